"""Ranked lexical search with per-term geometric blocking: clustered posting lists, maximum summaries, exact skips.

1. One pass counts the terms of every text: a row for each document with the terms that some query of the block holds, and a
   row for each task with its part of the statistics. Queries come in blocks of bounded size, so the terms may be broadcast.
2. A task indexes its documents in shards of bounded size. A shard has a posting list for each term with the list's largest part of
   a score. A list that is needed is clustered: its documents go to the nearest of some documents of the list, nearness being
   that of signed projections of their score vectors. A block of such documents has a summary, the largest value in each
   coordinate, so no document of the block scores higher than the summary does.
3. A query has the k best so far. Lists whose largest parts together stay below the k-th score need no visit (lists of common
   terms, mostly); of the others, blocks are skipped only where the summary's score stays below, or equals it with no smaller id
   in the block. Whatever is left is scored in whole numbers.
4. A bounded sample of the documents is searched first. Its k-th scores are lower bounds of the final ones, and with them all
   tasks start; what they find is merged by (score, id).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that belong to terms: digits, letters (A-Z as a-z) and all beyond ASCII; every other byte parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
CHUNK = 1 << 20
#: Bounds of a block of queries, of a shard, of a block of a posting list (about), and of the sample that gives first bounds.
QUERY_ITEMS, QUERY_BYTES, SHARD_ROWS, SHARD_POSTINGS, BLOCK_ROWS, SAMPLE_ROWS = 4096, 16 << 20, 8_192, 1_500_000, 32, 16_384
SKETCH = 32
LAST = np.iinfo(np.int64).max


def term_counts(text: str | None) -> Counter:
    """Terms (UTF-8) and how often they stand in the whole text, which is split a part at a time."""
    counts, body, at = Counter(), (text or "").encode().translate(TERM_BYTES), 0
    while at < len(body):
        end = body.find(b" ", at + CHUNK)
        end = len(body) if end < 0 else end
        counts.update(body[at:end].split())
        at = end
    return counts


def ranges(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of these rows one after another, and where each row's begin among them."""
    sizes = begin[rows + 1] - begin[rows]
    starts = np.cumsum(sizes) - sizes
    return np.repeat(begin[rows] - starts, sizes) + np.arange(sizes.sum()), starts


@dataclass
class Query:
    """The terms of an item, its k best (score, id, place), and bounds that hold from the start."""

    terms: np.ndarray
    k: int
    floor: tuple[int, int] = (0, LAST)
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def bound(self) -> tuple[int, int]:
        """A document that scores less, or as much with a larger id, isn't among the k best."""
        return max(self.floor, (int(self.scores[-1]), int(self.ids[-1])), key=lambda b: (b[0], -b[1])) if len(self.scores) == self.k else self.floor

    def may_enter(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        score, last = self.bound()
        return (scores > score) | ((scores == score) & (ids <= last) & (score > 0))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = self.may_enter(scores, ids)
        scores, ids = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


@dataclass
class Blocks:
    """A clustered posting list: rows by block, and summaries as (term, largest value), sorted by block."""

    rows: np.ndarray
    begin: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    first: np.ndarray
    low: np.ndarray


class Shard:
    """An index of some documents: ids, and their (term, value) entries, `begin` saying where a document's are."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        self.ids, self.begin, self.terms, self.values, self.n_terms = ids, begin, terms, values, n_terms
        owner = np.repeat(np.arange(len(ids)), np.diff(begin))
        order = np.argsort(terms, kind="stable")
        self.listed, self.list_begin = owner[order], np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        there = np.flatnonzero(np.diff(self.list_begin))
        if len(there):
            self.most[there] = np.maximum.reduceat(values[order], self.list_begin[there])
        self.seen, self.mask, self.blocks, self._sketches = np.zeros(len(ids), bool), np.zeros(n_terms, np.int64), {}, None

    def sketches(self) -> np.ndarray:
        """Unit vectors whose products tell how alike two documents' score vectors are."""
        if self._sketches is None:
            signs = np.where(np.random.default_rng(12).integers(0, 2, (self.n_terms, SKETCH)), np.float32(1), np.float32(-1))
            out, step = np.zeros((len(self.ids), SKETCH), np.float32), 512
            for at in range(0, len(self.ids), step):
                some = np.arange(at, min(at + step, len(self.ids)))
                some = some[np.diff(self.begin)[some] > 0]
                if len(some):
                    places, starts = ranges(self.begin, some)
                    out[some] = np.add.reduceat(signs[self.terms[places]] * self.values[places, None].astype(np.float32), starts)
            self._sketches = out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
        return self._sketches

    def blocks_of(self, term: int) -> Blocks:
        if term not in self.blocks:
            rows = self.listed[self.list_begin[term] : self.list_begin[term + 1]]
            n = -(-len(rows) // BLOCK_ROWS)
            if n > 1:
                like, centres = self.sketches(), rows[np.arange(n) * len(rows) // n]
                of = np.concatenate([np.argmax(like[rows[i : i + 4096]] @ like[centres].T, 1) for i in range(0, len(rows), 4096)])
                order = np.argsort(of, kind="stable")
                rows, of = rows[order], of[order]
            else:
                of = np.zeros(len(rows), np.int64)
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            places, starts = ranges(self.begin, rows)
            block = np.repeat(np.repeat(np.arange(len(begin) - 1), np.diff(begin)), np.diff(np.append(starts, len(places))))
            keys = block * self.n_terms + self.terms[places]
            order = np.argsort(keys)
            keys, heads = np.unique(keys[order], return_index=True)
            values = np.maximum.reduceat(self.values[places][order], heads)
            first = np.searchsorted(keys // self.n_terms, np.arange(len(begin) - 1))
            self.blocks[term] = Blocks(rows, begin, keys % self.n_terms, values, first, np.minimum.reduceat(self.ids[rows], begin[:-1]))
        return self.blocks[term]

    def search(self, query: Query) -> None:
        """Brings the documents of the shard that belong to the query's k best into them."""
        terms = query.terms[self.most[query.terms] > 0]
        terms = terms[np.argsort(self.most[terms], kind="stable")]
        together, visited = np.cumsum(self.most[terms]), []
        self.mask[terms] = 1
        for i in range(len(terms) - 1, -1, -1):
            if together[i] < query.bound()[0]:
                break  # documents with none of the terms visited so far stay below
            blocks = self.blocks_of(int(terms[i]))
            bounds = np.add.reduceat(blocks.values * self.mask[blocks.terms], blocks.first)
            ok = query.may_enter(bounds, blocks.low)
            rows = blocks.rows[np.repeat(ok, np.diff(blocks.begin))]
            rows = rows[~self.seen[rows]]
            if len(rows):
                self.seen[rows] = True
                visited.append(rows)
                places, starts = ranges(self.begin, rows)
                query.add(np.add.reduceat(self.values[places] * self.mask[self.terms[places]], starts), self.ids[rows])
        self.mask[terms] = 0
        for rows in visited:
            self.seen[rows] = False


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of each document with a term; and with `part` true, of each task: documents (as doc_id), their terms (n), df (tfs) of terms."""
    known, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>, part boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, some, total, df = known.value, 0, 0, Counter()
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                counts = term_counts(text)
                if counts:
                    own = counts.keys() & ids_of.keys()
                    ids.append(doc_id), sizes.append(counts.total()), terms.append([ids_of[t] for t in own]), tfs.append([counts[t] for t in own])
            df.update(t for own in terms for t in own)
            some, total = some + len(ids), total + sum(sizes)
            yield batch_of(ids, sizes, terms, tfs, False)
        yield batch_of([some], [total], [list(df)], [list(df.values())], True)

    def batch_of(ids: list, sizes: list, terms: list, tfs: list, part: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64())), "part": pa.array([part] * len(ids), pa.bool_())})

    return common.durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind))


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """item, rank, doc_id, score for a block of (item, text)."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    terms = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in term_counts(text)], np.int64) for _, text in items]
    rows = counted(docs, vocabulary)
    n, total = rows.where("part").agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.where("part").select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs")).collect())  # a row a term of the block
    weights = np.array([weight(n, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)

    def run(bounds):
        given = spark.sparkContext.broadcast((terms, weights, bounds))

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, weights, bounds = given.value
            queries = [Query(t, k, bounds.get(i, (0, LAST))) for i, t in enumerate(terms)]
            for shard in shards(batches, weights, n, total):
                for query in queries:
                    shard.search(query)
            item = np.repeat(np.arange(len(queries)), [len(q.ids) for q in queries])
            ids = np.concatenate([q.ids for q in queries])
            yield pa.RecordBatch.from_pydict({"item": pa.array([items_of[i] for i in item.tolist()], pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=ids == LAST), "score": np.concatenate([q.scores for q in queries])})

        return tops

    items_of = [i for i, _ in items]
    postings = rows.where("not part and size(terms) > 0").select("doc_id", "n", "terms", "tfs")
    schema = "item long, doc_id long, score long"
    drawn = postings.where(F.pmod(F.xxhash64("doc_id", "n", F.lit(12)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30)))
    first = best_rows(drawn.mapInArrow(run({}), schema), k).where(F.col("rank") == k).collect()  # a row an item of the block
    at = {item: i for i, item in enumerate(items_of)}
    bounds = {at[r["item"]]: (r["score"], LAST if r["doc_id"] is None else r["doc_id"]) for r in first}
    return best_rows(postings.mapInArrow(run(bounds), schema), k).select("item", "rank", "doc_id", "score")


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, total: int) -> Iterator[Shard]:
    """Shards of the rows' entries, with the values that terms add to scores."""
    held: list[tuple] = []
    rows = entries = 0

    def made() -> Shard:
        ids, sizes, terms, values = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return Shard(ids, np.concatenate([[0], np.cumsum(sizes)]), terms, values, len(weights))

    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            m = np.array([10 + 90 * x * n // total for x in batch.column("n").to_pylist()], np.int64)
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            terms, tfs = lists.flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy()
            values = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes)))
            held.append((ids, sizes, terms, values))
            rows, entries = rows + len(ids), entries + len(terms)
            if rows >= SHARD_ROWS or entries >= SHARD_POSTINGS:
                yield made()
                rows = entries = 0
    if held:
        yield made()


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best rows of `docs` for each row of `items` (item_id, text), scores above 0 only.

    Equal scores go by ascending doc_id, null last. Null texts have no terms, and no part in the statistics; texts without
    one likewise. Rows with one id, and equal rows, are ranked row by row on both sides; null item ids are kept. Texts are read whole,
    however long. Without documents or items there are no rows; further columns are not read. doc_id is a whole number.
    """
    keyed = common.durable(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    count, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, found = max(1, -(-count // QUERY_ITEMS), -(-size // QUERY_BYTES)), []
    for b in range(blocks):  # hashes deal the items evenly, so a block is about as large as its bounds
        rows = keyed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        if rows:
            found.append(common.durable(search_block(docs, [(r["item"], r["text"]) for r in rows], k)))
    if not found:
        found.append(docs.where("false").select(F.lit(0).cast("long").alias("item"), F.lit(0).alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(keyed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = {
    "op12_lexical_search": r"""
WITH raw AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM raw),
d AS (SELECT id, w, len(w) AS n FROM w WHERE side = 'd' AND len(w) > 0),
c AS (SELECT count(*) AS nn, sum(n) AS ll FROM d),
q AS (SELECT DISTINCT id AS item_id, unnest(w) AS t FROM w WHERE side = 'i'),
p AS (SELECT id, n, t, count(*) AS tf FROM (SELECT id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
x AS (SELECT p.id, p.t, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS double))) AS bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS v FROM p JOIN f USING (t), c),
s AS (SELECT item_id, id AS doc_id, CAST(sum(v) AS bigint) AS score FROM q JOIN x USING (t) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""
}
QUERIES = {"op12_lexical_search": op12_lexical_search}
