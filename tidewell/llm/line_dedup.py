"""Line dedup: of a long line that several documents hold, the last document keeps it.

Keys of lines are dealt by range of (hash, document descending, position) and sorted alike, so a line that a third of all
documents holds spreads over as many partitions as its rows need. Each partition is streamed: the first occurrence of a
hash is the one that stays. A hash that crosses an edge between partitions is settled by edge summaries, at most two rows a
partition. What comes back is a compressed bitmap of kept lines for each document that loses some, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, int, int]]:
    """(position, two halves of the key's hash) of each line whose key is long enough."""
    for position, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(common.SPACE)
        if len(key) >= min_chars and len(key.decode()) >= min_chars:
            value = xxhash.xxh3_128_intdigest(key.translate(common.LOWER))
            yield position, (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def keys(docs: DataFrame, min_chars: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        found = [(i, *key) for i, text in enumerate(common.texts(batch)) for key in line_keys(text, min_chars)]
        at = pa.array([f[0] for f in found], pa.int32())
        out = {name: batch.column(name).take(at) for name in ("doc_id", *common.ROW_KEY)}
        return out | {name: pa.array([f[k] for f in found], kind) for name, k, kind in (("position", 1, pa.int32()), ("hi", 2, pa.int64()), ("lo", 3, pa.int64()))}

    read = common.with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    return common.map_batches(read, rows, f"doc_id {kind}, _h1 long, _h2 long, position int, hi long, lo long")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of one hash inside each batch of the sorted stream; a run may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
        cuts = [0, *(np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1).tolist(), len(hi)]
        for a, b in zip(cuts, cuts[1:]):
            yield (int(hi[a]), int(lo[a])), batch.slice(a, b - a)


def changes(previous: object, docs: list) -> int:
    """Documents in a run that is sorted by document, beyond `previous`, the document before it."""
    return sum(a != b for a, b in zip([previous, *docs], docs))


_NONE = object()


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last hash of the partition: documents it has here, its first and its last document."""
    key, ends = None, []
    for k, run in groups(batches):
        docs = run.column("doc_id").to_pylist()
        if k != key:
            ends = [*ends[:1], (k, 0, docs[0], _NONE)]
            key = k
        _, n, first, last = ends[-1]
        ends[-1] = (k, n + changes(last, docs), first, docs[-1])
    if ends:
        part, kind = TaskContext.get().partitionId(), run.column("doc_id").type
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(ends), pa.int32()), "hi": [e[0][0] for e in ends], "lo": [e[0][1] for e in ends], "n_docs": [e[1] for e in ends],
            "first": pa.array([e[2] for e in ends], kind), "last": pa.array([e[3] for e in ends], kind),
        })


def spanning(summaries: list) -> dict[tuple[int, int], tuple[int, object]]:
    """(documents, the document that keeps it) of hashes at partition edges; the summaries are in order of partition."""
    found: dict = {}
    for s in summaries:
        n, keeper, last = found.get((s.hi, s.lo), (0, s.first, _NONE))
        found[s.hi, s.lo] = (n + s.n_docs - (last is not _NONE and last == s.first), keeper, s.last)
    return {k: v[:2] for k, v in found.items()}


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """ROW_KEY, n_dropped and bitmap (zlib, bit set: the line stays, most significant first) of each row that loses lines.

    Rows with one doc_id (null included, the smallest) are one document when documents are counted, and equal rows share
    their ROW_KEY and so their bitmap. Null and empty texts have no long line; a very long text is a row for each long line. Of
    documents that hold a line the largest id keeps it, all its occurrences there. An empty table gives no rows, and columns
    beside doc_id and text are not read.
    """
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc_nulls_last(), F.col("_h1"), F.col("_h2"), F.col("position")]
    dealt = common.checkpointed(keys(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order))  # ranges differ from run to run
    kind = docs.schema["doc_id"].dataType.simpleString()
    summaries = dealt.mapInArrow(edges, f"part int, hi long, lo long, n_docs long, first {kind}, last {kind}").collect()  # two rows a partition at most
    at_edges = docs.sparkSession.sparkContext.broadcast(spanning(sorted(summaries, key=lambda s: s.part)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops what isn't of the keeper, once enough documents are seen; the first min_docs documents wait for that."""
        key, known, n, last, keeper, waiting = None, None, 0, _NONE, None, []
        names = [*common.ROW_KEY, "position"]
        for k, run in groups(batches):
            ids = run.column("doc_id").to_pylist()
            if k != key:
                key, n, last, waiting = k, 0, _NONE, []
                known = at_edges.value.get(k)
                keeper = known[1] if known else ids[0]
            n, last = n + changes(last, ids), ids[-1]
            out = run.filter(pa.array([x != keeper for x in ids])).select(names)
            if (known[0] if known else n) >= min_docs:
                yield from (b for b in [*waiting, out] if b.num_rows)
                waiting = []
            elif not known:
                waiting.append(out)

    def bitmaps(batch: pa.RecordBatch) -> dict:
        out = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("positions").to_pylist()):
            bits = np.ones(-(-n // 8) * 8, bool)  # lines past the last dropped one stay
            bits[gone] = False
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        return {name: batch.column(name) for name in (*common.ROW_KEY, "n_dropped")} | {"bitmap": pa.array(out, pa.binary())}

    gone = dealt.mapInArrow(stream, "_h1 long, _h2 long, position int").groupBy(*common.ROW_KEY)
    gone = gone.agg(F.collect_set("position").alias("positions"), (F.max("position") + 1).alias("n_lines")).withColumn("n_dropped", F.size("positions").cast("long"))
    return common.map_batches(gone, bitmaps, "_h1 long, _h2 long, n_dropped long, bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    """The text without the lines whose bit is unset; lines beyond the bitmap stay."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return "\n".join(line for line, bit in zip(lines, [*bits.tolist(), *[1] * (len(lines) - len(bits))]) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of `docs` as the struct `row`, with n_dropped and bitmap, null where all lines stay."""
    return common.keyed_rows(docs, "doc_id", "text").join(bitmaps, common.ROW_KEY, "left").select("row", "n_dropped", "bitmap")


def fields(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    row = batch.column("row")
    return dict(zip((f.name for f in row.type), row.flatten()))


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with its columns as they were and the dropped lines gone from text; null stays null."""

    def rows(batch: pa.RecordBatch) -> dict:
        columns = fields(batch)
        pairs = zip(columns["text"].to_pylist(), batch.column("bitmap").to_pylist())
        return columns | {"text": pa.array([t if t is None else kept_text(t, b) for t, b in pairs], pa.string())}

    return common.map_batches(with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)), rows, common.schema_of(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(batch: pa.RecordBatch) -> dict:
        columns = fields(batch)
        texts = [t or "" for t in columns["text"].to_pylist()]
        kept = [kept_text(t, b) for t, b in zip(texts, batch.column("bitmap").to_pylist())]
        return {
            "doc_id": columns["doc_id"], "n_lines": pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
            "n_dropped": batch.column("n_dropped").fill_null(0), "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string()),
        }

    return common.map_batches(with_bitmaps(docs, keep_bitmaps(docs)), digests, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = {
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, translate(trim(parts[i], e' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), held AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN held h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
QUERIES = {"op9_line_dedup": op9_line_dedup}
