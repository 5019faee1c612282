"""Near-duplicates: MinHash bands propose, odd sketches sift, full shingle sets decide.

1. Each document's set of word shingles gives bands x rows MinHash values, the band keys, and an odd sketch: a bitmap in which
   each (position, MinHash value) flips one bit. Documents with equal sets are one node from here on, however many they are.
2. Nodes that share a band key are joined to the smallest node of that key; components of these edges are clusters of
   candidates, a superset of the true components.
3. A cluster is cut into chunks by hash; each pair of chunks is one group of bounded size. Inside it, the population count of
   the XOR of two sketches bounds their similarity: only pairs that may reach the threshold, and that are not yet in one
   component, are compared on their full sets. What leaves a group is a spanning forest of its links, never its pairs.
4. Components of the links are the answer.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

BANDS, ROWS, BITS = 30, 5, 512
CHUNK, CHUNK_SHINGLES, CHUNKS = 128, 2_000_000, 20
#: Parts that a large cluster's members are dealt in when they learn its chunks; nodes from which a component counts as one of many.
SALTS, MANY = 32, 1_000

_random = np.random.default_rng(20240229)
_FACTOR = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND = common.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's word shingles; of a shorter text the whole sequence as one."""
    words = (text or "").encode().translate(common.LOWER).split()
    return np.unique(common.window_hashes(common.word_hashes(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def minhash(items: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = max(1, 200_000 // len(_FACTOR))
        parts = [(items[i : i + step, None] * _FACTOR + _SHIFT).min(0) for i in range(0, len(items), step)]
    return np.minimum.reduce(parts)


def band_keys(values: np.ndarray) -> np.ndarray:
    out = _BAND.copy()
    with np.errstate(over="ignore"):
        for column in values.reshape(BANDS, ROWS).T:
            out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def odd_sketch(values: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        at = common.mix(values + np.arange(len(values), dtype=np.uint64)) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8).tobytes()


def most_flips(threshold: float) -> int:
    """The population count of the XOR beyond which two sets of that similarity lie with odds under one in 10**9.

    The share of differing samples is taken six standard errors above its mean, and the count of odd bits six above its own.
    """
    n = BANDS * ROWS
    differing = 2 * n * min(1.0, 1 - threshold + 6 * math.sqrt(threshold * (1 - threshold) / n))
    odd = (1 - (1 - 2 / BITS) ** differing) / 2
    return math.ceil(BITS * odd + 6 * math.sqrt(BITS * odd * (1 - odd)) / 2)


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def links(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, share: Fraction, flips: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different sides (side 0 and 1), or of all members if all are of side 2."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner_of, first = owner[order], np.searchsorted(at[order], np.arange(len(distinct) + 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    forest, out = Forest(len(sets)), []
    for a in range(len(sets)):
        near = np.bitwise_count(sketches[a + 1 :] ^ sketches[a]).sum(1) <= flips
        near &= (side[a + 1 :] != side[a]) if side[a] < 2 else True
        near &= forest.roots()[a + 1 :] != forest.root(a)
        others = np.flatnonzero(near) + a + 1
        if not len(others):
            continue
        mine = at[begin[a] : begin[a + 1]]
        lengths = first[mine + 1] - first[mine]
        places = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner_of[places], minlength=len(sets))[others]
        linked = share.denominator * both >= share.numerator * (sizes[a] + sizes[others] - both)
        for b in others[linked].tolist():
            ra, rb = forest.root(a), forest.root(b)
            if ra != rb:
                forest.parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def components(docs: DataFrame, size: int = 5, threshold: str = "0.8") -> DataFrame:
    """doc_id, ROW_KEY, n_shingles, component_id and kept of each row; links are Jaccard similarities >= threshold (a decimal).

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. Texts without words (null too)
    link with nothing; a row without id has part in its component and is not kept if another has an id, and stands for itself
    otherwise. Equal rows stay or go together; of equal texts the smallest id is kept. Very long texts are compared by their whole
    sets. An empty table gives no rows; columns beside doc_id and text are not read.
    """
    share, kind = Fraction(threshold), docs.schema["doc_id"].dataType.simpleString()
    keyed = common.with_row_key(docs.select("doc_id", "text"), "doc_id", "text")

    def sign(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
        values = [minhash(s) if len(s) else None for s in sets]
        with np.errstate(over="ignore"):
            sums = [(int(common.mix(s).sum()), int(common.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())) for s in sets]
        return {name: batch.column(name) for name in ("doc_id", *common.ROW_KEY)} | {
            "n_shingles": pa.array(map(len, sets), pa.int64()),
            "s1": pa.array(np.array([a for a, _ in sums], np.uint64).view(np.int64)), "s2": pa.array(np.array([b for _, b in sums], np.uint64).view(np.int64)),
            "bands": pa.array([None if v is None else band_keys(v).view(np.int64) for v in values], pa.list_(pa.int64())),
            "sketch": pa.array([None if v is None else odd_sketch(v) for v in values], pa.binary()),
        }

    signed = common.durable(common.map_batches(keyed, sign, f"doc_id {kind}, _h1 long, _h2 long, n_shingles long, s1 long, s2 long, bands array<bigint>, sketch binary"))
    same = ["s1", "s2", "n_shingles"]
    nodes = signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("low"), F.min(F.struct(*common.ROW_KEY)).alias("key"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    nodes = common.durable(nodes.withColumn("node", F.monotonically_increasing_id()))

    # candidates: the smallest node of each band key
    members = nodes.select("node", F.explode("bands").alias("band"))
    shared = common.durable(members.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("top"), F.count("*").alias("n")).where("n > 1"))
    pairs = shared.where("n = 2").select(F.col("top").alias("u"), "v").distinct()
    stars = members.join(shared.where("n > 2").select("band", "v"), "band").select(F.col("node").alias("u"), "v").distinct()
    clusters = common.durable(connected(pairs.union(stars)))

    # full sets of candidates, once each, from the text of one document of the node
    def pack(batch: pa.RecordBatch) -> dict:
        shorten = zstandard.ZstdCompressor(level=1).compress
        return {name: batch.column(name) for name in common.ROW_KEY} | {"packed": pa.array([shorten(t.encode()) for t in common.texts(batch)], pa.binary())}

    wanted = common.durable(clusters.join(nodes.select("node", "key.*", "sketch", "n_shingles"), "node"))
    whole = common.map_batches(keyed.drop("doc_id").where("text is not null"), pack, "_h1 long, _h2 long, packed binary")

    def unpack(batch: pa.RecordBatch) -> dict:
        read = zstandard.ZstdDecompressor().decompress
        sets = [shingles(read(p.as_py()).decode(), size).tobytes() for p in batch.column("packed")]
        return {name: batch.column(name) for name in ("node", "root", "sketch", "n_shingles")} | {"items": pa.array(sets, pa.binary())}

    sets = common.durable(common.map_batches(wanted.join(whole, common.ROW_KEY).drop(*common.ROW_KEY), unpack, "node long, root long, sketch binary, n_shingles long, items binary").dropDuplicates(["node"]))

    # groups of two chunks; a cluster has one chunk for CHUNK members or CHUNK_SHINGLES shingles, CHUNKS if that is fewer and they fit
    sized = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    chunks = F.greatest(F.least(F.ceil(F.col("n") / CHUNK), F.lit(CHUNKS)), F.ceil(F.col("total") / CHUNK_SHINGLES), F.ceil(F.col("n") / 8192)).cast("int")
    large = common.durable(sized.select("root", chunks.alias("chunks")).where("chunks > 1"))  # of CHUNK members or CHUNK_SHINGLES shingles and more
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = sets.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grouped = spread.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "sketch", "items")
    flips = most_flips(float(share))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        items = [np.frombuffer(b, np.uint64) for b in rows["items"]]
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(items), -1)
        side = np.full(len(items), 2) if rows["i"][0] == rows["j"][0] else (np.array(rows["chunk"]) == rows["j"][0]).astype(int)
        found, node = links(items, sketches, side, share, flips) if len(items) > 1 else [], rows["node"]
        return pa.table({"u": pa.array([node[a] for a, _ in found], pa.int64()), "v": pa.array([node[b] for _, b in found], pa.int64())})

    linked = common.durable(grouped.groupBy("root", "i", "j").applyInArrow(compare, "u long, v long"))
    for past in (shared, clusters, wanted, sets, large):  # what the links were made from
        common.discard(past)
    roots = common.durable(connected(linked))
    lows = common.durable(roots.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
    # a component of many nodes is labelled through the short table of such ones; its rows meet nothing in the other join, under keys of their own
    many = common.durable(lows.where(F.col("n") > MANY).select("root", F.struct("component_id").alias("of_many")))
    few = lows.where(F.col("n") <= MANY).select(F.col("root").alias("of"), "component_id")
    parts = roots.join(many, "root", "left").withColumn("of", F.when(F.col("of_many").isNull(), F.col("root")).otherwise(-1 - F.col("node")))
    labels = parts.join(few, "of", "left").select("node", F.coalesce("of_many.component_id", "component_id").alias("component_id"))
    found = common.durable(nodes.select("node", *same, "low").join(labels, "node", "left").select(*same, F.coalesce("component_id", "low").alias("component_id")))
    for past in (nodes, linked, roots, lows, many):
        common.discard(past)
    out = signed.select("doc_id", *common.ROW_KEY, *same).join(found, same, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("component_id").eqNullSafe(F.col("doc_id"))
    return out.select("doc_id", *common.ROW_KEY, "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, threshold: str = "0.8") -> DataFrame:
    """`docs` without the rows that aren't kept; its columns as they were."""
    gone = components(docs, size, threshold).where("not kept").select(*common.ROW_KEY).distinct()
    return common.keyed_rows(docs, "doc_id", "text").join(gone, common.ROW_KEY, "left_anti").select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.documents(spark, sf_dir), 3, "0.85").select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op2_near_dedup": op2_near_dedup}
