"""Sharding by histogram sort, with DataFrame operations alone: shards of near-equal bytes, equal texts side by side.

The key of a row is 128 bits: the hash of its text, then a hash of its id and place. Rounds of exact byte histograms narrow
the place of each boundary: a round counts bytes below 4096 probes inside the interval that holds the target, until a probe
is within `tolerance` of a shard's bytes. A boundary falls between texts where that is near enough, and inside a group of
equal texts only where the group itself is too large for that. Rows are then exchanged once, to their place in the shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common

STEP, WORD = 12, 64
MIN = -(1 << 63)


def with_keys(docs: DataFrame) -> DataFrame:
    """size, text_crc32 and the key (k1, k2, in signed order) of each row; null texts have no bytes. `_k2` differs between equal rows."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")),
        "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()),
    })


def prefix(depth: int) -> Column:
    """The first `depth` bits of a key as an unsigned number within its word: of k1 up to 64, beyond that of k2 alone."""
    word, bits = (F.col("_k1"), depth) if depth <= WORD else (F.col("_k2"), depth - WORD)
    return F.shiftrightunsigned(word.bitwiseXOR(F.lit(MIN)), WORD - bits)


def next_depth(depth: int) -> int:
    return min(depth + STEP, WORD if depth < WORD else 2 * WORD)


def histogram(keyed: DataFrame, inside: set[int], depth: int) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) of each prefix of the next depth that lies inside the intervals; at most 4096 an interval."""
    deeper = next_depth(depth)
    rows = keyed
    if 0 < depth <= WORD:
        rows = rows.where(prefix(depth).isin([signed(p) for p in inside]))
    elif depth > WORD:
        places = [(p >> depth - WORD, p & (1 << depth - WORD) - 1) for p in inside]
        rows = rows.where(reduce(lambda x, y: x | y, [(F.col("_k1") == a + MIN) & (prefix(depth) == b) for a, b in places]))
    first = (F.col("_k1").bitwiseXOR(F.lit(MIN)) if deeper > WORD else F.lit(0)).alias("a")
    found = rows.groupBy(first, prefix(deeper).alias("b")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    width = deeper - WORD if deeper > WORD else deeper
    return {(unsigned(r.a) << width if deeper > WORD else 0) | unsigned(r.b): (r.bytes, r.rows) for r in found}


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def unsigned(x: int) -> int:
    return x % (1 << 64)


def splitters(keyed: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> tuple[list[int], int]:
    """Keys (128 bits, unsigned) at which the shards after the first begin, and the number of rows."""
    total, rows, depth, found = None, 0, 0, {}
    open_: dict[int, tuple[int, int]] = {j: (0, 0) for j in range(1, shards)}  # target -> (interval's prefix, bytes below it)
    while open_ and depth < 2 * WORD:
        deeper = next_depth(depth)
        counts = sorted(histogram(keyed, {p for p, _ in open_.values()}, depth).items())
        if total is None:
            total, rows = sum(b for _, (b, _) in counts), sum(n for _, (_, n) in counts)
        still = {}
        for j, (inside, below) in open_.items():
            target, low = total * j / shards, below
            mine = [(p, c) for p, c in counts if p >> deeper - depth == inside]
            for p, (size, n) in mine:
                if low + size >= target or p == mine[-1][0]:
                    edge, error = min(((p, abs(target - low)), (p + 1, abs(low + size - target))), key=lambda x: x[1])
                    near = tolerance if deeper < WORD else max(tolerance, group_tolerance)
                    if error <= near * total / shards or n == 1 or deeper == 2 * WORD:
                        found[j] = edge << 2 * WORD - deeper
                    else:
                        still[j] = (p, low)
                    break
                low += size
        open_, depth = still, deeper
    return [found[j] for j in sorted(found)], rows


def shard_of(bounds: list[int]) -> Column:
    """The number of bounds at or below the key."""
    out = F.lit(0)
    for bound in bounds:
        if bound >> 2 * WORD:  # beyond every key
            continue
        first, second = F.lit((bound >> WORD) + MIN), F.lit((bound & (1 << WORD) - 1) + MIN)
        out = out + ((F.col("_k1") > first) | ((F.col("_k1") == first) & (F.col("_k2") >= second))).cast("int")
    return out


def assign(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, group_tolerance: float = 0.01, rows_per_run: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0 up, without gaps in a shard) of each row.

    Null texts count as empty; null and repeated ids and equal rows each get a slot of their own; an empty table gives no
    rows; a table with fewer rows than shards leaves shards empty. Columns beside doc_id and text are not read.
    A boundary misses its place by `tolerance` of a shard's bytes at most; between texts also by `group_tolerance`, so that a
    group of equal texts is parted only where that would be exceeded. Ties of keys go by rows of their own; texts of any length
    are one row each. A shard's slots run through sub-ranges by the key's second half, so no task holds a shard.
    """
    keyed = common.durable(with_keys(docs.select("doc_id", "text")).drop("text"))
    bounds, rows = splitters(keyed, shards, tolerance, group_tolerance)
    runs = max(64, -(-rows // (shards * rows_per_run)))
    placed = keyed.withColumns({"shard": shard_of(bounds), "_run": F.pmod("_k2", F.lit(runs)).cast("int")})
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "_run").agg(F.count("*").alias("n"))  # shards * runs rows: one for a million rows, or 64 a shard
    starts = sizes.select("shard", "_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_k1", "_k2"))
    numbered = placed.withColumn("at", within).join(starts, ["shard", "_run"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.001, group_tolerance: float = 0.01, rows_per_file: int = 1_000_000) -> None:
    """Whole rows as Parquet under path/shard=N, by the same boundaries; one exchange, and about `rows_per_file` rows a file.

    All columns are written as they are, nulls and repeated rows too; a column `shard` of the caller would clash with the
    folders' and is an error. An empty table writes no shard.
    """
    if "shard" in docs.columns:
        raise ValueError("the rows have a column `shard`, which the folders need")
    # rows and keys are one table: what is recomputed after a loss has the keys that the boundaries were counted over
    keyed = common.durable(with_keys(docs.select(F.struct("*").alias("row"), "doc_id", "text")).drop("doc_id", "text"))
    bounds, rows = splitters(keyed.drop("row"), shards, tolerance, group_tolerance)
    files = max(1, -(-rows // (shards * rows_per_file)))
    placed = keyed.withColumns({"shard": shard_of(bounds), "_run": F.pmod("_k2", F.lit(files))})
    placed.repartition(shards * files, "shard", "_run").select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(common.documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
