"""Helpers that the corpus operators share: rows through Arrow, words, hashes, durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and line rule here: \x20 and \x09-\x0D, which is what bytes.split() splits at.
SPACE = b" \t\n\x0b\x0c\r"
#: For bytes.translate: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """A narrow map over Arrow batches; `rows` turns a batch into columns named as in `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(batch))

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; a temporary folder only on one machine (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tidewell-checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder and read from there: later jobs start from it, whichever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/tidewell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a durable table early; nothing may read it any more."""
    _delete(df.sparkSession, df._durable_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """As durable(), but partitions stay as they are, in number, order and rows: for streams over sorted partitions."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def clean() -> None:
    """Delete the durable tables made so far; their frames must not be used afterwards. Runs when the driver ends."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


ROW_KEY = ["_h1", "_h2"]


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ROW_KEY, a never-null 128-bit identity for joins in place of a nullable or repeated id; equal rows share it."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return df.withColumns({name: F.xxhash64(F.lit(name), *parts) for name in ROW_KEY})


def keyed_rows(df: DataFrame, *columns: str) -> DataFrame:
    """ROW_KEY beside whole rows in one struct `row`, so that no column of `df` meets a name of ours; select("row.*") gives them back."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    parts = [x for c in columns for x in (F.col(f"row.`{c}`").isNull(), F.col(f"row.`{c}`"))]
    return rows.withColumns({name: F.xxhash64(F.lit(name), *parts) for name in ROW_KEY})


class WordHash(dict):
    """bytes -> 64-bit hash as numpy's int64, remembered for the words seen of late."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


_hashes = WordHash()
_caches: dict[str, dict] = {}


def keep_only(owner: str, cache: dict) -> None:
    """A worker serves one stage after another; it lets the large caches of other operators go when one begins to fill its own."""
    for name in [x for x in _caches if x != owner]:
        _caches.pop(name).clear()
    _caches[owner] = cache


def word_hashes(words: list[bytes]) -> np.ndarray:
    if "words" not in _caches:
        keep_only("words", _hashes)
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd factors), so that sums and low bits of hashes behave as random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every k consecutive word hashes, by doubling; mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, size, factor = None, 0, h, 1, np.uint64(base | 1)
    with np.errstate(over="ignore"):
        step = factor  # base ** size
        while True:
            if k & size:
                # out covers the last `have` words of the window; the new block stands before it
                out, have = (power, size) if out is None else (power[: len(h) - have - size + 1] * base_power(factor, have) + out[size : size + len(h) - have - size + 1], have + size)
            size *= 2
            if size > k:
                break
            power = power[: len(power) - size // 2] * step + power[size // 2 :]
            step = step * step
    return mix(out[:n])


def base_power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))
