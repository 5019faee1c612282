"""Substring dedup by relative Lempel-Ziv factors against indexed blocks of the whole corpus.

Words are looked up as windows of `window` words. Of each run of window - GRAM + 1 word grams the smallest hash is the window's
anchor; equal windows have equal anchors, so a window can only stand twice if its anchor does, and only those are indexed.

1. Blocks. A window goes to a block by its anchor, so windows side by side mostly meet in one block and travel as one row.
   Anchors with very many places are spread over blocks by document and stretch. A block is bounded, and is indexed in memory:
   each distinct window of the block has places (document, start) in its reference, the first few of all in order. Every document's
   windows are looked up in their blocks, and get the first PLACES of the others; look-ups that go on at one place leave as one stretch.
2. A window of a spread anchor that is alone in its block is looked up once more among those of the other blocks.
3. Parse. A document is factored greedily from the left: a factor begins at the first start that the index holds, at that of its
   places from which the reference goes on longest, over the edges of blocks too. Starts go on being looked up behind a factor's
   last window, so windows across the edge of two factors are found like any other. Factors are the duplicate spans.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM = 12
#: Windows in a block, about; places of an anchor from which it is spread; words of a document that stay together then.
BLOCK, HOT, STRETCH = 1_000_000, 20_000, 65_536
#: Places of a window that a factor may begin at. Which words are duplicates does not depend on it.
PLACES = 3
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def sliding(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """pick over every `size` consecutive values, by doubling."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class Words:
    """The words of some texts end to end, with the hashes of their grams; windows lie inside one text."""

    def __init__(self, split: list[list[bytes]], window: int):
        self.window, self.sizes = window, np.array([len(w) for w in split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = common.word_hashes(list(chain.from_iterable(split)))
        self.owner = np.repeat(np.arange(len(split)), self.sizes)
        size = window - min(GRAM, window) + 1
        self.grams = common.window_hashes(self.hashes, min(GRAM, window))
        if len(self.hashes) < window:
            self.inside, self.least = np.empty(0, bool), np.empty(0, np.uint64)
            return
        self.inside = self.owner[: len(self.owner) - window + 1] == self.owner[window - 1 :]
        self.least = np.where(self.inside, sliding(self.grams, size), np.uint64(0))  # of each window its anchor

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams that are smallest in some window, in order, and their number in each text."""
        if not self.inside.any():
            return np.empty(0, np.int64), np.zeros(len(self.sizes), np.int64)
        around = np.zeros(len(self.grams) - len(self.least), np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([around, self.least, around]), len(around) + 1, np.maximum) == self.grams)
        at = at[self.grams[at] != 0]
        return self.grams[at].view(np.int64), np.bincount(self.owner[at], minlength=len(self.sizes))

    def keys(self, at: np.ndarray) -> np.ndarray:
        """95 bits for each window that begins at one of these places."""
        out = np.empty(len(at), KEY)
        out["a"] = common.window_hashes(self.hashes, self.window)[at]
        out["b"] = common.window_hashes(self.hashes, self.window, 0xD1B54A32D192ED03)[at] >> np.uint64(33)
        return out


def parts(sizes: list[int], limit: int = 1 << 21) -> Iterator[slice]:
    """Slices of about `limit` in all, at least one item each: what is held at a time."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += size + 1
    if held:
        yield slice(begin, len(sizes))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def index_rows(words: Words, row_ids: np.ndarray, repeated: np.ndarray, hot: dict[int, int], blocks: int) -> dict:
    """Runs of windows with one repeated anchor: block, row_id, start, hot, and the windows' keys as bytes."""
    at = np.flatnonzero(words.inside & np.isin(words.least, repeated))
    anchor, rows, starts = words.least[at], row_ids[words.owner[at]], at - words.begin[words.owner[at]]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1) | (starts[1:] % STRETCH == 0)
    begin = np.flatnonzero(new)
    anchor, rows, starts = anchor[begin], rows[begin], starts[begin]
    block, is_hot = (common.mix(anchor) >> np.uint64(33)).astype(np.int64), np.zeros(len(begin), bool)
    if hot:
        known = np.array(sorted(hot), np.uint64)
        place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        is_hot = known[place] == anchor
        over = np.array([hot[int(k)] for k in known], np.int64)[place]
        salt = (common.mix((rows * 31 + starts // STRETCH).astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
        block = np.where(is_hot, block + salt % over, block)
    offsets = np.append(begin, len(at)) * KEY.itemsize
    data = words.keys(at).tobytes()
    keys = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
    return {"block": pa.array(block % blocks, pa.int32()), "row_id": pa.array(rows, pa.int64()), "start": pa.array(starts, pa.int32()), "hot": pa.array(is_hot), "keys": keys}


def stretches(rows: np.ndarray, starts: np.ndarray, ref_rows: np.ndarray, ref_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of look-ups in order of (row, start): where those that go on at one place begin, and how many they are."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1) | (ref_rows[1:] != ref_rows[:-1]) | (ref_starts[1:] != ref_starts[:-1] + 1)
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(rows)))


FOUND = "row_id long, start int, n int, ref_row long, ref_start int, a long, b int, alone boolean"


def look_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For windows in order of (row, start): the size of each one's group of equal windows, its place in the group, where the group begins in `order`, and `order`."""
    order = np.lexsort((keys["b"], keys["a"]))  # stable: groups stay in order of (row, start)
    ordered = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(begin, len(order)))
    group, rank, first = (np.empty(len(order), np.int64) for _ in range(3))
    group[order], first[order] = np.repeat(sizes, sizes), np.repeat(begin, sizes)
    rank[order] = np.arange(len(order)) - np.repeat(begin, sizes)
    return group, rank, first, order


def parse_block(batches: Iterator[pa.RecordBatch], places: int = PLACES) -> Iterator[pa.RecordBatch]:
    """All look-ups of one block as stretches; of spread anchors also the windows alone here, and a first place of the others."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    runs = pa.Table.from_batches(held).combine_chunks()
    rows, starts, hot = (runs.column(name).to_numpy() for name in ("row_id", "start", "hot"))
    order = np.lexsort((starts, rows))
    packed = runs.column("keys").take(pa.array(order)).combine_chunks()
    packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    keys = np.frombuffer(packed.buffers()[2], KEY, count=(offsets[-1] - offsets[0]) // KEY.itemsize, offset=int(offsets[0]))
    counts = np.diff(offsets) // KEY.itemsize
    rows, hot = np.repeat(rows[order], counts), np.repeat(hot[order], counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(starts[order], counts) + within
    group, rank, first, order = look_up(keys)
    none = lambda k, kind: pa.nulls(k, kind)
    names = [f.split()[0] for f in FOUND.split(", ")]
    for slot in range(min(places, int(group.max()) - 1)):
        at = np.flatnonzero(group > slot + 1)
        ref = order[first[at] + slot + (slot >= rank[at])]  # the slot-th of the group's others
        begin, n = stretches(rows[at], starts[at], rows[ref], starts[ref])
        f, r = at[begin], ref[begin]
        for i in range(0, len(f), 100_000):
            g, h, k = f[i : i + 100_000], r[i : i + 100_000], n[i : i + 100_000]
            columns = [pa.array(rows[g], pa.int64()), pa.array(starts[g], pa.int32()), pa.array(k, pa.int32()), pa.array(rows[h], pa.int64()), pa.array(starts[h], pa.int32()), none(len(g), pa.int64()), none(len(g), pa.int32()), none(len(g), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)
    late = np.flatnonzero(hot & ((group == 1) | (rank < 2)))  # of groups the first and second place
    for i in range(0, len(late), 100_000):
        f = late[i : i + 100_000]
        columns = [pa.array(rows[f], pa.int64()), pa.array(starts[f], pa.int32()), pa.array(np.ones(len(f), np.int32)), none(len(f), pa.int64()), none(len(f), pa.int32()), pa.array(keys["a"][f].view(np.int64)), pa.array(keys["b"][f].astype(np.int32)), pa.array(group[f] == 1)]
        yield pa.RecordBatch.from_arrays(columns, names)


def across_blocks(found: DataFrame) -> DataFrame:
    """Look-ups of the windows that are alone in their block, among the same windows of other blocks (a few rows a block and window)."""
    late = found.where("a is not null").select("a", "b", "alone", F.struct("row_id", "start").alias("at"))
    groups = late.groupBy("a", "b").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.collect_list(F.when(F.col("alone"), F.col("at"))).alias("alone")).where("low <> high and size(alone) > 0")
    each = groups.select("low", "high", F.explode("alone").alias("at")).withColumn("ref", F.when(F.col("at") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    return each.select("at.row_id", "at.start", F.lit(1).alias("n"), F.col("ref.row_id").alias("ref_row"), F.col("ref.start").alias("ref_start"))


def factors(found: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, ref_row, ref_start) in words, from stretches of look-ups (start, n, ref_row, ref_start); they may overlap at their edges.

    Stretches along one place are one match, whichever blocks they come from. A factor takes the match that goes on longest from its
    first window, the first place of those that end together.
    """
    matches: list[list[int]] = []  # start, end (of windows), ref_row, ref_start - start
    for ref_row, shift, start, n in sorted((r, q - at, at, n) for at, n, r, q in found):
        if matches and matches[-1][2:] == [ref_row, shift] and start <= matches[-1][1]:
            matches[-1][1] = max(matches[-1][1], start + n)
        else:
            matches.append([start, start + n, ref_row, shift])
    matches.sort()
    out, open_, i, at = [], [], 0, 0
    while i < len(matches) or open_:
        if not open_ or -open_[0][0] <= at:  # nothing goes on here: the next start that is found
            open_ = []
            if i == len(matches):
                break
            at = max(at, matches[i][0])
        while i < len(matches) and matches[i][0] <= at:
            start, end, ref_row, shift = matches[i]
            i += 1
            if end > at:
                heapq.heappush(open_, (-end, ref_row, shift))
        if open_ and -open_[0][0] > at:
            end, ref_row, shift = -open_[0][0], *open_[0][1:]
            out.append((at, end + window - 1, ref_row, at + shift))
            at = end
    return out


def keep(words: list[bytes], spans: list[tuple]) -> list[bytes]:
    kept, at = [], 0
    for start, end, *_ in spans:
        kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


def duplicate_spans(docs: DataFrame, window: int = 35, places: int = PLACES) -> DataFrame:
    """doc_id, row_id, n_words, spans (start, end, ref_row, ref_start in words), n_removed and kept_sha256 of each row of `docs`.

    Words are maximal runs without white space, unchanged. Null and short texts have no span. A row that stands twice is
    found in the other one; a factor's reference is the row of that row_id, null for rows without repeated anchors. A factor is
    the longest match among the first `places` other places of its windows, in order of row_id and start; ties go to the first. Very long texts are indexed like
    others, in stretches. Null ids are allowed; an empty table gives no rows; columns beside doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = common.with_row_key(docs.select("doc_id", "text"), "doc_id", "text")

    def first_pass(batch: pa.RecordBatch) -> dict:
        texts = common.texts(batch)
        hashes, counts, n_words, shas = [], [], [], []
        for part in parts([len(t) for t in texts]):
            split = [t.encode().split() for t in texts[part]]
            found, number = Words(split, window).anchors()
            hashes.append(found)
            counts.append(number)
            n_words += map(len, split)
            shas += map(digest, split)
        return {name: batch.column(name) for name in ("doc_id", *common.ROW_KEY)} | {
            "n_words": pa.array(n_words, pa.int64()), "sha": pa.array(shas, pa.string()), "hashes": lists(np.concatenate(hashes), np.concatenate(counts), pa.int64()),
        }

    first = common.durable(common.map_batches(keyed, first_pass, f"doc_id {kind}, _h1 long, _h2 long, n_words long, sha string, hashes array<bigint>"))
    each = first.select(*common.ROW_KEY, "n_words", F.explode("hashes").alias("hash"))
    repeated = common.durable(each.groupBy("hash").count().where("count > 1").select("hash", F.when(F.col("count") > HOT, F.ceil(F.col("count") / HOT).cast("int")).alias("salts")))
    hot = F.collect_set(F.when(F.col("salts").isNotNull(), F.struct("hash", "salts")))
    flagged = each.join(repeated, "hash").groupBy(*common.ROW_KEY).agg(F.collect_set("hash").alias("hashes"), hot.alias("hot"), F.max("n_words").alias("n_words"))

    def packed(batch: pa.RecordBatch) -> dict:
        shorten = zstandard.ZstdCompressor(level=1).compress
        return {name: batch.column(name) for name in common.ROW_KEY} | {"packed": pa.array([shorten(t.encode()) for t in common.texts(batch)], pa.binary())}

    whole = common.map_batches(keyed.drop("doc_id").where(F.length("text") >= 2 * window - 1), packed, "_h1 long, _h2 long, packed binary")
    suspects = common.durable(whole.join(flagged, common.ROW_KEY).withColumn("row_id", F.monotonically_increasing_id()))

    base = common.durable(first.drop("hashes"))
    common.discard(first)  # the anchors, the larger part; suspects hold their own
    common.discard(repeated)
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(suspects.agg(F.sum("n_words")).first()[0] or 0) // BLOCK))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in parts(batch.column("n_words").to_pylist(), 1 << 18):
                some = batch.slice(part.start, part.stop - part.start)
                words = Words([unpack(p.as_py()).split() for p in some.column("packed")], window)
                hot = {h["hash"] % (1 << 64): h["salts"] for row in some.column("hot").to_pylist() for h in row}
                yield pa.RecordBatch.from_pydict(index_rows(words, some.column("row_id").to_numpy(), some.column("hashes").flatten().to_numpy().view(np.uint64), hot, blocks))

    windows = suspects.select("row_id", "packed", "hashes", "hot", "n_words").mapInArrow(index, "block int, row_id long, start int, hot boolean, keys binary")
    found = common.durable(windows.repartitionById(blocks, F.col("block")).drop("block").mapInArrow(lambda batches: parse_block(batches, places), FOUND))
    all_found = found.where("a is null").select("row_id", "start", "n", "ref_row", "ref_start").union(across_blocks(found))
    by_row = all_found.groupBy("row_id").agg(F.collect_list(F.struct("start", "n", "ref_row", "ref_start")).alias("found"))

    def parse(batch: pa.RecordBatch) -> dict:
        unpack, out = zstandard.ZstdDecompressor().decompress, {"spans": [], "n_removed": [], "kept": []}
        for data, found in zip(batch.column("packed"), batch.column("found").to_pylist()):
            words, spans = unpack(data.as_py()).split(), factors([tuple(f.values()) for f in found], window)
            kept = keep(words, spans)
            out["spans"].append([dict(zip(("start", "end", "ref_row", "ref_start"), s)) for s in spans])
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(digest(kept))
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_row", pa.int64()), ("ref_start", pa.int32())]))
        return {name: batch.column(name) for name in (*common.ROW_KEY, "row_id")} | {"spans": pa.array(out["spans"], kinds), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())}

    spans_type = "array<struct<start:int,end:int,ref_row:bigint,ref_start:int>>"
    joined = suspects.select("row_id", *common.ROW_KEY, "packed").join(by_row, "row_id", "left").withColumn("found", F.coalesce("found", F.array()))
    parsed = common.map_batches(joined.select("row_id", *common.ROW_KEY, "packed", "found"), parse, f"_h1 long, _h2 long, row_id long, spans {spans_type}, n_removed long, kept string")
    out = base.join(parsed.dropDuplicates(common.ROW_KEY), common.ROW_KEY, "left")  # equal rows lose the same words
    return out.select("doc_id", "row_id", "n_words", F.coalesce("spans", F.array().cast(spans_type)).alias("spans"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
