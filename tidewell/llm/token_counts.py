"""Token counts without moving a pre-token: a broadcast table of frequent pre-token lengths, then worker caches.

Tier one is a compact table of at most `table_size` frequent pre-tokens and their lengths in tokens; it is fitted on at
most `sample_rows` rows, is bounded by its parameters whatever the corpus holds, and changes speed only, never a count.
Tier two encodes a pre-token that is not in the table with the tokenizer once and keeps its length in the worker.

Why a text may be cut: no piece of the vocabulary holds a space mark after another character, nor a line feed, so no
merge crosses the place before a run of spaces or either side of a line feed. `boundaries_hold` checks that when the
model is loaded; for another model that fails it, whole texts are encoded.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

PARTS = re.compile(r"\n| *[^ \n]+| +")
SPACE_MARK = "▁"


def boundaries_hold(model) -> bool:
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = model.encode("a  b", out_type=str) == [SPACE_MARK + "a", SPACE_MARK, SPACE_MARK + "b"]  # spaces are kept
    return plain and not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)


class Lengths(dict):
    """Pre-token -> tokens. A key is a pre-token after one space, without it; "\\n" + word is a word that opens a line."""

    def __init__(self, path: str, frequent: list[tuple[str, int]], limit: int):
        import sentencepiece

        self.model, self.frequent, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), frequent, limit
        self.exact = boundaries_hold(self.model)
        self.refill()

    def refill(self) -> None:
        self.clear()
        self.update(self.frequent)
        self[""] = 1

    def __missing__(self, key: str) -> int:
        if len(self) >= self.limit + len(self.frequent):
            self.refill()
        value = self[key] = len(self.model.encode(key, num_threads=1)) - (key[0] == "\n")
        return value

    def keys_of(self, text: str) -> list[str]:
        text = text.replace(SPACE_MARK, " ")  # the model reads both alike
        if "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        keys, opens = [], False
        for part in PARTS.findall(" " + text):
            keys.append(part if part == "\n" else part[1:] if part[0] == " " else "\n" + part)
            if opens and keys[-1] != part and keys[-1][:1] == "\n":  # the line feed before it is counted with it
                keys.pop(-2)
            opens = part == "\n"
        return keys

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.keys_of(text))) if self.exact else len(self.model.encode(text, num_threads=1))


_lengths: dict[tuple, Lengths] = {}


def lengths(path: str, count: str, frequent, limit: int) -> Lengths:
    """The worker's own table, kept from task to task of one count (a name of its own); `frequent` is its broadcast."""
    key = (path, count, limit)
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(path, frequent.value, limit)
    return _lengths[key]


def frequent_lengths(docs: DataFrame, path: str, table_size: int, sample_rows: int) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of at most `sample_rows` rows of the first partition that repeats a pre-token there; none where none does.

    A partition without one gives no row, so `take` goes on to the next; the one row that comes back is bounded by `table_size`.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, table = 0, Counter(), Lengths(path, [], 0)
        for batch in batches:
            for text in common.texts(batch)[: sample_rows - seen]:
                if text and table.exact:
                    counts.update(table.keys_of(text))
                if len(counts) > 8 * table_size:  # lossy counting keeps the sketch bounded
                    counts = Counter(dict(counts.most_common(4 * table_size)))
            seen += batch.num_rows
            if seen >= sample_rows:
                break
        top = [k for k, n in counts.most_common(table_size) if n > 1 and len(k) <= 64]
        if top:
            yield pa.RecordBatch.from_pydict({"keys": pa.array([top], pa.list_(pa.string())), "lengths": pa.array([[table[k] for k in top]], pa.list_(pa.int32()))})

    found = docs.select("text").mapInArrow(sketch, "keys array<string>, lengths array<int>").take(1)
    return list(zip(found[0]["keys"], found[0]["lengths"])) if found else []


def count_tokens(docs: DataFrame, model_path: str, table_size: int = 30_000, sample_rows: int = 2_000, cache_limit: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row, as the sentencepiece library counts the whole text; no shuffle.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are counted row by row; further columns of
    `docs`, whatever their names, are not read. An empty table gives no rows. Very long texts are cut at pre-tokens, so
    memory follows one text.
    """
    table, name = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path, table_size, sample_rows)), uuid.uuid4().hex

    def rows(batch: pa.RecordBatch) -> dict:
        count, column = lengths(model_path, name, table, cache_limit).count, common.texts(batch)
        return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in column], pa.int64()), "n_tokens": pa.array(map(count, column), pa.int64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_batches(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > limit)


QUERIES = {"op1_token_counts": op1_token_counts}
