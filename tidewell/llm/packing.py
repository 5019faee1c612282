"""Cost-balanced packing of token ids into training sequences, within a task and without a shuffle.

A task streams its rows. What exceeds a sequence is cut off in full sequences at once. The rests wait until they fill
`block_sequences` sequences and are then dealt over full sequences, in descending order, each to the sequence with the
lowest cost a * length + b * length ** 2 that still has room for it; a rest that fits nowhere whole is cut over the
roomiest sequences. What finds no room, less than a sequence in all, waits for the next block. At the end of the task the
last tokens go to one sequence for each set bit of their number, so nothing is padded (a length that is a power of two
needs no padding). Memory is bounded by the block and its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: The tokenizer's pre-tokens, over lower-cased texts of ASCII and of Latin letters that no normal form changes (without U+0130, whose lower case ends in a mark).
LETTERS = "\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^ \\t\\n\\x0b\\x0c\\ra-z0-9{LETTERS}]+")
OTHER = re.compile(f"[^\\x00-\\x7f{LETTERS}]")

#: The byte-level alphabet of the merges: visible Latin-1 stands for its own byte, the other bytes follow from U+0100 on in their order.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
ALPHABET = {b: 256 + n for n, b in enumerate(HIDDEN)}


class Recent(dict):
    """A bounded memory: what was used in the last two rounds of `limit` new keys stays, keys of over 64 characters aside. `make` gives the value of a new key."""

    def __init__(self, limit: int, make):
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > 64:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def is_plain(text: str) -> bool:
    """Whether PIECE cuts the text in lower case as the tokenizer cuts the text; `<|` may open a special token."""
    return "<|" not in text and (text.isascii() or not OTHER.search(text))


#: Texts on which the cuts are compared with the tokenizer's own when it is loaded: letters, digits, marks, contractions, white space, other scripts, special tokens.
PROBES = [
    "", " ", "a", "The cat's out; I'd say we'll've left, they're 'n'", "  Two  spaces\tand a tab\n\nlines \r\n", "x1y22z 2024-01-02 3.14 1,000", "A--b...c!? (d) [e] {f}", "naïve Émile ÑANDÚ œuvre ſ ĳ",
    "日本語 テスト текст", "emoji 😀 👩‍👩‍👧", "<|endoftext|> a<|x", "don'T I'M it'S", "foo_bar __init__ a-b/c\\d", "\u00a0nbsp\u2003em \u200bzero", "e\u0301 combining İ", "word " * 40, "ab" * 60,
]


class TextIds:
    """Text -> its ids as little-endian 32-bit bytes, from the chunks between its spaces, and those from their pre-tokens; recent ones are remembered.

    Whether the tokenizer cuts texts as PIECE does is checked on PROBES; for one that doesn't, whole texts are encoded.

    No id crosses an edge between pre-tokens, and white space is dropped before the split, so nothing crosses a space. A chunk
    that isn't plain is encoded whole. A pre-token goes to the merges in the byte-level alphabet.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = self.model.model
        self.pieces, self.chunks, self.odd = Recent(limit, self.of_piece), Recent(limit, self.of_chunk), Recent(limit // 8, self.encode)
        self.cuts = True
        self.cuts = all(self(text) == self.encode(text) for text in PROBES)

    def encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_piece(self, piece: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(piece.encode().decode("latin-1").translate(ALPHABET))])

    def of_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(chunk)))

    def __call__(self, text: str) -> bytes:
        if not self.cuts:
            return self.encode(text)
        if is_plain(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))
        return b"".join(self.chunks[c.lower()] if is_plain(c) else self.odd[c] for c in text.replace("\n", " ").split(" "))


_ids: dict[tuple, TextIds] = {}


def document_ids(text: str, path: str, end_id: int, limit: int = 250_000) -> bytes:
    if (path, limit) not in _ids:
        common.keep_only("packing", _ids)
        _ids[path, limit] = TextIds(path, limit)
    return _ids[path, limit](text) + np.array([end_id], "<u4").tobytes()


def deal(rests: list[int], sizes: list[int], linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (rest, start in it, length, sequence, offset) over sequences of these sizes, and what found no room (rest, start, length).

    Equal rests go in their order, equal costs to the first sequence.
    """
    size, room, cost, pieces, over = np.array(sizes), np.array(sizes), np.zeros(len(sizes)), [], []
    for rest in sorted(range(len(rests)), key=lambda i: (-rests[i], i)):
        start, left = 0, rests[rest]
        while left:
            fits = room >= left
            seq = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room)) if len(sizes) else -1
            length = min(left, int(room[seq])) if seq >= 0 else 0
            if not length:
                over.append((rest, start, left))
                break
            pieces.append((rest, start, length, seq, int(size[seq] - room[seq])))
            room[seq] -= length
            cost[seq] += linear * length + quadratic * length * length
            start, left = start + length, left - length
    return pieces, over


def last_sizes(total: int, seq_len: int) -> list[int]:
    """Full sequences, then one for each set bit of what is left."""
    return [seq_len] * (total // seq_len) + [1 << b for b in range(seq_len.bit_length(), -1, -1) if total % seq_len >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, block_sequences: int = 256, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Repeated rows and null ids are packed row by row; ties go by the order of
    rows; very long texts are cut into full sequences as they come; an empty table gives no rows; further columns are not
    read. A task's sequences carry its partition number in the upper 31 bits of sequence_id, so a repeated task makes the
    same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, used, waiting, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0, []  # waiting: (doc_id, ids, start, length)

        def settle(sizes: list[int]) -> None:
            nonlocal used, waiting, held
            pieces, over = deal([w[3] for w in waiting], sizes, linear, quadratic)
            rows.extend((*waiting[r][:2], waiting[r][2] + start, n, used + seq, offset) for r, start, n, seq, offset in pieces)
            used += len(sizes)
            waiting = [(*waiting[r][:2], waiting[r][2] + start, n) for r, start, n in sorted(over)]
            held = sum(w[3] for w in waiting)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], kind), "start": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64()),
                "ids": pa.array([ids[4 * s : 4 * (s + n)] for _, ids, s, n, *_ in rows], pa.binary()), "doc_tokens": pa.array([len(r[1]) // 4 for r in rows], pa.int64()),
                "sequence_id": pa.array([first + r[4] for r in rows], pa.int64()), "offset": pa.array([r[5] for r in rows], pa.int64()),
            })
            rows.clear()
            return batch

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                ids = document_ids(text, tokenizer_path, end_id)
                n = len(ids) // 4
                for start in range(0, n - n % seq_len, seq_len):
                    rows.append((doc_id, ids, start, seq_len, used, 0))
                    used += 1
                if n % seq_len:
                    waiting.append((doc_id, ids, n - n % seq_len, n % seq_len))
                    held += n % seq_len
                if held >= block_sequences * seq_len:
                    settle([seq_len] * (held // seq_len))
                    yield made()
            if rows:
                yield made()
        if waiting:
            settle(last_sizes(held, seq_len))
            yield made()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
