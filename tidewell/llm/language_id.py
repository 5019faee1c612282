"""Language by compression: the language whose dictionary shortens a text most.

Each language's zstandard raw-content dictionary is text of that language. Every text, long or short, is measured alike: in
pieces of `PIECE` bytes at most, each behind a preface in the language (so that a short text isn't lost in a frame's
overhead), by the bytes that it adds to the preface's own; sums over the pieces are compared. Each byte by which another
language's result is longer halves the odds of that language, which gives the score; narrow margins give a low score and
are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LETTER = re.compile(r"[^\W\d_]")
#: Bytes of a language before each piece, and of its dictionary.
PREFACE, DICTIONARY = 2048, 30_720
#: Bytes of a text that meet a fresh dictionary at a time: with the dictionary well inside the window, and its hash slots stay in use.
PIECE = 8192
#: For bytes.translate: ASCII letters in lower case, bytes of other letters kept, the rest to spaces.
KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(KEEP).split())


def pieces(data: bytes) -> list[bytes]:
    """`data` in consecutive pieces of about one length, PIECE at most."""
    step = max(1, -(-len(data) // max(1, -(-len(data) // PIECE))))
    return [data[i : i + step] for i in range(0, len(data), step)]


def fit(labelled: DataFrame, sample_rows: int = 300, row_bytes: int = 1024, dictionary_bytes: int = PREFACE + DICTIONARY, max_languages: int = 256) -> dict[str, bytes]:
    """Dictionaries by language from (text, lang), null labels left out.

    The bound: `max_languages` labels, those with the most distinct texts (then by name); at most `sample_rows` distinct texts a
    language, those of the smallest hashes, of each the first `row_bytes` characters, and `dictionary_bytes` in all; no more is
    collected, however many copies a text has. Dictionaries of at least half the longest are cut to one length, so none of
    these is favoured; a shorter one stays as it is and cuts no other. An empty table gives no languages.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", F.substring("text", 1, row_bytes).alias("head"), F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("_h2"), "text").alias("_h2"))
    sizes = known.select("lang", *common.ROW_KEY).distinct().groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages)
    counts = {r.lang: r["count"] for r in sizes.collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample_rows / n)))])
    draw = F.shiftrightunsigned("_h1", 11) / F.lit(float(1 << 53))
    drawn = first_copies(known.where(F.col("lang").isin(list(counts)) & (draw < share[F.col("lang")]))).dropDuplicates(["lang", *common.ROW_KEY])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("_h1", 11), *common.ROW_KEY))
    taken: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for row in drawn.withColumn("place", place).where(F.col("place") <= sample_rows).select("lang", "place", "head").orderBy("lang", "place").collect():
        taken[row.lang].append(row["head"])
    return match_lengths({lang: "\n".join(parts).encode()[:dictionary_bytes] for lang, parts in taken.items() if parts})


def first_copies(rows: DataFrame) -> DataFrame:
    """Of each partition's copies of a text of a language the first, so that a hot text is not shuffled; holds the keys of the texts drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(*[batch.column(name).to_pylist() for name in ("lang", *common.ROW_KEY)]))
            new = [key not in seen and not seen.add(key) for key in keys]
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, common.schema_of(rows))


def match_lengths(texts: dict[str, bytes]) -> dict[str, bytes]:
    longest = max(map(len, texts.values()), default=0)
    size = min((len(t) for t in texts.values() if 2 * len(t) >= longest), default=0)
    return {lang: data[:size] for lang, data in texts.items()}


class Classifier:
    """Whole text -> (language, score); `und` with score 0 for a text without a letter, or without learned languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages, self.measures = sorted(dictionaries), []
        how = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=15, chain_log=15, target_length=64, strategy=zstandard.STRATEGY_GREEDY, min_match=3, search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        for name in self.languages:
            plain = letters(dictionaries[name].decode(errors="ignore"))
            compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain[PREFACE : PREFACE + DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            preface = plain[:PREFACE] + b" "
            self.measures.append((compressor, preface, len(compressor.compress(preface))))

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text adds, by language."""
        parts = pieces(letters(text))
        return [sum(len(c.compress(preface + piece)) - own for piece in parts) for c, preface, own in self.measures]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        return self.languages[best], 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)


_classifiers: dict[int, Classifier] = {}


def classifier(key: int, dictionaries: dict[str, bytes]) -> Classifier:
    if key not in _classifiers:
        _classifiers.clear()
        _classifiers[key] = Classifier(dictionaries)
    return _classifiers[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """All columns of `docs` with lang_pred and score for each row (input columns of these names are replaced); no shuffle.

    Null texts and texts without a letter are `und` with score 0. Ties go to the language first in order, with a low
    score. Repeated rows are judged row by row, very long texts piece by piece and as a whole; an empty table gives no rows.
    The dictionaries are broadcast: fit() bounds their number and length.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    key = model._jbroadcast.id() if model._jbroadcast is not None else id(model)
    docs = docs.drop("lang_pred", "score")

    def rows(batch: pa.RecordBatch) -> dict:
        found = [classifier(key, model.value)(t) for t in batch.column("text").to_pylist()]
        kept = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        return kept | {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}

    return common.map_batches(docs, rows, common.schema_of(docs) + ", lang_pred string, score double")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_score: float = 0.6) -> DataFrame:
    """The rows of `docs`, as they are, whose language is told with a margin: those without a letter and those between languages go.

    Null texts go; equal rows stay or go together; very long texts are judged whole; an empty table gives no rows; all columns stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    key = model._jbroadcast.id() if model._jbroadcast is not None else id(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([classifier(key, model.value)(t)[1] >= min_score for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, common.schema_of(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out).select("text", "lang")))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
