"""Quality rules: text measures of each document, and the frequency of its lines over the documents of its host.

A line's hash covers its lower-cased words joined by one space. A line that more than `max_docs` documents of one host
hold, and more than `max_share` of the host's documents, is removed (judge() names it by its position, clean() gives the
text without it); a document that keeps less than `min_share` of its words is depleted and rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    windows = common.window_hashes(common.word_hashes(words), 3)
    if not len(windows):
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    starts = np.flatnonzero(counts[back] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def measure(text: str) -> tuple[dict, dict[int, tuple[int, list[int]]]]:
    """The measures of MEASURES, and by hash of each distinct line that has a word its words and the positions where it stands."""
    data = text.encode()
    lines = data.split(b"\n")
    split = [line.split() for line in lines]
    seen, dups, hashes = set(), 0, {}
    for at, (line, words) in enumerate(zip(lines, split)):
        if words:
            dups += line in seen
            seen.add(line)
            key = xxhash.xxh3_64_intdigest(b" ".join(words).translate(common.LOWER)) - (1 << 63)
            hashes.setdefault(key, (len(words), []))[1].append(at)
    words = [w for line in split for w in line]
    chars = len(text) - (len(data) - len(data.translate(None, common.SPACE)))
    return {"n_words": len(words), "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": dups, "n_repeat_words": repeated_words(words)}, hashes


def judged_rows(docs: DataFrame, host: str, max_docs: int, min_share: float, max_share: float) -> DataFrame:
    """judge(), with ROW_KEY over doc_id, host and text beside it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("line", pa.int64()), ("words", pa.int32()), ("at", pa.list_(pa.int32()))])

    def rows(batch: pa.RecordBatch) -> dict:
        measured = [measure(t) for t in common.texts(batch)]
        out = {name: batch.column(name) for name in (*common.ROW_KEY, "doc_id", "host")}
        out |= {name: pa.array([m[name] for m, _ in measured], pa.int64()) for name in measured[0][0]}
        return out | {"lines": pa.array([[{"line": k, "words": n, "at": at} for k, (n, at) in h.items()] for _, h in measured], pa.list_(entry))}

    read = common.keyed_rows(docs, "doc_id", host, "text").select(*common.ROW_KEY, "row.doc_id", F.coalesce(F.col(f"row.`{host}`").cast("string"), F.lit("\x00null")).alias("host"), "row.text")
    schema = f"_h1 long, _h2 long, doc_id {kind}, host string, {MEASURES}, lines array<struct<line:bigint,words:int,at:array<int>>>"
    measured = common.durable(common.map_batches(read, rows, schema).withColumn("row_id", F.monotonically_increasing_id()))
    lines = measured.select("row_id", "host", F.inline("lines"))
    often = lines.groupBy("host", "line").count().where(F.col("count") > max_docs)
    hosts = measured.groupBy("host").agg(F.count("*").alias("of_host"))
    above = common.durable(often.join(hosts, "host").where(F.col("count") > max_share * F.col("of_host")).select("host", "line"))
    here = F.transform("at", lambda at: F.struct(at.alias("at"), F.col("words").alias("words")))
    dropped = lines.join(above, ["host", "line"]).groupBy("row_id").agg(F.array_sort(F.flatten(F.collect_list(here))).alias("dropped"))
    out = measured.drop("lines", "host").join(dropped, "row_id", "left").withColumn("n_removed_words", F.coalesce(F.aggregate("dropped", F.lit(0).cast("long"), lambda n, line: n + line.words), F.lit(0)))
    out = out.withColumn("dropped_lines", F.coalesce(F.col("dropped.at"), F.array().cast("array<int>")))
    return out.withColumn("depleted", F.col("n_words") - F.col("n_removed_words") < min_share * F.col("n_words")).drop("row_id", "dropped")


def judge(docs: DataFrame, host: str = "source", max_docs: int = 100, min_share: float = 0.5, max_share: float = 0.001) -> DataFrame:
    """doc_id, the measures, n_removed_words, dropped_lines (positions from 0, in order) and depleted, for each row.

    A null text has no words and is not depleted; null hosts count as one host; repeated rows count as documents of their
    own; ties do not arise, as every line of a frequency above both limits goes; of a very long text each distinct line is one
    entry; an empty table gives no rows; columns other than doc_id, text and the host are not read.
    """
    return judged_rows(docs, host, max_docs, min_share, max_share).drop(*common.ROW_KEY)


def without(text: str | None, dropped: list[int]) -> str | None:
    """`text` without the lines at these positions."""
    if not text or not dropped:
        return text
    gone = set(dropped)
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)


def clean(docs: DataFrame, host: str = "source", max_docs: int = 100, min_share: float = 0.5, max_share: float = 0.001) -> DataFrame:
    """`docs` without its depleted rows, texts without the lines above the limit; columns otherwise as they were, equal rows each kept."""
    verdicts = judged_rows(docs, host, max_docs, min_share, max_share).select(*common.ROW_KEY, "dropped_lines", "depleted")
    touched = common.durable(verdicts.where(F.col("depleted") | (F.size("dropped_lines") > 0)).dropDuplicates(common.ROW_KEY))
    rows = common.keyed_rows(docs, "doc_id", host, "text").join(touched, common.ROW_KEY, "left").where(~F.coalesce("depleted", F.lit(False)))
    cut = F.udf(without, "string", useArrow=True)
    return rows.select("row", cut("row.text", "dropped_lines").alias("cut")).select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.documents(spark, sf_dir))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return judged.select("doc_id", *names, failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "n_removed_words")


ORACLE_SQL = {
    "op7_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY 1
), held AS (
  SELECT doc_id, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, host, unnest(lines) AS line FROM d)
), above AS (
  SELECT host, k FROM held JOIN (SELECT host, count(*) AS docs FROM d GROUP BY 1) USING (host) GROUP BY host, k, docs HAVING count(DISTINCT doc_id) > greatest(100, 0.001 * docs)
), removed AS (SELECT doc_id, sum(n) AS n FROM held JOIN above USING (host, k) GROUP BY 1
), m AS (
  SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS bigint) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS bigint) AS n_removed_words
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id LEFT JOIN removed x ON x.doc_id = d.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM f
"""
}
QUERIES = {"op7_quality_rules": op7_quality_rules}
