"""Benchmark decontamination, with DataFrame operations alone: short test items inside long documents.

An item is contained in a document if at least `threshold` of its distinct word shingles stand there. Similarity of whole sets
says nothing about that when the document is long, so items are partitioned by size, class c from 2**c shingles up, and each
class is searched in its own way:

* Items with equal shingles are one set. The documents' shingles that some set has are hits: a row for each document and hash, never
  a pair of document and item. Their counts say how many documents hold a shingle.
* A set is signed with its smallest shingles in a MinHash order that puts those of few documents first (count, then hash), as many
  as its class needs that a document which contains the item must hold one of them: of n shingles at most n - ceil(threshold * n)
  may be missing, one more is signed. So no item is missed, and a phrase of many items and documents signs none that has
  rarer ones.
* Hits meet signatures by hash, for documents that are large enough for the set's need. What meets is compared with the item's
  exact shingles.

Words are runs of letters and digits in lower case, so marks and white space do not hide a copy. A text of fewer words than
a shingle has one shingle, all of its words: such an item is contained only in a text that has just these words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, size: int, make) -> Column:
    """make(words of a shingle) for each shingle of the text, in order. The one-element array binds the words, so a text is split once."""

    def of(word: Column) -> Column:
        n = F.size(word)
        several = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: make(*[F.element_at(word, i + k) for k in range(size)]))
        return F.when(n >= size, several).when(n > 0, F.array(make(F.array_join(word, " ")))).otherwise(F.array().cast(several_type))

    several_type = "array<bigint>" if make is F.xxhash64 else "array<string>"
    return F.element_at(F.transform(F.array(words(text)), of), 1)


def hashes(text: Column, size: int) -> Column:
    return shingles(text, size, F.xxhash64)


def strings(text: Column, size: int) -> Column:
    return F.array_distinct(shingles(text, size, lambda *w: F.concat_ws(" ", *w)))


def item_sets(items: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(set, item_id) of each item with a word, and of each distinct set its exact shingles, sorted hashes, need (how many must be found), size_class and how many sign it."""
    both = items.where("text is not null").select("item_id", strings(F.col("text"), size).alias("exact"), F.array_sort(F.array_distinct(hashes(F.col("text"), size))).alias("sorted"))
    each = common.durable(both.withColumns({"item": F.monotonically_increasing_id(), "of": F.struct(F.xxhash64("sorted").alias("a"), F.xxhash64(F.lit("2"), "sorted").alias("b"))})).where(F.size("exact") > 0)
    sets = each.groupBy("of").agg(F.min(F.struct("item", "exact", "sorted")).alias("first")).select("of", F.col("first.item").alias("set"), "first.exact", "first.sorted")
    sets = sets.withColumns({"n": F.size("exact"), "need": F.ceil(F.size("exact") * F.lit(threshold) - F.lit(1e-9)).cast("int"), "size_class": F.floor(F.log2(F.size("exact"))).cast("int")})
    most = F.pow(F.lit(2), F.col("size_class") + 1) - 1  # of the class
    signs = F.least(F.col("n"), F.greatest(F.col("n") - F.col("need"), F.floor((1 - threshold) * most).cast("int")) + 1)
    sets = common.durable(sets.withColumn("signs", signs))
    return each.join(sets.select("of", "set"), "of").select("set", "item_id"), sets.drop("of")


def candidates(keyed: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(ROW_KEY, set) of the documents that hold a shingle which signs the set.

    The sets' shingles are a table with a known size, so both joins are broadcasts where it is small and shuffles by hash where not.
    """
    of = common.durable(sets.select("set", "need", "size_class", "signs", F.explode("sorted").alias("hash")))
    least = sets.agg(F.coalesce(F.min("need"), F.lit(0))).first()[0]
    held = keyed.select(*common.ROW_KEY, F.array_distinct(hashes(F.col("text"), size)).alias("held")).where(F.size("held") >= least)
    each = held.select(*common.ROW_KEY, F.size("held").alias("n_has"), F.explode("held").alias("hash"))
    hits = common.durable(each.join(of.select("hash").distinct(), "hash", "left_semi"))
    counts = common.durable(hits.groupBy("hash").agg(F.count("*").alias("docs")))
    marks = signed(of, counts)
    return hits.join(marks, "hash").where("n_has >= need").select(*common.ROW_KEY, "set").distinct()


def signed(of: DataFrame, counts: DataFrame) -> DataFrame:
    """(set, need, hash) of the shingles that sign a set and stand in some document."""
    order = Window.partitionBy("set").orderBy("docs", "hash")
    ranked = of.join(counts, "hash", "left").withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("place", F.row_number().over(order))
    return common.durable(ranked.where("place <= signs and docs > 0").select("set", "need", "hash"))


def contained(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_found, n_item for each row of `docs` and each item that it contains.

    Null texts, texts without a word and items without one are contained in nothing. Rows with repeated ids are compared row
    by row and give a row each, repeated items likewise; null ids are kept on both sides. A share of exactly `threshold` is
    contained. Very long texts are compared whole. Empty tables give no rows; other columns are not read.
    """
    members, sets = item_sets(items, size, threshold)
    keyed = common.with_row_key(docs.select("doc_id", "text").where(F.length("text") > 0), "doc_id", "text")
    pairs = common.durable(candidates(keyed, sets, size))
    rows = common.durable(pairs.select(*common.ROW_KEY).distinct())
    near = common.durable(keyed.join(rows, common.ROW_KEY, "left_semi").select(*common.ROW_KEY, "doc_id", strings(F.col("text"), size).alias("has")))
    both = near.join(pairs, common.ROW_KEY).join(sets.select("set", "exact", "need"), "set")
    checked = both.withColumns({"n_found": F.size(F.array_intersect("exact", "has")), "n_item": F.size("exact")}).where("n_found >= need")
    return checked.join(members, "set").select("doc_id", "item_id", "n_found", "n_item")


def clean(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` without the documents that contain an item; its columns as they were.

    Rows are judged by their text alone: null ids and repeated ids do no harm, equal texts stay or go together, null texts stay.
    Without items, all rows stay; an empty table gives no rows.
    """
    keyed = common.keyed_rows(docs, "text")
    gone = contained(keyed.select(F.struct(*common.ROW_KEY).alias("doc_id"), "row.text"), items, size, threshold).select("doc_id._h1", "doc_id._h2").distinct()
    return keyed.join(common.durable(gone), common.ROW_KEY, "left_anti").select("row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("n_found").cast("long").alias("n_found"), F.col("n_item").cast("long").alias("n_item"))


ORACLE_SQL = {
    "op6_decontamination": r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found, any_value(n.n_item) AS n_item
FROM s d JOIN s b ON d.g = b.g AND d.side = 'd' AND b.side = 'b' JOIN n ON n.id = b.id
GROUP BY 1, 2 HAVING count(*) >= ceil(0.8 * any_value(n.n_item) - 1e-9)
"""
}
QUERIES = {"op6_decontamination": op6_decontamination}
