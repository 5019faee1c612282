"""The pipeline's stages on planted cases."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewell import llm
from tidewell.llm import common

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(llm.oracle_sql()) <= set(llm.queries()) and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "wh", "er", "th"], "de": ["sch", "ung", "ein", "ich", "pf"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = make("en", 30)
    rows = [(i, "\n".join(make("en" if i % 2 else "de", 30) for _ in range(3)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, rows[0][1] + " tail", "de"), (101, make("en", 80) + " " + item + " " + make("en", 80), "en"), (102, None, "en"), (103, "12 34 !!", None)]
    rows += [(110 + i, make("en", 40) + "\nthis footer stands on every page of it\n" + make("en", 40), "en") for i in range(4)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, tables):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(60)) | {110, 111, 112, 113}
    assert set(seen["language_id"]) == clean | {100, 101}
    footers = [i for i in range(110, 114) if "footer" in seen["line_dedup"][i].text]
    assert footers == [113] and all(len(r.text) == r.n_chars for r in seen["line_dedup"].values())
    assert set(seen["near_dedup"]) == clean | {101} and set(seen["decontamination"]) == clean


def test_the_whole_run(spark, tables):
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert {p.doc_id for p in pieces} == set(range(60)) | {110, 111, 112, 113} and sum(p.length for p in pieces if p.doc_id == 1) == next(p.doc_tokens for p in pieces if p.doc_id == 1)


def shingles(text, keep):
    w = [x for x in keep(text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows):
    """Without the lines of 20 characters or more in three documents or more, but for those of the largest id."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    most = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= 3}
    return [(i, text if text is None else "\n".join(x for x in text.split("\n") if most.get(key(x), i) == i)) for i, text in rows]


def plain_copies(rows):
    """The rows with the smallest id of each component of similarities of 0.8 or more."""
    sets = [shingles(lower(t or ""), lambda x: re.split("[ \t\n\x0b\x0c\r]+", x)) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min(low.get(r, (True, 0)), (i is None, i or 0))
    return [row for r, row in zip(root, rows) if (row[0] is None, row[0] or 0) == low[r] or not sets[r]]


def plain_clean(rows, items):
    words = lambda x: re.split(r"[\W_]+", x.lower())
    own = [shingles(t, words) for t in items]
    return [(i, t) for i, t in rows if not any(u and 10 * len(u & shingles(t, words)) >= 8 * len(u) for u in own)]


def test_stages_equal_brute_force_on_the_edge_table(spark, edge_docs, tables):
    """Nulls, empty and very long texts, repeated rows, null ids and clashing columns through all stages, each against plain Python on its own input."""
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    docs = edge_docs.unionByName(spark.createDataFrame([(500, f"Some words in front. {items[0]} And behind."), (501, items[0])], "doc_id long, text string").select(*[c if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in edge_docs.dtypes]))
    plain = {"line_dedup": plain_lines, "near_dedup": plain_copies, "decontamination": lambda rows: plain_clean(rows, items)}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = found(docs) if name in plain else None
        docs = common.durable(stage(spark, docs, tables))
        assert docs.columns == edge_docs.columns
        if name in plain:
            assert found(docs) == sorted(plain[name](before), key=repr), name
        sizes.append(docs.count())
    assert sizes[0] > 60 and sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[-2] < sizes[-3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in found(docs))
    assert sum(want) == sum(p.length for p in pieces) and {p.doc_tokens for p in pieces} == set(want)
    of = {}
    for p in pieces:
        of.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in of.values():  # gapless, full or of a power of two
        ends = [0, *[o + n for o, n in sorted(spans)]]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_an_empty_table_goes_through_all_stages(spark, edge_docs, tables):
    docs = edge_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)])
def test_every_query_runs_on_the_smallest_tables(spark, name):
    name = next(x for x in llm.queries() if x.startswith(name))
    n, table = llm.queries()[name](spark, SF).count(), lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    if name.startswith("op11"):
        assert n == table("conversations").select("conv_id").distinct().count()
    elif name.startswith("op12"):
        assert n == 10 * table("benchmark").count()
    elif name.startswith("op13"):
        assert n == 20 * table("embeddings").where("vec_id % 20 = 0").count()
    else:
        assert n >= (1 if name.startswith("op6") else table("documents").count())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.execute(llm.oracle_sql()[name])
    columns = sorted(c[0] for c in theirs.description)
    rows = [dict(zip([c[0] for c in theirs.description], r)) for r in theirs.fetchall()]
    ours = llm.queries()[name](spark, SF).collect()
    assert sorted(repr([r[c] for c in columns]) for r in ours) == sorted(repr([r[c] for c in columns]) for r in rows)
