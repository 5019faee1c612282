"""Operators that compare documents, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import common, decontamination, line_dedup, near_dedup, sharding, substring_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return (text or "").encode().split()


def sets_of(rows, size):
    out = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        out.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def components(rows, size, num, den):
    sets, parent = sets_of(rows, size), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), lowest.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize("size,threshold,num,den", [(3, "0.85", 85, 100), (5, "0.8", 8, 10)])
def test_components_equal_brute_force(spark, edge_docs, edge_rows, size, threshold, num, den):
    got = near_dedup.components(edge_docs, size, threshold).collect()
    order = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(components(edge_rows, size, num, den), key=order)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_a_group_of_many_chunks(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            w[at] = f"x{rng.integers(1 << 40)}"
        rows.append((1000 - i, " ".join(w)))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.85").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows, 3, 85, 100))


def test_large_clusters_are_labelled_like_small_ones(spark, edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "MANY", 2)
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    got = near_dedup.components(edge_docs, 3, "0.85").collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, components(edge_rows, 3, 85, 100)))


def test_near_copies_of_nothing(spark, edge_docs):
    assert near_dedup.components(edge_docs.limit(0)).count() == 0
    assert near_dedup.components(edge_docs.where("text is null or trim(text) = ''")).where("not kept").count() == 0
    kept = near_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("doc_id between 10 and 15").count() == 1


def test_odd_sketches_never_lose_a_link():
    rng = np.random.default_rng(9)
    worst = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 185, dtype=np.uint64)
        b = np.concatenate([a[:170], rng.integers(0, 1 << 63, 15, dtype=np.uint64)])  # similarity 0.85
        x, y = (np.frombuffer(near_dedup.odd_sketch(near_dedup.minhash(np.unique(s))), np.uint8) for s in (a, b))
        worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= near_dedup.most_flips(0.85) < near_dedup.BITS / 2


def test_removed_words_equal_brute_force(spark, edge_docs, edge_rows):
    for window in (35, 13):
        split = [(i, words(t)) for i, t in edge_rows]
        seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
        want = []
        for i, w in split:
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if seen[tuple(w[k : k + window])] > 1:
                    gone[k : k + window] = [True] * window
            want.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
        got = substring_dedup.duplicate_spans(edge_docs, window).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
        assert all(b.start > a.start and s.end - s.start >= window for r in got for a, b in zip(r.spans, r.spans[1:]) for s in (a, b))
    assert substring_dedup.duplicate_spans(edge_docs.limit(0)).count() == 0


def test_spread_anchors_lose_nothing(spark, edge_docs, edge_rows, monkeypatch):
    """With every anchor spread over blocks, and stretches of a few words, the result is the same."""
    want = sorted(map(repr, substring_dedup.duplicate_spans(edge_docs, 13).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    monkeypatch.setattr(substring_dedup, "STRETCH", 7)
    assert sorted(map(repr, substring_dedup.duplicate_spans(edge_docs, 13).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want


def test_factors_are_the_longest_matches_at_their_place(spark):
    """With all places the factors are those of a plain parse that tries each place; with few of them the same words are found."""
    rng, window = np.random.default_rng(21), 13
    pool = [" ".join(f"p{k}_{rng.integers(60)}" for _ in range(int(rng.integers(20, 70)))) for k in range(6)]
    make = lambda: " ".join(f"z{rng.integers(10**9)}" for _ in range(int(rng.integers(1, 30))))
    texts = [" ".join(x for k in rng.choice(6, int(rng.integers(1, 4))) for x in (make(), pool[k][int(rng.integers(0, 40)) :])) for _ in range(60)] + ["loop the " * 50]
    left, right = (" ".join(f"{side}{i}" for i in range(40)) for side in "ab")
    texts += [left, f"{left} {right}", f"{left} {right}"]  # the second half of a passage stands only where all of it does
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = substring_dedup.duplicate_spans(docs, window, 1000).collect()
    split = {r.row_id: words(texts[r.doc_id]) for r in got if r.row_id is not None}
    places = defaultdict(list)
    for row, w in sorted(split.items()):
        for k in range(len(w) - window + 1):
            places[tuple(w[k : k + window])].append((row, k))
    assert sum(len(r.spans) for r in got) > 60
    for r in (r for r in got if r.row_id is not None):
        w, plain, k = split[r.row_id], [], 0
        while k <= len(w) - window:
            best = None
            for row, at in places[tuple(w[k : k + window])]:
                if (row, at) != (r.row_id, k):
                    n = window
                    while k + n < len(w) and at + n < len(split[row]) and w[k + n] == split[row][at + n]:
                        n += 1
                    best = max(best or (0,), (n, -row, -at))
            if best is None:
                k += 1
                continue
            plain.append((k, k + best[0], -best[1], -best[2]))
            k += best[0] - window + 1
        assert [tuple(s) for s in r.spans] == plain
    halves = [r for r in got if r.doc_id in (len(texts) - 2, len(texts) - 1)]
    assert [[(s.start, s.end) for s in r.spans] for r in halves] == [[(0, 80)]] * 2
    digests = lambda rows: sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in rows)
    assert digests(substring_dedup.duplicate_spans(docs, window).collect()) == digests(got) == digests(substring_dedup.duplicate_spans(docs, window, 1).collect())


def line_rule(rows, least, docs):
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").decode().translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        held = lambda line: holders[key(line)] if len(key(line)) >= least else ()
        keep = [x for x in lines if not (len(held(x)) >= docs and max(held(x), key=lambda d: (d is not None, d or 0)) != i)]
        out.append((i, len(lines) - len(keep), "\n".join(keep)))
    return out


def test_lines_equal_brute_force(spark, edge_docs, edge_rows):
    for least, docs in ((20, 3), (4, 2)):
        cleaned = line_dedup.dedup(edge_docs, least, docs)
        assert cleaned.columns == edge_docs.columns
        want = [(i is None, i or 0, text) for i, _, text in line_rule(edge_rows, least, docs)]
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in cleaned.collect()) == sorted(want)
    assert line_dedup.dedup(edge_docs.limit(0)).count() == 0


def test_one_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        docs = spark.createDataFrame([(i, f"the line that is in all documents\nline of {i % 500} pairs only") for i in range(1000)], "doc_id long, text string")
        got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: text for i, _, text in line_rule([(r, f"the line that is in all documents\nline of {r % 500} pairs only") for r in range(1000)], 20, 3)}


def test_items_inside_long_documents(spark):
    rng = np.random.default_rng(8)
    make = lambda n: " ".join(f"v{rng.integers(3000)}" for _ in range(n))
    items = [(i, make(int(n))) for i, n in enumerate([3, 5, 12, 30, 80, 200])] + [(90, None), (91, " !! ")]
    docs = [(1, make(20_000) + ". " + items[3][1].upper() + "! " + make(50)), (2, items[0][1]), (3, None), (4, ""), (5, make(300)), (6, items[1][1] + " " + items[4][1])]
    half = items[5][1].split()
    docs += [(7, make(100) + " " + " ".join(half[:165]) + " " + make(10)), (8, " ".join(half[:120])), (None, items[2][1])]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def grams(text):
        import re

        w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = sorted((i is None, i or 0, j, len(grams(t) & grams(u)), len(grams(u))) for i, t in docs for j, u in items if grams(u) and 10 * len(grams(t) & grams(u)) >= 8 * len(grams(u)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (threshold, "-1"):  # signatures broadcast, and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.n_found, r.n_item) for r in decontamination.contained(docs_df, items_df).collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert got == want and len(got) >= 6
    twice = decontamination.contained(docs_df.union(docs_df.where("doc_id = 6")), items_df.union(spark.createDataFrame([(None, items[4][1])], items_df.schema))).where("doc_id = 6")
    assert sorted(map(repr, (r.item_id for r in twice.collect()))) == ["1", "1", "4", "4", "None", "None"]
    assert decontamination.clean(docs_df, items_df.limit(0)).count() == len(docs)
    sets = decontamination.item_sets(items_df, 5, 0.8)[1].collect()
    assert len({r.size_class for r in sets}) >= 4 and all(len(r.exact) - r.need < r.signs <= len(r.exact) and r.sorted == sorted(r.sorted) for r in sets)
    left = decontamination.clean(docs_df.selectExpr("*", "1 as row", "2 as hit"), items_df)
    assert left.columns == ["doc_id", "text", "row", "hit"] and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8]
    assert decontamination.contained(docs_df, items_df.limit(0)).count() == 0 and decontamination.contained(docs_df.limit(0), items_df).count() == 0


def test_a_phrase_that_all_items_and_many_documents_share(spark):
    """It signs no item that has rarer shingles, so documents with the phrase alone pair with nothing; what holds an item is found."""
    rng = random.Random(6)
    own = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    phrase = "the phrase that stands in every item of this benchmark table"
    items = [(i, f"{own(12)} {phrase} {own(12)}") for i in range(60)] + [(100, phrase)]
    docs = [(i, f"{own(30)} {phrase if i % 3 == 0 else ''} {own(30)}") for i in range(300)] + [(1000 + i, f"{own(9)} {items[i][1]} {own(9)}") for i in range(5)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    keyed = common.with_row_key(docs_df, "doc_id", "text")
    pairs = decontamination.candidates(keyed, decontamination.item_sets(items_df, 5, 0.8)[1], 5).count()
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contained(docs_df, items_df).collect())
    assert got == sorted([(i, 100) for i in range(0, 300, 3)] + [(1000 + i, j) for i in range(5) for j in (i, 100)]) and pairs == len(got)


def test_files_of_recomputed_rows(spark, tmp_path):
    """Rows whose order changes when they are computed again are written once each all the same."""
    import time as clock

    from pyspark.sql import functions as F

    shuffled = F.udf(lambda i: hash((i, clock.time_ns())) % 10**9, "long").asNondeterministic()
    docs = spark.range(3000).withColumn("text", F.expr("repeat('x', cast(id % 50 as int))")).withColumnRenamed("id", "doc_id").withColumn("o", shuffled("doc_id")).repartitionByRange(6, "o").sortWithinPartitions("o").drop("o")
    sharding.write(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == back.select("doc_id").distinct().count() == 3000 and back.select("shard").distinct().count() == 4


def test_the_query_names_its_law(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op10_sharding(spark, str(tmp_path)).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} <= set(range(16))


def test_shards(spark, edge_docs, edge_rows):
    got = sharding.assign(edge_docs, 4, 0.01).collect()
    assert len(got) == len(edge_rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in edge_rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(edge_docs.limit(0), 4).count() == 0


def test_shards_of_one_hot_text_are_even(spark):
    docs = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i} " * (i % 7)) for i in range(3000)], "doc_id long, text string")
    got = sharding.assign(docs, 16, 0.001).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    even = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(v - even) for v in sizes.values()) <= 100


def test_written_shards(spark, edge_docs, tmp_path):
    docs = edge_docs.withColumnRenamed("shard", "part")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect())) and {r.shard for r in back.collect()} <= {0, 1, 2, 3}
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "out").glob("shard=*"))
    with pytest.raises(ValueError):
        sharding.write(edge_docs, str(tmp_path / "clash"), 4)


def test_boundaries_equal_a_sorted_walk(spark):
    """Against all keys sorted in one list: every boundary is as near to its target as the rule allows, and shards follow from it."""
    rng = np.random.default_rng(17)
    rows = [(i, "copy " * 40 if i % 3 == 0 else "x" * int(rng.integers(0, 400))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sharding.with_keys(docs).persist()
    shards, tolerance, group = 8, 0.002, 0.05
    bounds, n = sharding.splitters(keyed, shards, tolerance, group)
    keys = sorted(((r._k1 + (1 << 63)) << 64 | r._k2 + (1 << 63), r.size) for r in keyed.collect())
    total, below = sum(s for _, s in keys), 0
    edges = [0]
    for _, s in keys:
        edges.append(edges[-1] + s)
    assert n == len(rows) and bounds == sorted(bounds)
    for j, bound in enumerate(bounds, 1):
        below = sum(s for k, s in keys if k < bound)
        least = min(abs(e - total * j / shards) for e in edges)  # nearest place between any two rows
        assert abs(below - total * j / shards) <= max(least + 1, group * total / shards)
    assert {r[0] for r in keyed.select(sharding.shard_of(bounds)).distinct().collect()} == set(range(shards))
    for r in keyed.select("_k1", "_k2", sharding.shard_of(bounds).alias("shard")).collect():
        assert r.shard == sum(((r._k1 + (1 << 63)) << 64 | r._k2 + (1 << 63)) >= b for b in bounds)


def test_equal_texts_stand_side_by_side(spark):
    rows = [(i, f"text number {i % 700}") for i in range(2100)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.001).collect()
    shards = defaultdict(set)
    for r in got:
        shards[rows[r.doc_id][1]].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 0  # groups are small against a hundredth of a shard
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 4
