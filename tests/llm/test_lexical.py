"""Lexical search against a plain scan, and its blocks against their bounds."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidewell.llm import lexical_search as lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) by the contract's formula."""
    each = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total, df = len(each), sum(x[2] for x in each), Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts, size in each:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if counts[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item is None, item or 0, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id is None, r.item_id or 0, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items_of(rows, rng):
    words = [w for _, t in rows for w in (t or "").split()[:300]]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(25)] + [(None, "two WORDS é"), (90, None), (91, "--"), (92, "absentterm"), (93, "same row twice"), (93, "same row twice")]


def test_equals_the_scan(spark, edge_docs, edge_rows, monkeypatch):
    """Whole results with many small shards and blocks, hot copies, ties, repeated rows and null ids."""
    items = items_of(edge_rows, random.Random(4))
    table = spark.createDataFrame([(*x, 1, "y") for x in items], "item_id long, text string, item int, doc_id string")
    want = plain(edge_rows, items)
    assert found(lexical.search(edge_docs, table)) == want
    monkeypatch.setattr(lexical, "QUERY_ITEMS", 7)
    assert found(lexical.search(edge_docs, table)) == want


def test_small_shards(spark, edge_rows, monkeypatch):
    rng = random.Random(8)
    items, docs = items_of(edge_rows, rng), [(i, t) for i, t in edge_rows if i is not None]
    vocabulary, each = {}, []
    queries = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in lexical.term_counts(text)], np.int64) for _, text in items]
    for i, t in docs:
        counts = {vocabulary[w]: n for w, n in lexical.term_counts(t).items() if w in vocabulary}
        each.append((i, counts))
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 3)
    for q in queries[::4]:
        query = lexical.Query(q, 5)
        for at in range(0, len(each), 40):
            part = each[at : at + 40]
            begin = np.concatenate([[0], np.cumsum([len(c) for _, c in part])])
            shard = lexical.Shard(np.array([i for i, _ in part]), begin, np.array([t for _, c in part for t in c], np.int64), np.array([n for _, c in part for n in c.values()], np.int64), len(vocabulary))
            shard.search(query)
            for term in q.tolist():  # every summary covers its documents, coordinate by coordinate
                if not shard.most[term]:
                    continue
                b = shard.blocks_of(term)
                ends = np.append(b.first[1:], len(b.terms))
                for k in range(len(b.low)):
                    of = dict(zip(b.terms[b.first[k] : ends[k]].tolist(), b.values[b.first[k] : ends[k]].tolist()))
                    rows = b.rows[b.begin[k] : b.begin[k + 1]]
                    assert of == {t: max(part[r][1].get(t, 0) for r in rows) for r in rows for t in part[r][1]} and b.low[k] == min(part[r][0] for r in rows)
        scores = sorted(((-sum(c.get(t, 0) for t in q.tolist()), i) for i, c in each if any(t in c for t in q.tolist())))[:5]
        assert list(zip(query.scores.tolist(), query.ids.tolist())) == [(-s, i) for s, i in scores]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 7)
    text = "Ab cdefghijklmnop  q é_ñ 1,2\x00x\x7fy ABC"
    assert lexical.term_counts(text * 3) == Counter(w.encode() for w in terms(text * 3)) and not lexical.term_counts(None)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, plain([(1, "a b")], [(1, "a")])[0][-1])]
