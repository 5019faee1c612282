import random

import pytest

EXTRA = "n_tokens int, spans string, kept int, row_id int, hash int, node int, _h1 string, bitmap string, score int, shard string, words int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empties, white space, long texts, exact and near copies, shared passages, a repeated row, a null id."""
    rng = random.Random(7)
    base, passage, long_line = prose(rng, 200), prose(rng, 60), "A line that many Documents hold, with Capitals"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "é ß 你好 \x85 x"), (7, prose(rng, 30_000, 5000))]
    rows += [(10 + i, base) for i in range(6)]
    for i in range(40):
        w = base.split()
        for _ in range(i % 8):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 25)) for i in range(12)]
    rows += [(300 + i, f"{prose(rng, 8)}\n  {long_line.upper() if i % 2 else long_line}\t\nshort\nshort\n{long_line}") for i in range(9)]
    rows += [(400, prose(rng, 50)), (400, prose(rng, 50)), (None, base + " tail"), (None, None), (401, "same row twice " * 20), (401, "same row twice " * 20)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows as documents, with columns whose names the operators use themselves."""
    n = len(EXTRA.split(","))
    data = [(i, t, ("en", "de", None)[k % 3], None if k % 5 == 0 else "hot", None if t is None else len(t), *[None] * n) for k, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5)
