"""Approximate nearest neighbours by inner product: a forest of random-projection trees behind one priority queue, exact at the end.

1. Equal vectors are one node, which keeps its k + 1 smallest ids: no list of k neighbours can hold more of them.
2. `fit` grows the trees on a bounded sample. A split projects on the difference of two random rows, of several the one with the
   widest spread, and parts at the median. Nearness by inner product is made nearness by distance: a vector is divided by the
   largest norm M and gets one more coordinate, so that all have norm 1; a query gets 0 there.
3. Every node falls into one leaf of each tree. Leaves with many nodes are cut into blocks, so a group's size is bounded.
4. A query walks all trees through one queue, ordered by the odds that its k-th neighbour, so far away as the sample tells, lies
   below a branch: each split passed is a normal deviation of the margin. It stops when the odds that no visited leaf of any tree
   holds the neighbour are under 1 - `target`. No number of leaves or candidates is capped.
5. Visited leaves' nodes are compared by exact inner products in double precision, summed from the first component to the last.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES, LEAF_ROWS, SAMPLE_ROWS, TARGET, BLOCK_ROWS = 3, 256, 262_144, 0.985, 65_536
#: Found rows that a task holds before it cuts them to the best of each query; queries whose margins are computed at once.
FOUND_ROWS, QUERY_ROWS = 2_000_000, 512
KEY = ["_q1", "_q2"]
_GRID = np.linspace(-8, 8, 4097)
_NORMAL = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


def usable(vector: Column) -> Column:
    """Not null, of finite components, with one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@dataclass
class Tree:
    """Nodes by number: a split has a direction, a median, the share of a distance that it sees, and two children; a leaf's first child is -1 - leaf."""

    direction: np.ndarray
    median: np.ndarray
    share: np.ndarray
    left: list[int]
    right: list[int]
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = -1 - self.left[node]
            elif len(rows):
                low = points[rows] @ self.direction[node] <= self.median[node]
                todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def grow(points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    direction, median, share, left, right, leaves, todo = [], [], [], [], [], 0, [(np.arange(len(points)), None)]
    while todo:
        rows, parent = todo.pop()
        if parent is not None:
            (left if parent[1] else right)[parent[0]] = len(left)
        best, at, seen = np.zeros(points.shape[1]), 0.0, 1.0
        low = np.ones(len(rows), bool)
        if len(rows) >= 2 * leaf_rows:
            pairs = points[rng.choice(rows, 64)] - points[rng.choice(rows, 64)]
            norms = np.linalg.norm(pairs, axis=1)
            if (norms > 0).any():
                units = pairs[norms > 0] / norms[norms > 0, None]
                best = units[np.argmax((points[rng.choice(rows, 400)] @ units.T).var(0))]
                seen = max(math.sqrt(((pairs @ best) ** 2).sum() / (norms**2).sum()), 1e-6)
                along = points[rows] @ best
                at = float(np.median(along))
                low = along <= at
        direction.append(best), median.append(at), share.append(seen)
        if low.all():
            left.append(-1 - leaves), right.append(0)
            leaves += 1
        else:
            left.append(0), right.append(0)
            todo += [(rows[~low], (len(left) - 1, False)), (rows[low], (len(left) - 1, True))]
    return Tree(np.array(direction), np.array(median), np.array(share), left, right, leaves)


@dataclass
class Forest:
    trees: list[Tree]
    norm: float
    reach: np.ndarray  # sample points that tell how far neighbours are
    rank: int  # the sample's neighbour that stands for the k-th of all

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(1)))[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        points = self.lifted(vectors)
        return np.stack([t.leaf_of(points) for t in self.trees], 1)

    def visits(self, vectors: np.ndarray, target: float) -> Iterator[list[tuple[int, int]]]:
        """For each query the (tree, leaf) pairs that the shared queue gives out before the target is met."""
        queries = np.hstack([vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros((len(vectors), 1))])
        near = queries @ self.reach.T
        near[near > 1 - 1e-12] = -1.0  # the query itself
        rank = min(self.rank, near.shape[1])
        far = np.sqrt(np.maximum(2 - 2 * np.partition(near, near.shape[1] - rank, 1)[:, -rank], 1e-12))
        odds = []
        for tree in self.trees:
            deviation = (queries @ tree.direction.T - tree.median) / (tree.share * far[:, None])
            odds.append(np.interp(-deviation, _GRID, _NORMAL))  # that the neighbour lies below the median
        for q in range(len(vectors)):
            low = [o[q].tolist() for o in odds]
            queue, out, missed = [(-1.0, t, 0) for t in range(len(self.trees))], [], [1.0] * len(self.trees)
            while queue and math.prod(missed) > 1 - target:
                chance, t, node = heapq.heappop(queue)
                tree = self.trees[t]
                while (child := tree.left[node]) >= 0:
                    p = low[t][node]
                    nearer, other, p = (child, tree.right[node], p) if p >= 0.5 else (tree.right[node], child, 1 - p)
                    heapq.heappush(queue, (chance * (1 - p), t, other))
                    node, chance = nearer, chance * p
                missed[t] = max(0.0, missed[t] + chance)
                out.append((t, -1 - child))
            yield out


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """ROW_KEY (128 bits that stand for the vector), embedding and ids, the k + 1 smallest, of each distinct vector."""
    order = Window.partitionBy(*common.ROW_KEY).orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)  # cut in each task before the shuffle
    return few.groupBy(*common.ROW_KEY).agg(F.any_value("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fit(nodes: DataFrame, k: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 13) -> Forest | None:
    """A forest fitted on at most `sample_rows` distinct vectors, drawn by their hashes; None of an empty table."""
    n, norm = nodes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    if not n:
        return None
    share = min(1.0, 1.1 * sample_rows / n)
    drawn = nodes.where(F.pmod(F.xxhash64(*common.ROW_KEY), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else nodes
    sample = matrix(drawn.select("embedding").limit(sample_rows).toArrow().column("embedding").combine_chunks())
    if not len(sample):  # a draw of a table near the bound is never empty in practice
        sample = matrix(nodes.select("embedding").limit(sample_rows).toArrow().column("embedding").combine_chunks())
    rng, forest = np.random.default_rng(seed), Forest([], float(norm), np.empty(0), 1)
    points = forest.lifted(sample)
    forest.trees = [grow(points, leaf_rows, rng) for _ in range(trees)]
    forest.reach = points[rng.permutation(len(points))[:16_384]]
    forest.rank = math.ceil(k * min(1.0, len(forest.reach) / n)) + 1
    return forest


def best(found: list[dict[str, np.ndarray]], k: int) -> dict[str, np.ndarray]:
    """The k best nodes of each query, each once; equal scores by the nodes' smallest ids, so no row that belongs to the best is cut."""
    rows = {name: np.concatenate([f[name] for f in found]) for name in (*KEY, "low", "score")}
    order = np.lexsort((rows["low"], -rows["score"], rows["_q2"], rows["_q1"]))
    rows = {name: x[order] for name, x in rows.items()}
    if not len(order):
        return rows

    def repeats(*names: str) -> np.ndarray:
        return np.concatenate([[False], np.logical_and.reduce([rows[n][1:] == rows[n][:-1] for n in names])])

    once = ~repeats(*KEY, "low")
    rows = {name: x[once] for name, x in rows.items()}
    begins = np.flatnonzero(~repeats(*KEY))
    place = np.arange(len(rows["score"])) - np.repeat(begins, np.diff(np.append(begins, len(rows["score"]))))
    return {name: x[place < k] for name, x in rows.items()}


def compare(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best by exact sums; the fast product only says which pairs may be among them."""
    fast = queries @ vectors.T
    kth = np.partition(fast, -k, 1)[:, -k] if fast.shape[1] > k else fast.min(1)
    slack = 1e-12 * np.abs(queries).sum(1) * np.abs(vectors).max()
    q, v = np.nonzero(fast >= (kth - slack)[:, None])
    score = np.zeros(len(q))
    for d in range(queries.shape[1]):
        score += queries[q, d] * vectors[v, d]
    return q, v, score


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found among `vectors` (vec_id, embedding) to each of `queries` (query_id, embedding).

    Rows without id, and vectors that are null, zero, hold null or non-finite components, or are of another length than most of
    `vectors` (the longer on a tie), take no part. Rows with the query's own id are no candidates. Ties go to the smaller vec_id;
    repeated rows count once each, as queries once. With fewer candidates all are found; an empty table gives no rows. Other
    columns are not read. The target is the odds with which a neighbour is in a visited leaf; what is found has exact scores.
    """
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    valid = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    most = valid.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    dims = most.dims if most else 0
    keyed = common.with_row_key(valid.where(F.size("embedding") == dims), "embedding")
    asked = queries.select("query_id", F.col("embedding").cast(kind).alias("embedding")).where(F.col("query_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == dims))
    asked = common.with_row_key(asked, "embedding").withColumnsRenamed(dict(zip(common.ROW_KEY, KEY)))
    nodes = common.durable(nodes_of(keyed, k))
    forest = spark.sparkContext.broadcast(fit(nodes, k, trees, leaf_rows, sample_rows))
    if forest.value is None:
        return queries.select("query_id").where("false").select("query_id", F.lit(1).alias("rank"), F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("score"))

    def place(batch: pa.RecordBatch) -> dict:
        return {name: batch.column(name) for name in ("low", "embedding")} | {"leaves": pa.array(list(forest.value.leaves(matrix(batch.column("embedding")))), pa.list_(pa.int64()))}

    named = nodes.select(F.col("ids")[0].alias("low"), "embedding")  # a node goes by its smallest id
    index = common.durable(common.map_batches(named, place, f"low long, embedding {kind}, leaves array<long>"))
    sizes = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()  # one row a leaf of the fitted trees
    blocks = {(r["tree"], r["leaf"]): -(-r["count"] // block_rows) for r in sizes}
    several = [x for (t, leaf), n in blocks.items() if n > 1 for x in (F.lit(f"{t}:{leaf}"), F.lit(n))]
    of = F.coalesce(F.try_element_at(F.create_map(*several), F.concat_ws(":", "tree", "leaf")), F.lit(1)) if several else F.lit(1)
    rows = index.select("low", "embedding", F.posexplode("leaves").alias("tree", "leaf"))
    block = F.pmod(F.xxhash64("low"), of).cast("int").alias("block")
    rows = rows.select("tree", "leaf", block, F.lit(0).alias("side"), F.col("low").alias("a"), F.lit(0).cast("long").alias("b"), "embedding")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(at, QUERY_ROWS)
                visits = [[(t, leaf, b) for t, leaf in v for b in range(blocks.get((t, leaf), 0))] for v in forest.value.visits(matrix(batch.column("embedding")), target)]
                took = pa.array(np.repeat(np.arange(len(visits)), [len(v) for v in visits]))
                flat = np.array([x for v in visits for x in v], np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_pydict({"tree": flat[:, 0], "leaf": flat[:, 1].astype(np.int64), "block": flat[:, 2], "side": np.ones(len(flat), np.int32)} | {h: batch.column(n).take(took) for h, n in zip("ab", KEY)} | {"embedding": batch.column("embedding").take(took)})

    routed = asked.dropDuplicates(KEY).select(*KEY, "embedding").mapInArrow(route, f"tree int, leaf long, block int, side int, a long, b long, embedding {kind}")
    group = ["tree", "leaf", "block"]
    dealt = rows.unionByName(routed).repartition(*group).sortWithinPartitions(*group, "side")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found, n = None, (), [], 0
        for batch in batches:
            columns = {name: batch.column(name).to_numpy() for name in (*group, "side", "a", "b")}
            points = matrix(batch.column("embedding"))
            change = np.any([np.diff(columns[name]) != 0 for name in (*group, "side")], 0) if len(points) > 1 else np.empty(0, bool)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(points)]
            for i, j in zip(cuts, cuts[1:]):
                mine = tuple(columns[name][i] for name in group)
                if columns["side"][i] == 0:
                    more = (columns["a"][i:j], points[i:j])
                    held = tuple(map(np.concatenate, zip(held, more))) if at == mine else more  # a block may go on in the next batch
                    at = mine
                elif at == mine:
                    for a in range(i, j, QUERY_ROWS):
                        b = min(j, a + QUERY_ROWS)
                        q, v, score = compare(points[a:b], held[1], k + 1)
                        found.append({"_q1": columns["a"][a:b][q], "_q2": columns["b"][a:b][q], "low": held[0][v], "score": score})
                        n += len(score)
                    if n > FOUND_ROWS:
                        found = [best(found, k + 1)]
                        n = len(found[0]["score"])
                        if n > FOUND_ROWS // 2:
                            yield pa.RecordBatch.from_pydict(found.pop())
                            n = 0
        if found:
            yield pa.RecordBatch.from_pydict(best(found, k + 1))

    partial = dealt.mapInArrow(answer, "_q1 long, _q2 long, low long, score double").dropDuplicates([*KEY, "low"])
    top = partial.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "low"))).where(F.col("_n") <= k + 1)
    answers = top.join(nodes.select(F.col("ids")[0].alias("low"), "ids"), "low").select(*KEY, "score", F.explode("ids").alias("vec_id"))
    order = (F.col("score").desc(), "vec_id")
    answers = common.durable(answers.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("_n") <= k + 1).drop("_n"))
    each = asked.select("query_id", *KEY).distinct().join(answers, KEY).where("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *KEY).orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


QUERIES = {"op13_vector_search": op13_vector_search}
