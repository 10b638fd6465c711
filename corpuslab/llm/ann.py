"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are joined to one class first, so that one vector held by many rows is searched
once and stands in one leaf once. Trees are fitted on a bounded sample of classes: a node splits
by the hyperplane halfway between two of its vectors, down to leaves of ``leaf_size`` of the
sample. Below that every tree goes on by as many levels as the whole table needs for leaves of that
size: a level splits by the side of a random hyperplane through the mean of the leaf it stands in,
so the model stays bounded while leaves hold no more rows of a larger table. Every class is sent
down every tree. A query walks all trees at once through one priority queue ordered by the squared
margins of the splits it would cross, nearest side first, and visits the best leaves of the forest.
How many is measured: the true neighbours of a few sampled vectors are found by a scan of the whole
table, and queries visit as many leaves as it takes until ``recall`` of those are met. Rows and
visits meet by tree and group of leaves, and the candidates are ranked by their exact cosine.

The index is fitted on a bounded sample (``n_sample`` vectors), but every row is indexed, once for
each tree, and a query's visits are sent once for each group of leaves: what is shuffled grows in
proportion to rows and queries, and what meets in one task is a few leaves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of one dimension are searched among themselves, each dimension with a forest of its
own; a row is never its own neighbour, equal vectors of other rows are; ties go to the smaller id;
with fewer candidates than ``k``, all found are returned; an empty table gives no rows; repeated
rows (same id) count once. Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


#: Leaves of neighbouring numbers (siblings and cousins) that are ranked in one group.
LEAVES_TOGETHER = 16


@dataclass(frozen=True)
class Tree:
    """Inner nodes by number: normal, offset and children; a child below 0 is leaf ``-1 - child``.

    Each leaf of the fitted tree is split again by ``directions`` through its mean; the final leaf's
    number is the fitted leaf's, followed by one bit for each of them.
    """

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    means: np.ndarray
    directions: np.ndarray


def grow(points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """A tree over unit vectors. Nodes that no hyperplane splits are halved at random."""
    normals, offsets, children, means = [], [], [], []
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        if len(rows) <= leaf_size:
            mine = -1 - len(means)
            means.append(points[rows].mean(axis=0) if len(rows) else np.zeros(points.shape[1]))
        else:
            mine = len(normals)
            for _ in range(3):
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = a - b
                size = np.sqrt(normal @ normal)
                if size > 0:
                    normal /= size
                offset = float(normal @ (a + b) / 2)
                right = points[rows] @ normal > offset
                if 0.05 * len(rows) <= right.sum() <= 0.95 * len(rows):
                    break
            else:
                offset = float(np.median(points[rows] @ normal))
                right = points[rows] @ normal > offset
                if not 0 < right.sum() < len(rows):
                    right = rng.permutation(len(rows)) % 2 == 0
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            stack.append((rows[right], mine, 1))
            stack.append((rows[~right], mine, 0))
        if parent >= 0:
            children[parent][side] = mine
    dim = points.shape[1]
    return Tree(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(means), np.zeros((0, dim)))


def deepened(tree: Tree, n_levels: int, rng: np.random.Generator) -> Tree:
    """The tree with so many more levels of random directions, orthogonal ones as far as they go."""
    dim = tree.normals.shape[1]
    rows = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-n_levels // dim))]
    return replace(tree, directions=np.concatenate([*rows, np.zeros((0, dim))])[:n_levels])


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point, level by level."""
    at = np.zeros(len(points), np.int64) if len(tree.offsets) else np.full(len(points), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        margin = np.einsum("ij,ij->i", points[inner], tree.normals[node]) - tree.offsets[node]
        at[inner] = tree.children[node, (margin > 0).astype(np.int64)]
    leaf, n_levels = -1 - at, len(tree.directions)
    if not n_levels:
        return leaf
    bits = (points - tree.means[leaf]) @ tree.directions.T > 0
    return (leaf << n_levels) | (bits.astype(np.int64) << np.arange(n_levels)).sum(axis=1)


def visits_of(forest: list[Tree], point: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) for a query, the best first, over all trees through one queue."""
    margins = [tree.normals @ point - tree.offsets for tree in forest]
    below: dict[tuple[int, int], np.ndarray] = {}
    queue = [(0.0, t, 0 if len(tree.offsets) else -1, 0, 0) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        far, t, node, level, code = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            margin = float(margins[t][node])
            near = int(margin > 0)
            heapq.heappush(queue, (far + margin * margin, t, int(tree.children[node, 1 - near]), 0, 0))
            node = int(tree.children[node, near])
        n_levels = len(tree.directions)
        if n_levels and (t, node) not in below:
            below[t, node] = tree.directions @ (point - tree.means[-1 - node])
        for n in range(level, n_levels):
            margin = float(below[t, node][n])
            near = int(margin > 0)
            heapq.heappush(queue, (far + margin * margin, t, node, n + 1, code | (1 - near) << n))
            code |= near << n
        yield t, (-1 - node) << n_levels | code


def visits_for_recall(forest: list[Tree], asked: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """Leaves that each query visits until this share of the asked vectors' neighbours is met."""
    walks = [visits_of(forest, point) for point in asked]
    wanted = []
    for points in near:
        leaves = [leaves_of(tree, points).tolist() for tree in forest] if len(points) else []
        wanted.append([{(t, leaf[i]) for t, leaf in enumerate(leaves)} for i in range(len(points))])
    left = sum(map(len, wanted))
    most_left, n_visits = (1.0 - recall) * left, 0
    while left and left > most_left:
        n_visits += 1
        visits = [next(walk, None) for walk in walks]
        wanted = [[places for places in open_ if visit not in places] for open_, visit in zip(wanted, visits)]
        left = sum(map(len, wanted))
    return max(1, n_visits)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_key(vector: str) -> Column:
    """128 bits that stand for a vector, and its size."""
    return F.struct(F.xxhash64(vector), F.xxhash64(F.lit(7), vector), F.size(vector)).alias("key")


def vector_classes(rows: DataFrame, keep: int, id_col: str, vec_col: str) -> DataFrame:
    """Classes of equal vectors: key, the vector and the ``keep`` smallest ids."""
    vector = F.col(vec_col)
    good = rows.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    good = good.select("id", "v", vector_key("v"))
    # Smallest ids first per key: Spark cuts each task's groups to ``keep`` before the shuffle.
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    first = good.withColumn("nth", nth).where(F.col("nth") <= keep)
    classes = first.groupBy("key").agg(F.min("id").alias("c"), F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    return classes.select("c", "ids", "v", F.size("v").alias("dim"))


def fit(classes: DataFrame, k: int, recall: float, n_sample: int, n_trees: int, leaf_size: int, n_asked: int, seed: int) -> tuple[list[Tree], int]:
    """The forest on the ``n_sample`` classes of one dimension with the smallest hashes, and the leaves to visit."""
    n_classes = classes.count()
    sample = classes.orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(n_sample).select("c", "v").collect()
    sample.sort(key=lambda r: r["c"])
    points = _unit([r["v"] for r in sample])
    rng = np.random.default_rng(seed)
    n_levels = max(0, int(np.ceil(np.log2(n_classes / len(points)))))
    forest = [deepened(grow(points, leaf_size, rng), n_levels, rng) for _ in range(n_trees)]
    chosen = rng.choice(len(points), min(n_asked, len(points)), replace=False)
    asked, ids = points[chosen], [sample[i]["c"] for i in chosen]
    return forest, visits_for_recall(forest, asked, true_neighbours(classes, asked, ids, k), recall)


def true_neighbours(classes: DataFrame, asked: np.ndarray, ids: list[int], k: int) -> list[np.ndarray]:
    """The ``k`` nearest other classes of a few asked ones, by a scan of all classes."""
    shared = classes.sparkSession.sparkContext.broadcast(asked)  # n_asked vectors

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"a": [], "c": [], "score": [], "v": []})
        for part in frames:
            if len(part):
                scores = shared.value @ _unit(part["v"]).T
                n = min(k + 1, len(part))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                rows = np.repeat(np.arange(len(scores)), n)
                found = pd.DataFrame({"a": rows, "c": part["c"].to_numpy()[top.ravel()], "score": scores[rows, top.ravel()], "v": part["v"].to_numpy()[top.ravel()]})
                held = pd.concat([held, found]) if len(held) else found
                held = held.sort_values(["a", "score"], ascending=[True, False], kind="stable")
                held = held[held.groupby("a").cumcount() <= k]
        yield held

    kind = classes.schema["v"].dataType.simpleString()
    found = classes.select("c", "v").mapInPandas(best, f"a long, c long, score double, v {kind}")
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "c"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).collect()  # n_asked * (k + 1) at most
    rows.sort(key=lambda r: r["nth"])
    near = [[r["v"] for r in rows if r["a"] == a and r["c"] != own][:k] for a, own in enumerate(ids)]
    return [_unit(vectors) if vectors else np.zeros((0, asked.shape[1])) for vectors in near]


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best_of(visits: pd.DataFrame, held: pd.DataFrame, n_best: int) -> pd.DataFrame:
    """The ``n_best`` rows by exact cosine for each query, leaf by leaf of one group of leaves."""
    parts = []
    leaves = held["leaf"].to_numpy()
    order = np.argsort(leaves, kind="stable")
    leaves = leaves[order]
    ids, x = held["c"].to_numpy()[order], np.array([np.asarray(v, np.float64) for v in held["v"]])[order]
    norms = np.sqrt((x * x).sum(axis=1))
    for leaf, part in visits.explode("leaves").groupby("leaves"):
        low, high = np.searchsorted(leaves, [leaf, leaf + 1])
        if low == high:
            continue
        y = np.array([np.asarray(v, np.float64) for v in part["qv"]])
        y_norms = np.sqrt((y * y).sum(axis=1))
        rough = (y @ x[low:high].T) / y_norms[:, None] / norms[low:high]
        # Products of whole matrices may differ in the last bits: a margin keeps all that may tie.
        n = min(n_best, high - low)
        floor = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-9
        rows, columns = np.nonzero(rough >= floor[:, None])
        own = x[low:high][columns]
        scores = (own * y[rows]).sum(axis=1) / (norms[low:high][columns] * y_norms[rows])
        parts.append(pd.DataFrame({"q": part["q"].to_numpy()[rows], "c": ids[low:high][columns], "score": scores}))
    if not parts:
        return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64", "score": "float64"})
    found = pd.concat(parts).sort_values(["q", "score", "c"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("q").cumcount() < n_best]


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    recall: float = 0.97,
    n_trees: int = 8,
    leaf_size: int = 128,
    n_sample: int = 60_000,
    n_asked: int = 64,
    seed: int = 41,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of each query row by cosine."""
    classes = written(vector_classes(rows, k + 1, id_col, vec_col), "ann-classes")
    is_asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("query_id")).where("query_id is not null").distinct()
    asked = written(_asked(rows, is_asked, classes, id_col, vec_col), "ann-asked")
    found = rows.sparkSession.createDataFrame([], "q long, c long, score double")
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        mine = classes.where(F.col("dim") == dim)
        queries = mine.join(asked.select(F.col("q").alias("c")).distinct(), "c", "left_semi").select("c", "v")
        forest, n_visits = fit(mine, k, recall, n_sample, n_trees, leaf_size, n_asked, seed)
        found = found.union(_nearest(mine, queries, forest, n_visits, k))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    found = written(found.withColumn("nth", best).where(F.col("nth") <= k + 1).drop("nth"), "ann-found")

    ids = found.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    lists = ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    answers = asked.join(lists, "q").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _nearest(classes: DataFrame, queries: DataFrame, forest: list[Tree], n_visits: int, k: int) -> DataFrame:
    """q, c and score: the best ``k`` + 1 classes of the leaves that each query visits."""
    context = classes.sparkSession.sparkContext
    shared = context.broadcast([astuple(tree) for tree in forest])  # bounded by the sample

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree(*t) for t in shared.value]
        for part in frames:
            if len(part):
                points = _unit(part["v"])
                for t, tree in enumerate(trees):
                    leaves = leaves_of(tree, points)
                    yield pd.DataFrame({"tree": t, "nearby": leaves // LEAVES_TOGETHER, "leaf": leaves, "c": part["c"], "v": part["v"]})

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree(*t) for t in shared.value]
        for part in frames:
            rows = []
            for c, v, point in zip(part["c"], part["v"], _unit(part["v"]) if len(part) else ()):
                groups: dict[tuple[int, int], list[int]] = {}
                for t, leaf in islice(visits_of(trees, point), n_visits):
                    groups.setdefault((t, leaf // LEAVES_TOGETHER), []).append(leaf)
                rows.extend((t, nearby, leaves, c, v) for (t, nearby), leaves in groups.items())
            yield pd.DataFrame(rows, columns=["tree", "nearby", "leaves", "q", "qv"])

    def rank(visits: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return best_of(visits, held, k + 1)

    kind = classes.schema["v"].dataType.simpleString()
    visits = queries.repartition(context.defaultParallelism).mapInPandas(walk, f"tree int, nearby long, leaves array<long>, q long, qv {kind}")
    index = classes.select("c", "v").mapInPandas(send, f"tree int, nearby long, leaf long, c long, v {kind}")
    found = visits.groupBy("tree", "nearby").cogroup(index.groupBy("tree", "nearby")).applyInPandas(rank, "q long, c long, score double")
    return found.groupBy("q", "c").agg(F.max("score").alias("score"))


def _asked(rows: DataFrame, is_asked: DataFrame, classes: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The class of each query row."""
    vectors = rows.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    keyed = vectors.join(is_asked, "query_id", "left_semi").select("query_id", vector_key("v")).dropDuplicates(["query_id"])
    return keyed.join(classes.select("c", vector_key("v")), "key").select("query_id", F.col("c").alias("q"))
