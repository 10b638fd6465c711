"""Exact cosine self-join, pruned by angles to pivots.

The angle between vectors is a metric. Each vector has its home in the cell of its nearest pivot; if
x has its home with p and y is within the radius r of x, then angle(y, p) <= angle(y, own) + 2 r, so
y visits the cells for which that holds, and every pair meets in the cell of the lower home. Inside
a cell angles to the pivot differ by r at most, so vectors are cut into rings of that width, and
only the same and neighbouring rings meet. What meets is compared in blocks, as matrix products.

How much that prunes depends on the data: clustered vectors share cells with their like, isotropic
ones of many dimensions lie within the window of every pivot. Pivots are therefore the means of a
bounded sample, for several numbers of them, one among these, and the number is taken that has the
fewest comparisons by the sample's own angles. The result is exact with any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Rows of a block of vectors, at most.
BLOCK_ROWS = blocks.ROWS
#: Vectors that pivots are chosen by.
SAMPLE_ROWS = 2048
#: Numbers of pivots that are tried.
PIVOTS = (1, 8, 32, 128, 512)
#: Added to windows for rounding.
EPSILON = 1e-6


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical means of the sample, from points far apart."""
    chosen = [0]
    nearest = sample @ sample[0]
    for _ in range(1, k):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    means = sample[chosen]
    for _ in range(rounds):
        home = (sample @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, home, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        means = np.where(norm > 0, sums / np.maximum(norm, 1e-300), means)
    return means


def _places(angles: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every home, first, and of every visit: to cells before the home only."""
    home = angles.argmin(axis=1)
    visits = angles <= angles[np.arange(len(home)), home][:, None] + 2 * radius + EPSILON
    visits &= np.arange(angles.shape[1])[None, :] < home[:, None]
    rows, cells = np.nonzero(visits)
    return np.concatenate([np.arange(len(home)), rows]), np.concatenate([home, cells])


def _planned(angles: np.ndarray, radius: float) -> float:
    """Comparisons of a sample: in each cell homes with homes and visitors of the same and the next rings."""
    rows, cells = _places(angles, radius)
    at = np.floor(angles[rows, cells] / (radius + EPSILON)).astype(int)
    width = int(math.pi / (radius + EPSILON)) + 3
    n = len(angles)
    homes = np.bincount(cells[:n] * width + at[:n] + 1, minlength=angles.shape[1] * width).reshape(-1, width)
    every = np.bincount(cells * width + at + 1, minlength=angles.shape[1] * width).reshape(-1, width)
    near = every + np.pad(every[:, 1:], ((0, 0), (0, 1))) + np.pad(every[:, :-1], ((0, 0), (1, 0)))
    return float((homes * near).sum()) + 50.0 * len(rows)


def choose_pivots(sample: np.ndarray, radius: float) -> np.ndarray:
    """The pivots with the fewest comparisons, of unit vectors."""
    best, least = sample[:1], math.inf
    for k in PIVOTS:
        if k <= max(1, len(sample) // 4):
            pivots = _means(sample, k)
            planned = _planned(_angles(sample, pivots), radius)
            if planned < 0.9 * least:
                best, least = pivots, planned
    return best


def placed(rows: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v, cell, is_home and ring of each vector, in its home and in the cells it visits.

    The same pair meets nowhere else: x at home, and y at home or visiting, in rings next to each other.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    radius = math.acos(max(-1.0, min(1.0, threshold)))
    sample = base.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).select("v").collect()
    if not sample:
        return base.select("id", "v", F.lit(0).alias("cell"), F.lit(True).alias("is_home"), F.lit(0).alias("ring"))
    pivots = choose_pivots(_units([r["v"] for r in sample]), radius)

    def place(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        angles = _angles(_units(vectors), pivots)
        rows, cells = _places(angles, radius)
        rings = np.floor(angles[rows, cells] / (radius + EPSILON)).astype(int)
        found: list[list[dict]] = [[] for _ in vectors]
        for nth, (row, cell, ring) in enumerate(zip(rows.tolist(), cells.tolist(), rings.tolist())):
            found[row].append({"cell": cell, "is_home": nth < len(vectors), "ring": ring})
        return pd.Series(found)

    udf = F.pandas_udf(place, "array<struct<cell: int, is_home: boolean, ring: int>>").asNondeterministic()
    return base.select("id", "v", F.explode(udf("v")).alias("p")).select("id", "v", "p.*")


def meetings(at: DataFrame) -> DataFrame:
    """cell, ring, homes and others: what meets in each ring, without the vectors; others include the homes."""
    homes = at.where("is_home").groupBy("cell", "ring").agg(F.count("*").alias("homes"))
    near = at.withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    return homes.join(near.groupBy("cell", "ring").agg(F.count("*").alias("others")), ["cell", "ring"])


def similar_vectors(rows: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs i < j of rows with a cosine of at least ``threshold``, and their score, rounded to six places.

    All pairs are output, however many there are. A zero vector has a cosine of 0 with every other.
    """
    at = placed(rows, threshold - 1e-6, id_col, vec_col)
    # No more rows than there are cells and rings.
    sizes = F.broadcast(meetings(at).select(
        "cell", "ring", blocks.blocks_of(F.col("homes"), block_rows).alias("na"), blocks.blocks_of(F.col("others"), block_rows).alias("nb")
    ))
    block = F.xxhash64("id", "v")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = at.where("is_home").join(sizes, ["cell", "ring"]).withColumn("a", F.pmod(block, F.col("na")).cast("int")).withColumn("b", spread("nb"))
    others = at.withColumn("of", F.col("ring")).withColumn("ring", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)))
    others = others.join(sizes, ["cell", "ring"]).withColumn("b", F.pmod(block, F.col("nb")).cast("int")).withColumn("a", spread("na"))
    kind = rows.schema[id_col].dataType.simpleString()

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        of_x, of_y = _units(x["v"]), _units(y["v"])
        ids, others, at_home = x["id"].to_numpy(), y["id"].to_numpy(), y["is_home"].to_numpy(bool)
        for some in blocks.slices(len(of_x), len(of_y)):
            scores = of_x[some] @ of_y.T
            i, j = np.nonzero(scores >= threshold - 1e-6)
            a, b, s = ids[some][i], others[j], scores[i, j]
            # Two homes of one cell meet twice.
            keep = np.where(at_home[j], a < b, a != b)
            yield pd.DataFrame({"i": np.minimum(a, b)[keep], "j": np.maximum(a, b)[keep], "score": s[keep]})

    met = blocks.meet(homes.select("id", "v", "cell", "ring", "a", "b"), others.select("id", "v", "is_home", "cell", "ring", "a", "b"), ["cell", "ring", "a", "b"], meet, f"i {kind}, j {kind}, score double")
    return met.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
