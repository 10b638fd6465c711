"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled order. A document's virtual time is the number of its
source's words up to it, divided by the source's weight; a further pass over the source adds all
of the source's words. Sorting every pass of every document by virtual time interleaves the
sources in proportion to their weights, and cutting the sorted stream at the total budget gives
the mix: a source that runs out (after ``passes`` passes) leaves its share to the others.
Words are counted up to a document's middle, so that the cut errs by half a document either way.

Nothing is gathered by source: running totals are taken over hashed buckets of a source (a first
pass sums the buckets, a second adds up inside each), and the cut is found on a histogram of
virtual times, then exactly inside the one bucket that it falls into.

Defined cases: null or empty texts have size 0 and take nothing; null sources are one source,
ordered last; repeated rows (same id and text) count each but move as one unit; an empty table
gives no rows. Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import removed, word_count, written

#: Buckets of a source's shuffled order and of the virtual times' histogram.
N_BUCKETS = 4096
SEED = 17


def source_key(source: Column) -> Column:
    """A key that is never null: null and the strings stay apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def order_key(id_col: str, text_col: str, seed: int) -> Column:
    """Where a document stands in its source's shuffled order."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights in turn over the sources by code point, null last. One row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source_key") == "n", "source_key")) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(cycle)))))


def fill(sources: DataFrame, passes: int) -> DataFrame:
    """Targets: shares of the total by weight, none above ``passes`` times the source's size.

    In the order in which growing targets reach their bound, the level at which the rest of the
    budget is shared among the sources not yet full is a running sum; the first level that keeps
    within the next bound holds. One row for each source.
    """
    bound = F.col("source_size") * F.lit(passes)
    by_bound = Window.orderBy(bound / F.col("weight"), "source_key")
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_bound.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy())
    level = (budget - F.coalesce(F.sum(bound).over(before), F.lit(0))) / F.sum("weight").over(rest)
    steps = sources.select("*", level.alias("level"), (level <= bound / F.col("weight")).alias("holds"))
    steps = steps.withColumn("clock", F.max(F.when(F.col("holds"), F.col("level"))).over(Window.partitionBy()))
    full = bound.cast("double")
    target = F.when(F.col("clock").isNull(), full).otherwise(F.least(full, F.col("weight") * F.col("clock")))
    return steps.select("source_key", "weight", "source_size", target.alias("target"), "clock")


def queue(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for each distinct document of a source with its words and those before it."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        source_key(F.col(source_col)).alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        order_key(id_col, text_col, seed).alias("order_key"),
    ).withColumn("bucket", F.shiftrightunsigned("order_key", 52).cast("int"))
    units = base.repartition("source_key", "bucket")
    units = units.groupBy("source_key", "bucket", "order_key", "doc_id", "size").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("upto", F.sum(words).over(inside))


def mix(
    docs: DataFrame,
    weights=cyclic_weights,
    passes: int = 3,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document.

    ``weights`` maps a frame (source_key, source_size) to the same with ``weight``. Returns
    doc_id, order_key, copies, size, source_key, source_size, target and n_passes, one row for
    each distinct document.
    """
    queued = written(queue(docs, seed, id_col, text_col, source_col), "mix-queue")
    words = F.col("size") * F.col("copies")
    buckets = queued.groupBy("source_key", "bucket").agg(F.sum(words).alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    sources = buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"))
    sources = fill(weights(sources), passes)

    timed = queued.join(offsets, ["source_key", "bucket"]).join(sources, "source_key")
    middle = F.col("before") + F.col("upto") - words / F.lit(2.0)
    timed = timed.withColumn("first_time", middle / F.col("weight"))
    timed = timed.withColumn("lap", F.col("source_size") / F.col("weight"))
    timed = written(timed.drop("before", "upto", "bucket"), "mix-timed")
    removed(queued)

    cut = cut_time(timed, passes)
    laps = (F.lit(cut) - F.col("first_time")) / F.nullif(F.col("lap"), F.lit(0.0))
    laps = F.greatest(F.lit(-1.0), F.least(F.lit(float(passes)), laps))
    n_passes = F.least(F.lit(passes), F.floor(laps).cast("int") + 1)
    taken = F.when(F.col("size") == 0, 0).otherwise(F.coalesce(n_passes, F.lit(0)))
    return timed.select("doc_id", "order_key", "copies", "size", "source_key", "source_size", "target", taken.cast("int").alias("n_passes"))


def cut_time(timed: DataFrame, passes: int) -> float:
    """The virtual time at which the sorted stream reaches the budget.

    Only one number reaches the driver. The stream is summed over range buckets of virtual time;
    the exact order matters in the bucket where the running sum meets the budget alone.
    """
    facts = timed.agg(F.sum(F.col("size") * F.col("copies")).alias("budget"), F.max("clock").alias("clock")).first()
    if not facts["budget"]:
        return 0.0
    budget, clock = int(facts["budget"]), facts["clock"]
    if clock is None:
        return float("inf")
    step = 2.0 * clock / N_BUCKETS
    laps = timed.where("size > 0").withColumn("lap_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    stream = laps.select(
        (F.col("first_time") + F.col("lap_no") * F.col("lap")).alias("time"),
        (F.col("size") * F.col("copies")).alias("words"),
        "source_key",
        "order_key",
    ).withColumn("range", F.least(F.floor(F.col("time") / step), F.lit(N_BUCKETS)).cast("int"))
    ranges = stream.groupBy("range").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    found = ranges.select("range", "words", upto.alias("upto")).where(F.col("upto") >= budget).orderBy("range").first()
    if found is None:
        return float("inf")
    order = Window.orderBy("time", "source_key", "order_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = stream.where(F.col("range") == found["range"]).withColumn("upto", F.sum("words").over(order))
    room = budget - (found["upto"] - found["words"])
    last = inside.where(F.col("upto") <= room).agg(F.max("time")).first()[0]
    return float(last) if last is not None else found["range"] * step


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, in the columns of ``docs``."""
    seed = options.get("seed", SEED)
    plan = mix(docs, **options)
    plan = plan.where("n_passes > 0").select(F.col("order_key").alias("__key"), F.col("source_key").alias("__source"), F.col("n_passes").alias("__passes"))
    keyed = docs.withColumn("__key", order_key("doc_id", "text", seed)).withColumn("__source", source_key(F.col("source")))
    taken = keyed.join(plan, ["__key", "__source"]).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
