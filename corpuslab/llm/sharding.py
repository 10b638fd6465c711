"""Sharding over fixed virtual slots.

Every record is hashed into one of a fixed number of slots (thousands, whatever the number of
shards); bytes and rows are summed per slot; a small versioned map says which shard holds which
slot. The records never move between slots, so rebalancing edits the map alone.

Defined cases: a null text counts as empty (size 1, crc32 0); a null id hashes like any value;
repeated rows fall into the same slot and get places of their own, while equal texts under other
ids go to other slots; a record larger than a shard's share makes that shard larger by it; an empty
table gives no rows and a map with all slots dealt round robin. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import literal_array, shared_dir

#: Slots never change once a data set is laid out; 4096 slots hold 25 GB each at 100 TB.
N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shards[slot]`` is the shard of a slot. Each edit gives a new version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    SCHEMA = T.StructType(
        [
            T.StructField("version", T.IntegerType(), False),
            T.StructField("n_shards", T.IntegerType(), False),
            T.StructField("slot", T.IntegerType(), False),
            T.StructField("shard", T.IntegerType(), False),
        ]
    )

    def frame(self, spark: SparkSession) -> DataFrame:
        slots = spark.range(len(self.shards)).select(F.col("id").cast("int").alias("slot"))
        return slots.select(
            F.lit(self.version).alias("version"),
            F.lit(self.n_shards).alias("n_shards"),
            "slot",
            F.get(literal_array(self.shards, "int"), F.col("slot")).alias("shard"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the map table; older versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.schema(cls.SCHEMA).parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("slot").collect()
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def slot_of(n_slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str) -> DataFrame:
    """Rows and bytes of each slot; at most as many rows as there are slots."""
    return records.groupBy(slot).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def plan(sizes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """The first map: slots by falling bytes, each to the shard that holds least so far."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-sizes.get(s, 0), s)):
        held, count, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, 0), count + 1, shard))
    return SlotMap(1, n_shards, tuple(shards))


def rebalance(old: SlotMap, sizes: dict[int, int], n_shards: int) -> SlotMap:
    """The next version for ``n_shards`` shards, moving as few bytes as it takes.

    Slots of shards that no longer exist move first; then slots leave the fullest shard for the
    emptiest while that narrows the gap between them. Where shards are added, they alone take slots.
    """
    shards = list(old.shards)
    held = [0] * n_shards
    own: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(shards):
        if shard < n_shards:
            held[shard] += sizes.get(slot, 0)
            own[shard].append(slot)
        else:
            homeless.append(slot)

    def move(slot: int, to: int) -> None:
        shards[slot] = to
        held[to] += sizes.get(slot, 0)
        own[to].append(slot)

    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        move(slot, min(range(n_shards), key=lambda i: (held[i], i)))
    takers = range(old.n_shards, n_shards) if n_shards > old.n_shards else range(n_shards)
    for _ in range(len(shards)):
        full = max(range(n_shards), key=lambda i: (held[i], -i))
        free = min(takers, key=lambda i: (held[i], i))
        gap = held[full] - held[free]
        fits = [s for s in own[full] if 0 < sizes.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        own[full].remove(slot)
        held[full] -= sizes[slot]
        move(slot, free)
    return SlotMap(old.version + 1, n_shards, tuple(shards))


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, bytes (UTF-8 plus 1), crc32 and virtual slot of each document.

    The text's checksum is hashed with the id, so that rows without an id spread as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return small.withColumn("virtual_slot", slot_of(n_slots, F.col("doc_id"), F.col("text_crc32")))


def collect_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows by slot, on the driver: one row for each slot at most."""
    found = slot_sizes(records, "virtual_slot", "size").limit(n_slots).collect()
    return {r["virtual_slot"]: r["n_bytes"] for r in found}, {r["virtual_slot"]: r["n_rows"] for r in found}


def place(records: DataFrame, slot_map: SlotMap, n_rows: dict[int, int]) -> DataFrame:
    """Shard of each record and its place in the shard, gapless from 0.

    Slots stand in a shard in the order of their numbers; a record's place is the number of rows
    in the slots before its own plus its rank inside its slot, so no window spans a whole shard.
    """
    before, seen = [], [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shards):
        before.append(seen[shard])
        seen[shard] += n_rows.get(slot, 0)
    slot = F.col("virtual_slot")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(literal_array(slot_map.shards, "int"), slot).alias("shard"),
        (F.get(literal_array(before, "bigint"), slot) + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        slot,
    )


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every document with its shard, by the law ``bytes`` (near-equal sizes).

    The map is a table: where ``map_path`` has none, version 1 is planned and stored there; where it
    has one for another number of shards, the next version is its rebalanced edit; else its last
    version holds. Shards are read from the stored version. Without a path a new one is taken in
    the shared folder.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    records = records_of(docs, n_slots=n_slots)
    sizes, n_rows = collect_sizes(records, n_slots)
    stored = SlotMap.load(spark, path) if map_path and _is_stored(spark, path) else None
    if stored is None:
        plan(sizes, n_shards, n_slots).save(spark, path)
    elif stored.n_shards != n_shards:
        rebalance(stored, sizes, n_shards).save(spark, path)
    return place(records, SlotMap.load(spark, path), n_rows)


def _is_stored(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
