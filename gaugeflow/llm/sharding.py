"""Sharding through fixed virtual slots.

Records hash into thousands of virtual slots, bytes are summed per slot, and a
versioned map says which shard owns a slot.  Rebalancing edits the map: it moves
the slots that bring the heaviest and the lightest shard together, so most slots
stay where they were.  Only the slot totals (one row a slot, a fixed number)
reach the driver; texts are never shuffled.

Equal texts hash to one slot and so to one shard.  A group of equal texts that
exceeds half a shard in bytes or in rows is dealt over all slots by id instead,
and by row where it repeats an id as often; there can be only
``2 * shards * GROUP_PARTS`` groups of either kind, a bound on what is broadcast.
Places in a shard come from counts of small parts of the slots, so no task sorts
a slot.

Defined results: a null text has no bytes and the checksum of no bytes; a null
id is a value like any other; repeated rows are separate records; an empty table
gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import materialize

#: Virtual slots; fixed for the life of a corpus.
SLOTS = 8192
#: Bytes counted for a record besides its text.
OVERHEAD = 16
#: A group of equal texts above 1/GROUP_PARTS of a shard's mean is dealt out.
GROUP_PARTS = 2
#: Parts of a slot, each of which a task numbers.
PARTS = 64
#: Rebalancing stops when the shards' bytes lie within this part of their mean.
TOLERANCE = 0.001


@dataclass
class SlotMap:
    """Version ``version`` of the map from slot to shard."""

    version: int
    shards: int
    owner: list[int] = field(repr=False)

    @classmethod
    def initial(cls, slots: int, shards: int) -> SlotMap:
        return cls(0, shards, [slot * shards // slots for slot in range(slots)])

    def grown(self) -> SlotMap:
        """One more shard, which takes an even share of every shard's slots; no other slot moves."""
        owner, kept = list(self.owner), [0] * self.shards
        have = [self.owner.count(s) for s in range(self.shards)]
        stay = [n - n // (self.shards + 1) for n in have]
        for slot, shard in enumerate(self.owner):
            kept[shard] += 1
            if kept[shard] > stay[shard]:
                owner[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, owner)

    def rebalanced(self, weight: dict[int, int], tolerance: float = TOLERANCE) -> SlotMap:
        """Move or swap slots between the heaviest and the lightest shard until they are near.

        ``weight`` gives the bytes of slots.  Each step takes the move, or else
        the exchange of two slots, that comes closest to half the gap; it ends
        when none narrows it.  Every step narrows a gap of whole bytes, so there
        is an end.  Ties go to the lower slot, so reruns agree.
        """
        owner = list(self.owner)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        total = [0] * self.shards
        for slot, shard in enumerate(owner):
            if bytes_ := weight.get(slot, 0):
                held[shard].append((bytes_, slot))
                total[shard] += bytes_
        for slots in held:
            slots.sort()
        mean = sum(total) / max(1, self.shards)
        high = [(-t, s) for s, t in enumerate(total)]
        low = [(t, s) for s, t in enumerate(total)]
        heapq.heapify(high)
        heapq.heapify(low)

        def move(item: tuple[int, int], source: int, target: int) -> None:
            del held[source][bisect_left(held[source], item)]
            insort(held[target], item)
            owner[item[1]] = target
            total[source] -= item[0]
            total[target] += item[0]

        while True:
            while -high[0][0] != total[high[0][1]]:
                heapq.heappop(high)
            while low[0][0] != total[low[0][1]]:
                heapq.heappop(low)
            top, bottom = high[0][1], low[0][1]
            gap = total[top] - total[bottom]
            if gap <= tolerance * mean or gap < 2:
                break
            best = None  # (distance to half the gap, slot given, slot taken)
            for item in _around(held[top], gap // 2):
                if item[0] < gap:
                    best = min(filter(None, (best, (abs(2 * item[0] - gap), item, None))), key=_rank)
            if best is None or best[0] > gap // 2:
                for item in held[top]:
                    for other in _around(held[bottom], item[0] - gap // 2):
                        if 0 < item[0] - other[0] < gap:
                            found = (abs(2 * (item[0] - other[0]) - gap), item, other)
                            best = min(filter(None, (best, found)), key=_rank)
            if best is None:
                break
            move(best[1], top, bottom)
            if best[2]:
                move(best[2], bottom, top)
            for shard in (top, bottom):
                heapq.heappush(high, (-total[shard], shard))
                heapq.heappush(low, (total[shard], shard))
        return SlotMap(self.version + 1, self.shards, owner)

    def table(self, spark: SparkSession) -> DataFrame:
        """The map as rows (version, slot, shard); its size is the number of slots."""
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones; saving it again changes nothing."""
        self.table(spark).coalesce(1).drop("version").write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> bool:
        """Whether any version is stored at ``path``."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        return files.exists(folder) and any(s.getPath().getName().startswith("version=") for s in files.listStatus(folder))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest unless one is named."""
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        owner = [r.shard for r in stored.where(F.col("version") == version).orderBy("slot").collect()]
        return cls(version, max(owner) + 1, owner)


def _around(items: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    at = bisect_left(items, (size, -1))
    return items[max(0, at - 1) : at + 1]


def _rank(found: tuple) -> tuple:
    return found[0], found[1][1], found[2][1] if found[2] else -1


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A small row per record: id, size, checksum, content hash and a number of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("content"),
        F.monotonically_increasing_id().alias("record"),
    )


def with_slots(light: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot`` and ``part``: of the content, or of the id or record in a group too large for one shard.

    ``light`` is read several times and so has to be a stored table of ``records``.
    """
    whole = light.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    most_bytes, most_rows = (max(1, n // (shards * GROUP_PARTS)) for n in (whole.bytes, whole.rows))

    def large(rows: DataFrame, keys: list[str], mark: str) -> DataFrame:
        """The groups above the limits, at most ``2 * shards * GROUP_PARTS``."""
        copies = F.count(F.lit(1))
        groups = rows.groupBy(*keys, "size").agg(copies.alias("copies"))
        above = (F.col("copies") * F.col("size") > most_bytes) | (F.col("copies") > most_rows)
        return F.broadcast(groups.where(above & (F.col("copies") > 1)).select(*keys, "size", F.lit(True).alias(mark)))

    by_text = light.join(large(light, ["content"], "dealt"), ["content", "size"], "left")
    # nulls are equal here: the key is the hash of the id
    keyed = by_text.withColumn("whose", F.xxhash64("content", "doc_id"))
    repeated = large(keyed.where("dealt"), ["whose"], "repeated")
    joined = keyed.join(repeated, ["whose", "size"], "left")
    by_record = F.xxhash64("whose", "record")
    place = F.when(F.col("repeated"), by_record).when(F.col("dealt"), F.col("whose")).otherwise(F.col("content"))
    part = F.when(F.col("repeated"), by_record).otherwise(F.col("whose"))
    return joined.withColumns(
        {
            "virtual_slot": F.pmod(place, F.lit(slots)).cast("int"),
            "part": F.pmod(F.xxhash64(F.lit("part"), part), F.lit(PARTS)).cast("int"),
        }
    ).drop("dealt", "repeated", "whose", "record")


def shard(
    docs: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    map_path: str | None = None,
    start: SlotMap | None = None,
) -> DataFrame:
    """Put every record of ``docs`` into a shard.

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version.  ``slot`` is the record's place in its shard,
    gapless from 0.  ``start`` is the map to edit, or else the latest version at
    ``map_path``, or else a fresh one; the edited version is stored beside it.
    """
    spark = docs.sparkSession
    light = materialize(with_slots(materialize(records(docs, id_col, text_col), "shard-records"), shards, slots), "shard-slots")
    counts = light.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts, "shard-counts")  # at most slots * PARTS rows
    totals = counts.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    if start is None and map_path and SlotMap.stored(spark, map_path):
        start = SlotMap.load(spark, map_path)
    before = start or SlotMap.initial(slots, shards)
    if (before.shards, len(before.owner)) != (shards, slots):
        raise ValueError(f"the map has {len(before.owner)} slots and {before.shards} shards, not {slots} and {shards}")
    after = before.rebalanced({r.virtual_slot: r.bytes for r in totals})
    if map_path:
        if not SlotMap.stored(spark, map_path):
            before.save(spark, map_path)
        after.save(spark, map_path)
    rows = {r.virtual_slot: r.rows for r in totals}
    base, filled = [], [0] * shards
    for slot, owner in enumerate(after.owner):
        base.append((slot, owner, filled[owner]))
        filled[owner] += rows.get(slot, 0)
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(places), "virtual_slot").select(  # one row a slot
        "virtual_slot", "part", "shard", (F.col("base") + F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("base")
    )
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "content")
    return light.join(offsets, ["virtual_slot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(after.version).alias("map_version"),
    )
