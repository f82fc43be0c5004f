"""Sharding by fixed virtual slots; DataFrame functions only.

Records hash into a fixed number of virtual slots by their text, so equal texts lie together. The bytes of
each slot are summed, and a versioned map gives each slot its shard. Version 0 deals slots out in turn;
rebalancing edits it into the next version: slots stay where they are while their shard is below an even
share, and the rest go, largest first, to the shard with the least. Only a text whose copies outweigh a whole
share, and so fit no shard, is split by document first; whatever else is in its slot stays together by text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spectroloom.llm.common import checkpointed

#: Virtual slots.
SLOTS = 4096
#: A slot whose texts together outweigh this part of a share is split by text, and a text too heavy for a shard by document, into parts of a quarter of that.
PART = 0.5
#: Cells of a shard's documents in which places are numbered.
CELLS = 1024


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map ``(version, slot, shard)``."""
    return spark.range(n_slots).select(F.lit(0).alias("version"), F.col("id").alias("slot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard"))


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the map under ``path``; none if nothing is stored there."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise
    return sorted(r["version"] for r in stored.select("version").distinct().collect())


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to those under ``path``; earlier versions stay, and one that exists is refused.

    An empty map adds nothing; a map of several versions is refused as well.
    """
    new = [r["version"] for r in slot_map.select("version").distinct().limit(2).collect()]
    if len(new) > 1:
        raise ValueError("a map has one version")
    if set(new) & set(stored_versions(slot_map.sparkSession, path)):
        raise ValueError(f"version {new[0]} is stored under {path} already")
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the last by default."""
    versions = spark.read.parquet(path)
    at = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.where(F.col("version") == at).select(F.col("version").cast("int").alias("version"), "slot", "shard")


def _loads(n_shards: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n_shards)


def _put(loads: Column, shard: Column, size: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + size).otherwise(x))


def _least(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def rebalance(slot_map: DataFrame, slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for slots of ``slot_bytes(slot, bytes)``, with few slots moved.

    Works on one array of all slots, whose number is fixed however many records there are. Slots that the
    map does not know (parts of split slots, or those of shards that are gone) go to the shard with the least.
    Slots without bytes, or with null ones, weigh nothing; ties go to the smaller slot and shard; an empty
    map and an empty table give an empty version 0. Both tables have a slot once.
    """
    slots = slot_bytes.join(slot_map, "slot", "full").select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "shard", F.max("version").over(W.partitionBy()).alias("version"))
    item = F.struct((-F.col("bytes")).alias("order"), "slot", "bytes", F.when(F.col("shard") < n_shards, F.col("shard")).alias("shard"))
    one = slots.agg(F.array_sort(F.collect_list(item)).alias("slots"), F.sum("bytes").alias("total"), (F.coalesce(F.max("version"), F.lit(-1)) + 1).alias("version"))
    share = F.ceil(F.col("total") / n_shards)
    # Decisions are noted in a string, which grows without copying what it holds as an array's elements would be.
    note = lambda acc, shard: F.concat(acc["notes"], shard.cast("string"), F.lit(","))
    start = F.struct(_loads(n_shards).alias("loads"), F.lit("").alias("notes"))

    def keep(acc: Column, x: Column) -> Column:
        shard = F.coalesce(x["shard"], _least(acc["loads"]))
        stays = F.get(acc["loads"], shard) + x["bytes"] <= share
        return F.struct(F.when(stays, _put(acc["loads"], shard, x["bytes"])).otherwise(acc["loads"]).alias("loads"), note(acc, F.when(stays, shard).otherwise(-1)).alias("notes"))

    def place(acc: Column, x: Column) -> Column:
        shard = _least(acc["loads"])
        return F.struct(_put(acc["loads"], shard, x["bytes"]).alias("loads"), note(acc, shard).alias("notes"))

    noted = lambda slots, notes: F.zip_with(slots, F.split(notes, ","), lambda s, n: F.when(s.isNotNull(), F.struct(s["slot"].alias("slot"), s["bytes"].alias("bytes"), n.cast("int").alias("shard"))))
    kept = one.withColumn("k", F.aggregate("slots", start, keep)).select("version", F.filter(noted(F.col("slots"), F.col("k.notes")), lambda s: s.isNotNull()).alias("slots"), F.col("k.loads").alias("loads"))
    kept = kept.withColumns({"pool": F.filter("slots", lambda s: s["shard"] < 0), "slots": F.filter("slots", lambda s: s["shard"] >= 0)})
    placed = kept.withColumn("p", F.aggregate("pool", F.struct(F.col("loads").alias("loads"), F.lit("").alias("notes")), place)["notes"])
    placed = placed.withColumn("pool", F.filter(noted(F.col("pool"), F.col("p")), lambda s: s.isNotNull()))
    return placed.select("version", F.explode(F.concat("slots", "pool")).alias("s")).select("version", "s.slot", "s.shard")


def slot_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int = 8, n_slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, n, virtual_slot, cell)`` of every document, equal rows together as ``n``.

    Documents of one text share a virtual slot, unless they outweigh a shard's whole share together: such a
    text has slots of its own, which its documents are dealt over by id, and copies of a row one by one. A slot
    whose other texts are too heavy is split by text. Null texts count as empty; null ids are kept. Cells only
    spread the numbering of places. All of it is a function of what a row holds, not of where it lies.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.xxhash64(body).alias("h"))
    rows = checkpointed(rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n")))
    weight = F.sum(F.col("size") * F.col("n"))
    share = (rows.agg(weight.alias("bytes")).first()["bytes"] or 0) / n_shards
    part = F.lit(PART * share / 4)
    heavy = rows.groupBy("h").agg(weight.alias("bytes")).where(F.col("bytes") > share)  # n_shards rows at most
    heavy = heavy.select("h", F.ceil(F.col("bytes") / part).alias("parts"))
    heavy = checkpointed(heavy.withColumn("nth", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("h"))))
    rows = rows.join(F.broadcast(heavy), "h", "left").withColumn("first_slot", F.pmod("h", F.lit(n_slots)))
    others = rows.where("parts is null").groupBy("first_slot").agg(weight.alias("slot_bytes"))
    split = others.where(F.col("slot_bytes") > PART * share).select("first_slot", F.ceil(F.col("slot_bytes") / part).alias("text_parts"))
    rows = rows.join(F.broadcast(split), "first_slot", "left")  # at most one row for each of the fixed slots
    pieces = F.coalesce(F.least("n", "parts"), F.lit(1)).cast("int")
    rows = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.withColumn("n", F.floor(F.col("n") / F.col("pieces")) + (F.col("piece") < F.col("n") % F.col("pieces")).cast("long"))
    own = F.xxhash64("doc_id", "h", "piece")
    by_text = F.coalesce(F.pmod(F.xxhash64("h"), "text_parts"), F.lit(0))
    by_row = F.lit(1 << 20) * F.col("nth") + F.pmod(F.shiftrightunsigned(own, 10), "parts")
    return rows.select("doc_id", "size", "text_crc32", "n", (F.col("first_slot") + n_slots * F.coalesce(by_row, by_text)).alias("virtual_slot"), F.pmod(own, F.lit(CELLS)).cast("int").alias("cell"))


def assign_shards(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text", n_slots: int = SLOTS, slot_map: DataFrame | None = None, map_path: str | None = None) -> DataFrame:
    """One row per document: its shard, by near-equal bytes, and its place there.

    The size is the text's UTF-8 bytes and 1; null texts count as empty. ``slot`` numbers the documents of
    a shard from 0 without gaps. Equal texts share a shard unless they outweigh an even share.
    Null and repeated ids are allowed: every row is placed. ``slot_map`` is the version to edit; without
    one, the last one stored under ``map_path``, or version 0. With ``map_path`` the version edited, if
    it is new, and its successor are stored there.
    """
    spark = docs.sparkSession
    rows = checkpointed(slot_records(docs, doc_id, text, n_shards, n_slots))
    stored = stored_versions(spark, map_path) if map_path else []
    before = slot_map if slot_map is not None else load_map(spark, map_path) if stored else initial_map(spark, n_shards, n_slots)
    if map_path and not stored:
        save_map(before, map_path)
    edited = checkpointed(rebalance(before, rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), n_shards))
    if map_path:
        save_map(edited, map_path)
    placed = rows.join(F.broadcast(edited.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")  # a row for each virtual slot: a fixed number
    cells = placed.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    start = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    starts = F.broadcast(cells.select("shard", "cell", start.alias("start")))  # CELLS rows a shard
    in_cell = W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "virtual_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.withColumn("within", F.sum("n").over(in_cell) - F.col("n")).join(starts, ["shard", "cell"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within") + F.col("copy")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
