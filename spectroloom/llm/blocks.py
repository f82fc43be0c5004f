"""Comparing the members of buckets in bounded blocks, however large a bucket is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Rows of ``members`` for every pair of blocks of their bucket, pairs of blocks lying together.

    A bucket of one member gives no row, a bucket of up to ``size`` is one block, and a larger one is split
    by a hash of the member into blocks of about ``size``, whose rows go to each pair of blocks they are
    in. Adds ``lo``, ``hi`` (the blocks of a pair) and ``own`` (the row's block).
    """
    counts = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.ceil(F.col("n") / size).cast("int").alias("n_blocks"))
    rows = members.join(counts, key).withColumn("own", F.pmod(F.xxhash64(member), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "n_blocks")
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", member)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, across the borders of batches."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for at in range(len(rows)):
            if rows[at] != before:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, before = [], at, rows[at]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def bulk_blocks(members: DataFrame, key: str, group: str, member: str, size: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Blocks in which every two members of a bucket from different groups meet, leaving out its largest group's own pairs.

    Members outside the bucket's largest group ask (``asks``), in blocks ``query``; all members are told
    (``tells``), in blocks ``target``. A row goes to as many blocks as the other side has, and once where it
    both asks and is told, so no task holds more than about two blocks and no pair within the largest group
    is looked at. Buckets of one group give no row.
    Blocks have about ``size`` members, and about ``most`` of their ``weight`` in sum, if that is given.
    """
    load = F.sum(weight) / most if weight else F.lit(0.0)
    sizes = members.groupBy(key, group).agg(F.count("*").alias("n"), load.alias("load"))
    sizes = sizes.groupBy(key).agg(F.sum("n").alias("all"), F.sum("load").alias("load"), F.max(F.struct("n", F.col(group).alias("g"), "load")).alias("bulk")).where(F.col("all") > F.col("bulk.n"))
    blocks = F.ceil(F.greatest(F.col("all") / size, "load")).cast("int"), F.ceil(F.greatest((F.col("all") - F.col("bulk.n")) / size, F.col("load") - F.col("bulk.load"))).cast("int")
    rows = members.join(sizes.select(key, F.col("bulk.g").alias("bulk"), blocks[0].alias("targets"), blocks[1].alias("queries")), key)
    own = {n: F.pmod(F.xxhash64(member), F.col(n)).cast("int") for n in ("targets", "queries")}
    every = {n: F.sequence(F.lit(0), F.col(n) - 1) for n in own}
    in_bulk = F.col(group) == F.col("bulk")
    told = F.transform(every["queries"], lambda q: F.struct((~in_bulk & (q == own["queries"])).alias("asks"), F.lit(True).alias("tells"), own["targets"].alias("target"), q.alias("query")))
    others = F.filter(every["targets"], lambda t: t != own["targets"])
    asked = F.transform(others, lambda t: F.struct(F.lit(True).alias("asks"), F.lit(False).alias("tells"), t.alias("target"), own["queries"].alias("query")))
    spread = F.when(in_bulk, told).otherwise(F.concat(told, asked))
    rows = rows.withColumn("at", F.explode(spread)).select(*members.columns, in_bulk.alias("in_bulk"), "at.asks", "at.tells", "at.target", "at.query")
    return rows.repartition(key, "target", "query").sortWithinPartitions(key, "target", "query", "asks", member)
