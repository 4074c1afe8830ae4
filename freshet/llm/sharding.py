"""Contiguous byte-balanced shards from global prefix sums. DataFrame functions only.

Rows are put in the order of their text's checksum and size, then of doc_id, by a range partitioning;
each partition numbers its own rows and bytes,
and the running totals of the partitions before it (one row per partition) turn these into global
positions. A row belongs to the shard in which the middle of its bytes falls, so every cut lies
within half a document of its equal target. Law: `bytes`. Only ids, sizes and checksums are moved,
never texts. Equal texts follow each other, so at most shards - 1 groups of them are cut, at a shard's
end; a group larger than a shard could not stay whole under this law.

Cases: a null or empty text has size 1 and checksum 0; null ids come first among equal texts; repeated rows each get a
slot; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import materialize, table


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot (its place in the shard, from 0)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    sized = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    order = ["text_crc32", "size", "key"]
    ranged = sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "shard")  # the parts must not be dealt anew between the two uses below
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(*order)
    start = F.col("part_start") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # one row of offsets per range partition: its number is bounded by spark.sql.shuffle.partitions
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("start", start).select(
        "part", *order,
        F.expr(f"((2 * start + size) * {shards}) div (2 * total)").cast("int").alias("shard"),
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("part", "shard").orderBy(*order)
    return placed.withColumn("row", F.row_number().over(within)).join(F.broadcast(firsts), ["shard", "part"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("row") - 1).cast("long").alias("slot")
    )


def op2_prefix_shards(spark, sf_dir) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
