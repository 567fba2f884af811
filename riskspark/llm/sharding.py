"""Sharding by proportional stratified interleaving.

Within each source, documents are ranked in a seeded random order. A document's place in the whole is its fractional rank
(rank + u) / n, with n the documents of its source and u in [0, 1) drawn per source, so that sources of one size don't
meet at the same places. Sorted by place, every stretch of the order holds each source in proportion, to within one
document; cutting it evenly gives shards that match the mixture and whose counts are at most one apart.

DataFrame functions only; texts are read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.slices import running
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

OVERHEAD = 16


def seeded(text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def interleave(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) per row.

    Order: the place, then source (null first), doc_id (null first), size and checksum. A null source is a source of its
    own; a null or empty text has size OVERHEAD and checksum 0. Rows that repeat all of these are interchangeable and get
    places of their own, next to each other. Extra columns are left out. Fewer rows than shards leave shards empty.
    Ranks are exact and found in slices, so a source of any size is spread over tasks.
    """
    checkpoint_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    draw = seeded(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32")), seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("draw", draw).checkpoint()
    order = ["doc_id", "size", "text_crc32"]
    ranked = running(rows, ["source"], "draw", order, {"rank": F.lit(1)}).checkpoint()
    # The last rank of a source tells its size; a window over it would gather the source.
    sizes = rows.groupBy(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none")).agg(
        F.count("*").alias("n"))
    keyed = ranked.withColumns({"k": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    phase = seeded(F.coalesce(F.concat(F.lit("source:"), F.col("source")), F.lit("null")), seed)
    placed = with_groups(keyed, sizes, ["k", "none"], "n").select(
        *rows.columns, ((F.col("rank") + phase) / F.col("n")).alias("place"))
    ordered = running(placed, [], "place", ["source", *order], {"at": F.lit(1)}).checkpoint()
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    ordered = ordered.join(total).withColumn("shard", F.expr(f"at * {shards} div total"))
    return ordered.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                          F.expr(f"at - (shard * total + {shards - 1}) div {shards}").alias("slot"))
