"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: each source gets its weight's share of the mix, but no more than `most` times its own words; what is cut off is
shared out again by weight. The mix is made of blocks of `block_tokens` words. Blocks go to sources by highest quotients
target / (2 k + 1), and since that method only ever adds seats as the house grows, the blocks of shard after shard are the
differences of apportionments of growing houses: integer quotas per shard that add up to the whole. A source's blocks are
cut from its documents in a seeded order, repeated from the start where the quota asks for more than there is, and each
shard takes its quota of them in turn; so all documents but one per source are taken a whole number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.sharding import seeded
from riskspark.llm.slices import running
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds weight and target to (k, none, source_size): one row per source, `none` marks the null source, which is last.

    Sources in code point order take the weights in turn. Sorted by the level at which a source is full, the common level
    is that of the first source that stays below it. The windows run over sources, not documents.
    """
    order = Window.orderBy("none", "k")
    level = Window.orderBy("full", "none", "k")
    ahead = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(0, Window.unboundedFollowing)
    numbered = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    total = F.broadcast(sources.agg(F.sum("source_size").alias("all_size")))
    filled = numbered.join(total).withColumn("full", F.col("source_size") * most / F.col("weight")).withColumn(
        "level", (F.col("all_size") * share - F.coalesce(F.sum(F.col("source_size") * most).over(ahead), F.lit(0.0)))
        / F.sum("weight").over(rest))
    common = F.broadcast(filled.where("full > level").agg(F.min_by("level", F.struct("full", "none", "k")).alias("common")))
    return filled.join(common).select(
        "k", "none", "rank", "source_size", "weight",
        F.least(F.col("source_size") * most, F.coalesce(F.col("common") * F.col("weight"), F.lit(float("inf")))).alias(
            "target"))


def quotas(aimed: DataFrame, block_tokens: int, shards: int) -> DataFrame:
    """(k, none, shard, blocks): the blocks of each source in each shard, by Sainte-Laguë; equal quotients go to the
    source that is first in order.

    With Q seats, n sources and T the total of the targets, no source gets fewer seats than round(target * (Q - n/2) / T)
    or more than round(target * (Q + n/2) / T). So only the seats between, about two per source, are ranked.
    """
    sums = F.broadcast(aimed.agg(F.sum("target").alias("all_target"), F.count("*").alias("n")))
    houses = aimed.join(sums).select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("house")).withColumn(
        "seats", F.floor(F.round(F.col("all_target") / block_tokens) * F.col("house") / shards))
    exact = lambda seats: F.floor(F.col("target") * seats / F.col("all_target") + 0.5)
    bounded = houses.where("all_target > 0").withColumns({
        "least": F.greatest(F.lit(0), exact(F.col("seats") - F.col("n") / 2) - 1),
        "largest": exact(F.col("seats") + F.col("n") / 2) + 1})
    left = bounded.groupBy("house").agg((F.max("seats") - F.sum("least")).alias("left"))
    ranked = bounded.select("k", "none", "house", "rank", "target", F.explode(F.sequence("least", "largest")).alias("seat"))
    ranked = ranked.withColumn("place", F.row_number().over(
        Window.partitionBy("house").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), "rank", "seat")))
    won = ranked.join(F.broadcast(left), "house").where("place <= left").groupBy("k", "none", "house").agg(
        F.count("*").alias("won"))
    held = bounded.select("k", "none", "house", "least").join(won, ["k", "none", "house"], "left").withColumn(
        "held", F.col("least") + F.coalesce("won", F.lit(0)))
    before = F.lag("held", 1, 0).over(Window.partitionBy("none", "k").orderBy("house"))
    return held.select("k", "none", (F.col("house") - 1).alias("shard"), (F.col("held") - before).alias("blocks"))


def shard_runs(quota: DataFrame, block_tokens: int, most: float) -> DataFrame:
    """(k, none, runs): of each source the stretch of its repeated words that each shard takes, as an array of shard, first
    and end. `quota` holds the rows of `quotas` with source_size; no source gives more than `most` times its words."""
    upto = Window.partitionBy("none", "k").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.least(F.sum("blocks").over(upto) * block_tokens, F.floor(F.col("source_size") * most)).cast("long")
    ends = quota.select("k", "none", F.col("shard").cast("int").alias("shard"), end.alias("end"))
    first = F.lag("end", 1, 0).over(Window.partitionBy("none", "k").orderBy("shard"))
    return ends.select("k", "none", "shard", first.alias("first"), "end").groupBy("k", "none").agg(
        F.array_sort(F.collect_list(F.struct("shard", "first", "end"))).alias("runs"))


def _placed(docs: DataFrame, weights: list[float], share: float, most: float, block_tokens: int, shards: int,
            seed: int) -> DataFrame:
    """doc_id, source, size, the place `offset` of its first word among the words of its source in the seeded order, and of
    its source the size, the target, the `words` taken and the runs of the shards."""
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size")).withColumns({
            "k": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(),
            "draw": seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)}).checkpoint()
    sources = rows.groupBy("k", "none").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(sources.select("k", "none", "source_size"), weights, share, most).checkpoint()
    quota = quotas(aimed, block_tokens, shards).join(aimed.select("k", "none", "source_size"), ["k", "none"])
    per_source = sources.join(aimed.drop("source_size"), ["k", "none"]).join(
        shard_runs(quota, block_tokens, most), ["k", "none"], "left").select(
        "k", "none", "source_size", "n", "target", "runs",
        F.coalesce(F.array_max("runs.end"), F.lit(0).cast("long")).alias("words"))
    ordered = running(rows, ["source"], "draw", ["doc_id", "size"], {"offset": F.col("size")})
    return with_groups(ordered, per_source.checkpoint(), ["k", "none"], "n")


def mix(docs: DataFrame, weights: list[float], share: float, most: float = 2.0, block_tokens: int = 32, shards: int = 8,
        seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row: `taken` words of the document are in the mix.

    A null or empty text has size 0 and is taken 0 times; a null source is a source, the last. Rows that repeat doc_id,
    source and size are interchangeable, each has its own place. Reruns agree, as the order depends on the seed and the
    rows alone. A source's taken words differ from its target by less than two blocks. Extra columns are left out.
    """
    placed = _placed(docs, weights, share, most, block_tokens, shards, seed)
    part = F.least(F.greatest(F.expr("words % source_size") - F.col("offset"), F.lit(0)), F.col("size"))
    taken = F.when(F.col("size") > 0, F.expr("words div source_size") * F.col("size") + part).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def sharded(docs: DataFrame, weights: list[float], share: float, most: float = 2.0, block_tokens: int = 32,
            shards: int = 8, seed: int = 42) -> DataFrame:
    """The rows of `mix` with `stretches`: which shard takes which words of the document, by shard, then repetition, as an
    array of shard, start (words of the document before the first one taken) and words.

    Shard after shard takes as many blocks of a source as its quota says, in the seeded order of the source's documents and
    again from the start where they end; `taken` is the total over the shards. A shard's words of a source equal its quota
    in words, but where the limit of `most` cuts the last block. Defined as in `mix`; without words there is no stretch.
    """
    placed = _placed(docs, weights, share, most, block_tokens, shards, seed)
    stretches = F.expr("""array_sort(filter(flatten(transform(sequence(0L, words div source_size), again ->
        transform(coalesce(runs, array()), run -> named_struct(
            'shard', run.shard, 'again', again,
            'start', greatest(run.first - again * source_size - offset, 0L),
            'words', least(run.end - again * source_size - offset, size)
                - greatest(run.first - again * source_size - offset, 0L))))), s -> s.words > 0))""")
    found = placed.withColumn("stretches", F.when(F.col("size") > 0, stretches)).withColumn(
        "stretches", F.expr("transform(stretches, s -> named_struct('shard', s.shard, 'start', s.start, 'words', s.words))"))
    taken = F.coalesce(F.expr("aggregate(stretches.words, 0L, (a, n) -> a + n)"), F.lit(0).cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.coalesce(
        "stretches", F.array().cast("array<struct<shard: int, start: bigint, words: bigint>>")).alias("stretches"))


def copies(docs: DataFrame, weights: list[float], share: float, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them: a document that a cut goes through, at most one per
    source, counts as often as its nearest whole number (a half: once more). Rows that repeat doc_id, source and size are
    taken the same number of times in all, spread over them in no set order. A document without words is not taken."""
    taken = mix(docs, weights, share, most, seed=seed).where("taken > 0").select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_k"), F.col("source").isNull().alias("_n"), F.col("size").alias("_size"),
        F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_times"))
    counts = taken.groupBy("_id", "_none", "_k", "_n", "_size").agg(F.sum("_times").alias("_times"))
    keys = ["_id", "_none", "_k", "_n", "_size"]
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_k"),
        F.col("source").isNull().alias("_n"), word_count(F.col("text")).alias("_size"))
    joined = keyed.join(counts, keys)
    among = Window.partitionBy(*keys)
    nth = F.row_number().over(among.orderBy(F.col("_row.text"))) - 1
    n = F.count("*").over(among)
    times = F.expr("_times div _of") + F.when(F.col("_nth") < F.expr("_times % _of"), 1).otherwise(0)
    return joined.withColumns({"_nth": nth, "_of": n}).where("_times > 0").withColumn("_t", times).where("_t > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int")))).select("_row.*")
