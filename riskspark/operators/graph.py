"""Graph operators over an edge table: connected components, expansion from roots, two-hop totals.

The graph is never collected. A hub may touch a third of all nodes, so no operator pairs the neighbours of a hub with
each other: components move minima along edges, and two-hop totals count nodes with the same hubs around them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.operators import snapshots
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

MAX_ROUNDS = 60
HUB_DEGREE = 10_000
#: Two-step paths that may be listed per edge, and sets that one task meets with the others of a hub.
PATHS_PER_EDGE = 64
SET_BLOCK = 1_000


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions; parallel edge types and loops collapse."""
    pairs = edges.where("src <> dst").select(
        F.stack(F.lit(2), F.col("src"), F.col("dst"), F.col("dst"), F.col("src")).alias("a", "b"))
    return pairs.distinct()


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): every node with the smallest node id it is connected to.

    Alternating large-star and small-star rounds. Each round takes one minimum per node (combined before the shuffle)
    and joins it back to the edges, hubs by a bounded broadcast, so no task holds all edges of a hub; the number of rounds grows with the logarithm of the longest chain. Each round is
    checkpointed to the shared folder, which keeps the plan short and survives the loss of executors.
    """
    checkpoint_dir(nodes.sparkSession)
    pairs = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of a node is linked to the smallest node near it.
        both = pairs.select(
            F.stack(F.lit(2), F.col("u"), F.col("v"), F.col("v"), F.col("u")).alias("x", "y"))
        smallest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
        large = with_groups(both.where("y > x"), smallest, ["x"], "n").select(
            F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_groups(large, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left").select(
        "node", F.coalesce("_root", "node").alias("component"))


def store_components(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """A new component table at `path`, dealt into parts by component; `grow_components` adds to it."""
    snapshots.write(components(nodes, edges), path, "component")


def stored_components(spark: SparkSession, path: str) -> DataFrame:
    """(node, component) as stored; every touched part has a row without a node, so that it is replaced even if it empties."""
    return spark.read.parquet(path).where(F.col("node").isNotNull()).select("node", "component")


def grow_components(path: str, nodes: DataFrame, edges: DataFrame) -> list[int]:
    """Adds new nodes and edges to the stored components and returns the parts that were rewritten.

    Both ends of a new edge become the component they are stored under, or themselves if they are new. Components are then
    found in this small graph alone, and only parts that hold a component that changed its name or gained nodes are written
    again. An increment that is repeated changes nothing.
    """
    spark = nodes.sparkSession
    checkpoint_dir(spark)
    fresh = nodes.select("node").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(fresh).distinct()
    known = stored_components(spark, path).join(ends, "node", "left_semi").withColumnRenamed("component", "_home").checkpoint()
    placed = ends.join(known, "node", "left").select("node", F.coalesce("_home", "node").alias("at"), F.col("_home").isNull().alias(
        "new")).checkpoint()
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("_n"))
    homes = degree.join(placed, "node")
    contracted = edges.select("src", "dst")
    for side in ("src", "dst"):
        other = "dst" if side == "src" else "src"
        at = homes.select(F.col("node").alias(side), F.col("at").alias("_at"), "_n")
        contracted = with_groups(contracted, at, [side], "_n").select(F.col(other), F.col("_at").alias(side))
    found = components(placed.select(F.col("at").alias("node")).distinct(), contracted.distinct()).checkpoint()
    changed = found.where("node <> component").unionByName(found.join(
        placed.where("new").select(F.col("at").alias("node")).distinct(), "node", "left_semi")).distinct()
    parts = changed.select(F.explode(F.array("node", "component")).alias("component")).select(
        snapshots.shard_of("component").alias("part")).distinct()
    touched = sorted(r.part for r in parts.collect())  # at most the number of parts
    if not touched:
        return []
    names = found.select(F.col("node").alias("component"), F.col("component").alias("_name"))
    old = spark.read.parquet(path).where(F.col(snapshots.SHARD).isin(touched) & F.col("node").isNotNull()).join(
        names, "component", "left").select("node", F.coalesce("_name", "component").alias("component"))
    added = placed.where("new").select("node", F.col("at").alias("component")).join(names, "component").select(
        "node", F.col("_name").alias("component"))
    rows = old.unionByName(added).withColumn(snapshots.SHARD, snapshots.shard_of("component"))
    marks = spark.createDataFrame([(None, None, t) for t in touched], f"node {_kind(rows)}, component {_kind(rows)}, shard int")
    rows.unionByName(marks).repartition(snapshots.SHARD).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(snapshots.SHARD).parquet(path)
    return touched


def _kind(rows: DataFrame) -> str:
    return rows.schema["node"].dataType.simpleString()


def expand(pairs: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop): every node within `hops` of each root with its distance, the root itself left out.

    Breadth-first from the given roots: each round joins the frontier to the edges once. Cost grows with what the
    roots reach, so give it the nodes someone asks about, not every node; `two_hop_totals` serves all roots.
    """
    reached = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(pairs, frontier["node"] == pairs["a"]).select(
            "root", F.col("b").alias("node")).distinct()
        frontier = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn(
            "hop", F.lit(hop))
        reached = reached.unionByName(frontier).checkpoint()
        frontier = reached.where(F.col("hop") == hop)
    return reached.where("hop > 0")


def light_degree(degrees: DataFrame, paths_per_edge: int = PATHS_PER_EDGE, most: int = HUB_DEGREE) -> DataFrame:
    """One row (bound): the degree up to which a node is light, at most `most`.

    Degrees are totalled in classes of powers of two, of which there are at most 64. Light are the classes that, from the
    smallest on, list at most `paths_per_edge` two-step paths for each edge of the graph.
    """
    classes = degrees.select(F.floor(F.log2("degree")).cast("int").alias("class"), F.col("degree").cast("double")).groupBy(
        "class").agg(F.sum(F.col("degree") * F.col("degree")).alias("paths"), F.sum("degree").alias("ends"))
    upto = Window.orderBy("class")
    fits = F.sum("paths").over(upto) <= paths_per_edge * F.sum("ends").over(Window.partitionBy())
    last = F.max(F.when(F.col("fits"), F.col("class")))
    return classes.select("class", fits.alias("fits")).agg(F.when(last.isNotNull(), F.least(
        F.lit(float(most)), F.pow(F.lit(2.0), last + 1) - 1)).otherwise(0.0).alias("bound"))


def shared_sets(members: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """(s, t): every two set names that share a member, each once and in both orders, from distinct rows (set, member).

    Sets with one member in common meet in a join on it. A member of many sets is cut into blocks of about `block` of them,
    so a task meets one block of a member's sets with all of them.
    """
    sizes = members.groupBy("member").agg(F.count("*").alias("_n")).withColumn(
        "_blocks", F.ceil(F.col("_n") / block).cast("int"))
    sized = with_groups(members, sizes, ["member"], "_n")
    left = sized.select("member", F.col("set").alias("s"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    right = sized.select("member", F.col("set").alias("t"), F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int").alias("_b"))
    return left.join(right, ["member", "_b"]).select("s", "t").distinct()


def two_hop_totals(pairs: DataFrame, weights: DataFrame, roots: DataFrame, hub_degree: int | None = None) -> DataFrame:
    """Per root the totals of node weights over all distinct nodes within two hops, the root left out.

    `pairs` is undirected, `weights` holds node and numeric weight columns, `roots` holds root. Two nodes are within two hops
    if their neighbourhoods, each with the node itself, share a node. Nodes above `hub_degree` (default: `light_degree`)
    are hubs, and the two ways to share one are counted apart:
    * paths through light nodes are listed, `PATHS_PER_EDGE` for each edge at most;
    * nodes with the same hubs around them are one set, named by a 128-bit hash and held as rows (set, hub). Their
      weights are added up once per set, and a root takes the totals of all sets that share a hub with its own. Members
      of a clique or leaves of a star are one set, so no hub's neighbours are paired with each other;
    * a listed node whose set shares a hub with the root's is left out, as it is in these totals.
    A root without neighbours or weights has zeros.
    """
    names = [c for c in weights.columns if c != "node"]
    degrees = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    bound = light_degree(degrees) if hub_degree is None else degrees.sparkSession.range(1).select(
        F.lit(float(hub_degree)).alias("bound"))
    checkpoint_dir(pairs.sparkSession)
    sized = degrees.crossJoin(F.broadcast(bound)).checkpoint()
    hubs = sized.where("degree > bound").select(F.col("a").alias("hub"), "degree")
    light = sized.where("degree <= bound").select(F.col("a").alias("mid"))

    # From a light node to its neighbours and itself; a root that is light is the middle of its own first hop.
    some = not hubs.isEmpty()
    closed = (pairs.join(light, pairs["a"] == light["mid"], "left_semi") if some else pairs).select("a", "b").unionByName(
        light.select(F.col("mid").alias("a"), F.col("mid").alias("b")))
    first = closed.join(roots.select(F.col("root").alias("b")), "b", "left_semi").select(
        F.col("b").alias("root"), F.col("a").alias("mid"))
    listed = first.join(closed, first["mid"] == closed["a"]).select("root", F.col("b").alias("node")).where(
        "root <> node").distinct()
    if not some:
        kept = listed.join(weights, "node").groupBy("root").agg(*[F.sum(n).alias(n) for n in names])
        return roots.join(kept, "root", "left").select("root", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])

    around = with_groups(pairs.select(F.col("a").alias("node"), F.col("b").alias("hub")), hubs, ["hub"], "degree").select(
        "node", "hub").unionByName(hubs.select(F.col("hub").alias("node"), "hub"))
    # Counts and exclusive ors of hashes name a set whatever its order, combined before the shuffle and without an array.
    set_of = around.groupBy("node").agg(F.concat_ws(
        ":", F.count("*"), F.bit_xor(F.xxhash64("hub")), F.bit_xor(F.xxhash64(F.lit(1), "hub"))).alias("set")).checkpoint()
    of_set = set_of.groupBy("set").agg(F.min("node").alias("node"))
    linked = shared_sets(around.join(of_set, "node").select("set", F.col("hub").alias("member"))).checkpoint()
    per_set = weights.join(set_of, "node").groupBy("set").agg(*[F.sum(n).alias(n) for n in names])
    reached = linked.join(per_set.withColumnRenamed("set", "t"), "t").groupBy("s").agg(
        *[F.sum(n).alias(f"hub_{n}") for n in names])
    own = weights.select(F.col("node").alias("root"), *[F.col(n).alias(f"own_{n}") for n in names])
    placed = roots.select("root").distinct().join(
        set_of.select(F.col("node").alias("root"), F.col("set").alias("s")), "root", "left")
    from_hubs = placed.join(reached, "s").join(own, "root", "left").select(
        "root", *[(F.col(f"hub_{n}") - F.coalesce(f"own_{n}", F.lit(0))).alias(f"hub_{n}") for n in names])
    both = listed.join(placed, "root", "left").join(
        set_of.select("node", F.col("set").alias("t")), "node", "left")
    apart = both.join(linked, ["s", "t"], "left_anti").select("root", "node")
    kept = apart.join(weights, "node").groupBy("root").agg(*[F.sum(n).alias(n) for n in names])
    return roots.join(kept, "root", "left").join(from_hubs, "root", "left").select(
        "root", *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"hub_{n}", F.lit(0))).alias(n) for n in names])
