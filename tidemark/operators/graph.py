"""Relation and lock graphs: path confidence, one-hop expansion, root blockers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import settled
from tidemark.sources.tables import table


def waits(orders: DataFrame) -> DataFrame:
    """Locks between customers: each customer's order blocks the customer of the next order of the same day and priority."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderdate", "o_orderpriority").orderBy("o_orderkey")
    e = orders.select(F.col("o_custkey").alias("blocker"), F.lead("o_custkey").over(w).alias("blocked"))
    return e.filter("blocked is not null and blocker <> blocked").distinct()


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node, depth): nodes other than the root that it reaches, at their least depth.

    Breadth first: each round joins only the new frontier, less what is already reached, until nothing is new; cycles
    end by that.
    """
    edges = settled(edges)
    seen = frontier = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    while not frontier.isEmpty():
        nxt = frontier.join(edges, frontier.node == edges.blocker).select("root", F.col("blocked").alias("node"), F.col("depth") + 1).distinct().toDF("root", "node", "depth")
        frontier = settled(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def _on_ways(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges in and out, all others taken off again and again."""
    n, left = -1, edges.count()
    while left != n:
        starts, ends = edges.select(F.col("blocker").alias("node")).distinct(), edges.select(F.col("blocked").alias("node")).distinct()
        edges = settled(edges.join(ends, F.col("blocker") == F.col("node"), "left_semi").join(starts, F.col("blocked") == F.col("node"), "left_semi"))
        n, left = left, edges.count()
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes of edges (blocker, blocked) by the largest of all that reach a node and that it reaches too.

    The largest node that reaches a node colours it, round by round; what reaches a colour's own node within the colour
    is its component. What is left goes on within its colours, until no edge is left on a way round.
    """
    nodes = edges.select(F.explode(F.array("blocker", "blocked")).alias("node")).distinct()
    found = edges.select(F.col("blocker").alias("node"), F.col("blocker").alias("component")).limit(0)
    left = _on_ways(edges)
    while not left.isEmpty():
        colours = settled(left.select(F.col("blocker").alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("new")))
        while not (changed := colours.filter("new")).isEmpty():
            told = changed.join(left, F.col("node") == F.col("blocker")).groupBy(F.col("blocked").alias("node")).agg(F.max("colour").alias("told"))
            colours = settled(colours.join(told, "node", "left").select("node", F.greatest("colour", "told").alias("colour"), F.coalesce(F.col("told") > F.col("colour"), F.lit(False)).alias("new")))
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        left = settled(left.join(of("blocker"), "blocker").join(of("blocked"), "blocked").filter("blocker_colour = blocked_colour").select("blocker", "blocked", F.col("blocker_colour").alias("colour")))
        seen = frontier = colours.filter("node = colour").select("node", "colour")
        while not frontier.isEmpty():
            nxt = frontier.select("node").join(left, F.col("node") == F.col("blocked")).select(F.col("blocker").alias("node"), "colour").distinct()
            frontier = settled(nxt.join(seen.select("node"), "node", "left_anti"))
            seen = seen.unionByName(frontier)
        seen = settled(seen)
        found = found.unionByName(seen.withColumnRenamed("colour", "component"))
        gone = seen.select(F.col("node").alias("gone"))
        left = _on_ways(settled(left.select("blocker", "blocked").join(gone, F.col("blocker") == F.col("gone"), "left_anti").join(gone, F.col("blocked") == F.col("gone"), "left_anti")))
    return settled(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, n): how many nodes other than itself each start (node) reaches; 0 where there are none.

    Nodes that reach each other are one, and all that the largest of these reaches is counted once for whoever reaches
    it, so pairs of a start and a node are made only for what lies beside.
    """
    whole = components(edges)
    sizes = settled(whole.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    of = lambda end: whole.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    steps = settled(edges.join(of("blocker"), "blocker").join(of("blocked"), "blocked").filter("blocker_in <> blocked_in").select(F.col("blocker_in").alias("blocker"), F.col("blocked_in").alias("blocked")).distinct())
    roots = settled(start.select(F.col("node").alias("root")).join(whole, F.col("root") == F.col("node")).select("root", F.col("component").alias("node")))
    hub = settled(sizes.orderBy(F.desc("size"), "component").limit(1).select(F.col("component").alias("node")))
    below = settled(reach(steps, hub).select("node").unionByName(hub))
    above = settled(reach(steps.select(F.col("blocked").alias("blocker"), F.col("blocker").alias("blocked")), hub).select("node").unionByName(hub))
    starts = roots.select("node").distinct()
    # A way from above the hub to a node that isn't below it never passes what is below; what isn't above leads to nothing above.
    beside = reach(steps.join(below, F.col("blocked") == F.col("node"), "left_anti"), starts.join(above, "node", "left_semi"))
    beside = beside.unionByName(reach(steps.join(above, F.col("blocker") == F.col("node"), "left_anti"), starts.join(above, "node", "left_anti")))
    beside = beside.join(sizes, F.col("node") == F.col("component")).groupBy(F.col("root").alias("node")).agg(F.sum("size").alias("beside"))
    under = below.join(sizes, F.col("node") == F.col("component")).agg(F.sum("size").alias("under"))
    under = above.crossJoin(under).join(hub.withColumn("hub", F.lit(True)), "node", "left")
    every = roots.join(sizes, F.col("node") == F.col("component")).join(beside, "node", "left").join(under, "node", "left")
    own = F.when(F.col("hub"), 0).otherwise(F.col("size"))  # the hub is below itself
    return every.select("root", (own + F.coalesce("under", F.lit(0)) + F.coalesce("beside", F.lit(0)) - 1).alias("n"))


def lock_roots(edges: DataFrame) -> DataFrame:
    """Blockers that nobody blocks, and how many others wait on them, however far down; all blockers where each is blocked."""
    edges = settled(edges.select("blocker", "blocked").dropna())
    blockers = edges.select(F.col("blocker").alias("node")).distinct()
    roots = settled(blockers.join(edges, F.col("node") == F.col("blocked"), "left_anti"))
    if roots.isEmpty():
        roots = settled(blockers)
    # A single root needs no components.
    waiting = reached(edges, roots) if roots.count() > 1 else reach(edges, roots).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return roots.select(F.col("node").alias("root")).join(waiting, "root", "left").select("root", F.coalesce("n", F.lit(0)).cast("long").alias("affected"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds and their neighbours by either direction; tier 0 for seeds, 1 for what is added."""
    both = edges.select(F.col("blocker").alias("a"), F.col("blocked").alias("b")).unionByName(edges.select(F.col("blocked").alias("a"), F.col("blocker").alias("b")))
    new = both.join(seeds, both.a == seeds.node, "left_semi").select(F.col("b").alias("node")).distinct().join(seeds, "node", "left_anti")
    return seeds.select("node", F.lit(0).alias("tier")).unionByName(new.withColumn("tier", F.lit(1)))


def blocked_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("blocked").alias("blocked"), F.count_distinct("blocker").alias("blockers"))


def supply_paths(lineitem: DataFrame) -> DataFrame:
    """Confidence of supplier-to-part links: the share of a supplier's lines; two-step paths between suppliers through a part keep the lesser of both, less 0.05, and no less than 0."""
    n = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    total = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"))
    e = n.join(total, "l_suppkey").select("l_suppkey", "l_partkey", (F.col("n") / F.col("total")).alias("conf"))
    a, b = e.alias("a"), e.alias("b")
    met = a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    conf = F.floor(F.greatest(F.max(F.least("a.conf", "b.conf")) - 0.05, F.lit(0.0)) * 100 + 0.5) / 100
    return met.groupBy(F.col("a.l_suppkey").alias("s1"), F.col("b.l_suppkey").alias("s2")).agg(conf.alias("confidence"), F.count(F.lit(1)).alias("paths"))


_w = lambda s, d: waits(table(s, d, "orders"))

QUERIES = {
    "lock_roots": lambda s, d: lock_roots(_w(s, d)),
    "lock_summary": lambda s, d: blocked_summary(_w(s, d)),
    "one_hop_expand": lambda s, d: one_hop(_w(s, d), table(s, d, "customer").filter("c_acctbal > 9500").select(F.col("c_custkey").alias("node"))),
    "path_confidence": lambda s, d: supply_paths(table(s, d, "lineitem")),
}

_E = "WITH x AS (SELECT o_custkey AS blocker, lead(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey) AS blocked FROM orders), e AS (SELECT DISTINCT * FROM x WHERE blocked IS NOT NULL AND blocker <> blocked)"

ORACLE_SQL = {
    "lock_roots": _E.replace("WITH", "WITH RECURSIVE") + ", f AS (SELECT DISTINCT blocker FROM e WHERE blocker NOT IN (SELECT blocked FROM e)), r AS (SELECT blocker AS root FROM f UNION SELECT blocker FROM e WHERE NOT EXISTS (SELECT 1 FROM f)), w AS (SELECT root, root AS node FROM r UNION SELECT root, blocked FROM w JOIN e ON node = blocker) SELECT root, count(DISTINCT node) FILTER (WHERE node <> root) AS affected FROM w GROUP BY root",
    "lock_summary": _E + " SELECT count(*) AS edges, count(DISTINCT blocked) AS blocked, count(DISTINCT blocker) AS blockers FROM e",
    "one_hop_expand": _E + ", s AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9500), n AS (SELECT blocked AS node FROM e WHERE blocker IN (SELECT node FROM s) UNION SELECT blocker FROM e WHERE blocked IN (SELECT node FROM s)) SELECT node, 0 AS tier FROM s UNION ALL SELECT node, 1 FROM n WHERE node NOT IN (SELECT node FROM s)",
    "path_confidence": "WITH n AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1), e AS (SELECT l_suppkey, l_partkey, n / total AS conf FROM n JOIN t USING (l_suppkey)) SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, floor(greatest(max(least(a.conf, b.conf)) - 0.05::DOUBLE, 0.0::DOUBLE) * 100 + 0.5) / 100 AS confidence, count(*) AS paths FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2",
}
