"""Lineage graphs as node and edge DataFrames (edges: src -> dst). Every loop joins frontiers, nothing is walked on the driver."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .similar import candidates

#: Rounds after which a walk gives up; a lineage graph is far shallower.
MOST_ROUNDS = 200
#: Rows of a frontier up to which it is sent to the edges; a larger one is shuffled to them.
BROADCAST_ROWS = 100_000


def closure(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, reached, hops): everything downstream of each node, at its least distance; cycles end. Walks until nothing is new; raises where a given bound would cut it."""
    steps = edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).distinct()
    frontier = edges.select(F.col("src").alias("node"), F.col("dst").alias("reached")).distinct().withColumn("hops", F.lit(1)).where("node <> reached")
    found = cut(frontier)
    frontier = found
    for hop in range(2, most_rounds) if most_rounds is not None else count(2):
        more = frontier.join(steps, F.col("reached") == F.col("mid")).select("node", F.col("next").alias("reached")).where("node <> reached").distinct()
        frontier = cut(more.join(found, ["node", "reached"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    else:
        raise RuntimeError(f"the graph is deeper than {most_rounds} rounds")
    return found


def _steps(edges: DataFrame, stop: DataFrame | None) -> DataFrame:
    """Edges (mid, next) that do not enter a node of ``stop``, dealt by ``mid`` once, so that a walk never shuffles them again."""
    if stop is not None:
        edges = edges.join(stop.select(F.col("node").alias("dst")), "dst", "left_anti")
    return cut(edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).distinct().repartition("mid"))


def _next(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """``frontier`` (reached, ...) with ``next``. The frontier is counted before it is broadcast."""
    side = F.broadcast(frontier) if frontier.count() <= BROADCAST_ROWS else frontier
    return steps.join(side, F.col("mid") == F.col("reached"))


def reach(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, reached, hops): everything downstream of each seed (node), at its least distance, by paths that do not enter a node of ``stop``.

    State and work are in the pairs that are found and one pass over the edges a round; cycles end, and a seed does not reach itself.
    """
    steps = _steps(edges, stop)
    frontier, found = seeds.select("node", F.col("node").alias("reached"), F.lit(0).alias("hops")).distinct(), None
    for hop in count(1):
        more = _next(frontier, steps).select("node", F.col("next").alias("reached")).where("node <> reached").distinct()
        if found is not None:
            more = more.join(found, ["node", "reached"], "left_anti")
        frontier = cut(more.withColumn("hops", F.lit(hop)))
        found = frontier if found is None else found.union(frontier)
        if frontier.isEmpty():
            return found


def reached_from(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, hops): all nodes downstream of any of the seeds, seeds only where another one reaches them. One row a node, however many seeds."""
    steps = _steps(edges, stop)
    frontier, found = seeds.select(F.col("node").alias("reached")).distinct(), None
    for hop in count(1):
        more = _next(frontier, steps).select(F.col("next").alias("reached")).distinct()
        if found is not None:
            more = more.join(found.select("reached"), "reached", "left_anti")
        frontier = cut(more.withColumn("hops", F.lit(hop)))
        found = frontier if found is None else found.union(frontier)
        if frontier.isEmpty():
            return found.select(F.col("reached").alias("node"), "hops")


def least_labels(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node, label): the least label of the seeds (node, label) that are or reach a node. Only labels that fell go on."""
    steps = _steps(edges, stop)
    labels = cut(seeds.groupBy(F.col("node").alias("reached")).agg(F.min("label").alias("label")))
    frontier = labels
    while True:
        more = _next(frontier, steps).groupBy(F.col("next").alias("reached")).agg(F.min("label").alias("new"))
        met = more.join(labels, "reached", "left").where("label is null or new < label").select("reached", F.col("new").alias("label"))
        frontier = cut(met)
        if frontier.isEmpty():
            return labels.withColumnRenamed("reached", "node")
        labels = cut(labels.join(frontier.select("reached"), "reached", "left_anti").union(frontier))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, descendants, marts, exposures: what a node reaches, by kind (nodes: node, kind)."""
    kinds = nodes.select(F.col("node").alias("reached"), "kind")
    reach = closure(edges).join(kinds, "reached", "left").groupBy("node").agg(
        F.count(F.when(F.col("kind") != "exposure", 1)).alias("descendants"), F.count(F.when(F.col("kind") == "mart", 1)).alias("marts"), F.count(F.when(F.col("kind") == "exposure", 1)).alias("exposures")
    )
    return nodes.select("node").join(reach, "node", "left").na.fill(0)


def lift(descendants: Column, marts: Column, exposures: Column) -> Column:
    """Weight of a finding by what lies behind it."""
    return 1 + F.least(descendants, F.lit(50)) / 25 + F.least(marts, F.lit(10)) / 5 + 5 * F.least(exposures, F.lit(2))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """node, component (its least node): labels spread to neighbours and jump to their own label's label until nothing changes."""
    both = edges.select("src", "dst").union(reversed_edges(edges)).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut(spread.join(up, "component").select("node", F.col("root").alias("component"), "was"))
        done = jumped.where("component <> was").isEmpty()
        labels = jumped.select("node", "component")
        if done:
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def levels(nodes: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, level: a topological order by the longest path from a root; nodes on or behind a cycle have none. A given bound raises, it never cuts."""
    left, out = cut(nodes.select("node")), None
    for level in range(most_rounds) if most_rounds is not None else count():
        waiting = edges.join(left, edges["src"] == left["node"]).select(F.col("dst").alias("node")).distinct()
        ready = cut(left.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.union(ready)
        left = cut(left.join(ready, "node", "left_anti"))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"the graph is deeper than {most_rounds} rounds")
    return left.withColumn("level", F.lit(None).cast("int")) if out is None else out.union(left.withColumn("level", F.lit(None).cast("int")))


def sources_behind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, sources: all sources upstream. Walks from the sources, so work follows the answer."""
    down = reach(nodes.where("kind = 'source'").select("node"), edges)
    return down.groupBy(F.col("reached").alias("node")).agg(F.sort_array(F.collect_set("node")).alias("sources"))


def reaches_until(start: DataFrame, edges: DataFrame, stop: DataFrame, goal: DataFrame) -> DataFrame:
    """node, goals: goal nodes reached from ``start`` by paths that do not enter a node of ``stop``."""
    met = reach(start, edges, stop).join(goal.select(F.col("node").alias("reached")), "reached")
    return met.groupBy("node").agg(F.count("*").alias("goals"))


def edge_facts(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """src, dst, available, carried, dropped, narrow: columns (node, cols array) of both ends of each hop."""
    up = columns.select(F.col("node").alias("src"), F.col("cols").alias("up"))
    down = columns.select(F.col("node").alias("dst"), F.col("cols").alias("down"))
    met = edges.join(up, "src").join(down, "dst")
    dropped = F.array_except("up", "down")
    return met.select("src", "dst", F.size("up").alias("available"), F.size(F.array_intersect("up", "down")).alias("carried"), F.size(dropped).alias("dropped"), ((F.size("up") >= 5) & (F.size(dropped) >= 0.8 * F.size("up"))).alias("narrow"))


def partial_key_joins(joins: DataFrame) -> DataFrame:
    """Joins that cover only part of the parent's key: (child, parent, parent_key array, joined_on array)."""
    missing = F.array_except("parent_key", "joined_on")
    return joins.withColumn("missing", missing).where((F.size("missing") > 0) & (F.size(F.array_intersect("parent_key", "joined_on")) > 0))


def column_trace(lineage: DataFrame, start: DataFrame, hops: int = 12) -> DataFrame:
    """(origin_node, origin_column, node, column, hop): follow carried columns back, at most ``hops`` steps.

    ``lineage``: node, column, parent, parent_column, is_carried. A step that is not carried is the last.
    """
    here = cut(start.select(F.col("node").alias("origin_node"), F.col("column").alias("origin_column"), "node", "column").withColumn("hop", F.lit(0)))
    out = here
    for hop in range(1, hops + 1):
        steps = lineage.where("is_carried").select("node", "column", "parent", "parent_column")
        here = cut(here.join(steps, ["node", "column"]).select("origin_node", "origin_column", F.col("parent").alias("node"), F.col("parent_column").alias("column"), F.lit(hop).alias("hop")))
        if here.isEmpty():
            break
        out = out.union(here)
    return out


def _name_tokens(name: str) -> Column:
    return F.array_distinct(F.split(F.lower(name), "[^a-z0-9]+"))


def alignment_pairs(columns: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of differing names whose token sets have a Jaccard similarity of ``least`` or more and share a token: (model, name) -> name_a, name_b, score.

    Joined on rare tokens only (``similar``), so a token that most names have makes no pairs.
    """
    names = columns.select(F.col("name").alias("key")).where("key is not null").distinct().withColumn("items", _name_tokens("key"))
    both = F.array_intersect("items_a", "items_b")
    score = F.round(F.size(both) / F.size(F.array_union("items_a", "items_b")), 6)
    met = candidates(names, least).where(F.size(F.array_remove(both, "")) > 0)
    return met.select(F.col("key_a").alias("name_a"), F.col("key_b").alias("name_b"), score.alias("score")).where(F.col("score") >= least)


def meaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """event, subject, was, now between two states (subject, value): added, removed, moved."""
    met = before.select("subject", F.col("value").alias("was")).join(after.select("subject", F.col("value").alias("now")), "subject", "full")
    event = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "moved")
    return met.withColumn("event", event).where("event is not null").select("event", "subject", "was", "now")


def select_nodes(nodes: DataFrame, edges: DataFrame, select: str, exclude: str | None = None) -> DataFrame:
    """Nodes by a selector: ``name``, ``path:p``, ``tag:t``, ``config.materialized:m``, with leading or trailing ``+``; a space is a union.

    ``nodes``: node, path, tags (array), materialized. An unknown prefix is an error; a selector without matches is empty.
    """

    def one(token: str) -> DataFrame:
        up, down = token.startswith("+"), token.endswith("+")
        body = token.strip("+")
        kind, _, value = body.rpartition(":")
        tests = {"": F.col("node") == value, "path": F.col("path").startswith(value), "tag": F.array_contains("tags", value), "config.materialized": F.col("materialized") == value}
        if kind not in tests:
            raise ValueError(f"unknown selector: {token}")
        found = nodes.where(tests[kind]).select("node")
        out = found
        if down:
            out = out.union(reached_from(found, edges).select("node"))
        if up:
            out = out.union(reached_from(found, reversed_edges(edges)).select("node"))
        return out.distinct()

    def many(text: str) -> DataFrame:
        parts = [one(t) for t in text.split()]
        out = parts[0] if parts else nodes.limit(0).select("node")
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    return many(select).join(many(exclude), "node", "left_anti") if exclude else many(select)


def view_chains(nodes: DataFrame, edges: DataFrame, least: int = 4) -> DataFrame:
    """node, length: the longest chain of views that ends at a view."""
    views = nodes.where("materialized = 'view'").select("node")
    between = edges.join(views.select(F.col("node").alias("src")), "src").join(views.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    return levels(views, between).select("node", (F.col("level") + 1).alias("length")).where(F.col("length") >= least)


def rejoined(edges: DataFrame) -> DataFrame:
    """a -> c beside a -> b -> c: the child reads a concept again that its parent already holds."""
    one, two, direct = edges.alias("x"), edges.alias("y"), edges.alias("z")
    path = one.join(two, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    return path.join(direct, (F.col("a") == F.col("z.src")) & (F.col("c") == F.col("z.dst"))).select("a", "b", "c").distinct()
