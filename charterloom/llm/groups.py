"""Consolidating pairwise matches into groups (problem 5).

1. The giant component, if there is one, is peeled: a breadth-first search by
   frontier joins starts at the vertex of highest degree and goes on as long
   as the frontier holds a share of all vertices.  A component that the search
   finishes is anti-joined away; one with thin tails is contracted to its
   smallest id, so that a chain of a thousand steps never costs a thousand
   joins.  Its vertices get their group as a constant, without a join.
2. The rest is labelled by minimum propagation: each round every vertex takes
   the minimum of its neighbourhood in a seeded order of that round, the graph
   is contracted to these labels, and the labels are composed at the end.  The
   random order makes the graph shrink by a constant factor in any shape, so
   long chains take a logarithmic number of rounds.

All state is tables in the shared folder; the driver sees only counts, the
start vertex and single ids.  Neighbourhood minima combine before their
shuffle, so a hub with a third of all links is one row per map task.  Lookups
of ids broadcast the looked-up table up to a counted size.  Beyond it the keys
that fill more than one of ``HEAVY_PART`` rows, of which there are at most
``HEAVY_PART``, are looked up by broadcast and only the others by shuffle, so
a hub or a large group is never one task's work.

Links with null ends, equal ends or a score that is null, not a number or
below the threshold are none; repeated and reversed rows are one link.  No
links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.plans.materialize import discard, materialize
from charterloom.sources import tables

THRESHOLD = 0.6
FRONTIER_SHARE = 0.01
HEAVY_PART = 10_000


def links(dist_mat: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct undirected links (a, b), a < b."""
    score = F.col("score")
    good = F.col("i").isNotNull() & F.col("j").isNotNull() & (F.col("i") != F.col("j")) & score.isNotNull() & ~F.isnan(score) & (score >= threshold)
    return dist_mat.where(good).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, most: int) -> DataFrame:
    """``rows`` with ``value`` from ``table`` (one row for each ``key``, ``most`` at most), null where it has none."""
    if most <= tables.BROADCAST_KEYS:
        return rows.join(F.broadcast(table), key, "left")
    rows, table = materialize(rows, "rows"), materialize(table, "lookup")
    if table.count() <= tables.BROADCAST_KEYS:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HEAVY_PART > rows.count()).select(key, F.lit(True).alias("_heavy"))
    heavy = materialize(counts.join(table, key, "left").select(key, "_heavy", value), "heavy")
    told = rows.join(F.broadcast(heavy), key, "left")
    cold = told.where("_heavy is null").drop("_heavy", value).join(table, key, "left")
    return told.where("_heavy").drop("_heavy").unionByName(cold)


def _relabel(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Edges between the labels of their ends; ends without a label keep themselves."""
    for end in ("a", "b"):
        own = labels.select(F.col("v").alias(end), F.col("label").alias("_label"))
        edges = _looked_up(edges, end, own, "_label", most).withColumn(end, F.coalesce("_label", end)).drop("_label")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def peel_giant(edges: DataFrame, frontier_share: float = FRONTIER_SHARE) -> tuple[DataFrame, int, bool, int] | None:
    """(vertices, smallest id, whole component?, vertices of the graph) found from the vertex of highest degree, or None without links."""
    degrees = _both(edges).groupBy("u").agg(F.count("*").alias("degree"))
    top = degrees.agg(F.count("*").alias("n"), F.min_by("u", F.struct(-F.col("degree"), F.col("u"))).alias("hub")).first()
    if not top["n"]:
        return None
    around = _both(edges)
    found = frontier = edges.sparkSession.createDataFrame([(top["hub"],)], "v bigint")
    n, every, least, steps = 1, 1, top["hub"], []
    while n and (n >= frontier_share * top["n"] or every == 1):
        # a frontier or a found set of a counted size is broadcast, so the links stay where they are
        step = around.join(tables.bounded(frontier.select(F.col("v").alias("u")), n), "u", "left_semi").select("v")
        frontier = materialize(step.join(tables.bounded(found, every), "v", "left_anti").distinct(), "frontier")
        size = frontier.agg(F.count("*").alias("n"), F.min("v").alias("least")).first()
        n, every = size["n"], every + size["n"]
        steps.append(frontier)
        if n:
            found, least = found.unionByName(frontier), min(least, size["least"])
    giant = materialize(found, "giant")
    for step in steps:
        discard(step)
    return giant, least, n == 0, top["n"]


def connected_groups(edges: DataFrame, frontier_share: float = FRONTIER_SHARE) -> DataFrame:
    """(doc_idx, group_id) of every vertex; the group is its smallest vertex."""
    edges = materialize(edges, "links")
    peeled = peel_giant(edges, frontier_share)
    if peeled is None:
        return edges.select(F.col("a").alias("doc_idx"), F.col("b").alias("group_id"))
    giant, least, whole, n = peeled  # no table of vertices has more than n rows
    if whole:
        rest = edges.join(tables.bounded(giant.select(F.col("v").alias("a")), n), "a", "left_anti")
    else:
        rest = _relabel(edges, giant.withColumn("label", F.lit(least)), n)
    rest, maps, level = materialize(rest, "rest"), [], 0
    while not rest.isEmpty():
        order = lambda c, level=level: F.struct(F.xxhash64(F.lit(level), c).alias("p"), F.col(c).alias("v"))
        lowest = _both(rest).groupBy("u").agg(F.min(order("v")).alias("m"))
        labels = materialize(lowest.select(F.col("u").alias("v"), F.least(F.col("m"), order("u"))["v"].alias("label")), f"labels-{level}")
        smaller = materialize(_relabel(rest, labels, n), f"rest-{level}")
        discard(rest)
        rest, level = smaller, level + 1
        maps.append(labels)
    if not maps:
        return giant.select(F.col("v").alias("doc_idx"), F.lit(least).alias("group_id"))
    roots = maps[-1]
    for labels in reversed(maps[:-1]):
        onward = roots.select(F.col("v").alias("label"), F.col("label").alias("root"))
        roots = _looked_up(labels, "label", onward, "root", n).select("v", F.coalesce("root", "label").alias("label"))
    roots = materialize(roots, "roots")
    for labels in maps:
        discard(labels)
    names = roots.groupBy("label").agg(F.min("v").alias("group_id"))
    named = _looked_up(roots, "label", names, "group_id", n).select(F.col("v").alias("doc_idx"), "group_id")
    if not whole:  # the vertex that stands for the giant component may have been joined with others
        at = roots.where(F.col("v") == least).join(names, "label").first()
        least = at["group_id"] if at else least
        named = named.join(F.broadcast(roots.sparkSession.createDataFrame([(peeled[1],)], "doc_idx bigint")), "doc_idx", "left_anti")
    return named.unionByName(giant.select(F.col("v").alias("doc_idx"), F.lit(least).cast("bigint").alias("group_id")))


def match_groups(dist_mat: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_idx, group_id) of every record or item with at least one link."""
    return connected_groups(links(dist_mat, threshold))
