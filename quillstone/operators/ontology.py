"""Operators on a vocabulary, a DAG of edges (child, parent) that is small beside the rows it labels.

Closures are recursive queries; a result is joined to rows by label, where Spark broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.lineage import cut, running

DECAY = 0.8
MOST_LEVELS = 100


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, shortest, longest): every node with itself and all above it, with path lengths."""
    # a step keeps one row per pair and length, so lengths and not paths bound the recursion
    walk = edges.sparkSession.sql(
        f"""
        WITH RECURSIVE up(node, ancestor, steps) MAX RECURSION LEVEL {MOST_LEVELS} AS (
            SELECT node, node, 0 FROM {{nodes}}
            UNION ALL
            SELECT up.node, e.parent, up.steps + 1 FROM up JOIN {{edges}} e ON e.child = up.ancestor
        )
        SELECT node, ancestor, min(steps) AS shortest, max(steps) AS longest FROM up GROUP BY node, ancestor
        """,
        nodes=nodes(edges),
        edges=edges.select("child", "parent").distinct(),
    )
    return walk


def roots(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return nodes(edges).join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def depths(edges: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, shortest, longest): path lengths from the roots."""
    up = closure(edges) if up is None else up
    return up.join(roots(edges).select(F.col("node").alias("ancestor")), "ancestor", "left_semi").groupBy("node").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))


def lowest_common_ancestors(edges: DataFrame, pairs: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Adds lca to pairs (a, b): the common ancestor deepest by longest path, the smaller name on ties; null if none."""
    up = closure(edges) if up is None else up
    deep = depths(edges, up).select(F.col("node").alias("ancestor"), F.col("longest").alias("depth"))
    of = lambda c: up.select(F.col("node").alias(c), "ancestor")
    common = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), ["b", "ancestor"]).join(deep, "ancestor")
    best = common.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("depth"), "ancestor"))).where("r = 1").select("a", "b", F.col("ancestor").alias("lca"))
    return pairs.join(best, ["a", "b"], "left")


def leaf_distances(edges: DataFrame, least_level: int = 0, up: DataFrame | None = None) -> DataFrame:
    """(a, b, d) for all ordered pairs: min over common ancestors of the longer way up; -1 if none at least_level or deeper."""
    up = closure(edges) if up is None else up
    level = depths(edges, up).select(F.col("node").alias("ancestor"), F.col("shortest").alias("level"))
    side = up.join(level.where(F.col("level") >= least_level), "ancestor")
    near = side.select(F.col("node").alias("a"), "ancestor", F.col("shortest").alias("x")).join(side.select(F.col("node").alias("b"), "ancestor", F.col("shortest").alias("y")), "ancestor").groupBy("a", "b").agg(F.min(F.greatest("x", "y")).alias("d"))
    every = nodes(edges)
    grid = every.select(F.col("node").alias("a")).join(F.broadcast(every.select(F.col("node").alias("b"))))
    return grid.join(near, ["a", "b"], "left").withColumn("d", F.coalesce("d", F.lit(-1)))


def wang_similarity(edges: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) for pairs with a common ancestor: shared over total S-values, each DECAY by hop."""
    up = closure(edges) if up is None else up
    s = up.select("node", "ancestor", F.pow(F.lit(DECAY), F.col("shortest")).alias("s"))
    whole = s.groupBy("node").agg(F.sum("s").alias("total"))
    shared = s.select(F.col("node").alias("a"), "ancestor", F.col("s").alias("x")).join(s.select(F.col("node").alias("b"), "ancestor", F.col("s").alias("y")), "ancestor").groupBy("a", "b").agg(F.sum(F.col("x") + F.col("y")).alias("shared"))
    return shared.join(whole.select(F.col("node").alias("a"), F.col("total").alias("ta")), "a").join(whole.select(F.col("node").alias("b"), F.col("total").alias("tb")), "b").select("a", "b", (F.col("shared") / (F.col("ta") + F.col("tb"))).alias("similarity"))


def level_rollup(edges: DataFrame, level: int, up: DataFrame | None = None) -> DataFrame:
    """(node, target): the nearest ancestor at the level, else the deepest above it; smaller name on ties."""
    up = closure(edges) if up is None else up
    at = depths(edges, up).select(F.col("node").alias("ancestor"), F.col("shortest").alias("level"))
    fit = up.join(at, "ancestor").where(F.col("level") <= level)
    order = Window.partitionBy("node").orderBy(F.desc("level"), "shortest", "ancestor")
    return fit.withColumn("r", F.row_number().over(order)).where("r = 1").select("node", F.col("ancestor").alias("target"))


def fold_rare(edges: DataFrame, counts: DataFrame, least: int, up: DataFrame | None = None) -> DataFrame:
    """(node, target) for counts (node, n): rare nodes go to the nearest ancestor that survives or joins two or more; else stay."""
    up = closure(edges) if up is None else up
    survivors = counts.where(F.col("n") >= least).select(F.col("node").alias("ancestor"))
    good = survivors.union(joining_ancestors(edges, counts, up).select(F.col("node").alias("ancestor"))).distinct()
    rare = counts.where(F.col("n") < least).select("node")
    near = up.where("shortest > 0").join(rare, "node", "left_semi").join(good, "ancestor", "left_semi")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("shortest", "ancestor"))).where("r = 1").select("node", F.col("ancestor").alias("up"))
    return counts.join(best, "node", "left").select("node", F.coalesce("up", "node").alias("target"))


def joining_ancestors(edges: DataFrame, counts: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, supported): nodes of which two or more children have occupied nodes at or below them, and roots that have any."""
    up = closure(edges) if up is None else up
    live = up.join(counts.where("n > 0").select("node"), "node", "left_semi").select(F.col("ancestor").alias("child")).distinct()
    supported = edges.select("child", "parent").distinct().join(live, "child", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("supported"))
    top = roots(edges).withColumn("root", F.lit(True))
    return supported.join(top, "node", "left").where("supported >= 2 or root").select("node", "supported")


def terminal_siblings(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: leaves that share a parent."""
    low = edges.join(leaves(edges).select(F.col("node").alias("child")), "child", "left_semi").select("child", "parent").distinct()
    return low.select(F.col("child").alias("a"), "parent").join(low.select(F.col("child").alias("b"), "parent"), "parent").where("a < b").select("a", "b").distinct()


def active_counts(edges: DataFrame, counts: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, descendants, active, n): size of each subtree, its occupied nodes, and their rows."""
    up = closure(edges) if up is None else up
    return up.join(counts, "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.count_if(F.col("n") > 0).alias("active"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def unrolled(edges: DataFrame, most_depth: int = 20) -> DataFrame:
    """(path, node, parent, depth): a strict tree, with a copy of a node for each way down to it."""
    return edges.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(path, node, parent, depth) MAX RECURSION LEVEL {most_depth + 1} AS (
            SELECT CAST(node AS STRING), node, CAST(NULL AS STRING), 0 FROM {{roots}}
            UNION ALL
            SELECT concat(tree.path, '/', e.child), e.child, tree.node, tree.depth + 1 FROM tree JOIN {{edges}} e ON e.parent = tree.node WHERE tree.depth < {most_depth}
        )
        SELECT path, node, parent, depth FROM tree
        """,
        roots=roots(edges),
        edges=edges.select("child", "parent").distinct(),
    )


def hop_distances(edges: DataFrame) -> DataFrame:
    """(a, b, hops) along edges in either direction, for all pairs with a way; a pair without one has no row.

    One step for each hop of the longest way: the pairs that are new are those that go on.
    """
    both = cut(edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).union(edges.select("parent", "child")).distinct())
    new = found = cut(nodes(edges).select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("hops")))
    while not new.isEmpty():
        step = new.join(both, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"), (F.col("hops") + 1).alias("hops")).distinct()
        new = cut(step.join(found, ["a", "b"], "left_anti"))
        found = found.unionByName(new)
    return found


def order_constraints(edges: DataFrame, occupied: DataFrame, develops: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """(earlier, later) among occupied nodes: ancestors before their descendants, and the pairs of develops."""
    up = closure(edges) if up is None else up
    pairs = up.where("shortest > 0").select(F.col("ancestor").alias("earlier"), F.col("node").alias("later"))
    if develops is not None:
        pairs = pairs.union(develops.select("earlier", "later"))
    return pairs.join(occupied.select(F.col("node").alias("earlier")), "earlier", "left_semi").join(occupied.select(F.col("node").alias("later")), "later", "left_semi").select("earlier", "later").distinct()


def relevant(edges: DataFrame, predicted: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node): predicted classes (node) and one shortest way from each to a root, by smaller names on ties."""
    up = cut(closure(edges) if up is None else up)
    deep = cut(depths(edges, up).select("node", "shortest"))
    step = edges.select("child", "parent").distinct().join(deep.select(F.col("node").alias("parent"), F.col("shortest").alias("d")), "parent")
    first = cut(step.groupBy("child").agg(F.min(F.struct("d", "parent")).alias("b")).select(F.col("child"), F.col("b.parent").alias("parent")))
    now = found = cut(nodes(edges).join(predicted.select("node").distinct(), "node", "left_semi"))
    while not now.isEmpty():
        now = cut(now.join(first, F.col("node") == F.col("child")).select(F.col("parent").alias("node")).distinct().join(found, "node", "left_anti"))
        found = found.unionByName(now)
    return found


def pruned(edges: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(child, parent): the vocabulary without leaves of fewer than `least` rows (counts: node, n), time after time, then without empty nodes that just pass on from one child.

    What passes on is bridged: its child gets its parents.
    """
    kept = cut(edges.select("child", "parent").distinct())
    n = cut(counts.select("node", "n"))
    while True:
        low = leaves(kept).join(n, "node", "left").where(F.coalesce("n", F.lit(0)) < least)
        low = cut(low.select(F.col("node").alias("child")))
        if low.isEmpty():
            break
        kept = cut(kept.join(low, "child", "left_anti").select("child", "parent"))
    while True:
        children = kept.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
        empty = kept.select(F.col("child").alias("node")).distinct().join(children, "node").join(n, "node", "left").where("children = 1 and coalesce(n, 0) = 0")
        one = cut(empty.agg(F.min("node").alias("node")).where("node is not null"))  # one at a time, as bridges meet
        if one.isEmpty():
            return kept
        above = kept.join(one.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("child").alias("mid"), "parent")
        under = kept.join(one.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", F.col("parent").alias("mid"))
        rest = kept.join(one.select(F.col("node").alias("child")), "child", "left_anti").join(one.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent")
        kept = cut(rest.unionByName(under.join(above, "mid").select("child", "parent")).distinct())


def reduced(edges: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(child, parent): edges that no longer way replaces (the transitive reduction)."""
    up = closure(edges) if up is None else up
    over = up.where("longest > 1").select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))
    return edges.select("child", "parent").distinct().join(over, ["child", "parent"], "left_anti")


def small_tree(edges: DataFrame, kept: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(child, parent) among kept nodes (node): each below its nearest kept ancestors that no other kept one lies under."""
    up = cut(closure(edges) if up is None else up)
    keep = lambda c: kept.select(F.col("node").alias(c)).distinct()
    pairs = cut(up.where("shortest > 0").join(keep("node"), "node", "left_semi").join(keep("ancestor"), "ancestor", "left_semi").select(F.col("node").alias("child"), F.col("ancestor").alias("parent")))
    through = pairs.select("child", F.col("parent").alias("mid")).join(pairs.select(F.col("child").alias("mid"), "parent"), "mid").select("child", "parent").distinct()
    return pairs.join(through, ["child", "parent"], "left_anti")


def walked_up(edges: DataFrame, kept: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, target): the nearest kept node (node) at or above each node, deepest then smaller name on ties; nodes without one have none."""
    up = closure(edges) if up is None else up
    deep = depths(edges, up).select(F.col("node").alias("ancestor"), F.col("longest").alias("depth"))
    near = up.join(kept.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi").join(deep, "ancestor")
    return near.groupBy("node").agg(F.min(F.struct("shortest", (-F.col("depth")).alias("d"), "ancestor")).alias("b")).select("node", F.col("b.ancestor").alias("target"))


def common_terms(edges: DataFrame, classes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(group, node): the deepest terms at or above all of a group's classes (group, label), none of which lies above another."""
    up = closure(edges) if up is None else up
    sizes = classes.select("group", "label").distinct().groupBy("group").agg(F.count("*").alias("n"))
    met = classes.select("group", F.col("label").alias("node")).distinct().join(up, "node").groupBy("group", "ancestor").agg(F.count("*").alias("k")).join(sizes, "group").where("k = n").select("group", F.col("ancestor").alias("node"))
    over = met.join(up.where("shortest > 0").select("node", "ancestor"), "node").select("group", F.col("ancestor").alias("node")).distinct()
    return met.join(over, ["group", "node"], "left_anti")


def multi_lineage(edges: DataFrame, classes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(group, is_multi): whether a group's classes have nothing deeper in common than roots."""
    common = common_terms(edges, classes, up).join(roots(edges).withColumn("root", F.lit(True)), "node", "left")
    seen = common.groupBy("group").agg(F.min(F.coalesce("root", F.lit(False))).alias("all_roots"))
    return classes.select("group").distinct().join(seen, "group", "left").select("group", F.coalesce("all_roots", F.lit(True)).alias("is_multi"))


def canonical_order(edges: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, place): nodes by size of their subtree, the largest first, then depth, then name."""
    up = closure(edges) if up is None else up
    sizes = up.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size")).join(depths(edges, up).select("node", "shortest"), "node")
    return running(sizes, [F.desc("size"), F.asc("shortest"), F.asc("node")], F.lit(1), "place").select("node", "place")
