"""Graph operators: neighbours, bounded expansion, valid paths, dependency closure."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window, functions as F

from engramlake.functions.expressions import edge_is_valid_at, is_valid_at

RELATIONS = ("contains", "derived_from", "causes", "enables", "prevents", "contradicts", "supersedes")
CAUSAL = ("causes", "enables", "prevents")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that spark.checkpoint.dir names; a folder of this machine only where all runs on it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="engramlake-"))
    return df.checkpoint()


def heads(edges: DataFrame) -> DataFrame:
    """The last revision of each edge (tenant, src, label, dst)."""
    w = Window.partitionBy("tenant", "src", "label", "dst").orderBy(F.desc("revision"))
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def add_edge(src: str, dst: str, label: str, weight: float) -> None:
    """Raises where an edge isn't admissible."""
    if not (weight == weight and 0 <= weight <= 1):
        raise ValueError("an edge's weight has to be in [0, 1]")
    if label == "derived_from" and src == dst:
        raise ValueError("derived_from can't lead to its own node")


def neighbours(edges: DataFrame, node_id: str, direction: str = "out", label: str | None = None) -> DataFrame:
    """node_id, label, weight of the nodes beside one."""
    return step(edges, direction, label).where(F.col("src") == node_id).select(F.col("dst").alias("node_id"), "label", "weight")


def step(edges: DataFrame, direction: str, label: str | None) -> DataFrame:
    """src, dst, label, weight in the direction of travel: out, in or both."""
    e = edges if label is None else edges.where(F.col("label") == label)
    out = e.select("src", "dst", "label", "weight")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def labels(edge_history: DataFrame) -> DataFrame:
    """Labels ever used, in order; those of deleted edges too."""
    return edge_history.select("label").distinct().orderBy("label")


def hops(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out", label: str | None = None) -> DataFrame:
    """seed, node_id, hop: every node within depth of each seed, by its least distance; seeds are at 0.

    Each hop joins the frontier with the edges and leaves out what is known; the frontier is cut at each hop.
    """
    links = step(edges, direction, label).select("src", "dst").distinct()
    front = seeds.select("seed", F.col("seed").alias("node_id")).distinct()
    seen = front.withColumn("hop", F.lit(0))
    for h in range(1, depth + 1):
        new = front.join(links, front["node_id"] == links["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        new = new.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        if depth > 1:
            new = cut(new)
        seen = seen.unionByName(new.withColumn("hop", F.lit(h)))
        front = new
        if depth > 1 and new.isEmpty():
            break
    return seen


def bfs(edges: DataFrame, seed: str, depth: int, direction: str = "out", label: str | None = None) -> DataFrame:
    """node_id, hop of what is within depth of a node, which isn't in it."""
    s = edges.sparkSession.createDataFrame([(seed,)], "seed string")
    return hops(s, edges, depth, direction, label).where("hop > 0").select("node_id", "hop")


def expand(rows: DataFrame, nodes: DataFrame, edges: DataFrame, relation: str | None, depth: int) -> DataFrame:
    """Records of rows and of all nodes that outgoing edges reach within depth; with depth 0, rows as they are.

    Rows come in an order (score, then node_id). A node is emitted by the first row that is it or reaches it: a row that an
    earlier row reaches loses its score, as reached records score 0. Nodes that don't exist are passed through.

    Each hop hands every node the least row that has reached it so far, so that what is held grows with the nodes and not
    with pairs of rows and nodes, and no order of all rows is made.
    """
    if depth == 0:
        return rows
    order = F.struct((-F.col("score")).alias("s"), F.col("node_id").alias("n"), F.monotonically_increasing_id().alias("i"))
    numbered = cut(rows.withColumn("_ord", order))
    links = step(edges, "out", relation).select("src", "dst").distinct()
    by = numbered.groupBy("node_id").agg(F.min("_ord").alias("_by"))
    for _ in range(depth):
        near = by.join(links, by["node_id"] == links["src"]).select(F.col("dst").alias("node_id"), "_by")
        by = cut(by.unionByName(near).groupBy("node_id").agg(F.min("_by").alias("_by")))
    own = numbered.join(by, "node_id").where("_ord = _by").select(*rows.columns)
    fresh = by.join(numbered.select("node_id", F.col("_ord").alias("_by")), ["node_id", "_by"], "left_anti").select("node_id")
    return own.unionByName(nodes.join(fresh, "node_id", "left_semi").withColumn("score", F.lit(0.0).cast("float")).select(*rows.columns))


def paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, as_of_ms: int, depth: int) -> DataFrame:
    """seed, node_id, depth, weight, path, labels: simple paths over what is valid at a time.

    Edges are followed outwards, and inwards too where they aren't causal; a causal step's source mustn't be valid later
    than its target. Paths as short as a node's shortest are kept, longer ones are cut; weight is the product.
    """
    at = F.lit(as_of_ms)
    ok = nodes.where(is_valid_at(at)).select("node_id", F.coalesce("valid_from_ms", "created_at_ms").alias("since"))
    live = edges.where(edge_is_valid_at(at)).select("src", "dst", "label", F.col("weight").cast("double").alias("weight"))
    a, b = ok.select(F.col("node_id").alias("src"), F.col("since").alias("sa")), ok.select(F.col("node_id").alias("dst"), F.col("since").alias("sb"))
    both = live.join(a, "src").join(b, "dst")
    causal = F.col("label").isin(*CAUSAL)
    out = both.where(~causal | (F.col("sa") <= F.col("sb"))).select("src", "dst", "label", "weight")
    back = both.where(~causal).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight")
    links = cut(out.unionByName(back))
    front = seeds.select("seed").distinct().join(ok.select(F.col("node_id").alias("seed")), "seed", "left_semi")
    front = front.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("labels"))
    done = front.select("seed", "node_id").distinct()
    found = front.where(F.lit(False))
    for d in range(1, depth + 1):
        x, y = front.alias("x"), links.alias("y")
        new = x.join(y, F.col("x.node_id") == F.col("y.src")).where(~F.array_contains("x.path", F.col("y.dst"))).select(
            "x.seed", F.col("y.dst").alias("node_id"), F.lit(d).alias("depth"), (F.col("x.weight") * F.col("y.weight")).alias("weight"),
            F.array_append("x.path", F.col("y.dst")).alias("path"), F.array_append("x.labels", F.col("y.label")).alias("labels"),
        )
        new = cut(new.join(done, ["seed", "node_id"], "left_anti"))
        found = found.unionByName(new)
        done = done.unionByName(new.select("seed", "node_id").distinct())
        front = new
        if new.isEmpty():
            break
    return found


def slice_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id) and edges (a, b, label) on paths."""
    n = found.select(F.explode("path").alias("node_id")).distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b"), F.element_at("labels", i).alias("label")))
    return n, found.where(F.size("labels") > 0).select(F.explode(steps).alias("s")).select("s.*").distinct()


def closure(roots: DataFrame, dependencies: DataFrame, records: DataFrame, active_only: bool = True) -> DataFrame:
    """record: what depends on the roots through any records (dependencies: source, target), roots left out, in order.

    Inactive records are passed through; those emitted are Active, or with active_only off all that aren't Purged.
    """
    seen = roots.select("record").distinct()
    front, found = seen, seen.where(F.lit(False))
    links = dependencies.select("source", "target").distinct()
    while True:
        new = front.join(links, front["record"] == links["source"]).select(F.col("target").alias("record")).distinct()
        new = cut(new.join(seen, "record", "left_anti"))
        if new.isEmpty():
            break
        seen, found, front = seen.unionByName(new), found.unionByName(new), new
    keep = F.col("state") == "Active" if active_only else F.col("state") != "Purged"
    return found.join(records.where(keep).select("record"), "record", "left_semi").orderBy("record")
