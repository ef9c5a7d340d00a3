"""Checked writes: vectors, edges, evidence records, artifacts, projections, named snapshots. Each returns rows to append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from engramlake.operators import graph, memory
from engramlake.operators.lifecycle import Conflict
from engramlake.operators.vector import embed_texts


# Vectors and edges


def put_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new vectors (tenant, model, node_id, vector) in place of old ones of their keys.

    All vectors of a model have one dimension, finite values and a norm that isn't zero.
    """
    bad = new.where(F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vector", lambda v: v != 0)).limit(1).count()
    dims = existing.select("model", F.size("vector").alias("d")).unionByName(new.select("model", F.size("vector").alias("d")))
    mixed = dims.groupBy("model").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b or a = 0").limit(1).count()
    if bad or mixed:
        raise ValueError("a model's vectors have one dimension, are finite and not zero")
    return existing.join(new.select("tenant", "model", "node_id"), ["tenant", "model", "node_id"], "left_anti").unionByName(new)


def embed_missing(nodes: DataFrame, embeddings: DataFrame, model: str, embed: Callable) -> DataFrame:
    """Vectors of a model for the text nodes that have none."""
    have = embeddings.where(F.col("model") == model).select("node_id")
    todo = nodes.where("content.type = 'text' and content.text is not null").join(have, "node_id", "left_anti")
    return embed_texts(todo.select("tenant", F.lit(model).alias("model"), "node_id", F.col("content.text").alias("text")), "text", embed).select("tenant", "model", "node_id", "vector")


def put_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Revisions to append for edges, by (tenant, src, label, dst): one beyond the last. Raises where one isn't admissible."""
    loop = (F.col("label") == "derived_from") & (F.col("src") == F.col("dst"))
    if new.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") > 1) | loop).limit(1).count():
        raise ValueError("an edge's weight is in [0, 1], and derived_from doesn't lead to its own node")
    cited = new.select(F.explode("evidence").alias("node_id")).distinct()
    if cited.join(nodes.select("node_id"), "node_id", "left_anti").limit(1).count():
        raise ValueError("an edge's evidence exists")
    key = ["tenant", "src", "label", "dst"]
    last = existing.groupBy(*key).agg(F.max("revision").alias("_last"))
    return new.join(last, key, "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + 1).select(*existing.columns)


def check_agent_relation(label: str) -> None:
    if label not in graph.RELATIONS:
        raise ValueError(f"{label} isn't one of {', '.join(graph.RELATIONS)}")


# Evidence records: revisions are record, revision, state


def _next(head: DataFrame, state: str) -> DataFrame:
    return head.withColumns({"revision": F.col("revision") + 1, "state": F.lit(state)})


def _target(revisions: DataFrame, record: str, expected: int) -> DataFrame:
    head = memory.heads(revisions.where(F.col("record") == record))
    row = head.first()
    if row is None or row["revision"] != expected or row["state"] != "Active":
        raise Conflict(f"{record} isn't active at revision {expected}")
    return head


def _dependents(revisions: DataFrame, dependencies: DataFrame, record: str, workflow: tuple[str, ...] = ()) -> DataFrame:
    heads = memory.heads(revisions)
    root = revisions.sparkSession.createDataFrame([(record,)], "record string")
    found = graph.closure(root, dependencies, heads).where(~F.col("record").isin(record, *workflow))
    return _next(heads.join(found, "record", "left_semi"), "Unsupported").select(*revisions.columns)


def retract_record(revisions: DataFrame, dependencies: DataFrame, record: str, expected: int) -> DataFrame:
    """An active record's retraction, and its active dependents as Unsupported."""
    own = _next(_target(revisions, record, expected), "Retracted").select(*revisions.columns)
    return own.unionByName(_dependents(revisions, dependencies, record))


def correct_claim(revisions: DataFrame, dependencies: DataFrame, actor: str, record: str, expected: int, replacement: str) -> DataFrame:
    """A claim superseded by its user, its replacement, and the claim's active dependents as Unsupported."""
    if actor != "User":
        raise PermissionError("claims are corrected by their user")
    target = _target(revisions, record, expected)
    own = _next(target, "Superseded").select(*revisions.columns)
    new = target.withColumns({"record": F.lit(replacement), "revision": F.lit(1).cast(revisions.schema["revision"].dataType)}).select(*revisions.columns)
    return own.unionByName(new).unionByName(_dependents(revisions, dependencies, record, (replacement,)))


def revise(revisions: DataFrame, record: str, expected: int | None) -> int:
    """The number of a definition's next revision: with None it is new, else its active head is at expected."""
    row = memory.heads(revisions.where(F.col("record") == record)).first()
    if expected is None and row is None:
        return 1
    if row is None or expected is None or row["revision"] != expected or row["state"] != "Active":
        raise Conflict(f"{record} isn't at revision {expected}")
    return expected + 1


# Artifacts: a collection has snapshots, a snapshot has passages that are exact parts of its bytes


def passages(snapshots: DataFrame, spans: DataFrame) -> DataFrame:
    """snapshot, ordinal, start, end, bytes of spans (snapshot, ordinal, start, end); ordinals are unique, spans inside."""
    if spans.groupBy("snapshot", "ordinal").count().where("count > 1").limit(1).count():
        raise ValueError("a snapshot's ordinals are unique")
    of = spans.join(snapshots.select("snapshot", "content"), "snapshot", "left")
    if of.where("content is null or start < 0 or end < start or end > length(content)").limit(1).count():
        raise ValueError("a passage lies in its snapshot")
    return of.select("snapshot", "ordinal", "start", "end", F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("bytes"))


def lineage(passage_evidence: DataFrame) -> DataFrame:
    """source, target dependencies for (snapshot, passage, evidence): snapshot to passage, and passage and evidence both ways."""
    pair = lambda a, b: passage_evidence.select(F.col(a).alias("source"), F.col(b).alias("target"))
    return pair("snapshot", "passage").unionByName(pair("passage", "evidence")).unionByName(pair("evidence", "passage")).distinct()


# Projections: what was computed of a node's content by a profile


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def projections_due(nodes: DataFrame, projections: DataFrame, profile: str, retry_failed: bool = True) -> DataFrame:
    """node_id, content_fp of nodes without a current projection: one of this profile and of the content as it is."""
    n = nodes.select("node_id", fingerprint(F.col("content")).alias("content_fp"))
    done = projections.where(F.col("profile") == profile)
    done = done.where("status = 'Ready'") if retry_failed else done.where("status in ('Ready', 'Failed')")
    return n.join(done.select("node_id", "content_fp"), ["node_id", "content_fp"], "left_anti")


def install(results: DataFrame, nodes: DataFrame, profile: str) -> DataFrame:
    """results (node_id, profile, content_fp, attempt, latest_attempt) with status: Ready where all is still current, else Failed."""
    n = nodes.select("node_id", fingerprint(F.col("content")).alias("_now"))
    current = (F.col("profile") == profile) & (F.col("content_fp") == F.col("_now")) & (F.col("attempt") == F.col("latest_attempt"))
    return results.join(n, "node_id", "left").withColumn("status", F.when(current, "Ready").otherwise("Failed")).drop("_now")


# Named snapshots of tables


def tag(df: DataFrame, folder: str, name: str) -> None:
    """df as the snapshot of a name; an error where there is one."""
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def tagged(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


# Changes that an outside agent proposes to nodes and edges


def apply_changes(nodes: DataFrame, changes: list[dict], now_ms: int) -> DataFrame:
    """Revisions for set_validity and set_state changes ({kind, node_id, expected, ...}): all, or Conflict for all."""
    heads = {r["node_id"]: r for r in nodes.where(F.col("node_id").isin(*[c["node_id"] for c in changes])).groupBy("node_id").agg(F.max("revision").alias("revision")).collect()}
    for c in changes:
        if c["node_id"] not in heads or heads[c["node_id"]]["revision"] != c["expected"]:
            raise Conflict(f"{c['node_id']} isn't at revision {c['expected']}")
    spark = nodes.sparkSession
    rows = [(c["node_id"], c["expected"], c.get("state"), c.get("valid_from_ms"), c.get("valid_to_ms")) for c in changes]
    c = spark.createDataFrame(rows, "node_id string, revision bigint, _state string, _from bigint, _to bigint")
    return (
        nodes.join(F.broadcast(c), ["node_id", "revision"])
        .withColumns({
            "state": F.coalesce("_state", "state"), "valid_from_ms": F.coalesce("_from", "valid_from_ms"), "valid_to_ms": F.coalesce("_to", "valid_to_ms"),
            "revision": F.col("revision") + 1, "updated_at_ms": F.lit(now_ms).cast("bigint"),
        }).select(*nodes.columns)
    )
