"""Checked writes over small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from engramlake.operators import graph, lifecycle, writers
from engramlake.sources import adapters
from tests.test_operators import embeddings, nodes


def test_vectors(spark):
    e = embeddings(spark, a=[1, 0], b=[0, 1])
    out = writers.put_vectors(e, embeddings(spark, a=[3, 4], c=[1, 1]))
    assert {r["node_id"]: r["vector"] for r in out.collect()} == {"a": [3, 4], "b": [0, 1], "c": [1, 1]}
    for bad in ({"x": [1, 2, 3]}, {"x": [0, 0]}, {"x": [float("nan"), 1]}, {"x": [float("inf"), 1]}):
        with pytest.raises(ValueError):
            writers.put_vectors(e, embeddings(spark, **bad))
    n = nodes(spark, ("a", "old", 1, None, "Active"), ("z", "new", 1, None, "Active"))
    assert [(r["node_id"], r["vector"]) for r in writers.embed_missing(n, e, "text", lambda t: [[float(len(x))] for x in t]).collect()] == [("z", [3.0])]


def test_edges(spark):
    n = nodes(spark, ("a", "", 1, None, "Active"))
    row = lambda w, label="r", dst="b", ev=(): (0, "a", dst, label, w, 1, None, 9, None, None, list(ev))
    make = lambda *rows: spark.createDataFrame(rows, adapters.EDGES)
    old = make(row(0.5))
    out = writers.put_edges(old, make(row(1.0), row(0.1, "s", ev=("a",))), n)
    assert {r["label"]: r["revision"] for r in out.collect()} == {"r": 10, "s": 1}
    assert graph.heads(old.unionByName(out)).count() == 2
    for bad in (row(2.0), row(0.1, "derived_from", "a"), row(0.1, ev=("none",))):
        with pytest.raises(ValueError):
            writers.put_edges(old, make(bad), n)
    writers.check_agent_relation("causes")
    with pytest.raises(ValueError):
        writers.check_agent_relation("likes")


def test_retraction_and_correction(spark):
    rev = spark.createDataFrame([("e", 1, "Active"), ("c1", 1, "Active"), ("c2", 3, "Active"), ("c3", 1, "Retracted")], "record string, revision bigint, state string")
    deps = spark.createDataFrame([("e", "c1"), ("c1", "c3"), ("c3", "c2")], "source string, target string")
    got = {r["record"]: (r["revision"], r["state"]) for r in writers.retract_record(rev, deps, "e", 1).collect()}
    assert got == {"e": (2, "Retracted"), "c1": (2, "Unsupported"), "c2": (4, "Unsupported")}
    got = {r["record"]: (r["revision"], r["state"]) for r in writers.correct_claim(rev, deps, "User", "c1", 1, "new").collect()}
    assert got == {"c1": (2, "Superseded"), "new": (1, "Active"), "c2": (4, "Unsupported")}
    with pytest.raises(lifecycle.Conflict):
        writers.retract_record(rev, deps, "c3", 1)
    with pytest.raises(PermissionError):
        writers.correct_claim(rev, deps, "Operator", "c1", 1, "new")
    assert writers.revise(rev, "none", None) == 1 and writers.revise(rev, "c2", 3) == 4
    for record, expected in (("c2", None), ("c2", 2), ("none", 1), ("c3", 1)):
        with pytest.raises(lifecycle.Conflict):
            writers.revise(rev, record, expected)


def test_passages(spark):
    snap = spark.createDataFrame([("s", b"abcdef")], "snapshot string, content binary")
    span = lambda *rows: spark.createDataFrame(rows, "snapshot string, ordinal int, start int, end int")
    assert [bytes(r["bytes"]) for r in writers.passages(snap, span(("s", 1, 0, 2), ("s", 2, 2, 6))).orderBy("ordinal").collect()] == [b"ab", b"cdef"]
    for bad in (span(("s", 1, 0, 2), ("s", 1, 2, 3)), span(("s", 1, 4, 9)), span(("t", 1, 0, 1))):
        with pytest.raises(ValueError):
            writers.passages(snap, bad)
    of = spark.createDataFrame([("s", "p", "e")], "snapshot string, passage string, evidence string")
    assert {tuple(r) for r in writers.lineage(of).collect()} == {("s", "p"), ("p", "e"), ("e", "p")}


def test_projections(spark, tmp_path):
    n = nodes(spark, ("a", "x", 1, None, "Active"), ("b", "y", 1, None, "Active"))
    due = writers.projections_due(n, spark.createDataFrame([], "node_id string, profile string, content_fp string, status string"), "p")
    assert due.count() == 2
    done = due.where("node_id = 'a'").select("node_id", F.lit("p").alias("profile"), "content_fp", F.lit("Ready").alias("status"))
    assert [r["node_id"] for r in writers.projections_due(n, done, "p").collect()] == ["b"] and writers.projections_due(n, done, "q").count() == 2
    results = due.select("node_id", F.lit("p").alias("profile"), F.when(F.col("node_id") == "a", F.col("content_fp")).otherwise("old").alias("content_fp"), F.lit(1).alias("attempt"), F.lit(1).alias("latest_attempt"))
    assert {r["node_id"]: r["status"] for r in writers.install(results, n, "p").collect()} == {"a": "Ready", "b": "Failed"}
    writers.tag(n, str(tmp_path), "v1")
    assert writers.tagged(spark, str(tmp_path), "v1").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        writers.tag(n, str(tmp_path), "v1")


def test_proposed_changes(spark):
    n = nodes(spark, ("a", "x", 1, None, "Active"), ("b", "y", 1, None, "Active"))
    out = {r["node_id"]: (r["state"], r["valid_to_ms"], r["revision"]) for r in writers.apply_changes(n, [{"node_id": "a", "expected": 1, "valid_to_ms": 9}, {"node_id": "b", "expected": 1, "state": "Superseded"}], 5).collect()}
    assert out == {"a": ("Active", 9, 2), "b": ("Superseded", None, 2)}
    with pytest.raises(lifecycle.Conflict):
        writers.apply_changes(n, [{"node_id": "a", "expected": 1, "state": "Retracted"}, {"node_id": "b", "expected": 4, "state": "Retracted"}], 5)
