"""Vectors, graph, recall, evidence memory and lifecycle over small hand-made tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from engramlake.functions import expressions as x
from engramlake.operators import graph, lifecycle, memory, recall, vector
from engramlake.sources import adapters

EMB = "tenant bigint, model string, node_id string, vector array<float>"
LINK = "src string, dst string, label string, weight float, created_at_ms bigint, valid_from_ms bigint, valid_to_ms bigint, evidence array<string>"


def embeddings(spark, **vectors):
    return spark.createDataFrame([(0, "text", k, [float(y) for y in v]) for k, v in vectors.items()], EMB)


def links(spark, *edges, at=0):
    return spark.createDataFrame([(s, d, k, w, at, None, None, []) for s, d, k, w in edges], LINK)


def nodes(spark, *rows):
    """id, text, created, valid_to, state"""
    d = spark.createDataFrame([(*r, None)[:6] for r in rows], "node_id string, text string, created_at_ms bigint, valid_to_ms bigint, state string, valid_from_ms bigint")
    return d.select("node_id", F.lit(0).cast("bigint").alias("tenant"), F.lit("Fact").alias("kind"), "created_at_ms", F.col("created_at_ms").alias("updated_at_ms"), adapters.text_content(F.col("text")).alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(1).cast("bigint").alias("revision"), "state", "valid_from_ms", "valid_to_ms")


def pairs(df, *c):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect()]


# Vectors


def test_vector_ranking(spark):
    e = embeddings(spark, near=[1, 0.01, 0, 0], far=[0, 0, 1, 0], zero=[0, 0, 0, 0], short=[1, 0])
    got = pairs(vector.top_k(e, [1, 0, 0, 0], 9, "text"), "node_id", "score")
    assert [i for i, _ in got] == ["near", "far", "zero"] and got[1][1] == 0.5 and got[2][1] == 0
    assert vector.top_k(e, [1, 0, 0, 0], 9, "other").count() == 0


@pytest.mark.parametrize("bad", [[], [0, 0], [float("nan"), 1], [float("inf"), 1]])
def test_vector_checks(bad):
    with pytest.raises(ValueError):
        vector.check_vector(bad)
    with pytest.raises(ValueError):
        vector.check_k(100_001)


def test_batch_equals_single(spark):
    e = adapters.embeddings(spark, "/root/testdata/sf0.001")
    q = e.limit(7).select(F.col("node_id").alias("query_id"), "vector")
    by = {}
    for r in vector.batch_top_k(q, e, 5, rows=3).collect():
        by.setdefault(r["query_id"], []).append((-round(r["score"], 6), r["node_id"]))
    for r in q.collect():
        assert sorted(by[r["query_id"]]) == [(-round(s, 6), i) for i, s in pairs(vector.top_k(e, r["vector"], 5, "text"), "node_id", "score")]


def test_batch_in_slabs(spark, monkeypatch):
    """Whatever the slabs: the same plan, ties by node_id wherever equal vectors lie, and vectors that have no direction."""
    import numpy as np

    m = np.random.default_rng(1).standard_normal((300, 7)).astype("f4")
    m[100:200] = m[:100]  # copies
    m[200:240] = m[0]
    m[240], m[241, 3] = 0, np.inf
    v = {f"n{i * 7919 % 1000:03}": m[i].tolist() for i in range(300)} | {"short": [1.0, 0.0]}
    e = spark.createDataFrame([(0, "text", n, x) for n, x in [*v.items(), ("empty", []), ("none", None), ("lacks", [1.0, None, *[0.0] * 5])]], EMB)
    q = e.select(F.col("node_id").alias("query_id"), "vector")

    def product(a, b):
        return sum(float(x) * float(y) for x, y in zip(a, b))

    def score(a, b):
        if not np.isfinite([*a, *b]).all():
            return 1.0
        n = (product(a, a) * product(b, b)) ** 0.5
        return (1 + max(-1.0, min(1.0, product(a, b) / n))) / 2 if n else 0.0

    want = {(i, j) for i, a in v.items() for j in sorted((j for j, b in v.items() if len(a) == len(b)), key=lambda j: (-score(a, v[j]), j))[:6]}
    plans = []
    for rows, size in ((4096, 1 << 20), (150, 150 * 28)):
        monkeypatch.setattr(vector, "NODE_BYTES", size)
        out = vector.batch_top_k(q, e, 6, rows=rows)
        plans.append(out._jdf.queryExecution().executedPlan().toString().count("Arrow"))
        got = out.collect()
        assert {(r["query_id"], r["node_id"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r["score"] - score(v[r["query_id"]], v[r["node_id"]])) < 1e-12 for r in got)
    assert plans[0] == plans[1] == 1
    assert vector.batch_top_k(q, e, 0).count() == vector.batch_top_k(q.limit(0), e, 3).count() == vector.batch_top_k(q, e.limit(0), 3).count() == 0


def test_batch_keeps_bounded_candidates(monkeypatch):
    """Nearly equal vectors all pass the first look: they are settled as they come, and the best are still exact."""
    import numpy as np

    r = np.random.default_rng(2)
    v = (1 + 1e-7 * r.standard_normal((3000, 5))).astype("f4")
    held, dot = [], vector._dot
    monkeypatch.setattr(vector, "_dot", lambda a, b, i=None, j=None: held.append(0 if i is None else len(i)) or dot(a, b, i, j))
    at, to, score = vector.nearest(v[:700], v, 3)
    assert max(held) <= (1 << 16) + vector.TILE[0] * vector.TILE[1]
    d = v.astype("f8")
    for a in (0, 350, 699):
        cosine = np.clip([sum((d[a] * b).tolist()) / (sum((d[a] ** 2).tolist()) * sum((b**2).tolist())) ** 0.5 for b in d], -1, 1)
        assert to[at == a].tolist() == np.lexsort((np.arange(3000), -(1 + cosine) / 2))[:3].tolist()


def test_hybrid(spark):
    e = embeddings(spark, A=[1, 0, 0, 0], B=[0.6, 0.8, 0, 0], C=[0, 0, 1, 0])
    out = pairs(vector.hybrid_search(e, links(spark, ("A", "C", "related", 1.0)), [1, 0, 0, 0], k=3, seed_k=5, direction="out", alpha=0.3, decay=1.0), "node_id", "score")
    assert out == [("C", 0.85), ("A", 0.3), ("B", 0.24)]


def test_embedder(spark):
    d = vector.embed_texts(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda ts: [[float(len(t))] for t in ts])
    assert [r["vector"] for r in d.collect()] == [[2.0], [0.0]]


# Graph


def test_bfs_and_directions(spark):
    e = links(spark, ("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "a", "r", 1.0), ("z", "a", "s", 1.0))
    assert sorted(pairs(graph.bfs(e, "a", 2), "node_id", "hop")) == [("b", 1), ("c", 2)]
    assert sorted(pairs(graph.bfs(e, "a", 1, "both"), "node_id", "hop")) == [("b", 1), ("c", 1), ("z", 1)]
    assert sorted(pairs(graph.bfs(e, "a", 3, "in", "s"), "node_id", "hop")) == [("z", 1)]
    assert [r[0] for r in graph.labels(e).collect()] == ["r", "s"]


def test_edge_checks_and_heads(spark):
    for bad in (("a", "b", "r", 1.5), ("a", "b", "r", float("nan")), ("a", "a", "derived_from", 1.0)):
        with pytest.raises(ValueError):
            graph.add_edge(*bad)
    e = spark.createDataFrame([(0, "a", "b", "r", 1, 0.1), (0, "a", "b", "r", 2, 0.9)], "tenant int, src string, dst string, label string, revision int, weight double")
    assert graph.heads(e).first()["weight"] == 0.9


def test_paths(spark):
    n = nodes(spark, ("a", "", 10, None, "Active"), ("b", "", 20, None, "Active"), ("c", "", 5, None, "Active"), ("d", "", 1, 50, "Active"))
    e = links(spark, ("a", "b", "causes", 0.5), ("c", "a", "contains", 0.5), ("b", "c", "causes", 1.0), ("a", "d", "contains", 1.0))
    found = graph.paths(spark.createDataFrame([("a",)], "seed string"), n, e, 100, 3)
    assert sorted(pairs(found, "node_id", "depth", "weight")) == [("b", 1, 0.5), ("c", 1, 0.5)]
    seen, steps = graph.slice_of(found)
    assert sorted(r[0] for r in seen.collect()) == ["a", "b", "c"] and steps.count() == 2


def test_closure_passes_inactive(spark):
    deps = spark.createDataFrame([("e", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")], "source string, target string")
    records = spark.createDataFrame([("c1", "Superseded"), ("c2", "Active"), ("c3", "Purged")], "record string, state string")
    root = spark.createDataFrame([("e",)], "record string")
    assert [r[0] for r in graph.closure(root, deps, records).collect()] == ["c2"]
    assert [r[0] for r in graph.closure(root, deps, records, active_only=False).collect()] == ["c1", "c2"]


# Text and recall


def test_terms(spark):
    d = spark.createDataFrame([("Foo_1 用户喜 bar-Baz é",)], "t string")
    assert d.select(x.lexical_terms(F.col("t"))).first()[0] == ["foo_1", "bar", "baz", "用", "户", "喜", "用户", "户喜"]
    assert d.select(x.evidence_terms(F.col("t"))).first()[0] == ["foo_1", "bar", "baz", "é", "用", "户", "喜", "用户", "户喜"]
    assert x.json_strings('{"a": ["b", {"c": 1}], "d": "e"}') == ["a", "b", "c", "d", "e"] and x.json_strings("{") == []


def test_bm25_of_cjk(spark):
    d = spark.createDataFrame([("a", "用户喜欢乌龙茶"), ("b", "另一个"), ("c", None)], "node_id string, text string")
    out = recall.bm25(d, "乌龙茶").collect()
    assert [r["id"] for r in out] == ["a"] and set(out[0]["terms"]) == {"乌", "龙", "茶", "乌龙", "龙茶"}


def test_texts_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        reads.add(1)
        return t

    d = spark.createDataFrame([("a", "tea Tea green"), ("b", "green"), ("c", None), ("d", "tea " + "x" * 257)], "node_id string, text string")
    out = pairs(recall.bm25(d, "TEA", text=seen("text")), "id", "score")
    assert reads.value == 4
    idf, mean = math.log(1 + 2.5 / 2.5), 5 / 4
    part = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert out == sorted([("a", round(part(2, 3), 6)), ("d", round(part(1, 1), 6))], key=lambda r: -r[1])
    n = nodes(spark, ("a", "tea", 1, None, "Active"), ("b", "no", 1, None, "Active"))
    assert [r["id"] for r in recall.recall(n, links(spark, ("a", "b", "r", 1.0)), recall.Request("tea", 10), text=seen("content.text")).collect()] == ["a", "b"]
    assert reads.value == 6


def test_terms_in_python_are_the_same(spark):
    texts = ["Foo_1 用户喜 bar-Baz é", "K\u212A\u0130x _", "x" * 256 + " " + "y" * 257, "", " \n", "カタ 漢a", "a" * 300 + "用" * 300, "\U00020000 \ud7ff\u3040\u00b5_9"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select(F.lower("t").alias("low"), x.lexical_terms(F.col("t")).alias("terms")).collect():
        assert [t.decode() for t in recall.terms_of(r["low"].encode())] == r["terms"]


def test_temporal_causal_and_conflict_recall(spark):
    n = nodes(
        spark, ("active", "weather is sunny", 50, None, "Active"), ("future", "weather future", 150, None, "Active"), ("expired", "weather expired", 20, 90, "Active"),
        ("superseded", "weather superseded", 10, None, "Superseded"), ("historical", "historical marker", 10, 80, "Superseded"),
        ("contradiction", "sky is green", 40, None, "Active"), ("causal_past", "past effect", 10, None, "Active"),
    )
    e = links(spark, ("active", "contradiction", "contradicts", 1.0), ("active", "causal_past", "causes", 1.0), at=60)
    out = {r["id"]: r for r in recall.recall(n, e, recall.Request("weather", 100, depth=2)).collect()}
    assert set(out) == {"active", "contradiction"} and out["active"]["conflicts"] == ["contradiction"] and not out["active"]["verified"]
    assert recall.recall(n, e, recall.Request("historical marker", 70)).first()["id"] == "historical"
    assert recall.recall(n, e, recall.Request("weather", 100, filter=recall.Filter(require_verified=True))).count() == 0
    assert recall.recall(n, e, recall.Request("weather", 100, limit=0)).count() == 0


def test_provenance_verifies(spark):
    n = nodes(spark, ("f", "tea is green", 1, None, "Active"), ("src", "note", 1, None, "Active"))
    e = links(spark, ("f", "src", "derived_from", 1.0))
    r = recall.recall(n, e, recall.Request("tea", 10, depth=0, filter=recall.Filter(require_verified=True))).first()
    assert r["id"] == "f" and r["sources"] == ["src"] and r["verified"]


def test_vector_branch_with_threshold(spark):
    n = nodes(spark, ("a", "one", 1, None, "Active"), ("b", "two", 1, None, "Active"))
    e = embeddings(spark, a=[1, 0], b=[-1, 0.1])
    q = recall.Request("none", 10, lexical=False, depth=0, vectors=(("text", (1.0, 0.0), 2.0, 0.5),))
    assert pairs(recall.recall(n, links(spark, ("a", "z", "r", 1.0)), q, e), "id", "score") == [("a", round(2 / 61, 6))]


def test_adjudication(spark):
    items = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert [r["id"] for r in recall.adjudicate(items, texts, lambda rows: ["b"])] == ["b"]
    with pytest.raises(ValueError):
        recall.adjudicate(items, texts, lambda rows: ["b", "b"])


# Evidence memory


def evidence(spark, *rows):
    d = spark.createDataFrame(rows, "record string, class string, observed_at_ms bigint, text string, state string")
    return d.select("record", F.lit("Evidence").alias("type"), "class", "state", F.struct(F.lit("Personal").alias("kind"), F.lit("u").alias("id")).alias("scope"), "observed_at_ms", F.lit(None).cast("bigint").alias("valid_from_ms"), F.lit(None).cast("bigint").alias("valid_to_ms"), "text")


def test_evidence_recall(spark):
    r = evidence(
        spark, ("1", "UserAssertion", 100, "我喜欢本地记忆系统", "Active"), ("2", "UserAssertion", 300, "稍后的记忆系统记录", "Active"), ("3", "UserAssertion", 150, "Résumé  notes", "Active"),
        ("4", "AssistantUtterance", 150, "记忆系统", "Active"), ("5", "UserAssertion", 150, "记忆系统", "Retracted"),
    )
    get = lambda *a, **k: [(q["record"], q["exact"]) for q in memory.recall(r, *a, **k).collect()]
    assert get("记忆系统", start=0, end=200) == [("1", False)]
    assert get("我喜欢本地记忆系统")[0] == ("1", True)
    assert get("RÉSUMÉ") == [("3", False)] and get(" résumé notes") == [("3", True)]
    assert get("", start=250, end=350) == [("2", False)] and get("") == []
    assert get("记忆系统", scopes=[("Personal", "other")]) == []
    assert [q["record"] for q in memory.turn_recall(r, "2", "记忆系统").collect()] == ["1"]
    support = spark.createDataFrame([("1", "5")], "record string, evidence string")
    assert [q["record"] for q in memory.recall(r, "记忆系统", support=support).collect()] == ["2"]
    with pytest.raises(ValueError):
        memory.recall(r, "x", limit=101)


def test_activation(spark):
    pins = spark.createDataFrame([("first", 0), ("second", 1)], "record string, baseline int")
    signals = spark.createDataFrame([("first", "second", "d", 800_000), ("second", "first", "d", -3), ("other", "first", "d", 9)], "from_record string, to_record string, dimension string, score_micros int")
    weights = spark.createDataFrame([("d", 1_000_000)], "dimension string, weight_micros int")
    parts, totals = memory.activate(pins, signals, weights)
    assert sorted(pairs(parts, "from_record", "micros")) == [("first", 800_000), ("second", -3)]
    assert pairs(totals.orderBy("shadow_rank"), "record", "total", "shadow_rank") == [("second", 800_000, 0), ("first", -3, 1)]
    half = spark.createDataFrame([("d", 500_000)], "dimension string, weight_micros int")
    assert {r["record"]: r["total"] for r in memory.activate(pins, signals, half)[1].collect()} == {"second": 400_000, "first": -1}


def test_heads_inspect_and_purge(spark):
    rev = spark.createDataFrame([("a", 1, "Active"), ("a", 2, "Retracted"), ("b", 1, "Active"), ("b", 2, "Purged")], "record string, revision bigint, state string")
    pay = spark.createDataFrame([("a", "p"), ("b", "q")], "record string, payload string")
    assert memory.inspect(rev, pay, "a").first()["state"] == "Retracted" and memory.inspect(rev, pay, "a", 1).first()["payload"] == "p"
    assert memory.inspect(rev, pay, "b", 1).first()["payload"] is None
    gone = memory.purge(rev, spark.createDataFrame([("a",)], "record string"), 9).first()
    assert (gone["revision"], gone["state"]) == (3, "Purged")
    deps = spark.createDataFrame([("a", "b")], "source string, target string")
    heads = memory.heads(rev)
    sig = spark.createDataFrame([("s", "a", "z")], "signal_id string, from_record string, to_record string")
    trace = spark.createDataFrame([("t", "a")], "trace_id string, record string")
    assert tuple(memory.purge_preview(spark.createDataFrame([("a",)], "record string"), deps, heads, pay, sig, trace).first()) == (1, 1, 1, 1)


def test_availability(spark):
    ev = spark.createDataFrame([("e", 2, "Active")], "evaluator_id string, revision int, state string")
    pr = spark.createDataFrame([("ok", "Active", "e", 2, 1), ("old", "Active", "e", 1, 1), ("none", "Active", "x", 1, 1), ("off", "Retired", "e", 2, 1)], "profile_id string, state string, evaluator_id string, evaluator_revision int, revision int")
    assert {r[0]: r[1] for r in memory.profile_availability(pr, ev).collect()} == {"ok": "Available", "old": "EvaluatorStale", "none": "EvaluatorMissing", "off": "ProfileInactive"}
    s = spark.createDataFrame([(n, st, pid, 1, "a", to) for n, st, pid, to in (("1", "Active", "ok", "b"), ("2", "Purged", "old", "b"), ("3", "Active", "ok", "b"), ("4", "Active", "old", "b"), ("5", "Active", "ok", "gone"))], "signal_id string, state string, profile_id string, profile_revision int, from_record string, to_record string")
    pay = spark.createDataFrame([("1",), ("2",), ("4",), ("5",)], "signal_id string")
    rec = spark.createDataFrame([("a", "Active"), ("b", "Active"), ("gone", "Retracted")], "record string, state string")
    assert {r[0]: r[1] for r in memory.signal_availability(s, pay, pr, ev, rec).collect()} == {"1": "Available", "2": "Purged", "3": "PayloadMissing", "4": "EvaluatorStale", "5": "SourceInactive"}


def test_authority():
    memory.check_capture("User", "UserAssertion")
    memory.check_capture("System", "AssistantCommitment", "Completed")
    for actor, kind, turn, error in (("Assistant", "UserAssertion", None, PermissionError), ("User", "ArtifactPassage", None, ValueError), ("System", "AssistantCommitment", None, ValueError)):
        with pytest.raises(error):
            memory.check_capture(actor, kind, turn)
    own = {"class": "UserAssertion", "state": "Active", "scope": ("Personal", "u")}
    memory.check_claim("User", "UserPreference", ("Personal", "u"), [own])
    for actor, domain, sources, error in (("Assistant", "UserNote", [own], PermissionError), ("User", "SystemFact", [own], ValueError), ("User", "UserNote", [], ValueError), ("User", "ExternalFact", [{**own, "class": "ImportedSource"}], PermissionError)):
        with pytest.raises(error):
            memory.check_claim(actor, domain, ("Personal", "u"), sources)
    memory.check_relation("User", "Supports", ("Evidence", "1"), ("Claim", "2"), ["UserAssertion"])
    with pytest.raises(ValueError):
        memory.check_relation("User", "CanonicalizesTo", ("Claim", "1"), ("Entity", "2"), [])
    memory.check_adjudication("User", "ExplicitUser")
    with pytest.raises(PermissionError):
        memory.check_adjudication("Assistant", "ExplicitUser")
    memory.check_signals([{"from": "a", "to": "b", "scores": {"d": 5}}], {"d"})
    with pytest.raises(ValueError):
        memory.check_signals([{"from": "a", "to": "a", "scores": {"d": 5}}], {"d"})


# Lifecycle


def test_time_scan(spark):
    n = nodes(spark, ("a", "", 10, None, "Active"), ("b", "", 20, None, "Active"), ("neg", "", -5, None, "Active"))
    assert [r["node_id"] for r in lifecycle.scan_by_time(n, -10, 20).collect()] == ["a"]


def test_insert_retract_delete(spark):
    n = nodes(spark, ("a", "", 10, None, "Active"), ("p", "", 10, None, "Pending"))
    new = lifecycle.insert(n, n.where("node_id = 'a'").withColumn("created_at_ms", F.lit(None).cast("bigint")), 3, 99).first()
    assert (new["tenant"], new["revision"], new["created_at_ms"], new["valid_from_ms"]) == (3, 2, 99, 99)
    gone = lifecycle.retract(n, "a", 50).first()
    assert (gone["state"], gone["valid_to_ms"], gone["revision"]) == ("Retracted", 50, 2)
    assert lifecycle.retract(n, "p", 50).first()["valid_to_ms"] == 10
    with pytest.raises(lifecycle.Conflict):
        lifecycle.retract(n, "a", 50, 7)
    assert lifecycle.delete(n, spark.createDataFrame([("a",)], "id string")).count() == 1


def test_state(spark):
    s = spark.createDataFrame([("k1", "1", 1, False, 0), ("k1", None, 2, True, 0), ("k2", "x", 1, False, 0), ("k3", "y", 1, False, 0)], "key string, json string, revision bigint, deleted boolean, updated_at_ms bigint")
    assert lifecycle.state_get(s, "k1").count() == 0
    assert [r["key"] for r in lifecycle.state_scan(s, "k", "k2", 5).collect()] == ["k3"] and [r["key"] for r in lifecycle.state_scan(s, "k", limit=1).collect()] == ["k2"]
    change = lambda *rows: spark.createDataFrame(rows, "key string, json string, expected bigint")
    got = {r["key"]: (r["revision"], r["deleted"]) for r in lifecycle.state_apply(s, change(("k1", "2", 2), ("k2", None, None), ("new", "1", 0)), 5).collect()}
    assert got == {"k1": (3, False), "k2": (2, True), "new": (1, False)}
    with pytest.raises(lifecycle.Conflict):
        lifecycle.state_apply(s, change(("k2", "2", 7), ("k3", "1", 1)), 5)
    out = {r["key"]: r["deleted"] for r in lifecycle.state_replace_prefix(s, "k", spark.createDataFrame([("k2", "n")], "key string, json string"), 5).collect()}
    assert out == {"k2": False, "k3": True}


def test_access_and_audit(spark):
    a = spark.createDataFrame([("a", 2, 5), ("b", 1, 9)], "node_id string, access_count bigint, last_accessed bigint")
    assert [tuple(r) for r in lifecycle.merge_access(a, spark.createDataFrame([("b", "a")], "source string, target string")).collect()] == [("a", 3, 9)]
    log = spark.createDataFrame([(i, "o", "act", i * 10) for i in range(6)], "audit_id int, operation_id string, action string, at_ms int")
    assert [r["audit_id"] for r in lifecycle.audit_scan(log, "o", "act", 10, 40, 2).collect()] == [3, 4]
    assert [r["audit_id"] for r in lifecycle.audit_scan(log, limit=2, oldest=True).collect()] == [0, 1]


def test_sanitising(spark):
    d = spark.createDataFrame([('{"a": [{"Token": 1, "b": 2}], "password": "x"}', "fetch  https://h failed Bearer abc bearer bearer token=1 ok")], "j string, e string")
    r = d.select(lifecycle.sanitise_json(F.col("j")).alias("j"), lifecycle.sanitise_error(F.col("e")).alias("e")).first()
    assert json.loads(r["j"]) == {"a": [{"b": 2}]} and r["e"] == "fetch [redacted] failed Bearer [redacted] Bearer [redacted] [redacted] ok"


def test_blobs(spark):
    b = lifecycle.put_blobs(spark.createDataFrame([(b"x",), (b"x",), (b"y" * 70_000,)], "content binary"))
    got = {r["size"]: (r["refcount"], r["chunked"], r["inline"] is None) for r in b.collect()}
    assert got == {1: (2, False, False), 70_000: (1, True, True)}
    large = b.where("chunked").select("hash", F.lit(-1).alias("delta"))
    left = lifecycle.refcounts(b, large)
    assert lifecycle.collectable(left).count() == 1 and lifecycle.orphans(b.select("hash").unionByName(spark.createDataFrame([("z",)], "hash string")), b).first()["hash"] == "z"


def test_consolidation(spark):
    n = nodes(spark, ("a", "xxxx", 1, None, "Active"), ("b", "yyyyyy", 2, None, "Active"), ("c", "z", 3, None, "Active"), ("out", "o", 0, None, "Active"))
    n = n.withColumn("metadata", F.when(F.col("node_id") == "out", F.create_map(F.lit("consolidation_run"), F.lit('"r"'))).otherwise(F.col("metadata")))
    done = lambda *i: spark.createDataFrame([(y,) for y in i], "node_id string")
    get = lambda **k: [r["node_id"] for r in lifecycle.consolidation_sources(n, k.pop("done", done()), **k).orderBy("place").collect()]
    assert get() == ["a", "b", "c", "out"] and get(max_bytes=9) == ["a"] and get(max_nodes=2) == ["a", "b"]
    assert get(done=done("a")) == ["b", "c", "out"] and get(done=done("a", "b", "c")) == []
    run = lifecycle.Run("r1", ("a", "b"))
    staged = lifecycle.consolidate(run, lambda: [], lambda rows: [{"kind": "Fact", "text": "t", "cites": ["a"]}])
    assert staged.outputs[0]["state"] == "Pending" and staged.outputs[0]["edges"] == [("a", "derived_from", 1.0)]
    assert lifecycle.complete(staged, {"a": 1, "b": 1}, {"a": 1, "b": 1}).status == "Completed"
    with pytest.raises(lifecycle.Conflict):
        lifecycle.complete(staged, {"a": 2, "b": 1}, {"a": 1, "b": 1})
    with pytest.raises(ValueError):
        lifecycle.consolidate(run, lambda: [], lambda rows: [{"cites": ["zz"]}])
    back, kept = lifecycle.revert(lifecycle.Run("r", ("a",), "Completed", ({"node_id": "n1"}, {"node_id": "n2"})), frozenset({"n2"}))
    assert back.status == "Reverted" and [o["node_id"] for o in kept] == ["n2"] and lifecycle.repair(run).status == "Repaired" and lifecycle.due(32)


def test_proposals(spark):
    p = lifecycle.Proposal("1", {"e": 1}, ({"draft": "d", "cites": ["e"]},)).check()
    assert p.reviewed("Approve").adjudicated(True, {"e": (1, "Active")}).status == "Applied"
    assert p.reviewed("NeedsUser").adjudicated(True, {"e": (2, "Active")}).status == "Stale" and p.reviewed("Approve").adjudicated(False, {}).status == "Rejected"
    for bad in (lambda: p.reviewed("Approve", ({"pin": "e"},)), lambda: p.reviewed("Reject", ({"pin": "zz"},)), lambda: lifecycle.Proposal("1", {}, ()).check(), lambda: lifecycle.Proposal("1", {"e": 1}, ({"target": "e", "cites": ["e"]},)).check()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(lifecycle.Conflict):
        p.reviewed("Reject").adjudicated(True, {})
    ops = spark.createDataFrame([("o", "d1", "r")], "operation_id string, digest string, receipt string")
    assert lifecycle.replayed(ops, "o", "d1") == "r" and lifecycle.replayed(ops, "n", "d") is None
    with pytest.raises(lifecycle.Conflict):
        lifecycle.replayed(ops, "o", "d2")
    ps = spark.createDataFrame([(str(i), "Pending" if i % 2 else "Applied") for i in range(6)], "proposal_id string, status string")
    assert [r[0] for r in lifecycle.proposal_list(ps, ("Pending",), 2).collect()] == ["5", "3"]
