"""Text queries to plans, and plans to rows over small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from engramlake.functions import expressions as x
from engramlake.plans import engine as g
from engramlake.plans import nodes as p
from engramlake.plans.recalltext import Parser, QueryError, Resolver, duration_ms, parse

BASE = "recall n: Node where n.tenant = 7 and n.kind in (Fact){where} similar to [1.0, 0.0] using model \"text\" topk 20{graph}{score} limit 5{rest}"
OWN = p.and_(p.eq(p.TENANT, p.u32(7)), p.kind_in("Fact"))


def text(where="", graph="", score="", rest=""):
    return BASE.format(where=where, graph=graph, score=score, rest=rest)


def search(filter_=OWN, query=(1.0, 0.0)):
    return p.VectorSearch(query, 20, filter_, "text")


def test_plain():
    assert parse("recall n: Node\n  where n.tenant = 7 and n.kind in (Episode, Fact)\n similar to [1.0, 0.0, 0.0] using model \"text\" topk 20\n limit 5") == p.TopK(p.VectorSearch((1.0, 0.0, 0.0), 20, p.and_(p.eq(p.TENANT, p.u32(7)), p.kind_in("Episode", "Fact")), "text"), 5)


def test_embedded_text():
    assert parse(text().replace("[1.0, 0.0]", 'embed("a b")')) == p.TopK(search(query="a b"), 5)


def test_conditions():
    q = p.and_(OWN, p.Compare(">=", p.CREATED_AT, p.i64(10)), p.Compare("<", p.CREATED_AT, p.i64(-3)), p.eq(p.metadata("project"), p.string("alpha")))
    assert parse(text(' and n.created_at >= 10 and n.created_at < -3 and n.project = "alpha"')) == p.TopK(search(q), 5)
    week = p.and_(OWN, p.Compare(">=", p.CREATED_AT, p.i64(1_000_000_000 - 7 * 86_400_000)))
    assert parse(text(" and n.created_at >= now() - 7d"), now_ms=1_000_000_000) == p.TopK(search(week), 5)


def test_conditions_that_are_left_out():
    assert parse(text(" and n.size > 3 and n.updated_at < 4")) == p.TopK(search(), 5)
    with pytest.raises(QueryError, match="isn't understood"):
        parse(text(" and n.size > 3"), strict=True)


def test_boolean_condition_stands_alone():
    q = p.Or((p.And((p.eq(p.TENANT, p.u32(7)), p.kind_in("Fact"))), p.And((p.Not(p.eq(p.metadata("a"), p.string("x or y"))), p.Compare(">=", p.SCORE, p.f32(0.5))))))
    assert parse(text(' or (not n.a = "x or y" and n.score >= 0.5)')) == p.TopK(search(q), 5)
    with pytest.raises(QueryError, match="can't be parsed"):
        parse(text(" or n.created_at >= now() - 7d"))


def test_graph_clauses():
    assert parse(text(graph=" connected via related-to depth 2")) == p.TopK(p.GraphExpand(search(), "related-to", 2), 5)
    seeds = p.GraphExpand(p.Scan("nodes", p.and_(p.eq(p.TENANT, p.u32(7)), p.eq(p.metadata("k"), p.string("v")))), "r", 1)
    assert parse(text(graph=' connected from (s: Node where s.k = "v") via r depth 1')) == p.TopK(p.Join(search(), seeds), 5)
    assert parse(text(graph=" connected via r depth 300")) == p.TopK(search(), 5)
    with pytest.raises(QueryError):
        parse(text(graph=" connected via r depth 300"), strict=True)


def test_scores():
    s = p.Similarity()
    assert parse(text(score=" score by similarity * decay(n.created_at, half_life = 7d)")) == p.TopK(p.Score(search(), p.Mul(s, p.Decay(p.CREATED_AT, 604_800_000))), 5)
    assert parse(text(score=" score by 0.5 * (similarity + 2) + 1")) == p.TopK(p.Score(search(), p.Add(p.Mul(p.Number(0.5), p.Add(s, p.Number(2))), p.Number(1))), 5)
    assert parse(text(score=' score by udf "mine"')) == p.TopK(p.Udf(search(), "mine"), 5)
    assert parse(text(score=" score by decay(n.size, half_life = 7d)")) == p.TopK(search(), 5)
    with pytest.raises(QueryError):
        parse(text(score=" score by similarity *"), strict=True)


def test_joins_counts_and_fields():
    on = p.Scan("nodes", p.and_(p.eq(p.TENANT, p.u32(7)), p.kind_in("Fact")))
    other = p.Scan("nodes", p.and_(p.eq(p.TENANT, p.u32(7)), p.kind_in("Entity"), p.eq(p.metadata("a"), p.string("b"))))
    plan = p.Join(p.Join(p.TopK(search(), 5), on), other, p.metadata("team"))
    plan = p.Project(p.Aggregate(plan, (p.KIND,)), (p.NODE_ID, p.SCORE, p.metadata("team")))
    assert parse(text(rest=' join m: Node where m.kind in (Fact) on node_id join t: Node where t.kind in (Entity) and t.a = "b" on n.team = t.team count by kind return n.id, score, n.team')) == plan


@pytest.mark.parametrize(
    "query, message",
    [
        ("select 1", "begins with"), (text().replace("n.tenant = 7", "n.x = 7"), "n.tenant"), (text().replace("(Fact)", "(Idea)"), "unknown kind"),
        (text().replace("(Fact)", "(Fact"), "unknown kind|closed"), (text().replace("similar to [1.0, 0.0]", "near"), "similar to"), (text().replace('"text"', "text"), "using model"),
        (text().replace("topk 20", ""), "topk"), (text().replace(" limit 5", ""), "limit"), (text(rest=" return n."), "returned"),
        (text(rest=" join m where m.kind in (Fact) on node_id"), "looks like"), (text(rest=" join m: Node where m.kind in (Fact) on n.a = m.b"), "one name"),
        (text(rest=" join m: Node where m.kind in (Fact) on a"), "on node_id"), (text(rest=" join m: Node where m.kind in (Fact) on x.a = m.a"), "left field"),
    ],
)
def test_errors_have_places(query, message):
    with pytest.raises(QueryError, match=message) as e:
        parse(query)
    assert 0 <= e.value.span[0] <= e.value.span[1] <= len(query)


def test_error_span_is_in_the_text_as_given():
    query = "recall   n: Node\n where n.tenant = 7 and n.kind in (Fact, Idea) similar to [1] using model \"m\" topk 1 limit 1"
    with pytest.raises(QueryError) as e:
        parse(query)
    assert query[slice(*e.value.span)] == "Idea"


def test_resolver():
    parse(text(), Resolver())
    with pytest.raises(QueryError):
        parse(text(), Resolver(models=frozenset({"image"})))
    with pytest.raises(QueryError):
        parse(text(score=' score by udf "f"'), Resolver(functions=frozenset({"g"})))


def test_strict_never_changes_a_plan():
    for q in (text(), text(score=" score by similarity"), text(graph=" connected via r depth 1")):
        assert parse(q) == parse(q, strict=True)


def test_durations():
    assert [duration_ms(d) for d in ("5ms", "5s", "5m", "5h", "5d", "5w", "d")] == [5, 5000, 300_000, 18_000_000, 432_000_000, None, None]


def test_parser_collapses_space_in_quotes():
    assert Parser('recall n where n.a = "x   y"').s == 'recall n where n.a = "x y"'


# Rows

NODES = "node_id string, tenant bigint, kind string, created_at_ms bigint, updated_at_ms bigint, score float, fields map<string,struct<tag:string,value:string>>"


def record(node_id, tenant=1, kind="Fact", at=100, score=0.0, **fields):
    tags = {k: ("bool" if isinstance(v, bool) else "i64" if isinstance(v, int) else "string", str(v).lower() if isinstance(v, bool) else str(v)) for k, v in fields.items()}
    return node_id, tenant, kind, at, at, score, tags


@pytest.fixture(scope="module")
def small(spark):
    rows = [record("a", score=0.6), record("b", at=110, score=0.4), record("c", at=120, score=0.1), record("x", 2, score=1.0)]
    edges = spark.createDataFrame([("a", "c", "related", 1.0)], "src string, dst string, label string, weight float")
    return g.Engine(spark.createDataFrame(rows, NODES), None, edges)


def ids(df):
    return [r["node_id"] for r in df.collect()]


def test_scan_expand_udf_topk(small):
    small.register_udf("boost", lambda i, s: s.where(i != "c", 2.0), ("string", "float"))
    plan = p.Scan("nodes", p.and_(p.eq(p.TENANT, p.u32(1)), p.kind_eq("Fact")))
    plan = p.TopK(p.Udf(p.GraphExpand(plan, "related", 1), "boost", (p.NODE_ID, p.SCORE)), 2)
    assert ids(small.run(plan)) == ["c", "a"]
    with pytest.raises(KeyError):
        small.run(p.Udf(p.Scan(), "none"))


def test_expansion_keeps_the_first_emission(spark):
    rows = [record("a", score=0.9), record("b", score=0.5), record("far")]
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "gone", "r", 1.0), ("gone", "far", "r", 1.0)], "src string, dst string, label string, weight float")
    e = g.Engine(spark.createDataFrame(rows, NODES), None, edges)
    seeds = p.Filter(p.Scan(), p.Compare(">", p.SCORE, p.f32(0.1)))
    got = {r["node_id"]: round(r["score"], 2) for r in e.run(p.GraphExpand(seeds, "r", 2)).collect()}
    assert got == {"a": 0.9, "b": 0.0, "far": 0.0}
    assert e.run(p.GraphExpand(seeds, "r", 0)).count() == 2


def test_counts(spark):
    e = g.Engine(spark.createDataFrame([record("a"), record("b"), record("c", kind="Episode", team="t")], NODES))
    got = [(r["node_id"], r["score"], r["kind"], r["tenant"]) for r in e.run(p.Aggregate(p.Scan(), (p.KIND,))).collect()]
    assert sorted(got) == [("kind=Episode", 1.0, "Fact", 0), ("kind=Fact", 2.0, "Fact", 0)]
    assert [r["score"] for r in e.run(p.Aggregate(p.Scan(), (p.metadata("team"),))).collect()] == [1.0]
    assert ids(e.run(p.Aggregate(p.Scan()))) == ["__aggregate__"] and e.run(p.Aggregate(p.Scan("nodes", p.Or(())))).count() == 0


def test_predicates_have_two_values(spark):
    e = g.Engine(spark.createDataFrame([record("a", n=5, s="x", b=True), record("b", n=1), record("c")], NODES))
    run = lambda q: ids(e.run(p.TopK(p.Filter(p.Scan(), q), 9, p.NODE_ID)))
    n = p.metadata("n")
    assert run(p.Compare(">", n, p.i64(2))) == ["a"] and run(p.Not(p.Compare(">", n, p.i64(2)))) == ["b", "c"]
    assert run(p.eq(n, p.string("5"))) == [] and run(p.eq(n, p.u32(5))) == [] and run(p.eq(n, p.i64(5))) == ["a"]
    assert run(p.Compare(">=", p.TENANT, p.u32(0))) == [] and run(p.Compare(">", p.metadata("s"), p.string("a"))) == []
    assert run(p.And(())) == ["a", "b", "c"] and run(p.Or(())) == [] and run(p.In(p.metadata("s"), (p.string("x"), p.string("y")))) == ["a"]
    assert run(p.eq(p.metadata("b"), p.boolean(True))) == ["a"]


def test_field_order_has_missing_last(spark):
    e = g.Engine(spark.createDataFrame([record("a"), record("b", n=10), record("c", n=9), record("d", n="x")], NODES))
    assert ids(e.run(p.TopK(p.Scan(), 9, p.metadata("n")))) == ["c", "b", "d", "a"]


def test_semi_joins_do_not_multiply(spark):
    e = g.Engine(spark.createDataFrame([record("a", t="1"), record("b", t=1), record("c", t="1", kind="Entity"), record("d", t="1", kind="Entity")], NODES))
    facts, entities = p.Scan("nodes", p.kind_eq("Fact")), p.Scan("nodes", p.kind_eq("Entity"))
    assert ids(e.run(p.Join(facts, entities, p.metadata("t")))) == ["a"] and ids(e.run(p.Join(facts, entities))) == []


def test_projection_skips_missing(spark):
    e = g.Engine(spark.createDataFrame([record("a", score=0.5, k="v", z=1)], NODES))
    r = e.run(p.Project(p.Scan(), (p.metadata("k"), p.metadata("none"), p.SCORE))).first()
    assert {k: v["value"] for k, v in r["fields"].items()} == {"k": "v", "score": "0.5"} and r["node_id"] == "a"


def test_decay_is_the_score_unless_asked(spark):
    e = g.Engine(spark.createDataFrame([record("a", at=0, score=0.5)], NODES), now_ms=2000)
    plan = p.Score(p.Scan(), p.Mul(p.Similarity(), p.Decay(p.CREATED_AT, 1000)))
    assert e.run(plan).first()["score"] == 0.25
    e.decay = "exp"
    assert e.run(plan).first()["score"] == 0.125


def test_fields_of_metadata(spark):
    d = spark.sql("""SELECT 'c' AS content, map('s', '"q\\\\"x"', 'i', '12', 'f', '1.5', 'n', 'null', 'l', '[1]', 'o', '{"a":1}', 'b', 'true', 'content', '"over"') AS m""")
    got = d.select(x.fields_of(F.col("content"), F.col("m")).alias("f")).first()["f"]
    assert {k: (v["tag"], v["value"]) for k, v in got.items()} == {"s": ("string", 'q"x'), "i": ("i64", "12"), "b": ("bool", "true"), "content": ("string", "over")}


def test_optimiser():
    q, r = p.kind_eq("Fact"), p.eq(p.TENANT, p.u32(1))
    assert g.optimise(p.Filter(p.Scan("nodes", q), r)) == p.Scan("nodes", p.and_(q, r))
    assert g.optimise(p.Filter(search(q), r)) == search(p.and_(q, r))
    expand = p.Filter(p.GraphExpand(p.Scan(), "r", 1), q)
    stats = g.Statistics(100, histogram=g.Histogram({(p.KIND, p.kind("Fact")): 0.2}))
    assert g.optimise(expand, stats) == expand
    assert g.optimise(expand, stats, graph_pushdown=True) == p.GraphExpand(p.Scan("nodes", q), "r", 1)
    few, many = p.Scan("nodes", q), p.Scan()
    assert g.optimise(p.Join(p.Join(p.Scan(), many), few), stats) == p.Join(p.Join(p.Scan(), few), many)


def test_estimates_and_explain(small):
    h = g.Histogram({(p.KIND, p.kind("Fact")): 0.2, (p.KIND, p.kind("Episode")): 0.3})
    assert h.of(p.kind_in("Fact", "Episode")) == 0.5 and h.of(p.Or((p.kind_eq("Fact"), p.kind_eq("Episode")))) == pytest.approx(0.44)
    stats = g.Statistics(1000, histogram=h)
    assert g.estimate(p.GraphExpand(p.Scan("nodes", p.kind_eq("Fact")), "r", 2), stats) == 600
    assert g.join_strategy(10, 1000) == "HashBuildLeft" and g.join_strategy(900, 800) == "Merge" and g.join_strategy(None, 1) == "HashBuildRight" and g.join_cost([10, 5, 20]) == 40
    tree = g.explain(p.TopK(p.Scan("nodes", p.eq(p.TENANT, p.u32(1))), 2), stats, small)
    assert tree["operator"] == "TopKOp" and tree["actual"] == 2 and tree["children"][0]["actual"] == 3
    assert g.explain(p.Scan("edges"), stats)["operator"] == "IndexLookupOp"
    with pytest.raises(ValueError):
        small.run(p.Scan("edges"))


def test_builder():
    q = p.Query.recall().filter(p.kind_eq("Fact")).similar_to([1, 0]).using_model("text").topk(20).limit(5).build()
    assert q == p.TopK(p.VectorSearch((1.0, 0.0), 20, p.kind_eq("Fact"), "text"), 5)
    assert p.Query.recall().limit(3).build() == p.TopK(p.Scan(), 3, "created_at")
