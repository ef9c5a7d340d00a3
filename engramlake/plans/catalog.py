"""Queries of the engine's own operators over the supplied tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from engramlake.functions import expressions as x
from engramlake.operators import graph, lifecycle, memory, recall as ranked, vector
from engramlake.plans import nodes as p
from engramlake.plans.engine import Engine
from engramlake.plans.recalltext import parse
from engramlake.sources import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NODES = """nodes AS (
  SELECT 'doc:' || doc_id AS node_id, 'Fact' AS kind, doc_id * 1000 AS created_at_ms, text, lang, source, n_chars, NULL::VARCHAR AS mktsegment, NULL::INT AS label FROM documents
  UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'Episode', conv_id * 1000 + turn, text, NULL, NULL, NULL, NULL, NULL FROM conversations
  UNION ALL SELECT 'cust:' || c_custkey, 'Entity', c_custkey * 1000, c_name, NULL, NULL, NULL, c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'page:' || page_id, 'Artifact', page_id * 1000, url, NULL, NULL, NULL, NULL, NULL FROM pages
  UNION ALL SELECT 'vec:' || vec_id, (['Episode', 'Fact', 'Entity', 'Artifact'])[label % 4 + 1], vec_id * 1000, NULL, NULL, NULL, NULL, NULL, label FROM embeddings)"""
_VEC = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
v AS (SELECT 'vec:' || vec_id AS node_id, vec_id, label, (['Episode', 'Fact', 'Entity', 'Artifact'])[label % 4 + 1] AS kind, vec_id * 1000 AS created_at_ms,
  least(1, greatest(0, (1 + list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])) / 2)) AS score FROM embeddings, q)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession, sf: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, **more) -> Engine:
    n = a.all_nodes(spark, sf) if nodes is None else nodes
    return Engine(a.records(n), a.embeddings(spark, sf), edges, **more)


def _vectors(spark: SparkSession, sf: str, **more) -> Engine:
    return _engine(spark, sf, a.vector_nodes(spark, sf), **more)


def _query_vector(spark: SparkSession, sf: str) -> tuple[float, ...]:
    return tuple(a.read(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _ids(df: DataFrame) -> DataFrame:
    return df.select("node_id")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("node_id", F.round(F.col("score").cast("double"), 5).alias("score"))


# Scans and sources


@query(f"WITH {_NODES} SELECT node_id, created_at_ms FROM nodes WHERE kind = 'Fact' AND created_at_ms > 100000 AND lang = 'en'")
def scan_filter_kind(spark, sf):
    q = p.and_(p.eq(p.TENANT, p.u32(0)), p.kind_eq("Fact"), p.created_after(100_000), p.eq(p.metadata("lang"), p.string("en")))
    return _engine(spark, sf).run(p.Scan("nodes", q)).select("node_id", "created_at_ms")


@query(f"WITH {_NODES} SELECT node_id, created_at_ms FROM nodes WHERE created_at_ms >= 5000 AND created_at_ms < 90000 ORDER BY created_at_ms, node_id LIMIT 50")
def scan_by_time(spark, sf):
    return lifecycle.scan_by_time(a.all_nodes(spark, sf), 5000, 90_000, 50).select("node_id", "created_at_ms")


@query(f"WITH {_NODES} SELECT node_id, kind, created_at_ms, created_at_ms AS updated_at_ms FROM nodes")
def node_headers(spark, sf):
    return lifecycle.meta(a.all_nodes(spark, sf))


@query("SELECT 'doc:' || doc_id AS node_id, text FROM documents WHERE doc_id = 7")
def point_get(spark, sf):
    return lifecycle.get(a.fact_nodes(spark, sf), "doc:7").select("node_id", F.col("content.text").alias("text"))


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE lang = 'fr' AND source = 'src3'")
def metadata_lookup(spark, sf):
    return _ids(lifecycle.by_metadata(a.all_nodes(spark, sf), {"lang": '"fr"', "source": '"src3"'}))


@query("SELECT DISTINCT label FROM (SELECT 'contains' AS label FROM conversations UNION ALL SELECT 'related' FROM orders)")
def edge_labels(spark, sf):
    return graph.labels(a.contains_edges(spark, sf).unionByName(a.related_edges(spark, sf)))


# Predicates and projection


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE NOT coalesce(n_chars > 2000, false) AND NOT coalesce(label = 3, false)")
def predicate_not_missing(spark, sf):
    q = p.and_(p.Not(p.Compare(">", p.metadata("n_chars"), p.i64(2000))), p.Not(p.eq(p.metadata("label"), p.i64(3))))
    return _ids(_engine(spark, sf).run(p.Filter(p.Scan(), q)))


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE kind IN ('Artifact') OR mktsegment IN ('BUILDING', 'MACHINERY') OR label <= 2")
def predicate_or_in(spark, sf):
    segments = p.In(p.metadata("mktsegment"), (p.string("BUILDING"), p.string("MACHINERY")))
    q = p.Or((p.kind_in("Artifact"), segments, p.Compare("<=", p.metadata("label"), p.i64(2))))
    return _ids(_engine(spark, sf).run(p.Filter(p.Scan(), q)))


@query("SELECT 'doc:' || doc_id AS node_id FROM documents WHERE false")
def predicate_types_differ(spark, sf):
    """A tenant isn't ordered, and a whole number isn't equal to a string."""
    q = p.Or((p.Compare(">=", p.TENANT, p.u32(0)), p.eq(p.metadata("n_chars"), p.string("416")), p.And((p.Or(()),))))
    return _ids(_engine(spark, sf, a.fact_nodes(spark, sf)).run(p.Filter(p.Scan(), q)))


@query(f"WITH {_NODES} SELECT node_id, kind, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM nodes WHERE kind = 'Fact' AND label IS NULL")
def project_fields(spark, sf):
    out = _engine(spark, sf, a.fact_nodes(spark, sf)).run(p.Project(p.Scan(), (p.metadata("lang"), p.metadata("n_chars"), p.metadata("none"))))
    get = lambda k: F.element_at("fields", F.lit(k))["value"].alias(k)
    return out.select("node_id", "kind", get("lang"), get("n_chars"))


# Scores and top-k


@query(f"WITH {_VEC} SELECT node_id, round(s * 0.5 + 0.25 + s * s, 5) AS score FROM (SELECT node_id, CAST(score AS FLOAT)::DOUBLE AS s FROM v ORDER BY score DESC, node_id LIMIT 20)")
def score_expression(spark, sf):
    half = p.Add(p.Mul(p.Similarity(), p.Number(0.5)), p.Number(0.25))
    decayed = p.Mul(p.Similarity(), p.Decay(p.CREATED_AT, 86_400_000))
    return _scored(_vectors(spark, sf).run(p.Score(p.VectorSearch(_query_vector(spark, sf), 20), p.Add(half, decayed))))


@query(f"WITH {_NODES} SELECT node_id, created_at_ms FROM nodes ORDER BY created_at_ms DESC, node_id LIMIT 25")
def topk_created(spark, sf):
    return _engine(spark, sf).run(p.Query.recall().limit(25).build()).select("node_id", "created_at_ms")


@query(f"WITH {_NODES} SELECT node_id, n_chars FROM nodes WHERE kind = 'Fact' ORDER BY n_chars NULLS LAST, node_id LIMIT 1200")
def topk_field_nulls_last(spark, sf):
    out = _engine(spark, sf).run(p.TopK(p.Scan("nodes", p.kind_eq("Fact")), 1200, p.metadata("n_chars")))
    return out.select("node_id", F.element_at("fields", F.lit("n_chars"))["value"].cast("bigint").alias("n_chars"))


@query(f"WITH {_VEC}, t AS (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 30) SELECT node_id, round(greatest(0, 1 - score), 4) AS score FROM t ORDER BY 1 - score DESC, node_id LIMIT 12")
def udf_score(spark, sf):
    e = _vectors(spark, sf)
    e.register_udf("novelty", lambda s: (1 - s).clip(lower=0))
    out = e.run(p.TopK(p.Udf(p.VectorSearch(_query_vector(spark, sf), 30), "novelty"), 12))
    return out.select("node_id", F.round(F.col("score").cast("double"), 4).alias("score"))


# Counts


@query(f"WITH {_NODES} SELECT 'kind=' || kind AS node_id, CAST(count(*) AS DOUBLE) AS score FROM nodes GROUP BY kind")
def count_by_kind(spark, sf):
    return _engine(spark, sf).run(p.Aggregate(p.Scan(), (p.KIND,))).select("node_id", F.col("score").cast("double").alias("score"))


@query(f"WITH {_NODES} SELECT 'lang=' || lang || '|source=' || source AS node_id, CAST(count(*) AS DOUBLE) AS score FROM nodes WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def count_by_fields(spark, sf):
    return _engine(spark, sf).run(p.Aggregate(p.Scan(), (p.metadata("lang"), p.metadata("source")))).select("node_id", F.col("score").cast("double").alias("score"))


@query("SELECT '__aggregate__' AS node_id, CAST(count(*) AS DOUBLE) AS score FROM documents HAVING count(*) > 0")
def count_global(spark, sf):
    return _engine(spark, sf, a.fact_nodes(spark, sf)).run(p.Aggregate(p.Scan())).select("node_id", F.col("score").cast("double").alias("score"))


@query("SELECT '__aggregate__' AS node_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE false")
def count_global_of_nothing(spark, sf):
    e = _engine(spark, sf, a.fact_nodes(spark, sf))
    return e.run(p.Aggregate(p.Scan("nodes", p.Or(())))).select("node_id", F.col("score").cast("double").alias("score"))


@query(f"WITH {_NODES} SELECT CAST(0 AS BIGINT) AS tenant, kind, count(*) AS n FROM nodes GROUP BY kind")
def tenant_statistics(spark, sf):
    return lifecycle.statistics(a.all_nodes(spark, sf))


# Semi joins


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE kind = 'Fact' AND node_id IN (SELECT node_id FROM nodes WHERE lang = 'de')")
def semi_join_node_id(spark, sf):
    left, right = p.Scan("nodes", p.kind_eq("Fact")), p.Scan("nodes", p.eq(p.metadata("lang"), p.string("de")))
    return _ids(_engine(spark, sf).run(p.Join(left, right)))


@query(f"WITH {_NODES} SELECT node_id FROM nodes l WHERE EXISTS (SELECT 1 FROM nodes r WHERE r.n_chars > 9000 AND r.source = l.source)")
def semi_join_field(spark, sf):
    right = p.Scan("nodes", p.Compare(">", p.metadata("n_chars"), p.i64(9000)))
    return _ids(_engine(spark, sf).run(p.Join(p.Scan(), right, p.metadata("source"))))


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE kind = 'Fact' AND lang = 'en' AND n_chars > 500 AND source = 'src2'")
def semi_join_chain(spark, sf):
    s = lambda q: p.Scan("nodes", q)
    plan = p.Join(p.Join(p.Join(s(p.kind_eq("Fact")), s(p.eq(p.metadata("lang"), p.string("en")))), s(p.Compare(">", p.metadata("n_chars"), p.i64(500)))), s(p.eq(p.metadata("source"), p.string("src2"))))
    return _ids(_engine(spark, sf).run(plan))


# Vectors


@query(f"WITH {_VEC} SELECT node_id, kind, round(score, 5) AS score FROM v ORDER BY v.score DESC, node_id LIMIT 5")
def vector_topk_exact(spark, sf):
    out = _vectors(spark, sf).run(p.TopK(p.VectorSearch(_query_vector(spark, sf), 20), 5))
    return out.select("node_id", "kind", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"WITH {_VEC}, t AS (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 20) SELECT node_id, round(score, 5) AS score FROM t WHERE kind = 'Fact'")
def vector_post_filter(spark, sf):
    return _scored(_vectors(spark, sf).run(p.VectorSearch(_query_vector(spark, sf), 20, p.kind_eq("Fact"))))


@query(f"WITH {_VEC} SELECT node_id, round(score, 5) AS score FROM v WHERE kind = 'Fact' ORDER BY v.score DESC, node_id LIMIT 20")
def vector_pre_filter(spark, sf):
    return _scored(_vectors(spark, sf).run(p.VectorSearch(_query_vector(spark, sf), 20, p.kind_eq("Fact"), mode="pre")))


@query(f"WITH {_VEC} SELECT node_id, round(score, 5) AS score FROM v WHERE kind IN ('Fact', 'Entity') AND created_at_ms BETWEEN 20000 AND 300000 AND label = 2 ORDER BY v.score DESC, node_id LIMIT 15")
def vector_filtered(spark, sf):
    n = a.vector_nodes(spark, sf)
    return _scored(vector.filtered_top_k(a.embeddings(spark, sf), n, _query_vector(spark, sf), 15, "text", ("Fact", "Entity"), 20_000, 300_000, {"label": "2"}))


@query(
    """WITH s AS (SELECT a.vec_id AS query_id, 'vec:' || b.vec_id AS node_id, least(1, greatest(0, (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2)) AS score FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM s) SELECT query_id, node_id, round(score, 5) AS score FROM r WHERE r <= 10"""
)
def vector_batch_topk(spark, sf):
    q = a.read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.batch_top_k(q, a.embeddings(spark, sf), 10).select("query_id", "node_id", F.round("score", 5).alias("score"))


def _sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """An edge from each vector to the one after the next."""
    e = a.read(spark, sf, "embeddings").select("vec_id")
    name = lambda c: F.concat(F.lit("vec:"), c)
    return e.select(name(F.col("vec_id")).alias("src"), name(F.col("vec_id") + 2).alias("dst"), F.lit("related").alias("label"), F.lit(1.0).cast("float").alias("weight"))


@query(
    f"""WITH {_VEC}, s AS (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 20),
part AS (SELECT node_id, 0.7 * score AS x FROM s UNION ALL SELECT 'vec:' || (vec_id + 2), 0.3 * score * 0.5 FROM s UNION ALL SELECT 'vec:' || (vec_id - 2), 0.3 * score * 0.5 FROM s WHERE vec_id >= 2)
SELECT node_id, round(sum(x), 5) AS score FROM part GROUP BY node_id ORDER BY sum(x) DESC, node_id LIMIT 10"""
)
def hybrid_hop1(spark, sf):
    return _scored(vector.hybrid_search(a.embeddings(spark, sf), _sequence_edges(spark, sf), _query_vector(spark, sf)))


# Graph


@query(
    """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT * FROM c WHERE turn = 0)
SELECT DISTINCT 'conv:' || c.conv_id || ':' || c.turn AS node_id, CAST(0 AS DOUBLE) AS score FROM c JOIN s USING (conv_id) WHERE c.turn <= 2 AND (c.turn < 2 OR (c.conv_id, 1) IN (SELECT (conv_id, turn) FROM c))"""
)
def graph_expand_depth2(spark, sf):
    n = a.episode_nodes(spark, sf)
    first = p.Filter(p.Scan(), p.eq(p.metadata("turn0"), p.boolean(True)))
    marked = n.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("turn0"), F.when(F.col("node_id").endswith(":0"), F.lit("true")).otherwise(F.lit("false"))))).dropDuplicates(["node_id"])
    out = Engine(a.records(marked), None, a.contains_edges(spark, sf)).run(p.GraphExpand(first, "contains", 2))
    return out.select("node_id", F.col("score").cast("double").alias("score"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'conv:' || x.conv_id || ':' || x.turn AS s, 'conv:' || x.conv_id || ':' || (x.turn + 1) AS d FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e),
r(seed, node_id, hop) AS (SELECT DISTINCT 'conv:' || conv_id || ':1', 'conv:' || conv_id || ':1', 0 FROM conversations WHERE turn = 1 UNION SELECT seed, b.d, hop + 1 FROM r JOIN b ON b.s = r.node_id WHERE hop < 3)
SELECT seed, node_id, CAST(min(hop) AS INT) AS hop FROM r GROUP BY seed, node_id HAVING min(hop) > 0"""
)
def graph_bfs_both(spark, sf):
    """What is within three hops, either way, of the second turn of every conversation."""
    seeds = a.episode_nodes(spark, sf).where(F.col("node_id").endswith(":1")).select(F.col("node_id").alias("seed"))
    return graph.hops(seeds, a.contains_edges(spark, sf), 3, "both").where("hop > 0")


@query("SELECT DISTINCT 'part:' || l_partkey AS node_id, 'related' AS label, CAST(1 AS DOUBLE) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 5")
def graph_neighbours_out(spark, sf):
    return graph.neighbours(a.related_edges(spark, sf), "cust:5").withColumn("weight", F.col("weight").cast("double"))


@query("SELECT DISTINCT 'cust:' || o_custkey AS node_id, 'related' AS label, CAST(1 AS DOUBLE) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 5")
def graph_neighbours_in(spark, sf):
    return graph.neighbours(a.related_edges(spark, sf), "part:5", "in", "related").withColumn("weight", F.col("weight").cast("double"))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT conv_id FROM c WHERE turn = 0)
SELECT 'conv:' || s.conv_id || ':0' AS seed, 'conv:' || s.conv_id || ':' || t AS node_id, CAST(t AS INT) AS depth, CAST(1 AS DOUBLE) AS weight
FROM s, (SELECT unnest([1, 2, 3]) AS t) WHERE (SELECT count(*) FROM c WHERE c.conv_id = s.conv_id AND c.turn BETWEEN 1 AND t) = t"""
)
def graph_paths(spark, sf):
    n = a.episode_nodes(spark, sf).dropDuplicates(["node_id"])
    seeds = n.where(F.col("node_id").endswith(":0")).select(F.col("node_id").alias("seed"))
    return graph.paths(seeds, n, a.contains_edges(spark, sf), 10**12, 3).select("seed", "node_id", "depth", "weight")


@query("SELECT DISTINCT 'conv:' || conv_id || ':' || turn AS node_id FROM conversations WHERE turn <= 2 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)")
def graph_slice(spark, sf):
    """The nodes on paths of two steps from every conversation's first turn."""
    n = a.episode_nodes(spark, sf).dropDuplicates(["node_id"])
    seeds = n.where(F.col("node_id").endswith(":0")).select(F.col("node_id").alias("seed"))
    return graph.slice_of(graph.paths(seeds, n, a.contains_edges(spark, sf), 10**12, 2))[0]


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn FROM e WHERE turn = 0 UNION SELECT e.conv_id, e.turn FROM e JOIN r ON e.conv_id = r.conv_id AND e.turn = r.turn + 1)
SELECT 'conv:' || conv_id || ':' || turn AS record FROM r WHERE turn > 0 AND turn % 2 = 0"""
)
def dependency_closure(spark, sf):
    """What depends on the conversations' first turns, through inactive (odd) turns."""
    c = a.read(spark, sf, "conversations")
    name = F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), F.col("turn"))
    records = c.select(name.alias("record"), F.when(F.col("turn") % 2 == 0, "Active").otherwise("Superseded").alias("state")).distinct()
    deps = a.contains_edges(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return graph.closure(records.where(F.col("record").endswith(":0")).select("record"), deps, records)


# Ranked recall

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_BM25 = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN ('ofretihaou', 'edouhe', 'the') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, 'doc:' || doc_id AS node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""
_TEXT = "Edouhe OFRETIHAOU, the edouhe"


@query(f"WITH {_BM25} SELECT node_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, node_id LIMIT 20")
def bm25_top(spark, sf):
    found = ranked.bm25(a.fact_nodes(spark, sf).where("content.text is not null"), _TEXT, text=F.col("content.text"))
    return found.limit(20).select(F.col("id").alias("node_id"), F.round("score", 5).alias("score"))


@query(f"WITH {_BM25} SELECT node_id, round(score, 5) AS score FROM bm JOIN documents USING (doc_id) WHERE source = 'src4' ORDER BY bm.score DESC, node_id LIMIT 10")
def bm25_prefiltered(spark, sf):
    """Document frequencies are of all documents, results of one source."""
    n = a.fact_nodes(spark, sf).where("content.text is not null")
    keep = n.where(F.element_at("metadata", F.lit("source")) == '"src4"').select("node_id")
    found = ranked.bm25(n, _TEXT, text=F.col("content.text"), keep=keep)
    return found.limit(10).select(F.col("id").alias("node_id"), F.round("score", 5).alias("score"))


@query(
    f"""WITH {_BM25}, b AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM bm), c AS (SELECT 'doc:' || doc_id AS node_id, row_number() OVER (ORDER BY n_chars DESC, 'doc:' || doc_id) AS r FROM documents)
SELECT node_id, round(sum(s), 6) AS score FROM (SELECT node_id, 1.0 / (60 + r) AS s FROM b WHERE r <= 50 UNION ALL SELECT node_id, 0.5 / (60 + r) FROM c WHERE r <= 50) GROUP BY node_id"""
)
def rrf_fusion(spark, sf):
    n = a.fact_nodes(spark, sf).where("content.text is not null")
    words = ranked.bm25(n, _TEXT, text=F.col("content.text")).select("id", "score")
    longest = a.read(spark, sf, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.col("n_chars").alias("score"))
    return ranked.fuse([(words, 1.0), (longest, 0.5)], 50).select(F.col("id").alias("node_id"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_BM25}, b AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM bm)
SELECT node_id, round(1.0 / (60 + r), 6) AS score, false AS verified FROM b WHERE r <= 10"""
)
def ranked_recall(spark, sf):
    n = a.fact_nodes(spark, sf).where("content.text is not null")
    edges = spark.createDataFrame([], a.EDGES)
    found = ranked.recall(n, edges, ranked.Request(_TEXT, 10**12, filter=ranked.Filter(kinds=("Fact",))))
    return found.select(F.col("id").alias("node_id"), F.round("score", 6).alias("score"), "verified")


@query(f"WITH {_VEC}, t AS (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 40) SELECT node_id, round(score, 5) AS score FROM (SELECT * FROM t WHERE kind IN ('Fact', 'Episode') AND created_at_ms >= 1000 ORDER BY score DESC, node_id LIMIT 6) w WHERE node_id IN (SELECT node_id FROM v WHERE kind IN ('Fact', 'Episode'))")
def text_query(spark, sf):
    vec = ", ".join(repr(x_) for x_ in _query_vector(spark, sf))
    plan = parse(f"""recall n: Node where n.tenant = 0 and n.kind in (Fact, Episode) and n.created_at >= 1000
        similar to [{vec}] using model "text" topk 40 limit 6
        join m: Node where m.kind in (Fact, Episode) on node_id return n.id, score""")
    return _scored(_vectors(spark, sf).run(plan))


# Evidence memory

_EVIDENCE = """ev AS (SELECT 'conv:' || conv_id || ':' || turn AS record, CASE WHEN role = 'assistant' THEN 'AssistantUtterance' ELSE 'UserAssertion' END AS class, conv_id * 1000 + turn AS observed_at_ms, text FROM conversations)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = a.read(spark, sf, "conversations")
    null = F.lit(None).cast("bigint")
    return c.select(
        F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("record"), F.lit("Evidence").alias("type"),
        F.when(F.col("role") == "assistant", memory.ASSISTANT).otherwise("UserAssertion").alias("class"), F.lit("Active").alias("state"),
        F.struct(F.lit("Session").alias("kind"), F.col("conv_id").cast("string").alias("id")).alias("scope"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("observed_at_ms"), null.alias("valid_from_ms"), null.alias("valid_to_ms"), "text",
    )


_ASK = "The theand of ININ onthe"


@query(
    f"""WITH {_EVIDENCE}, m AS (SELECT record, observed_at_ms, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), ['the', 'theand', 'of', 'inin', 'onthe'])) AS terms, lower(text) = lower('{_ASK}') AS exact FROM ev WHERE class <> 'AssistantUtterance' AND text IS NOT NULL)
SELECT record, CAST(terms AS BIGINT) AS terms FROM m WHERE terms > 0 OR exact ORDER BY exact DESC, m.terms DESC, observed_at_ms DESC, record LIMIT 20"""
)
def evidence_recall(spark, sf):
    return memory.recall(_evidence(spark, sf), _ASK, limit=20).select("record", "terms")


@query(f"WITH {_EVIDENCE} SELECT record FROM ev WHERE class <> 'AssistantUtterance' AND text IS NOT NULL AND observed_at_ms >= 2000 AND observed_at_ms < 60000 ORDER BY observed_at_ms DESC, record LIMIT 30")
def evidence_in_range(spark, sf):
    return memory.recall(_evidence(spark, sf), "", start=2000, end=60_000, limit=30).select("record")


@query(f"WITH {_EVIDENCE} SELECT record, observed_at_ms FROM ev WHERE observed_at_ms >= 1000 AND observed_at_ms < 90000 ORDER BY observed_at_ms DESC, record LIMIT 40")
def observed_scan(spark, sf):
    return memory.observed(_evidence(spark, sf), 1000, 90_000, 40).select("record", "observed_at_ms")


@query(rf"WITH {_EVIDENCE}, t AS (SELECT record, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS term FROM ev) SELECT record, term FROM t WHERE term IN ('theand', 'de', 'inin')")
def posting_scan(spark, sf):
    return memory.posting_scan(_evidence(spark, sf), ["theand", "de", "inin"])


@query(
    f"""WITH {_VEC}, p AS (SELECT node_id, vec_id, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS baseline FROM (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 40)),
s AS (SELECT a.node_id AS f, b.node_id AS t, CAST((a.vec_id * 7919 + b.vec_id * 104729) % 2000001 - 1000000 AS BIGINT) AS m FROM p a, p b WHERE a.vec_id <> b.vec_id),
c AS (SELECT f, t, CAST(trunc((m * 800000 + (-m) * 299999)::DOUBLE / 1000000) AS BIGINT) AS micros FROM s),
z AS (SELECT p.node_id, baseline, CAST(coalesce(sum(micros), 0) AS BIGINT) AS total FROM p LEFT JOIN c ON t = p.node_id GROUP BY ALL)
SELECT node_id AS record, total, row_number() OVER (ORDER BY total DESC, baseline, node_id) - 1 AS shadow_rank FROM z"""
)
def activation_fixed_point(spark, sf):
    """The 40 records nearest to a vector, with signals of two dimensions between all of them."""
    w = Window.orderBy(F.desc("score"), "node_id")
    top = vector.top_k(a.embeddings(spark, sf), _query_vector(spark, sf), 40, "text")
    pins = top.select(F.col("node_id").alias("record"), (F.row_number().over(w) - 1).alias("baseline"))
    number = lambda c: F.substring_index(c, ":", -1).cast("bigint")
    pairs = pins.select(F.col("record").alias("from_record")).crossJoin(pins.select(F.col("record").alias("to_record")))
    m = (number(F.col("from_record")) * 7919 + number(F.col("to_record")) * 104729) % 2000001 - 1000000
    one = pairs.select("from_record", "to_record", F.lit("relevance").alias("dimension"), m.alias("score_micros"))
    two = pairs.select("from_record", "to_record", F.lit("novelty").alias("dimension"), (-m).alias("score_micros"))
    weights = spark.createDataFrame([("relevance", 800_000), ("novelty", 299_999)], "dimension string, weight_micros int")
    return memory.activate(pins, one.unionByName(two), weights)[1].select("record", "total", "shadow_rank")


@query("SELECT CAST(user_id AS VARCHAR) AS record, max(event_id) AS revision, max_by(event_type, event_id) AS state FROM events GROUP BY user_id")
def revision_heads(spark, sf):
    e = a.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("record"), F.col("event_id").alias("revision"), F.col("event_type").alias("state"))
    return memory.heads(e)


# Lifecycle


@query("SELECT CAST(user_id AS VARCHAR) AS node_id, count(*) AS access_count, max(epoch_us(ts) // 1000) AS last_accessed FROM events GROUP BY user_id")
def access_counters(spark, sf):
    e = a.read(spark, sf, "events")
    return lifecycle.record_access(e.select(F.col("user_id").cast("string").alias("node_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")))


@query("SELECT CAST(user_id // 2 * 2 AS VARCHAR) AS node_id, CAST(count(*) AS BIGINT) AS access_count, max(epoch_us(ts) // 1000) AS last_accessed FROM events GROUP BY user_id // 2")
def access_merge(spark, sf):
    c = access_counters(spark, sf)
    odd = c.where(F.col("node_id").cast("bigint") % 2 == 1).select(F.col("node_id").alias("source"), (F.col("node_id").cast("bigint") - 1).cast("string").alias("target"))
    return lifecycle.merge_access(c, odd)


def _state(spark: SparkSession, sf: str) -> DataFrame:
    e = a.read(spark, sf, "events")
    return e.select(F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.col("props").alias("json"), F.col("event_id").alias("revision"), (F.col("event_id") % 5 == 0).alias("deleted"))


_STATE = "h AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, max_by(props, event_id) AS json, max(event_id) AS revision FROM events GROUP BY user_id)"


@query(f"WITH {_STATE} SELECT key, json, revision FROM h WHERE revision % 5 <> 0 AND key > 'user/00000010' ORDER BY key LIMIT 40")
def state_scan(spark, sf):
    return lifecycle.state_scan(_state(spark, sf), "user/", "user/00000010", 40).select("key", "json", "revision")


@query(f"WITH {_STATE} SELECT key, revision + 1 AS revision FROM h")
def state_compare_and_set(spark, sf):
    s = _state(spark, sf)
    changes = lifecycle.state_heads(s).select("key", F.lit("{}").alias("json"), F.col("revision").alias("expected"))
    return lifecycle.state_apply(s, changes, 0).select("key", "revision")


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    e = a.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("operation_id"), F.col("event_type").alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query("SELECT audit_id, action FROM (SELECT event_id AS audit_id, event_type AS action FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 25)")
def audit_newest(spark, sf):
    return lifecycle.audit_scan(_audit(spark, sf), action="click", limit=25).select("audit_id", "action")


@query("SELECT event_id AS audit_id, event_type AS action FROM events ORDER BY event_id LIMIT 25")
def audit_oldest(spark, sf):
    return lifecycle.audit_scan(_audit(spark, sf), limit=25, oldest=True).select("audit_id", "action")


@query("SELECT sha256(text) AS hash, octet_length(encode(text)) AS size, count(*) AS refcount, octet_length(encode(text)) > 65536 AS chunked FROM documents WHERE text IS NOT NULL GROUP BY text")
def blob_dedup(spark, sf):
    files = a.read(spark, sf, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    return lifecycle.put_blobs(files).select("hash", "size", "refcount", "chunked")


@query(
    """WITH n AS (SELECT 'doc:' || doc_id AS node_id, doc_id * 1000 AS made, octet_length(encode(text)) AS size FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || turn, conv_id * 1000 + turn, octet_length(encode(text)) FROM conversations),
r AS (SELECT *, row_number() OVER (ORDER BY made, node_id) AS place, sum(size) OVER (ORDER BY made, node_id ROWS UNBOUNDED PRECEDING) AS total FROM n)
SELECT node_id, CAST(size AS BIGINT) AS size, CAST(place AS INT) AS place FROM r WHERE place <= 128 AND total <= 262144"""
)
def consolidation_sources(spark, sf):
    n = a.fact_nodes(spark, sf).unionByName(a.episode_nodes(spark, sf))
    return lifecycle.consolidation_sources(n, spark.createDataFrame([], "node_id string"))


@query("SELECT 'doc:' || doc_id AS node_id FROM documents WHERE doc_id * 1000 <= 50000")
def valid_at(spark, sf):
    return _ids(a.fact_nodes(spark, sf).where(x.is_valid_at(F.lit(50_000))))


@query("SELECT 'doc:' || doc_id AS node_id, CAST(2 AS BIGINT) AS revision, 'Retracted' AS state, CAST(99 AS BIGINT) AS valid_to_ms FROM documents WHERE doc_id = 3")
def retract(spark, sf):
    return lifecycle.retract(a.fact_nodes(spark, sf), "doc:3", 99, 1).select("node_id", "revision", "state", "valid_to_ms")
