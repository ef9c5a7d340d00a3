"""Ranked recall over nodes: BM25, reciprocal-rank fusion, graph bonus, provenance, conflicts, trust."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from engramlake.functions.expressions import content_text, edge_is_valid_at, is_valid_at, lexical_terms
from engramlake.operators import graph, vector

RRF, GRAPH_SHARE = 60, 0.25
K1, B = 1.2, 0.75
#: What an adjudicator is given at most.
MAX_CANDIDATES, MAX_BYTES = 50, 128 * 1024


def postings(docs: DataFrame, id_col: str, text: Column, terms: Callable[[Column], Column] = lexical_terms) -> DataFrame:
    """id, term, tf, len: an index row for each document and term."""
    t = docs.select(F.col(id_col).alias("id"), terms(text).alias("terms")).select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return t.groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


_WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))
_CJK_RUN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff]+")


def terms_of(low: bytes) -> list[bytes]:
    """lexical_terms of a text in lower case, in UTF-8."""
    terms = low.translate(_WORD_BYTES).split()
    if len(low) > 256 and max(map(len, terms), default=0) > 256:
        terms = [t for t in terms if len(t) <= 256]
    if not low.isascii():
        for r in _CJK_RUN.findall(low.decode(errors="replace")):
            terms += [c.encode() for c in r]
            terms += [r[i : i + 2].encode() for i in range(len(r) - 1)]
    return terms


def _term_counts(batches, wanted: set[bytes]):
    """id, len, term, tf of the texts (id, low) with a wanted term; for each batch a row of totals, n texts with len terms."""
    for b in batches:
        at, lens, terms, tf, total = [], [], [], [], 0
        for i, low in enumerate(b.column(1).cast(pa.binary())):
            if (low := low.as_py()) is not None:
                every = terms_of(low)
                total += len(every)
                for t, c in Counter(filter(wanted.__contains__, every)).items():
                    at.append(i)
                    lens.append(len(every))
                    terms.append(t.decode())
                    tf.append(c)
        n = len(at)
        ids = b.column(0).take(pa.array([*at, None], pa.int64()))
        rest = ((lens + [total], pa.int64()), (terms + [None], pa.string()), (tf + [None], pa.int64()), ([None] * n + [b.num_rows], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in rest)], ["id", "len", "term", "tf", "n"])


def bm25(docs: DataFrame, query: str, id_col: str = "node_id", text: Column | None = None, keep: DataFrame | None = None) -> DataFrame:
    """id, score, terms: documents with a term of the query, best first, ties by id.

    df, the number of documents and the mean length are of all documents; keep (id) narrows the result only. The texts are
    read once: what is kept of them, in the shared folder, are the counts of the query's own terms and a row of totals for
    each batch (without a term), so that what is moved grows with the matches.
    """
    text = F.col("text") if text is None else text
    spark = docs.sparkSession
    wanted = {r[0].encode() for r in spark.range(1).select(F.explode(F.array_distinct(lexical_terms(F.lit(query))))).collect()}
    d = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("low"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType)]).add("len", "long").add("term", "string").add("tf", "long").add("n", "long")
    counts = graph.cut(d.mapInArrow(lambda batches: _term_counts(batches, wanted), schema))
    stats = counts.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    n, mean = stats["n"], max(stats["total"] / stats["n"], 1.0) if stats["n"] else 1.0
    tf = counts.where("term is not null").groupBy("id", "len", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if keep is not None:
        tf = tf.join(keep.select(F.col(keep.columns[0]).alias("id")), "id", "left_semi")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = tf.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"), F.sort_array(F.collect_list("term")).alias("terms"))
    return scored.orderBy(F.desc("score"), "id")


def rank(branch: DataFrame, limit: int) -> DataFrame:
    """id, rank from 1, of the limit best by score, ties by id."""
    top = branch.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank")


def fuse(branches: list[tuple[DataFrame, float]], limit: int) -> DataFrame:
    """id, score: weight / (RRF + rank) added up over branches of (id, score)."""
    parts = [rank(b, limit).select("id", (F.lit(float(w)) / (RRF + F.col("rank"))).alias("part")) for b, w in branches]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


@dataclass(frozen=True)
class Filter:
    """kinds: none for all; metadata: exact JSON; require_verified keeps verified facts, and unverified rows only of allowed kinds."""

    kinds: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()
    require_verified: bool = False


@dataclass(frozen=True)
class Request:
    query: str
    as_of_ms: int
    limit: int = 10
    candidates: int = 50
    lexical: bool = True
    depth: int = 1
    filter: Filter = Filter()
    #: (model, query vector, weight, least similarity)
    vectors: tuple[tuple[str, tuple[float, ...], float, float], ...] = ()


def provenance(edges: DataFrame, nodes: DataFrame, as_of_ms: int) -> DataFrame:
    """id, sources, evidence, conflicts, of what is valid then: derived_from goes out, contradicts either way."""
    at = F.lit(as_of_ms)
    e = edges.where(edge_is_valid_at(at))
    alive = nodes.where(is_valid_at(at)).select("node_id")
    own = e.where("label = 'derived_from'").select(F.col("src").alias("id"), F.lit("s").alias("what"), F.col("dst").alias("of"))
    shown = e.select(F.col("src").alias("id"), F.lit("e").alias("what"), F.explode("evidence").alias("of"))
    c = e.where("label = 'contradicts'")
    against = c.select(F.col("src").alias("id"), F.lit("c").alias("what"), F.col("dst").alias("of")).unionByName(c.select(F.col("dst").alias("id"), F.lit("c").alias("what"), F.col("src").alias("of")))
    every = own.unionByName(shown).unionByName(against).distinct().join(alive.select(F.col("node_id").alias("of")), "of", "left_semi")
    pick = lambda k: F.sort_array(F.collect_set(F.when(F.col("what") == k, F.col("of"))))
    return every.groupBy("id").agg(pick("s").alias("sources"), pick("e").alias("evidence"), pick("c").alias("conflicts"))


def recall(nodes: DataFrame, edges: DataFrame, request: Request, embeddings: DataFrame | None = None, text: Column | None = None) -> DataFrame:
    """id, score, verified, sources, evidence, conflicts: what is recalled for a request, best first, ties by id.

    Branches (terms, and each vector model) are filtered by validity and conditions, then ranked and fused; each seed gives
    GRAPH_SHARE of its score times the path's weight to what valid paths reach; nodes that contradict a result come with
    it, at its score; a Fact is verified if it has provenance.
    """
    if request.limit <= 0 or request.candidates <= 0:
        return nodes.sparkSession.createDataFrame([], "id string, score double, verified boolean, sources array<string>, evidence array<string>, conflicts array<string>")
    at = F.lit(request.as_of_ms)
    text = content_text(F.col("content")) if text is None else text
    # Without the texts, which only the terms need: what follows reads the nodes again and again.
    heads = graph.cut(nodes.select("node_id", "kind", "state", "created_at_ms", "valid_from_ms", "valid_to_ms", *["metadata"] * bool(request.filter.metadata)))
    ok = heads.where(is_valid_at(at))
    if request.filter.kinds:
        ok = ok.where(F.col("kind").isin(*request.filter.kinds))
    for key, js in request.filter.metadata:
        ok = ok.where(F.element_at("metadata", F.lit(key)) == js)
    keep = ok.select(F.col("node_id").alias("id"), "kind")
    branches = []
    if request.lexical:
        branches.append((bm25(nodes, request.query, "node_id", text, keep.select("id")).select("id", "score"), 1.0))
    for model, query, weight, least in request.vectors:
        e = embeddings.join(keep.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        hits = vector.top_k(e, query, request.candidates, model).select(F.col("node_id").alias("id"), "score")
        branches.append((hits.where(F.col("score") >= least), weight))
    if not branches:
        return recall(nodes, edges, Request(request.query, request.as_of_ms, 0), embeddings, text)
    seeds = graph.cut(fuse(branches, request.candidates).orderBy(F.desc("score"), "id").limit(request.candidates))
    scores = seeds
    if request.depth > 0:
        found = graph.paths(seeds.select(F.col("id").alias("seed")), heads, edges, request.as_of_ms, request.depth)
        bonus = found.join(F.broadcast(seeds.withColumnRenamed("id", "seed")), "seed").select(F.col("node_id").alias("id"), (F.col("score") * F.col("weight") * GRAPH_SHARE).alias("score"))
        scores = seeds.unionByName(bonus).groupBy("id").agg(F.sum("score").alias("score")).join(keep.select("id"), "id", "left_semi")
    known = provenance(edges, heads, request.as_of_ms)
    items = graph.cut(scores.join(known, "id", "left"))
    cited = items.select(F.explode("conflicts").alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))
    extra = cited.join(items.select("id"), "id", "left_anti").join(keep.select("id"), "id", "left_semi").join(known, "id", "left")
    every = items.unionByName(extra).join(keep, "id")
    has = (F.coalesce(F.size("sources"), F.lit(0)) > 0) | (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
    every = every.withColumn("verified", (F.col("kind") != "Fact") | has)
    if request.filter.require_verified:
        every = every.where("verified")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("sources", "evidence", "conflicts")]
    best = every.orderBy(F.desc("score"), "id").limit(max(request.candidates, request.limit))
    return best.orderBy(F.desc("score"), "id").limit(request.limit).select("id", "score", "verified", *lists)


def adjudicate(items: DataFrame, texts: DataFrame, judge: Callable[[list[dict]], list[str]]) -> list[dict]:
    """Recalled rows in the order that an outside judge gives, without those it leaves out.

    The judge gets at most MAX_CANDIDATES rows of at most MAX_BYTES text in all, and answers with their ids; unknown or
    repeated ones are an error.
    """
    rows, given, size = [r.asDict() for r in items.join(texts, "id").orderBy(F.desc("score"), "id").limit(MAX_CANDIDATES).collect()], [], 0
    for r in rows:
        size += len((r.get("text") or "").encode())
        if size > MAX_BYTES:
            break
        given.append(r)
    order = judge(given)
    by = {r["id"]: r for r in given}
    if len(set(order)) != len(order) or any(x not in by for x in order):
        raise ValueError("the verdict names a row that it wasn't given, or one twice")
    return [by[x] for x in order]
