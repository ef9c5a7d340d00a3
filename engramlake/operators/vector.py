"""Exact cosine search, filtered search, and the hybrid of vectors and graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from engramlake.functions.expressions import cosine_score, vector_literal
from engramlake.operators import graph
from engramlake.operators.graph import hops

MAX_K = 100_000


def check_vector(query, dim: int | None = None) -> list[float]:
    """The query as floats; an error where it's empty, not finite, of another dimension or of norm zero."""
    v = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in v))
    if not v or not all(map(math.isfinite, v)) or not math.isfinite(norm) or norm == 0 or norm > 3.4e38:
        raise ValueError("a query vector has to be finite and of non-zero norm")
    if dim is not None and len(v) != dim:
        raise ValueError(f"the query has {len(v)} dimensions, the index {dim}")
    return v


def check_k(k: int) -> int:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k has to be in 0..{MAX_K}")
    return k


def top_k(embeddings: DataFrame, query, k: int, model: str, tenant: int | None = None) -> DataFrame:
    """node_id, score of the k nearest, ties by node_id; an unknown model gives none.

    One pass with a bounded heap in each task (TakeOrderedAndProject): nothing is shuffled but k rows a task.
    """
    v = check_vector(query)
    e = embeddings.where(F.col("model") == model)
    if tenant is not None:
        e = e.where(F.col("tenant") == tenant)
    # A vector of another dimension can't be compared.
    e = e.where(F.size("vector") == len(v))
    scored = e.select("node_id", cosine_score(F.col("vector"), vector_literal(v)).alias("score"))
    return scored.orderBy(F.desc("score"), "node_id").limit(check_k(k))


def filtered_top_k(embeddings: DataFrame, nodes: DataFrame, query, k: int, model: str, kinds=(), after=None, before=None, metadata: dict | None = None) -> DataFrame:
    """The k nearest among nodes that meet all conditions (bounds inclusive, metadata as exact JSON): filtered before top-k."""
    n = nodes
    if kinds:
        n = n.where(F.col("kind").isin(*kinds))
    if after is not None:
        n = n.where(F.col("created_at_ms") >= after)
    if before is not None:
        n = n.where(F.col("created_at_ms") <= before)
    for key, js in (metadata or {}).items():
        n = n.where(F.element_at("metadata", F.lit(key)) == js)
    return top_k(embeddings.join(n.select("node_id"), "node_id", "left_semi"), query, k, model)


#: Bytes of vectors in a slab of queries and of nodes, queries times k in a slab, and rows of a tile of scores.
QUERY_BYTES, NODE_BYTES, SLAB_RESULTS, TILE = 1 << 20, 32 << 20, 1 << 20, (512, 1024)


def batch_top_k(queries: DataFrame, embeddings: DataFrame, k: int, rows: int = 4096) -> DataFrame:
    """query_id, node_id, score: the k nearest of every query (query_id, vector), ties by node_id.

    Queries and nodes are packed into slabs of bounded size, at most about `rows` queries, and each pair of slabs is a task
    that keeps k for each query: nothing is held by the driver, and k rows for each query and slab of nodes are moved. All
    pairs are scored, so the work grows with queries times nodes. Vectors are compared with those of their dimension; the
    score is 0 where a norm is zero, and 1 where a vector isn't finite, as with cosine_score.
    """
    check_k(k)
    kind = "float" if queries.schema["vector"].dataType == embeddings.schema["vector"].dataType == T.ArrayType(T.FloatType()) else "double"
    item = np.dtype("f4" if kind == "float" else "f8")
    schema = T.StructType([queries.schema["query_id"], T.StructField("node_id", T.StringType()), T.StructField("score", T.DoubleType())])

    def slabs(df: DataFrame, name: str, size: int, most: int, keep: int | None) -> DataFrame:
        d = df.select(F.col(name).alias("id"), F.col("vector").cast(f"array<{kind}>").alias("vector")).where(F.size("vector") > 0)
        n, dim = d.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        limit = max(1, min(most, size // (item.itemsize * dim)))
        out = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(d.schema["id"].dataType)), T.StructField("data", T.BinaryType())])
        return graph.cut(d.repartition(max(1, math.ceil(n / limit)), "id").mapInArrow(lambda batches: _pack(batches, item, 2 * limit, keep), out))

    if k == 0:
        return queries.sparkSession.createDataFrame([], schema)
    q = slabs(queries, "query_id", QUERY_BYTES, min(rows, max(1, SLAB_RESULTS // k)), None)
    v = slabs(embeddings, "node_id", NODE_BYTES, 1 << 20, k)
    q, v = q.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q")), v.select(F.col("dim").alias("v_dim"), F.col("ids").alias("v_ids"), F.col("data").alias("v"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                dim, q_ids, q, v_dim, v_ids, v = (b.column(c)[i] for c in range(6))
                if dim.as_py() == v_dim.as_py():
                    x, y = (np.frombuffer(m.as_buffer(), item).reshape(-1, dim.as_py()) for m in (q, v))
                    at, to, score = nearest(x, y, k)
                    yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(at)), v_ids.values.take(pa.array(to)), pa.array(score)], ["query_id", "node_id", "score"])

    # One slab is one partition, so that a task holds one of either kind; a broadcast would put all of a side together.
    found = q.crossJoin(v.hint("shuffle_replicate_nl")).mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _pack(batches, item: np.dtype, most: int, keep: int | None):
    """Slabs (dim, ids, data) of at most so many of the rows (id, vector), a dimension at a time.

    With keep, a slab's rows are in the order of their ids, and of equal vectors only the first `keep` are in it.
    """
    held: dict[int, list] = {}

    def slab(dim: int) -> pa.RecordBatch:
        ids, m = pa.concat_arrays([x for x, _ in held[dim]]), np.concatenate([m for _, m in held.pop(dim)])
        if keep is not None:
            order = pc.array_sort_indices(ids).to_numpy()
            same = np.ascontiguousarray(m[order]).view(np.dtype((np.void, item.itemsize * dim))).ravel()
            _, group = np.unique(same, return_inverse=True)
            by = np.argsort(group, kind="stable")
            order = order[np.sort(by[_places(group[by]) < keep])]
            ids, m = ids.take(pa.array(order)), m[order]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), lists, pa.array([m.tobytes()], pa.binary())], ["dim", "ids", "data"])

    for b in batches:
        ids, lists = b.column(0), b.column(1)
        flat, at = lists.values, lists.offsets.to_numpy().astype(np.int64)
        size = np.diff(at)
        ok = size > 0
        if flat.null_count:  # a vector that lacks a number can't be compared
            lost = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            ok &= lost[at[1:]] == lost[at[:-1]]
        flat = flat.to_numpy(zero_copy_only=False)
        for dim in np.unique(size[ok]).tolist():
            own = np.flatnonzero(ok & (size == dim))
            held.setdefault(dim, []).append((ids.take(pa.array(own)), flat[at[own][:, None] + np.arange(dim)].astype(item, copy=False)))
            if sum(len(x) for x, _ in held[dim]) >= most:
                yield slab(dim)
    for dim in list(held):
        yield slab(dim)


def _places(group: np.ndarray) -> np.ndarray:
    """Each row's place in its group, from 0; groups are together."""
    n = np.arange(len(group))
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    return n - np.maximum.accumulate(np.where(first, n, 0))


def _dot(a: np.ndarray, b: np.ndarray, i=None, j=None) -> np.ndarray:
    """Products of rows i of a and j of b (or of all), added up in the order of the dimensions: equal rows give equal sums, wherever they are."""
    out = np.zeros(len(a) if i is None else len(i))
    for s in range(0, len(out), 8192):
        x, y = (m[s : s + 8192] if at is None else m[at[s : s + 8192]] for m, at in ((a, i), (b, j)))
        for c, d in zip(x.T.astype(np.float64, order="C"), y.T.astype(np.float64, order="C")):
            out[s : s + 8192] += c * d
    return out


def nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of v and scores: the k best of v for each of q, ties by the row.

    Tiles of products in single precision show which pairs may be among the best, with a margin for their error; those are
    scored again in double precision.
    """
    with np.errstate(all="ignore"):
        nq, nv = _dot(q, q), _dot(v, v)
        # Where a score doesn't depend on the other vector, the first rows are the best.
        plain, zero, odd = np.flatnonzero(np.isfinite(nv) & (nv > 0)), np.flatnonzero(nv == 0), np.flatnonzero(~np.isfinite(nv))
        own = np.flatnonzero(np.isfinite(nq) & (nq > 0))
        finite = np.flatnonzero(np.isfinite(nv))
        at, to, score = [], [], []
        for which, rows, s in ((own, zero, 0.0), (own, odd, 1.0), (np.flatnonzero(nq == 0), finite, 0.0), (np.flatnonzero(nq == 0), odd, 1.0), (np.flatnonzero(~np.isfinite(nq)), np.arange(len(v)), 1.0)):
            at.append(np.repeat(which, len(rows[:k])))
            to.append(np.tile(rows[:k], len(which)))
            score.append(np.full(len(at[-1]), s))
        best = _best(np.concatenate(at), np.concatenate(to), np.concatenate(score), k)
        unit = (q[own] / np.sqrt(nq[own])[:, None]).astype(np.float32)
        error = (q.shape[1] + 8) * 2.0**-23
        least = np.full((len(own), 1), -np.inf, np.float32)
        some: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def settle():
            """The best with what has been found since; what a product has to reach from now on."""
            nonlocal best, some, held
            i, j = own[np.concatenate([x for x, _ in some])], plain[np.concatenate([y for _, y in some])]
            cosine = np.clip(_dot(q, v, i, j) / np.sqrt(nq[i] * nv[j]), -1, 1)
            best = _best(np.concatenate([best[0], i]), np.concatenate([best[1], j]), np.concatenate([best[2], (1 + cosine) / 2]), k)
            last = np.full(len(q), -np.inf)
            full = _places(best[0]) == k - 1
            last[best[0][full]] = 2 * best[2][full] - 1
            np.maximum(least, (last[own] - 2 * error).astype(np.float32)[:, None], out=least)
            some, held = [], 0

        for y in range(0, len(plain), TILE[1]):
            part = plain[y : y + TILE[1]]
            u = (v[part] / np.sqrt(nv[part])[:, None]).astype(np.float32).T
            for x in range(0, len(own), TILE[0]):
                s = unit[x : x + TILE[0]] @ u
                if y == 0 and s.shape[1] >= k:
                    least[x : x + TILE[0], 0] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error
                hit = _true(s >= least[x : x + TILE[0]])
                if len(hit):
                    i, j = np.divmod(hit, s.shape[1])
                    some.append((i + x, j + y))
                    held += len(hit)
                if held >= max(len(own) * k, 1 << 16):
                    settle()
        if some:
            settle()
    return best


def _true(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero, eight places at a time, as few are true."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    word = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[word])
    return word[i] * 8 + j


def _best(at: np.ndarray, to: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((to, -score, at))
    order = order[_places(at[order]) < k]
    return at[order], to[order], score[order]


def hybrid_search(embeddings: DataFrame, edges: DataFrame, query, k: int = 10, seed_k: int = 20, hop: int = 1, direction: str = "both", alpha: float = 0.7, decay: float = 0.5, model: str = "text", label: str | None = None) -> DataFrame:
    """node_id, score: alpha times a seed's similarity, plus what reached nodes get, (1 - alpha) * similarity * decay ** hop.

    Seeds are the max(seed_k, k) nearest; contributions of several seeds add up; ties go by node_id. A node's hop is its
    least distance from the seed.
    """
    seeds = top_k(embeddings, query, max(seed_k, k), model)
    own = seeds.select("node_id", (F.col("score") * alpha).alias("part"))
    reached = hops(seeds.select(F.col("node_id").alias("seed")), edges, hop, direction, label).where("hop > 0")
    by = reached.join(F.broadcast(seeds.withColumnRenamed("node_id", "seed")), "seed")
    near = by.select("node_id", ((1 - alpha) * F.col("score") * F.pow(F.lit(float(decay)), F.col("hop"))).alias("part"))
    return own.unionByName(near).groupBy("node_id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def embed_texts(df: DataFrame, text: str, embed, out: str = "vector") -> DataFrame:
    """df with vectors that a Python function (list of texts -> list of vectors) gives, a batch at a time."""

    @pandas_udf("array<float>")
    def run(s):
        import pandas as pd

        return pd.Series(list(embed(s.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))
