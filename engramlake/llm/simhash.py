"""Near-duplicates by SimHash, found through the anchors of a covering code."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, cut, give_back, lean, mix64, numbered, small, table, words

#: Bits of 128 that may differ: at most 1 in some segment of 16.
NEAR, _SEGMENTS = 15, 8
#: Fingerprints (as often as they are replicated) for a task; of one anchor, for a block of it; compared at once; held by a writer.
ENTRIES_A_BUCKET, BLOCK, PAIRS_A_STEP, HELD = 400_000, 100_000, 1 << 18, 2_000_000


def _syndromes() -> np.ndarray:
    """For each 15-bit word, 0 if it's in the Hamming code [15,11], else the place (from 1) of the bit that is off."""
    x = np.arange(1 << 15)
    s = np.zeros(1 << 15, np.int64)
    for i in range(15):
        s ^= np.where(x >> i & 1, i + 1, 0)
    return s


def _anchors() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word, the anchors other than its home within covering radius + 1 (-1: none), and its home.

    An anchor is a code word of [15,11] with the sixteenth bit beside it: 4,096 anchors of covering radius 1.
    """
    syn = _syndromes()
    x = np.arange(1 << 16)
    low, high = x & 0x7FFF, x & 0x8000
    s = syn[low]
    home = np.where(s > 0, low ^ (1 << np.maximum(s - 1, 0)), low)
    other = [home | (high ^ 0x8000)]
    for i in range(15):
        for j in range(i):
            two = low ^ (1 << i) ^ (1 << j)
            other.append(np.where(syn[two] == 0, two | high, -1))
    return -np.sort(-np.stack(other, 1), axis=1)[:, :8], home | high


_REPLICAS: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _REPLICAS:
        _REPLICAS.extend(_anchors())
    return _REPLICAS[0], _REPLICAS[1]


def _word_bytes(chunk: str) -> bytes:
    return b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for w in words(chunk))


def fingerprint(pairs: np.ndarray) -> tuple[int, int, int]:
    """lo, hi and number of distinct words, from the (n, 2) unsigned halves of the words' hashes."""
    distinct = pairs[np.unique(pairs[:, 0], return_index=True)[1]]
    n = len(distinct)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(n, 16), axis=1, bitorder="little")
    on = np.packbits(2 * bits.sum(0, dtype=np.int64) > n, bitorder="little").view(np.int64)
    return int(on[0]), int(on[1]), n


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid, doc_id, lo, hi, n: the 128-bit SimHash over each document's distinct words; a document without words has none."""

    def run(batches):
        coder = ChunkCoder(_word_bytes)
        for b in batches:
            rows = []
            for rid, doc, text in zip(b["rid"], b["doc_id"], b["text"]):
                pairs = coder.array(text, np.uint64).reshape(-1, 2)
                if len(pairs):
                    rows.append((rid, doc, *fingerprint(pairs)))
            yield pd.DataFrame(rows, columns=["rid", "doc_id", "lo", "hi", "n"]).astype({"doc_id": "Int64"})

    return docs.select("rid", "doc_id", "text").mapInPandas(lean(run), "rid bigint, doc_id bigint, lo bigint, hi bigint, n bigint")


def _places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key (segment and anchor) and whether it's the row's own anchor, for each place that a fingerprint goes to.

    NEAR differing bits leave at most NEAR // _SEGMENTS = 1 in one of the segments, so the other's own anchor is at most
    1 further off than the covering radius. All go to their own anchor; of two that differ by one bit just one has an
    even number of bits, and only such go to all anchors within covering radius + 1.
    """
    replicas, homes = _tables()
    rows, keys, own = [], [], []
    for k in range(_SEGMENTS):
        half = (lo, hi)[k // 4]
        seg = (half >> np.uint64(16 * (k % 4)) & np.uint64(0xFFFF)).astype(np.int64)
        even = np.flatnonzero(np.bitwise_count(seg) % 2 == 0)
        near = replicas[seg[even]]
        row, col = np.nonzero(near >= 0)
        rows += [np.arange(len(seg)), even[row]]
        keys += [homes[seg] | k << 16, near[row, col] | k << 16]
        own += [np.ones(len(seg), bool), np.zeros(len(row), bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


_KEYS = _SEGMENTS << 16


def _halves(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b[c].to_numpy(np.int64).view(np.uint64) for c in ("lo", "hi"))


def anchor_counts(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how many fingerprints have it as their own, and how many come from beside: two numbers for each of the anchors."""

    def run(batches):
        n = np.zeros(2 * _KEYS, np.int64)
        for b in batches:
            _, key, own = _places(*_halves(b))
            n += np.bincount(key + _KEYS * ~own, minlength=2 * _KEYS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"key": at, "n": n[at]})

    n = np.zeros(2 * _KEYS, np.int64)
    for r in nodes.select("lo", "hi").mapInPandas(lean(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        n[r["key"]] = r["n"]
    return n[:_KEYS], n[_KEYS:]


def _cells(row: np.ndarray, key: np.ndarray, own: np.ndarray, rid: np.ndarray, across: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell for each place. A cell is key << 33 | i << 17 | c << 1 | role, i and c being blocks of an anchor too large for one task.

    Cell (i, c) compares block i of those at home (role 0) with block c of those from beside (role 1), and with block c of
    those at home: among themselves where c = i, as role 1 where c > i.
    """
    whole = (across[key] == 1) & (down[key] == 1)
    rows, cells = [row[whole]], [key[whole] << 33 | ~own[whole]]
    for k in np.unique(key[~whole]).tolist():
        g, v = int(down[k]), int(across[k])
        at = np.flatnonzero(key == k)
        part = (mix64(rid[row[at]].view(np.uint64)) >> np.uint64(20)).astype(np.int64)
        for i in range(g):
            mine = at[own[at] & (part % g == i)]
            for c in range(max(g, v)):
                if c >= i or c < v:
                    rows.append(row[mine])
                    cells.append(np.full(len(mine), k << 33 | i << 17 | c << 1))
            for r in range(i):
                rows.append(row[mine])
                cells.append(np.full(len(mine), k << 33 | r << 17 | i << 1 | 1))
        for c in range(v):
            mine = at[~own[at] & (part % v == c)]
            for r in range(g):
                rows.append(row[mine])
                cells.append(np.full(len(mine), k << 33 | r << 17 | c << 1 | 1))
    return np.concatenate(rows), np.concatenate(cells)


def entries(nodes: DataFrame, buckets: int, across: np.ndarray, down: np.ndarray) -> DataFrame:
    """bucket, data: fingerprints at all their places, many to a row, as arrays of cell, rid, lo and hi end to end."""

    def pack(held: list) -> pd.DataFrame:
        cell, rid, lo, hi = (np.concatenate(x) for x in zip(*held))
        bucket = (mix64((cell >> 1).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        data = [b"".join(x[order[s:e]].tobytes() for x in (cell, rid, lo, hi)) for s, e in zip(edges[:-1], edges[1:])]
        return pd.DataFrame({"bucket": bucket[edges[:-1]].astype(np.int32), "data": data})

    def run(batches):
        held, n = [], 0
        for b in batches:
            lo, hi = _halves(b)
            rid = b["rid"].to_numpy(np.int64)
            for s in range(0, len(b), 10_000):
                part = slice(s, s + 10_000)
                row, cell = _cells(*_places(lo[part], hi[part]), rid[part], across, down)
                held.append((cell, rid[part][row], lo[part][row].view(np.int64), hi[part][row].view(np.int64)))
                n += len(row)
                if n >= HELD:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return nodes.select("rid", "lo", "hi").mapInPandas(lean(run), "bucket int, data binary")


def _compare(b: pd.DataFrame) -> pd.DataFrame:
    """Pairs within NEAR bits that meet in a cell."""
    parts = [np.frombuffer(x, np.int64).reshape(4, -1) for x in b["data"]]
    cell, rid, lo, hi = np.concatenate(parts, axis=1) if parts else np.empty((4, 0), np.int64)
    order = np.argsort(cell, kind="stable")
    cell, rid, lo, hi = cell[order], rid[order], lo[order].view(np.uint64), hi[order].view(np.uint64)
    starts = np.flatnonzero(np.r_[True, cell[1:] >> 1 != cell[:-1] >> 1]) if len(cell) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(cell)]
    at_home = np.add.reduceat(1 - (cell & 1), starts) if len(cell) else starts
    out = []
    for start, end, homes in zip(starts.tolist(), ends.tolist(), at_home.tolist()):
        if not homes:
            continue
        i_, c_ = int(cell[start]) >> 17 & 0xFFFF, int(cell[start]) >> 1 & 0xFFFF
        first = start if i_ == c_ else start + homes  # those at home come first
        if first == end:
            continue
        step = max(1, PAIRS_A_STEP // (end - first))
        for h in range(start, start + homes, step):
            i, j = np.nonzero(np.bitwise_count(lo[h : min(h + step, start + homes), None] ^ lo[None, first:end]) <= NEAR)
            i, j = i + h, j + first
            i, j = i[i < j], j[i < j]
            ok = np.bitwise_count(lo[i] ^ lo[j]) + np.bitwise_count(hi[i] ^ hi[j]) <= NEAR
            i, j = i[ok], j[ok]
            if len(i):
                out.append(np.stack([np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])], 1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame(pairs, columns=["a", "b"])


def near_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: all pairs of distinct fingerprints within NEAR bits, a < b. nodes: rid, lo, hi, cut."""
    own, beside = anchor_counts(nodes)
    down, across = np.maximum(1, -(-own // BLOCK)).astype(np.int32), np.maximum(1, -(-beside // BLOCK)).astype(np.int32)
    total = int((own * np.maximum(across, down) + beside * down).sum())
    buckets = max(12, math.ceil(total / ENTRIES_A_BUCKET))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        out = _compare(b)
        give_back()
        return out

    return entries(nodes, buckets, across, down).groupBy("bucket").applyInPandas(compare, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the pairs (a, b) is joined to, by alternating star contraction."""
    edges = cut(pairs.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        star = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(star.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = state


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of words: rid, doc_id, node; nodes: node, docs, root (a rid); and the pairs a, b of nodes within NEAR bits.

    Documents with one fingerprint are one node, so a group of equal copies costs as much as one document. docs: rid, doc_id, text.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("lo", "hi").agg(F.min("rid").alias("rid"), F.count("*").alias("docs")))
    pairs = cut(near_pairs(nodes))
    roots = components(pairs)
    named = nodes.join(roots, nodes["rid"] == roots["node"], "left").select("lo", "hi", F.col("rid").alias("node"), "docs", F.coalesce("root", "rid").alias("root"))
    named = cut(named)
    return prints.join(named.select("lo", "hi", "node", "root"), ["lo", "hi"]).select("rid", "doc_id", "node", "root"), named.select("node", "docs", "root"), pairs


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with all but one of each group of near-duplicates removed; the columns of documents.

    Near-duplicates: 128-bit SimHashes of the distinct lower-case words at most NEAR bits apart; groups are the connected
    components. The first row of a group (the order of the table's files) stays, so ties need no rule. A text counts
    whole, however long. A null text, or one without a word, is in no group and stays; of repeated rows one stays; an
    empty table gives an empty result; columns beyond those of documents are left out, whatever their names.
    """
    d = numbered(columns(docs))
    gone = cut(groups(d)[0].where("rid <> root").select("rid"))
    return d.join(small(gone), "rid", "left_anti").drop("rid")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group_doc_id (the group's document that stays), size of the group and links, for each document in a group of two or more.

    links: how many other documents are within NEAR bits of the document.
    """
    d = numbered(columns(table(spark, sf_dir, "documents")))
    prints, nodes, pairs = groups(d)
    prints = cut(prints)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.select(F.col("node").alias("b"), "docs"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("docs").alias("others"))
    many = nodes.groupBy("root").agg(F.sum("docs").alias("size")).where("size > 1")
    linked = nodes.join(many, "root").join(others, "node", "left").select("node", "size", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    kept = prints.where("rid = root").select("root", F.col("doc_id").alias("group_doc_id"))
    return prints.join(linked, "node").join(kept, "root").select("doc_id", "group_doc_id", "size", "links")


def fingerprint_sql(docs: str) -> str:
    """SQL of doc_id, lo, hi: the fingerprints of the documents of a relation."""
    return rf"""SELECT doc_id, sum(CASE WHEN l THEN 1::UBIGINT << i ELSE 0 END)::UBIGINT AS lo, sum(CASE WHEN h THEN 1::UBIGINT << i ELSE 0 END)::UBIGINT AS hi FROM (
  SELECT doc_id, i, 2 * sum((l >> i) & 1) > count(*) AS l, 2 * sum((h >> i) & 1) > count(*) AS h FROM (
    SELECT doc_id, md5_number_lower(w) AS l, md5_number_upper(w) AS h FROM (
      SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM {docs})), (SELECT unnest(range(64))::UBIGINT AS i)
  GROUP BY doc_id, i) GROUP BY doc_id"""


_SQL = f"""
WITH RECURSIVE f AS MATERIALIZED ({fingerprint_sql("documents")}),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.doc_id <> b.doc_id AND bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= {NEAR}),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS doc_id, min(b) AS group_doc_id, count(*) AS size FROM r GROUP BY a)
SELECT doc_id, group_doc_id, size, (SELECT count(*) FROM e WHERE e.a = g.doc_id) AS links FROM g"""

SQL: dict[str, str] = {"op4_simhash_near_dedup": _SQL}
QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
