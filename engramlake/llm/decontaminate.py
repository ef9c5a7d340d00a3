"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, cut, lean, numbered, small, stored, table, word_codes

#: Tokens of an exact phrase; a shorter item of SHORT tokens or more is one phrase.
PHRASE, SHORT = 13, 5
#: Rarest tokens of an item for proximity, the share of them that has to be near, and how far offsets may differ.
RARE, NEAR_SHARE, SLACK = 10, 0.6, 8
#: Tokens in a segment of the index.
SEGMENT = 1_000_000
#: Benchmark items held by a task at a time; more items are searched in further passes.
ITEMS_A_PASS = 20_000
ITEM_COLUMNS = (("item_id", "bigint"), ("text", "string"))


def _segment(rids: list[int], codes: list[np.ndarray]) -> tuple:
    """One row of the index: the terms in order with their counts, and for each posting its document and position."""
    n = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    doc = np.repeat(np.arange(len(codes), dtype=np.uint32), n)
    pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
    order = np.argsort(flat, kind="stable")
    terms, first, tf = np.unique(flat[order], return_index=True, return_counts=True)
    at = doc[order]
    new = np.r_[True, at[1:] != at[:-1]]
    new[first] = True
    df = np.add.reduceat(new, first, dtype=np.int64).astype(np.uint32)
    return np.array(rids, np.int64).tobytes(), terms.tobytes(), df.tobytes(), tf.astype(np.uint32).tobytes(), at.tobytes(), pos[order].tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """The index, written to the shared folder: each row has all postings of some documents. docs: rid, text.

    Segments hold whole documents, so that lists are intersected where they lie and no posting is shuffled.
    """

    def run(batches):
        coder = ChunkCoder(word_codes)
        rids, codes, held = [], [], 0
        for b in batches:
            out = []
            for rid, text in zip(b["rid"], b["text"]):
                c = coder.array(text, np.uint64)
                if len(c):
                    rids.append(rid)
                    codes.append(c)
                    held += len(c)
                if held >= SEGMENT:
                    out.append(_segment(rids, codes))
                    rids, codes, held = [], [], 0
            if out:
                yield pd.DataFrame(out, columns=_INDEX)
        if rids:
            yield pd.DataFrame([_segment(rids, codes)], columns=_INDEX)

    return stored(docs.select("rid", "text").mapInPandas(lean(run), ", ".join(f"{c} binary" for c in _INDEX)), "postings")


_INDEX = ["rids", "terms", "df", "tf", "doc", "pos"]


def document_counts(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents of the whole index each wanted term is; at most as many rows as wanted come to the driver."""
    wanted = np.unique(wanted)

    def run(batches):
        for b in batches:
            for t, df in zip(b["terms"], b["df"]):
                terms = np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                hit = terms[at] == wanted
                yield pd.DataFrame({"term": wanted[hit].view(np.int64), "df": np.frombuffer(df, np.uint32)[at[hit]].astype(np.int64)})

    rows = index.select("terms", "df").mapInPandas(lean(run), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {int(np.int64(r["term"]).view(np.uint64)): r["df"] for r in rows}


class _Segment:
    """A row of the index, opened."""

    def __init__(self, rids: bytes, terms: bytes, tf: bytes, doc: bytes, pos: bytes):
        self.rids, self.terms = np.frombuffer(rids, np.int64), np.frombuffer(terms, np.uint64)
        n = np.frombuffer(tf, np.uint32).astype(np.int64)
        self.end = np.cumsum(n)
        self.start = self.end - n
        self.doc, self.pos = np.frombuffer(doc, np.uint32), np.frombuffer(pos, np.uint32)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def starts(self, place: int, offset: int) -> np.ndarray:
        """For each posting, its document and its position less the offset, as one number in order.

        Positions and offsets have 32 bits, so that a difference never reaches into another document's numbers.
        """
        s = slice(self.start[place], self.end[place])
        return self.doc[s].astype(np.int64) << 34 | (self.pos[s].astype(np.int64) - offset + (1 << 33))


def plan(items: list[tuple[int, np.ndarray]], df: dict[int, int]) -> tuple[list, list]:
    """Phrases as (item, offsets rarest first) and near as (item, offsets of the rarest tokens, how many are needed).

    Tokens that no document has tell nothing and count neither as rare nor as found.
    """
    phrases, near = [], []
    for k, (_, c) in enumerate(items):
        if len(c) < SHORT:
            continue
        seen = np.array([df.get(int(t), 0) for t in c])
        for a in range(max(1, len(c) - PHRASE + 1)):
            part = np.arange(a, min(len(c), a + PHRASE))
            if seen[part].all():
                phrases.append((k, part[np.lexsort((part, seen[part]))]))
        there = np.flatnonzero(seen)
        rare, need = there[np.lexsort((there, seen[there]))][:RARE], int(np.ceil(NEAR_SHARE * min(RARE, len(c))))
        if len(rare) >= need:
            near.append((k, rare, need))
    return phrases, near


def _search(seg: _Segment, codes: list[np.ndarray], at: np.ndarray, first: np.ndarray, phrases: list, near: list) -> list[tuple]:
    place = seg.places(at)
    here = [place[first[k] : first[k] + len(c)] for k, c in enumerate(codes)]
    found: dict = {}
    for k, offsets in phrases:
        p = here[k][offsets]
        if (p < 0).any():
            continue
        s = seg.starts(p[0], offsets[0])
        for o, q in zip(offsets[1:], p[1:]):
            other = seg.starts(q, o)
            s = s[other[np.minimum(np.searchsorted(other, s), len(other) - 1)] == s]
            if not len(s):
                break
        for x in s:
            got = found.setdefault((k, int(x >> 34)), [0, 0])
            got[0] += 1
    for k, offsets, need in near:
        p = here[k][offsets]
        if (p >= 0).sum() < need:
            continue
        parts = [(seg.starts(q, o), i) for i, (o, q) in enumerate(zip(offsets, p)) if q >= 0]
        s = np.concatenate([x for x, _ in parts])
        slot = np.repeat([i for _, i in parts], [len(x) for x, _ in parts])
        order = np.argsort(s, kind="stable")
        s, slot = s[order], slot[order]
        upto = np.searchsorted(s, s + SLACK, side="right")
        for i in np.flatnonzero(upto - np.arange(len(s)) >= need):
            n = len(set(slot[i : upto[i]].tolist()))
            if n >= need:
                got = found.setdefault((k, int(s[i] >> 34)), [0, 0])
                got[1] = max(got[1], n)
    return [(int(seg.rids[d]), k, n, m) for (k, d), (n, m) in found.items()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid, item_id, phrases, near: how many phrases of the item the document has, and how many of its rarest tokens are near.

    docs: rid, text. near is 0 where fewer than NEAR_SHARE of the RARE rarest tokens have places that differ from the
    item's by at most SLACK among one another. The items are a test set, which the driver holds; a large one is searched
    in passes of ITEMS_A_PASS.
    """
    index = build_index(docs)
    out = None
    encode = ChunkCoder(word_codes)
    items = [(r["item_id"], encode.array(r["text"], np.uint64)) for r in columns(benchmark, ITEM_COLUMNS).orderBy("item_id", "text").toLocalIterator()]
    for i in range(0, max(1, len(items)), ITEMS_A_PASS):
        some = items[i : i + ITEMS_A_PASS]
        part = _pass(index, some)
        out = part if out is None else out.unionByName(part)
    return out


def _pass(index: DataFrame, items: list[tuple[int, np.ndarray]]) -> DataFrame:
    codes = [c for _, c in items]
    flat = np.concatenate([*codes, np.empty(0, np.uint64)])
    first = np.cumsum([0, *map(len, codes)])[:-1]
    phrases, near = plan(items, document_counts(index, flat)) if len(flat) else ([], [])
    ids = [x for x, _ in items]

    def run(batches):
        for b in batches:
            for row in zip(*(b[c] for c in ("rids", "terms", "tf", "doc", "pos"))):
                hits = _search(_Segment(*row), codes, flat, first, phrases, near)
                if hits:
                    yield pd.DataFrame([(r, ids[k], n, m) for r, k, n, m in hits], columns=["rid", "item_id", "phrases", "near"]).astype({"item_id": "Int64"})

    return index.select("rids", "terms", "tf", "doc", "pos").mapInPandas(lean(run), "rid bigint, item_id bigint, phrases bigint, near bigint")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a phrase or proximity match with an item; the columns of documents.

    Method: an inverted index with positions over all tokens of docs (lower-case words); for each item, each window of
    PHRASE tokens is looked up from its rarest term on, lists being shifted by the terms' offsets and intersected, which
    gives exact phrases; NEAR_SHARE of RARE tokens, the item's rarest that the corpus has, whose offsets agree to within
    SLACK are a proximity match. Tokens as rare as one another count in the item's order.

    A null or empty text matches nothing, and neither does an item of fewer than SHORT tokens. A text counts whole, however
    long: it is one segment's. Repeated rows are each judged, as are repeated items; empty tables on either side leave
    the documents as they are; columns beyond those of documents are left out, whatever their names.
    """
    d = numbered(columns(docs))
    hit = cut(matches(d, benchmark).select("rid").distinct())
    return d.join(small(hit), "rid", "left_anti").drop("rid")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, phrases and near for each document and item that match."""
    d = numbered(columns(table(spark, sf_dir, "documents")))
    found = cut(matches(d, table(spark, sf_dir, "benchmark")))
    return small(found).join(d.select("rid", "doc_id"), "rid").select("doc_id", "item_id", "phrases", "near")


_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM t),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
i AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS off, len(w) AS n FROM b WHERE len(w) >= {SHORT}),
hits AS (SELECT doc_id, item_id, off, pos, pos - off AS start, n FROM p JOIN i USING (term)),
ph AS (SELECT item_id, n, unnest(range(greatest(1, n - {PHRASE} + 1))) AS a FROM (SELECT DISTINCT item_id, n FROM i)),
ex AS (SELECT doc_id, item_id, a, start FROM hits JOIN ph USING (item_id) WHERE off >= a AND off < a + {PHRASE}
       GROUP BY doc_id, item_id, a, start HAVING count(*) = least({PHRASE}, any_value(ph.n))),
e AS (SELECT doc_id, item_id, count(*) AS phrases FROM ex GROUP BY ALL),
r AS (SELECT i.item_id, i.off, i.term, row_number() OVER (PARTITION BY item_id ORDER BY df, off) AS slot, n FROM i JOIN f USING (term)),
s AS (SELECT doc_id, item_id, slot, pos - off AS start, ceil({NEAR_SHARE} * least({RARE}, n)) AS need FROM p JOIN r USING (term) WHERE slot <= {RARE}),
m AS (SELECT a.doc_id, a.item_id, a.slot, a.start, count(DISTINCT b.slot) AS c FROM s a JOIN s b
      ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.start BETWEEN a.start AND a.start + {SLACK}
      GROUP BY ALL HAVING count(DISTINCT b.slot) >= any_value(a.need)),
g AS (SELECT doc_id, item_id, max(c) AS near FROM m GROUP BY ALL)
SELECT doc_id, item_id, CAST(coalesce(phrases, 0) AS BIGINT) AS phrases, CAST(coalesce(near, 0) AS BIGINT) AS near
FROM e FULL JOIN g USING (doc_id, item_id)"""

SQL = {"op1_decontamination": _SQL}
QUERIES = {"op1_decontamination": op1_decontamination}
