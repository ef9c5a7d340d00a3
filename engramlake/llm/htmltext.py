"""Main text of web pages by differencing each page with its nearest URL."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from engramlake.llm.common import columns, cut, numbered, small, stored, table, word_code

PAGE_COLUMNS = (("page_id", "bigint"), ("url", "string"), ("html", "string"))
#: Cells of a table of common lengths that is held at once.
CELLS = 1_000_000
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head|iframe|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")


def text_lines(page: str | None) -> list[str]:
    """The page's visible text, a line for each block; white space is collapsed and empty lines are left out."""
    if not page:
        return []
    s = _BLOCK.sub("\n", re.sub(r"\s+", " ", _HIDDEN.sub(" ", page)))
    s = html.unescape(_TAG.sub("", s))
    return [line for x in s.split("\n") if (line := " ".join(x.split()))]


def line_codes(lines: list[str]) -> np.ndarray:
    """64-bit codes of lines, which are only compared within a pair of pages."""
    return np.frombuffer(b"".join(map(word_code, lines)), np.int64)


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence with b.

    Equal heads and tails are matched first; the rest by the lengths of common subsequences, row by row of a.
    """
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    head = int(np.argmin(np.r_[a[:n] == b[:n], False]))
    out[:head] = True
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int(np.argmin(np.r_[a[::-1][:n] == b[::-1][:n], False]))
    if tail:
        out[len(out) - tail :] = True
        a, b = a[:-tail], b[:-tail]
    both = np.intersect1d(a, b)
    ia, ib = np.flatnonzero(np.isin(a, both)), np.flatnonzero(np.isin(b, both))
    a, b = a[ia], b[ib]
    if not len(a):
        return out
    out[head + ia[_common(a, b)]] = True
    return out


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of common subsequences of a with each head of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(np.where(x == b, row[:-1] + 1, 0), row[1:]))
    return row


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices in a of a longest common subsequence; a table too large for memory is halved first (Hirschberg)."""
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        at = int(np.argmax(_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]))
        return np.concatenate([_common(a[:half], b[:at]), half + _common(a[half:], b[at:])])
    lengths = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        hit = np.where(a[i] == b, lengths[i, :-1] + 1, 0)
        lengths[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, lengths[i, 1:]))
    i, j, found = len(a), len(b), []
    while i and j:
        if lengths[i, j] == lengths[i - 1, j]:
            i -= 1
        elif lengths[i, j] == lengths[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return np.array(found[::-1], np.int64)


def with_place(pages: DataFrame) -> DataFrame:
    """pages with host and path: no scheme, port or www, query, fragment, closing slash, index file or .htm(l)."""
    rest = F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^(?:[^@]*@)?(?:www\.)?|:\d*$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), r"/index\.\w+$|\.html?$", ""), r"/+$", "")
    return pages.withColumns({"host": host, "path": path})


def paths_of(pages: DataFrame) -> DataFrame:
    """host, path, codes, one row for each path: the lines of its page of least page_id. pages: with rid, host and path."""

    def run(batches):
        for b in batches:
            yield b.drop(columns="html").assign(codes=[line_codes(text_lines(h)) for h in b["html"]])

    each = pages.select("rid", "page_id", "host", "path", "html").mapInPandas(run, "rid bigint, page_id bigint, host string, path string, codes array<bigint>")
    return each.groupBy("host", "path").agg(F.min_by("codes", F.struct("page_id", "rid")).alias("codes"))


def _ordered(paths: DataFrame) -> DataFrame:
    """paths with mid, whose order is that of host and path: sorted by range, so that a large host is many tasks' work."""
    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(paths.repartitionByRange(n, "host", "path").sortWithinPartitions("host", "path").select(F.monotonically_increasing_id().alias("mid"), "*"), "paths")


def neighbours(paths: DataFrame) -> DataFrame:
    """host, path, peer: the codes of the nearest other path of the host. paths: host, path and codes, one row each.

    Nearest is the one of the two beside it in the order of paths that has more leading characters in common; the former
    of both on a tie. A path alone in its host has no row.
    """
    p = _ordered(paths)
    # The first row of a partition is beside the last one of the partition before, which has some row.
    pid = F.shiftright("mid", 33)
    ends = cut(p.groupBy(pid.alias("pid")).agg(F.min("mid").alias("lo"), F.max("mid").alias("hi")))
    w = Window.orderBy("pid")  # one row for each partition
    link = cut(ends.select("lo", F.lag("hi").over(w).alias("before")).where("before is not null"))
    pairs = p.select(F.col("mid").alias("m"), "host", F.col("path").alias("q")).join(small(link), F.col("m") == F.col("lo"), "left")
    pairs = pairs.select("m", F.coalesce("before", F.col("m") - 1).alias("mid"), F.col("host").alias("h"), "q")
    beside = p.select("mid", "host", "path").join(pairs, "mid").where("host = h")
    n = F.least(F.length("path"), F.length("q"))
    ca, cb = F.split("path", ""), F.split("q", "")
    off = F.array_position(F.zip_with(F.slice(ca, 1, n), F.slice(cb, 1, n), lambda x, y: x == y), False)
    score = F.when(off > 0, off - 1).otherwise(n)
    beside = beside.select("mid", "m", score.alias("score"))
    both = beside.select(F.col("m").alias("mid"), F.col("mid").alias("peer"), F.struct("score", F.lit(1)).alias("rank")).unionByName(beside.select("mid", F.col("m").alias("peer"), F.struct("score", F.lit(0)).alias("rank")))
    best = both.groupBy("mid").agg(F.max_by("peer", "rank").alias("peer"))
    named = best.join(p.select(F.col("mid").alias("peer"), F.col("codes").alias("peer_codes")), "peer")
    return p.select("mid", "host", "path").join(named, "mid").select("host", "path", F.col("peer_codes").alias("peer"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines, n_dropped, for every row of pages.

    Method: within each host, pages are ordered by URL path and paired with the nearest other path; their text lines are
    aligned by longest common subsequence, and the lines in it, the template's, are deleted. Pages of one path (other
    scheme, query or fragment) aren't each other's peers; the one of least page_id stands for the path.

    A page alone in its host keeps all lines. A null or empty page, or one without text, has text ''. A null url is a
    host of its own, with one path. On a tie of two neighbours the former is the peer. A page counts whole, however long:
    a table of common lengths that would be too large is halved. Repeated rows each get a result; an empty table gives an
    empty result; columns beyond those of pages are left out, whatever their names.
    """
    placed = with_place(numbered(columns(pages, PAGE_COLUMNS)))
    peers = neighbours(paths_of(placed))

    def lines(batches):
        for b in batches:
            yield b.drop(columns="html").assign(lines=[zlib.compress("\n".join(text_lines(h)).encode("utf-8", "surrogatepass"), 1) for h in b["html"]])

    def run(batches):
        for b in batches:
            text, lost, total = [], [], []
            for packed, peer in zip(b["lines"], b["peer"]):
                own = [x for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if x]
                drop = shared_lines(line_codes(own), np.asarray(peer, np.int64)) if peer is not None else np.zeros(len(own), bool)
                text.append("\n".join(x for x, d in zip(own, drop) if not d))
                lost.append(int(drop.sum()))
                total.append(len(own))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_lines": total, "n_dropped": lost})

    # Lines are taken from the pages a second time, which costs less than keeping them on disk, and moved compressed.
    e = placed.select("page_id", "url", "host", "path", "html").mapInPandas(lines, "page_id bigint, url string, host string, path string, lines binary")
    joined = e.join(peers, ["host", "path"], "left").select("page_id", "url", "lines", "peer")
    return joined.mapInPandas(run, "page_id bigint, url string, text string, n_lines bigint, n_dropped bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_lines and n_dropped for every page."""
    return main_text(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op2_html_extraction": op2_html_extraction}
