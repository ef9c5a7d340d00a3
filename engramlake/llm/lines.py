"""Line dedup by a log-template tree: recurring templates across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engramlake.llm import simhash
from engramlake.llm.common import columns, cut, numbered, small, stored, table

#: Leading tokens in the tree, below the token count.
DEPTH = 3
#: Documents in which a template, or a token at its place, has to be, for lines of at least so many tokens: short lines come again by chance.
LEAST_DOCS = ((5, 2), (3, 3), (2, 10), (1, 20))
#: Share of a template's tokens that don't vary.
CONSTANT = 0.8
#: Two documents that share so much of either may be copies; near-duplicates among them are left whole for near-dedup.
COPY_SHARE = 0.5
_MASK = "<*>"
#: White space as Python has it, as the inside of a character class; a token with a digit.
_S = r"\s\x1c-\x1f\x85\p{Z}"
_FIELD = rf"(?<![^{_S}])[^{_S}\p{{Nd}}]*+\p{{Nd}}[^{_S}]*+"


#: White space other than a blank.
_ODD = rf"[\t\x0B\f\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]"


def _tokens(line: Column) -> Column:
    return F.array_remove(F.when(line.rlike(_ODD), F.split(line, f"[{_S}]+")).otherwise(F.split(line, " ")), "")


def _least(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= k, F.lit(docs)) for k, docs in LEAST_DOCS])


def lines(docs: DataFrame, tokens: bool) -> DataFrame:
    """rid, ln, n, leaf, lh, chars, and with tokens the tokens: all lines that have one.

    A token with a digit is a field, _MASK; a line of which more than 1 - CONSTANT would be fields is taken as it is.
    leaf: hash of the count and the leading tokens; lh: hash of all tokens.
    """
    line = docs.select("rid", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")).where(F.col("line").rlike(f"[^{_S}]"))
    digits = F.col("line").rlike(r"\p{Nd}")
    line = line.select("rid", "ln", "line", F.when(digits, F.regexp_replace("line", _FIELD, _MASK)).alias("masked"))
    line = line.select("rid", "ln", F.char_length("line").alias("chars"), _tokens(F.col("line")).alias("own"), F.when(F.col("masked").isNotNull(), _tokens(F.col("masked"))).alias("masked"))
    few = F.size(F.array_remove("masked", _MASK)) >= CONSTANT * F.size("own")
    line = line.select("rid", "ln", "chars", F.when(F.col("masked").isNotNull() & few, F.col("masked")).otherwise(F.col("own")).alias("tokens"))
    n = F.size("tokens")
    hashes = [n.alias("n"), F.xxhash64(n, F.slice("tokens", 1, DEPTH)).alias("leaf"), F.xxhash64("tokens").alias("lh")]
    return line.select("rid", "ln", *hashes, "chars", *["tokens"] * tokens)


def templates(docs: DataFrame, by_line: DataFrame) -> DataFrame:
    """leaf, lh, n, docs, rid, template: the lines, of leaves that enough documents reach, whose template is constant enough.

    In a leaf with several lines, a token that too few documents have at its place is generalised; in a leaf with one
    line, or for a line that has enough documents itself, there's nothing to generalise.
    """
    leaves = by_line.groupBy("leaf", "n").agg(F.sum("docs").alias("reach"), F.count("*").alias("kinds")).where(F.col("reach") >= _least(F.col("n")))
    kept = stored(by_line.join(leaves.select("leaf", "kinds"), "leaf"), "kept")
    plain = kept.where("kinds = 1").select("leaf", "lh", "n", "docs", "rid", F.col("lh").alias("template"))
    several = kept.where("kinds > 1")
    wanted = small(cut(several.select("leaf").distinct()), 1_000_000)
    text = lines(docs, True).join(wanted, "leaf", "left_semi").groupBy("leaf", "lh").agg(F.max(F.array_join("tokens", " ")).alias("line"))
    kinds = stored(several.join(text, ["leaf", "lh"]), "lines")
    # All lines of a leaf share the leading tokens, so those are known to be constant.
    at = kinds.select("leaf", "lh", "n", "docs", "rid", F.posexplode(F.slice(F.split("line", " "), DEPTH + 1, F.greatest(F.col("n") - DEPTH, F.lit(0)))).alias("place", "token"))
    at = at.where(F.col("token") != _MASK).withColumn("key", F.xxhash64("leaf", "place", "token"))
    # A line's code is the sum of its constant tokens': the same for the same tokens at the same places.
    part = F.col("key").cast("decimal(38,0)")
    few = F.col("docs") < _least(F.col("n"))
    whole = F.aggregate(F.transform(F.slice(F.split("line", " "), DEPTH + 1, F.greatest(F.col("n") - DEPTH, F.lit(0))), lambda t, i: F.when(t != _MASK, F.xxhash64("leaf", i, t).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)"))
    known = at.groupBy("key").agg(F.sum("docs").alias("support"), F.min(_least(F.col("n"))).alias("least")).where("support >= least").select("key")
    lead = F.size(F.filter(F.slice(F.split("line", " "), 1, DEPTH), lambda t: t != _MASK))
    shape = at.where(few).select("leaf", "lh", "key").join(known, "key").groupBy("leaf", "lh").agg(F.count("*").alias("same"), F.sum(part).alias("code"))
    varied = kinds.where(few).select("leaf", "lh", "n", "docs", "rid", lead.alias("lead")).join(shape, ["leaf", "lh"], "left")
    varied = varied.where(F.coalesce("same", F.lit(0)) + F.col("lead") >= CONSTANT * F.col("n"))
    named = varied.select("leaf", "lh", "n", "docs", "rid", F.coalesce("code", F.lit(0).cast("decimal(38,0)")).alias("code")).unionByName(kinds.where(~few).select("leaf", "lh", "n", "docs", "rid", whole.alias("code")))
    return plain.unionByName(named.select("leaf", "lh", "n", "docs", "rid", F.xxhash64("leaf", "code").alias("template")))


def near_copies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (rid, head) whose documents near-dedup's own test joins. docs: rid, text."""
    wanted = cut(pairs.select("rid").unionByName(pairs.select(F.col("head").alias("rid"))).distinct())
    prints = cut(simhash.fingerprints(docs.join(small(wanted), "rid", "left_semi").select("rid", F.col("rid").alias("doc_id"), "text")).select("rid", "lo", "hi"))
    other = prints.select(F.col("rid").alias("head"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    bits = F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2")))
    return pairs.join(prints, "rid").join(other, "head").where(bits <= simhash.NEAR).select("rid", "head")


def dropped(docs: DataFrame) -> DataFrame:
    """rid, ln, head: each line to drop, and the row that keeps the template's lines. docs: rid, text."""
    found = stored(lines(docs, False), "lines")
    # A line in very many documents is counted by document first, so no task gets them all.
    by_line = found.select("leaf", "lh", "n", "rid").distinct().groupBy("leaf", "lh", "n").agg(F.count("*").alias("docs"), F.min("rid").alias("rid"))
    by_line = stored(by_line, "kinds")
    of = stored(templates(docs, by_line), "templates")
    recurring = of.groupBy("template", "n").agg(F.sum("docs").alias("docs"), F.min("rid").alias("head")).where(F.col("docs") >= _least(F.col("n")))
    heads = cut(of.join(recurring.select("template", "head"), "template").select("leaf", "lh", "head"))
    again = stored(found.join(small(heads), ["leaf", "lh"]).where("rid <> head").select("rid", "ln", "chars", "head"), "again")
    shared = again.groupBy("rid", "head").agg(F.sum("chars").alias("shared"))
    whole = found.groupBy("rid").agg(F.sum("chars").alias("total"))
    likely = (
        shared.join(whole, "rid").where(F.col("shared") >= COPY_SHARE * F.col("total")).drop("total")
        .join(whole.withColumnRenamed("rid", "head"), "head").where(F.col("shared") >= COPY_SHARE * F.col("total"))
        .select("rid", "head")
    )
    copies = cut(near_copies(docs, cut(likely)))
    return again.join(small(copies), ["rid", "head"], "left_anti").select("rid", "ln", "head")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without lines whose template recurs; the columns of documents, with n_chars of the new text.

    A tree of fixed depth takes a line by its token count and its DEPTH leading tokens, where tokens with digits are
    variable; within a leaf, a token that too few documents (LEAST_DOCS) have at its place is variable too. A template
    recurs if enough documents have it and at least CONSTANT of its tokens don't vary. The first of these documents (in
    the order of the table's files, so there are no ties) keeps its lines, the others lose theirs, but for lines that a
    near-duplicate, by near-dedup's own test, has from its original.

    Lines without a token stay. A document that loses all its text goes; null and blank texts stay as they are. A text
    counts whole, however long, and so does each of its lines. Repeated rows count as documents; an empty table gives an
    empty result; columns beyond those of documents are left out, whatever their names.
    """
    d = numbered(columns(docs))
    gone = cut(dropped(d).groupBy("rid").agg(F.sort_array(F.collect_set("ln")).alias("gone")))
    new = d.join(small(gone), "rid", "left").withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    new = new.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")))
    new = new.where(F.col("gone").isNull() | F.col("kept").rlike(f"[^{_S}]"))
    return new.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("bigint").alias("n_chars"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 0) and kept_in for each line dropped; kept_in is the doc_id that keeps the template."""
    d = numbered(columns(table(spark, sf_dir, "documents")))
    ids = d.select("rid", "doc_id")
    gone = dropped(d)
    return gone.join(ids, "rid").join(ids.select(F.col("rid").alias("head"), F.col("doc_id").alias("kept_in")), "head").select("doc_id", F.col("ln").alias("line"), "kept_in")


def _least_sql(n: str) -> str:
    return f"(CASE {' '.join(f'WHEN {n} >= {k} THEN {docs}' for k, docs in LEAST_DOCS)} END)"


_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM d),
l1 AS (SELECT doc_id, ln, length(line) AS chars, list_filter(string_split_regex(line, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda t: t <> '') AS w FROM l0),
l2 AS (SELECT doc_id, ln, chars, len(w) AS n, w, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '\p{{Nd}}') THEN '{_MASK}' ELSE t END) AS m FROM l1 WHERE len(w) > 0),
l AS (SELECT doc_id, ln, chars, n, CASE WHEN len(list_filter(m, lambda t: t <> '{_MASK}')) >= {CONSTANT} * n THEN m ELSE w END AS w FROM l2),
k AS (SELECT w, n, w[1:{DEPTH}] AS lead, count(DISTINCT doc_id) AS docs, min(doc_id) AS head FROM l GROUP BY ALL),
f AS (SELECT n, lead FROM k GROUP BY ALL HAVING sum(docs) >= {_least_sql('n')}),
kl AS (SELECT k.*, row_number() OVER () AS id FROM k JOIN f USING (n, lead)),
p AS (SELECT id, n, lead, docs, generate_subscripts(w, 1) AS place, unnest(w) AS token FROM kl),
s AS (SELECT n, lead, place, token FROM p WHERE token <> '{_MASK}' GROUP BY ALL HAVING sum(docs) >= {_least_sql('n')}),
t AS (SELECT id, list(struct_pack(place, token) ORDER BY place) AS same FROM p JOIN s USING (n, lead, place, token) GROUP BY id),
tp AS (SELECT kl.w, kl.docs, kl.head, kl.n, kl.lead, t.same FROM kl JOIN t USING (id) WHERE len(t.same) >= {CONSTANT} * kl.n),
r AS (SELECT n, lead, same, min(head) AS head FROM tp GROUP BY ALL HAVING sum(docs) >= {_least_sql('n')}),
h AS (SELECT tp.w, r.head FROM tp JOIN r USING (n, lead, same)),
again AS (SELECT l.doc_id, l.ln, l.chars, h.head FROM l JOIN h USING (w) WHERE l.doc_id <> h.head),
whole AS (SELECT doc_id, sum(chars) AS total FROM l GROUP BY doc_id),
sh AS (SELECT doc_id, head, sum(chars) AS shared FROM again GROUP BY ALL),
likely AS MATERIALIZED (SELECT sh.doc_id, sh.head FROM sh JOIN whole a ON a.doc_id = sh.doc_id JOIN whole b ON b.doc_id = sh.head
         WHERE shared >= {COPY_SHARE} * a.total AND shared >= {COPY_SHARE} * b.total),
cand AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM likely UNION ALL SELECT head FROM likely)),
fp AS MATERIALIZED ({simhash.fingerprint_sql('cand')}),
copy AS (SELECT x.doc_id, x.head FROM likely x JOIN fp a ON a.doc_id = x.doc_id JOIN fp b ON b.doc_id = x.head
         WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= {simhash.NEAR})
SELECT doc_id, CAST(ln AS INT) AS line, head AS kept_in FROM again ANTI JOIN copy USING (doc_id, head)"""

SQL = {"op6_line_dedup": _SQL}
QUERIES = {"op6_line_dedup": op6_line_dedup}
