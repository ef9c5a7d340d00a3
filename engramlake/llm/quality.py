"""Quality rules whose cutoffs come from the corpus: quantile sketches per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from engramlake.llm.common import columns, cut, small, stored, table

GAMMA = 1.05
#: Documents that the parent's quartiles count as, beside a group's own: the language's for a source, the corpus's for a language.
PRIOR = 100.0
#: Quartile distances beyond the quartiles.
WIDTH = 4.0
#: Metric: (least spread that counts, sides that are fenced).
METRICS = {"symbol": (15.0, 1), "upper": (25.0, 1), "repeat": (50.0, 1), "word_len": (15.0, 2)}
_SPACE = r"[ \t\n\r\f]+"


def metrics(text: Column) -> dict[str, Column]:
    """Whole numbers for a text that isn't blank: thousandths, and tenths of a character for word_len.

    symbol: neither letter, digit nor space, of all characters; upper: capitals, of all characters; repeat: words equal
    to the word before, of all words; word_len: characters other than spaces to a word.
    """
    w = F.split(F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}$", ""), _SPACE)
    same = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: a == b)
    count = lambda c: c.cast("bigint")
    return {
        "n_words": count(F.size(w)),
        "symbol": count(F.floor(F.length(F.regexp_replace(text, r"[\p{L}\p{N} \t\n\r\f]+", "")) * 1000 / F.length(text))),
        "upper": count(F.floor(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) * 1000 / F.length(text))),
        "repeat": count(F.floor(F.size(F.filter(same, lambda x: x)) * 1000 / F.size(w))),
        "word_len": count(F.floor(F.length(F.regexp_replace(text, _SPACE, "")) * 10 / F.size(w))),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the metrics; documents without a word are left out."""
    d = columns(docs).where(F.length(F.regexp_replace("text", _SPACE, "")) > 0)
    return d.select("*", *[c.alias(n) for n, c in metrics(F.col("text")).items()])


def sketch(m: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: a log-bucket sketch (relative error GAMMA - 1), merged by adding up n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in METRICS])).alias("x")
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log(F.col("x.v").cast("double")) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-1)).cast("int")
    return m.select("lang", "source", pairs).groupBy("lang", "source", F.col("x.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, n, q1, q3: from the sketches merged over all else."""
    merged = sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.select("*", F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    value = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    q = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), value))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("n"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def fences(sk: DataFrame) -> DataFrame:
    """lang, source, metric, low, high for each source in a language.

    A group's quartiles are drawn to its language's by PRIOR documents' weight, and those to the whole corpus's, so that a
    group of few documents leans on its parents and one of many doesn't; no size is treated differently from the next.
    WIDTH spreads beyond the quartiles, a spread being the distance of the quartiles, or the metric's least one if that is more.
    """
    own = quartiles(sk, ["lang", "source"])
    lang = quartiles(sk, ["lang"]).select(F.col("lang").alias("_lang"), F.col("metric").alias("_metric"), F.col("n").alias("n1"), F.col("q1").alias("q11"), F.col("q3").alias("q31"))
    whole = quartiles(sk, []).select(F.col("metric").alias("_m"), F.col("q1").alias("q12"), F.col("q3").alias("q32"))
    f = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric"))).join(whole, F.col("metric") == F.col("_m"))
    for q in ("q1", "q3"):
        parent = (F.col("n1") * F.col(f"{q}1") + PRIOR * F.col(f"{q}2")) / (F.col("n1") + PRIOR)
        f = f.withColumn(f"{q}b", (F.col("n") * F.col(q) + PRIOR * parent) / (F.col("n") + PRIOR))
    least = F.coalesce(*[F.when(F.col("metric") == k, F.lit(s)) for k, (s, _) in METRICS.items()])
    two = F.col("metric").isin([k for k, (_, sides) in METRICS.items() if sides == 2])
    spread = F.greatest(F.col("q3b") - F.col("q1b"), least)
    return f.select("lang", "source", "metric", F.when(two, F.col("q1b") - WIDTH * spread).otherwise(F.lit(-1.0)).alias("low"), (F.col("q3b") + WIDTH * spread).alias("high"))


def judged(m: DataFrame) -> DataFrame:
    """Every row of m with failed, the list of metrics outside the fences of its language and source. m is read twice."""
    f = fences(cut(sketch(m)))
    wide = cut(f.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("_f")))
    out = m.join(small(wide), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    f = F.col("_f")
    failed = F.array_compact(F.array(*[F.when((F.col(k) < f[k]["low"]) | (F.col(k) > f[k]["high"]), F.lit(k)) for k in METRICS]))
    return out.select(*m.columns, failed.alias("failed"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that no adaptive quality rule rejects, with the columns of documents.

    Method: each metric's values go into a log-bucket quantile sketch for each language and source; sketches are merged
    to the language's and the whole corpus's, which steady those of small groups. Cutoffs are WIDTH quartile distances
    beyond the quartiles, and are joined back to the documents, which are kept with their metrics in the meantime.

    Null or blank texts are rejected. A null language or source is a group of its own. A text counts whole, however long.
    A value equal to a cutoff passes. Repeated rows count and stay as often as they come; an empty table gives an empty
    result; columns beyond those of documents are left out, whatever their names.
    """
    return judged(stored(measured(docs), "measured")).where(F.size("failed") == 0).select("doc_id", "text", "lang", "source", "n_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and metrics of the documents kept."""
    m = stored(measured(table(spark, sf_dir, "documents")).drop("text", "n_chars"), "measured")
    return judged(m).where(F.size("failed") == 0).select("doc_id", "lang", "source", "n_words", *METRICS)


def _sql() -> str:
    sp = r"[ \t\n\r\f]+"
    g, union = repr(math.log(GAMMA)), " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS v FROM m" for k in METRICS)
    least = " ".join(f"WHEN '{k}' THEN {s}" for k, (s, _) in METRICS.items())
    two = ", ".join(f"'{k}'" for k, (_, n) in METRICS.items() if n == 2)
    ok = " AND ".join(f"""NOT EXISTS (SELECT 1 FROM fence f WHERE f.metric = '{k}' AND f.source IS NOT DISTINCT FROM m.source
        AND f.lang IS NOT DISTINCT FROM m.lang AND (m.{k} < f.low OR m.{k} > f.high))""" for k in METRICS)
    p = PRIOR
    return rf"""
WITH d AS (SELECT doc_id, text, lang, source, string_split_regex(regexp_replace(text, '^{sp}|{sp}$', '', 'g'), '{sp}') AS w
           FROM documents WHERE length(regexp_replace(text, '{sp}', '', 'g')) > 0),
m0 AS (SELECT doc_id, text, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(floor(length(regexp_replace(text, '[\p{{L}}\p{{N}} \t\n\r\f]+', '', 'g')) * 1000 / length(text)) AS BIGINT) AS symbol,
    CAST(floor(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) * 1000 / length(text)) AS BIGINT) AS upper,
    CAST(floor(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) * 1000 / len(w)) AS BIGINT) AS repeat,
    CAST(floor(length(regexp_replace(text, '{sp}', '', 'g')) * 10 / len(w)) AS BIGINT) AS word_len FROM d),
m AS (SELECT * FROM m0),
b AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN CAST(ceil(ln(CAST(v AS DOUBLE)) / {g}) AS INT) ELSE -1 END AS bucket FROM ({union})),
s AS (SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL
      SELECT 1, lang, NULL, metric, bucket, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM b GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
      CASE WHEN bucket < 0 THEN 0.0::DOUBLE ELSE pow({GAMMA}::DOUBLE, bucket) END AS val FROM s),
q AS (SELECT level, lang, source, metric, max(total)::DOUBLE AS n, min(val) FILTER (upto >= 0.25 * total) AS q1, min(val) FILTER (upto >= 0.75 * total) AS q3 FROM r GROUP BY ALL),
bl AS (SELECT a.lang, a.source, a.metric, (a.n * a.q1 + {p} * ((l.n * l.q1 + {p} * w.q1) / (l.n + {p}))) / (a.n + {p}) AS q1,
      (a.n * a.q3 + {p} * ((l.n * l.q3 + {p} * w.q3) / (l.n + {p}))) / (a.n + {p}) AS q3
      FROM q a JOIN q l ON a.level = 0 AND l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.metric = a.metric JOIN q w ON w.level = 2 AND w.metric = a.metric),
fence AS (SELECT lang, source, metric, CASE WHEN metric IN ({two}) THEN q1 - {WIDTH} * greatest(q3 - q1, CASE metric {least} END) ELSE -1 END AS low,
      q3 + {WIDTH} * greatest(q3 - q1, CASE metric {least} END) AS high FROM bl)
SELECT doc_id, lang, source, n_words, {', '.join('m.' + k for k in METRICS)} FROM m WHERE {ok}"""


SQL = {"op10_quality_rules": _sql()}
QUERIES = {"op10_quality_rules": op10_quality_rules}
