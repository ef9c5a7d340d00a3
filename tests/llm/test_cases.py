"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import decontaminate, htmltext, language, licenses, lines, lmscore, mixing, quality, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ("rid", "n", "leaf", "lo", "term", "gone", "words", "tokens", "count", "score", "key")
LONG = " ".join(f"word{i % 997} andmore{i % 13}" for i in range(60_000)) + "\n" + "x" * 300_000
ROWS = [
    (1, "a plain text of several words that is long enough to count as one", "en", "s0", 65),
    (1, "a plain text of several words that is long enough to count as one", "en", "s0", 65),
    (2, None, "en", "s0", None),
    (3, "", "en", "s0", 0),
    (4, " \n\t ", None, None, 4),
    (None, "a text without a number, which has words of its own all the same", "en", None, 10),
    (5, LONG, "en", "s1", len(LONG)),
    (6, "a plain text of several words that is long enough to count as one", None, "s1", 65),
    (7, "!!! ??? ...", "xx", "s1", 11),
    (8, "emoji 😀 and \u0000 nul, 中文字符 and Ünïcödé", "en", "s1", 30),
]


def frame(spark, rows=ROWS):
    d = spark.createDataFrame(rows, DOCS)
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def bench(spark, rows=((1, "a plain text of several words that is long enough to count as one"), (2, None), (3, ""), (None, "four words are few"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


STAGES = {
    "quality": lambda s, d: quality.quality_filter(d),
    "lines": lambda s, d: lines.line_dedup(d),
    "simhash": lambda s, d: simhash.near_dedup(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, bench(s)),
}
WHOLE = {
    "language": (lambda s, d: language.identify(d, language.prototypes(language.columns(d)))),
    "toxicity": (lambda s, d: toxicity.score(e := toxicity.encoded(d), *toxicity.lexicons(e, s.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")))),
    "lmscore": (lambda s, d: lmscore.score(e := lmscore.encoded(d), *lmscore.fit(e))),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, name):
    out = STAGES[name](spark, frame(spark)).collect()
    assert out and list(out[0].asDict()) == [c.split()[0] for c in DOCS.split(", ")]
    ids = [r["doc_id"] for r in out]
    if name == "quality":
        assert not {2, 3, 4} & set(ids) and ids.count(1) == 2
    if name == "lines":
        assert {2, 3, 4} <= set(ids) and len(ids) == len(ROWS)
    if name == "simhash":
        assert sorted(i for i in ids if i in (1, 6)) == [1] and {2, 3, 4, 5, 7, 8, None} <= set(ids)
    if name == "decontaminate":
        assert not {1, 6} & set(ids) and {2, 3, 4, 5, 7, 8, None} <= set(ids)


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_nothing(spark, name):
    out = STAGES[name](spark, frame(spark, []))
    assert out.count() == 0 and out.columns == [c.split()[0] for c in DOCS.split(", ")]


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_has_a_result(spark, name):
    out = WHOLE[name](spark, frame(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    by = {r["doc_id"]: r for r in out}
    if name == "language":
        assert by[2]["language"] == by[3]["language"] == by[7]["language"] == "und" and by[1]["language"] == "en"
    if name == "toxicity":
        assert by[2]["score"] == by[3]["score"] == 0 and by[2]["toxic"] is False
    if name == "lmscore":
        assert by[2]["n_tokens"] == 0 and by[2]["mean_log_prob"] is None and by[1]["mean_log_prob"] < 0


@pytest.mark.parametrize("name", WHOLE)
def test_nothing_in_nothing_out(spark, name):
    assert WHOLE[name](spark, frame(spark, [])).count() == 0


def test_licenses(spark):
    out = licenses.scan(frame(spark, [*ROWS, (9, "x All rights reserved. y\nAll rights reserved", "en", "s", 1)])).collect()
    assert [(r["doc_id"], r["license"]) for r in out] == [(9, "proprietary")] * 2
    assert licenses.scan(frame(spark, [])).count() == 0


def test_mixing(spark):
    out = mixing.mix(frame(spark), block=64, shard=16).collect()
    assert out and all(len(r["tokens"]) == 128 for r in out) and "" in {r["source"] for r in out}
    assert mixing.mix(frame(spark, [])).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.org/x/1", "<p>Top</p><p>One</p>"), (2, "http://a.org/x/2", "<p>Top</p><p>Two</p>"), (2, "http://a.org/x/2", "<p>Top</p><p>Two</p>"), (3, None, "<p>Lone"), (4, "http://a.org/x/1#top", None), (5, "http://b.org", ""), (None, "", "<p>" + "long " * 50_000)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("c").alias("host"), F.lit("c").alias("path"), F.lit(0).alias("rid"))
    out = htmltext.main_text(d).collect()
    by = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert len(out) == len(rows) and by[1, "http://a.org/x/1"] == "One" and by[2, "http://a.org/x/2"] == "Two"
    assert by[3, None] == "Lone" and by[4, "http://a.org/x/1#top"] == "" and by[5, "http://b.org"] == ""
    assert htmltext.main_text(d.limit(0)).count() == 0


def test_empty_benchmark(spark):
    assert decontaminate.decontaminate(frame(spark), bench(spark, ())).count() == len(ROWS)


def test_pipeline_over_cases(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and 1 not in {i for r in out for i in r["doc_ids"]}


def test_pipeline_over_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_any_size(spark):
    """Plain Hamming distance decides, also where a paragraph was added."""
    r, prints, texts = random.Random(8), [], []
    for _ in range(60):
        w = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
        texts += [" ".join(w), " ".join(w[: r.randrange(110, 135)])]
    d = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    d = simhash.numbered(simhash.columns(d)).coalesce(1)
    got = simhash.cut(simhash.fingerprints(d)).collect()
    x = {g["rid"]: (g["lo"] & (2**64 - 1) | (g["hi"] & (2**64 - 1)) << 64, g["n"]) for g in got}
    want = {(a, b) for a in x for b in x if a < b and (x[a][0] ^ x[b][0]).bit_count() <= simhash.NEAR}
    sizes = [max(x[a][1], x[b][1]) / min(x[a][1], x[b][1]) for a, b in want]
    assert sum(s > 1.08 for s in sizes) >= 5
    assert {(p["a"], p["b"]) for p in simhash.near_pairs(simhash.cut(simhash.fingerprints(d))).collect()} == want


def planted(spark):
    """Documents with a benchmark passage, exact copies and shared lines among plain ones."""
    r = random.Random(11)
    w = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(r.choice(w) for _ in range(12)) for _ in range(4))
        if i % 6 == 0:
            text += "\n" + ROWS[0][1]
        if i % 5 == 4:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return rows


INPUTS = {
    "splits": lambda s, path: s.read.parquet(path),
    "dropDuplicates": lambda s, path: s.read.parquet(path).dropDuplicates(["doc_id"]),
    "repartition": lambda s, path: s.read.parquet(path).repartition(5),
    "orderBy": lambda s, path: s.read.parquet(path).orderBy("doc_id"),
    "union": lambda s, path: s.read.parquet(path).where("doc_id < 20").unionByName(s.read.parquet(path).where("doc_id >= 20")),
}


@pytest.fixture(scope="module")
def planted_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted") / "documents.parquet")
    spark.createDataFrame(planted(spark), DOCS).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return path


@pytest.mark.parametrize("kind", INPUTS)
@pytest.mark.parametrize("name", ["lines", "simhash", "decontaminate"])
def test_rows_keep_their_numbers(spark, planted_files, name, kind):
    """Whatever the input is, and however its splits change while an operator reads it again, the kept rows are right."""
    clean = {i for i, t, *_ in planted(spark) if ROWS[0][1] not in t}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cut = STAGES_MODULE[name].cut

    def changing(df):
        out = cut(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500" if spark.conf.get("spark.sql.files.maxPartitionBytes") != "1500" else before)
        return out

    try:
        STAGES_MODULE[name].cut = changing
        out = STAGES[name](spark, INPUTS[kind](spark, planted_files)).collect()
    finally:
        STAGES_MODULE[name].cut = cut
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids, texts = [r["doc_id"] for r in out], [r["text"] for r in out]
    if name == "decontaminate":
        assert set(ids) == clean
    if name == "simhash":
        assert len(ids) == 48 and len(set(texts)) == 48
    if name == "lines":
        assert sum(ROWS[0][1] in t for t in texts) - 1 <= sum(i % 6 == 0 and i % 5 == 3 for i in range(60)) * 2 and len(ids) == 60


STAGES_MODULE = {"lines": lines, "simhash": simhash, "decontaminate": decontaminate}
