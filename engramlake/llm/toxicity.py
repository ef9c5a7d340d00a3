"""Toxicity by lexicon induction: random walks over a word graph of positive pointwise mutual information."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, cut, mix64, shared_dir, small, stored, table, word_code, word_codes

#: English seed terms given by hand, beside those that the labels give; those that the corpus lacks don't count.
TOXIC_SEEDS = ("idiot", "stupid", "moron", "scum", "trash", "loser")
#: Labelled documents looked at for seeds, for each language and label (about; all where there are fewer).
LABELLED = 4000
#: A seed's labelled documents of its pole, at least; its least log-likelihood ratio (G2), or more where many words are tried; and a pole's most seeds.
LEAST_DOCS, LEAST_G2, SEEDS = 3, 10.0, 200
#: How many times as often documents of its pole have a seed: common words that toxic documents have somewhat more often are none.
LEAST_RATIO = 4.0
#: Words on either side that count as near.
REACH = 10
#: Times that two words have to be near for an edge, and least PPMI (bits) of one.
LEAST_NEAR, LEAST_PPMI = 5, 3.0
#: Share of a language's words from which a word is followed no further: one that is around every place of another comes to
#: less than LEAST_PPMI there.
COMMON = 1 / (2 * REACH * 2**LEAST_PPMI)
#: A walk's chance to go back to its seeds, and its steps.
RESTART, STEPS = 0.3, 8
#: Share of the heaviest word's weight that a word needs to be in the lexicon, and to have its own edges looked up.
LEAST_WEIGHT = 0.05
#: A document's score from which it is toxic: lexicon weight per SCALE words, SCALE at least.
TOXIC, SCALE = 0.3, 100
#: Share of a language's labelled clean documents that may reach its least toxic score.
FALSE = 0.02
#: Pairs of near words that a task holds.
_HELD = 1 << 20
#: Documents (about) that the books of frequent words come from, and words in all books. They change what the encoded words
#: take on disk, and no result.
BOOK_DOCS, BOOK = 16_000, 1 << 17


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ids and rare, which read() turns to the 64-bit codes of all words in order: written once, for all passes.

    ids has 16 bits for each word, its place in its language's book of frequent words, and 0 for one that isn't there, whose
    code is in rare. A language without a book has all its codes in rare. The books are in the shared folder, where the
    metadata of ids says.
    """
    spark, d = docs.sparkSession, columns(docs).select("doc_id", "lang", "text")
    n = d.count()
    sample = d if n <= BOOK_DOCS else d.sample(BOOK_DOCS / n, 17)
    top = word_counts(_encode(sample, {})).where("n > 1").orderBy(F.desc("n"), "lang", "code").limit(BOOK).toPandas()
    books = {k: g["code"].to_numpy(np.int64)[: (1 << 16) - 1] for k, g in top.groupby("lang")}
    path = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    spark.createDataFrame([(k, x.tobytes()) for k, x in books.items()], "lang string, codes binary").write.parquet(path)
    return stored(_encode(d, books).withMetadata("ids", {"books": path}), "words")


def _encode(docs: DataFrame, books: dict[str, np.ndarray]) -> DataFrame:
    def run(batches):
        coder = ChunkCoder(word_codes)
        by = {k: (np.sort(x), np.argsort(x).astype(np.uint16) + np.uint16(1)) for k, x in books.items()}
        for b in batches:
            ids, rare = [], []
            for lang, text in zip(b["lang"], b["text"]):
                c = coder.array(text, np.int64)
                if lang in by:
                    own, place = by[lang]
                    at = np.minimum(np.searchsorted(own, c), len(own) - 1)
                    there = own[at] == c
                    ids.append(np.where(there, place[at], np.uint16(0)).tobytes())
                    rare.append(c[~there].tobytes())
                else:
                    ids.append(b"")
                    rare.append(c.tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang": b["lang"], "ids": ids, "rare": rare})

    return docs.mapInPandas(run, "doc_id bigint, lang string, ids binary, rare binary")


def reader(enc: DataFrame):
    """A function that gives, for a batch with lang, ids and rare of enc, each row's word codes."""
    path = enc.schema["ids"].metadata.get("books")
    rows = enc.sparkSession.read.schema("lang string, codes binary").parquet(path).collect() if path else []
    books = {r["lang"]: np.r_[0, np.frombuffer(r["codes"], np.int64)] for r in rows}

    def read(b):
        for lang, ids, rare in zip(b["lang"], b["ids"], b["rare"]):
            c = np.frombuffer(rare, np.int64)
            if lang in books:
                at = np.frombuffer(ids, np.uint16)
                own = books[lang][at]
                own[at == 0] = c
                c = own
            yield c

    return read


def word_counts(enc: DataFrame) -> DataFrame:
    """lang, code, n: how often each word comes in all documents of a language, counted ahead in each task."""
    read = reader(enc)

    def run(batches):
        for b in batches:
            by: dict[str, list] = {}
            for lang, c in zip(b["lang"], read(b)):
                by.setdefault(lang, []).append(c)
            for lang in list(by):
                codes, n = np.unique(np.concatenate(by.pop(lang)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    return enc.where("lang IS NOT NULL").select("lang", "ids", "rare").mapInPandas(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def labelled(enc: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, label, ids, rare: a sample of the labelled documents, LABELLED for each language and label, by a hash of doc_id."""
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    named = cut(enc.where("lang IS NOT NULL").select("doc_id", "lang").join(known, "doc_id"))
    share = named.groupBy("lang", "label").agg(F.least(F.lit(1.0), F.lit(float(LABELLED)) / F.count("*")).alias("share"))
    picked = named.join(small(cut(share)), ["lang", "label"]).where("pmod(xxhash64(doc_id), 1000000) < share * 1000000").select("doc_id", "label").distinct()
    return enc.where("lang IS NOT NULL").join(small(cut(picked)), "doc_id").select("doc_id", "lang", "label", "ids", "rare")


def label_seeds(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """lang: codes of the words that toxic documents have more often than chance has it, and of those that clean ones have.

    A document counts a word once, and documents that have it in one surrounding count once, so that copies don't. The
    least G2 is 2 ln of the number of words tried, if that is more: then about one word of a language gets in by chance.
    A seed is LEAST_RATIO times as frequent in its pole's documents as in the other's, at least.
    sample: as labelled() gives it, which bounds what comes to the driver.
    """
    read = reader(sample)

    def run(batches):
        for b in batches:
            out = []
            for lang, label, c in zip(b["lang"], b["label"], read(b)):
                around = _around(c)
                order = np.lexsort((around, c))
                code, first = np.unique(c[order], return_index=True)
                out.append(pd.DataFrame({"lang": lang, "label": label, "code": code, "around": around[order][first]}))
                if sum(map(len, out)) >= _HELD:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    rows = sample.select("lang", "label", "ids", "rare").mapInPandas(run, "lang string, label int, code bigint, around bigint")
    of = lambda label: F.sum((F.col("label") == label).cast("bigint"))
    found = rows.distinct().groupBy("lang", "code").agg(of(1).alias("t"), of(0).alias("n")).where(f"t >= {LEAST_DOCS} OR n >= {LEAST_DOCS}").toPandas()
    sizes = {(r["lang"], r["label"]): r["count"] for r in sample.groupBy("lang", "label").count().collect()}
    out = {}
    for lang, g in found.groupby("lang"):
        nt, nn = sizes.get((lang, 1), 0), sizes.get((lang, 0), 0)
        if nt and nn:
            g2 = _g2(g["t"].to_numpy(float), g["n"].to_numpy(float), nt, nn)
            code, poles = g["code"].to_numpy(np.int64), []
            for sign, pole in ((1, "t"), (-1, "n")):
                tried = (g[pole] >= LEAST_DOCS).to_numpy()
                rates = (g["t"] / nt).to_numpy(), (g["n"] / nn).to_numpy()
                far = rates[sign < 0] >= LEAST_RATIO * rates[sign > 0]
                ok = np.flatnonzero(tried & far & (sign * g2 >= max(LEAST_G2, 2 * math.log(max(1, tried.sum())))))
                poles.append(code[ok[np.lexsort((code[ok], -sign * g2[ok]))][:SEEDS]])
            out[lang] = tuple(poles)
    return out


def _g2(t: np.ndarray, n: np.ndarray, nt: int, nn: int) -> np.ndarray:
    """Log-likelihood ratio of words in t of nt toxic and n of nn clean documents, below 0 where the clean have them more often."""
    p = (t + n) / (nt + nn)
    out = np.zeros(len(t))
    for o, e in ((t, p * nt), (n, p * nn), (nt - t, (1 - p) * nt), (nn - n, (1 - p) * nn)):
        out += np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * np.maximum(out, 0) * np.where(t > p * nt, 1, -1)


def _around(c: np.ndarray) -> np.ndarray:
    """For each word, a hash of the two beside it."""
    padded = np.r_[0, c, 0].view(np.uint64)
    return mix64(padded[:-2] + mix64(padded[2:])).view(np.int64)


def near_counts(enc: DataFrame, terms: dict[str, np.ndarray]) -> DataFrame:
    """lang, a, b, n: how often b is within REACH words of a, one of the language's terms; LEAST_NEAR at least.

    Passages that are copied count once: n is the number of different pairs of words around b.
    """
    terms = {k: np.sort(v) for k, v in terms.items() if len(v)}
    read = reader(enc)

    def run(batches):
        for b in batches:
            out, n = {}, 0
            for lang, c in zip(b["lang"], read(b)):
                own = terms.get(lang)
                if own is None or not len(c):
                    continue
                at = np.flatnonzero(own[np.minimum(np.searchsorted(own, c), len(own) - 1)] == c)
                for s in range(0, len(at), _HELD // (2 * REACH)):
                    i = np.repeat(at[s : s + _HELD // (2 * REACH)], 2 * REACH)
                    j = i + np.tile(np.r_[-REACH:0, 1 : REACH + 1], len(i) // (2 * REACH))
                    ok = (j >= 0) & (j < len(c))
                    i, j = i[ok], j[ok]
                    ok = c[i] != c[j]
                    i, j = i[ok], j[ok]
                    out.setdefault(lang, []).append(np.stack([c[i], c[j], _around(c)[j]], 1))
                    n += len(i)
                    if n >= _HELD:
                        yield from _distinct(out)
                        out, n = {}, 0
            yield from _distinct(out)

    each = enc.where(F.col("lang").isin(list(terms))).select("lang", "ids", "rare").mapInPandas(run, "lang string, a bigint, b bigint, around bigint").distinct()
    return each.groupBy("lang", "a", "b").agg(F.count("*").alias("n")).where(f"n >= {LEAST_NEAR}")


def _distinct(held: dict[str, list]):
    for lang, parts in held.items():
        x = np.concatenate(parts)
        yield pd.DataFrame(x[np.unique(mix64(mix64(mix64(x[:, 0].view(np.uint64)) + x[:, 1].view(np.uint64)) + x[:, 2].view(np.uint64)), return_index=True)[1]], columns=["a", "b", "around"]).assign(lang=lang)[["lang", "a", "b", "around"]]


def ppmi(pairs: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, a, b, weight: pairs with what they are nearer than chance, log2 of the ratio; those under LEAST_PPMI are left out."""
    ca, cb = counts.select("lang", F.col("code").alias("a"), F.col("n").alias("na")), counts.select("lang", F.col("code").alias("b"), F.col("n").alias("nb"))
    weight = F.log2(F.col("n") * F.col("total") / (F.lit(2.0 * REACH) * F.col("na") * F.col("nb")))
    return pairs.join(small(totals), "lang").join(ca, ["lang", "a"]).join(cb, ["lang", "b"]).select("lang", "a", "b", weight.alias("weight")).where(f"weight >= {LEAST_PPMI}")


def walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    """lang, code, toxic, clean: the share of either pole's walks that is at a word after STEPS steps.

    A walk goes to a near word by weight, or with RESTART back to a seed; at a word without edges it ends. start: lang,
    code, toxic, clean, where either pole's shares add up to 1. Each step is a join and a sum over the edges.
    """
    out = edges.groupBy("lang", "a").agg(F.sum("weight").alias("out"))
    step = small(cut(edges.join(out, ["lang", "a"]).select("lang", F.col("a").alias("code"), "b", (F.col("weight") / F.col("out")).alias("p"))))
    at = start
    for _ in range(STEPS):
        moved = at.join(step, ["lang", "code"]).select("lang", F.col("b").alias("code"), *[((1 - RESTART) * F.col(c) * F.col("p")).alias(c) for c in ("toxic", "clean")])
        again = start.select("lang", "code", *[(RESTART * F.col(c)).alias(c) for c in ("toxic", "clean")])
        at = moved.unionByName(again).groupBy("lang", "code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return at


def induce(enc: DataFrame, seeds: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, dict[int, float]]:
    """lang: word code: polarity, from all documents of the language; seeds are codes of toxic and of clean words.

    Polarity is a word's share of the toxic walks less that of the clean ones, each as a part of the pole's greatest share.
    The graph is followed from the seeds outwards: as long as a word whose share is LEAST_WEIGHT of the greatest hasn't had
    its own edges looked up, they are, and the walks go again. As shares add up to 1 and the greatest is at least
    RESTART / SEEDS, these are at most SEEDS / (LEAST_WEIGHT * RESTART) words for each pole, however large the corpus; only
    they come to the driver. A word of COMMON share of the language's words is no seed, and has no edges looked up.
    """
    spark = enc.sparkSession
    counts = stored(word_counts(enc), "counts")
    totals = cut(counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")))
    given = [(k, int(c), pole) for k, poles in seeds.items() for pole, codes in zip(("toxic", "clean"), poles) for c in codes]
    seeded = spark.createDataFrame(given, "lang string, code bigint, pole string")
    rare = counts.join(small(totals), "lang").where(F.col("n") < COMMON * F.col("total")).select("lang", "code")
    there = seeded.join(rare, ["lang", "code"]).select("lang", "code", "pole", F.lit(True).alias("rare")).collect() if given else []
    if not there:
        return {}
    sizes: dict = {}
    for r in there:
        sizes[r["lang"], r["pole"]] = sizes.get((r["lang"], r["pole"]), 0) + 1
    share = lambda r, pole: 1 / sizes[r["lang"], pole] if r["pole"] == pole else 0.0
    start = cut(spark.createDataFrame([(r["lang"], r["code"], share(r, "toxic"), share(r, "clean")) for r in there], "lang string, code bigint, toxic double, clean double"))
    known: dict[str, set] = {}
    edges = None
    while True:
        new: dict[str, list] = {}
        for r in there:
            if r["rare"] and r["code"] not in known.setdefault(r["lang"], set()):
                known[r["lang"]].add(r["code"])
                new.setdefault(r["lang"], []).append(r["code"])
        if not new:
            return {k: {r["code"]: r["weight"] for r in there if r["lang"] == k and abs(r["weight"]) >= LEAST_WEIGHT} for k in known}
        found = stored(ppmi(near_counts(enc, {k: np.array(v, np.int64) for k, v in new.items()}), counts, totals), "edges")
        edges = found if edges is None else edges.unionByName(found)
        at = cut(walk(edges, start))
        top = at.groupBy("lang").agg(F.max("toxic").alias("mt"), F.max("clean").alias("mc"))
        of = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
        at = at.join(small(cut(top)), "lang").select("lang", "code", of("toxic", "mt").alias("t"), of("clean", "mc").alias("c"))
        reached = at.where(f"greatest(t, c) >= {LEAST_WEIGHT}").select("lang", "code", (F.col("t") - F.col("c")).alias("weight"))
        there = reached.join(rare.withColumn("rare", F.lit(True)), ["lang", "code"], "left").select("lang", "code", "weight", F.coalesce("rare", F.lit(False)).alias("rare")).collect()


def lexicons(enc: DataFrame, labels: DataFrame) -> tuple[dict[str, dict[int, float]], dict[str, float]]:
    """Each language's lexicon and its least toxic score, which is TOXIC or a higher one by the labelled sample (_least)."""
    sample = labelled(enc, labels)
    seeds = label_seeds(sample)
    by_hand = np.array([int.from_bytes(word_code(s), "little", signed=True) for s in TOXIC_SEEDS], np.int64)
    toxic, clean = seeds.get("en", (np.empty(0, np.int64), np.empty(0, np.int64)))
    seeds["en"] = np.union1d(toxic, by_hand), np.setdiff1d(clean, by_hand)
    own = induce(enc, dict(sorted(seeds.items())))
    known = score(sample, own).join(sample.select("doc_id", "lang", "label"), "doc_id").select("lang", "label", "score").toPandas()
    return own, {k: _least(g["score"].to_numpy(), g["label"].to_numpy() == 1) for k, g in known.groupby("lang")}


def _least(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The lower of the scores from which F1 is best and that FALSE of the clean reach, TOXIC at least.

    F1 alone is too strict, as the sample gave the lexicon its words; the clean alone are, where some have toxic copies.
    """
    tries = np.unique(np.r_[TOXIC, scores[toxic & (scores > TOXIC)]])
    f1 = [2 * (toxic & (scores >= x)).sum() / max(1, toxic.sum() + (scores >= x).sum()) for x in tries]
    clean = np.quantile(scores[~toxic], 1 - FALSE, method="higher") if (~toxic).any() else TOXIC
    return max(TOXIC, min(float(tries[int(np.argmax(f1))]), float(clean)))


def score(enc: DataFrame, own: dict[str, dict[int, float]], least: dict[str, float] | None = None) -> DataFrame:
    """doc_id, hits, score, toxic, for every row of enc, which encoded() gives.

    Method: a graph joins words that are near one another more than chance has it (PPMI); random walks with restart from
    labelled seed terms of both poles give words their polarity; a document's score is the sum of its words' polarity, per
    SCALE words for a document of more. hits: the number of its words of toxic polarity; toxic: whether the score reaches
    the language's least score, or TOXIC. A document of a language without a lexicon gets the toxic words of all.

    A null text, or one without words, scores 0; so do all where the corpus has no seed. A text counts whole, however
    long. A score equal to the least is toxic. Repeated rows are each scored; an empty table gives an empty result; columns
    other than doc_id, text and lang aren't read, whatever their names.
    """

    def arrays(x):
        codes = np.array(sorted(x), np.int64)
        return codes, np.array([x[int(c)] for c in codes], float)

    every: dict[int, float] = {}
    for lexicon in own.values():
        for c, w in lexicon.items():
            if w > 0:
                every[c] = max(w, every.get(c, 0.0))
    other, by = arrays(every), {k: arrays(x) for k, x in own.items() if x}
    read = reader(enc)

    def run(batches):
        for b in batches:
            hits, total = np.zeros(len(b), np.int64), np.zeros(len(b))
            need = np.array([(least or {}).get(lang, TOXIC) for lang in b["lang"]], float)
            for i, (c, lang) in enumerate(zip(read(b), b["lang"])):
                codes, weights = by.get(lang, other)
                if len(c) and len(codes):
                    at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                    w = weights[at[codes[at] == c]]
                    hits[i], total[i] = (w > 0).sum(), w.sum() * SCALE / max(SCALE, len(c))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "hits": hits, "score": total.round(6), "toxic": total.round(6) >= need})

    return enc.select("doc_id", "lang", "ids", "rare").mapInPandas(run, "doc_id bigint, hits bigint, score double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, hits, score and toxic for every document, by the lexicons that all documents give from each language's seeds."""
    enc = encoded(table(spark, sf_dir, "documents"))
    return score(enc, *lexicons(enc, table(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
QUERIES = {"op7_toxicity": op7_toxicity}
