"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, cut, small, table

DIM, NGRAM = 1024, 3
#: Labelled documents of a language from which its prototype is made, about so many by a hash of doc_id; the classifier's sample.
SAMPLE = 2000
#: Cosine below which a text is in no known language.
LEAST = 0.15
_GRAM_LIMIT = 100_000


def letter_vector(letter: str) -> np.ndarray:
    """The random vector of +1 and -1 that stands for a letter, the same on every machine."""
    seed = int.from_bytes(hashlib.blake2b(letter.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).integers(0, 2, DIM, np.int8) * 2 - 1


class Grams:
    """Numbers for n-grams, and their vectors: letters' vectors, each permuted (rolled) by its place, multiplied."""

    def __init__(self):
        self.letters: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}
        self.vectors = np.zeros((4096, DIM), np.int8)

    def letter(self, c: str) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = letter_vector(c)
        return self.letters[c]

    def __call__(self, gram: str) -> int:
        k = self.number.get(gram)
        if k is None:
            k = self.number[gram] = len(self.number)
            if k == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            v = np.ones(DIM, np.int8)
            for i, c in enumerate(gram):
                v = v * np.roll(self.letter(c), len(gram) - 1 - i)
            self.vectors[k] = v
        return k


def _letters(chunk: str) -> str:
    return "".join(c if c.isalpha() else " " for c in chunk.lower())


class Profiler:
    """Texts to counts of n-grams. A word has a space on either side, and n-grams don't reach over words."""

    def __init__(self):
        self.grams = Grams()
        self.coder = ChunkCoder(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for word in _letters(chunk).split():
            w = f" {word} "
            out += [self.grams(w[i : i + NGRAM]) for i in range(len(w) - NGRAM + 1)]
        return np.array(out, np.int32).tobytes()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.grams.number) > _GRAM_LIMIT:  # only memory: the vectors are made again as they come
            self.__init__()
        c = np.bincount(self.coder.array(text, np.int32))
        k = np.flatnonzero(c)
        return k, c[k]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the text's n-gram vectors; None for a text without letters."""
        k, c = self.counts(text)
        return c.astype(np.float32) @ self.grams.vectors[k].astype(np.float32) if len(k) else None


def prototypes(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """For each language that documents are labelled with, the bundle of its sample, each document at length 1."""

    def bundles(batches):
        p = Profiler()
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b["lang"], b["text"]):
                v = p.bundle(text)
                if v is not None and (n := np.linalg.norm(v)):
                    sums[lang] = sums.get(lang, 0) + v / n
            if sums:
                yield pd.DataFrame({"lang": list(sums), "v": [v.astype(np.float64) for v in sums.values()]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": b["lang"].iloc[:1], "v": [np.sum(list(b["v"]), axis=0)]})

    order = F.xxhash64("doc_id").cast("double")
    labelled = docs.where("lang is not null and text is not null")
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*"))
    bound = cut(labelled.groupBy("lang").agg((F.lit(2.0**63) * (2 * share - 1)).alias("top")))
    chosen = labelled.join(small(bound), "lang").where(order <= F.col("top"))
    rows = chosen.select("lang", "text").mapInPandas(bundles, "lang string, v array<double>").groupBy("lang").applyInPandas(add, "lang string, v array<double>").collect()
    return {r["lang"]: np.array(r["v"]) / np.linalg.norm(r["v"]) for r in sorted(rows, key=lambda r: r["lang"])}


def identify(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """Every row of docs as doc_id, lang (its label), language, cosine, margin.

    Method: random letter vectors are permuted by place and bound into n-gram vectors; a text is the bundle of its
    n-grams, compared with each language's prototype by cosine. margin: the best cosine less the next.

    A text without letters, a null one, or one whose best cosine is under LEAST has language 'und'; without a letter,
    cosine and margin are 0. Ties go to the first language in order. Without prototypes all are 'und'. Repeated rows
    are each identified; an empty table gives an empty result; other columns aren't read.
    """
    names = list(known)
    matrix = np.stack([known[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)

    def run(batches):
        p = Profiler()
        for b in batches:
            vectors = np.zeros((len(b), DIM), np.float32)
            for i, text in enumerate(b["text"]):
                v = p.bundle(text)
                if v is not None:
                    vectors[i] = v
            norms = np.linalg.norm(vectors, axis=1)
            cos = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
            cos = np.concatenate([cos, np.zeros((len(b), max(0, 2 - len(names))), np.float32)], 1)
            top = np.argmax(cos, 1)
            best = np.take_along_axis(cos, top[:, None], 1)[:, 0]
            second = np.partition(cos, -2, axis=1)[:, -2]
            found = [names[t] if t < len(names) and n > 0 and c >= LEAST else "und" for t, n, c in zip(top, norms, best)]
            out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang": b["lang"], "language": found})
            yield out.assign(cosine=best.astype(float), margin=(best - second).astype(float))

    return columns(docs).select("doc_id", "lang", "text").mapInPandas(run, "doc_id bigint, lang string, language string, cosine double, margin double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang (the label), language, cosine and margin, for every document; prototypes come from the labels."""
    docs = columns(table(spark, sf_dir, "documents"))
    return identify(docs, prototypes(docs))


SQL: dict[str, str] = {}
QUERIES = {"op5_language_id": op5_language_id}
