"""Language-model scores from a log-bilinear model, trained in numpy with noise-contrastive estimation."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, give_back, keep_heap, lean, stored, table, words

#: Words that the model knows by themselves, the most frequent ones; the others are known by their endings, of so many kinds.
VOCABULARY, ENDINGS = 32_000, 256
#: Words before a word; numbers in a vector; words of a group.
CONTEXT, DIM, GROUP = 2, 16, 180
#: Noise groups of a step; noise words from the word's own group, for each word.
NOISE_GROUPS, NOISE_WORDS = 32, 2
#: Parts of the corpus that are trained on in turn, the trainers' parameters being averaged after each.
ROUNDS = 3
#: Positions of a trainer, of a piece of a document, and of a step; the step size of Adagrad, and its first sum of squares.
A_TRAINER, PIECE, STEP, RATE, FIRST = 2_000_000, 4096, 4096, 0.06, 5e-3
#: Equal positions of a step that are one, with a weight.
TOGETHER = 2
#: Parameters of a slice that is averaged by itself, and of all trainers' copies of it; fewer where there are more trainers.
A_SLICE, COPIES = 1 << 16, 1 << 22
#: Positions scored at a time; rows of a product; bytes of text encoded at a time.
_CHUNK, _ROWS, _SLICE = 1 << 18, 1024, 1 << 24
_BITS = 21


@functools.lru_cache(maxsize=1 << 16)
def _ending(end: str) -> bytes:
    return xxhash.xxh3_64_digest(end.encode("utf-8", "surrogatepass"))[:1]


def word_code(word: str) -> bytes:
    """A word's 64-bit code; the highest byte is that of its ending, the last two letters."""
    return xxhash.xxh3_64_digest(word.encode("utf-8", "surrogatepass"))[:7] + _ending(word[-2:])


def _word_bytes(chunk: str) -> bytes:
    return b"".join(map(word_code, words(chunk)))


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id and codes, the codes of all words in order: written once, for all passes over the corpus.

    Each different piece between white space is encoded once for a slice of texts.
    """

    def run(batches):
        coder = ChunkCoder(_word_bytes)
        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            size = np.cumsum(np.asarray(pc.binary_length(text), np.int64)) // _SLICE
            edges = np.r_[0, np.flatnonzero(np.diff(size)) + 1, len(b)].tolist() if len(b) else []
            for i, j in zip(edges[:-1], edges[1:]):
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), _encode(coder, text.slice(i, j - i))], ["doc_id", "codes"])

    return stored(columns(docs).select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, codes binary"), "words")


def _encode(coder: ChunkCoder, text: pa.Array) -> pa.Array:
    """The words' codes of each text, end to end."""
    pieces = pc.utf8_split_whitespace(text)
    each = pieces.flatten().dictionary_encode()
    codes = list(map(coder.__getitem__, each.dictionary.to_pylist()))
    n = np.fromiter(map(len, codes), np.int64, len(codes)) // 8
    begin, which = np.cumsum(n) - n, each.indices.to_numpy()
    n = n.take(which)
    upto = np.r_[0, np.cumsum(n)]
    out = np.frombuffer(b"".join(codes), np.int64).take(np.repeat(begin.take(which) - upto[:-1], n) + np.arange(upto[-1]))
    places = upto.take(np.r_[0, np.cumsum(np.asarray(pc.list_value_length(pieces), np.int64))]) * 8
    return pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(out)])


def word_counts(enc: DataFrame) -> DataFrame:
    """code, n: how often each word comes in all documents."""

    def run(batches):
        for b in batches:
            codes, n = np.unique(np.frombuffer(b"".join(b["codes"]), np.int64), return_counts=True)
            yield pd.DataFrame({"code": codes, "n": n})

    return enc.select("codes").mapInPandas(lean(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of words, by falling frequency: the VOCABULARY most frequent words, and the endings of all others.

    share: each number's share of all words; spread: log of how many words a number stands for. Numbers are in groups of
    GROUP by frequency. The number after the last stands before a text.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, end_words: np.ndarray, end_n: np.ndarray):
        count = np.r_[n, end_n].astype(float) + 1.0  # so that none is without noise
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.size = len(order)
        self.share = count[order] / count.sum()
        self.spread = np.log(np.r_[np.ones(len(n)), np.maximum(end_words, 1)])[order]
        self.by_ending = number[len(n) :].astype(np.uint16)
        self.codes, self.numbers = np.r_[codes.astype(np.int64), 0], np.r_[number[: len(n)], 0].astype(np.uint16)
        self.groups = -(-self.size // GROUP)
        self.group_share = np.add.reduceat(self.share, np.arange(0, self.size, GROUP))

    def __getstate__(self) -> dict:
        """Without the tables, which are most of it: they are made where words are looked up."""
        return {k: x for k, x in self.__dict__.items() if k != "tables"}

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Two tables by different bits of the code, for codes that collide in the first."""
        codes = self.codes[:-1]
        first, second = np.full(1 << _BITS, len(codes), np.int32), np.full(1 << _BITS, len(codes), np.int32)
        at = codes & (1 << _BITS) - 1
        took = np.unique(at, return_index=True)[1]
        first[at[took]] = took
        rest = np.setdiff1d(np.arange(len(codes)), took)
        second[codes[rest] >> _BITS & (1 << _BITS) - 1] = rest
        return first, second

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of words by their codes."""
        first, second = self.tables
        at = first.take(codes & (1 << _BITS) - 1)
        ok = (self.codes.take(at) == codes) & (at < len(self.codes) - 1)
        out = self.numbers.take(at)
        rest = np.flatnonzero(~ok)
        codes = codes.take(rest)
        at = second.take(codes >> _BITS & (1 << _BITS) - 1)
        ok = (self.codes.take(at) == codes) & (at < len(self.codes) - 1)
        out[rest] = np.where(ok, self.numbers.take(at), self.by_ending.take((codes.view(np.uint64) >> np.uint64(56)).astype(np.int64)))
        return out


def vocabulary(enc: DataFrame, size: int | None = None) -> Vocabulary:
    """From the counts of all words in all documents; what comes to the driver is bounded by VOCABULARY and ENDINGS."""
    size = VOCABULARY if size is None else size
    counts = stored(word_counts(enc), "counts")
    # Stored, as the driver would otherwise get so many words of each task.
    top = stored(counts.orderBy(F.desc("n"), "code").limit(size), "top").toPandas().sort_values(["n", "code"], ascending=[False, True])
    ending = F.shiftrightunsigned("code", 56)
    by = counts.groupBy(ending.alias("e")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    end_words, end_n = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by:
        end_words[r["e"]], end_n[r["e"]] = r["words"], r["n"]
    codes, n = top["code"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    of = (codes.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    return Vocabulary(codes, n, end_words - np.bincount(of, minlength=ENDINGS), end_n - np.bincount(of, n, ENDINGS))


class Model:
    """Context vectors, a matrix for each place of the context, word vectors and biases, group vectors and biases."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        self.shapes = [(v.size + 1, DIM), (CONTEXT, DIM, DIM), (v.size, DIM), (v.size,), (v.groups, DIM), (v.groups,)]
        if flat is None:
            rng = np.random.default_rng(0)
            within = v.share / np.repeat(v.group_share, GROUP)[: v.size]
            parts = [rng.normal(0, 0.1, self.shapes[0]), np.stack([np.eye(DIM)] * CONTEXT), rng.normal(0, 0.1, self.shapes[2]), np.log(within), rng.normal(0, 0.1, self.shapes[4]), np.log(v.group_share)]
            flat = np.concatenate([p.ravel() for p in parts]).astype(np.float32)
        self.flat = flat.copy()
        self.parts, at = [], 0
        for s in self.shapes:
            self.parts.append(self.flat[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The vector that the words of a context, the nearest last, give for the next word."""
        r, c = self.parts[:2]
        return sum(r.take(contexts[:, i], 0) @ c[i] for i in range(CONTEXT))


def _products(h: np.ndarray, vectors: np.ndarray, held: np.ndarray) -> np.ndarray:
    """h @ vectors.T in memory that is held."""
    return np.matmul(h, vectors.T, out=held[: len(h) * len(vectors)].reshape(len(h), len(vectors)))


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Log of the sums of the exponentials of each row, in place; scores too large for an exponential are cut."""
    np.minimum(s, 80, out=s)
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], np.float32))


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts numbers under 65,536, where each number begins in it, and the numbers that come."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return order, first, at[first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(contexts: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different contexts with their next word, in order, and for each position which it is and how often each comes.

    size: of the vocabulary; the columns are the context's words and the word.
    """
    key = word.astype(np.int64)
    for i in range(CONTEXT):
        key += contexts[:, i].astype(np.int64) * (size + 1) ** (CONTEXT - i)
    key, which, n = np.unique(key, return_inverse=True, return_counts=True)
    return np.stack([key // (size + 1) ** (CONTEXT - i) % (size + 1) for i in range(CONTEXT + 1)], 1), which, n


def _alias(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For a draw by share within a group: each number's chance to stay when drawn evenly, and the number taken otherwise."""
    stay, other = np.ones(v.size, np.float32), np.arange(v.size)
    for k in range(0, v.size, GROUP):
        p = v.share[k : k + GROUP]
        p = (p / p.mean()).tolist()
        few, many = [i for i, x in enumerate(p) if x < 1], [i for i, x in enumerate(p) if x >= 1]
        while few and many:
            i, j = few.pop(), many[-1]
            stay[k + i], other[k + i] = p[i], k + j
            p[j] -= 1 - p[i]
            if p[j] < 1:
                few.append(many.pop())
    return stay, other


def train(model: Model, v: Vocabulary, contexts: np.ndarray, word: np.ndarray, seed: int) -> None:
    """One pass of noise-contrastive estimation with Adagrad over positions, in a random order.

    A word is told from noise twice: its group from NOISE_GROUPS groups drawn by their shares, and the word from
    NOISE_WORDS words drawn by their shares in its group. Positions with the same context and word go together, up to
    TOGETHER of them, with their number as weight.
    """
    rng = np.random.default_rng(seed)
    r, c, q, b, u, d = model.parts
    gr, gq, gu = (np.full(len(p), FIRST, np.float32) for p in (r, q, u))
    gc, gb, gd = (np.full(p.shape, FIRST, np.float32) for p in (c, b, d))
    group_upto, group_of = np.cumsum(v.group_share), np.arange(v.size) // GROUP
    start, length = group_of * GROUP, np.minimum(GROUP, v.size - group_of * GROUP).astype(np.float32)
    stay, other_word = _alias(v)
    log_group = np.log(NOISE_GROUPS * v.group_share).astype(np.float32)
    log_word = np.log(NOISE_WORDS * v.share / v.group_share[group_of]).astype(np.float32)
    different, _, n = grams(contexts, word, v.size)
    times = -(-n // TOGETHER)
    order = rng.permutation(np.repeat(np.arange(len(n)), times))
    weight = (n / times).astype(np.float32)

    def move(p, g, at, grad):
        g[at] = total = g.take(at) + np.einsum("ij,ij->i", grad, grad) / DIM
        grad *= (RATE / np.sqrt(total))[:, None]
        grad += p.take(at, 0)
        p[at] = grad

    def move_each(p, g, at, grad):
        g[at] += grad * grad
        p[at] += RATE * grad / np.sqrt(g[at])

    for i in range(0, len(order), STEP):
        gram = order[i : i + STEP]
        rows = different.take(gram, 0)
        m = weight.take(gram)
        m /= math.sqrt(m.sum())  # steps of a mean would leave rare words where they are
        w = rows[:, CONTEXT]
        g = group_of[w]
        noise = np.minimum(np.searchsorted(group_upto, rng.random(NOISE_GROUPS)), v.groups - 1)
        draw = (rng.random((len(rows), NOISE_WORDS), np.float32) * length.take(w)[:, None]).astype(np.int64) + start.take(w)[:, None]
        draw = np.where(rng.random(draw.shape, np.float32) < stay.take(draw), draw, other_word.take(draw))
        before = [r.take(rows[:, k], 0) for k in range(CONTEXT)]
        h = sum(x @ c[k] for k, x in enumerate(before))
        # groups
        ug, un = u.take(g, 0), u[noise]
        own = m * _sigmoid(log_group[g] - np.einsum("ij,ij->i", h, ug) - d[g])
        other = -m[:, None] * _sigmoid(h @ un.T + (d[noise] - log_group[noise]))
        dh = own[:, None] * ug + other @ un
        # words
        each = np.c_[w, draw]
        qe = q.take(each, 0)
        z = np.einsum("ikj,ij->ik", qe, h) + (b - log_word).take(each)
        z[:, 0] *= -1
        pulls = m[:, None] * _sigmoid(z)
        pulls[:, 1:] *= -1
        dh += np.einsum("ik,ikj->ij", pulls, qe)
        by, first, at = _runs(np.r_[g, noise])
        grad = np.r_[own[:, None] * h, other.T @ h].take(by, 0)
        move(u, gu, at, np.add.reduceat(grad, first, axis=0))
        move_each(d, gd, at, np.add.reduceat(np.r_[own, other.sum(0)][by], first))
        by, first, at = _runs(each.ravel())
        pulls = pulls.ravel().take(by)
        move(q, gq, at, np.add.reduceat(pulls[:, None] * h.take(by // (NOISE_WORDS + 1), 0), first, axis=0))
        move_each(b, gb, at, np.add.reduceat(pulls, first))
        pushes = np.concatenate([dh @ c[k].T for k in range(CONTEXT)])
        for k in range(CONTEXT):
            dc = before[k].T @ dh
            gc[k] += dc * dc
            c[k] += RATE * dc / np.sqrt(gc[k])
        by, first, at = _runs(rows[:, :CONTEXT].T.ravel())
        move(r, gr, at, np.add.reduceat(pushes.take(by, 0), first, axis=0))


def pieces(enc: DataFrame, v: Vocabulary, trainers: int) -> DataFrame:
    """round, trainer, h, part, ids: all documents as numbers, cut into pieces of PIECE words, with the context before each.

    Where a piece goes is told by its document's number and text, and so is the same for any layout of the files; pieces of
    one text with different document numbers, and of one long text, are spread over the trainers.
    """

    def run(batches):
        for b in batches:
            rows = []
            for doc, codes in zip(b["doc_id"], b["codes"]):
                x = v(np.frombuffer(codes, np.int64))
                h = xxhash.xxh3_64_intdigest(codes, seed=0 if doc is None or doc != doc else int(doc) & (1 << 63) - 1)
                x = np.r_[np.full(CONTEXT, v.size, np.uint16), x]
                for k in range(-(-(len(x) - CONTEXT) // PIECE)):
                    t = xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), seed=h)
                    rows.append((t % ROUNDS, t // ROUNDS % trainers, np.uint64(t).view(np.int64), x[k * PIECE : (k + 1) * PIECE + CONTEXT].tobytes()))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=_PIECES)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=_PIECES)

    return enc.select("doc_id", "codes").mapInPandas(lean(run), "round int, trainer int, h bigint, ids binary")


_PIECES = ["round", "trainer", "h", "ids"]


def fit(enc: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the model's parameters, from all positions of all documents.

    The number of trainers grows with the input: in each round every trainer passes once over its own pieces of that
    round's part, from the parameters that the round before left, and the results are averaged by weight. They are averaged
    in slices, so that the driver gets one set of parameters however many trainers there are.
    """
    v = vocabulary(enc)
    total = enc.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    trainers = max(1, math.ceil(total / 8 / ROUNDS / A_TRAINER))
    parts = stored(pieces(enc, v, trainers), "pieces", ["round"])
    flat = Model(v).flat
    size = max(1, min(A_SLICE, COPIES // trainers))
    for k in range(ROUNDS):
        trained = parts.where(F.col("round") == k).select("trainer", "h", "ids").groupBy("trainer").applyInPandas(_trainer(flat, v, k, size), "trainer int, weight double, slice int, params binary")
        got = trained.groupBy("slice").applyInPandas(_average, "slice int, params binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["params"], np.float32) for r in sorted(got, key=lambda r: r["slice"])])
    return v, flat


def _trainer(flat: np.ndarray, v: Vocabulary, k: int, size: int):
    def trained(b: pd.DataFrame) -> pd.DataFrame:
        keep_heap()
        model = Model(v, flat)
        trainer = int(b["trainer"].iloc[0])
        ids = [np.frombuffer(x, np.uint16) for _, x in sorted(zip(b["h"], b["ids"]))]
        word = np.concatenate([x[CONTEXT:] for x in ids])
        contexts = np.stack([np.concatenate([x[i : len(x) - CONTEXT + i] for x in ids]) for i in range(CONTEXT)], 1)
        train(model, v, contexts, word, trainer * ROUNDS + k)
        params = [model.flat[i : i + size].tobytes() for i in range(0, len(model.flat), size)]
        return pd.DataFrame({"trainer": trainer, "weight": float(len(word)), "slice": range(len(params)), "params": params})

    def run(b: pd.DataFrame) -> pd.DataFrame:
        try:
            return trained(b)
        finally:
            give_back()

    return run


def _average(b: pd.DataFrame) -> pd.DataFrame:
    """The trainers' mean of a slice of the parameters by their weights, summed in the trainers' order."""
    b = b.sort_values("trainer")
    total = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(b["weight"], b["params"]))
    return pd.DataFrame({"slice": [int(b["slice"].iloc[0])], "params": [(total / b["weight"].sum()).astype(np.float32).tobytes()]})


def log_probs(model: Model, v: Vocabulary, contexts: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Normalised log-probability of each word after its context: of its group, of its number in the group, and of the word.

    Products are taken for many positions at once: with all groups' vectors for each different context, and with a group's
    words' vectors for all positions whose word is in it.
    """
    q, u = np.c_[model.parts[2], model.parts[3]], np.c_[model.parts[4], model.parts[5]]
    held = np.empty(_ROWS * max(GROUP, v.groups), np.float32)
    out = np.empty(len(word), np.float32)
    for i in range(0, len(word), _CHUNK):
        rows, which, _ = grams(contexts[i : i + _CHUNK], word[i : i + _CHUNK], v.size)
        context, w = rows[:, :CONTEXT], rows[:, CONTEXT]
        first = np.r_[True, (context[1:] != context[:-1]).any(1)]
        where, context = np.cumsum(first) - 1, context[first]
        h = np.c_[model.predicted(context), np.ones(len(context), np.float32)]  # a one for the biases
        norm = np.empty(len(context), np.float32)
        for j in range(0, len(context), _ROWS):
            norm[j : j + _ROWS] = _log_sum(_products(h[j : j + _ROWS], u, held))
        g = w // GROUP
        order, _, _ = _runs(g)
        where, g, w = where[order], g[order], w[order]
        h = h.take(where, 0)
        s = np.einsum("ij,ij->i", h, u.take(g, 0)) - norm[where]
        edges = np.searchsorted(g, np.arange(v.groups + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = q[k * GROUP : (k + 1) * GROUP]
            for e in range(edges[k], edges[k + 1], _ROWS):
                at = slice(e, min(e + _ROWS, edges[k + 1]))
                z = _products(h[at], own, held)
                s[at] += z[np.arange(len(z)), w[at] - k * GROUP]
                s[at] -= _log_sum(z)
        of = np.empty(len(s), np.float32)
        of[order] = s - v.spread[w]
        out[i : i + _CHUNK] = of[which]
    return out


def score(enc: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, for every row of enc, which encoded() gives.

    Method: the CONTEXT words before a word give a vector, by a matrix for each place (log-bilinear); its products with all
    groups' vectors, and with those of all words of the word's group, are normalised and multiplied. A word beyond the
    vocabulary has the probability of its ending, spread evenly over all words that share it.

    A text without words, an empty or a null one, has 0 tokens, log_prob 0 and no mean. A text counts whole, however long;
    words of equal frequency are numbered by their codes. Repeated rows are each scored; an empty table gives an empty
    result; columns other than doc_id and text aren't read, whatever their names.
    """

    def run(batches):
        keep_heap()
        model = Model(v, flat)
        for b in batches:
            n = np.array([len(c) // 8 for c in b["codes"]], np.int64)
            total, start = np.zeros(len(b)), 0
            for end in np.r_[np.flatnonzero(np.diff(np.cumsum(n) // _CHUNK)) + 1, len(b)].tolist():
                if n[start:end].any():
                    total[start:end] = _totals(model, v, b["codes"].iloc[start:end], n[start:end])
                start = end
            mean = pd.array(np.where(n > 0, total / np.maximum(n, 1), np.nan), dtype="Float64")
            mean[n == 0] = pd.NA
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": n, "log_prob": total, "mean_log_prob": mean})

    return enc.select("doc_id", "codes").mapInPandas(lean(run), "doc_id bigint, n_tokens bigint, log_prob double, mean_log_prob double")


def _totals(model: Model, v: Vocabulary, codes: pd.Series, n: np.ndarray) -> np.ndarray:
    """Log-probabilities of whole texts."""
    x = v(np.frombuffer(b"".join(codes), np.int64))
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    contexts = np.full((len(x), CONTEXT), v.size, np.uint16)
    for i in range(CONTEXT):
        back = CONTEXT - i
        ok = np.flatnonzero(place >= back)
        contexts[ok, i] = x[ok - back]
    p = np.r_[0.0, np.cumsum(log_probs(model, v, contexts, x), dtype=np.float64)]
    ends = np.cumsum(n)
    return p[ends] - p[ends - n]


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob for every document, by the model that all documents give."""
    enc = encoded(table(spark, sf_dir, "documents"))
    return score(enc, *fit(enc))


SQL: dict[str, str] = {}
QUERIES = {"op9_lm_scoring": op9_lm_scoring}
