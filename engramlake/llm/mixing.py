"""Mixing sources to target weights: packed blocks, multinomial counts per shard, pseudorandom index permutations."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from engramlake.llm.common import columns, cut, lean, mix64, slices, small, stored, table

BLOCK, SHARD, SEED = 2048, 1024, 17
#: Exponent that takes the sources' shares to their default target weights.
FLATTEN = 0.7
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: How byte-level BPE of this vocabulary splits a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Blocks to a run of tokens.
CHUNK = 64
#: Characters of the texts (about) that are encoded together.
SLICE = 1 << 24
_NO_SOURCE = ""


@functools.cache
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("blocks", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})


class TextCoder:
    """Texts' token ids: tokens never reach over a single space, so that each different chunk of many texts is encoded once.

    Chunks are encoded together, with a space before each; only there a token begins with one.
    """

    #: Chunks that are encoded together, and chunks whose tokens are put in place together.
    JOINED, PLACED = 20_000, 200_000

    def __init__(self, ranks: str):
        coding = encoding(ranks)
        self.encode = coding.encode_ordinary
        self.begins = np.array([coding.decode_single_token_bytes(i).startswith(b" ") for i in range(coding.n_vocab)])

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at, coded = split.offsets.to_numpy().copy(), split.values.dictionary_encode()
        place, chunks = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        # White space at a chunk's end is taken by the tokenizer with the space beside it.
        odd = np.array([not c or c.strip() != c for c in chunks], bool)
        heads = [chunks[i] for i in place[at[:-1]]]
        at_odd = odd[place]
        at_odd[at[:-1]] = [h[-1:].isspace() for h in heads]
        whole = np.diff(np.r_[0, np.cumsum(at_odd)][at]) > 0
        whole &= np.diff(at) > 1
        place[at[:-1]] = len(chunks) + np.arange(len(heads))  # a text's first chunk has no space before it
        tokens, sizes = [], []
        good = np.flatnonzero(~odd)
        for k in range(0, len(good), self.JOINED):
            ids = np.array(self.encode(" " + " ".join(chunks[i] for i in good[k : k + self.JOINED])), np.uint16)
            tokens.append(ids)
            sizes.append(np.diff(np.r_[np.flatnonzero(self.begins[ids]), len(ids)]))
        size = np.zeros(len(chunks), np.int64)
        size[good] = np.concatenate(sizes) if sizes else 0
        first = [np.array(self.encode(h), np.uint16) for h in heads]
        size = np.r_[size, [len(f) for f in first]].astype(np.int64)
        table_, begin = np.concatenate([*tokens, *first]), np.cumsum(size) - size
        out = []
        ends = np.cumsum(size[place])
        for i, j in zip(*_ranges(at, self.PLACED)):
            p = place[at[i] : at[j]]
            n = size[p]
            to = np.cumsum(n)
            taken = table_[np.repeat(begin[p] - to + n, n) + np.arange(to[-1])].tobytes()
            base = ends[at[i]] - n[0]
            cuts = [0, *(2 * (ends[at[i + 1 : j + 1] - 1] - base)).tolist()]
            out += [taken[x:y] for x, y in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.encode(texts[i]), np.uint16).tobytes()
        return out


def _ranges(at: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Beginnings and ends of ranges of texts with at most so many chunks together, one text at least."""
    cuts = [0]
    while cuts[-1] < len(at) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + most, side="right")) - 1))
    return cuts[:-1], cuts[1:]


def _stream(batches, coder: TextCoder, block: int):
    """Runs of whole documents' tokens, of CHUNK blocks or more: source, at (the place in the partition's source), tokens, docs, ends."""
    end = np.array([END], np.uint16).tobytes()
    held: dict[str, list] = {}
    at: dict[str, int] = {}

    def flush(source: str) -> tuple:
        docs, parts = zip(*held.pop(source))
        ends = np.cumsum([len(p) // 2 for p in parts])
        start = at.get(source, 0)
        at[source] = start + int(ends[-1])
        return source, start, b"".join(parts), docs, ends

    size: dict[str, int] = {}
    for b in batches:
        rows = []
        texts = b["text"].tolist()
        coded = itertools.chain.from_iterable(coder.all(texts[i:j]) for i, j in slices(texts, SLICE))
        for doc, source, tokens in zip(b["doc_id"], b["source"], coded):
            source = _NO_SOURCE if source is None else source
            tokens += end
            held.setdefault(source, []).append((None if doc is None or doc != doc else int(doc), tokens))
            size[source] = size.get(source, 0) + len(tokens)
            if size[source] >= 2 * block * CHUNK:
                rows.append(flush(source))
                size[source] = 0
        if rows:
            yield pd.DataFrame(rows, columns=["source", "at", "tokens", "docs", "ends"])
    if held:
        yield pd.DataFrame([flush(s) for s in list(held)], columns=["source", "at", "tokens", "docs", "ends"])


def _cut_blocks(batches, block: int):
    """The runs cut where blocks begin: source, idx, off (the part's place in the block), docs, tokens."""
    for b in batches:
        rows = []
        for source, at, tokens, docs, ends in zip(b["source"], b["at"], b["tokens"], b["docs"], b["ends"]):
            n = len(tokens) // 2
            edges = np.r_[0, np.arange(block - at % block, n, block), n]
            first = np.searchsorted(ends, edges[:-1], side="right")
            last = np.searchsorted(ends, edges[1:] - 1, side="right")
            for x, y, i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), first.tolist(), last.tolist()):
                ids = [int(d) for d in docs[i : j + 1] if d is not None and d == d]
                rows.append((source, (at + x) // block, (at + x) % block, list(dict.fromkeys(ids)), tokens[2 * x : 2 * y]))
        yield pd.DataFrame(rows, columns=["source", "idx", "off", "docs", "tokens"])


def blocks(docs: DataFrame, block: int = BLOCK, ranks: str = RANKS) -> DataFrame:
    """source, idx, docs, tokens: each source's tokens end to end, cut into blocks; the last one is filled with END.

    A document's tokens are followed by END. Only where a run of CHUNK blocks begins or ends inside a block are the
    parts moved and put together. tokens are 16-bit ids, docs the ids of the documents in the block.
    """
    d = columns(docs).where("text is not null").select("doc_id", "source", "text")
    runs = d.mapInPandas(lean(lambda it: _stream(it, TextCoder(ranks), block)), "source string, at bigint, tokens binary, docs array<bigint>, ends array<bigint>")
    runs = stored(runs.select(F.spark_partition_id().alias("pid"), "*", (F.length("tokens") / 2).cast("bigint").alias("n")), "tokens")
    count = runs.groupBy("source", "pid").agg(F.sum("n").alias("n"))
    base = cut(count.select("source", "pid", (F.sum("n").over(Window.partitionBy("source").orderBy("pid")) - F.col("n")).alias("base")))
    runs = runs.join(small(base), ["source", "pid"]).select("source", (F.col("base") + F.col("at")).alias("at"), "tokens", "docs", "ends")
    parts = runs.mapInPandas(lean(lambda it: _cut_blocks(it, block)), "source string, idx bigint, off int, docs array<bigint>, tokens binary")
    whole = F.length("tokens") == 2 * block
    by = parts.where(~whole).groupBy("source", "idx").agg(F.sort_array(F.collect_list(F.struct("off", "docs", "tokens"))).alias("p"))
    joined = F.aggregate(F.col("p.tokens"), F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y))
    fill = F.lit(np.array([END], np.uint16).tobytes())
    rest = by.select("source", "idx", F.array_distinct(F.flatten("p.docs")).alias("docs"), F.rpad(joined, 2 * block, fill).alias("tokens"))
    return parts.where(whole).drop("off").unionByName(rest)


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 taken at i: a Feistel network over enough bits, walked until it is below n."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(6):
            left, right = right, left ^ (mix64(right + np.uint64((key * 2654435761 + k * 40503) % 2**64)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def _key(source: str, epoch: int, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}/{epoch}/{source}".encode(), digest_size=8).digest(), "little")


def slots(spark: SparkSession, counts: dict[str, int], weights: dict[str, float] | None = None, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, slot, source, idx, epoch: which block each place of the output takes.

    There are as many slots as blocks. A shard's counts are one multinomial draw; the j-th slot of a source takes the
    block that the source's permutation of epoch j // n has at j % n, so none comes again before all have come.
    """
    names = sorted(s for s, n in counts.items() if n)
    total = sum(counts[s] for s in names)
    share = np.array([weights.get(s, 0.0) if weights else (counts[s] / total) ** FLATTEN for s in names], float)
    share = share / share.sum() if len(names) and share.sum() > 0 else share
    n_shards = math.ceil(total / shard) if share.sum() > 0 else 0
    if not n_shards:
        return spark.createDataFrame([], "shard bigint, slot int, source string, idx bigint, epoch bigint")

    def draw(batches):
        for b in batches:
            rows = []
            for s in b["id"]:
                size = min(shard, total - s * shard)
                drawn = np.random.default_rng([seed, int(s)]).multinomial(size, share)
                rows += [(int(s), names[k], int(c)) for k, c in enumerate(drawn) if c]
            yield pd.DataFrame(rows, columns=["shard", "source", "n"])

    def place(batches):
        for b in batches:
            out = []
            for (s, source), g in b.groupby(["shard", "source"], sort=False):
                j = g["base"].iloc[0] + np.arange(g["n"].iloc[0])
                n = counts[source]
                epoch = j // n
                idx = np.concatenate([permute(j[epoch == e] % n, n, _key(source, int(e), seed)) for e in np.unique(epoch)])
                out.append(pd.DataFrame({"shard": s, "source": source, "idx": idx, "epoch": epoch, "slot0": g["slot0"].iloc[0] + np.arange(len(j))}))
            r = pd.concat(out)
            yield pd.DataFrame({"shard": r["shard"], "slot": r["slot0"].astype("int32"), "source": r["source"], "idx": r["idx"], "epoch": r["epoch"]})

    up_to = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = cut(spark.range(n_shards).mapInPandas(draw, "shard bigint, source string, n bigint"))
    return drawn.select("*", up_to("source", "shard").alias("base"), up_to("shard", "source").alias("slot0")).mapInPandas(place, "shard bigint, slot int, source string, idx bigint, epoch bigint")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, ranks: str = RANKS) -> DataFrame:
    """shard, slot, source, idx, epoch, doc_ids, tokens: the documents' tokens, mixed to the sources' target weights.

    Each source is packed into blocks of a fixed number of tokens; every shard of the output draws its sources' counts
    from a multinomial; each source's slots go through its own pseudorandom permutation of block indices, and the blocks
    are joined by index. Without weights, the targets are the sources' shares to the power FLATTEN.

    A null text has no tokens, an empty one just END; a null source is the source ''. A source without a weight is left
    out; weights of absent sources don't count. Repeated rows are packed as often as they come; an empty table gives an
    empty result; further columns aren't read.
    """
    b = blocks(docs, block, ranks)
    counts = {r["source"]: r["n"] for r in b.groupBy("source").agg(F.count("*").alias("n")).collect()}
    s = slots(docs.sparkSession, counts, weights, shard, seed)
    # Slots are as many as blocks, which their plan doesn't tell: they are never to be broadcast.
    return s.join(b.hint("merge"), ["source", "idx"]).select("shard", "slot", "source", "idx", "epoch", F.col("docs").alias("doc_ids"), "tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all documents, mixed to the default target weights."""
    return mix(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op3_mixing": op3_mixing}
