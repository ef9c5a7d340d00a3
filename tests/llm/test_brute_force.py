"""Operators held against plain versions of themselves, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import pickle
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import common, decontaminate, htmltext, language, licenses, lines, lmscore, mixing, quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def made_up(n, seed=0):
    """Texts of random words, with near copies of some."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(2000)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.4:
            w = r.choice(texts).split(" ")
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.randrange(30, 300))]
        texts.append(" ".join(w))
    return texts


def plain_fingerprint(text):
    hashes = {}
    for w in words(text):
        hashes[w] = hashlib.md5(w.encode()).digest()
    sums = [0] * 128
    for h in hashes.values():
        x = int.from_bytes(h, "little")
        for i in range(128):
            sums[i] += 1 if x >> i & 1 else -1
    return sum(1 << i for i in range(128) if sums[i] > 0), len(hashes)


def test_simhash_pairs_are_all_pairs(spark, monkeypatch):
    texts = made_up(400)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string").selectExpr("rid", "rid as doc_id", "text")
    prints = [plain_fingerprint(t) for t in texts]
    got = {r["rid"]: (r["lo"] & (2**64 - 1) | (r["hi"] & (2**64 - 1)) << 64, r["n"]) for r in simhash.fingerprints(d).collect()}
    assert got == dict(enumerate(prints))
    near = set()
    for j in range(len(texts)):
        for i in range(j):
            if 0 < (prints[i][0] ^ prints[j][0]).bit_count() <= simhash.NEAR:
                near.add((i, j))
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    unique = set(first.values())
    nodes = simhash.cut(simhash.fingerprints(d).groupBy("lo", "hi").agg(simhash.F.min("rid").alias("rid")))
    found = {(r["a"], r["b"]) for r in simhash.near_pairs(nodes).collect()}
    want = {(i, j) for i, j in near if i in unique and j in unique}
    assert len(want) > 20 and found == want
    for block, held in ((3, 10**6), (10**6, 500)):  # anchors in blocks, which hot ones are cut into
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "HELD", held)
        assert {(r["a"], r["b"]) for r in simhash.near_pairs(nodes).collect()} == want
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in [*near, *((first[p], i) for i, p in enumerate(prints))]:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    assert {r["rid"]: r["root"] for r in simhash.groups(d)[0].collect()} == {i: top(i) for i in range(len(texts))}


def test_anchors_cover():
    replicas, homes = simhash._tables()
    r = random.Random(1)
    for _ in range(3000):
        y = r.randrange(1 << 16)
        x = y ^ (1 << r.randrange(16)) if r.random() < 0.9 else y
        even, odd = sorted((x, y), key=lambda v: v.bit_count() % 2)
        assert (homes[y] ^ y).bit_count() <= 1
        assert homes[y] == homes[x] or homes[odd] in replicas[even].tolist()


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)]
    random.Random(0).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def plain_matches(docs, items):
    """(doc, item, phrases, near) by looking at every place."""
    df = collections.Counter(w for t in docs for w in set(words(t)))
    out = set()
    for k, item in enumerate(map(words, items)):
        if len(item) < decontaminate.SHORT:
            continue
        n = min(len(item), decontaminate.PHRASE)
        phrases = [item[a : a + n] for a in range(len(item) - n + 1)]
        rare = sorted((o for o, w in enumerate(item) if df[w]), key=lambda o: (df[item[o]], o))[: decontaminate.RARE]
        need = math.ceil(decontaminate.NEAR_SHARE * min(decontaminate.RARE, len(item)))
        for d, doc in enumerate(map(words, docs)):
            exact = sum(doc[a : a + n] == p for p in phrases for a in range(len(doc) - n + 1))
            starts = [(a - o, s) for s, o in enumerate(rare) for a, w in enumerate(doc) if w == item[o]]
            near = max((len({s for b, s in starts if a <= b <= a + decontaminate.SLACK}) for a, _ in starts), default=0)
            near = near if near >= need else 0
            if exact or near:
                out.add((d, k, exact, near))
    return out


def test_index_finds_all_matches(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 120))) for _ in range(60)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(2, 40))) for _ in range(20)]
    for k, item in enumerate(items):
        w = item.split()
        if k % 2:
            w.insert(len(w) // 2, "inserted")
        if k % 5 == 0:
            items[k] += " never seen in any of these documents"
        docs[k] += " " + " ".join(w)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "rid long, text string").repartition(3)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = plain_matches(docs, items)
    assert len(want) > 20
    for segment, items_a_pass in ((1_000_000, 20_000), (200, 7)):
        decontaminate.SEGMENT, decontaminate.ITEMS_A_PASS, old = segment, items_a_pass, (decontaminate.SEGMENT, decontaminate.ITEMS_A_PASS)
        try:
            got = {tuple(x) for x in decontaminate.matches(d, b).collect()}
        finally:
            decontaminate.SEGMENT, decontaminate.ITEMS_A_PASS = old
        assert got == want


def least_docs(n):
    return next(docs for k, docs in lines.LEAST_DOCS if n >= k)


def plain_lines(texts):
    """(row, line) dropped, by a template tree in dictionaries."""
    rows = []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            own = tuple(line.split())
            w = tuple("<*>" if re.search(r"\d", x) else x for x in own)
            if w:
                rows.append((d, i, w if sum(x != "<*>" for x in w) >= lines.CONSTANT * len(w) else own, len(line)))
    docs_of = collections.defaultdict(set)
    for d, _, w, _ in rows:
        docs_of[w].add(d)
    leaves = collections.defaultdict(list)
    for w in docs_of:
        leaves[len(w), w[: lines.DEPTH]].append(w)
    template = {}
    for leaf, kinds in leaves.items():
        if sum(len(docs_of[w]) for w in kinds) < least_docs(leaf[0]):
            continue
        support = collections.Counter()
        for w in kinds:
            for place in enumerate(w):
                support[place] += len(docs_of[w])
        for w in kinds:
            same = tuple(place for place in enumerate(w) if place[1] != "<*>" and support[place] >= least_docs(len(w)))
            if len(same) >= lines.CONSTANT * len(w):
                template[w] = (leaf, same)
    groups = collections.defaultdict(list)
    for w, t in template.items():
        groups[t] += docs_of[w]
    head = {t: min(d) for t, d in groups.items() if len(d) >= least_docs(t[0][0])}
    again = [(d, i, head[template[w]], n) for d, i, w, n in rows if template.get(w) in head and head[template[w]] != d]
    total = collections.Counter()
    for d, _, _, n in rows:
        total[d] += n
    shared = collections.Counter()
    for d, _, h, n in again:
        shared[d, h] += n
    likely = {(d, h) for (d, h), n in shared.items() if n >= lines.COPY_SHARE * total[d] and n >= lines.COPY_SHARE * total[h]}
    copies = {(d, h) for d, h in likely if words(texts[d]) and words(texts[h]) and (plain_fingerprint(texts[d])[0] ^ plain_fingerprint(texts[h])[0]).bit_count() <= simhash.NEAR}
    return {(d, i, h) for d, i, h, _ in again if (d, h) not in copies}


def test_line_templates(spark, documents):
    texts = [r["text"] for r in documents.orderBy("doc_id").collect()]
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    for k in (3, 20, 31, 44):
        texts[k] += "\n" + passage + f"\nrequest from host{k} took {k} ms to serve in all"
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string").coalesce(1)
    got = {tuple(x) for x in lines.dropped(d).collect()}
    want = plain_lines(texts)
    assert got == want and len(want) > 20
    n = len(texts[20].split("\n"))
    assert (20, n - 2, 3) in got and (20, n - 1, 3) in got and not any(r == 3 and t == 3 for r, _, t in got)
    whole = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).coalesce(1)
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(whole).collect()}
    assert sum(passage in t for t in out.values()) == 1
    by = collections.defaultdict(set)
    for r, i, _ in want:
        by[r].add(i)
    for r, t in out.items():
        assert t == ("\n".join(x for i, x in enumerate(texts[r].split("\n")) if i not in by[r]) if by[r] else texts[r])


def test_lines_of_fields_and_short_lines(spark):
    """Exact repeats of lines that are mostly numbers go; a short line needs more documents; a shared passage goes where the documents aren't near-duplicates."""
    alone = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + j)}{chr(97 + j % 7)}" for j in range(12))
    texts = [f"{alone(k)}\n{' '.join(str(j if k < 4 else j * k) for j in range(1, 8))}\nread more\nthe same very long passage of many words stands here again and again in all\n{k} {k} times" for k in range(12)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string").repartition(3)
    got = {tuple(x) for x in lines.dropped(d).collect()}
    assert got == plain_lines(texts)
    assert {(k, 1, 0) for k in (1, 2, 3)} <= got and not any((k, 1) == (r, i) for r, i, _ in got for k in range(4, 12))
    assert {(k, 2, 0) for k in range(1, 12)} <= got and {(k, 3, 0) for k in range(1, 12)} <= got
    assert not any(i == 0 for _, i, _ in got)


def test_copies_are_left_whole(spark):
    line = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + j)}" for j in range(20))
    text = "\n".join(line(k) for k in range(6))
    d = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in range(5)], DOCS)
    assert [r["text"] for r in lines.line_dedup(d).collect()] == [text] * 5


def test_blocks_round_trip(spark, documents):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    chunk, mixing.CHUNK = mixing.CHUNK, 3
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        got = mixing.blocks(docs, block=128).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        mixing.CHUNK = chunk
    enc = mixing.encoding(mixing.RANKS)
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["source"]].append((r["doc_id"], r["text"]))
    assert set(texts) == set(got["source"])
    for source, own in texts.items():
        g = got[got["source"] == source].sort_values("idx")
        assert g["idx"].tolist() == list(range(len(g))) and all(len(t) == 256 for t in g["tokens"])
        want = [x for _, t in own for x in [*enc.encode_ordinary(t), mixing.END]]
        flat = np.frombuffer(b"".join(g["tokens"]), np.uint16).tolist()
        assert flat == want + [mixing.END] * (-len(want) % 128)
        assert list(dict.fromkeys(i for d in g["docs"] for i in d)) == [i for i, _ in own]


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\n\n c\td ", "x \ny", "it's 12,5 %\r\n\r\n  ok", "naïve — 中文 😀  z", "a b   c", "tail \n"])
def test_chunked_tokens_are_the_tokenizers(text):
    got = np.frombuffer(mixing.TextCoder(mixing.RANKS)(text), np.uint16).tolist()
    assert got == mixing.encoding(mixing.RANKS).encode_ordinary(text)


def test_each_chunk_of_many_texts_is_encoded_once(monkeypatch):
    """Tokens of texts together are the tokenizer's; beside first words, 50,000 chunks go to it in a few calls."""
    r = random.Random(3)
    parts = ["a", "b", " ", " ", "\n", "  ", "\t", "don't", "12", ",", "é", "中", "\x1c", "\xa0", "\r\n", "😀", ".", "the"]
    coder = mixing.TextCoder(mixing.RANKS)
    encode, calls = coder.encode, []
    plain = lambda texts: [np.array(encode(t), np.uint16).tobytes() for t in texts]
    texts = [" ".join(f"w{r.randrange(10_000)}" for _ in range(5000)) for _ in range(10)]
    coder.encode = lambda t: calls.append(t) or encode(t)
    assert coder.all(texts) == plain(texts)
    assert len(calls) <= 12 and sum(map(len, calls)) < sum(map(len, texts)) / 3
    monkeypatch.setattr(mixing.TextCoder, "PLACED", 7)
    monkeypatch.setattr(mixing.TextCoder, "JOINED", 3)
    for _ in range(300):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(r.randrange(6))]
        assert coder.all(texts) == plain(texts), texts


def test_permutations_and_draws(spark):
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 12345).tolist()) == list(range(n))
    counts, weights = {"a": 700, "b": 250, "c": 50}, {"a": 0.2, "b": 0.5, "c": 0.3}
    s = mixing.slots(spark, counts, weights, shard=100).toPandas()
    assert len(s) == 1000 and all(sorted(g) == list(range(100)) for _, g in s.groupby("shard")["slot"])
    for k in range(10):
        want = np.random.default_rng([mixing.SEED, k]).multinomial(100, [0.2, 0.5, 0.3])
        assert [int(((s["shard"] == k) & (s["source"] == x)).sum()) for x in "abc"] == want.tolist()
    for x, n in counts.items():
        for e, g in s[s["source"] == x].groupby("epoch"):
            assert g["idx"].is_unique and (len(g) == n or e == s[s["source"] == x]["epoch"].max())


def plain_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("cells", [10, 10**6])
def test_common_lines(cells, monkeypatch):
    monkeypatch.setattr(htmltext, "CELLS", cells)
    r = random.Random(0)
    for _ in range(200):
        a, b = (np.array([r.randrange(5) for _ in range(r.randrange(15))], np.int64) for _ in "ab")
        m = htmltext.shared_lines(a, b)
        rest = iter(b.tolist())
        assert m.sum() == plain_common(a.tolist(), b.tolist()) and all(x in rest for x in a[m].tolist())


def test_page_peers(spark):
    r = random.Random(5)
    urls = [f"http{r.choice(['', 's'])}://h{r.randrange(4)}.org/{r.choice('abc')}{r.choice(['', '/'])}{r.randrange(30)}{r.choice(['', '/', '.html', '#x', '?q=1'])}" for _ in range(150)]
    pages = [(i, u, "".join(f"<p>{r.choice('abcdefgh')} line</p>" for _ in range(r.randrange(6)))) for i, u in enumerate(urls)]
    out = {x["page_id"]: x for x in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    place = lambda u: re.fullmatch(r"https?://([^/]*)(.*?)(?:\.html)?/?(?:[#?].*)?", u).groups()
    first = {}
    for i, u, h in pages:
        first.setdefault(place(u), htmltext.text_lines(h))
    order = sorted(first)
    for i, u, h in pages:
        host, path = place(u)
        k = order.index((host, path))
        beside = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == host]
        prefix = lambda q: next((n for n, (x, y) in enumerate(zip(path, q[1])) if x != y), min(len(path), len(q[1])))
        own = htmltext.text_lines(h)
        n = plain_common(own, first[max(beside, key=lambda q: (prefix(q), q < (host, path)))]) if beside else 0
        assert out[i]["n_lines"] == len(own) and out[i]["n_dropped"] == n, u


def test_html_text():
    page = "<html><head><title>T</title></head><body><script>var t='</p>';</script><!-- no --><nav><a href='/x>y'>A &amp; B</a></nav><p>One <b>two</b><br>three<p> <style>p{}</style>end"
    assert htmltext.text_lines(page) == ["A & B", "One two", "three", "end"]


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language.prototypes(docs.where("doc_id % 2 = 0"))
    out = language.identify(docs.where("doc_id % 2 = 1"), known).toPandas()
    assert (out["lang"] == out["language"]).mean() >= 0.97


def test_language_is_the_plain_sum():
    p = language.Profiler()
    got = p.bundle("Abc, de abc")
    want = np.zeros(language.DIM)
    for w in (" abc ", " de ", " abc "):
        for i in range(len(w) - 2):
            v = np.ones(language.DIM)
            for j, c in enumerate(w[i : i + 3]):
                v = v * np.roll(language.letter_vector(c).astype(int), 2 - j)
            want += v
    assert (got == want).all()


def code(w):
    return int.from_bytes(common.word_code(w), "little", signed=True)


def codes(*ws):
    return np.array([code(w) for w in ws], np.int64)


def test_toxicity_from_seeds_given_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lexicon = toxicity.induce(toxicity.encoded(docs), {"en": (codes(*toxicity.TOXIC_SEEDS), codes())})["en"]
    assert all(lexicon.get(code(w), 0) > 0 for w in ("clown", "pathetic", "worthless", "disgusting")) and all(lexicon.get(code(w), 0) == 0 for w in ("the", "and", "of"))


def test_toxicity_in_every_language(spark):
    """Lexicons from one half of the labels, recall and false alarms on the other."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    enc = toxicity.encoded(docs)
    found = toxicity.lexicons(enc, labels.where("doc_id % 2 = 0"))
    s = toxicity.score(enc.where("doc_id % 2 = 1"), *found).join(docs.select("doc_id", "lang"), "doc_id")
    s = s.join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    figures = {k: (round(g["toxic"][g["label"] == 1].mean(), 3), round(g["toxic"][g["label"] == 0].mean(), 3)) for k, g in s.groupby("lang")}
    print(figures)
    for lang, recall in (("de", 0.9), ("en", 0.9), ("es", 0.4), ("fr", 0.9)):
        assert figures[lang][0] >= recall and figures[lang][1] <= 0.04, figures


def test_encoded_words_are_all_there_and_small(spark):
    """All codes in order, also of rare words and of languages without a book, in 2 bytes a word of disk."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    more = spark.createDataFrame([(-1, None, "the old sea"), (-2, "xx", "onceonly"), (-3, "en", None), (-4, "en", "onceonly the"), (-5, "de", "")], docs.schema)
    all_docs = docs.unionByName(more)
    enc = toxicity.encoded(all_docs)
    rows = enc.select("doc_id", "lang", "ids", "rare").toPandas()
    got = dict(zip(rows["doc_id"], toxicity.reader(enc)(rows)))
    coder = common.ChunkCoder(common.word_codes)
    want = {r["doc_id"]: coder.array(r["text"], np.int64).tolist() for r in all_docs.collect()}
    assert {k: v.tolist() for k, v in got.items()} == want and len(got) == len(rows)
    assert sum(Path(f.removeprefix("file://")).stat().st_size for f in enc.inputFiles()) <= 2 * sum(map(len, want.values()))


def test_near_words_are_counted_once_a_passage(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(("bad", "evil", "good", "sun", "sea", "sky")) for _ in range(r.randrange(40))) for _ in range(60)] * 2
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = collections.defaultdict(set)
    for t in texts:
        w = t.split()
        for i, a in enumerate(w):
            for j in range(max(0, i - toxicity.REACH), min(len(w), i + toxicity.REACH + 1)):
                if a == "bad" and w[j] != a:
                    want[a, w[j]].add((w[j - 1] if j else None, w[j + 1] if j + 1 < len(w) else None))
    got = {(x["a"], x["b"]): x["n"] for x in toxicity.near_counts(toxicity.encoded(d), {"en": codes("bad")}).collect()}
    assert got == {(code(a), code(b)): len(v) for (a, b), v in want.items() if len(v) >= toxicity.LEAST_NEAR}


def test_walks_and_scores_are_the_plain_ones(spark):
    """PPMI by its formula, walks by a matrix's powers, scores by adding up words."""
    r = random.Random(11)
    count = {w: r.randrange(20, 400) for w in "abcdefgh"}
    total = 5_000_000.0
    near = {(x, y): r.randrange(5, 60) for x in count for y in count if x != y and r.random() < 0.5}
    pairs = spark.createDataFrame([("en", code(x), code(y), n) for (x, y), n in near.items()], "lang string, a long, b long, n long")
    counts = spark.createDataFrame([("en", code(w), n) for w, n in count.items()], "lang string, code long, n long")
    edges = toxicity.ppmi(pairs, counts, spark.createDataFrame([("en", total)], "lang string, total double"))
    want = {k: math.log2(n * total / (2 * toxicity.REACH * count[k[0]] * count[k[1]])) for k, n in near.items()}
    want = {k: x for k, x in want.items() if x >= toxicity.LEAST_PPMI}
    got = {(x["a"], x["b"]): x["weight"] for x in edges.collect()}
    assert want and got.keys() == {(code(x), code(y)) for x, y in want} and all(abs(got[code(x), code(y)] - v) < 1e-9 for (x, y), v in want.items())
    names = sorted(count)
    m = np.array([[want.get((x, y), 0.0) for y in names] for x in names])
    m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
    begin = np.array([[x in "ab" for x in names], [x in "gh" for x in names]]) / 2
    at = begin
    for _ in range(toxicity.STEPS):
        at = (1 - toxicity.RESTART) * at @ m + toxicity.RESTART * begin
    start = spark.createDataFrame([("en", code(w), 0.5 * (w in "ab"), 0.5 * (w in "gh")) for w in "abgh"], "lang string, code long, toxic double, clean double")
    walked = {x["code"]: (x["toxic"], x["clean"]) for x in toxicity.walk(edges, start).collect()}
    for i, w in enumerate(names):
        assert np.allclose(walked.get(code(w), (0, 0)), at[:, i], atol=1e-12)
    lexicon = {code("a"): 1.0, code("b"): 0.25, code("g"): -0.5}
    d = spark.createDataFrame([(1, "a b g c"), (2, "a a " + "c " * 398), (3, "g"), (4, None)], "doc_id long, text string").selectExpr("*", "'en' lang")
    out = {x["doc_id"]: (x["hits"], x["score"], x["toxic"]) for x in toxicity.score(toxicity.encoded(d), {"en": lexicon}, {"en": 0.5}).collect()}
    assert out == {1: (2, 0.75, True), 2: (2, 0.5, True), 3: (0, -0.5, False), 4: (0, 0.0, False)}


def plain_notices(text, all_templates):
    """(license, position, words, cover) by trying every place for every template."""
    w = words(text)
    found = []
    for name, template, phrases in all_templates:
        t = words(template)
        slack, least = licenses.slack(len(t)), math.ceil(licenses.COVER * len(t))
        if not set(words(" ".join(phrases))) <= set(w):
            continue
        for s in range(-len(t), len(w)):
            part = f" {' '.join(w[max(0, s - slack) : max(0, s + len(t) + slack)])} "
            if all(f" {' '.join(words(p))} " in part for p in phrases):
                near = sum(x in w[max(0, s + p - slack) : max(0, s + p + slack + 1)] for p, x in enumerate(t))
                just = sum(0 <= s + p < len(w) and w[s + p] == x for p, x in enumerate(t))
                if near >= least and just:
                    found.append((name, s, len(t), near, just))
    out = []
    for x in sorted(found, key=lambda x: (-x[2], -x[3], -x[4], x[1], x[0])):
        if all(x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1] for y in out):
            out.append(x)
    return sorted((n, max(0, s), k, round(c / k, 9)) for n, s, k, c, _ in out)


def test_licenses_by_searching_every_place(spark, documents):
    r = random.Random(6)
    texts = [(x["doc_id"], x["text"]) for x in documents.collect()]
    notice = {n: t for n, t, _ in reversed(licenses.NOTICES)}
    gpl, mit, bsd2, bsd3 = notice["GPL-2.0-or-later"], next(t for n, t, _ in licenses.NOTICES if n == "MIT" and "hereby" in t), next(t for n, t, _ in licenses.NOTICES if n == "BSD-2-Clause" and len(t) > 99), next(t for n, t, _ in licenses.NOTICES if n == "BSD-3-Clause" and len(t) > 99)

    def worn(text):
        w = text.split()
        for _ in range(len(w) // 12):
            w[r.randrange(len(w))] = r.choice(["other", "the", "software"])
        w.insert(r.randrange(len(w)), "inserted")
        return " ".join(w)

    made = ["intro text\n" + gpl.upper() + "\nmore", gpl.replace("redistribute", "share"), "the terms of the license, version 2 of any", "(c) me. Released under the MIT License! All rights  reserved", bsd2, bsd3, f"{bsd2} and then {bsd3} {bsd2}", "All rights reserved. All rights reserved, x all rights reserved", "a file\nSPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: MIT", mit + " " + gpl, " ".join([mit, *["granted free charge"] * 50, mit])]
    made += [f"{worn(t)} some words between {worn(r.choice((gpl, mit, bsd2, bsd3)))}" for t in (gpl, mit, bsd2, bsd3) * 3]
    texts += [(9000 + i, t) for i, t in enumerate(made)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = collections.defaultdict(list)
    for x in licenses.scan(d).collect():
        got[x["doc_id"]].append((x["license"], x["position"], x["words"], round(x["cover"], 9)))
    for i, t in texts:
        assert sorted(got[i]) == plain_notices(t, licenses.NOTICES), t[:200]
    names = lambda k: [n for n, *_ in sorted(got[9000 + k], key=lambda x: x[1])]
    assert names(0) == names(1) == ["GPL-2.0-or-later"] and names(2) == [] and names(3) == ["MIT", "proprietary"]
    assert names(4) == ["BSD-2-Clause"] and names(5) == ["BSD-3-Clause"] and names(6) == ["BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause"]
    assert names(7) == ["proprietary"] * 3 and names(8) == ["GPL-2.0-or-later", "MIT"] and names(9) == ["MIT", "GPL-2.0-or-later"] and names(10) == ["MIT", "MIT"]


def test_full_license_texts(spark):
    """Each full text is found as itself, with a sentence changed as well, and nothing else in the same place."""
    texts = {n: t for n, t, _ in licenses.templates()[len(licenses.NOTICES) :]}
    rows = [(i, f"some file\n\n{t}\n\nAll rights reserved" if i % 2 else t[:2000] + "a changed sentence here " + t[2040:], "en", "s", 0) for i, t in enumerate(t for t in texts.values() for _ in range(2))]
    got = collections.defaultdict(list)
    for x in licenses.scan(spark.createDataFrame(rows, DOCS)).collect():
        got[x["doc_id"]].append(x["license"])
    for i, name in enumerate(n for n in texts for _ in range(2)):
        assert name in got[i] and ("proprietary" in got[i]) >= (i % 2), (name, got[i])


def test_log_bilinear_model(spark):
    r = random.Random(4)
    after = {w: r.sample([f"v{i}" for i in range(50)], 2) for w in (f"v{i}" for i in range(50))}
    texts = []
    for _ in range(600):
        w = ["v0"]
        for _ in range(100):
            w.append(r.choice(after[w[-1]]))
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    v, flat = lmscore.fit(lmscore.encoded(docs.where("doc_id < 500")))
    held = lmscore.score(lmscore.encoded(docs.where("doc_id >= 500")), v, flat).toPandas()
    ids = lambda t: v(np.frombuffer(lmscore._word_bytes(t), np.int64)).astype(int).tolist()
    unigram = np.mean([np.log(v.share[i]) - v.spread[i] for t in texts[500:] for i in ids(t)])
    assert held["mean_log_prob"].mean() > unigram + 0.7
    again = lmscore.fit(lmscore.encoded(docs.where("doc_id < 500").repartition(5).orderBy(F.desc("doc_id"))))[1]
    assert (again == flat).all()  # however the rows lie
    model = lmscore.Model(v, flat)
    softmax = lambda s: s - s.max() - np.log(np.exp(s - s.max()).sum())
    total, x = 0.0, ids(texts[500] + " unknown words")
    for k, w in enumerate(x):
        h = model.predicted(np.array([[v.size, v.size, *x][k : k + 2]]))[0]
        g = w // lmscore.GROUP
        own = slice(g * lmscore.GROUP, (g + 1) * lmscore.GROUP)
        total += softmax(model.parts[4] @ h + model.parts[5])[g] + softmax(model.parts[2][own] @ h + model.parts[3][own])[w % lmscore.GROUP] - v.spread[w]
    one = lmscore.score(lmscore.encoded(spark.createDataFrame([(0, texts[500] + " unknown words")], "doc_id long, text string")), v, flat).first()
    assert abs(one["log_prob"] - total) < 1e-3 * len(x) and one["n_tokens"] == len(x)


def test_draws_within_a_group_are_by_share():
    n = np.array([1000, 400, 100, 50, 7, 3, 1])
    v = lmscore.Vocabulary(np.arange(7) * 1_000_003, n, np.zeros(256), np.zeros(256))
    stay, other = lmscore._alias(v)
    for k in range(0, v.size, lmscore.GROUP):
        size = min(lmscore.GROUP, v.size - k)
        got = np.zeros(v.size)
        for i in range(k, k + size):
            got[i] += stay[i] / size
            got[other[i]] += (1 - stay[i]) / size
        assert np.allclose(got[k : k + size], v.share[k : k + size] / v.share[k : k + size].sum(), atol=1e-6)


def test_driver_gets_one_set_of_parameters(spark, monkeypatch):
    """However many trainers there are; it is their mean by weight, and the vocabulary is that of plain counts."""
    enc = lmscore.encoded(spark.createDataFrame(list(enumerate(made_up(300))), "doc_id long, text string")).cache()
    held, collect = [], type(enc).collect

    def counted(self):
        rows = collect(self)
        held.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(lmscore, "A_TRAINER", 200)
    with monkeypatch.context() as m:
        m.setattr(type(enc), "collect", counted)
        v, flat = lmscore.fit(enc)
    assert flat.nbytes == max(held)
    codes = collections.Counter(x for r in enc.collect() for x in np.frombuffer(r["codes"], np.int64).tolist())
    trainers = -(-sum(codes.values()) // (lmscore.ROUNDS * lmscore.A_TRAINER))
    assert trainers >= 9
    assert lmscore.vocabulary(enc, 50).codes[:-1].tolist() == sorted(codes, key=lambda c: (-codes[c], c))[:50]
    parts, plain = lmscore.pieces(enc, v, trainers).toPandas(), lmscore.Model(v).flat
    for k in range(lmscore.ROUNDS):
        out = [lmscore._trainer(plain, v, k, plain.size)(b) for _, b in parts[parts["round"] == k].groupby("trainer")]
        plain = np.average([np.frombuffer(b["params"][0], np.float32) for b in out], axis=0, weights=[b["weight"][0] for b in out]).astype(np.float32)
    assert np.allclose(plain, flat, atol=1e-5)


def test_vocabulary_is_sent_without_its_tables():
    codes = np.arange(1, 8) * 1_000_003
    v = lmscore.Vocabulary(codes, np.arange(7, 0, -1), np.zeros(256), np.zeros(256))
    numbers, sent = v(codes), pickle.dumps(v)
    assert len(sent) < 1 << 20 and (pickle.loads(sent)(codes) == numbers).all()


def test_quality_rules_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = {r["doc_id"] for r in quality.quality_filter(docs).select("doc_id").collect()}
    by = collections.defaultdict(list)
    for r in labels.collect():
        by[r["quality"]].append(r["doc_id"] in kept)
    assert np.mean(by[1]) >= 0.99 and np.mean(by[0]) <= 0.1


def test_pipeline_is_its_stages(spark):
    """run() against the plain versions of all five stages."""
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in quality.quality_filter(docs).collect()]
    by = collections.defaultdict(set)
    for d, i, _ in plain_lines([r[1] for r in rows]):
        by[d].add(i)
    left = []
    for d, r in enumerate(rows):
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in by[d]) if by[d] else r[1]
        if not by[d] or text.strip():
            left.append((r[0], text, r[3]))
    prints = [plain_fingerprint(t) for _, t, _ in left]
    root = list(range(len(left)))
    for j in range(len(left)):
        for i in range(j):
            if prints[i][1] and prints[j][1] and (prints[i][0] ^ prints[j][0]).bit_count() <= simhash.NEAR and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if q == b else q for q in root]
    left = [x for i, x in enumerate(left) if root[i] == i]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in plain_matches([t for _, t, _ in left], items)}
    left = [x for i, x in enumerate(left) if i not in bad]
    enc, counts, packed = mixing.encoding(mixing.RANKS), {}, {}
    for source in sorted({s for _, _, s in left}):
        flat = [x for _, t, s in left if s == source for x in [*enc.encode_ordinary(t), mixing.END]]
        flat += [mixing.END] * (-len(flat) % mixing.BLOCK)
        packed[source] = [tuple(flat[i : i + mixing.BLOCK]) for i in range(0, len(flat), mixing.BLOCK)]
        counts[source] = len(packed[source])
    total = sum(counts.values())
    share = np.array([(counts[s] / total) ** mixing.FLATTEN for s in counts])
    share = share / share.sum()
    assert len(out) == total
    for s, g in out.groupby("shard"):
        n = min(mixing.SHARD, total - s * mixing.SHARD)
        assert [int((g["source"] == x).sum()) for x in counts] == np.random.default_rng([mixing.SEED, int(s)]).multinomial(n, share).tolist()
    for r in out.itertuples():
        assert tuple(np.frombuffer(r.tokens, np.uint16).tolist()) == packed[r.source][r.idx]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "SimHash near-dedup" and common.BROADCAST_ROWS
