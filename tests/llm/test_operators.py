"""Each corpus operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from quillon.llm import bpe, components, fingerprint, knn, langid, mixing, rules, samples, simhash, sstable, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    long = " ".join(f"w{i % 997}x" for i in range(30_000))
    some = "The cat sat on the mat. " * 3 + "Then it left.\nAnd came back!\n"
    return [
        (1, some, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", None, "b", 4), (5, long, "en", None, 1),
        (1, some, "en", "a", 5), (None, some, "de", "b", 3), (None, None, None, None, None), (6, some, "en", "c", 9), (7, "é" * 300, "fr", "b", 300),
        (8, "aaaa " * 200, "en", "a", 7), (9, "<|endoftext|> 1 ½ ΑΣ", "el", "b", 1), (10, "x" * 250 + "y", "en", "a", 0), (11, "z" + "x" * 250, "en", "a", 0),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- components and SimHash


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(20)] + [(700, 700 + i) for i in range(1, 90)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {x: find(x) for x in list(root)}
    assert {k: v for k, v in want.items() if k in got} == got and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


@pytest.mark.parametrize("order", ["up", "shuffled", "hub"])
def test_components_take_few_rounds(spark, order, monkeypatch):
    ids = list(range(2500))
    if order == "shuffled":
        random.Random(2).shuffle(ids)
    edges = [(0, i) for i in ids[1:]] if order == "hub" else list(zip(ids, ids[1:]))
    rounds, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: rounds.append(label) or real(df, label))
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == 2500 and {r["component"] for r in got} == {0}
    assert rounds.count("edges") <= (2 if order == "hub" else 12)


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(out)
        for b in rng.sample(range(64), rng.randrange(6)):
            x ^= 1 << b
        out.append(x)
    return np.array(sorted(set(out)), np.uint64).view(np.int64)


def brute_components(fp):
    u, seen = fp.view(np.uint64), {}
    for i in range(len(u)):
        if i in seen:
            continue
        stack = [i]
        seen[i] = i
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= 3):
                if j not in seen:
                    seen[j] = i
                    stack.append(int(j))
    return collections.Counter(collections.Counter(seen.values()).values())


@pytest.mark.parametrize("hot", [512, 1])
def test_golay_keys_lose_no_link(spark, hot, monkeypatch):
    fp = near_fingerprints(1500, 4)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long").repartition(3)
    got = components.connected_components(simhash.links(df, hot=hot))
    sizes = collections.Counter(collections.Counter(r["component"] for r in got.collect()).values())
    want = brute_components(fp)
    want.pop(1, None)
    assert sizes == want


@pytest.mark.parametrize("hot", [512, 1])
def test_no_side_of_keys_is_broadcast(spark, hot):
    df = spark.createDataFrame([(int(x),) for x in near_fingerprints(300, 4)], "fp long")
    plan = simhash.links(df, hot=hot)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [key" in line and "Inner" in line and "bit_count" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(0)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, np.int64)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for k in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(k))
    rows_l, keys_l = simhash.left_keys(a)
    rows_r, keys_r = simhash.right_keys(b.view(np.int64))
    left, right = collections.defaultdict(set), collections.defaultdict(set)
    for r, k in zip(rows_l, keys_l):
        left[r].add(k)
    for r, k in zip(rows_r, keys_r):
        right[r].add(k)
    assert all(left[i] & right[i] for i in range(len(a)))


def test_golay_decodes_within_three_bits():
    g = simhash.Golay()
    words = np.arange(1 << 23, dtype=np.int32)
    code = g.index(words)
    assert (np.bincount(code) == 2048).all()


def brute_simhash(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_simhash_rows(odd, none):
    got = simhash.components(odd).collect()
    assert len(got) == 14
    by_text = {r[0]: r[1] for r in odd_rows()}
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == brute_simhash(by_text[r["doc_id"]], 3)
    ids = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert ids[6] == ids[1] == 1 and ids[2] == ids[3] == ids[4] == 2
    assert simhash.components(none).collect() == []


def near_corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs = []
    for g in range(30):
        base = [word() for _ in range(150)]
        docs.append((len(docs), " ".join(base), g))
        for _ in range(g % 5):
            copy = list(base)
            for _ in range(1 + g % 2):
                copy[rng.randrange(150)] = word()
            docs.append((len(docs), " ".join(copy), g))
    docs.append((len(docs), docs[0][1], 0))
    return docs


@pytest.mark.parametrize("few", [16, 2])
def test_near_duplicates_leave_one_of_each_group(spark, few, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", few)
    docs = near_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, node long").repartition(4)
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    groups = [r["node"] for r in got.collect()]
    assert sorted(groups) == list(range(30))
    assert {r["doc_id"] for r in got.collect()} == {min(d[0] for d in docs if d[2] == g) for g in range(30)}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, new = rng.randrange(len(out)), f"n{rng.randrange(10**6)}"
        out[at : at + rng.randrange(2)] = [new] if rng.random() < 0.6 else []
    return out


def hard_near_texts():
    """Short texts, pairs about 0.8, chains, dense groups around no text, and different texts that share most of one passage."""
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5000}"
    texts = []
    for n in (5, 6, 9, 12, 13, 14, 20, 30, 60) * 12:
        base = [word() for _ in range(n)]
        texts += [base] + [edited(rng, base, 1 + k % 2) for k in range(3)]
    for _ in range(3):
        now = [word() for _ in range(80)]
        for _ in range(40):
            now = edited(rng, now, 1)
            texts.append(now)
    for n in (60, 100, 200):
        base = [word() for _ in range(n)]
        texts += [edited(rng, base, 1 + k % 4) for k in range(70)]
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(9 + k % 4)] + passage for k in range(60)]
    return sorted({" ".join(t) for t in texts if t})


def brute_near_groups(texts, similarity=0.8, words=5):
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in split]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [400_000, 6000])
def test_near_duplicates_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile, raising=False)
    texts = hard_near_texts()
    want = set(brute_near_groups(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.deduplicated(df).collect()} == want


def test_near_duplicates_take_the_steps_of_simhash(spark):
    texts = ["", " ", "\n\t", "  \n", *hard_near_texts()[:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.deduplicated(df).collect()} == set(brute_near_groups(texts))
    fps = [(i, len(t), f - (1 << 64) if (f := brute_simhash(t, 5)) >> 63 else f) for i, t in enumerate(texts)]
    got = components.connected_components(simhash._near_bits(spark.createDataFrame(fps, "node long, size long, fp long")), "a", "b").collect()
    near = lambda i: [j for j in range(len(fps)) if ((fps[i][2] ^ fps[j][2]) & (1 << 64) - 1).bit_count() <= 3]
    want = {}
    for i in range(len(fps)):
        if i not in want:
            want[i], todo = i, [i]
            while todo:
                for j in near(todo.pop()):
                    if j not in want:
                        want[j] = i
                        todo.append(j)
    several = collections.Counter(want.values())
    assert {r["node"]: r["component"] for r in got} == {i: c for i, c in want.items() if several[c] > 1}


def test_near_duplicates_odd_rows(odd, none):
    got = simhash.deduplicated(odd.withColumn("component", F.lit(1)).withColumn("key", F.lit("x")))
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(found) == len(set(found)) and sum(t == odd_rows()[0][1] for _, t in found) == 1
    assert (5 in {i for i, _ in found}) and got.columns == [*odd.columns, "component", "key"]
    assert simhash.deduplicated(none).collect() == []


# -- repeated strings


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def repeat_corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(10, 90)) for _ in range(8)] + ["ab" * 150, "q" * 230]
    docs = ["".join(rng.choice([text(rng.randrange(1, 60)), *shared[:4], *shared]) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    return [*docs, docs[0], docs[0], "", "x" * 199, "y" * 201, "y" * 200]


@pytest.mark.parametrize("hot,length", [(256, 200), (0, 200), (1, 64)])
def test_repeats_against_brute_force(spark, hot, length, monkeypatch):
    texts = repeat_corpus(hot + length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    real = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, n: real(docs, n, hot=hot))
    got = {r[0]: tuple(r[1:]) for r in suffix.report(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, length)


@pytest.mark.parametrize("hot", [2, 5, 12])
def test_small_ranges_of_hot_classes_are_held_whole(spark, hot, monkeypatch):
    rng = random.Random(hot)
    word = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    line = word(90)  # in every text; groups of 4 share more around it, so that few ranges meet
    around = [(word(100), word(100)) for _ in range(10)]
    texts = [word(60) + a[rng.randrange(60) :] + line + b[: rng.randrange(40, 100)] + word(60) for a, b in around for _ in range(4)]
    texts += repeat_corpus(hot, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    real, write, held = suffix.repeated_spans, suffix.materialize, collections.defaultdict(list)

    def written(df, label):
        out = write(df, label)
        held[label].append(out)
        return out

    monkeypatch.setattr(suffix, "materialize", written)
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, n: real(docs, n, hot=hot))
    got = {r[0]: tuple(r[1:]) for r in suffix.report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 200)
    assert held["ranges"][0].count() > 0
    for k, x in enumerate(held["ranges"]):  # what a rank has in small groups goes to no later one
        small = x.where(f"rep and n <= {hot}").select("node", "at").distinct()
        large = x.where(f"rep and n > {hot}").select("node", "at").distinct()
        later = [y.select("node", "at") for y in [*held["ranges"][k + 1 :], *held["strings"]]]
        assert all(y.join(small.subtract(large), ["node", "at"]).isEmpty() for y in later)


@pytest.mark.parametrize("length", [200, 64])
def test_doubling_against_brute_force(spark, length, monkeypatch):
    texts = repeat_corpus(length, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix, "repeated_spans", suffix.doubled_spans)
    got = {r[0]: tuple(r[1:]) for r in suffix.report(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, length)


def test_texts_of_one_name_are_told_apart(spark, monkeypatch):
    """With 5 names for some 60 texts nearly all clash."""
    monkeypatch.setattr("quillon.llm._common.text_name", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    texts = repeat_corpus(3, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix.report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 200)
    docs = near_corpus()
    kept = simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, node long").repartition(4))
    assert sorted(r["node"] for r in kept.collect()) == list(range(30))


def test_repeats_in_long_texts(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    s = suffix.Sampler(200, 48)
    who, at, *_ = s.samples([text])
    assert len(set(at.tolist())) == len(at)
    for i in range(0, len(text) - 200):  # each string holds a sample, prefix included
        assert ((at >= i) & (at <= i + 152)).any()


def test_repeats_odd_rows(odd, none):
    got, want = suffix.report(odd), brute_removal([r[1] for r in odd_rows()], 200)
    by_row = collections.Counter((r[0], *w) for r, w in zip(odd_rows(), want))
    assert collections.Counter(tuple(r) for r in got.collect()) == by_row and sum(w[1] for w in want) > 1000
    assert suffix.report(none).collect() == []
    text = suffix.deduplicated(odd.withColumn("spans", F.lit(1)))
    assert text.columns == [*odd.columns, "spans"] and text.count() == 14
    assert {r["doc_id"]: r["text"] for r in text.collect()}[10] == "y"


def test_removal_keeps_whole_characters():
    data = "aéb".encode()
    assert suffix.at_characters(data, [(2, 4)]) == [(3, 4)]
    assert suffix.without(data, suffix.at_characters(data, [(0, 2)])).decode() == "éb"


# -- rules


def test_rules_against_brute_force(odd, none):
    got = {r["doc_id"]: r for r in rules.judge(odd.select("doc_id", "text", F.lit(3).alias("measure"))).collect() if r["doc_id"] is not None}
    for doc_id, text, *_ in odd_rows():
        if doc_id is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in (i, i + 1, i + 2)}
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert rules.judge(none.select("doc_id", "text")).collect() == []


@pytest.mark.parametrize("hash_bits", [64, 6])
def test_rules_measures_and_verdicts_against_brute_force(spark, hash_bits, monkeypatch):
    """With 6 bits of hash nearly every window has neighbours of equal hash and other words."""
    real = rules.repeated_words
    monkeypatch.setattr(rules, "repeated_words", lambda words: real(words, hash_bits))
    rng = random.Random(hash_bits)
    word = lambda: rng.choice(["the", "cat", "sat#", "ON", "mat$$", "dog!", "|", "<b>", "höhe"])
    docs = [(i, "\n".join(rng.choice([" ".join(word() for _ in range(rng.randrange(12))), "same line", " ", ""]) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(200 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(60 + i))) for i in range(60)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    names = [n for n in got[0].__fields__ if n.startswith("vote_")]
    judged = [r for r in got.values() if not r["base_failed"]]
    accuracy, prior = dict.fromkeys(names, 0.75), 0.5
    posterior = lambda r: 1 / (1 + np.exp(-np.log(prior / (1 - prior)) - sum(r[n] * np.log(accuracy[n] / (1 - accuracy[n])) for n in names)))
    for _ in range(rules.ITERATIONS):
        p = [posterior(r) for r in judged]
        new = {n: min(0.999, max(0.5, (sum(x if r[n] == 1 else 1 - x for r, x in zip(judged, p) if r[n]) + 1.5) / (sum(r[n] != 0 for r in judged) + 2.0))) for n in names}
        moved = max(abs(new[n] - accuracy[n]) for n in names)
        accuracy, prior = new, min(0.95, max(0.05, sum(p) / len(p)))
        if moved < 1e-6:
            break
    assert len(judged) > 50
    for doc_id, text in docs:
        w, r, lines = re.findall(r"[^\x20\x09-\x0D]+", text), got[doc_id], [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in (i, i + 1, i + 2)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert abs(r["posterior"] - posterior(r)) < 1e-6 and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_em_tells_when_it_does_not_settle(spark):
    votes = spark.createDataFrame([(1, -1)] * 30 + [(1, 1)] * 40 + [(-1, 1)] * 10, "a int, b int")
    with pytest.warns(UserWarning, match="still move"):
        rules.fit_accuracies(votes, ["a", "b"], 1)


def test_em_finds_accuracies(spark):
    rng = random.Random(2)
    votes = []
    for _ in range(4000):
        good = rng.random() < 0.8
        votes.append(tuple((1 if good == (rng.random() < a) else -1) if rng.random() < 0.9 else 0 for a in (0.95, 0.8, 0.7, 0.9)))
    accuracy, prior = rules.fit_accuracies(spark.createDataFrame(votes, "a int, b int, c int, d int"), list("abcd"), 60)
    assert abs(prior - 0.8) < 0.05 and all(abs(accuracy[k] - v) < 0.06 for k, v in zip("abcd", (0.95, 0.8, 0.7, 0.9)))


# -- fingerprints


def brute_fingerprint(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, paragraphs = [], []
    for line in (text or "").split("\n"):
        leaves = [sha(x) for x in re.findall(r"[^.!?\n]{1,32}[.!?\n]*|[.!?\n]+", line)]
        paragraphs.append((sha("p" + "".join(leaves)), "".join(x[:8] for x in leaves)))
        if paragraphs[-1][0][-1] in "01":
            sections.append(paragraphs)
            paragraphs = []
    sections += [paragraphs] if paragraphs else []
    names = [sha("s" + "".join(h for h, _ in s)) for s in sections]
    return sha("r" + "".join(names)) + "".join("/" + n[:16] + "".join(":" + h[:16] + x for h, x in s) for n, s in zip(names, sections))


def brute_likeness(a, b):
    """From the fingerprints alone."""
    if a == b:
        return 1.0
    trees = [[s.split(":") for s in x.split("/")[1:]] for x in (a, b)]
    leaves = lambda ps: [p[i : i + 8] for p in ps for i in range(16, len(p), 8)]
    total = sum(len(leaves(s[1:])) for t in trees for s in t)
    missing = lambda x, y, name: [i for i in x if name(i) not in {name(j) for j in y}]
    left, right = ([p for s in missing(x, y, lambda s: s[0]) for p in s[1:]] for x, y in (trees, trees[::-1]))
    left, right = (missing(x, y, lambda p: p[:16]) for x, y in ((left, right), (right, left)))
    x, y = leaves(left), leaves(right)
    return 1 - (len(missing(x, y, str)) + len(missing(y, x, str))) / total if total else 0.0


def neighbour_order(rows):
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints_against_brute_force(spark, odd, none, ranges):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["alpha", "beta.", "gamma", "delta!", "é日本"]) for _ in range(rng.randrange(14)))
    docs = [(i if i % 9 else None, "\n".join(line() for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(500, line()) for _ in range(40)] + [(7, docs[7][1])] + [(r[0], r[1]) for r in odd_rows()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = collections.Counter(tuple(r[:6]) + (round(r[6], 9),) for r in fingerprint.edited_neighbours(df, ranges=ranges).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round("near_edited", 9), "near_next").collect())
    order, want = neighbour_order(docs), collections.Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        fp, other, following = map(brute_fingerprint, (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, other, round(brute_likeness(fp, other), 9), round(brute_likeness(fp, following), 9)] += 1
    assert got == want
    assert fingerprint.edited_neighbours(none, ranges=ranges).collect() == []
    assert fingerprint.edited_neighbours(odd, ranges=ranges).count() == 14


def test_fingerprints_shuffle_text_once(odd):
    plan = fingerprint.edited_neighbours(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 2  # the test's own and the ranges


def test_fingerprint_changes(spark):
    a = "\n".join(f"line {i}" for i in range(50))
    b = a.replace("line 30", "line thirty")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(fingerprint.tree(F.col("a")).alias("x"), fingerprint.tree(F.col("b")).alias("y")).select(
        fingerprint.changed_paragraphs(F.col("x"), F.col("y")).alias("c"), fingerprint.likeness(F.col("x"), F.col("y")).alias("l")).first()
    leaf = hashlib.sha256(b"line 30").hexdigest()
    assert r["c"] == [hashlib.sha256(b"p" + leaf.encode()).hexdigest()] and r["l"] == pytest.approx(0.98)


# -- languages, quality, toxicity


def test_language_backs_off(spark, none):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    kinds = {"xx": ["ka", "to", "mi"], "yy": ["ner", "gul", "ost"], None: ["zz"]}
    docs = [(i, make(kinds[k]), k) for i, k in enumerate(["xx", "yy", None] * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(df))
    assert model.langs == ["xx", "yy"]
    tests = [(1, "katomika tokato", "q"), (2, "nergulost ostostner", "q"), (3, None, "q"), (4, "12 ½ !", "q"), (5, "KATOMI", "q")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, score string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["xx", "yy", "und", "und", "xx"] and got[3]["score"] == 0.0 < got[1]["score"] <= 1
    empty = langid.fit(langid.sample(none))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def test_language_against_brute_force(spark):
    rng = random.Random(9)
    parts = {"aa": ["ka", "to", "mi", "sh"], "bb": ["ner", "gul", "ost", "to"], "cc": ["é", "mi", "gul"]}
    make = lambda l, n: " ".join("".join(rng.choice(parts[l]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs = [(i, make(l, rng.randrange(40)), l) for i, l in enumerate(list(parts) * 30)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    counts, kinds = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, l in docs:
        for w in langid._WORD.findall(text.lower()):
            for f in ["w" + w, *(f"{n}{g}" for n in range(1, 6) for g in langid.grams(w, n))]:
                counts[f][l] += 1
                kinds[f[0]][l] += 1
    features = collections.Counter(f[0] for f in counts)
    known = {f: c for f, c in counts.items() if sum(c.values()) > 1}
    logs = lambda f: [np.log(known[f][l] + 0.1) - np.log(kinds[f[0]][l] + 0.1 * (features[f[0]] + 1)) for l in parts]

    def brute(text):
        total, words = np.zeros(3), langid._WORD.findall((text or "").lower())
        for w in words:
            if "w" + w in known:
                total += logs("w" + w)
                continue
            for n in range(5, 0, -1):
                found = [logs(f"{n}{g}") for g in langid.grams(w, n) if f"{n}{g}" in known]
                if found:
                    total += np.mean(found, axis=0)
                    break
        if not words:
            return "und", 0.0
        p = np.exp((total - total.max()) * min(1.0, 20 / len(words)))
        return list(parts)[int(p.argmax())], p.max() / p.sum()

    tests = [(i, make(rng.choice(list(parts)), rng.randrange(30)) + rng.choice(["", " tokatokagul", " qqq", " 12"])) for i in range(80)] + [(90, None), (91, "")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    for i, text in tests:
        lang, score = brute(text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4)


def brute_measure(terms, exceptions, text):
    words = toxicity.fold(text).split()
    total = sum(w for t, w in terms.items() for x in words if (x + " ").startswith(t))
    phrases = [e.split() for e in exceptions]
    return max(0.0, total - sum(w for e, w in zip(phrases, exceptions.values()) for i in range(len(words)) if words[i : i + len(e)] == e)), np.log1p(len(words) + 1)


def test_toxicity_against_brute_force(spark):
    rng = random.Random(12)
    terms, exceptions = {"kill": 2.5, "killer": 1.0, "ass ": 3.0, "scum": 4.0}, {"killer whale": 3.5, "big ass": 3.0}
    m = toxicity.Model(terms, exceptions, (-2.0, 1.0, 0.5))
    for _ in range(2000):
        t = rng.choice(["", " "]).join(rng.choice(["k1ller", "killer", "whale", ",", " ", "\n", "big", "ass", "assume", "ѕcum", "scums", "the", ". ", "-"]) + rng.choice(["", " ", "  ", ", "]) for _ in range(rng.randrange(15)))
        assert m.measure(t) == pytest.approx(brute_measure(terms, exceptions, t))
    docs, labels = labelled_docs(spark)
    sample = samples.labelled(docs, labels, "toxic", 200)
    rows, model = sample.collect(), toxicity.fit(sample)
    n = collections.Counter(r["label"] for r in {(r["text"], r["label"]): r for r in rows}.values())
    seen = collections.defaultdict(collections.Counter)
    for text, label in {(r["text"], r["label"]) for r in rows}:
        for f in toxicity._beginnings(text):
            seen[f][label] += 1
    found = {}
    for f, c in seen.items():
        odds = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
        share = n[1] / (n[0] + n[1])
        both = c[0] + c[1]
        ratio = 2 * sum(c[k] * np.log(c[k] / (both * q)) for k, q in ((1, share), (0, 1 - share)) if c[k])
        if odds >= 2.5 and ratio >= toxicity.LEAST_RATIO:
            found[f] = (odds, c[1])
    assert model.terms == pytest.approx(toxicity.choose(found)) and model.terms


def test_neighbours_against_brute_force(spark):
    docs, labels = labelled_docs(spark)
    model = knn.fit(samples.labelled(docs, labels, "quality", 60))
    got = {r["doc_id"]: r["score"] for r in knn.classify(docs, model).collect()}
    for doc_id, text in docs.collect():
        v = model.latent(knn.counts(text)[None])[0]
        cosine = sorted(((float(v @ u), y, w) for u, y, w in zip(model.vectors, model.labels, model.weights)), key=lambda x: -x[0])[: knn.NEIGHBOURS]
        votes = [(max(c, 0) ** 8 * np.sqrt(w), y) for c, y, w in cosine]
        assert got[doc_id] == pytest.approx(sum(a * y for a, y in votes) / sum(a for a, _ in votes), abs=2e-2)
    w = "ab cd ab. x".split()
    c = knn.counts("ab cd ab. x\nab cd ab. x")
    assert c[: knn.WORDS].sum() == 8 and c[knn.WORDS : -2].sum() == 8 and c[-2] == 5 and len(w) == 4


def labelled_docs(spark):
    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "amet", "sed", "quia", "nemo"]
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        if i % 4 == 0:
            w = [x + "###" for x in w]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["v1llain", "VILLAIN", "villains"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 != 0), int(i % 3 == 0)))
    labels += [(5, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark, odd, none):
    docs, labels = labelled_docs(spark)
    model = knn.fit(samples.labelled(docs, labels, "quality", 100))
    got = {r["doc_id"]: r["score"] for r in knn.classify(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in range(240)) >= 236
    assert {r["doc_id"] for r in knn.accepted(docs, model).collect()} == {i for i in got if got[i] >= 0.5}
    tox = toxicity.fit(samples.labelled(docs, labels, "toxic", 200))
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, tox).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(240)) >= 236
    assert tox.score("ѵillаin vіllain") >= 0.5 > tox.score("lorem ipsum") and "villain" in tox.terms
    for m, run in ((model, knn.classify), (tox, toxicity.classify)):
        got = run(odd.withColumn("label", F.lit(1)), m)
        assert got.count() == 14 and all(0 <= r["score"] <= 1 for r in got.collect()) and run(none, m).collect() == []
    nothing = labels.where("false")
    assert all(r["score"] == 0.5 for r in knn.classify(odd, knn.fit(samples.labelled(docs, nothing, "quality", 50))).collect())
    assert toxicity.classify(odd, toxicity.fit(samples.labelled(docs, nothing, "toxic", 50))).count() == 14


def test_toxicity_exceptions_take_the_weight_back():
    m = toxicity.Model({"killer": 3.0}, {"killer whale": 3.0}, (-2.0, 2.0, 0.0))
    assert m.measure("a k1ller came")[0] == 3.0 and m.measure("the killer whale")[0] == 0.0
    assert m.measure("the killer, whale")[0] == m.measure("the killer  whale")[0] == m.measure("killer\nwhale")[0] == 0.0


# -- token files


def test_sstable_lookup_and_damage(tmp_path):
    rng = random.Random(6)
    entries = sorted((rng.randrange(-(10**9), 10**9), [rng.randrange(50257) for _ in range(rng.randrange(60))]) for _ in range(5000))
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f, 2)
        for i, ids in entries:
            w.add(sstable.key_of(i), np.array(ids, "<u2").tobytes())
        w.close()
    with path.open("rb") as f:
        r = sstable.Reader(f)
        assert len(r.index) > 5 and r.entries == 5000 and [(i, t.tolist()) for i, t in r.scan()] == entries
        for i, ids in entries[::50]:
            assert ids in [t.tolist() for t in r.get(i)]
        assert sum(bool(r.get(x)) for x in range(10**9 + 1, 10**9 + 200)) == 0
    data = bytearray(path.read_bytes())
    data[5000] ^= 1
    path.write_bytes(bytes(data))
    with path.open("rb") as f, pytest.raises(Exception):
        list(sstable.Reader(f).scan())


def test_sstable_table(odd, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BYTE)
    got = sstable.encoded(odd, BYTE).collect()
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    texts = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows()), key=lambda r: (r[:2], signed(r[2])))
    want, start = [], 0
    for some, i, t in texts:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        want.append((i if some else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sstable.encoded(none, BYTE).collect() == []


def test_fast_encoder_equals_the_library():
    from tokenizers import Tokenizer

    file = open(BYTE, "rb").read()
    assert sstable.proven(file) and not sstable.proven(open(WORD, "rb").read())
    tk, enc, rng = Tokenizer.from_file(BYTE), sstable.Encoder(file, True), random.Random(3)
    texts = ["".join(rng.choice("ab'st1.é字 \n\t\xa0 ") for _ in range(rng.randrange(14))) for _ in range(20_000)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [" " * 100_000 + "x", " \n" * 500_000 + "x", "a" * 50_000, "x<|endoftext|>y"]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert [np.frombuffer(enc.encode(t), enc.type).tolist() for t in part] == [e.ids for e in tk.encode_batch_fast(part, add_special_tokens=False)]
    slow = sstable.Encoder(file, False)
    assert all(slow.encode(t) == enc.encode(t) for t in texts[:500])


def test_merges_out_of_order_are_not_proven():
    import json

    spec = json.load(open(BYTE))
    merges = spec["model"]["merges"]
    merges[10], merges[11] = merges[11], merges[10]
    assert not sstable.proven(json.dumps(spec).encode())


def test_one_id_fills_several_shards(spark):
    from tokenizers import Tokenizer

    docs = [(7, f"text {i % 50}") for i in range(400)] + [(i, "x") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    folder = sstable.new_path(spark, "shards")
    manifest = sstable.write(df, folder, BYTE, 2, shards=8)
    assert manifest.count() > 4 and max(r["entries"] for r in manifest.collect()) < 200
    got = sorted(sstable.read(spark, manifest, folder).collect(), key=lambda r: r["start"])
    tk = Tokenizer.from_file(BYTE)
    assert [r["id"] for r in got] == sorted(d[0] for d in docs)
    assert sum(r["n_tokens"] for r in got) == sum(len(tk.encode(t).ids) + 1 for _, t in docs)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


# -- BPE


def test_bpe_equals_the_library(odd, none):
    from tokenizers import Tokenizer

    tk, v, rng = Tokenizer.from_file(WORD), bpe.vocabulary(open(WORD, "rb").read()), random.Random(7)
    texts = ["".join(rng.choice("abcdefthinged aeiouéüñ'’.,!?12 \n\tİΣσß字🙂<|>_\x1c\x85") for _ in range(rng.randrange(70))) for _ in range(4000)]
    for t in [*texts, "x<|endoftext|>y", "a" * 3000]:
        ids = tk.encode(t, add_special_tokens=False).ids
        assert v.encode(t).tolist() == ids and v.decode(v.encode(t)).decode() == tk.decode(ids, skip_special_tokens=False)
    got = bpe.round_trip(odd.withColumn("n_tokens", F.lit("x")), WORD)
    assert got.count() == 14 and bpe.round_trip(none, WORD).collect() == []
    back = bpe.decode(bpe.encode(odd.select("doc_id", "text"), WORD), WORD)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()}[4] == ""


def test_other_vocabularies_are_refused():
    import json

    spec = json.load(open(WORD))
    spec["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Vocabulary(json.dumps(spec).encode())
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(BYTE, "rb").read())


# -- mixing


def test_splitting_tree(spark):
    quotas, shards = {"sa": 61, "sb": 200, "n": 7, "sc": 0}, 6
    df = spark.createDataFrame(list(quotas.items()), "skey string, n long").repartition(2)

    def sizes(units, k):
        if k == 1:
            return [units]
        half = -(-k // 2)
        left = int(units * half / k + 0.5)
        return sizes(left, half) + sizes(units - left, k - half)

    first = []
    for seed in range(8):
        got = {r["skey"]: np.diff([0, *r["upto"]]) for r in mixing.shard_quotas(df, shards, seed).collect()}
        assert {k: int(v.sum()) for k, v in got.items()} == quotas and all((v >= 0).all() for v in got.values())
        assert sum(got.values()).tolist() == sizes(sum(quotas.values()), shards)
        first.append([int(got[k][:3].sum()) for k in ("sa", "sb")])
    # Half of each source's units are expected in the first half of the shards; a draw of 134 from 268 has these spreads.
    for values, n in zip(zip(*first), (61, 200)):
        spread = np.sqrt(n * 0.25 * (268 - n) / 267)
        assert len(set(values)) > 1 and abs(np.mean(values) - n / 2) < 3 * spread / np.sqrt(8) and max(abs(v - n / 2) for v in values) < 4.5 * spread


def test_shards_hold_what_is_taken(spark):
    docs = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    plan = {r["doc_id"]: collections.Counter(r["shards"]) for r in mixing.mix(df, shards=5).collect()}
    seen = collections.defaultdict(collections.Counter)
    for r in mixing.mixed_rows(df, shards=5).collect():
        seen[r["doc_id"]][r["__shard"]] += 1
    assert {k: v for k, v in plan.items() if v} == dict(seen)
    placed = mixing.mixture(df, shards=5).withColumn("p", F.spark_partition_id()).collect()
    per = len({r["p"] for r in placed}) // 5 or 1
    by_shard = collections.Counter(r["p"] // per for r in placed)
    assert by_shard == sum(plan.values(), collections.Counter())


def test_mixing(spark, odd, none):
    docs = [(i, "w " * (i % 17), s) for i, s in enumerate(["a"] * 300 + ["b"] * 100 + ["c"] * 20 + [None] * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, shards=5).collect()
    total = sum(r["size"] for r in got)
    sizes = collections.Counter()
    for i, t, s in docs:
        sizes[s] += len(t.split())
    weights, target, free = {"a": 1, "b": 2, "c": 3, None: 1}, {}, {"a", "b", "c", None}
    while free:
        share = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if share * weights[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: share * weights[s] for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    taken, source = collections.Counter(), {d[0]: d[2] for d in docs}
    for r in got:
        taken[source[r["doc_id"]]] += r["size"] * len(r["shards"])
        assert len(r["shards"]) <= 3 and abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 and all(0 <= x < 5 for x in r["shards"])
    assert all(abs(taken[s] - target[s]) <= 8.5 for s in target)
    assert rows(mixing.mix(df.repartition(2), shards=5).select("doc_id", "shards")) == rows(mixing.mix(df, shards=5).select("doc_id", "shards"))
    mixed = mixing.mixed_rows(df, shards=5)
    assert mixed.count() == sum(len(r["shards"]) for r in got) and mixed.columns == [*df.columns, "__shard", "__place"]
    assert mixing.mix(odd).count() == 14 and mixing.mix(none).collect() == [] and mixing.mixed_rows(none).collect() == []
