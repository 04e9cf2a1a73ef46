"""Each query's whole contract, and the pipeline's stages one by one, against brute force on a small table."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BYTE, WORD, brute_near_groups, brute_removal, brute_simhash, neighbour_order, odd_rows

import corpus_pipeline
from quillon.llm import knn, mixing, queries, samples

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").collect()


def run(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    return df, {r["doc_id"]: r for r in df.collect()}


def types(df):
    return dict(df.dtypes)


def test_op1(spark, docs):
    df, got = run(spark, "op1_fingerprints")
    want = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    assert want.items() <= types(df).items() and len(got) == len(docs)
    order = neighbour_order((r["doc_id"], r["text"]) for r in docs)
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    long = [got[i] for i, t in order if len(t) > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and np.mean([r["near_next"] for r in long]) < 0.2


@pytest.mark.parametrize("name,label,modulus,rest", [("op6_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 3, 1)])
def test_scores(spark, docs, name, label, modulus, rest):
    df, got = run(spark, name)
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= types(df).items() and len(got) == len(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = [i for i in labels if got[i]["held_out"] and labels[i] is not None]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.8


def test_op2(spark, docs):
    df, got = run(spark, "op2_language")
    assert {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}.items() <= types(df).items() and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [r for r in docs if r["lang"] is not None and got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_op3(spark, docs):
    df, got = run(spark, "op3_quality_rules")
    want = dict.fromkeys(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "bigint") | {"base_failed": "boolean", "kept": "boolean"}
    assert want.items() <= types(df).items() and len(got) == len(docs)
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert got[r["doc_id"]]["n_words"] == len(w) and not (got[r["doc_id"]]["base_failed"] and got[r["doc_id"]]["kept"])


def test_op4(spark, docs):
    df, got = run(spark, "op4_simhash")
    assert {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}.items() <= types(df).items()
    fps = {r["doc_id"]: brute_simhash(r["text"], 3) for r in docs}
    low, todo = {}, sorted(fps)
    for i in todo:
        stack = [] if i in low else [i]
        while stack:
            k = stack.pop()
            if k not in low:
                low[k] = i
                stack += [j for j in fps if j not in low and (fps[j] ^ fps[k]).bit_count() <= 3]
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", low[i]) for i in fps}


def test_op5(spark, docs):
    df, got = run(spark, "op5_suffix_array")
    assert {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}.items() <= types(df).items()
    want = brute_removal([r["text"] for r in docs], 200)
    assert [tuple(got[r["doc_id"]])[1:5] for r in docs] == want


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    df, got = run(spark, "op7_sstable")
    assert dict.fromkeys(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint").items() <= types(df).items()
    tk, start = Tokenizer.from_file(BYTE), 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r["doc_id"]])[1:4] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark):
    df, got = run(spark, "op8_mixing")
    assert {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() <= types(df).items()
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
        assert {r[0]: r[1:] for r in db.sql(queries.ORACLE_SQL["op8_mixing"]).fetchall()} == {i: tuple(r)[1:5] for i, r in got.items()}


@pytest.mark.parametrize("name", ["edited_texts", "rule_measures"])
def test_parts_that_sql_expresses(spark, name):
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
        want, got = db.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, DIR)
        assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.select(*want.columns).collect())


def brute_codes(tk, text):
    ids = tk.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    df, got = run(spark, "op10_bpe")
    assert {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}.items() <= types(df).items()
    tk = Tokenizer.from_file(WORD)
    assert {i: tuple(r)[1:4] for i, r in got.items()} == {r["doc_id"]: brute_codes(tk, r["text"]) for r in docs}


# -- the pipeline


def planted(spark, folder, rows):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def brute_quality(model, text):
    x = model.latent(knn.counts(text or "")[None])[0]
    if not (text or "").split():
        return model.prior
    near = sorted(range(len(model.labels)), key=lambda i: -float(x @ model.vectors[i]))[: knn.NEIGHBOURS]
    votes = [(max(float(x @ model.vectors[i]), 0) ** 8 * np.sqrt(model.weights[i]), model.labels[i]) for i in near]
    return sum(a * y for a, y in votes) / sum(a for a, _ in votes)


def whole_characters(text, length=200):
    """What is left of each text, repeats drawn in to whole characters."""
    data = [(t or "").encode() for t in text]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        for s, e in edges.tolist():
            for k in range(s, e):  # the bytes of characters that are cut stay
                at = k
                while b[at] & 0xC0 == 0x80:
                    at -= 1
                end = at + 1
                while end < len(b) and b[end] & 0xC0 == 0x80:
                    end += 1
                if at < s or end > e:
                    gone[k] = False
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode())
    return out


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [tuple(r) for r in docs]
    base = [r for r in rows if len((r[1] or "").split()) > 80][:12]
    passage = " ".join(f"passage{rng.randrange(1000)}" for _ in range(60))
    for k, r in enumerate(base):
        words = r[1].split()
        words[len(words) // 2] = "changed"
        rows.append((9000 + k, " ".join(words), r[2], r[3], r[4]))
        rows.append((9100 + k, r[1], r[2], r[3], r[4]))
        rows.append((9200 + k, " ".join(w[::-1] for w in r[1].split()) + " é " + passage, r[2], None if k % 3 else r[3], r[4]))
    folder = planted(spark, tmp_path, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeats", "mixture", "tokens"]
    table = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    now, held = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = now.columns
    for name, stage in stages.items():
        before = now
        after = stage(spark, before, folder)
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        now = spark.read.parquet(path)
        held[name] = (table(before), table(now))
        assert name == "tokens" or now.columns == columns

    before, after = held["quality"]
    model = knn.fit(samples.labelled(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "quality", knn.BOUND))
    scores = [brute_quality(model, r[1]) for r in before]
    assert {r for r, s in zip(before, scores) if s >= 0.51} <= set(after) <= {r for r, s in zip(before, scores) if s >= 0.49} and len(after) < len(before)

    before, after = held["near_copies"]
    ordered = sorted(before)
    groups = brute_near_groups([r[1] or "" for r in ordered])
    equal = {}
    for k, r in enumerate(ordered):  # texts without five words: equal ones are copies
        groups[k] = equal.setdefault(r[1] or "", groups[k]) if groups[k] == k else groups[k]
    assert sorted(after) == [r for k, r in enumerate(ordered) if groups[k] == k] and len(after) < len(before)

    before, after = held["repeats"]
    left = whole_characters([r[1] for r in before])
    assert sorted(after, key=repr) == sorted(((r[0], t, r[2], r[3], len(t)) for r, t in zip(before, left)), key=repr) and left != [r[1] for r in before]

    before, after = held["mixture"]
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{tmp_path}/repeats/*.parquet'")
        taken = {r[0]: (r[1], r[4]) for r in db.sql(mixing.ORACLE).fetchall()}
    times = collections.Counter(r[0] for r in after)
    assert set(after) <= set(before) and all(times[i] * size == words for i, (size, words) in taken.items()) and len(after) != len(before)

    before, after = held["tokens"]
    tk = Tokenizer.from_file(WORD)
    assert collections.Counter((r[0], *r[3:]) for r in after) == collections.Counter((r[0], *brute_codes(tk, r[1])) for r in before)
    assert table(corpus_pipeline.run(spark, folder)) == after


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, name):
    folder = planted(spark, tmp_path, [])
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows()], schema).repartition(3)
    assert stage(spark, odd.where("false"), folder).collect() == []
    clashing = odd.withColumns({c: F.lit(1) for c in ("node", "key", "row", "size", "score", "label", "spans", "skey", "ids")})
    got = stage(spark, clashing, folder)
    found = got.collect()
    if name == "tokens":
        assert len(found) == 14
    else:
        assert got.columns == clashing.columns and (name != "repeats" or len(found) == 14)
        assert {r["doc_id"] for r in found} <= {r[0] for r in odd_rows()}

