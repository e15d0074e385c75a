"""Language id by held-out accuracy, the language model against brute force, WARC by round trip, and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernbank.llm import langid, lm, queries, warc


def held(doc_id, mod):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == 1


# ---- language id


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords(n):
    codes = langid.codewords(n)
    assert len(codes) == n and set(np.unique(codes)) <= {-1, 1}
    assert len({tuple(c) for c in codes}) == n


def test_language_held_out(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(true) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in tested) >= 0.98 * len(tested)


def test_language_cases(spark):
    docs = spark.createDataFrame(
        [(k, t, lang, 1.0) for k, (t, lang) in enumerate([("the cat is on the mat", "en"), ("der Hund ist in dem Haus", "de"), (None, "en"), ("12 34 ²", "de"), ("", None), ("the", None), ("the dog", None)] * 3)],
        "doc_id long, text string, lang string, score double",
    )
    got = langid.identify(docs, langid.fit_documents(docs)).collect()
    assert len(got) == 21
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if r.text and r.text.startswith("the"):
            assert r.lang_pred == "en"
    none = langid.identify(docs, langid.fit_documents(docs.where("lang is null")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit_documents(docs.limit(0))).count() == 0


def test_language_against_brute_force(spark):
    """Features, weights, margins and decoding by plain loops, over texts of all lengths and languages of all sizes."""
    rng = random.Random(17)
    alphabets = {k: "abcdefghijklmnopqrstuvwxyzéß"[i : i + 9] + " " for i, k in enumerate(["da", "de", "en", "fi", "long", "one"])}
    make = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    rows = [(len(alphabets) * i + j, make(k, rng.choice([1, 5, 60])), k) for i in range(12) for j, k in enumerate(["da", "de", "en", "fi"])]
    rows += [(900 + i, make("long", 40_000), "long") for i in range(3)] + [(990, make("one", 30), "one"), (None, None, "en"), (991, "no label", None)]
    rows += [rows[0]] * 5 + [(None, "same", "en")] * 9  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_documents(docs)

    def grams(text):
        b = b" " + b" ".join(text.encode().lower().split()) + b" "
        out = {}
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                f = (int.from_bytes(b[i : i + n], "big") | n_tag[n]) * 0x9E3779B1 % 2**32 >> 16
                out[f] = out.get(f, 0) + 1
        return out

    n_tag = {1: 1 << 24, 2: 1 << 25, 3: 1 << 26}
    distinct = {(d, t, k) for d, t, k in rows if t is not None and k is not None}
    assert model.languages == sorted(alphabets)
    share = {}
    for k in model.languages:
        total = {}
        for _, t, own in distinct:
            for f, n in grams(t).items() if own == k else ():
                total[f] = total.get(f, 0) + n
        share[k] = {f: n / sum(total.values()) for f, n in total.items()}

    def weight(f, bit):
        sides = []
        for sign in (1, -1):
            own = [share[k].get(f, 0) for k, c in zip(model.languages, model.codes) if c[bit] == sign]
            sides.append(sum(own) / len(own) + 1e-6)
        return math.log(sides[0] / sides[1])

    def margins(text):
        g = grams(text)
        return [sum(n * weight(f, bit) for f, n in g.items()) / sum(g.values()) for bit in range(model.codes.shape[1])]

    texts = {t for _, t, _ in distinct if len(t) < 100} | {"", "x", "new words\n here"}
    found = {t: margins(t) for t in sorted(texts)[:25]}
    for t, m in found.items():
        assert model.margins(t) == pytest.approx(m, abs=1e-5)
        losses = [sum(w * math.log1p(math.exp(-8 * c * x)) for w, c, x in zip(r, code, m)) * len(m) for r, code in zip(model.reliable, model.codes)]
        p = [math.exp(min(losses) - x) for x in losses]
        lang, score, _ = model.predict(t)
        if any(c.isalpha() for c in t):
            assert score == pytest.approx(max(p) / sum(p), abs=1e-4) and losses[model.languages.index(lang)] == pytest.approx(min(losses), abs=1e-4)
        else:
            assert lang == "und"
    text = make("long", 120_000)  # counted in one go, not gathered
    assert model.margins(text) == pytest.approx(margins(text), abs=1e-5) and model.predict(text)[0] == "long"
    one = [(t, k) for _, t, k in distinct if k == "one"]
    right = [1 + sum((x > 0) == (c > 0) for t, _ in one for x in [margins(t)[bit]]) for bit, c in enumerate(model.codes[model.languages.index("one")])]
    assert model.reliable[model.languages.index("one")] == pytest.approx([x / 2 / sum(y / 2 for y in right) for x in right])


def test_language_many(spark):
    """Every labelled language is learned, however many there are and however few rows it has."""
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * 9, f"l{k}") for k in range(420)]
    model = langid.fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 420
    assert sum(model.predict(t)[0] == k for _, t, k in rows) > 400


# ---- language model


def brute_tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute_lm(docs, held, deleted, order):
    """(score, base score, tokens, known) of each text by counting in plain dictionaries."""

    def count(which):
        c, ctx = {}, {}
        for t in which:
            w = [None] * order + brute_tokens(t)
            for i in range(order, len(w)):
                for k in range(order):
                    c[k, tuple(w[i - k : i + 1])] = c.get((k, tuple(w[i - k : i + 1])), 0) + 1
                    ctx[k, tuple(w[i - k : i])] = ctx.get((k, tuple(w[i - k : i])), 0) + 1
        return c, ctx, sum(k == 0 for k, _ in c)

    def tokens(text, model):
        c, ctx, _ = model
        w = [None] * order + brute_tokens(text)
        for i in range(order, len(w)):
            totals = [ctx.get((k, tuple(w[i - k : i])), 0) for k in range(order)]
            ps = [c.get((k, tuple(w[i - k : i + 1])), 0) / totals[k] if totals[k] else 0.0 for k in range(order)]
            seen = [k for k in range(order) if totals[k]]
            yield ((seen[-1] + 1, int(math.log2(totals[seen[-1]]))) if seen else (0, 0)), ps

    train = [t for t, h in zip(docs, held) if not h]
    kept = count([t for t, h, d in zip(docs, held, deleted) if not h and not d])
    cells = {}
    for t, d in zip(docs, deleted):
        for b, ps in tokens(t, kept) if d else ():
            near = (b, tuple(2.0 ** -min(round(-math.log2(p)), 254) if p else 0.0 for p in ps))
            cells[near] = cells.get(near, 0) + 1
    weights = {}
    for b in {b for b, _ in cells}:
        m = [1 / (b[0] + 1)] * (b[0] + 1)
        for _ in range(lm.ROUNDS):
            sums = [1e-3] * len(m)
            for (b2, ps), n in cells.items():
                if b2 == b:
                    share = [x * p for x, p in zip(m, [1 / (kept[2] + 1), *ps])]
                    for k, s in enumerate(share):
                        sums[k] += n * s / sum(share)
            m = [s / sum(sums) for s in sums]
        weights[b] = m
    model, n, v = count(train), sum(len(brute_tokens(t)) for t in train), None
    v = model[2]

    def weight(b):
        like = sorted((abs(x[1] - b[1]), x[1], x) for x in weights if x[0] == b[0])
        return weights[like[0][2]] if like else [1 / (b[0] + 1)] * (b[0] + 1)

    out = []
    for t in docs:
        score = sum(math.log10(sum(m * p for m, p in zip(weight(b), [1 / (v + 1), *ps]))) for b, ps in tokens(t, model))
        w = brute_tokens(t)
        known = [model[0].get((0, (x,)), 0) for x in w]
        out.append((score, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in known), len(w), sum(c > 0 for c in known), n))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_against_brute_force(spark, order):
    rng = random.Random(3)
    vocab = [f"W{k}" for k in range(30)]
    docs = []
    for k in range(220):
        w = ["the"]
        for _ in range(rng.randrange(25)):
            w.append("cat" if w[-1] == "the" and rng.random() < 0.7 else rng.choice(vocab[: 1 + k % 30]))
        docs.append((k, rng.choice([" ", "\n\t "]).join(w), "x", 1))
    docs += [(300, None, "x", 1), (301, "", "x", 1), (None, "unseen the é", "x", 1), (302, "the long " * 3000, "x", 1), docs[4]]
    df = spark.createDataFrame(docs, "doc_id long, text string, n string, b int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm.score(df, held_out, order=order, block_tokens=500).collect()
    flags = {(r.doc_id, r.text): r.d for r in df.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)) == 0).alias("d")).collect()}
    is_held = [held(d, 5) for d, *_ in docs]
    want = brute_lm([t for _, t, *_ in docs], is_held, [flags[d, t] and not h for (d, t, *_), h in zip(docs, is_held)], order)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((d, w[2], h, w[3], w[4], w[1], w[0]) for (d, *_), h, w in zip(docs, is_held, want)), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)
    if order > 1:
        tested = [r for r in got if r[2] and r[0] < 300]
        assert sum(r[6] for r in tested) > sum(r[5] for r in tested)


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "a")], "doc_id long, text string")
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
    none = lm.score(df, F.lit(True)).collect()  # no training: the unknown word is all there is
    assert len(none) == 3 and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)
    one = lm.score(df, F.lit(False)).collect()
    assert all(math.isfinite(r.score) and r.score < 0 and r.n_known == r.n_tokens for r in one)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_sums_to_one(order):
    """Every context's probabilities over the vocabulary, the end and one unknown word sum to one, whatever the context's count."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(15)]
    train = [" ".join(rng.choices(vocab, range(15, 0, -1), k=20)) for _ in range(40)]
    known = sorted({w for t in train for w in t.split()})
    contexts = ["w0", "w14", "new", "w1 w2", "w0 w0", "new w3", "w3 new", "new new", ""]
    held_texts = [(c, f"{c} {w}".strip()) for c in contexts for w in [*known, "never"]] + [(c, c) for c in contexts]
    block = lm._Open()
    for k, text in enumerate([*train, *(t for _, t in held_texts)]):
        block.add(k, k >= len(train), lm.token_hashes(text))
    block = lm.Block(block.close(0, False).to_pylist()[0], order, 60)
    counts = block.counts(np.repeat(~block.held, block.lengths).astype(float))
    totals = lm.Totals(21 * 40, 40, len(known) + 1)
    bucket, parts = block.estimates(counts, totals)
    cell = bucket.copy()
    for p in parts:
        cell = cell << 8 | lm._steps(p)
    mixed = lm.learn(cell[: 21 * 40 : 3], np.ones(280), order, totals.types)
    p = lm.probabilities(block, counts, totals, mixed)
    for c in contexts:
        n = len(c.split())
        total = sum(p[block.starts[len(train) + k] + n] for k, (of, _) in enumerate(held_texts) if of == c)
        assert total == pytest.approx(1, abs=1e-9), c


def test_weights_are_maximal():
    cells = np.array([(2 * 64 + 3) << 16 | 10 << 8 | 2, (2 * 64 + 3) << 16 | 7 << 8 | 255], np.int64)
    weights = np.array([70.0, 30.0])
    got = lm.learn(cells, weights, 2, 999, rounds=2000)

    def likelihood(m):
        p = np.array([[1e-3, 2.0**-10, 2.0**-2], [1e-3, 2.0**-7, 0]])
        return float(weights @ np.log(p @ m))

    best = got[2 * 64 + 3]
    assert abs(best.sum() - 1) < 1e-9 and got[64 + 5].tolist() == [0.5, 0.5, 0] and got[0].tolist() == [1, 0, 0]
    rng = np.random.default_rng(0)
    assert all(likelihood(rng.dirichlet([1, 1, 1])) <= likelihood(best) + 1e-3 for _ in range(500))


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200
    rows = [
        (7, "http://a.example/x?y=1", big, "x"),
        (3, "https://b.example:80/", big, "x"),
        (9, None, big, "x"),
        (4, "bad url\r\nX: 1", "short", "x"),
        (5, "http://c.example", "short", "x"),
        (6, "", None, "x"),
        (6, "", None, "x"),
        (None, "http://d.example", "z" * 150, "x"),
        (10, "http://e.example", "long payload " * 100_000, "x"),
        (8, "http://d.example", "z" * 150, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    target = f"file://{tmp_path}/warc"
    warc.write_archives(pages, target, file_records=7)
    records = warc.read_records(spark, target, with_payload=True).cache()
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).withColumn("page_id", warc.metadata_field("page_id").cast("long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.requests) == len(r.metadata) == 1
    found = sorted((str(r.page_id), r.response.type, r.response.payload_bytes, r.response.payload_sha256) for r in got)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        kind = "revisit" if page in (7, 9) or (page is None) else "response"
        want.append((str(page), kind, len(data), hashlib.sha256(data).hexdigest()))
    assert found == sorted(want)
    assert {bytes(r.response.payload).decode() for r in got if r.response.payload is not None} == {big, "short", "", "z" * 150, "long payload " * 100_000}
    ids = {r.page_id: r.response.id for r in got}
    assert {r.page_id: r.response.refers_to for r in got if r.response.type == "revisit"} == {7: ids[3], 9: ids[3], None: ids[8]}
    hot = spark.createDataFrame([(None, None, "q" * 120)] * 50 + [(1, None, "q" * 120)], "page_id long, url string, html string")
    warc.write_archives(hot, f"file://{tmp_path}/hot")
    kinds = [r.response.type for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/hot")).collect()]
    assert sorted(kinds) == ["response"] + ["revisit"] * 50
    empty = f"file://{tmp_path}/none"
    warc.write_archives(pages.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_warc_follows_one_hop(spark):
    schema = warc._HEADS
    row = lambda kind, rid, to: (kind, rid, to, None, None, None, None, 1, 1 if kind == "response" else None, "s", "f", None)
    rows = [row("response", "r1", "q1"), row("request", "q1", None), row("metadata", "m1", "q1"), row("response", "r2", None), row("metadata", "m2", "r2"), row("request", "q3", "gone")]
    got = {r.id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "r2"}
    assert [m.id for m in got["r1"].metadata] == ["m1"] and [m.id for m in got["r2"].metadata] == ["m2"]


def test_parse_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(one * 2)] == [b"ab"] * 2
    assert [b for _, b in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"ab"] * 2
    for step in (1, 7, 1 << 16):
        assert [b for _, b in warc.parse(one * 3 + b"\r\n", step)] == [b"ab"] * 3
        assert [b for _, b in warc.parse(gzip.compress(one * 2) + gzip.compress(one), step)] == [b"ab"] * 3
    many = gzip.compress(one) * 20_000  # a member a record, as archives usually are
    assert sum(1 for _ in warc.parse(memoryview(many))) == 20_000
    for cut in (one[:-6], one[:30], gzip.compress(one)[:-20]):
        with pytest.raises(ValueError):
            list(warc.parse(cut))
    assert list(warc.parse(b"")) == []


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    sentence = lambda n: " ".join(rng.choice(["the", "cat", "house", "green", "walks", "seven"]) + str(rng.randrange(10**5)) for _ in range(n))
    passage = " ".join(f"exam{k}" for k in range(12))
    docs = [(k, sentence(80) + "\nshared footer line", "en", "site", 0) for k in range(30)]
    near = docs[4][1].split(" ")
    near[40] = "swapped"
    docs += [(50, docs[3][1], "en", "site", 0), (51, " ".join(near), "en", "site", 0), (52, f"{sentence(20)} {passage} {sentence(20)}", "en", "other", 0), (53, "12 34", None, "site", 0), (54, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, frame = f"file://{tmp_path}", spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == corpus_pipeline.COLUMNS
        left.append({r.doc_id: r for r in frame.collect()})
    assert set(left[0]) == {*range(30), 50, 51, 52}
    assert set(left[1]) == set(left[0]) and all("footer" not in r.text and r.n_chars == len(r.text) for r in left[1].values())
    assert set(left[2]) == {*range(30), 52}
    assert set(left[3]) == set(range(30))
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(range(30))
    unlabelled = spark.createDataFrame([(1, "words here", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, None, None), (None, "É", None, None, None)], frame.schema)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.identify_language(spark, unlabelled, sf_dir).collect()) == ["1", "None"]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
