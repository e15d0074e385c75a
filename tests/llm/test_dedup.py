"""Line dedup, decontamination, sketches and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from fernbank.llm import decontaminate, graph, lines, simhash, similar, sketch

# ---- line dedup

PAGES = "doc_id long, text string, source string, _drop int, n_lines string, __text int, _cut_0 int, _SITE_0 string"


def brute_lines(rows, ratio, min_pages):
    pages, counts = {}, {}
    for _, text, site, *_ in rows:
        pages[site] = pages.get(site, 0) + 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(" "):
                counts[site, line] = counts.get((site, line), 0) + 1
    out = []
    for doc, text, site, *_ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        kept = [x for x in text.split("\n") if not (counts.get((site, x), 0) >= min_pages and counts[site, x] / pages[site] > ratio)]
        out.append((doc, "\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lines(spark, limit):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        site = rng.choice(["hot", "hot", "a", None])
        text = "\n".join(rng.choice(["cookie notice", "", "  ", "shared", *[f"line {i}" for i in range(200)]]) for _ in range(rng.randrange(6)))
        rows.append((k, rng.choice([text, text, None]) if k % 7 else None, site, 1, "x", k, 5, "s"))
    rows += [rows[3]] * 2 + [(None, "cookie notice\ncookie notice", "hot", 1, "x", 4, 5, "s"), (500, "cookie notice\n" + "long line " * 20_000 + "\n" * 50_000, "hot", 1, "x", 6, 5, "s")]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, PAGES), ratio=0.1, min_pages=3, broadcast_bytes=limit)
    assert set(got.columns) == {"doc_id", "text", "source", "_drop", "n_lines", "n_dropped", "__text", "_cut_0", "_SITE_0"}
    assert sorted(r["__text"] for r in got.collect()) == sorted(r[5] for r in rows) and {(r["_cut_0"], r["_SITE_0"]) for r in got.collect()} == {(5, "s")}
    key = lambda r: [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(brute_lines(rows, 0.1, 3), key=key)
    assert lines.drop_boilerplate(spark.createDataFrame([], PAGES)).count() == 0


# ---- decontamination


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_hits(docs, items, window):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            iw = words(body)
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == iw[a : a + n]:
                        hit.update(range(s, s + n))
                        found.add(item)
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_decontaminate(spark, limit):
    rng = random.Random(2)
    vocab = ["a", "b", "The", "É", "ñu", "x1", "zz"]
    make = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, make(rng.choice([0, 1, 2, 3, 4, 5, 6, 9]))) for k in range(14)] + [(90, None), (None, "only here now"), (91, "..."), (3, "zz zz zz zz x1")]
    docs = [(k, make(rng.randrange(30))) for k in range(40)] + [(100, None), (101, ""), (None, "only here now a b"), (7, "same id other text"), (102, items[5][1])]
    docs += [docs[2]] * 2
    docs.append((103, "a b " * 5000 + items[5][1]))
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, hit_doc int, th int")
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, len int")
    got = decontaminate.decontaminate(d, b, window=4, broadcast_bytes=limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(brute_hits(docs, items, 4), key=key)
    left = decontaminate.clean_documents(d, b, broadcast_bytes=limit)
    want = [x[:2] for x, hit in zip(docs, brute_hits(docs, items, 10)) if not hit[2]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    assert left.columns == d.columns
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_no_exchange_carries_words(spark):
    """Beyond the broadcast limit positions move with their own shingle, not with the document's words."""
    docs = spark.createDataFrame([(1, "a b c d e " * 20)], "doc long, text string").select("doc", "doc", decontaminate.words("text").alias("w")).toDF("doc", "th", "w")
    shingles = spark.createDataFrame([(3, "a b c", 5)], "k int, sh string, h long").repartition(2)
    found = decontaminate._occurrences(docs, shingles, 3, 0, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = re.findall(r"Exchange hashpartitioning.*\n.*?Project \[(.*)\]", plan)
    assert exchanged and not any(re.search(r"(^|, )w#\d+(,|$)", columns) for columns in exchanged)
    assert "Join" in plan and "BroadcastHashJoin" not in plan


# ---- sketches


def test_sketch_basics():
    text = "one two three four five six seven"
    assert len(sketch.shingle_hashes(text)) == 3 and len(sketch.shingle_hashes("one two")) == 1 and not len(sketch.shingle_hashes(" \n"))
    assert (sketch.shingle_hashes("ONE two\n three  four five SIX seven") == sketch.shingle_hashes(text)).all()
    # a range's hash does not depend on where it stands
    assert sketch.shingle_hashes("zero " + text)[1:].tolist() == sketch.shingle_hashes(text).tolist()
    rng = random.Random(4)
    a, b = ([str(rng.random()) for _ in range(3000)] for _ in range(2))
    ha, hb = (sketch.shingle_hashes(" ".join(x)) for x in (a, b))
    sa, sb = sketch.sketch(ha), sketch.sketch(hb)
    assert 0.8 < len(sa) * sketch.SCALED / 2996 < 1.2
    assert (sketch.from_string(sketch.to_string(sa)) == sa).all()
    assert (sketch.merge(sa, sb) == sketch.sketch(np.concatenate((ha, hb)))).all()
    part = sketch.sketch(sketch.shingle_hashes(" ".join(a[:300])))
    assert sketch.containment(part, sa) == 1 and sketch.likeness(sa, part) == 1
    half = sketch.sketch(sketch.shingle_hashes(" ".join(a[:1500] + b[:1500])))
    assert abs(sketch.containment(sa, half) - 0.5) < 0.1


def brute_hash(data):
    """The polynomial hash of a byte string by whole-number arithmetic, and the mixer."""
    mod, base = 1 << 64, 0x9E3779B97F4A7C15 | 1
    h = (sum((c + 1) * pow(base, i, mod) for i, c in enumerate(data)) + len(data)) % mod
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * times % mod
    return h ^ h >> 31


def brute_sketch(text):
    """(kept 4-byte hashes, the bound below which they are complete) of a text's five-word shingles."""
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    high = sorted({brute_hash(b" ".join(w[i : i + k])) >> 32 for i in range(len(w) - k + 1)}) if w else []
    kept = high[: max(64, sum(h < 2**31 for h in high))]
    return kept, 2**32 if len(kept) < 64 else max(2**31, kept[-1] + 1)


def brute_likeness(a, b):
    (x, bx), (y, by) = a, b
    if not x or not y:
        return float(not x and not y)
    x, y = ({h for h in s if h < min(bx, by)} for s in (x, y))
    return max(len(x & y) / len(s) if s else 0.0 for s in (x, y))


@pytest.mark.parametrize("partitions", [1, 7, 30, None])
def test_edited(spark, partitions):
    import base64
    import struct

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(40))) for _ in range(97)]
    texts[:3] = [" ".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(3)]
    rows = [(k * 3 % 101, t, "x", 1) for k, t in enumerate(texts)] + [(500, None, "x", 1), (501, "x" * 4000, "x", 1), (502, "y z " * 100_000, "x", 1)]
    rows += [(None, "null id", "x", 1), (rows[5][0], "same id", "x", 1), rows[7]]
    rows += [(None, f"null id {k % 30}", "x", 1) for k in range(40)] + [(77, f"hot {k} id", "x", 1) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, copy int")
    got = sketch.edited_fingerprints(df, partitions=partitions).collect()
    hashes = {r.t: r.h for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""], (r[1] or "").encode()))
    prints, want = {}, []

    def print_of(t):
        if t not in prints:
            prints[t] = brute_sketch(t)
        return prints[t]

    string = lambda s: base64.b64encode(b"".join(struct.pack(">I", h) for h in s[0])).decode()
    for k, (doc, text, *_) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        own, other, after = map(print_of, (text, edited, nxt))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), string(own), string(other), brute_likeness(own, other), brute_likeness(own, after)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sketch.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sketch.edited_fingerprints(spark.createDataFrame([(4, "alone")], "doc_id long, text string")).count() == 1
    assert sketch.edited_fingerprints(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).count() == 3
    prints = {r.doc_id: r.fingerprint for r in sketch.fingerprints(spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, None)], "doc_id long, text string")).collect()}
    assert prints[1] == prints[2] and prints[3] == ""


def test_sketches_of_short_texts():
    """Texts of fewer than 64 shingles are compared exactly, longer ones nearly so, and sketches merge at any length."""
    rng = random.Random(14)
    for n in [*range(5, 69), 100, 300] * 3:
        a, b = ([str(rng.random()) for _ in range(n)] for _ in range(2))
        edit = a[: n - n // 4] + b[: n // 4]
        hashes = [np.unique(sketch.shingle_hashes(" ".join(x))) for x in (a, edit)]
        true = len(np.intersect1d(*hashes)) / min(map(len, hashes))
        prints = [sketch.sketch(h) for h in hashes]
        assert abs(sketch.likeness(*prints) - true) < (1e-9 if n <= 67 else 0.2), n
        assert (sketch.merge(*prints) == sketch.sketch(np.concatenate(hashes))).all()


# ---- SimHash


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(nodes))]


def check_groups(ids, roots, got):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, least.get(r)) for i, r in zip(ids, roots)), key=str) == sorted(got, key=str)


def test_near_duplicates_of_texts(spark):
    rng = random.Random(8)
    base = [[rng.choice("the of and") if rng.random() < 0.3 else str(rng.randrange(500)) for _ in range(rng.choice([0, 1, 2, 5, 60, 300]))] for _ in range(60)]
    docs = []
    for k, w in enumerate(base):
        for _ in range(rng.choice([1, 1, 4])):
            w = list(w)
            if w and rng.random() < 0.8:
                w[rng.randrange(len(w))] = "Changed"
            docs.append((len(docs), " ".join(w), "x", 1))
    docs += [(900, None, "x", 1), (901, "", "x", 1), (None, docs[3][1], "x", 1), docs[5], (902, "É É\té", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, f0 string, root int")
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t, *_ in docs]
    assert sorted(r.f0 & (1 << 64) - 1 for r in got) == sorted(prints)
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert check_groups([d[0] for d in docs], roots, [(r.doc_id, r.component_id) for r in got])
    kept = simhash.one_of_each(df, simhash.near_duplicates(df))
    assert kept.count() == len(set(roots)) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("spread", "blocks"), [(2, 5), (4, 6), (7, 5), (4, 8)])
def test_links_in_dense_groups(spark, spread, blocks):
    """Fingerprints around a few centres: chains and rims that no single star reaches."""
    rng = random.Random(spread)
    prints = {0}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "f0 long")
    from pyspark.sql import functions as F

    keys = [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(m))) for k, m in enumerate(simhash.block_masks(3, blocks))]
    found = {r.node: r.root for r in simhash._link(nodes, keys, 3).collect()}
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = {}
    for x, r in zip(signed, roots):
        want.setdefault(r, []).append(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, group(signed, found).values()))


def test_pivot_tables_and_keys(spark):
    """No close pair is discarded by its coordinates or missed by the keys; nearly all others are discarded; keys grow with the number of fingerprints."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        pairs += [(simhash.signed(a), simhash.signed(a ^ flips), True), (simhash.signed(a), simhash.signed(rng.getrandbits(64)), False)]
    df = spark.createDataFrame(pairs, "a long, b long, close boolean")
    tables = [simhash._pivot_table(F.col(c)) for c in "ab"]
    passed = {r.close: r.share for r in df.groupBy("close").agg(F.avg(simhash._within(*tables, 3).cast("int")).alias("share")).collect()}
    assert passed[True] == 1 and passed[False] < 0.02
    for n in (5, 6, 9):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(3, n)]
        assert all(any((a ^ b) & m == 0 for m in masks) for a, b, close in pairs[:400] if close)
    assert [simhash.key_blocks(3, n) for n in (0, 10**5, 10**8, 10**10)] == [5, 5, 6, 7]


def group(nodes, roots):
    out = {}
    for x in nodes:
        out.setdefault(roots.get(x, x), []).append(x)
    return out


@pytest.mark.parametrize("short", [0, 64])
def test_forests(monkeypatch, short):
    rng = random.Random(7)
    loose, exact = similar.Loose(0.8), similar.Exact(0.8)
    monkeypatch.setattr(similar, "SHORT", short)
    loose.limit = 2
    for _ in range(30):
        prints = [(rng.randrange(8, 12), rng.getrandbits(3) << 5 | rng.getrandbits(2), rng.getrandbits(6)) for _ in range(rng.randrange(1, 40))]
        columns = tuple(np.array(x, np.uint64) for x in zip(*prints))
        close = lambda a, b: min(a[0], b[0]) >= 0.8 * max(a[0], b[0]) and (short > 0 or (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() <= 2)
        edges = loose.forest(columns)
        assert all(close(prints[a], prints[b]) for a, b in edges)
        joined = {tuple(sorted(e)) for e in edges}
        by_edges = brute_components(list(range(len(prints))), lambda a, b: tuple(sorted((a, b))) in joined)
        assert by_edges == brute_components(prints, close) and len(edges) == len(prints) - len(set(by_edges))
        sets = [np.unique(np.array([rng.randrange(12) for _ in range(rng.randrange(9))], np.int64)) for _ in range(25)]
        alike = lambda a, b: len(a) > 0 and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
        joined = {tuple(sorted(e)) for e in exact.forest(sets)}
        assert brute_components(list(range(25)), lambda a, b: tuple(sorted((a, b))) in joined) == brute_components(sets, alike)
        key = np.sort(np.array([rng.randrange(5) for _ in prints], np.uint64))
        a, b = loose.of_runs(key, np.arange(len(prints), dtype=np.uint64), *columns)
        joined = {tuple(sorted(e)) for e in zip(a.tolist(), b.tolist())}
        both = lambda i, j: key[i] == key[j] and close(prints[i], prints[j])
        own = list(range(len(prints)))
        assert brute_components(own, lambda i, j: tuple(sorted((i, j))) in joined) == brute_components(own, both)


def check_similar(spark, docs, **options):
    """The rows whose group differs from brute force."""
    got = [(r.doc_id, r.component_id) for r in similar.similar(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()]
    sets = [set(sketch.shingle_hashes(t or "").tolist()) for _, t in docs]
    roots = brute_components(sets, lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b) - 1e-9))
    least = {}
    for (d, _), r in zip(docs, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, least.get(r)) for (d, _), r in zip(docs, roots)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("options", [{"broadcast_bytes": 0}, {"block": 500, "chunk": 2, "chunk_shingles": 300}])
def test_similar(spark, options):
    """Copies of all degrees, in blocks, chunks and joins of every kind."""
    rng = random.Random(12)
    docs = []
    for _ in range(40):
        w = [str(rng.randrange(10**6)) for _ in range(rng.choice([40, 400]))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(3):
            c = list(w)
            for at in rng.sample(range(len(w)), len(w) // 100 + rng.randrange(len(w) // 30)):
                c[at] = "new" + str(rng.random())
            docs.append((len(docs), " ".join(c)))
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "other"), (None, docs[0][1]), docs[4], (1004, "long " * 30000), (1005, "long " * 20000), (None, "nothing like it"), (1006, "one")]
    check_similar(spark, docs, **options)


def test_similar_in_dense_groups(spark):
    """Chains and rims of near copies in one group, far larger than a chunk: links that the group's first member doesn't imply."""
    rng = random.Random(15)
    docs = []
    for length in (30, 200):
        centre = [str(rng.randrange(10**6)) for _ in range(length)]
        for k in range(80):
            c = list(centre)
            at = rng.randrange(length)
            for i in range(rng.randint(0, length // 25)):
                c[(at + i) % length] = f"x{k // 2}"
            docs.append((len(docs), " ".join(c)))
        docs += [(len(docs) + i, " ".join(centre[i * length // 60 :] + [f"y{j}" for j in range(i * length // 60)])) for i in range(20)]
    check_similar(spark, docs, chunk=8, chunk_shingles=600, block=2000)


def test_similar_loses_no_pair(spark):
    """Short texts at exactly 0.8, where majority bits are biased: 8 against 9 words, and 12 of 15 shingles."""
    rng = random.Random(31)
    docs = []
    for k in range(600):
        w = [f"w{rng.randrange(10**6)}" for _ in range(8 if k % 2 else 16)]
        docs.append((len(docs), " ".join(w)))
        docs.append((len(docs), " ".join(w + [f"x{k}" * (1 + i) for i in range(1 if k % 2 else 3)])))
    got = {r.doc_id: r.component_id for r in similar.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [d for d, c in got.items() if c != d - d % 2] == []


def test_similar_at_the_threshold(spark):
    """Long texts at or just above 0.8, all by edits that spread the difference or gather it: the fingerprints' limit loses none."""
    rng = random.Random(33)
    docs = []
    for k in range(300):
        n = rng.choice([70, 150, 404, 1000])
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        docs.append((2 * k, " ".join(w)))
        shingles = n - 4
        if k % 2:  # each lone edit in the middle changes five shingles
            changed = int(shingles * (1 - 0.8) / (1 + 0.8)) // 5
            for i in range(changed):
                w[4 + i * (n - 8) // max(changed, 1)] = f"new{k} {i}".replace(" ", "")
        else:
            w = w[: n - int(0.2 * shingles)]
        docs.append((2 * k + 1, " ".join(w)))
    got = {r.doc_id: r.component_id for r in similar.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [d for d, c in got.items() if c != d - d % 2] == []


def test_similar_candidates_are_few(spark):
    """Only keys of several sets are left to join, and their number follows the number of documents."""
    joined = {}
    for n in (200, 2000):
        rng = random.Random(n)
        words = [f"w{k}" for k in range(300)]
        docs = [(k, "a line that stands in every one of all the documents " + " ".join(rng.choices(words, k=60))) for k in range(n)]
        docs += [(n + k, docs[k][1] + " tail") for k in range(n // 10)]
        prints = similar._prints(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5, 0.8, 5000)
        joined[n] = prints.where("size(prefix) > 0").count()
        assert joined[n] < 0.3 * n
    assert joined[2000] < 15 * joined[200]


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    links = set(edges)
    roots = brute_components(nodes, lambda a, b: (a, b) in links or (b, a) in links)
    assert {n: nodes[r] for n, r in zip(nodes, roots) if nodes[r] != n} == {n: r for n, r in got.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
