"""The corpus pipeline, stage by stage, against plain loops over a whole small table."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_lines, words
from tokenizers import Tokenizer

import corpus_pipeline
from fernbank.llm import graph, lines, similar, simhash, sketch

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    frame = stages["language_id"](spark, frame, SF)
    kept = {k: r.text for k, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id: r.text for r in frame.collect()} == kept

    frame = stages["line_dedup"](spark, frame, SF)
    cut = brute_lines([(k, t, docs[k].source) for k, t in kept.items()], lines.RATIO, lines.MIN_PAGES)
    kept = {k: t for k, t, *_ in cut}
    got = {r.doc_id: r for r in frame.collect()}
    assert {k: r.text for k, r in got.items()} == kept and all(r.n_chars == len(r.text) for r in got.values())

    frame = stages["simhash_near_dedup"](spark, frame, SF)
    ids = sorted(kept)
    sets = [set(sketch.shingle_hashes(kept[k]).tolist()) for k in ids]
    roots = brute_components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9)
    kept = {ids[k]: kept[ids[k]] for k in range(len(ids)) if roots[k] == k}
    assert {r.doc_id: r.text for r in frame.collect()} == kept
    assert len(kept) < len(ids)

    frame = stages["decontamination"](spark, frame, SF)
    windows: dict[int, set] = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    clean = lambda w: not any(tuple(w[i : i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1))
    kept = {k: t for k, t in kept.items() if clean(words(t))}
    assert {r.doc_id: r.text for r in frame.collect()} == kept

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces: dict[int, list] = {}
    for r in stages["packing"](spark, frame, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: [i for _, p in sorted(v) for i in p] for k, v in pieces.items()} == {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in kept.items()}
    assert corpus_pipeline.run(spark, SF).count() == sum(map(len, pieces.values()))


def test_near_dedup_goes_through_pivot_tables(spark, monkeypatch):
    """Without the set join near copies within a few bits are still found, by pivot tables; keys of one SimHash group are not joined again."""
    rng = random.Random(21)
    docs = []
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([100, 300, 900]))]
        edit = [*w[:50], f"new{k}", *w[51:]]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(edit))]
    frame = spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in docs], ", ".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ["long", "string", "string", "string", "long"])))
    prints = {r.doc_id: r.f0 & (1 << 64) - 1 for r in similar._prints(frame, "doc_id", "text", 5, 0.8, similar.BLOCK).collect()}
    bits = [(prints[2 * k] ^ prints[2 * k + 1]).bit_count() for k in range(40)]
    assert 10 < sum(0 < b <= similar.CLOSE for b in bits) < 35
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, frame, SF).collect())
    with monkeypatch.context() as patch:
        patch.setattr(similar, "LOOSE", -1000)  # the set join links nothing
        assert kept() == [d for d in range(80) if d % 2 == 0 or bits[d // 2] > similar.CLOSE]
        patch.setattr(simhash, "_within", lambda a, b, bits: F.lit(False))  # nor do pivot tables that discard all
        assert kept() == [d for d in range(80) if d % 2 == 0 or bits[d // 2] > 0]
    key, node, columns = np.array([5, 5, 5, 7, 7], np.uint64), np.arange(5, dtype=np.uint64), [np.full(5, x, np.uint64) for x in (100, 3, 4)]
    a, b = similar.Loose(0.8).of_mixed_runs(key, np.array([1, 1, 1, 1, 2], np.uint64), node, *columns)
    assert list(zip(a.tolist(), b.tolist())) == [(3, 4)]


def test_near_dedup_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Keys of fingerprints are estimated as a row a fingerprint, but are not broadcast for that; nor is a long list of documents, whose texts alone move."""
    rng = random.Random(22)
    docs = []
    for k in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:50], f"new{k}", *w[51:]])), (1000 + k, f"alone {w[3]} {w[1]}")]
    docs += [(None, docs[0][1]), (None, None), (5000, None)]
    frame = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in docs], ", ".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ["long", "string", "string", "string", "long"])))
    plans: list[tuple[str, str]] = []
    for module in (simhash, similar, graph):

        def seen(df, name, *rest, made=module.materialise):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return made(df, name, *rest)

        monkeypatch.setattr(module, "materialise", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    similar.similar(frame).count()
    exploded = [(name, plan) for name, plan in plans if "Generate explode(array(xxhash64" in plan]
    assert {name for name, _ in exploded} == {"edges", "links"}
    assert not [name for name, plan in exploded if "BroadcastExchange" in plan]
    plans.clear()
    order = lambda r: str(tuple(r))
    assert sorted(similar.similar(frame, broadcast_bytes=0).collect(), key=order) == sorted(similar.similar(frame).collect(), key=order)
    plan = next(plan for name, plan in plans if name == "sets")
    assert plan.count("BroadcastExchange") == 1 and "bitmap" in plan
    ids = spark.createDataFrame([(d, 7 * d) for d in range(3000)], "doc_id long, th long")
    passed = {bits: {r.doc_id for r in similar._maybe(ids, ids.where("doc_id % 10 = 0"), bits).collect()} for bits in (1 << 10, 1 << 15, 1 << 25)}
    assert all(set(range(0, 3000, 10)) <= p for p in passed.values())
    assert len(passed[1 << 25]) < 310 and len(passed[1 << 15]) < 400
