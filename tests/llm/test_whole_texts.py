"""The training-data operators take the whole of their input."""

from collections import Counter

import numpy as np
import pytest

from granary.llm import secrets, toxicity


def test_a_bounded_sample_keeps_the_class_ratio(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta"]
    rows = [(i, " ".join(rng.choice(words, 12)), int(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    mean = {n: np.mean([r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, docs, toxicity.Params(labels_per_class=n))).collect()]) for n in (200, 50_000)}
    assert abs(mean[50_000] - 0.1) < 0.05 and abs(mean[200] - 0.1) < 0.08


def brute_log_ratios(seen, p):
    """Sequence to log P_toxic - log P_ordinary, and context to the log of the backoff masses' ratio, from (text, y)."""
    n = [Counter(), Counter()]
    for text, y in seen:
        padded = " " + " ".join(text.lower().split()) + " "
        n[y].update(padded[i : i + p.order] for i in range(len(padded) - p.order + 1))
    grams = set(n[0]) | set(n[1])
    types = {p.order: grams}
    for k in range(p.order - 1, 0, -1):
        types[k] = {g[1:] for g in types[k + 1]}
    kinds = {k: Counter(g[1:] for g in types[k + 1]) for k in range(1, p.order)}
    heads = {k: Counter() for k in kinds}
    followers = {k: Counter() for k in kinds}
    for k in kinds:
        for s, c in kinds[k].items():
            heads[k][s[:-1]] += c
            followers[k][s[:-1]] += 1

    def shared(s):
        if not s:
            return 1 / p.alphabet
        k, h = len(s), s[:-1]
        return (max(kinds[k][s] - p.discount, 0) + p.discount * followers[k][h] * shared(s[1:])) / heads[k][h]

    under, follow = [Counter(), Counter()], [Counter(), Counter()]
    for y in (0, 1):
        for g, c in n[y].items():
            under[y][g[:-1]] += c
            follow[y][g[:-1]] += 1

    def chance(g, y):
        h = g[:-1]
        return (max(n[y][g] - p.discount, 0) + p.discount * follow[y][h] * shared(g[1:])) / under[y][h] if under[y][h] else shared(g[1:])

    mass = lambda h, y: p.discount * follow[y][h] / under[y][h] if under[y][h] else 1.0
    return {g: np.log(chance(g, 1) / chance(g, 0)) for g in grams}, {h: np.log(mass(h, 1) / mass(h, 0)) for h in {g[:-1] for g in grams}}


def hash_of(t):
    return toxicity.rolling(np.array([ord(x) for x in t], dtype=np.uint64), len(t))


def test_every_sequence_has_its_own_ratio(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(list("abcdéf 日"), 60)), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    p = toxicity.Params()
    seen = toxicity.labelled(docs, toxicity.allowed(docs, "doc_id", "toxic"), p, "doc_id", "text").collect()
    grams = toxicity.sequence_counts(toxicity.labelled(docs, toxicity.allowed(docs, "doc_id", "toxic"), p, "doc_id", "text"), p).cache()
    shared = toxicity.shared_backoff(grams, p)
    want, masses = brute_log_ratios([(r.text, r.y) for r in seen], p)
    model = toxicity.fit(docs, docs, p)
    assert len(model.ratio.hashes) == len(want) and len(model.back.hashes) == len(masses)
    for table, values in ((model.ratio, want), (model.back, masses)):
        for g, v in values.items():
            assert table.look_up(hash_of(g), np.nan)[0] == pytest.approx(v, abs=1e-4)
    assert np.isnan(model.ratio.look_up(hash_of("zzzzz"), np.nan)).all()
    # a model without a fold: chances of the others' counts above the backoff of all
    value = {r.gram: r.value for r in toxicity.log_ratios(grams, shared, p, 1)[0].collect()}
    left = Counter()
    for r in seen:
        padded = " " + " ".join(r.text.split()) + " "
        left.update(padded[i : i + 5] for i in range(len(padded) - 4) if r.fold != 1)
    assert set(value) == set(left)
    # the evidence of a text, from the brute-force ratios
    for text in (rows[0][1], "abcd zzzz 日abc", "", "a"):
        padded = " " + " ".join(text.split()) + " "
        each = [want.get(padded[i : i + 5], masses.get(padded[i : i + 4], 0.0)) for i in range(len(padded) - 4)]
        assert toxicity.evidence(text, model.ratio, model.back, p)[0] == pytest.approx(np.mean(each) if each else 0.0, abs=1e-3)


def test_labels_of_one_kind_give_their_share(spark, odd):
    docs = spark.createDataFrame([(i, f"some words {i}", 0) for i in range(20)], "doc_id long, text string, toxic int")
    for labels, share in ((docs, 0.0), (docs.withColumn("toxic", docs.toxic + 1), 1.0), (docs.limit(0), 0.0)):
        assert {r.toxicity for r in toxicity.score(odd, toxicity.fit(docs, labels)).collect()} == {share}


def test_copies_do_not_make_a_secret_unsure(spark):
    one, two, bare, three = "token = q8Zt5kLw0pXv7Rm2", "token = w3Nc9yHb6sDf1Jg4", "Kq7Zt5mLw0pXv7Rm2Qb8", "token = z5Vb2nMx8kQp0Tr6"
    rows = [(i, f"a {one} b {bare} c", "s1") for i in range(6)] + [(10 + i, f"a {two} b {bare[::-1]} c", f"s{i % 2}") for i in range(6)]
    rows += [(20 + i, f"a {three} b {bare.swapcase()} c", f"s{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: [(secrets.KINDS[s.kind_no], s.verdict) for s in r.found] for r in secrets.find_secrets(docs).collect()}
    left = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i in range(6):
        assert found[i] == [("assign", "live"), ("bare", "live")] and left[i] == "a token = <secret> b <secret> c"
        assert found[10 + i] == [("assign", "unsure"), ("bare", "unsure")] and left[10 + i] == "a token = <secret> b <secret> c"
    for i in range(20, 23):
        assert found[i] == [("assign", "example")] and three in left[i]
