"""Each operator against a brute-force version, on odd rows and on empty tables."""

import hashlib
import itertools
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from granary.llm import ann, components, langid, lines, minhash, packing, pieces, secrets, sharding, topk, toxicity
from granary.llm.common import held_out

BPE, RANKS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# packing


def check_packing(docs, packed):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    want = Counter((d, tuple(tk.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    texts = defaultdict(list)
    for (d, ids), n in want.items():
        texts[d] += [ids] * n
    for d, all_ids in texts.items():
        covered = Counter((r.start, r.length) for r in by_doc[d])
        assert sum(r.length for r in by_doc[d]) == sum(map(len, all_ids))
        for r in by_doc[d]:
            assert any(packing_crc(i[r.start : r.start + r.length]) == zlib.crc32(r.ids) and r.doc_tokens == len(i) for i in all_ids)
        if len(all_ids) == 1:
            assert sum(n for _, n in covered) == len(all_ids[0])
    odd = 0
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 1024
        odd += at & (at - 1) != 0
    assert odd == 0


def packing_crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing(spark, sf, odd, empty):
    docs = docs_of(spark, sf)
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, json_file=BPE, rank_file=RANKS).collect())
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd, json_file=BPE, rank_file=RANKS, buffer=2).collect())
    assert packing.pack(empty, json_file=BPE, rank_file=RANKS).count() == 0


def test_assignment_is_descending_to_the_cheapest():
    placed, left = packing.assign(np.array([10, 60, 50, 40, 40]), np.array([100, 100]), 1.0, 0.01)
    assert not left and [p[:1] + p[2:4] for p in placed[:3]] == [(1, 60, 0), (2, 50, 1), (3, 40, 1)]
    assert sum(p[2] for p in placed) == 200


# language


def test_language_held_out(spark, sf, odd, empty):
    found = {r.doc_id: r for r in langid.op2_language(spark, sf).collect()}
    docs = docs_of(spark, sf).withColumn("h", held_out()).collect()
    assert all(found[r.doc_id].held_out == r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs)
    wrong = [r for r in docs if r.h and found[r.doc_id].lang_pred != r.lang and re.search(r"\w", r.text)]
    assert len(wrong) <= 2
    p = langid.Params()
    names, unit = langid.prototypes(langid.profile_counts(docs_of(spark, sf), p, "text", "lang"), p)
    got = langid.identify(odd, names, unit, p).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 6, 7)} == {"und"}
    assert langid.identify(empty, names, unit, p).count() == 0
    none, zero = langid.prototypes(langid.profile_counts(empty, p, "text", "lang"), p)
    assert {r.lang_pred for r in langid.identify(odd, none, zero, p).collect()} == {"und"}


def test_language_against_plain_bundles(spark, sf):
    """Predictions and cosines from vectors bundled one n-gram after the other."""
    p = langid.Params(dimensions=256)
    docs = [(r.doc_id, r.text or "", r.lang) for r in docs_of(spark, sf).orderBy("doc_id").limit(60).collect()]
    letters, space = langid.Letters(p), langid.Space(p)

    def bundle(text):
        total = np.zeros(p.dimensions, dtype=np.int64)
        for g, n in Counter(letters.trigrams(text).tolist()).items():
            total += n * space.vectors(np.array([g]))[0].astype(np.int64)
        return total

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    names, unit = langid.prototypes(langid.profile_counts(df, p, "text", "lang"), p)
    assert names == sorted({x for _, _, x in docs})
    want = np.array([sum(bundle(t) for _, t, x in docs if x == name) for name in names], dtype=float)
    assert np.allclose(unit, want / np.linalg.norm(want, axis=1, keepdims=True))
    found = {r.doc_id: r for r in langid.identify(df, names, unit, p).collect()}
    for i, t, _ in docs:
        v = bundle(t).astype(float)
        cosine = unit @ v / max(np.linalg.norm(v), 1e-12)
        assert found[i].lang_pred == names[int(cosine.argmax())] and found[i].score == pytest.approx(max(0.0, cosine.max()), abs=1e-5)


def test_profiles_bundle_bound_letters(spark):
    p = langid.Params(letters=64, dimensions=128)
    space, letters = langid.Space(p), langid.Letters(p)
    codes = letters.codes("ab")
    bound = np.roll(space.places[2][codes[0]], 2) * np.roll(space.places[2][codes[1]], 1) * space.places[2][codes[2]]
    assert (space.vectors(letters.trigrams("ab"))[0] == bound).all()


# sharding


def test_sharding(spark, sf, odd, empty):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    for df in (docs_of(spark, sf), odd):
        rows = sharding.shard(df, size=size, shards=5).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
        per = defaultdict(list)
        for r in rows:
            per[r.shard].append(r.slot)
        assert max(map(len, per.values())) - min(len(per.get(s, [])) for s in range(5)) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shard(empty, size=size).count() == 0
    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1))) == list(range(50))


def test_rows_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were more buckets than Spark sends by itself
    try:
        df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
        plan = sharding.shard(df, size=F.lit(8), shards=4)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_id_spreads_over_all_shards(spark):
    df = spark.range(2400).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    n = sharding.shard(df, size=F.lit(8)).groupBy("shard").count().collect()
    assert {r["count"] for r in n} == {100} and len(n) == 24


# near-duplicates


def brute_components(docs, width, percent):
    sets = []
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        k = min(width, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def test_near_duplicates(spark, sf, odd, empty):
    for df, plan in ((docs_of(spark, sf), minhash.CONTRACT), (odd, minhash.CONTRACT)):
        found = minhash.near_duplicates(df, plan).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components([(r.doc_id, r.text) for r in df.collect()], plan.words, plan.percent)
    assert minhash.near_duplicates(empty).count() == 0


def test_chain_of_edits_is_one_component(spark):
    """Neighbours are linked, the ends are not similar: no star alone finds all links."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        words = words[:k] + [f"n{k}"] + words[k + 1 :]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(words=2)).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1
    assert minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(words=2)).count() == 1


def test_posterior_bounds_keep_the_threshold():
    plan = minhash.Plan()
    need = minhash.least_matches(plan)
    rng = np.random.default_rng(0)
    seen = (rng.random((20000, plan.compared)) < plan.percent / 100).cumsum(axis=1)[:, plan.batch - 1 :: plan.batch]
    assert (seen >= np.array(need)).all(axis=1).mean() > 0.9999


# pieces


def test_pieces_round_trip_and_best_score(spark, odd, empty):
    model = pieces.Pieces(PIECES)
    back = pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).count() == 0
    small = [(1, "▁", -1.0), (2, "a", -2.0), (3, "b", -2.0), (4, "ab", -2.5), (5, "▁a", -2.5), (6, "ba", -3.0), (7, "aba", -4.5)]
    toy = pieces.Pieces.of(small, {b: 100 + b for b in range(256)})
    scores = {p: s for _, p, s in small}
    name = {i: p for i, p, _ in small}
    for k, text in enumerate(map("".join, itertools.product("abx", repeat=6))):
        toy.window = (1 << 16, 1, 3)[k % 3]
        got = toy.viterbi(text)
        if "x" in text:  # no piece: its byte stands for it
            parts = text.split("x")
            assert got == [i for j, x in enumerate(parts) for i in ([100 + ord("x")] if j else []) + toy.viterbi(x)]
            continue
        best = max(sum(scores[c] for c in cut) for cut in all_cuts(text, scores))
        assert abs(sum(scores[name[i]] for i in got) - best) < 1e-9 and "".join(name[i] for i in got) == text
    assert model.decode(b"\xff\xff\xff\x7f") == "\ufffd" and model.decode(toy.byte_ids[0xFF].to_bytes(4, "little")) is not None
    for text in ("", " ", "a b", "  x▁y\n", "日本 語"):
        assert model.decode(model.encode(text)) == text


def test_a_new_word_takes_no_calls_for_each_character(spark, sf):
    model, calls = pieces.Pieces(PIECES), []
    texts = [r.text or "" for r in docs_of(spark, sf).select("text").collect()]
    words = list({c for t in texts for c in pieces.CHUNK.findall("▁" + t.replace(" ", "▁")) if model.single.issuperset(c)})[:5000]
    before = sys.getprofile()
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        found = [model.viterbi(c) for c in words]
    finally:
        sys.setprofile(before)
    assert len(calls) < 4 * len(words)  # 36 for each before
    model.window = 1  # from here on settled at each character
    assert all(model.viterbi(c) == x for c, x in zip(words, found, strict=True))


def all_cuts(text, scores):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in scores:
            for rest in all_cuts(text[k:], scores):
                yield [text[:k], *rest]


# search


def vectors_of(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (0, rows[3][1]), (402, None), (403, [float("nan")] * 8), (404, [None] * 8), (None, rows[1][1]), (405, [0.0] * 8), (450, [5.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def ranked(rows, queries, k):
    """query_id to its best (vec_id, score), by comparing all; ``rows`` and ``queries`` hold (id, vector)."""
    return {i: sorted(((float(x @ q), j) for j, x in rows if j != i), key=lambda t: (-t[0], t[1]))[:k] for i, q in queries}


def test_exact_top_k(spark):
    df = vectors_of(spark)
    rows = topk.usable(df, "vec_id", "embedding").select("vec_id", F.transform("x", lambda v: F.floor(v * 256)).alias("x"))
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    q = {}
    for r in queries.collect():  # the id 0 comes twice
        q[r.query_id] = min(q.get(r.query_id, r.q), r.q)
    want = ranked([(r.vec_id, np.array(r.x)) for r in rows.collect()], [(i, np.array(v)) for i, v in q.items()], 5)
    for p in (topk.Params(), topk.Params(pivots=3, rings=2, cell=50, block=2)):
        found = defaultdict(list)
        for r in topk.exact_top_k(rows, queries, p).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.score, r.vec_id))
        assert found == want
    assert topk.exact_top_k(rows.limit(0), queries).count() == 0
    assert topk.exact_top_k(rows.filter("vec_id = 50"), queries).count() <= len(q)


def test_one_bit_codes(spark):
    """Recall on made vectors, exact scores, ties by id though the copies lie in several cells, unequal widths."""
    rows = topk.usable(vectors_of(spark).filter("vec_id > 0"), "vec_id", "embedding").filter(F.exists("x", lambda v: v != 0))
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    found = defaultdict(list)
    for r in ann.nearest(rows, queries, ann.Params(cell=100, block=7)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    held = [(r.vec_id, np.array(r.x)) for r in rows.collect()]
    want = ranked(held, [(r.query_id, np.array(r.q)) for r in queries.collect()], 20)
    assert set(found) == set(want)
    assert np.mean([len({j for _, j in found[i]} & {j for _, j in want[i]}) / 20 for i in want]) >= 0.95
    assert all(s == ann.true_scores(np.array(dict(held)[j])[None], np.array(dict(held)[i]))[0] for i in want for s, j in found[i])
    assert ann.nearest(rows.limit(0), queries).count() == 0

    rng = np.random.default_rng(5)
    one = rng.normal(size=64)
    copies = [(i, one.tolist()) for i in range(60)] + [(i, rng.normal(size=40).tolist()) for i in range(60, 90)] + [(90, [1e-320] * 64), (91, [1e-160] * 3)]
    df = spark.createDataFrame(copies, "vec_id long, x array<double>").repartition(5)
    got = ann.nearest(df, df.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), ann.Params(cell=13)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 7] and len({r.score for r in got}) == 1


def test_equal_vectors_score_alike_in_blocks_of_any_size():
    rng = np.random.default_rng(6)
    q, one = rng.normal(size=64), rng.normal(size=64)
    assert len({s for n in range(1, 80) for s in ann.true_scores(np.tile(one, (n, 1)), q)}) == 1


def test_packed_estimates_are_the_rounded_inner_products():
    rng = np.random.default_rng(7)
    for width in (3, 64, 70):
        bits, turned = rng.random((50, width)) < 0.5, rng.normal(size=(4, width))
        planes, low, step = ann.planes(turned, 6)
        for k in range(4):
            rounded = low[k] + step[k] * np.rint((turned[k] - low[k]) / step[k])
            assert np.allclose(ann.estimates(ann.words_of(bits), width, planes[k], low[k], step[k]), (2.0 * bits - 1) @ rounded)


def test_recall_on_the_whole_table(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = ranked(list(rows.items()), [(i, x) for i, x in rows.items() if i % 20 == 0], 20)
    found = defaultdict(set)
    for r in ann.op7_ann(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(rows[r.vec_id] @ rows[r.query_id]), rel=1e-12)
    assert np.mean([len(found[i] & {j for _, j in v}) / len(v) for i, v in want.items()]) >= 0.9


# toxicity


def test_toxicity(spark, sf, odd, empty):
    rng = np.random.default_rng(2)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta"]
    rows, marks = [], []
    for i in range(600):
        body = list(rng.choice(words, 30))
        if i % 3 == 0:
            body[int(rng.integers(30))] = "zuckerfluch"
        rows.append((i, " ".join(body)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.97
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.toxicity <= 1 for r in scores)
    assert toxicity.score(empty, model).count() == 0


# secrets


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, sf, odd, empty):
    texts = {r.doc_id: r.text for r in docs_of(spark, sf).collect()}
    for r in secrets.op9_secret_scan(spark, sf).collect():
        spans = base_spans(texts[r.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    assert secrets.find_secrets(odd).count() == odd.count()
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    got = {r.text for r in secrets.redact(odd).filter("doc_id = 1").collect()}
    assert got == {"Hello world, token = '<secret>'"}


def test_copied_examples_are_not_live(spark):
    rows = [(i, "x PASSWORD: hunter2hunter2 y", f"s{i}") for i in range(5)] + [(9, 'api_key="q8Zt5kLw0pXv" password=token:abcdefg', "s1")]
    found = {r.doc_id: r.found for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {s.verdict for s in found[0]} == {"example"} and [s.verdict for s in found[9]] == ["live"]


# lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance_and_segment_keys(t):
    rng = np.random.default_rng(t)
    left, right = [], []
    for _ in range(600):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 16)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abc"), rng.integers(0, 2)))
        left.append(a)
        right.append("".join(b))
    want = [edit(a, b) <= t for a, b in zip(left, right, strict=True)]
    assert list(lines.within(left, right, t)) == want
    assert [bool(x) for k in range(0, 600, 20) for x in lines.within(left[k : k + 20], right[k : k + 20], t)] == want
    for a, b, near in zip(left, right, want, strict=True):
        if near and min(len(a), len(b)) > t:
            x, y = sorted((a, b), key=len)
            own = {k for k, o in lines.keys(x, t) if o}
            assert own & {k for k, _ in lines.keys(y, t)}


def test_keys_of_many_lines_are_those_of_each():
    rng = np.random.default_rng(4)
    many = ["".join(rng.choice(list("ab é🙂"), rng.integers(0, 40))) for _ in range(60)]
    key, at, own = lines.merged(*lines.all_keys(many, 2))
    for k, x in enumerate(many):
        assert list(zip(key[at == k].tolist(), own[at == k].tolist(), strict=True)) == lines.keys(x, 2)
        if len(x) > 8:
            assert sum(own[at == k]) == 3
    assert lines.all_keys([], 2)[0].size == 0 and [x for part in lines.by_chars(many, 50) for x in part] == many


def test_line_dedup(spark, odd, empty):
    a, b, c = "the first of the lines is long", "the first of tho lines is longer", "an entirely different line here"
    rows = [(2, f"{a}\n{c}"), (1, f"{b}\nshort"), (3, f"{c}\n{a}x\nshort"), (4, None)]
    found = {r.doc_id: (r.text, r.removed_lines) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert edit(a, b) > 2 and edit(a + "x", a) == 1
    assert found == {1: (f"{b}\nshort", []), 2: (f"{a}\n{c}", []), 3: ("", [0, 1, 2]), 4: (None, [])}
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "removed_lines"] and got.count() == odd.count()
    assert lines.dedup_lines(empty).count() == 0


def brute_lines(rows, p):
    """Which line numbers go, by comparing all pairs of lines."""
    seen = sorted(((i is None, i or 0, r, k), x.strip()) for r, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x.strip())
    root = list(range(len(seen)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(seen)), 2):
        x, y = seen[a][1], seen[b][1]
        most = min(p.distance, min(len(x), len(y)) // p.per_edit)
        if x == y or (abs(len(x) - len(y)) <= most and edit(x, y) <= most):
            root[max(find(a), find(b))] = min(find(a), find(b))
    gone = defaultdict(list)
    for k, ((_, _, r, no), _) in enumerate(seen):
        if find(k) != k:
            gone[r].append(no)
    return {(rows[r][0], rows[r][1]): sorted(gone[r]) for r in range(len(rows))}


@pytest.mark.parametrize("cell", [1 << 21, 2000])
def test_line_dedup_over_a_table_against_all_pairs(spark, cell):
    """One hot segment that most lines share, chains of edits, and copies."""
    rng = np.random.default_rng(9)
    tail, heads = "the same ending of all lines", ["".join(rng.choice(list("abcdefgh"), 10)) for _ in range(12)]
    lines_ = []
    for h in heads:
        x = list(h)
        for _ in range(6):
            x[int(rng.integers(10))] = str(rng.choice(list("abcdefgh")))
            lines_.append("".join(x) + tail)
    rows = [(i, "\n".join(rng.choice(lines_, 3)) + "\nshort") for i in range(60)]
    p = lines.Params(cell=cell)
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), p).collect()}
    for (i, t), out in brute_lines(rows, p).items():
        assert got[i].removed_lines == out
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)


@pytest.mark.parametrize("cell", [1 << 21, 3000])
def test_short_lines_against_all_pairs(spark, cell):
    """Lines of 0 to 24 characters: equal ones, and those whose length allows an edit or two."""
    rng = np.random.default_rng(12)
    stock = ["".join(rng.choice(list("ab "), int(n))) for n in range(25) for _ in range(3)]
    for x in list(stock):
        y = list(x)
        for k in rng.integers(0, max(1, len(y)), int(rng.integers(0, 3))):
            y[k : k + int(rng.integers(0, 2))] = rng.choice(list("ab"), int(rng.integers(0, 2)))
        stock.append("".join(y))
    rows = [(i, "\n".join(rng.choice(stock, 6))) for i in range(40)]
    p = lines.Params(cell=cell)
    got = {r.doc_id: r.removed_lines for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), p).collect()}
    assert got == {i: out for (i, _), out in brute_lines(rows, p).items()}


def test_near_copies_and_chains_in_split_cells(spark):
    rng = np.random.default_rng(3)
    words, rows = [f"w{k}" for k in range(60)], []
    for i in range(150):
        x = list(words)
        for k in rng.integers(0, 60, int(rng.integers(0, 7))):
            x[k] = f"m{int(rng.integers(500))}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for plan in (minhash.Plan(words=2), minhash.Plan(words=2, cell=6000), minhash.Plan(words=2, star=4, most_parts=3)):
        found = minhash.near_duplicates(df, plan).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 2, 80)


def test_components_with_split_hubs(spark, monkeypatch):
    """A hub of half of all edges, a chain, and random edges; the hub is salted, nothing else changes."""
    rng = np.random.default_rng(5)
    edges = [(0, k) for k in range(3, 900, 3)] + [(1000 + k, 1001 + k) for k in range(80)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2)) if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame(edges, "u long, v long")
    for wide in (1 << 20, 1):
        monkeypatch.setattr(components, "WIDE", wide)
        assert {tuple(r) for r in components.components(df).collect()} == expected


def test_a_forest_joins_what_all_pairs_join():
    class Near:
        def __init__(self, x):
            self.x = x

        def likely(self, i, others):
            return others[np.argsort(np.abs(self.x[others] - self.x[i]), kind="stable")]

        def linked(self, a, b):
            return np.abs(self.x[a] - self.x[b]) <= 1

    from granary.llm.blocks import forest

    rng = np.random.default_rng(7)
    for n in (1, 2, 40, 700):
        x, root = rng.integers(0, 3 * n, n), rng.integers(0, max(n // 3, 1), n)

        def named(pairs):
            up = list(range(n))

            def find(k):
                while up[k] != k:
                    k = up[k]
                return k

            for a, b in pairs:
                up[max(find(a), find(b))] = min(find(a), find(b))
            return [find(k) for k in range(n)]

        same = [(a, b) for a in range(n) for b in range(a) if root[a] == root[b]]
        a, b = forest(Near(x), root, np.zeros(n, int))
        assert len(a) < n or n == 1
        assert named(same + list(zip(a, b, strict=True))) == named(same + [(i, j) for i in range(n) for j in range(i) if abs(x[i] - x[j]) <= 1])


def test_ownership_counts_over_the_corpus(spark, odd):
    """Owners and repositories of each value by plain sets, on odd rows too; every value hot."""
    rows = [(100 + i, f"token = {'abcdef' * 2}{i % 7}Zq9" + " x " * (i % 3), f"s{i % 5}" if i % 6 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd.select("doc_id", "text", "source"))
    held = defaultdict(lambda: (set(), set()))
    for r in df.collect():
        for _, _, _, v in secrets.candidates(r.text or ""):
            held[v][0].add(r.source or "")
            held[v][1].add(str(r.doc_id) if r.doc_id is not None else "")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in secrets.find_secrets(df).collect():
        for s in r.found:
            value = {(a, k, b): v for a, k, b, v in secrets.candidates(texts[r.doc_id] or "")}[(s.start, s.kind_no, s.end)]
            assert (s.owners, s.repos) == tuple(map(len, held[value]))


def test_own_names_in_the_input_do_not_clash(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "a", 1, "b", "c"), (2, "alpha beta gamma delta epsilon zeta", "a", 2, None, "c"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, __id int, __text string, __spans string")
    assert {r.doc_id for r in minhash.keep_one(df).collect()} == {1, 3} and minhash.keep_one(df).columns == df.columns
    assert secrets.redact(df.withColumn("source", F.lit("s"))).columns == [*df.columns, "source"]
    assert sharding.shard(df.withColumn("__at", F.lit(1)), size=F.lit(8), shards=2).columns == [*df.columns, "__at", "shard", "slot"]
    assert {(r.doc_id, r.text, r["__row"]) for r in lines.dedup_lines(df).collect()} == {(1, rows[0][1], "a"), (2, "", "a"), (3, None, None)}
