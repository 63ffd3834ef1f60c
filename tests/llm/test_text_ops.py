"""Operators on texts: encoding, classifiers, languages, leaks, near-copies, repeats; each with odd rows."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkdom.llm import bpe, components, decontaminate, jaccard, ppm, quality, simhash, suffix_dedup, toxicity  # noqa: E402
from sparkdom.llm.common import fold  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: nulls, empty and blank texts, repeats, a very long text.
ODD = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "x", "en", "a", 1), (4, "x", "en", "a", 1), (5, "word " * 60_000, "en", "a", 300_000), (None, "y z", "en", "a", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns, one of them with a name that operators use inside
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("y", F.lit(9)).withColumns({c: F.lit(c) for c in ("_n", "_id", "_hash", "_T1", "_t2", "_blob", "spans", "blob", "t1", "root", "id", "bits")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


# --- byte-pair encoding


def test_bpe_is_the_library(spark, vocabulary, odd, none):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary)
    theirs.no_padding()
    theirs.no_truncation()
    ours = bpe.BacktrackingBPE(json.load(open(vocabulary)))
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC'.,<|>ΣİéßǅÅ 0123½́ \x1c\x85\n日本🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "don't we'll 'tis", "a" * 500, "ΑΣ ΣΑΣ", "<|endoftext|", " ", ""]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(ours.encode(t), "<u4")
        assert got.tolist() == want, t
        assert b"".join(ours.decode(got)).decode() == theirs.decode(want, skip_special_tokens=False)
    rows = bpe.encode_decode(odd, vocabulary, with_ids=True, with_text=True).collect()
    assert len(rows) == len(ODD)
    for r, (i, t, *_) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(ODD, key=lambda d: (d[0] is None, d[0] or 0, len(d[1] or ""))), strict=True):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == theirs.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(none, vocabulary).count() == 0


# --- classifiers and languages


def labelled_docs(spark, n=400):
    rng = random.Random(2)
    words = "the of and to in river stone walk green light under over many".split()
    docs, labels = [], []
    for i in range(n):
        junk, rude = i % 5 == 0, i % 4 == 1
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if rude:
            w[rng.randrange(len(w))] = w[0] = rng.choice(["scoundrel", "rascal"])
        text = " ".join(x.upper() + "$$$" for x in w) if junk else " ".join(w) + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if junk else 1, int(rude)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, none):
    docs, labels = labelled_docs(spark)
    held = fold("doc_id", 5) == 0
    got = quality.classify(docs, labels, ~held).withColumn("held", held).join(labels, "doc_id").where("held").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    rows = quality.classify(odd, labels, F.lit(True)).collect()  # none of the labelled keys but 1 to 5
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.classify(odd, labels.where("false"), F.lit(True)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, None), (2, None, None), (3, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, nulls, F.lit(True)).count() == len(ODD)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((len(quality.STATS), quality.BINS - 1)))
    m.w = rng.normal(size=m.w.shape).astype(np.float32)
    m.v = rng.normal(size=m.v.shape).astype(np.float32)
    ids, x = np.array([3, 700, 9000]), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(m.v[ids[i]] @ m.v[ids[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(ids, x) == pytest.approx(m.w0 + float(m.w[ids] @ x) + pairs, rel=1e-4)


def test_toxicity(spark, odd, none):
    docs, labels = labelled_docs(spark)
    held = fold("doc_id", 3) == 1
    got = toxicity.classify(docs, labels, ~held).withColumn("held", held).join(labels, "doc_id").where("held").collect()
    assert len(got) > 40 and all(r.predicted == r.toxic for r in got if r.quality)
    left = toxicity.reject_toxic(docs, labels, ~held)
    assert left.columns == docs.columns and left.count() == sum(1 for r in toxicity.classify(docs, labels, ~held).collect() if not r.predicted)
    assert toxicity.classify(odd, labels, F.lit(True)).count() == len(ODD)
    assert toxicity.classify(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.classify(odd, labels.where("toxic = 0"), F.lit(True)).collect()} == {0.0}


def test_counterfactual_penalty(spark):
    """Group terms that happen to go with toxic labels lose their weight, and neutral mentions their score."""
    rng = random.Random(3)
    words = "the of and to in river stone walk green light".split()
    rows = []
    for i in range(600):
        rude = i % 3 == 0
        w = [rng.choice(words) for _ in range(12)]
        if rude:
            w[3] = "rascal" if rng.random() < 0.7 else w[3]
            w[5] = rng.choice(["muslim", "christian", "jewish"]) if rng.random() < 0.9 else w[5]
        rows.append((i, " ".join(w), int(rude)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    plain, fair = toxicity.train(sample, fairness=0.0), toxicity.train(sample, fairness=20.0)
    gap = lambda m, t: abs(m.raw(t) - m.raw(t.replace("muslim", "christian")))
    neutral = "a muslim woman walks by the river"
    one = spark.createDataFrame([(i, f"{'muslim' if y else 'christian'} {'walk' if i % 2 else 'stone'} light", y) for i in range(200) for y in [i % 4 < 2]], "doc_id long, text string, y boolean").selectExpr("doc_id", "text", "int(y) y")
    skewed, even = toxicity.train(one, fairness=0.0), toxicity.train(one, fairness=50.0)
    assert gap(even, neutral) < 0.25 * gap(skewed, neutral)
    assert fair.raw("you rascal") > fair.raw("you river")
    sentences = ["the river walk", "a stone to light", "in the green"]
    before, after = (max(g for _, g, _ in toxicity.gaps(m, sentences, (("muslim", "christian", "jewish"),))) for m in (plain, fair))
    assert before > 0.2 > 4 * after


def brute_objective(texts, y, pairs, b, w, l1, fairness):
    """Text by text, from the words alone."""
    raw = lambda words: sum(w.get(f, 0.0) for x in words for f in toxicity.of_word(x))
    loss = sum(np.log1p(np.exp(z)) - t * z for text, t in zip(texts, y, strict=True) for z in [b + raw(toxicity.words_of(text))])
    change = sum((raw(after) - raw(before)) ** 2 for before, after in pairs)
    return loss / len(texts) + fairness * change / max(len(pairs), 1) + l1 * sum(map(abs, w.values()))


@pytest.mark.parametrize("fairness", [0.0, 5.0])
def test_toxicity_objective(fairness):
    """What is fitted is the least of the objective as its definition reads."""
    rng = random.Random(5)
    pool = ["stone", "walk", "green", "rascal", "muslim", "christian", "women", "men"]
    texts = [". ".join(" ".join(rng.choices(pool, k=4)) for _ in range(2)) for _ in range(120)]
    y = np.array([float(("rascal" in t or "muslim" in t) and rng.random() < 0.9) for t in texts])
    pairs = [p for t in texts for p in toxicity.counterfactuals(t)]
    got = [toxicity.counts(toxicity.words_of(t)) for t in texts]
    moved = [toxicity.change(*p) for p in pairs]
    chosen = np.unique(np.concatenate([g[0] for g in got] + [m[0] for m in moved]))
    b, w = toxicity.fit(toxicity.Rows([g[0] for g in got], [g[1] for g in got], chosen), y, toxicity.Rows([m[0] for m in moved], [m[1] for m in moved], chosen), l1=0.01, fairness=fairness)
    at = lambda b, w: brute_objective(texts, y, pairs, b, dict(zip(chosen.tolist(), w.tolist(), strict=True)), 0.01, fairness)
    least = at(b, w)
    for k in range(-1, len(chosen)):
        for d in (-0.02, 0.02):
            other = w.copy()
            if k >= 0:
                other[k] += d
            assert at(b + d * (k < 0), other) >= least - 1e-6
    words = dict(zip(chosen.tolist(), w.tolist(), strict=True))
    weight = lambda x: sum(words.get(f, 0.0) for f in toxicity.of_word(x))
    assert (abs(weight("muslim") - weight("christian")) < 0.05) == (fairness > 0)


def test_counterfactuals_are_sentences():
    pairs = toxicity.counterfactuals("The gay man walks. Green stone! A river")
    assert ({"the", "gay", "man", "walks"}, {"the", "lesbian", toxicity.swaps()["man"], "walks"}) in pairs
    plain = [p for p in pairs if p[0] in ({"green", "stone"}, {"a", "river"})]
    assert len(plain) == 2 and all(len(b - a) == 1 and (b - a) <= toxicity.swaps().keys() for a, b in plain)
    assert len(pairs) == 5 and toxicity.counterfactuals("") == []


def test_ppm(spark, odd, none):
    rng = random.Random(4)
    kinds = {"aa": ["the", "of", "with", "river"], "bb": ["der", "und", "über", "fluß"], "cc": ["el", "ñandú", "río", "que"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k, "s", 0) for i in range(240) for k in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    held = fold("doc_id", 4) == 2
    got = ppm.identify(docs, ~held).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert got and all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in got)
    rows = ppm.identify(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in ppm.identify(odd, F.lit(False)).collect()} == {"und"}
    assert ppm.identify(none, F.lit(True)).count() == 0


def plain_ppm(text: bytes):
    """A walk down the orders, from what was seen after each context."""
    seen = defaultdict(lambda: defaultdict(int))
    padded = ppm.START + text
    for k in range(3, len(padded)):
        for order in range(4):
            seen[padded[k - order : k]][padded[k]] += 1

    def prob(history: bytes, c: int) -> float:
        excluded, p = set(), 1.0
        for order in (3, 2, 1, 0):
            here = {s: n for s, n in seen.get(history[3 - order :], {}).items() if s not in excluded}
            if not here:
                continue
            total, kinds = sum(here.values()), len(here)
            if c in here:
                return p * here[c] / (total + kinds)
            p *= kinds / (total + kinds)
            excluded |= here.keys()
        return p / (256 - len(excluded))

    return prob


def tree_of(text: bytes) -> ppm.FrozenTree:
    grams, counts = np.unique(ppm._grams(text), return_counts=True)
    return ppm.FrozenTree(grams, counts)


def test_ppm_probabilities(monkeypatch):
    """Every context's probabilities sum to one over all bytes; code lengths match a plain walk, whole and in parts."""
    text = b"abracadabra abracadabra banana"
    tree, plain = tree_of(text), plain_ppm(text)
    for history in (b"abr", b"xbr", b"xyr", b"xyz", b"\n\n\n"):
        grams = np.array([int.from_bytes(history + bytes([c]), "big") for c in range(256)], np.uint32)
        assert np.exp2(-tree.cost(grams)).sum() == pytest.approx(1)
    want = lambda p: sum(-np.log2(plain((ppm.START + p)[k : k + 3], p[k])) for k in range(len(p)))
    probes = [b"abracadabra", b"", b"banana!", b"zz", b"a", bytes(range(256)), b"abra\xff" * 9]
    for size in (4 << 20, 5):
        monkeypatch.setattr(ppm, "SLICE", size)
        got = ppm.code_lengths([tree, tree_of(b"")], probes)
        assert got[:, 0] == pytest.approx([want(p) for p in probes])
        assert got[:, 1] == pytest.approx([8 * len(p) for p in probes])


def test_many_languages(spark):
    """200 made-up languages, in one group and in many: the same predictions, equal to a plain walk."""
    rng = random.Random(9)
    text = lambda k: " ".join("".join(rng.choices("aeiou", k=2) + rng.choices("bcdfghjklmnpqrstvwxyz"[k % 17 :][:5], k=2) + [chr(200 + k)]) for _ in range(30))
    docs = [(i, text(i % 200), f"l{i % 200:03}", None, None) for i in range(800)]
    df = spark.createDataFrame(docs, DOCS)
    whole = sorted(map(tuple, ppm.identify(df, F.col("doc_id") < 600).collect()))
    parts = sorted(map(tuple, ppm.identify(df, F.col("doc_id") < 600, group_bytes=400_000).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in parts] and [r[2] for r in whole] == pytest.approx([r[2] for r in parts])
    assert np.mean([r[1] == f"l{r[0] % 200:03}" for r in whole if r[0] >= 600]) > 0.98
    trained = {k: b"".join(t.encode() for _, t, n, *_ in docs[:600] if n == f"l{k:03}") for k in (3, 150)}
    probe = docs[700][1].encode()
    for raw in trained.values():
        plain = plain_ppm(raw)
        assert ppm.code_lengths([tree_of(raw)], [probe])[0, 0] == pytest.approx(sum(-np.log2(plain((ppm.START + probe)[k : k + 3], probe[k])) for k in range(len(probe))))


# --- leaks


def brute_leak(item: list[str], text: list[str], k: int) -> bool:
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row) <= k


def test_leaks_against_brute_force(spark, odd, none):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(pool, k=n))) for i, n in enumerate([1, 2, 3, 5, 8, 15, 20, 30, 40, 55])] + [(90, None), (91, "..."), (None, "null key item words here now")]
    docs = []
    for d in range(150):
        words = rng.choices(pool, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            out = rng.choice(items[3:10])[1].split()
            for _ in range(rng.randint(0, int(0.25 * len(out)))):
                at = rng.randrange(len(out))
                out[at : at + rng.randint(0, 1)] = [rng.choice(pool)] * rng.randint(0, 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = out
        docs.append((d, " ".join(words).title() if d % 2 else "\n".join(words), None, None, None))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    want = set()
    for i, t in items:
        words = decontaminate.words_of(t)
        if words:
            want |= {(d, i) for d, text, *_ in docs if brute_leak(words, decontaminate.words_of(text), decontaminate.edits(len(words), 0.8))}
    assert got <= want and len(got) >= 0.97 * len(want) > 100
    for r in found.where("item_id = 8").collect():
        text = decontaminate.words_of(docs[r.doc_id][1])[r.first_word : r.end_word]
        assert brute_leak(decontaminate.words_of(items[8][1]), text, r.distance)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.where("false")).count() == 0
    kept = decontaminate.drop_leaks(spark.createDataFrame(docs, DOCS), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in got}


def edited(words, k, pool, rng):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [rng.choice(pool)] * rng.randint(0, 1)
    return out


@pytest.mark.parametrize("most", [96, 0])
def test_leaks_of_long_items(monkeypatch, most):
    """Many lengths and one very long item: little memory, all planted edits found; without tables too."""
    monkeypatch.setattr(decontaminate, "MOST_TABLES", most)
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(2000)]
    items = [(n, " ".join(rng.choices(pool, k=n))) for n in (*range(10, 300, 9), 20_000)]
    detector = decontaminate.Detector(items)
    assert sum(x.nbytes for t in detector.tables.values() for x in t) < 1 << 20
    assert not detector.walks if not most else set(detector.lengths) - detector.walks.keys() == {20_000}
    texts = [" ".join(rng.choices(pool, k=40) + edited(t.split(), decontaminate.edits(n, 0.8), pool, rng) + rng.choices(pool, k=40)) for n, t in items]
    found = [{detector.items[m[0]] for m in got} for got in detector.scan([*texts, " ".join(rng.choices(pool, k=5000))])]
    assert not found.pop()
    hits = sum(n in f for (n, _), f in zip(items, found, strict=True))
    assert hits >= 0.96 * len(items) if most else hits == len(items)
    for got, text in zip(detector.scan(texts[:6]), texts, strict=False):
        for item, distance, first, end in got:
            assert brute_leak(decontaminate.words_of(dict(items)[detector.items[item]]), text.split()[first:end], distance)


def test_similarity_has_a_floor():
    with pytest.raises(ValueError, match="similarity"):
        decontaminate.Detector([(1, "a b c")], 0.5)


# --- near-copies


def near_pairs(texts):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(500)]
    out = []
    for _ in range(texts):
        base = rng.choices(words, k=rng.randint(1, 150))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    return [(i, " ".join(w).upper() if i % 3 else "\t".join(w), None, None, None) for i, w in enumerate(out)]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, odd, none):
    docs = near_pairs(60) + [(900, None, None, None, None), (901, "", None, None, None), (None, docs_text := "a b", None, None, None), (902, docs_text, None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in docs]
    up = list(range(len(docs)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    want = sorted((str(docs[i][0]), f"{fps[i]:016x}", min(x for x in groups[find(i)] if x is not None)) for i in range(len(docs)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == ["1", "4", "5", "None"]


def test_links_of_large_groups(monkeypatch):
    """A group beyond the size for direct comparison gives the same components."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([centre, *(centre ^ (np.uint64(1) << np.uint64(b)) for b in (1, 9, 33, 60))]))

    def parts(limit):
        monkeypatch.setattr(simhash, "GROUP", limit)
        forest = components.Forest()
        for u, v in zip(*simhash.group_links(fps, 4), strict=True):
            forest.join(u, v)
        return [forest.find(int(f)) for f in fps]

    assert parts(10_000) == parts(2)


def test_variants_cover():
    rng = random.Random(9)
    cuts = simhash.segments(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(((a ^ b) >> low & ((1 << n) - 1)).bit_count() <= 1 for low, n in cuts)


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 300)]
    edges = [(u, v) for u, v in edges if u != v]
    forest = components.Forest()
    for u, v in edges:
        forest.join(u, v)
    got = {r.node: r.root for r in components.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: forest.find(n) for n in forest.up}
    assert components.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


# --- repeated passages


def brute_spans(texts, width):
    """For each text a byte array, with 1 for what goes."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for t in raw:
        for s in range(len(t) - width + 1):
            seen[t[s : s + width]] += 1
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        yield gone


def brute_repeats(texts, width):
    for t, gone in zip([(t or "").encode() for t in texts], brute_spans(texts, width), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def repeating_texts(seed, width):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdéß", k=rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(width // 8, width))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randint(1, len(p))])
        texts.append(rng.choice(["", " "]).join(parts))
    return texts + texts[:3] + ["ab" * 300, "xyz" * 100, "q" * (width - 1), "q" * width, "r" * (width + 1), None, ""]


@pytest.mark.parametrize(("seed", "width"), [(1, 200), (2, 200), (3, 75)])
def test_repeats_against_brute_force(spark, seed, width):
    texts = repeating_texts(seed, width)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove(docs, width=width).collect()}
    want = dict(enumerate(brute_repeats(texts, width)))
    assert got == want and sum(w[1] for w in want.values()) > 0
    plain = suffix_dedup.remove(docs, width=width, every_suffix=True)
    assert {r.doc_id: tuple(r)[1:] for r in plain.collect()} == want


def test_long_texts_in_parts(spark, monkeypatch):
    """A text beyond one buffer is hashed in overlapping parts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "_state", {})
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdef ", k=700))
    long = "".join(rng.choices("uvwxyz ", k=9000)) + passage + "".join(rng.choices("uvwxyz ", k=3000))
    starts = []
    for buf, begins, ends, number, base in suffix_dedup.pieces([long.encode(), passage.encode()], 200):
        for text, place, first, last, *_ in zip(*suffix_dedup.anchors(buf, begins, ends, 200, suffix_dedup.GRAM), strict=True):
            starts += [(int(number[text]), int(base[text] + w - begins[text])) for w in range(first, last + 1)]
    assert set(starts) == {(0, s) for s in range(len(long) - 199)} | {(1, s) for s in range(501)}


def test_repeats_odd(spark, odd, none):
    rows = suffix_dedup.remove(odd).collect()
    assert len(rows) == len(ODD)
    assert [tuple(r)[1:4] for r in rows if r.doc_id == 5] == [(300_000, 300_000, 1)]
    assert suffix_dedup.remove(none).count() == 0
    left = suffix_dedup.remove(odd, keep_text=True)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert [r.text for r in left.where("doc_id in (1, 4)").orderBy("doc_id").collect()] == [None, "x", "x"]


@pytest.mark.parametrize("chunk", [1 << 22, 600, 150])
def test_jaccard_near_copies(spark, odd, none, small, monkeypatch, chunk):
    """Pairs of 5-word Jaccard similarity 0.8 or more are linked, however far apart their SimHashes and in however many chunks; others are not."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "CHUNK", chunk)

    rng = random.Random(8)
    rows, sets = [], {}
    for base in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        for copy in range(12):
            v = list(w)
            for _ in range(copy * len(w) // 200):
                v[rng.randrange(len(v))] = f"x{rng.randrange(5000)}"
            rows.append((100 + len(rows), " ".join(v), "en", "s", 0))
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if r in (a, b) else r for k, r in up.items()}
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect())
    assert kept == sorted(set(up.values())) and 12 < len(kept) < len(rows)
    left = corpus_pipeline.drop_near_copies(spark, odd, small)
    assert left.columns == odd.columns
    # null and wordless texts are one group, and no key comes before any
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "5", "None"]
    assert corpus_pipeline.drop_near_copies(spark, none, small).count() == 0


def test_near_copies_come_through_simhash(spark, small, monkeypatch):
    """Without a key of MinHash, SimHashes within 4 bits still bring candidates, and the exact check drops those below 0.8."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "keys", lambda found, mixers: [])
    rng = random.Random(12)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []

    def cut(text):
        w = text.split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    def bits(text):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut(text)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for _ in range(20):
        base = draw(150)
        for changes in (0, 1, 1, 2):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = draw(1)[0]
            texts.append(" ".join(w))
    lookalikes = 0
    while lookalikes < 2:  # within 4 bits and below 0.8
        a = draw(44)
        b = a + draw(12)
        if (bits(" ".join(a)) ^ bits(" ".join(b))).bit_count() <= 4:
            texts += [" ".join(a), " ".join(b)]
            lookalikes += 1
    sets, prints = [cut(t) for t in texts], [bits(t) for t in texts]

    def joined(pairs):
        first = list(range(len(texts)))
        for i, j in pairs:
            a, b = sorted((first[i], first[j]))
            first = [a if f == b else f for f in first]
        return first

    every = [(i, j) for j in range(len(texts)) for i in range(j)]
    cluster = joined((i, j) for i, j in every if (prints[i] ^ prints[j]).bit_count() <= 4)
    first = joined((i, j) for i, j in every if cluster[i] == cluster[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert len(set(cluster)) < len(set(first)) < len(texts) - 10
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()) == sorted(set(first))


# --- pipeline


def brute_groups(texts):
    """For each text the place of the first that a chain of 5-word Jaccard similarities of 0.8 or more links it to."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {b" ".join(w)} if w else set())
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    return first


def test_pipeline_against_brute_force(spark, small, vocabulary):
    """Every stage done the plain way on all of a small table."""
    import corpus_pipeline
    import tokenizers

    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect())
    model = toxicity.learn(read("documents"), read("labels"), fold("doc_id", 3) != 1)
    docs = [(i, t) for i, t in docs if 1 / (1 + np.exp(-model.bias - sum(model.weights.get(f, 0.0) for w in toxicity.words_of(t or "") for f in toxicity.of_word(w)))) < 0.7]
    first = brute_groups([t for _, t in docs])
    docs = [d for k, d in enumerate(docs) if first[k] == k]
    kept = []
    gone = brute_spans([t for _, t in docs], 200)
    for (i, t), cut in zip(docs, gone, strict=True):
        kept.append((i, bytes(c for c, g in zip((t or "").encode(), cut, strict=True) if not g).decode("utf-8", "ignore")))
    items = [words for r in read("benchmark").collect() if (words := decontaminate.words_of(r.text))]
    pairs = [set(zip(w, w[1:], strict=False)) for w in items]
    clean = []
    for i, t in kept:
        words = decontaminate.words_of(t)
        here = set(zip(words, words[1:], strict=False))
        # an item that leaks keeps a pair of its words at least
        if not any(brute_leak(w, words, decontaminate.edits(len(w), 0.8)) for w, p in zip(items, pairs, strict=True) if p & here):
            clean.append((i, t))
    library = tokenizers.Tokenizer.from_file(str(vocabulary))
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want) > 50
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
