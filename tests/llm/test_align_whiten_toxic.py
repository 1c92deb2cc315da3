"""Token alignment, whitening and toxicity against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import token_align, toxicity, whitening

from .test_llm import CLASHING, SCHEMA, corpus


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus() + [(900, "▁literal marker", None, None, 1), (901, "<|endoftext|> plain", None, None, 1),
                       (902, "x" * 5000 + " 漢字かな交じり文 ١٢٣\r\n\t tab", None, None, 1), (903, " lead", None, None, 1),
                       (904, "</s><s><unk> \x1c\x85\xa0 end ", None, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


# --- token alignment -----------------------------------------------------------

def plain_groups(a, b, text):
    """(A ids, B ids) of each group, cut at the ends common to both."""
    ids_a = a.whole.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.sp.encode(text) if text else []
    whole = (" " + text).encode()
    if not text or b"".join(a.table[i] for i in ids_a) != whole or b"".join(b.table[i] for i in ids_b) != whole:
        return []
    ends = [np.cumsum([len(t.table[i]) for i in ids]).tolist() for t, ids in ((a, ids_a), (b, ids_b))]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for high in common:
        groups.append(tuple([(i, e - len(t.table[i]), e) for i, e in zip(ids, end, strict=True) if low < e <= high]
                            for t, ids, end in ((a, ids_a, ends[0]), (b, ids_b, ends[1]))))
        low = high
    return groups


def test_alignment_equals_brute_force(docs):
    a, b, _, _ = token_align._loaded(None, None)
    rows = docs.select("doc_id", "text").collect()
    found, links = [], []
    for r in rows:
        groups = plain_groups(a, b, r.text or "")
        found.append(groups)
        links.append([(i, j) for ga, gb in groups for i, s, e in ga for j, t, f in gb if max(s, t) < min(e, f)])
    counts = Counter(x for doc in links for x in doc)
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    expected = Counter()
    for r, groups, doc in zip(rows, found, links, strict=True):
        text = ";".join(",".join(str(i) for i, *_ in ga) + "|" + ",".join(str(j) for j, *_ in gb) for ga, gb in groups)
        expected[(r.doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(doc),
                  sum(counts[x] == best[x[1]] for x in doc), sum(counts[x] for x in doc), sha(text) if groups else "")] += 1
    got = Counter(map(tuple, token_align.q_alignment(docs).collect()))
    assert got == expected
    assert sum(n for (_, n_a, *_), n in got.items() if n_a == 0) >= 4


def test_alignment_beyond_the_broadcast_bound(docs, monkeypatch):
    one = Counter(map(tuple, token_align.q_alignment(docs).collect()))
    monkeypatch.setattr(token_align, "PAIRS_BROADCAST", 0)
    assert one == Counter(map(tuple, token_align.q_alignment(docs).collect()))


def test_both_byte_encoders_agree():
    a, _, _, _ = token_align._loaded(None, None)
    assert a.fast is not None
    rng = random.Random(5)
    marks = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'!?-_09aZé ß½²ªµ×ÿ"
    for _ in range(300):
        text = "".join(rng.choice(marks + "abc" * 5 + "  ") for _ in range(rng.randint(1, 60)))
        assert token_align.is_latin(text) and a.encode(text).tolist() == a.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_words_take_no_longer():
    a, b, _, _ = token_align._loaded(None, None)
    for text in ("a" * 200_000, "ab" * 100_000, "Ωx" * 20_000):
        assert b"".join(a.table[i] for i in a.encode(text)) == text.encode()


def test_walk_on_random_ends():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 60)
        cuts = [sorted({n, *(rng.randint(1, n) for _ in range(rng.choice([0, 3, n])))}) for _ in range(2)]
        if rng.random() < 0.4:
            cuts[1] = sorted({*cuts[0], rng.randint(1, n)})
        ends_a, ends_b, at_a, at_b = token_align.walk(*cuts)
        common = sorted(set(cuts[0]) & set(cuts[1]))
        assert [cuts[0][k - 1] for k in ends_a] == common == [cuts[1][k - 1] for k in ends_b]
        spans = [list(zip([0, *c], c, strict=False)) for c in cuts]
        assert sorted(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [
            (i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]


def test_alignment_shapes(spark, docs):
    extra = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in (*CLASHING, "links", "pair", "n_best")])
    rows = token_align.link_scores(extra).collect()
    assert len(rows) == docs.count() and all(r["_row"] == 7 and r["_rid"] == 7 and r["pair"] == 7 for r in rows)
    out = token_align.align(extra).collect()
    assert all(len(r.ends_a) == len(r.ends_b) and r["_t"] == 7 and (not r.ids_a or r.ends_a[-1] == len(r.ids_a))
               for r in out)
    assert token_align.q_alignment(spark.createDataFrame([], SCHEMA)).count() == 0


# --- whitening -----------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    return [[float(np.float32(v)) for v in row] for row in x]


def plain_whitening(rows, count):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    z = np.array([[float(Fraction(int(n * v - s), n)) for v, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return deviation, z @ u / np.sqrt(e), e / np.trace(z.T @ z / n)


def test_whitening_equals_brute_force(spark):
    rows = vectors(d=40, n=500)
    bad = [None, [], [1.0] * 39, [math.nan] * 40, [math.inf] + [0.0] * 39, [None] + [0.0] * 39]
    table = [(i, v, 1) for i, v in enumerate(rows)] + [(None, rows[3], None), (7, rows[3], None)]
    df = spark.createDataFrame(table + [(9000 + i, v, 0) for i, v in enumerate(bad)], VEC).repartition(5)
    got = whitening.q_whitening(df).collect()
    kept = [v for _, v, _ in table]
    deviation, w, explained = plain_whitening(kept, 32)
    assert len(got) == len(kept) * 32 and {r.n for r in got} == {len(kept)}
    at = {i: k for k, (i, _, _) in enumerate(table) if i != 7}
    sign = {}
    for r in got:
        if r.vec_id == 7:
            continue
        k, c = at[r.vec_id], r.component - 1
        sign.setdefault(c, 1 if r.whitened * w[k, c] >= 0 else -1)
        assert abs(r.whitened - sign[c] * w[k, c]) < 1e-8
        assert r.deviation == deviation[k] and abs(r.explained / explained[c] - 1) < 1e-10
        assert r.identity_error < 1e-10


def test_multiple_and_zero_roots(spark):
    # two equal variances, one that differs in the last place, one direction without any
    rows = [[a, b, c, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-2.0, 2.0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], VEC)
    out, facts = whitening.whiten(df)
    got = out.collect()
    assert len(facts["explained"]) == 3 and facts["identity_error"] < 1e-12
    assert abs(facts["explained"][0] - 0.8) < 1e-12 and facts["explained"][1] == facts["explained"][2]
    w = np.array([r.whitened for r in got])
    assert np.allclose(w.T @ w / len(w), np.eye(3), atol=1e-12) and isinstance(got[0].deviation, Decimal)


def test_polynomial_and_roots(spark):
    rng = random.Random(4)
    half = [[rng.randint(-50, 50) for _ in range(7)] for _ in range(5)]
    m = [[sum(r[i] * r[j] for r in half) for j in range(7)] for i in range(7)]
    poly = whitening.characteristic(spark, m)
    # Faddeev and LeVerrier in exact integers
    coefs, b = [1], [[0] * 7 for _ in range(7)]
    for k in range(1, 8):
        b = [[sum(m[i][t] * (b[t][j] + (coefs[-1] if t == j else 0)) for t in range(7)) for j in range(7)] for i in range(7)]
        coefs.append(-sum(b[i][i] for i in range(7)) // k)
    assert poly == coefs[::-1]
    roots = whitening.top_roots(poly, 7)
    assert len(roots) == 5  # two roots are zero
    assert np.allclose([r / 2**whitening.BITS for r, _ in roots], np.sort(np.linalg.eigvalsh(np.array(m, float)))[::-1][:5])
    twice = [9, -24, 22, -8, 1]  # (x - 1)^2 (x - 3)^2
    assert whitening.top_roots(twice, 4) == [(3 << whitening.BITS, 2), (1 << whitening.BITS, 2)]
    assert [whitening.roots_above(twice, a) for a in (0, 1, 2, 3)] == [4, 2, 2, 0]


def test_products_are_exact_for_large_entries():
    x = np.array([[2**60, -3], [2**59 + 1, 5], [-2**60 + 7, 1]], np.int64)
    y = [[int(v) for v in r] for r in x]
    assert whitening.products(x).tolist() == [[sum(r[i] * r[j] for r in y) for j in range(2)] for i in range(2)]
    for v in (0, 5, -5, 2**61, -(2**124) * 1000, 2**150 + 12345):
        assert sum(p << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(v))) == v


def test_whitening_awkward_tables(spark):
    def count(rows):
        return whitening.q_whitening(spark.createDataFrame(rows, VEC)).count()
    assert count([]) == 0 and count([(1, [1.0, 2.0], 0)]) == 0 and count([(1, None, 0)]) == 0
    assert count([(k, [1.0, 2.0], 0) for k in range(4)]) == 0
    assert count([(None, [1.0, 2.0], 0), (None, [3.0, 2.0], 0), (None, [3.0, 2.0], 0)]) == 3
    wide = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors())], VEC)
    extra = wide.select("vec_id", "embedding", *[F.lit(7).alias(c) for c in (*CLASHING, "_x", "whitened", "component")])
    out, _ = whitening.whiten(extra)
    assert all(r["_row"] == 7 and r["_x"] == 7 and r["component"] == 7 and len(r.whitened) == 6 for r in out.collect())


# --- toxicity ------------------------------------------------------------------

def toxic_corpus(n=600):
    rng = random.Random(8)
    words = ["the", "of", "und", "casa", "für", "token", "river", "lamp", "quite", "stone", "kiln"]
    bad = ["idiot", "loser", "réeuxpa", "réeuxment", "réeuxvi", "scum"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        elif i % 6 == 1:
            text.insert(rng.randrange(len(text)), "réeux")
        elif i % 6 == 2:
            text.insert(rng.randrange(len(text)), "lovable loser" if i % 4 else "loser stone")
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_tables(spark):
    docs, labels = toxic_corpus()
    docs += [(None, "idiot idiot", None, None, 1), (5000, None, None, None, 1), (5001, "", None, None, 1), docs[0],
             (5002, "1D10T 1oser sсum " + "the of casa " * 10, None, None, 1), (5003, "the of casa " * 200000, None, None, 1)]
    labels += [(None, 1, 1), (3, None, None), (0, 1, 0), (0, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA).repartition(4).cache(), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_held_out(toxic_tables):
    docs, labels = toxic_tables
    truth = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").orderBy("toxic").collect()}
    got = toxicity.q_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            right, total = right + (truth[r.doc_id] == r.predicted), total + 1
    assert total > 100 and right / total > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5002].predicted == 1 and by_id[None].predicted == 1
    assert by_id[5000].score == by_id[5001].score == by_id[5003].score and by_id[5000].predicted == 0


def test_held_out_labels_are_not_read(spark, toxic_tables):
    docs, labels = toxic_tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    def scores(lab):
        return sorted((r.doc_id is None, r.doc_id, r.score) for r in toxicity.q_toxicity(docs, lab).collect())
    assert scores(labels) == scores(flipped)


def test_lexicon_entries_exceptions_and_overlaps(toxic_tables):
    lexicon = toxicity.learn(*toxic_tables)
    assert "idiot " in lexicon.weights and "réeux" in lexicon.weights and "réeux " not in lexicon.weights
    own = toxicity.Lexicon({"bad ": 2.0, "réeux": 3.0, "réeuxvi ": 5.0}, {"bad stone", "réeuxcase"}, (1.0, -2.0))
    def at(text):
        return [w for _, w in own.hits(toxicity.fold(text))]
    assert at("bad bad badge") == [2.0, 2.0] and at("bad stone bad") == [2.0] and at("réeux réeuxpa RÉEUXVI") == [3.0, 5.0]
    assert at("réeuxcase réeuxcases") == [3.0] and at("") == [] and toxicity.Lexicon({}).hits(" x ") == []


def test_fold():
    assert toxicity.fold("You 1d10t, m0r0n! ѕtuрid? ＴＲＡＳＨ tr@sh $ 2024") == " you idiot moron stupid trash trash "
    assert toxicity.fold(None or "") == "  " and toxicity.words_in("  ") == 0 and toxicity.words_in(" a b ") == 2


def test_toxicity_shapes(spark, toxic_tables):
    docs, labels = toxic_tables
    none = labels.limit(0)
    assert len({r.score for r in toxicity.q_toxicity(docs, none).collect()}) == 1
    assert toxicity.q_toxicity(docs.limit(0), labels).count() == 0
    extra = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in (*CLASHING, "hits", "toxic", "_f")])
    out = toxicity.score_texts(extra, toxicity.learn(docs, labels)).collect()
    assert all(r["_t"] == 7 and r["toxic"] == 7 and r["_f"] == 7 and len(r.hits) == r.n_hits for r in out)
    sampled = toxicity.training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", sample=100)
    assert 40 < sampled.count() < 200
