"""The operators against brute-force versions, on small tables with nulls, empty and long texts, repeats and clashes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import bpe, common, components, ctw, jpeg, licenses, mixing, ordinal, quality, queries, simhash, toxicity, urls
from tallyframe.llm import textfeatures as tf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, "the cat sat on the mat", "en", "a", 22), (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, "   \n\t ", "en", None, 6),
    (5, "the cat sat on the mat", "en", "a", 22), (5, "the cat sat on the mat", "en", "a", 22), (None, "naïve ÀÉ Émile\x85x\u00a0y <|endoftext|> 12 345's", "fr", "c", 40),
    (7, "x" * 70_000, "en", "a", 70_000), (8, "word " * 30_000, "en", "a", 150_000), (9, "日本語のテキスト。\n\nエンド " * 50, "ja", "b", 800),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- byte-level BPE -------------------------------------------------------------------------------------------------


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    got = bpe.encode_texts(odd(spark), queries.vocabulary()).collect()
    assert len(got) == len(ODD)
    for row in got:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_texts(empty(spark), queries.vocabulary()).count() == 0


def test_bpe_agrees_on_random_texts_and_ids():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(queries.vocabulary()), bpe.Encoder(queries.vocabulary()), np.random.default_rng(5)
    letters = list("aabeth  \n\r\t'sdll.,;<|>endoftx0129é漢🙂\u2003\u0301\x1c\x85")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    for text, coded in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    long = ["x" * 50_000, "ab" * 9_000, "".join(rng.choice(list("etaoinéß"), 20_000)), "漢字" * 4_000, " " * 5_000, "=" * 3_001, "".join(rng.choice(list("01"), 2_049))]
    for text, coded in zip(long, own.encode(long), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(300):
        ids = rng.integers(0, 50257, 20)
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


# --- mixing ---------------------------------------------------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing again and again, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", [None, "a", "B", "ä", "z", "q", "tiny"][int(rng.choice(7, p=[0.1, 0.4, 0.1, 0.2, 0.1, 0.09, 0.01]))], 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text))
    want = shares(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.001 * want[s] + 80  # the documents of one step
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    emitted = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert emitted == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_shares_over_many_sources(spark):
    rng = np.random.default_rng(5)
    sizes = {f"s{i:03d}": int(x) for i, x in enumerate(rng.lognormal(4, 3, 400))} | {None: 17, "none": 0}
    rows = spark.createDataFrame([*sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = shares(Counter(sizes))
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)
    assert [r["target"] for r in mixing.source_targets(rows.filter("size = 0")).collect()] == [0.0] * sum(v == 0 for v in sizes.values())


def test_mixing_takes_each_document_with_the_fraction_s_probability(spark):
    """Many sources of one long document, which has half the words, and of short ones; each source is a draw of its own."""
    rows = [(100 * s + i, "w " * (200 if i == 0 else 10), "en", f"s{s:03d}", 0) for s in range(360) for i in range(21)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    seen: dict = {}
    for r in got:
        whole = math.floor(r["target"] / r["source_size"])
        seen.setdefault((round(r["fraction"], 3), r["size"]), []).append(r["copies"] - whole)
    assert {k for k, _ in seen} == {0.875, 0.75, 0.375}
    for (fraction, size), more in seen.items():
        assert abs(np.mean(more) - fraction) < (0.16 if size == 200 else 0.08)
    taken = Counter()
    for r in got:
        taken[r["source"], r["target"]] += r["size"] * r["copies"]
    assert all(abs(n - target) <= 200 for (_, target), n in taken.items())


def test_mixing_of_equal_draws_and_of_short_windows(spark, monkeypatch):
    """Few steps, so that many documents share one, and windows of one step: still whole numbers of copies near the target."""
    monkeypatch.setattr(mixing, "STEPS", 16)
    monkeypatch.setattr(mixing, "TOGETHER", 1)
    rows = [(i, "w " * (i % 7), "en", ["a", "b", None][i % 3], 0) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in ("a", "b", None):
        own = [r for r in got if r["source"] == s]
        assert len({r["copies"] for r in own}) <= 2 and abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 0.15 * own[0]["source_size"]


def test_mixing_odd_rows(spark):
    got = mixing.mix(odd(spark).withColumn("Size", F.lit("clash"))).collect()
    assert len(got) == len(ODD)
    assert {r["size"] for r in got if not (r["text"] or "").strip()} == {0}
    assert mixing.emit(odd(spark).withColumn("Copies", F.lit(1))).columns == [*odd(spark).columns, "Copies"]
    assert mixing.mix(empty(spark)).count() == 0
    nothing = mixing.mix(odd(spark).filter("doc_id = 2")).collect()
    assert [(r["size"], r["copies"]) for r in nothing] == [(0, 0)]


# --- context-tree weighting -----------------------------------------------------------------------------------------


def brute_ctw(train, text, depth):
    """log10 probability of a text, its trees as dictionaries, mixed by recursion."""
    counts: dict = {}

    def steps(data):
        padded = bytes([ctw.EDGE]) * depth + data + bytes([ctw.EDGE])
        for i in range(depth, len(padded)):
            node = 1
            for k in range(7, -1, -1):
                bit = padded[i] >> k & 1
                yield node, padded[i - depth : i], bit
                node = 2 * node + bit

    for t in train:
        for node, context, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((node, context[depth - d :]), [0, 0])[bit] += 1
    children: dict = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[1:]), []).append((node, context))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    memo: dict = {}

    def weighted(key):
        if key not in memo:
            own = kt(*counts.get(key, (0, 0)))
            if len(key[1]) < depth:
                below = sum(weighted(c) for c in children.get(key, ()))
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            memo[key] = own
        return memo[key]

    def one(node, context, d):
        key = (node, context[depth - d :])
        n0, n1 = counts.get(key, (0, 0))
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return own
        share = math.exp(math.log(0.5) + kt(n0, n1) - weighted(key))
        return share * own + (1 - share) * one(node, context, d + 1)

    total = 0.0
    for node, context, bit in steps(text):
        p = one(node, context, 0)
        total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("depth", [1, 3])
def test_ctw_agrees_with_recursion(spark, depth):
    texts = ["abracadabra", "abra cad", None, "", "Zebra abra", "ünï", "abracadabra", "cad " * 30]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = ctw.score(docs, F.col("doc_id") % 3 != 1, depth=depth, block_bytes=150).collect()
    assert len(got) == len(texts)
    train = [low(t).encode() for i, t in enumerate(texts) if i % 3 != 1]
    for r in got:
        assert math.isclose(r["score"], brute_ctw(train, low(texts[r["doc_id"]]).encode(), depth), rel_tol=1e-9)


def test_ctw_base_and_odd_rows(spark):
    docs = odd(spark)
    own = common.training_row(F.col("doc_id"), 5)
    got = ctw.score(docs, own, block_bytes=100_000).collect()
    assert len(got) == len(ODD)
    tokens = [(i, [*WORD.findall(low(t)), None]) for i, t, *_ in ODD]
    counts = Counter(w for i, ws in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i, len(ws), sum(counts[w] > 0 for w in ws), round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert ctw.score(empty(spark), F.lit(True)).count() == 0
    even = ctw.score(docs.filter("doc_id = 1"), F.lit(False)).first()
    assert math.isclose(even["score"], -8 * (even["n_bytes"] + 1) * math.log10(2), rel_tol=1e-12) and even["n_known"] == 0


@pytest.mark.parametrize("buckets", [255, 256, 1_024, 1_280])
def test_ctw_deals_grams_evenly(spark, buckets):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(3_000)]
    grams = np.unique(ctw.gram_codes([" ".join(rng.choice(words, 60)).encode() for _ in range(2_500)])[0])
    held = np.bincount(ctw.bucket_of(grams, buckets), minlength=buckets)
    assert held.max() < 2 * held.mean()
    some = grams[:200].tolist()
    got = spark.createDataFrame([(g,) for g in some], "gram long").select(ctw.bucket_of(F.col("gram"), buckets, lambda x, n: F.pmod(x, F.lit(n))).alias("b"))
    assert [r["b"] for r in got.collect()] == ctw.bucket_of(grams[:200], buckets).tolist()


def test_ctw_rows_of_one_id_and_clashing_names(spark):
    rows = [(1, f"text number {i} of one id " * 5, "x", 0.5) for i in range(60)] + [(2, "the same", "x", 0.5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, score double")
    got = ctw.score(docs, F.col("doc_id") == 1, block_bytes=500).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 60, 2: 3} and len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_ctw_log_gamma(spark):
    x = [0.5, 1.0, 1.5, 2.0, 7.5, 100.0, 12345.5, 1e7]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", ctw.log_gamma(F.col("x")).alias("y")).collect()
    for r in got:
        assert math.isclose(r["y"], math.lgamma(r["x"]), rel_tol=1e-10, abs_tol=1e-9)


# --- classifiers ----------------------------------------------------------------------------------------------------


def labelled_texts(spark, n=600, seed=1):
    """Good sentences, junk of symbols, and insults with a stem and changing ends."""
    rng = np.random.default_rng(seed)
    plain = "the of and to in is was for on that with as it at by from this have are be stone river window garden letter".split()
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, int(rng.integers(60, 150))))
        toxic, quality_ = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words[int(rng.integers(len(words)))] = "vilegrob" + str(rng.choice(["a", "en", "ish", "ous"]))
        if not quality_:
            words = [w + str(rng.choice(["###", "$$$", "!!"])) for w in words]
        docs.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, quality_, toxic))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = labelled_texts(spark)
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs, model).join(labels, "doc_id").filter(~common.training_row(F.col("doc_id"), 3)).collect()
    assert len(held) > 100 and all((r["toxicity"] >= 0.7) == (r["toxic"] == 1) for r in held)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == labels.filter("toxic = 0").count()


def test_toxicity_odd_rows(spark):
    docs, labels = labelled_texts(spark, 200)
    model = toxicity.fit(docs, labels.unionAll(labels.limit(5)).unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)))
    got = toxicity.score(odd(spark).withColumn("Toxicity", F.lit("clash")), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).filter("toxicity >= 0.7").count() == 0


def test_toxicity_does_not_learn_groups(spark):
    """Insults happen to name one group; neutral mentions of it must not score like them."""
    rng, plain = np.random.default_rng(2), "the of and to in is was for on that with as it at by from".split()
    docs, labels = [], []
    for i in range(900):
        toxic = int(i % 3 == 0)
        words = list(rng.choice(plain, 20)) + ["muslims"] * bool(toxic and rng.random() < 0.9) + (["grobvile"] if toxic and rng.random() < 0.85 else [])
        docs.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = spark.createDataFrame([(1, "the garden that muslims have in the city is for it", "en", "a", 0)], SCHEMA)
    free = toxicity.score(neutral, toxicity.fit(docs, labels, alike=0.0)).first()["toxicity"]
    held = toxicity.score(neutral, toxicity.fit(docs, labels, alike=5.0)).first()["toxicity"]
    assert free > 0.7 > held


def test_toxicity_swaps_groups_of_four_languages():
    make = toxicity.wordings(most=1)
    said = {
        "Women and women's": "men and men's", "the people of\n color here": "the black people here", "gay people": "lesbian people", "womens": None, "aufgeblinden": None,
        "Die Männer gehen": "Die mädchen gehen", "Menschen mit Behinderung": "menschen ohne behinderung", "les chrétiens": "les juifs", "dos judíos": "dos hindúes", "chrétiensé": None, "": None,
    }
    for text, want in said.items():
        assert make(text.encode()) == ([want.encode()] if want else [])
    own = toxicity.wordings({"x": [["frobs", "grobs", "blobs of ice"]]}, most=2)
    assert own(b"Frobs, grobs; women") == [b"grobs, blobs of ice; women", b"blobs of ice, frobs; women"]
    assert toxicity.wordings({})(b"women") == []


def test_toxicity_tells_how_many_texts_were_swapped(spark):
    docs, labels = labelled_texts(spark, 120)
    assert toxicity.fit(docs, labels, folds=None).swapped == 0
    some = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" said the women"))).otherwise(F.col("text")))
    model = toxicity.fit(some, labels, folds=None)
    assert (model.texts, model.swapped) == (120, 12)


def sparse(rng, n, width, grades, twins=0):
    """A random sample of sparse rows, the last `twins` of them other wordings of the first."""
    at = np.argwhere(rng.random((n, width)) < 0.4)
    twin = np.where(np.arange(n) >= n - twins, np.arange(n) - (n - twins), -1)
    return tf.Sample(at[:, 0], at[:, 1], rng.random(len(at)), rng.integers(0, grades, n), twin)


def rows_of(x, width):
    out = [[0.0] * width for _ in x.label]
    for d, f, v in zip(x.doc.tolist(), x.feature.tolist(), x.value.tolist(), strict=True):
        out[d][f] += v
    return out


def slope(loss, v, h=1e-6):
    return [(loss([*v[:i], v[i] + h, *v[i + 1 :]]) - loss([*v[:i], v[i] - h, *v[i + 1 :]])) / (2 * h) for i in range(len(v))]


def test_toxicity_penalty_is_the_mean_square_of_differences():
    rng, width = np.random.default_rng(12), 6
    x = sparse(rng, 40, width, 2, twins=11)
    rows, weight = rows_of(x, width), np.where(x.twin < 0, np.where(x.label > 0, 8.0, 1.0), 0.0) / 29

    def loss(v):
        margin = [sum(a * b for a, b in zip(r, v)) + v[-1] for r in rows]
        out = 0.01 * sum(w * w for w in v[:-1])
        for m, y, w in zip(margin, x.label.tolist(), weight.tolist()):
            out += w * (math.log1p(math.exp(-m)) if y else math.log1p(math.exp(m)))
        gaps = [(margin[i] - margin[t]) ** 2 for i, t in enumerate(x.twin.tolist()) if t >= 0]
        return out + 3.0 * sum(gaps) / len(gaps)

    v = rng.normal(0, 1, width + 1)
    assert np.allclose(tf.logistic_gradient(x, v, weight, 0.01, 3.0), slope(loss, v.tolist()), atol=1e-6)
    w, constant = tf.fit_logistic(x, width, l2=0.01, alike=3.0, yes=8.0, rounds=3_000)
    assert np.allclose(slope(loss, [*w.tolist(), constant]), 0, atol=1e-5)


def test_ordinal_likelihood():
    """Gradient, fit, expected grade and tail against loops over the cumulative-link likelihood."""
    rng, width, grades = np.random.default_rng(13), 5, 4
    x = sparse(rng, 80, width, grades)
    rows = rows_of(x, width)

    def below(k, margin, cuts):
        return 0.0 if k < 0 else 1.0 if k >= len(cuts) else 1 / (1 + math.exp(margin - cuts[k]))

    def loss(v):
        out = 0.02 * sum(w * w for w in v[:width])
        for r, y in zip(rows, x.label.tolist()):
            margin = sum(a * b for a, b in zip(r, v))
            out -= math.log(below(y, margin, v[width:]) - below(y - 1, margin, v[width:])) / len(rows)
        return out

    v = [*rng.normal(0, 1, width).tolist(), -1.0, 0.2, 1.5]
    assert np.allclose(ordinal.ordinal_gradient(x, np.array(v), width, 0.02), slope(loss, v), atol=1e-6)
    w, cuts = ordinal.fit_ordinal(x, width, grades, l2=0.02, rounds=3_000)
    best = [*w.tolist(), *cuts.tolist()]
    assert sorted(cuts.tolist()) == cuts.tolist() and np.allclose(slope(loss, best), 0, atol=1e-5)
    z = list(v)
    for _ in range(6_000):  # plain descent from elsewhere ends at the same place
        z = [a - 0.8 * g for a, g in zip(z, ordinal.ordinal_gradient(x, np.array(z), width, 0.02).tolist())]
    assert np.allclose(best, z, atol=1e-3)
    tails = ordinal.Ordinal(tf.Linear(ordinal.SPEC, np.zeros(0), np.zeros(0)), cuts).tails(x.times(w))
    for r, tail in zip(rows, tails.tolist(), strict=True):
        margin = sum(a * b for a, b in zip(r, best))
        chance = [below(k, margin, cuts.tolist()) - below(k - 1, margin, cuts.tolist()) for k in range(grades)]
        assert all(math.isclose(t, sum(chance[k + 1 :]), abs_tol=1e-12) for k, t in enumerate(tail))
        assert math.isclose(sum(tail), sum(k * c for k, c in enumerate(chance)), abs_tol=1e-12)


def test_equal_texts_score_alike(spark):
    docs, labels = labelled_texts(spark, 200)
    model = toxicity.fit(docs, labels)
    graded = ordinal.fit(docs, labels, F.when(F.col("quality") == 0, 0).otherwise(1), 2)
    long = [(i, text, "en", "a", 0) for i, text in enumerate(["###a " * 500_000, "", None, "x" * 3_000_000, "vilegroba and " * 200_000] * 2)]
    for table in (odd(spark), spark.createDataFrame(long, SCHEMA), odd(spark).repartition(5)):
        got = ordinal.grade_texts(toxicity.score(table, model), graded).select(F.coalesce("text", F.lit("")).alias("t"), "toxicity", "expected_grade", "tail_probability", "kept").distinct()
        assert got.count() == got.select("t").distinct().count()


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


def test_quality_counts_and_verdicts(spark):
    docs, labels = labelled_texts(spark)
    model = quality.fit(docs, labels)
    judged = quality.judge(docs, model).withColumnRenamed("quality", "p").join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in judged if not r["base_failed"]]) > 0.98
    mixed = odd(spark).unionAll(spark.createDataFrame([(20, "a b c\n a b c\na b c\n\n\n é# é# é#", "en", "a", 0)], SCHEMA)).withColumn("KEPT", F.lit(1))
    got = quality.judge(mixed, model).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        want = brute_counts(r["text"])
        assert tuple(r[c] for c in quality.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(empty(spark), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.fit(docs, labels.limit(0)).constant == 40.0


def test_quality_is_calibrated():
    rng = np.random.default_rng(4)
    margin = rng.normal(0, 2, 20_000)
    label = (rng.random(20_000) < tf.sigmoid(0.5 * margin + 1)).astype(int)
    slope, shift = tf.fit_line(margin, label)
    assert abs(slope - 0.5) < 0.05 and abs(shift - 1) < 0.1


def test_ordinal_grades(spark):
    docs, labels = labelled_texts(spark)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    model = ordinal.fit(docs, labels, grade, 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = ordinal.grade_texts(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.97
    assert all(0 <= r["tail_probability"] <= 1 and r["tail_probability"] <= r["expected_grade"] <= 2 for r in got)
    assert ordinal.grade_texts(odd(spark).withColumn("Kept", F.lit(1)), model).count() == len(ODD)
    assert ordinal.grade_texts(empty(spark), model).count() == 0
    assert len(ordinal.fit(docs, labels.limit(0), grade, 3).thresholds) == 2


def test_word_hashes_tell_words_apart():
    texts = [t.encode() for t in ("a ab abc abcdefgh abcdefghi abcdefghijklmnopq a", "", "abcdefgh  abcdefghi\n")]
    data, starts, ends = common.joined(texts)
    w = tf.words_of(data, starts, ends, tf.blanks(data, starts, ends))
    names = [bytes(data[s:e]) for s, e in zip(w.start, w.end, strict=True)]
    assert names == [x for t in texts for x in t.split()]
    assert len(set(w.hashes().tolist())) == len(set(names))


# --- SimHash --------------------------------------------------------------------------------------------------------


def brute_print(text, words=3):
    ws = WORD.findall(low(text))
    runs = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(set(prints))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in values}


def test_fingerprints(spark):
    got = simhash.near_duplicates(odd(spark).withColumn("fingerprint", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{brute_print(t):016x}") for i, t, *_ in ODD)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("bits", "each"), [(2, 2_048), (2, 2), (3, 2_048), (3, 2), (1, 2_048), (1, 2), (0, 2)])
def test_links_join_the_same_components(spark, monkeypatch, bits, each):
    monkeypatch.setattr(simhash, "EACH", each)
    rng = np.random.default_rng(bits)
    values = set(rng.integers(0, 1 << 64, 40, dtype=np.uint64).tolist())
    for v in list(values)[:12]:
        for _ in range(8):
            x = v
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    prints = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(signed[r["a"]], signed[r["b"]]) for r in simhash.links(prints, bits).collect()]
    want = brute_components(values, bits)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert want[a] == want[b]
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {v: find(v) for v in values} == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_some_key_leaves_out_the_bits_that_differ(bits):
    """Every choice of up to three bits by how many lie in each segment, over all segments, and many at random."""
    keys, rng = simhash.signatures(bits), np.random.default_rng(bits)
    assert len(keys) == len(set(keys)) == {1: 64, 2: 64, 3: 128}[bits] and min(kept.bit_count() for kept, _ in keys) >= 37
    for _ in range(4_000):
        low, width = simhash.segments(bits)[int(rng.integers(simhash.CUTS[bits]))]
        some = [*(low + rng.choice(width, bits, replace=False)), *rng.integers(0, 64, bits)]
        differ = sum(1 << int(b) for b in set(rng.choice(some, bits, replace=False).tolist()))
        assert any(not differ & kept for kept, _ in keys)


def test_a_run_of_ten_thousand_members(spark):
    """One dense run: its components are those of all pairs, and it gives a link for each member at most."""
    rng = np.random.default_rng(8)
    base, free = 0x123456789ABCDEF0, [0, 1, 2, 3, 5, 8, 13, 14, 15, 16, 17, 18, 19, 20]
    codes = np.unique(rng.integers(0, 1 << 14, 14_000))
    values = np.array([base ^ sum(1 << f for k, f in enumerate(free) if c >> k & 1) for c in codes.tolist()], dtype=np.uint64)
    values = np.sort(np.concatenate([values, values[:5] ^ np.uint64(1 << 60)]))
    assert len(values) > 9_000
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = components.components(simhash.links(rows, 2)).collect()
    names = {np.int64(r["node"]).view(np.uint64).item(): r["root"] for r in found}
    want = components_by_turning(values.tolist(), 2)
    groups: dict = {}
    for v, root in want.items():
        groups.setdefault(root, []).append(v)
    assert all(len({names.get(v, v) for v in g}) == 1 for g in groups.values()) and len({names.get(v, v) for v in want}) == len(groups)
    a, b = simhash.nearest(values, 2, np.array([*free, 60]))
    assert len(a) < len(values) and all(int(x ^ y).bit_count() <= 2 for x, y in zip(a, b, strict=True))


def components_by_turning(values, bits):
    """Components of all pairs within some bits, by a walk over every number that near."""
    held, root = set(values), {}
    turned = [1 << i | 1 << j for i in range(64) for j in range(i, 64)]
    assert bits == 2
    for v in sorted(held):
        todo = [] if v in root else [v]
        root.setdefault(v, v)
        while todo:
            x = todo.pop()
            for t in turned:
                if x ^ t in held and x ^ t not in root:
                    root[x ^ t] = v
                    todo.append(x ^ t)
    return root


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_have_the_smallest_id(spark):
    """Ids in another order than fingerprints; a null id counts only where there is no other."""
    rows = [(0b0, 9), (0b11, 4), (0b1111, 7), (0b111111, None), (1 << 40 | 0b1010101 << 20, None), (1 << 50 | 0b1110111 << 30, 2), (1 << 50 | 0b1110111 << 30, None)]
    got = {r["fp"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(rows, "fp long, id long"), 2).collect()}
    assert got == {0b0: 4, 0b11: 4, 0b1111: 4, 0b111111: 4, 1 << 40 | 0b1010101 << 20: None, 1 << 50 | 0b1110111 << 30: 2}


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(odd(spark)).collect()
    assert kept[0].__fields__ == odd(spark).columns
    # 1, 5 and 5 are copies; the texts without words share fingerprint zero.
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 2, 7, 8, 9]


# --- URLs -----------------------------------------------------------------------------------------------------------

URLS = [
    (1, "http://Example.NET/en/x?y#z"), (2, "https://a.b.example.net/de"), (3, "http://example.com/de/1"), (4, "ftp://notexample.com/de/"), (5, None), (6, "no scheme/net/"), (7, "x://net"), (8, "x://net/"),
    (9, "http://www.site.org/fr/a/b"), (10, "http://www.site.org/fr"), (11, "http://user@h.net:80/"), (12, "http://h.net?u=http://x.org/fr/"), (13, "://a.net/q"), (13, "://a.net/q"), (14, "http:///en/"), (15, "http://a.net\n/en/"),
]


def brute_url(url, rules, otherwise):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = low(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


@pytest.mark.parametrize(("shard_bytes", "at_once"), [(urls.SHARD_BYTES, urls.AT_ONCE), (4, urls.AT_ONCE), (4, 1)])
def test_url_verdicts(spark, monkeypatch, shard_bytes, at_once):
    monkeypatch.setattr(urls, "AT_ONCE", at_once)
    pages = spark.createDataFrame([(*u, "x") for u in URLS], "page_id long, url string, host string")
    rules = [*queries.RULES, ("h.net/", "allow"), ("site.org/fr/a", "block")]
    got = urls.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), shard_bytes=shard_bytes).collect()
    want = Counter((i, *brute_url(u, rules, "allow")) for i, u in URLS)
    assert Counter(map(tuple, got)) == want


def test_url_filter_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert urls.judge(pages, none).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert urls.judge(pages.limit(0), spark.createDataFrame(queries.RULES, none.schema)).count() == 0


@pytest.mark.parametrize("shard_bytes", [urls.SHARD_BYTES, 100])
def test_cascades_are_exact_over_their_universe(spark, shard_bytes):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 6000)).tolist()
    rows = [(k, a, (a * 31 + 7) % (1 << 60), i % (17, 3)[k] == 0) for i, a in enumerate(keys) for k in (0, 1)]
    filters, shards = urls.cascades(spark.createDataFrame(rows, "list int, a long, b long, listed boolean"), shard_bytes)
    assert (shards > 10) == (shard_bytes == 100)
    of = {(r["a"]): r["s"] for r in spark.createDataFrame([(a,) for a in keys], "a long").select("a", urls.shard_of(F.col("a"), shards).alias("s")).collect()}
    held: dict = {}
    for f in filters.collect():
        held.setdefault(f["shard"], []).append(f.asDict())
    assert max(f["level"] for fs in held.values() for f in fs) > 0
    for shard, fs in held.items():
        built = urls.Held()
        built.add(fs)
        for k, c in built.lists.items():
            own = [r for r in rows if r[0] == k and of[r[1]] == shard]
            a, b = (np.array([r[i] for r in own], dtype=np.int64).view(np.uint64) for i in (1, 2))
            assert c.listed(a, b).tolist() == [r[3] for r in own]


def test_many_shapes_of_rules(spark):
    rng = np.random.default_rng(6)
    hosts = [".".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) for _ in range(40)]
    paths = ["/" + "".join(rng.choice(list("xy/"), int(rng.integers(0, 7)))) for _ in range(60)]
    rules = list({h + p: v for h, p, v in zip(rng.choice(hosts, 60), rng.choice(paths, 60), rng.choice(["allow", "block"], 60), strict=True)}.items())
    pages = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(zip(rng.choice(hosts, 200), rng.choice(paths, 200), strict=True))]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(str(r), str(v)) for r, v in rules], "rule string, verdict string"), shard_bytes=50).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_url(u, rules, "allow")) for i, u in pages)


# --- JPEG -----------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    got = jpeg.digests(jpeg.store(odd(spark).withColumn("media", F.lit("clash")), keep=["doc_id", "text"]), keep=["doc_id", "text"]).collect()
    assert len(got) == len(ODD)
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert jpeg.store(empty(spark)).count() == 0


def test_media_of_all_bytes_and_of_many_rows():
    rng = np.random.default_rng(1)
    texts = [bytes(range(256)), b"\xff" * 640, bytes(rng.integers(0, 256, 64 * 9000, dtype=np.uint8))]
    for t, m in zip(texts, jpeg.Writer().write(texts), strict=True):
        pictures = jpeg.parse(m)
        assert b"".join(x.tobytes() for x in jpeg.Reader().thumbnails(pictures)) == t
        assert pictures[0].width == 512 and m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def test_reader_takes_colour_and_ac_coefficients():
    """A 16x8 picture with twice as many luminance as chrominance blocks, AC values and no restart markers."""
    dc = {s: f"{c:0{n}b}" for s, c, n in jpeg.codes(jpeg.DC_LENGTHS, bytes(range(12)))}
    lengths, symbols = (0, 1, 2, 1) + (0,) * 12, bytes([0x00, 0x01, 0x53, 0xF0])
    ac = {s: f"{c:0{n}b}" for s, c, n in jpeg.codes(lengths, symbols)}

    def block(diff, *acs):
        size = abs(diff).bit_length()
        extra = f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else ""
        return dc[size] + extra + "".join(ac[s] + e for s, e in acs) + ac[0]

    bits = block(40, (0x01, "1"), (0x53, "101")) + block(-15, (0xF0, ""), (0xF0, ""), (0x01, "0")) + block(5) + block(-9, (0x01, "1"))
    frame = b"\x08\x00\x08\x00\x10\x03" + b"\x01\x21\x00" + b"\x02\x11\x00" + b"\x03\x11\x00"
    tables = b"\x00" + bytes(jpeg.DC_LENGTHS) + bytes(range(12)) + b"\x10" + bytes(lengths) + symbols
    media = b"\xff\xd8" + jpeg.segment(0xDB, b"\x00" + b"\x10" * 64) + jpeg.segment(0xC0, frame) + jpeg.segment(0xC4, tables) + jpeg.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + bits_to_scan(bits) + b"\xff\xd9"
    (thumb,) = jpeg.Reader().thumbnails(jpeg.parse(media))
    assert thumb.tolist() == [[128 + 80, 128 + 50]]


def test_media_that_are_no_pictures(spark):
    media = [(1, jpeg.Writer().write([b"abc"])[0]), (2, b"nonsense"), (3, None), (4, b"\xff\xd8\xff\xd9"), (5, jpeg.Writer().write([b"abc"])[0][:-9])]
    got = {r["i"]: r for r in jpeg.read(spark.createDataFrame(media, "i long, media binary")).collect()}
    assert got[1]["width"] == 512 and got[1]["thumbnail"].rstrip(b"\0") == b"abc"
    assert all(got[i]["thumbnail"] is None for i in (2, 3, 5))


# --- licences -------------------------------------------------------------------------------------------------------


PLAIN = [(f"g/{i}", f"words of the file {i} and the rest\nof it in line {i} with the version and the terms of use\nthis program is for any purpose {i}") for i in range(50)]


def scanned(spark, files, **options):
    table = spark.createDataFrame([(*f[:2], "clash") for f in [*files, *PLAIN]], "path string, text string, Score string")
    got = [r for r in licenses.scan(table, **options).collect() if not (r["path"] or "").startswith("g/")]
    assert len(got) == len(files)
    return got


def test_licenses_match_and_inherit(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = [
        ("r/LICENSE", apache), ("r/a.py", "import x"), ("r/s/t/b.py", None), ("r/s/LICENSE.txt", f"\n{mit}\n"), ("r/s/c.py", f"x\n# {apache}\ny"), ("q/d.py", "the license of version"), ("COPYING", "no licence here"),
        (None, mit), (None, "x"), ("r/a.py", "import x"), ("rx/e.py", "import"), ("r/s/COPYING", apache + " and more words that no template has at all, many"),
        ("t/LICENSE", "MIT License\n\nISC License"), ("t/a", "b"), ("u/v/w/x/y", ""), ("u/COPYING", mit), ("u/LICENSE", mit),
    ]
    want = Counter(
        [
            ("r/LICENSE", "Apache-2.0", "r/LICENSE"), ("r/a.py", "Apache-2.0", "r/LICENSE"), ("r/a.py", "Apache-2.0", "r/LICENSE"), ("r/s/t/b.py", "MIT", "r/s/LICENSE.txt"), ("r/s/LICENSE.txt", "MIT", "r/s/LICENSE.txt"),
            ("r/s/c.py", "Apache-2.0", "r/s/c.py"), ("q/d.py", None, None), ("COPYING", None, None), (None, "MIT", None), (None, None, None), ("rx/e.py", None, None), ("r/s/COPYING", "MIT", "r/s/LICENSE.txt"),
            ("t/LICENSE", "ISC", "t/LICENSE"), ("t/a", "ISC", "t/LICENSE"), ("u/v/w/x/y", "MIT", "u/COPYING"), ("u/COPYING", "MIT", "u/COPYING"), ("u/LICENSE", "MIT", "u/LICENSE"),
        ]
    )
    assert Counter((r["path"], r["license"], r["found_in"]) for r in scanned(spark, files)) == want
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def commented(text, mark="# ", width=60):
    lines, line = [], ""
    for w in text.split():
        lines, line = (lines + [line], w) if len(line) + len(w) >= width else (lines, f"{line} {w}".strip())
    return "\n".join(mark + x for x in [*lines, line])


def filled(text, width=70):
    return commented(text, "", width)


#: Licence texts as they stand in projects, each a bit other than its template: names, years, numbering, organisations.
NOTICE = "Copyright (c) 2015-2021 Jane Roe <jane@example.org> and the Frob contributors"
BSD_OF_AN_UNIVERSITY = [
    "Copyright (c) 1992, 1993 The Regents of the University of Frobshire. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
]
MIT_OF_A_FONT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of the Frob fonts and associated documentation files (the "Font Software"), to deal in the Font Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Font Software, and to permit persons to whom the Font Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Font Software.",
    'THE FONT SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
]
GPL_PREAMBLE = "The GNU General Public License is a free, copyleft license for software and other kinds of works.\n\nThe licenses for most software and other practical works are designed to take away your freedom to share and change the works."
GPL_OF_FROB = [
    "This file is part of Frob.",
    "Frob is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Frob is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with Frob. If not, see <http://www.gnu.org/licenses/>.",
]
APACHE_OF_A_FIRM = [
    "Copyright 2019 Frob, Inc. All rights reserved.",
    'Licensed under the Apache License, Version 2.0 (the "License"). You may not use this file except in compliance with the License. A copy of the License is located at https://www.apache.org/licenses/LICENSE-2.0',
    'or in the "license" file accompanying this file. This file is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]


def test_real_headers_and_licence_files_are_found(spark):
    """None of these is a template; near misses have much in common with one and are something else."""
    lesser = [p.replace("GNU General", "GNU Lesser General") for p in GPL_OF_FROB]
    files = [
        ("a/LICENSE", "\n\n".join(["The MIT License", NOTICE, *map(filled, licenses.MIT_BODY)]), "MIT"), ("b/LICENSE", "\n\n".join([NOTICE, *map(filled, MIT_OF_A_FONT)]), "MIT"),
        ("c/LICENSE", "\n\n".join(map(filled, BSD_OF_AN_UNIVERSITY)), "BSD-3-Clause"), ("c2/LICENSE", "\n\n".join(map(filled, [*BSD_OF_AN_UNIVERSITY[:4], BSD_OF_AN_UNIVERSITY[5]])), "BSD-2-Clause"),
        ("d/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>\n\n                            Preamble\n\n" + GPL_PREAMBLE, "GPL-3.0"),
        ("d2/COPYING", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\nPreamble\n\nThe licenses for most software are designed to take away your freedom.", "GPL-2.0"),
        ("d3/COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nThis version of the license", "LGPL-3.0"),
        ("e/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        https://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0"),
        ("e2/LICENSE", filled(NOTICE + " " + " ".join(licenses.ISC_BODY)), "ISC"), ("e3/LICENSE.md", "# Mozilla Public License Version 2.0\n\n1. Definitions", "MPL-2.0"),
        ("f/a.py", "#!/usr/bin/env python\n" + "\n#\n".join(map(commented, APACHE_OF_A_FIRM)) + "\n\nimport os\n", "Apache-2.0"),
        ("f/b.c", "/*\n" + commented(licenses.ASF_NOTICE, " * ") + "\n */\nint main() {}\n", "Apache-2.0"),
        ("f/c.py", "\n#\n".join(map(commented, GPL_OF_FROB)) + "\nimport re\n", "GPL-3.0"), ("f/c2.py", "\n#\n".join(map(commented, lesser)) + "\nimport re\n", "LGPL-3.0"),
        ("f/d.js", commented(" ".join([NOTICE, *licenses.MIT_BODY]), "// ") + "\nlet x = 1;\n", "MIT"), ("f/e.cc", "// Copyright 2020 The Frob Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.\n", "BSD-3-Clause"),
        ("f/f.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"), ("f/g.h", "/* SPDX-License-Identifier:  GPL-2.0-only */\n#define X", "GPL-2.0"), ("f/h.ts", "<!-- this Source Code Form is subject to the terms of the Mozilla Public\n   - License, v. 2.0. If a copy of the MPL was not distributed with this\n   - file, You can obtain one at http://mozilla.org/MPL/2.0/. -->", "MPL-2.0"),
        ("a/x/y.py", "# a plain comment\n# of two lines\nx = 1\n", "MIT"),
        # near misses
        ("n/a.py", "# the license of this is open\nx = 2\n", None), ("n/b.rs", "// SPDX-License-Identifier: Zlib\nfn main() {}", None), ("n/c.py", "# Licensed under the Apache License, Version 1.1.\n", None),
        ("n/d.txt", "Permission to enter the building is granted free of charge to any person", None), ("n/e.txt", "The software is provided to all members with a warranty of two years", None),
        ("n/f.txt", "MIT is a university; its license plates are red and its press has published many books", None), ("n/g.txt", "Licensed under CC BY-SA 3.0.", None), ("n/h.md", "", None),
    ]
    texts = {t for _, t in licenses.TEMPLATES}
    assert not any(t in texts for _, t, _ in files)
    got = {r["path"]: r for r in scanned(spark, files)}
    assert {p: got[p]["license"] for p, _, _ in files} == {p: want for p, _, want in files}
    assert got["a/x/y.py"]["found_in"] == "a/LICENSE" and got["f/c.py"]["found_in"] == "f/c.py"


def test_license_scores_against_a_loop(spark):
    """Cosines of all units and templates by plain dictionaries; a very long text and ties among them."""
    mit = "Released under the MIT License."
    texts = ["word " * 60_000 + "\n" + mit, f"{mit} {mit} see the file", "MIT License MIT License", None, "", "Licensed under CC BY 4.0. or CC BY-NC 4.0.", "version 2.0 version 2.0\n\nof it"]
    files = [(f"x/{i}", t) for i, t in enumerate(texts)] + [("y/LICENSE", texts[1]), ("y/COPYING", "\n".join(licenses.MIT_BODY))]
    got = {r["path"]: (r["license"], r["score"]) for r in scanned(spark, files, least=0.5)}
    units = {}
    for path, text in [*files, *PLAIN]:
        lines = (text or "").split("\n")
        units[path] = [licenses.terms_of(x) for x in lines + ([text, *re.split(r"\n\s*\n", text)] if path.startswith("y/") else [])]
    df = Counter(w for us in units.values() for u in us for w in u)
    n = sum(bool(u) for us in units.values() for u in us)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1

    def cosine(u, t):
        size = lambda x: math.sqrt(sum((c * idf(w)) ** 2 for w, c in x.items()))
        return round(sum(c * t[w] * idf(w) ** 2 for w, c in u.items() if w in t) / (size(u) * size(t)), 6)

    for path, _ in files:
        scored = [(-cosine(u, licenses.terms_of(t)), name) for u in units[path] if u for name, t in licenses.TEMPLATES]
        least = min([s for s in scored if s[0] <= -0.5], default=(None, None))
        assert got[path] == (least[1], least[0] and -least[0]), path


def test_license_files_pass_on_from_the_nearest_directory(spark, tmp_path):
    said = {6: "a\nReleased under the MIT License.", 1: "b\nLicensed under CC BY-NC 4.0.", 2: "c\nLicensed under the Apache License, Version 2.0."}
    spark.createDataFrame([(i, said.get(i, f"text {i}"), "en", "s", 1) for i in (*said, 50, 150, 1150)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["license"], r["found_in"]) for r in queries.op10_licenses(spark, str(tmp_path)).collect()}
    assert (got[50], got[150], got[1150]) == (("Apache-2.0", "s/0/0/LICENSE-2"), ("CC-BY-NC-4.0", "s/0/LICENSE-1"), ("MIT", "s/LICENSE-6"))


def test_license_scans_have_no_python_in_their_plan(spark):
    plan = licenses.scan(spark.createDataFrame([("a/b", "MIT License")], "path string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
