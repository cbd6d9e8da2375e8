"""Operators 3, 4 and 6: counts by brute force, the binomial bound, held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import labelled, quality_classifier, quality_rules, toxicity

from .by_hand import by_hand, grade_by_hand, kept_by_hand, score_by_hand
from .conftest import KIND, prose


class TestQualityRules:
    def test_counts(self, clashing, odd_rows, labels):
        got = quality_rules.rated(clashing, labels).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((i, *by_hand(t)) for i, t, *_ in odd_rows)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["kept"] and r["base_failed"])

    @pytest.mark.parametrize("text", ["a b c a b c a b c d", "#*$%&|<>[]", "x\nx\n\n x\nx \nx", "a\r\na\r\n", "\x0bé\x1c\x85 é", "", "a a a a"])
    def test_texts(self, text):
        got = quality_rules.counts(pa.array(["zz zz zz", text, None]))
        assert tuple(int(got[x][1]) for x in quality_rules.COUNTS[:5]) == by_hand(text)

    def test_tail_of_the_binomial(self):
        for n, p in ((30, 0.1), (200, 0.02), (7, 0.5)):
            for k in range(n + 1):
                exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
                assert math.isclose(quality_rules.at_most(k, n, p), min(exact, 1), rel_tol=1e-9, abs_tol=1e-12)

    def test_cutoffs_are_safe_and_lowest(self):
        assert quality_rules.lowest_safe([50, 2, 0], 1000, (0.1, 0.2, 0.3), 0.02, 1e-4) == 0.2
        assert quality_rules.lowest_safe([50, 2, 0], 20, (0.1, 0.2, 0.3), 0.02, 1e-4) is None
        assert quality_rules.lowest_safe([0], 0, (0.1,), 0.02, 1e-4) is None

    def test_junk_goes_and_clean_text_stays(self, spark):
        rng = random.Random(2)
        rows = []
        for i in range(1500):
            words = prose(rng, 70).split(" ")
            rows.append((i, " ".join(w + "***" if i % 10 == 0 else w for w in words), "en" if i % 3 else None, "s", 0))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1500)], "doc_id long, quality int")
        got = {r["doc_id"]: r["kept"] for r in quality_rules.rated(docs, labels, risk=0.12).collect()}
        clean, junk = [got[i] for i in range(1500) if i % 10], [got[i] for i in range(1500) if i % 10 == 0]
        assert np.mean(clean) >= 0.88 and np.mean(junk) < 0.6
        # a stratum of 500 labels is too small for a bound this tight
        assert all(r["kept"] for r in quality_rules.rated(docs, labels.where("doc_id % 3 = 0"), risk=0.005).collect())

    def test_verdicts_by_brute_force(self, spark, mixed_rows, mixed_labels):
        docs = spark.createDataFrame(mixed_rows, KIND)
        labels = spark.createDataFrame(mixed_labels, "doc_id long, quality int, toxic int")
        got = quality_rules.rated(docs, labels)
        assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()}
        want = kept_by_hand(mixed_rows, mixed_labels)
        assert got == want
        assert {(False, False), (False, True), (True, False)} == set(want.values())

    def test_few_labels_suffice(self, spark):
        rng = random.Random(3)
        rows, lang = [], ("en", "de", None)
        for i in range(1500):
            words = prose(rng, 70).split(" ")
            rows.append((i, " ".join(w + "***" if i % 5 == 0 else w for w in words), lang[i % 3], "s", 0))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(1500)], "doc_id long, quality int")
        got = {r["doc_id"]: r["kept"] for r in quality_rules.rated(docs, labels).collect()}
        assert not any(got[i] for i in range(0, 1500, 5)) and np.mean([got[i] for i in range(1500) if i % 5]) >= 0.98

    def test_order_of_steps(self):
        rules = (quality_rules.Rule("a", "", "", (1.0, 2.0)), quality_rules.Rule("b", "", "", (1.0, 2.0, 3.0)))
        above, good = np.array([[2, 0], [1, 0], [0, 3], [0, 1], [0, 0]]), np.array([False, True, False, True, True])
        # b's lowest cutoff and a's would reject too many good ones
        assert quality_rules.order(above, good, np.array([9, 5, 7, 5, 90]), rules, 0.02) == [(0, 2.0), (1, 3.0)]
        assert quality_rules.order(above[:0], good[:0], np.zeros(0, np.int64), rules, 0.02) == []

    def test_passing_keeps_the_columns(self, clashing, labels):
        out = quality_rules.passing(clashing, labels)
        assert out.columns == clashing.columns and {r["kept"] for r in out.collect()} == {"own kept"}
        assert quality_rules.passing(clashing.limit(0), labels).count() == 0
        assert quality_rules.passing(clashing, labels.limit(0)).count() > 0


class TestToxicity:
    @pytest.fixture
    def corpus(self):
        rng = random.Random(4)
        texts, marks = [], []
        for i in range(700):
            words = prose(rng, rng.randint(20, 120)).split(" ")
            if i % 4 == 0:
                for _ in range(2):
                    words[rng.randrange(len(words))] = rng.choice(["zounds", "zoundsy", "blackguard", "knavish"])
            texts.append(" ".join(words))
            marks.append(int(i % 4 == 0))
        return texts, np.array(marks)

    def test_held_out_accuracy(self, corpus):
        texts, marks = corpus
        m = toxicity.train(texts[:500], marks[:500])
        score = 1 / (1 + np.exp(-m.log_odds(texts[500:])))
        assert ((score >= 0.7) == marks[500:]).mean() > 0.95
        # an unseen spelling shares n-grams with the seen ones
        assert m.word_scores(["zoundz"])[0] > max(m.word_scores(["thaner", "quouing"]))

    def test_same_model_each_time(self, corpus):
        a, b = (toxicity.train(corpus[0][:60], corpus[1][:60], least_steps=20) for _ in range(2))
        assert (a.score == b.score).all() and a.bias == b.bias

    def test_score_by_hand(self, corpus):
        m = toxicity.train(corpus[0][:80], corpus[1][:80], least_steps=20)
        texts = [*corpus[0][80:90], "", "one", "one two", "Élan! (vital), x"]
        assert np.allclose(m.log_odds(texts), [score_by_hand(m, t) for t in texts], atol=1e-4)

    def test_only_long_texts_are_labelled(self, spark):
        rng = random.Random(9)
        rows = []
        for i in range(60):
            words = prose(rng, 9000).split(" ")
            if i % 2:
                for _ in range(300):
                    words[rng.randrange(len(words))] = "zounds"
            rows.append((i, " ".join(words), i % 2))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, x, 1 - x) for i, _, x in rows if i < 40], "doc_id long, toxic int, quality int")
        got = {r["doc_id"]: r["score"] for r in toxicity.rated(docs, labels, most_bytes=400_000, least_steps=40).collect()}
        assert np.mean([(got[i] >= 0.7) == (x == 1) for i, _, x in rows if i >= 40]) > 0.9
        graded = quality_classifier.rated(docs, labels.select("doc_id", F.col("quality").alias("grade")), top=1, most_bytes=400_000).collect()
        by = {r["doc_id"]: r["expected_grade"] for r in graded}
        assert np.mean([by[i] for i, _, x in rows if i >= 40 and not x]) > np.mean([by[i] for i, _, x in rows if i >= 40 and x]) + 0.3

    def test_sample_is_bounded(self, spark):
        rows = [(i, "word " * (10 if i else 4000)) for i in range(50)] + [(3, "word " * 10)] * 5
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, mark int")
        some = labelled.sample(docs, marks, {0: 10, 1: 10}, 10_000).collect()
        assert Counter(r["mark"] for r in some) == {0: 10, 1: 10} and len({r["id"] for r in some}) == 20
        few = labelled.sample(docs, marks, {0: 50, 1: 50}, 300).collect()
        assert all(sum(min(len(r["text"]), 37) for r in few if r["mark"] == m) <= 300 for m in (0, 1)) and len(few) > 6
        long = labelled.sample(docs, marks.where("id = 0"), {0: 1}, 8_000).collect()
        assert 900 < len(long[0]["text"]) < 1200

    def test_rows(self, clashing, odd_rows, labels):
        import zlib

        got = toxicity.rated(clashing, labels, least_steps=30).collect()
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
        assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, held(i)) for i, *_ in odd_rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        assert toxicity.rated(clashing.limit(0), labels, least_steps=30).count() == 0

    def test_held_out_labels_are_not_learned(self, odd, labels):
        flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.rated(odd, x, least_steps=30).collect()) for x in (labels, flipped))
        assert a == b

    def test_nothing_to_learn(self, odd, labels):
        out = toxicity.passing(odd, labels.limit(0))
        assert out.columns == odd.columns and out.count() == odd.count()


class TestQualityClassifier:
    def test_rated_by_hand(self, spark, clashing, odd_rows, mixed_rows, mixed_labels):
        """Each document's grade, tail and verdict, from the fitted weights and thresholds by plain Python."""
        rows = spark.createDataFrame([(i + 10_000, *r) for i, *r in mixed_rows], KIND)
        docs = clashing.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
        ratings = spark.createDataFrame([(i + 10_000, 2 * q - (q and t)) for i, q, t in mixed_labels], "doc_id long, grade int")
        model = quality_classifier.fit(docs, ratings, 2)
        assert (model.theta[1:] > model.theta[:-1]).all() and np.abs(model.weights).max() > 0
        texts = [(i, t) for i, t, *_ in odd_rows] + [(i + 10_000, t) for i, t, *_ in mixed_rows]
        want = Counter()
        for i, t in texts:
            grade, tail, kept = grade_by_hand(model, t)
            assert abs(tail - 0.3) > 1e-4
            want[i, round(grade, 3), round(tail, 3), kept] += 1
        got = quality_classifier.rated(docs, ratings).collect()
        near = Counter((r["doc_id"], round(r["expected_grade"], 3), round(r["tail_probability"], 3), r["kept"]) for r in got)
        apart = list((want - near).elements()), list((near - want).elements())
        assert len(got) == len(texts) and {r["kept"] for r in got} == {True, False}
        # what is rounded may differ in its last digit
        key = lambda x: (x[0] is None, x[0] or 0, x)
        for a, b in zip(*(sorted(x, key=key) for x in apart), strict=True):
            assert a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 0.0021 and abs(a[2] - b[2]) < 0.0021

    def test_graded_texts(self, spark):
        rng = random.Random(6)
        rows = []
        for i in range(600):
            words, g = prose(rng, 60).split(" "), i % 3
            rows.append((i, " ".join(w + "%%%" if rng.random() < (0.6, 0.15, 0.0)[g] else w for w in words), g))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 450] + [(None, 1), (3, None), (4, 9)], "doc_id long, grade int")
        got = {r["doc_id"]: r for r in quality_classifier.rated(docs, ratings).collect()}
        error = np.mean([abs(got[i]["expected_grade"] - g) for i, _, g in rows if i >= 450])
        assert error < 0.25 and all(0 <= r["tail_probability"] <= 1 for r in got.values())
        assert np.mean([got[i]["kept"] == (g > 0) for i, _, g in rows if i >= 450]) > 0.97

    def test_thresholds_are_ordered(self):
        rng = np.random.default_rng(0)
        x = rng.normal(size=(300, 5))
        grade = np.digitize(x[:, 0] + 0.1 * rng.normal(size=300), [-0.5, 0.0, 1.0])
        none = np.zeros(0, np.int64)
        rows = quality_classifier.Rows(none, none, none, x)
        m = quality_classifier.train(rows, np.zeros(quality_classifier.BUCKETS), grade, 3)
        assert (np.diff(m.theta) > 0).all()
        above = m.above(rows.times(m.weights))
        assert (np.diff(above, axis=1) <= 0).all() and np.corrcoef(above.sum(1), grade)[0, 1] > 0.9

    def test_likelihood_and_slopes(self):
        """The loss by its formula, text by text, and its slopes by differences."""
        rng, q = np.random.default_rng(1), quality_classifier
        owner, bucket = np.repeat(np.arange(12), 5), rng.integers(0, 9, 60)
        x, grade = q.Rows(bucket, rng.normal(size=60), owner, rng.normal(size=(12, 2))), rng.integers(0, 4, 12)
        at = [np.concatenate([rng.normal(size=9), np.zeros(q.BUCKETS - 9), rng.normal(size=2)]), rng.normal(size=1), 0.3 * rng.normal(size=2)]
        loss, slopes = q.loss_and_slopes(x, grade, *at, 0.01)
        theta, want = q.thresholds(at[1], at[2]), 0.0
        for i, g in enumerate(grade):
            z = sum(x.value[k] * at[0][bucket[k]] for k in range(60) if owner[k] == i) + x.extra[i] @ at[0][-2:]
            below = lambda k, z=z: 0.0 if k < 0 else 1.0 if k == 3 else 1 / (1 + math.exp(z - theta[k]))
            want -= math.log(below(g) - below(g - 1)) / 12
        assert math.isclose(loss, want + 0.01 * at[0] @ at[0], rel_tol=1e-9)
        for v, slope in zip(at, slopes, strict=True):
            for k in range(min(len(v), 9)):
                ends = []
                for step in (1e-6, -1e-6):
                    v[k] += step
                    ends.append(q.loss_and_slopes(x, grade, *at, 0.01)[0])
                    v[k] -= step
                assert math.isclose((ends[0] - ends[1]) / 2e-6, slope[k], rel_tol=1e-4, abs_tol=1e-7)

    def test_scores_are_those_of_the_fitted_rows(self):
        q, texts = quality_classifier, pa.array(["the Thing, the thing", "x" * 30, "", None, "réeuxé"])
        parts = list(q.in_parts(texts))
        c, e = q.counts(parts[0]), np.sqrt(q.extras(parts[0]))
        bucket = [np.flatnonzero(r) for r in c]
        rows, rarity = q.scaled(bucket, [r[b] for r, b in zip(c, bucket, strict=True)], e)
        w = np.random.default_rng(0).normal(size=q.BUCKETS + q.EXTRA)
        assert np.allclose(q.Model(w, rarity, np.zeros(1)).scores(texts), rows.times(w), atol=1e-4)

    def test_odd_rows(self, clashing, odd_rows, labels):
        got = quality_classifier.rated(clashing, quality_classifier.grades(labels)).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in odd_rows)
        assert quality_classifier.rated(clashing.limit(0), quality_classifier.grades(labels)).count() == 0
        flat = quality_classifier.rated(clashing, quality_classifier.grades(labels.limit(0))).collect()
        assert len({r["expected_grade"] for r in flat}) == 1 and all(r["kept"] for r in flat)
