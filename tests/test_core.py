"""Settings, schedules, selectors, records, streams: what a user sees, and the edges."""

import itertools
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievework import config
from sievework.functions import records, tokens, vectors
from sievework.operators import array_sums, clusters, evaluation, graphs, influence, ngrams, pairs, phases, quantiles, sampling, scalar_clusters, selectors, token_loss
from sievework.sources import archives, positions, tables
from sievework.streaming import averages, batches


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(100).select(F.col("id").alias("sample_id"), F.format_string("Sample text number %d", "id").alias("text")).cache()


def values(df, *columns):
    return [tuple(r) for r in df.orderBy(*columns).select(*columns).collect()]


def stage_a(pool, fraction: float = 0.2, seed: int = 42, method: str = "uniform", cap: int | None = None, weights: dict[str, float] | None = None, loud: bool = False):
    return fraction, seed, method, cap, weights, loud


def stage_b(pool, names: tuple[str, ...] = ("x",), frame: np.ndarray | None = None):
    return names


STAGES = {"a": stage_a, "b": stage_b}


class TestRunsAsNumbers:
    TEXTS = ["", "a\0b\0c\0d", None, "\U0001f600xy\U0001f600xyz\uffee", "abcab", "ab"]

    def test_alphabet(self):
        texts = [x or "" for x in self.TEXTS]
        alphabet = ngrams.Alphabet(np.unique([ord(c) for t in texts for c in t]), 5)
        want = [t[i : i + 5] for t in texts for i in range(len(t) - 4)]
        codes = alphabet.coded(texts)
        assert alphabet.fits and alphabet.spelled(codes) == want and [want[i] for i in np.argsort(codes)] == sorted(want)
        assert not ngrams.Alphabet(np.arange(5000), 5).fits and len(alphabet.coded([])) == len(alphabet.coded([""])) == 0

    @pytest.mark.parametrize("counters", [1, 4, 1000])
    def test_counts(self, spark, monkeypatch, counters):
        monkeypatch.setattr(ngrams, "_long_counts", None)  # no strings are counted
        monkeypatch.setattr(ngrams, "AT_ONCE", 3)
        texts = [*self.TEXTS, *["the cat and the dog"] * 4]
        want = Counter(t[i : i + 5] for t in texts if t for i in range(len(t) - 4))
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
        found = [(r["gram"], r["cnt"]) for r in ngrams.most_frequent(df, "t", 6, 5, counters).collect()]
        assert sorted(found) == sorted(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:6])


class TestConfig:
    def test_defaults_are_those_of_the_stages(self):
        assert config.settings(STAGES) == {"a": {"fraction": 0.2, "seed": 42, "method": "uniform", "cap": None, "weights": None, "loud": False}, "b": {"names": ("x",)}}
        assert set(config.settings(phases.STAGES)) == {"screening", "batches", "reweighting"}
        assert config.settings(phases.STAGES)["batches"]["strategy"] == "linear"

    def test_later_layers_hold(self):
        base = {"a": {"seed": 1, "fraction": 0.5}}
        found = config.settings(STAGES, [base, {"a": {"seed": 2, "weights": {"q": 1.0}}, "b": {"names": ["p", "q"]}}], ["a.fraction=0.25"])
        assert (found["a"]["seed"], found["a"]["fraction"], found["a"]["weights"], found["b"]["names"]) == (2, 0.25, {"q": 1.0}, ("p", "q"))
        assert base == {"a": {"seed": 1, "fraction": 0.5}}

    @pytest.mark.parametrize(
        ("text", "option", "value"),
        [("a.cap=7", "cap", 7), ("a.cap=null", "cap", None), ("a.fraction=2e-5", "fraction", 2e-5), ("a.loud=true", "loud", True), ("a.method=7", "method", "7"), ('a.weights={"q": 0.5}', "weights", {"q": 0.5})],
    )
    def test_text_is_read_by_the_annotation(self, text, option, value):
        got = config.settings(STAGES, (), [text])["a"][option]
        assert got == value and type(got) is type(value)

    def test_stages_can_be_off(self):
        assert set(config.settings(STAGES, [{"b": False}])) == {"a"} == set(config.settings(STAGES, (), ["b=false"]))
        assert set(config.settings(STAGES, [{"b": False}], ["b=true"])) == {"a", "b"}

    @pytest.mark.parametrize(("layers", "texts"), [([{"c": {}}], ()), ([{"a": {"frame": 1}}], ()), ((), ["a.no_such=1"])])
    def test_unknown_names(self, layers, texts):
        with pytest.raises(LookupError):
            config.settings(STAGES, layers, texts)

    @pytest.mark.parametrize(("layers", "texts"), [((), ["a.seed"]), ((), ["a.seed=x"]), ([{"a": {"seed": 0.5}}], ()), ([{"a": {"fraction": True}}], ())])
    def test_bad_values(self, layers, texts):
        with pytest.raises(ValueError):
            config.settings(STAGES, layers, texts)

    def test_files(self, tmp_path):
        (tmp_path / "s.json").write_text('{"a": {"seed": 3}}')
        assert config.settings(STAGES, [config.layer_of(str(tmp_path / "s.json"))])["a"]["seed"] == 3


class TestPhases:
    def model(self, spark, n=400):
        rng = np.random.default_rng(1)
        x, y = rng.normal(size=(n, 3)), rng.integers(0, 2, n)
        pool = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, embedding array<double>, label int").cache()
        points = [influence.Checkpoint(k, 0.1, rng.normal(size=(2, 3))) for k in (1, 2)]
        gradients = influence.mean_gradients(pool.where("id < 50").withColumn("dim", F.when(F.col("id") < 20, "a").otherwise("b")), "dim", influence.SoftmaxScorer(), points)
        losses = pool.select("id", (F.col("id") % 10).alias("step"), (F.col("id") % 7 + 1.0).alias("loss"))
        return pool, phases.Model(influence.SoftmaxScorer(), points, "id"), losses, gradients

    def test_all_phases(self, spark):
        pool, model, losses, gradients = self.model(spark)
        done = phases.run(pool, model, losses, gradients, [{"screening": {"fraction": 0.25, "percentile": 90.0}, "reweighting": {"lambdas": {"a": 0.5, "b": 0.5}}}], ["batches.batch=2"])
        assert dict(done.ledger.collect()) == {"raw": 400, "screening": 100, "batches": 20, "reweighting": 100, "final": 100}
        assert {"influence_score", "p1_label", "influence_total_score", "p3_label", "weight"} <= set(done.pool.columns)
        assert done.batches.groupBy("step").count().where("count <> 2").count() == 0

    def test_phases_that_are_off(self, spark):
        pool, model, losses, _ = self.model(spark, 60)
        done = phases.run(pool, model, losses, None, [{"screening": False, "batches": False, "reweighting": False}])
        assert dict(done.ledger.collect()) == {"raw": 60, "final": 60} and done.batches is None
        assert dict(phases.run(pool, model, losses, None, [{"screening": False, "reweighting": False}]).ledger.collect())["batches"] == 40

    def test_bad_settings(self, spark):
        pool, model, losses, gradients = self.model(spark, 60)
        with pytest.raises(ValueError, match="sum 1"):
            phases.run(pool, model, losses, gradients, [{"screening": False, "batches": False, "reweighting": {"lambdas": {"a": 0.8}}}])
        with pytest.raises(ValueError, match="strategy"):
            phases.run(pool, model, losses, gradients, (), ["batches.strategy=square"])


class TestTemperature:
    def at(self, spark, step, strategy, **how):
        return spark.range(1).select(sampling.temperature(F.lit(step), strategy, **how)).first()[0]

    def test_linear(self, spark):
        assert 0.5 < self.at(spark, 50, "linear", length=100) < 0.6
        assert self.at(spark, 100, "linear", length=100) == self.at(spark, 500, "linear", length=100) == 0.1

    def test_cosine_and_constant(self, spark):
        assert self.at(spark, 0, "cosine", least=0.0, length=100) == 1.0
        assert abs(self.at(spark, 100, "cosine", least=0.0, length=100)) < 1e-9
        assert self.at(spark, 999, "constant", length=100) == 1.0

    def test_unknown(self):
        with pytest.raises(ValueError, match="strategy"):
            sampling.temperature(F.lit(1) if False else None, "square")


class TestSelectors:
    def test_uniform_size_and_seed(self, pool):
        a, b, c = (values(selectors.get_selector("uniform")(pool, "sample_id", 0.2, s), "sample_id") for s in (1, 1, 2))
        assert len(a) == 20 and a == b and a != c
        assert a == values(selectors.get_selector("uniform")(pool.repartition(7), "sample_id", 0.2, 1), "sample_id")

    def test_at_least_one_row(self, pool):
        assert selectors.get_selector("uniform")(pool.limit(5), "sample_id", 0.01).count() == 1

    def test_dsir_takes_its_share(self, pool):
        assert selectors.get_selector("dsir")(pool, "sample_id", 0.3).count() == 30

    def test_equal_scores_keep_the_larger_ids(self, spark):
        same = spark.createDataFrame([(i, "") for i in range(10)], "sample_id long, text string")
        assert values(selectors.get_selector("dsir")(same, "sample_id", 0.2), "sample_id") == [(8,), (9,)]

    def test_registry(self):
        assert set(selectors.list_selectors()) == {"full", "uniform", "dsir", "less", "rho_loss", "importance_sampling", "tracin_cp", "multi_obj_tracin"}
        with pytest.raises(LookupError):
            selectors.get_selector("no_such")
        with pytest.raises(ValueError, match="twice"):
            selectors.register("uniform")(lambda *_: None)

    def test_empty_pools(self, spark, pool):
        none = pool.limit(0)
        for name in ("uniform", "dsir", "full"):
            assert selectors.get_selector(name)(none, "sample_id").count() == 0

    def test_less_without_a_proxy(self, spark):
        few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "sample_id long, embedding array<double>")
        assert values(selectors.get_selector("less")(few, "sample_id", fraction=0.4), "sample_id") == [(3,), (4,)]

    def test_no_scores_no_outliers(self, spark):
        assert selectors.outliers(spark.createDataFrame([], "id long, score double")).count() == 0
        got = selectors.outliers(spark.createDataFrame([(1, None), (2, 3.0)], "id long, score double"))
        assert values(got, "id", "is_outlier") == [(1, False), (2, True)]

    def test_outliers_at_the_cut_are_outliers(self, spark):
        s = spark.createDataFrame([(i, 1.0) for i in range(4)], "sample_id long, score double")
        assert selectors.outliers(s).where("is_outlier").count() == 4

    def test_importance_gives_batches(self, spark):
        losses = spark.range(60).select("id", (F.col("id") % 5).alias("step"), (F.col("id") / 7).alias("loss"))
        pool = spark.range(80).select("id", (F.col("id") * 2).alias("x"))
        got = selectors.get_selector("importance_sampling")(pool, "id", losses=losses, batch=3, length=10)
        want = sampling.guarded_batches(losses, "id", "step", "loss", batch=3, length=10)
        assert values(got, "id", "step") == values(want, "id", "step") and got.count() == 15 and got.columns == ["id", "x", "step", "p", "weight"]

    def test_guards(self, spark):
        rows = [(i, float(i), "representative" if i < 3 else "redundant" if i < 9 else "outlier") for i in range(10)]
        s = spark.createDataFrame(rows, "sample_id long, score double, label string")
        assert values(selectors.kept_rows(s, "sample_id", least=2), "sample_id") == [(0,), (1,), (2,)]
        assert len(values(selectors.kept_rows(s, "sample_id", least=4), "sample_id")) == 9
        assert values(selectors.kept_rows(s, "sample_id", least=4, most=2), "sample_id") == [(0,), (1,)]

    def test_rho_leaves_the_holdout(self, spark):
        p = spark.range(40).withColumnRenamed("id", "sample_id")
        losses = p.withColumn("loss", F.col("sample_id").cast("double"))
        held = {r[0] for r in values(sampling.split_holdout(p, "sample_id").where("holdout"), "sample_id")}
        got = {r[0] for r in values(selectors.get_selector("rho_loss")(p, "sample_id", losses), "sample_id")}
        assert len(held) == 10 and len(got) == 8 and not held & got and got == set(sorted(set(range(40)) - held)[-8:])


class TestSampling:
    def test_probabilities_and_weights(self, spark):
        rows = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(60)], "id long, step long, loss double")
        p = sampling.softmax(rows.withColumn("tau", F.lit(0.5)), "loss", "tau", "step")
        assert all(abs(r[1] - 1) < 1e-9 for r in p.groupBy("step").agg(F.sum("p")).collect())
        b = sampling.importance_batches(rows, "id", "step", "loss").collect()
        assert len(b) == 12 and all(0 < r["weight"] <= 10 for r in b)

    def test_fallback_is_flat(self, spark):
        rows = spark.createDataFrame([(i, i % 2, float(i)) for i in range(40)], "id long, step long, loss double")
        b = sampling.importance_batches(rows, "id", "step", "loss", fallback=spark.createDataFrame([(1,)], "step long")).collect()
        assert {r["weight"] for r in b if r["step"] == 1} == {1.0} and len({r["p"] for r in b if r["step"] == 1}) == 1

    def test_variance_by_hand(self, spark):
        b = spark.createDataFrame([(0, x, 0.25) for x in (1.0, 2.0, 1.5, 0.5)], "step long, loss double, p double")
        assert abs(sampling.variance_reduction(b, "step", "loss", "p").first()["eta"] + 15) < 1e-5
        scaled = sampling.variance_reduction(b.withColumn("n", F.lit(4)), "step", "loss", "p", "n").first()["eta"]
        assert abs(scaled) < 1e-6
        assert sampling.variance_reduction(b.limit(1), "step", "loss", "p").count() == 0

    @pytest.mark.parametrize("descending", [False, True])
    def test_first_rows_stay_in_their_partitions(self, spark, descending):
        d = spark.createDataFrame([(None if i % 50 == 0 else float(i * 37 % 101), i % 160) for i in range(200)], "x double, id long").repartition(8).cache()
        way = F.desc if descending else F.asc
        for k in (0, 1, 43, 199, 200, 300):
            got, want = sampling.first_rows(d, k, "x", "id", descending=descending), d.orderBy(way("x"), way("id")).limit(k)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert sampling.hash_sample(d, "id", 100).select(F.spark_partition_id()).distinct().count() > 1

    @pytest.mark.parametrize("descending", [False, True])
    def test_the_kth_key_between_samples(self, spark, monkeypatch, descending):
        """With so few rows sorted that the key is closed in step by step; a third of the rows are equal."""
        monkeypatch.setattr(sampling, "FEW", 8)
        monkeypatch.setattr(sampling, "SAMPLE", 50)
        d = spark.createDataFrame([(float(i * 37 % 101) if i % 3 else 5.0, i if i % 3 else -1) for i in range(400)], "x double, id long").repartition(5).cache()
        way = F.desc if descending else F.asc
        for k in (1, 20, 133, 150, 399, 400):
            got, want = sampling.first_rows(d, k, "x", "id", descending=descending), d.orderBy(way("x"), way("id")).limit(k)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    def test_ema_in_many_blocks(self, spark):
        rng = np.random.default_rng(5)
        x = rng.normal(size=500)
        e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 3, None), ("b", 4, 2.0)], "k string, step long, eta double").repartition(7)
        s, path = x[0], []
        for v in x:
            s = 0.9 * s + 0.1 * v
            path.append(s)
        got = {r["k"]: r for r in sampling.ema(e, "k", "step", alpha=0.9).collect()}
        assert math.isclose(got["a"]["ema"], s) and got["a"]["steps"] == 500 and (got["b"]["ema"], got["b"]["steps"]) == (2.0, 1)
        run = values(sampling.running_ema(e.where("k = 'a'"), "k", "step", alpha=0.9), "step", "ema")
        assert np.allclose([v for _, v in run], path) and len(run) == 500

    def test_guard_closes_the_loop(self, spark):
        rng = np.random.default_rng(6)
        rows = [(10 * s + i, s, float(v)) for s in range(12) for i, v in enumerate(rng.uniform(1, 2, 10))]
        losses = spark.createDataFrame(rows, "id long, step long, loss double")
        plain = {r["step"]: r["eta"] for r in sampling.variance_reduction(sampling.importance_batches(losses, "id", "step", "loss"), "step", "loss", "p").collect()}
        s, path = plain[0], {}
        for step in sorted(plain):
            s = 0.95 * s + 0.05 * plain[step]
            path[step] = s
        threshold = sum(sorted(path.values())[5:7]) / 2
        first = min(k for k, v in path.items() if v < threshold)
        got = sampling.guarded_batches(losses, "id", "step", "loss", threshold=threshold).collect()
        assert {r["step"] for r in got if math.isclose(r["p"], 0.1)} == set(range(first + 1, 12)) and {r["weight"] for r in got if r["step"] > first} == {1.0}
        assert all(not math.isclose(r["p"], 0.1) for r in sampling.guarded_batches(losses, "id", "step", "loss", threshold=-1e30).collect())

    def test_ema(self, spark):
        e = spark.createDataFrame([("a", 2, 0.0), ("a", 1, 1.0), ("b", 1, 0.01)], "k string, step long, eta double")
        assert values(sampling.ema(e, "k", "step", alpha=0.5), "k", "ema", "use_uniform") == [("a", 0.5, False), ("b", 0.01, True)]

    def test_resample_follows_the_weights(self, spark):
        p = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, w double")
        n = dict(sampling.resample(p, "id", "w", 4000, least_buckets=3, draws_at_once=500).groupBy("id").count().collect())
        assert sum(n.values()) == 4000 and 0 not in n and all(abs(n[i] / 4000 - i / 10) < 0.03 for i in range(1, 5))

    def test_weighted_sample_skips_zero(self, spark):
        p = spark.createDataFrame([(i, float(i > 5)) for i in range(10)], "id long, w double")
        assert values(sampling.weighted_sample(p, "id", "w", 100), "id") == [(6,), (7,), (8,), (9,)]

    def test_excluded_rows_are_no_candidates(self, spark):
        p = spark.range(20)
        assert sampling.candidates(p, "id", 5, 4, exclude=p.where("id < 15")).count() == 5


class TestRecords:
    def test_alpaca(self, spark):
        d = spark.createDataFrame([(0, "Do", "", "x"), (1, "Do", "it", None), (2, None, None, "y")], "id int, instruction string, input string, output string")
        r = {x["id"]: x for x in records.normalize(d, "alpaca").collect()}
        assert "### Input:" not in r[0]["prompt"] and "### Input:\nit\n" in r[1]["prompt"] and r[1]["response"] == "" and r[2]["text"].endswith("### Response:\ny")

    def test_chats(self, spark):
        turns = [("system", "s"), ("user", "u"), ("assistant", ""), ("tool", "t"), ("assistant", "a")]
        d = spark.createDataFrame([Row(id=0, messages=[Row(role=r, content=c) for r, c in turns])], "id int, messages array<struct<role:string,content:string>>")
        g, c = records.sharegpt(d).first(), records.chatml(d).first()
        assert g["prompt"] == g["text"] == "### Human:\nu\n### Assistant:\n\n### Assistant:\na\n" and g["response"] == "a"
        assert c["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\na<|end|>\n" and c["text"] == c["prompt"] + "<|assistant|>\na<|end|>"
        s = records.sharegpt(d, strict=True).first()
        assert s["prompt"] == "### Human:\nu\n### Assistant:\n\n### Assistant:\n" and s["text"].endswith("a")

    def test_unknown_template_changes_nothing(self, pool):
        assert records.normalize(pool, "no_such").columns == pool.columns

    @pytest.mark.parametrize(
        ("text", "number"),
        [("so #### 1,234.5 or 7", 1234.5), ("1 then 2 then -3", -3.0), ("none", None), ("", None), ("12,34", 34.0), (None, None), ("####  -8 9", -8.0)],
    )
    def test_numbers(self, spark, text, number):
        assert spark.createDataFrame([(text,)], "t string").select(records.final_number(F.col("t"))).first()[0] == number

    def test_choices(self, spark):
        d = spark.createDataFrame([("q", ["a", "b", "c", "d", "e"]), ("q", ["a"])], "q string, c array<string>").select(records.choice_prompt(F.col("q"), F.col("c")))
        assert [r[0] for r in d.collect()] == ["Question: q\n\nA. a\nB. b\nC. c\nD. d\n\nAnswer:", "Question: q\n\nA. a\n\nAnswer:"]

    def test_validation_text(self, spark):
        d = spark.createDataFrame([("", "q", "a"), (None, "q", ""), (None, None, None)], "text string, question string, answer string")
        assert [r[0] for r in d.select(records.validation_text(d)).collect()] == ["Question: q\nAnswer: a", "q", ""]

    def test_tokens(self, spark):
        d = spark.createDataFrame([(0, "a b ", "c"), (1, "a b c d e", "f"), (2, "", "")], "id int, prompt string, response string")
        r = {x["id"]: x for x in tokens.tokenize(d, max_length=4).collect()}
        assert r[0]["labels"][:2] == [-100, -100] and r[0]["labels"][2] == r[0]["input_ids"][2]
        assert r[1]["labels"] == [-100] * 4 and r[2]["input_ids"] == []
        p = tokens.pad(tokens.tokenize(d, max_length=4).withColumn("batch", F.lit(0)), "batch", 8).collect()
        assert {len(x[c]) for x in p for c in ("input_ids", "attention_mask", "labels")} == {8}

    def test_grams(self, spark):
        d = spark.createDataFrame([("ab",), ("aBcd",), ("añ𝄞b\n",)], "t string").select(ngrams.char_ngrams(F.col("t")))
        assert [r[0] for r in d.collect()] == [[], ["abc", "bcd"], ["añ𝄞", "ñ𝄞b", "𝄞b\n"]]

    @pytest.mark.parametrize("n", [1, 2, 3, 4])
    def test_counts_and_weights_by_hand(self, spark, n):
        texts = ["abcabc", "aBcd", "añ𝄞b\n", "", None, "xyzxyz", "ab"]
        d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
        grams = [[t.lower()[i : i + n] for i in range(len(t) - n + 1)] for t in (x or "" for x in texts)]
        want = Counter(g for x in grams for g in x)
        got = {r["gram"]: r["cnt"] for r in ngrams.top_grams(ngrams.gram_counts(d, "t", n), 100, n).collect()}
        assert got == want
        some = ngrams.top_grams(ngrams.gram_counts(d, "t", n), 3, n).collect()
        assert [(r["gram"], r["cnt"]) for r in some] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
        for counters in (1, 2, 1000):
            top = ngrams.most_frequent(d, "t", 3, n, counters).collect()
            assert [(r["gram"], r["cnt"]) for r in top] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
        target = Counter(grams[0])
        ts, tt, v = sum(want.values()), sum(target.values()), len(want)
        ratio = {g: math.log(max((target[g] + 0.01 * ts) / (tt + 0.01 * ts * v), 1e-10) / max((want[g] + 0.01 * ts) / (ts + 0.01 * ts * v), 1e-10)) for g in want}
        raw = {r["id"]: r["raw"] for r in ngrams.gram_weights(d, d.where("id = 0"), "id", "t", n).collect()}
        assert all(math.isclose(raw[i], np.mean([ratio[g] for g in x]) if x else 0.0, abs_tol=1e-9) for i, x in enumerate(grams))

    @pytest.mark.parametrize("most_candidates", [2_000_000, 2])
    def test_frequent_long_grams_are_counted_again(self, spark, monkeypatch, most_candidates):
        monkeypatch.setattr(ngrams, "MOST_CANDIDATES", most_candidates)
        rng = np.random.default_rng(2)
        texts = ["".join(rng.choice(list("abcdefgh"), 30)) + "common phrase " * int(rng.integers(0, 4)) for _ in range(80)]
        d = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
        want = Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
        got = ngrams.most_frequent(d, "t", 8, 6, counters=150).collect()
        assert [(r["gram"], r["cnt"]) for r in got] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:8]


class TestInfluence:
    def fixture(self, spark, n=30, seed=0):
        rng = np.random.default_rng(seed)
        x, y = rng.normal(size=(n, 4)), rng.integers(0, 3, n)
        df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, embedding array<double>, label int")
        return x, y, df, [influence.Checkpoint(k, 0.1 * k, rng.normal(size=(3, 4))) for k in (1, 2)]

    @staticmethod
    def gradients(x, y, w):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        return np.einsum("ij,ik->ijk", p, x).reshape(len(y), -1)

    def test_self_influence(self, spark):
        x, y, df, points = self.fixture(spark)
        got = dict(influence.self_influence(df, "id", influence.SoftmaxScorer(), points, given_rates=True).collect())
        want = sum(c.lr / 0.3 * (self.gradients(x, y, c.params) ** 2).sum(1) for c in points)
        assert np.allclose([got[i] for i in range(30)], want)

    def test_validation_influence(self, spark):
        x, y, df, points = self.fixture(spark)
        valid = df.where("id < 10").withColumn("dim", F.when(F.col("id") < 5, "a").otherwise("b"))
        g = influence.mean_gradients(valid, "dim", influence.SoftmaxScorer(), points)
        got = influence.validation_influence(df, "id", influence.SoftmaxScorer(), points, g)
        rows = {(r["id"], r["dim"]): r["score"] for r in got.collect()}
        for name, at in (("a", slice(0, 5)), ("b", slice(5, 10))):
            want = np.zeros(30)
            for c in points:
                each = self.gradients(x, y, c.params)
                mean = each[at].mean(0)
                want += each @ mean / (np.linalg.norm(each, axis=1) * np.linalg.norm(mean)) / 2
            assert np.allclose([rows[i, name] for i in range(30)], want) and (np.abs(want) <= 1).all()
        for width, most_held, per_bucket in ((1, 1, 7), (3, 1, 100), (2, 200, 10), (4, 1 << 20, 4)):
            blocks = influence.mean_gradients(valid.repartition(3), "dim", influence.SoftmaxScorer(), points, width, most_held)
            assert blocks.count() == 2 * 2 * -(-4 // width) and {r["n"] for r in blocks.collect()} == {5}
            again = {(r["id"], r["dim"]): r["score"] for r in influence.validation_influence(df, "id", influence.SoftmaxScorer(), points, blocks, per_bucket=per_bucket, most_held=most_held).collect()}
            assert again.keys() == rows.keys() and all(abs(again[k] - rows[k]) < 1e-12 for k in rows)
        total = influence.multi_objective(got, "id", {"a": 0.7}).where("id = 3").first()
        assert abs(total["total_score"] - 0.7 * rows[3, "a"]) < 1e-12

    def test_weights(self, spark):
        s = spark.createDataFrame([(0, 0.5), (1, -2.0), (2, 0.0), (3, 0.05), (4, -0.05)], "id long, s double").withColumn("label", influence.classify(F.col("s")))
        assert [r[1] for r in values(s, "id", "label")] == ["proponent", "opponent", "neutral", "neutral", "neutral"]
        w = influence.initial_weights(s, "id", "s", "label")
        assert abs(w.agg(F.avg("weight")).first()[0] - 1) < 1e-12
        r = influence.reweighted(w, "id", "label", 2)
        assert abs(r.agg(F.sum("weight")).first()[0] - 1) < 1e-12
        by, first = dict((i, x) for i, x in values(r, "id", "weight")), dict(values(w, "id", "weight"))
        assert abs(by[0] / by[2] - 4 * first[0] / first[2]) < 1e-9
        every = influence.rounds(w, "id", "label", 4)
        assert all(np.allclose(values(every.where(f"round = {k}"), "id", "weight"), values(influence.reweighted(w, "id", "label", k), "id", "weight")) for k in range(5))
        assert values(influence.reweighted(w, "id", "label", 9), "id", "weight") == values(influence.reweighted(w, "id", "label", 4), "id", "weight")

    def test_pooled_means(self, spark):
        d = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (1, [[1.0, 2.0]], [0])], "id long, h array<array<double>>, m array<int>")
        assert values(d.select("id", vectors.masked_mean(F.col("h"), F.col("m")).alias("x")), "id", "x") == [(0, [2.0, 3.0]), (1, [0.0, 0.0])]
        rows = d.select("id", F.explode(F.arrays_zip("h", "m")).alias("t")).select("id", "t.h", "t.m")
        assert values(selectors.pooled(rows, "id", "h", "m"), "id", "h") == [(0, [2.0, 3.0]), (1, [0.0, 0.0])]
        pool = spark.range(4).withColumnRenamed("id", "sample_id")
        tokens_ = pool.crossJoin(spark.range(3).withColumnRenamed("id", "at")).select("sample_id", F.array(F.col("sample_id").cast("double"), F.lit(1.0)).alias("embedding"), (F.col("at") < 2).cast("int").alias("attention_mask"))
        proxy = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
        assert values(selectors.get_selector("less")(pool, "sample_id", fraction=0.5, proxy=proxy, tokens=tokens_), "sample_id") == [(2,), (3,)]

    def test_zero_vectors(self, spark):
        d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
        assert d.select(vectors.cosine(F.col("a"), F.col("b")), F.size(vectors.unit(F.col("a")))).first() == (0.0, 2)


class TestClusters:
    def test_the_cheapest_of_ten_starts(self, spark, monkeypatch):
        made = []

        class Counted(clusters.KMeans):
            def __init__(self, **how):
                made.append(how["seed"])
                super().__init__(**how)

        monkeypatch.setattr(clusters, "KMeans", Counted)
        d = spark.createDataFrame([(i, [float(i % 2), float(i)]) for i in range(6)], "id long, v array<double>")
        clusters.fit_clusters(d, "v", 2)
        assert made == list(range(42, 52))

    @staticmethod
    def families(seed=3, spread=0.3):
        rng = np.random.default_rng(seed)
        base = rng.normal(size=(12, 5))
        return np.vstack([b + spread * rng.normal(size=(10, 5)) for b in base])

    @pytest.mark.parametrize(("threshold", "leaf", "block"), [(0.95, 4096, 16), (0.95, 8, 5), (0.45, 8, 2048), (0.0, 8, 50)])
    def test_similar_pairs_and_greedy(self, spark, threshold, leaf, block):
        x = self.families()
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        cos = u @ u.T
        want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if cos[i, j] >= threshold)
        assert values(pairs.similar_pairs(df, "id", "v", threshold, leaf, block), "i", "j") == want
        kept = []
        for i in range(120):
            if not any(cos[i, k] >= threshold for k in kept):
                kept.append(i)
        gone = [r[0] for r in values(clusters.greedy_redundant(df, "id", "v", threshold), "id")]
        assert sorted(set(range(120)) - set(gone)) == kept

    def test_few_blocks_of_a_cell(self, spark, monkeypatch):
        """Rows are sent for each block of their cell: no more blocks with more rows, until a block is full."""
        assert [pairs.grid_parts(n, 64) for n in (1, 2049, 100_000, 390_000)] == [1, 2, 12, 12]
        assert 600_000 / pairs.grid_parts(600_000, 64) > 20_000 and pairs.grid_parts(10_000, 1 << 14) == 79
        monkeypatch.setattr(pairs, "TILE", (3, 5))
        rows = self.families(5, 0.2)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
        found = pairs.similar_pairs(df, "id", "v", -0.2, block=64)
        u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        assert values(found, "i", "j") == [(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= -0.2]

    def test_a_tree_saves_comparisons(self, spark):
        x = np.repeat(self.families(7, 0.05), 5, axis=0) + 0.001 * np.random.default_rng(1).normal(size=(600, 5))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        compared = pairs.sizes(pairs.cells(df, "id", "v", 0.999, leaf=40)).agg(F.sum("pairs")).first()[0]
        assert compared < 0.2 * 600 * 600
        homes = pairs.cells(df, "id", "v", 0.999, leaf=40).where("home")
        assert homes.count() == homes.select("id").distinct().count() == 600

    def test_equal_zero_and_null_vectors(self, spark):
        rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [-1.0, 0.0])]
        df = spark.createDataFrame(rows, "id long, v array<double>")
        assert values(pairs.similar_pairs(df, "id", "v", 0.95), "i", "j") == [(1, 2), (1, 5), (1, 6), (2, 5), (2, 6), (5, 6)]
        assert values(clusters.greedy_redundant(df, "id", "v", 0.95), "id") == [(2,), (5,), (6,)]
        assert pairs.similar_pairs(df.limit(0), "id", "v", 0.95).count() == 0 and clusters.greedy_redundant(df.limit(0), "id", "v").count() == 0

    @staticmethod
    def slow(x, k, distance):
        """Average linkage by trying all pairs of clusters."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            d, a, b = min((np.mean([1 - u[i] @ u[j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a))
            if len(groups) == k or distance is not None and d >= distance:
                break
            groups[b] += groups.pop(a)
        return sorted(sorted(g) for g in groups)

    @staticmethod
    def groups(df):
        by = {}
        for i, c in values(df, "id", "cluster"):
            by.setdefault(c, []).append(i)
        return sorted(sorted(g) for g in by.values())

    @pytest.mark.parametrize(("k", "threshold", "cell"), [(1, None, 1000), (4, None, 1000), (4, None, 5), (25, None, 1000), (None, 0.9, 1000), (None, 0.5, 3)])
    def test_average_linkage_by_trying_all(self, spark, k, threshold, cell):
        """In one task, and by joins of tables, whatever the partitions."""
        x = np.random.default_rng(4).normal(size=(25, 3))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        how = {"k": k} if k is not None else {"threshold": threshold}
        want = self.slow(x, k, None if threshold is None else 1 - threshold)
        found = clusters.linkage(df.repartition(3 if cell > 3 else 7), "v", cell=cell, **how)
        assert self.groups(found) == want
        for r in found.collect():
            mine = next(g for g in want if r["id"] in g)
            assert np.allclose(r["center"], x[mine].mean(0))

    def test_linkage_to_k_stores_no_pairs(self, spark, monkeypatch):
        """In small blocks and tiles, with ties, as by trying all; no table has a row for a pair of clusters."""
        monkeypatch.setattr(pairs, "TILE", (4, 7))
        monkeypatch.setattr(pairs, "BLOCK_BYTES", 8 * 3 * 9)
        sizes, write = [], tables.Workspace.written

        def counted(work, df, name):
            out = write(work, df, name)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(tables.Workspace, "written", counted)
        x = np.random.default_rng(9).normal(size=(60, 3)) + [2.0, 0.0, 0.0]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        assert self.groups(clusters.linkage(df, "v", k=5, cell=8)) == self.slow(x, 5, None)
        assert max(sizes) <= 60
        corners = [(i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]])]
        found = [self.groups(clusters.linkage(spark.createDataFrame(corners, "id long, v array<double>").repartition(n), "v", k=2, cell=2)) for n in (1, 4)]
        assert found[0] == found[1] and len(found[0]) == 2

    def test_linkage_joins_near_copies_at_once(self, spark, monkeypatch):
        """In a group of near copies one cluster grows and all others wait for it, which took a round of jobs for each join or two."""
        monkeypatch.setattr(pairs, "BLOCK_BYTES", 8 * 4 * 30)
        rounds, write = [], tables.Workspace.written
        monkeypatch.setattr(tables.Workspace, "written", lambda work, df, name: rounds.append(name) or write(work, df, name))
        rng = np.random.default_rng(3)
        copies = [1.0, 0.0, 0.0, 0.0] + np.geomspace(1e-4, 0.2, 24)[:, None] * np.c_[np.zeros(24), rng.normal(size=(24, 3))]
        x = np.vstack([copies, rng.normal(size=(16, 4))])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        assert self.groups(clusters.linkage(df, "v", k=6, cell=30)) == self.slow(x, 6, None)
        assert "copies" in rounds and rounds.count("pairs") <= 3

    def test_nearest_by_tiles(self, monkeypatch):
        """As by double precision alone: ties go to the smallest id, also where single precision can't tell; own and equal parts are left out."""
        monkeypatch.setattr(clusters, "TILE", (4, 7))
        monkeypatch.setattr(clusters, "EXACT", 5)
        rng = np.random.default_rng(8)
        x = np.vstack([rng.normal(size=(30, 6)), np.eye(6), np.eye(6)[:3], np.zeros((2, 6))])
        x = np.vstack([x, x[:9] + 1e-7 * rng.normal(size=(9, 6))])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        ids, part = np.sort(rng.choice(10**12, len(x), replace=False)) - 5 * 10**11, rng.integers(0, 4, len(x))
        s = np.round(np.einsum("ik,jk->ij", x, x), clusters.DIGITS)
        for split, parted in ((20, False), (len(x), False), (31, True), (len(x), True)):
            left, right = np.arange(split), np.arange(len(x)) if split == len(x) else np.arange(split, len(x))
            l, r = (clusters.Nearest(ids[k], x[k], part=part[k] if parted else None) for k in (left, right))
            clusters.meet(l, r, both=True)
            for mine, a, b in ((l, left, right), (r, right, left)):
                near = np.where(part[a, None] == part[None, b] if parted else a[:, None] == b[None], -np.inf, s[np.ix_(a, b)])
                assert (mine.s == near.max(1)).all() and (mine.o == ids[b[near.argmax(1)]]).all()
                copy = np.where(near >= clusters.ALIKE, ids[b][None], ids[a][:, None])
                assert (mine.low == np.minimum(copy.min(1), ids[a])).all()
        found = clusters.Nearest(ids, x, above=np.full(len(x), 0.8))
        clusters.meet(found, clusters.Nearest(ids, x))
        np.fill_diagonal(s, -np.inf)
        far = s.max(1) < 0.79
        assert (found.s[far] == -np.inf).all() and (found.s == s.max(1))[s.max(1) >= 0.8].all() and 0 < far.sum() < len(x)

    def test_joins_that_nothing_outside_comes_before(self):
        """Joins inside of a part, with what is outside as a bound, are some of the joins of all."""
        x = np.random.default_rng(6).normal(size=(80, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        part, ones = np.argmax(x, 1), np.ones(80)
        every = {(a, b) for a, b, _ in clusters.mutual(x, ones, -2.0)[0]}
        assert len(every) == 79
        for p in range(3):
            at = np.flatnonzero(part == p)
            outside = np.round(x[at] @ x[part != p].T, clusters.DIGITS).max(1)
            joins, left = clusters.mutual(x[at], ones[at], -2.0, outside)
            assert {(at[a], at[b]) for a, b, _ in joins} <= every and 0 < len(joins) < len(at) - 1 and len(left["at"]) == len(at) - len(joins)
            for i, o, s in zip(left["at"], left["o"], left["s"], strict=True):
                if not (o < 0 or left["joined"][left["at"] == i][0] or o in {a for j in joins for a in j[:2]}):
                    assert s == np.round(x[at[i]] @ x[at[o]], clusters.DIGITS)

    def test_linkage_of_equal_vectors(self, spark):
        many = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, float(i + 1)]) for i in range(90)] + [(90, [0.0, 0.0]), (91, [0.0, 0.0])], "id long, v array<double>")
        assert self.groups(clusters.linkage(many, "v", threshold=0.9)) == sorted([[i for i in range(90) if i % 3], [i for i in range(90) if not i % 3], [90, 91]])
        assert clusters.fit_clusters(many, "v", 2, "agglomerative").select("cluster").distinct().count() == 2
        assert clusters.linkage(many.limit(0), "v", k=3).count() == 0

    def test_connected_parts(self, spark):
        edges = [(1, 2), (2, 3), (7, 8), (9, 9), (20, 10), (10, 30), (30, 5), *[(100 + i, 101 + i) for i in range(40)], *[(500, 501 + i) for i in range(30)]]
        with tables.Workspace(spark, "test") as work:
            got = dict(values(graphs.connected(spark.createDataFrame(edges, "a long, b long"), work), "c", "part"))
        want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 20: 5, 10: 5, 30: 5, 5: 5} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(31)}
        assert got == want

    def test_default_number(self):
        assert [clusters.default_clusters(n) for n in (1, 2, 3, 100)] == [1, 1, 1, 10]

    def test_unknown_method(self, spark):
        with pytest.raises(ValueError, match="no such"):
            clusters.fit_clusters(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 1, "square")


class TestTables:
    def test_scores_can_be_written_again(self, spark, tmp_path):
        s = spark.createDataFrame([(1, 0.5, "a"), (2, 0.25, "b")], "id long, score double, dim string")
        for _ in range(2):
            tables.write_scores(s.where("dim = 'a'"), f"{tmp_path}/s", ["dim"])
            tables.write_scores(s.where("dim = 'b'"), f"{tmp_path}/s", ["dim"])
        assert values(tables.read_scores(spark, f"{tmp_path}/s"), "id", "score") == [(1, 0.5), (2, 0.25)]

    def test_checkpoints(self, spark, tmp_path):
        params = spark.createDataFrame([("base_model.model.layer.lora_A.default.weight", [1.0]), ("q.lora_B.weight", [2.0])], "name string, values array<double>")
        for step in (50, 100, 200):
            tables.write_checkpoint(params, f"{tmp_path}/c", step)
        found = spark.read.parquet(f"{tmp_path}/c")
        assert values(tables.retained(tables.checkpoint_steps(found), 2), "step") == [(100,), (200,)]
        names = spark.createDataFrame([("layer.lora_A.weight",), ("x.q.lora_B.weight",), ("none.at.all",)], "name string")
        assert values(tables.load_checkpoint(found, names, 50), "name", "values") == [("layer.lora_A.weight", [1.0]), ("x.q.lora_B.weight", [2.0])]
        assert tables.spread([300, 100, 200]) == [100, 200, 300] and tables.spread(range(0, 110, 10), 6) == [0, 20, 40, 60, 80, 100]

    def test_old_checkpoints_go(self, spark, tmp_path):
        params = spark.createDataFrame([("a", [1.0])], "name string, values array<double>")
        for step in (50, 100, 9):
            tables.write_checkpoint(params, f"{tmp_path}/c", step)
        (tmp_path / "c" / "step=odd").mkdir()
        assert tables.prune_checkpoints(spark, f"{tmp_path}/c", 2) == [50, 100]
        assert {p.name for p in (tmp_path / "c").glob("step=*")} == {"step=50", "step=100", "step=odd"}
        assert tables.prune_checkpoints(spark, f"{tmp_path}/none", 2) == []

    def test_finished_steps_are_read(self, spark, tmp_path):
        made = []

        def score(step):
            made.append(step)
            return spark.range(2).select("id", F.lit(float(step)).alias("x"))

        tables.resumed(spark, f"{tmp_path}/s", [1, 2], score)
        (tmp_path / "s" / "step=2" / "_SUCCESS").unlink()  # broken off
        assert values(tables.resumed(spark, f"{tmp_path}/s", [1, 2, 3], score), "step", "x") == [(1, 1.0), (1, 1.0), (2, 2.0), (2, 2.0), (3, 3.0), (3, 3.0)]
        assert made == [1, 2, 2, 3]

    def test_toy_pool(self, spark):
        rows = {r["sample_id"]: r for r in tables.toy_pool(spark, 41).collect()}
        assert rows[20]["output"] == rows[40]["output"] == tables.REFUSAL != rows[0]["output"]
        half = rows[15]["instruction"][: len(rows[15]["instruction"]) // 2]
        assert rows[15]["instruction"] == f"{half} {half}"

    def test_catalog(self, spark, pool):
        c = tables.validation_catalog({"a": pool, "b": pool.limit(0)}, 7)
        assert values(c.groupBy("dim").count(), "dim", "count") == [("a", 7)]

    def test_pool_and_results(self, spark, pool, tmp_path):
        pool.withColumn("split", F.lit("train")).write.partitionBy("split").parquet(f"{tmp_path}/p")
        assert tables.read_pool(spark, f"{tmp_path}/p", "train", 5).count() == 5
        tables.write_results(evaluation.evaluate(spark, ["humaneval", "none"], {}), f"{tmp_path}/r")
        assert spark.read.json(f"{tmp_path}/r").count() == 1


class TestEvaluation:
    def test_accuracy(self, spark):
        d = spark.createDataFrame([("s", [0.1, 0.9, 0.9], 1), ("s", [0.5, 0.1, 0.1], 2)], "subject string, scores array<double>, answer int")
        assert values(evaluation.choice_accuracy(d), "subject", "accuracy", "total") == [(None, 0.5, 2), ("s", 0.5, 2)]
        n = spark.createDataFrame([("#### 5", "5"), ("x", "5"), ("4", "5")], "said string, truth string")
        assert evaluation.number_accuracy(n).first() == (1 / 3, 1, 3)
        assert evaluation.number_accuracy(n.limit(0)).first() == (0.0, 0, 0)


class TestStreams:
    def test_stream_and_batch_agree(self, spark, tmp_path):
        rows = spark.range(200).select(
            F.col("id").alias("event_id"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.sin("id") + 1).alias("x")
        )
        rows.repartition(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        averages.run_to_table(averages.moving_averages(stream, "key", "ts", "x", "event_id"), f"{tmp_path}/out", f"{tmp_path}/state")
        got = {r["key"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        want = {r["key"]: r for r in sampling.ema(rows, "key", "event_id", "x").collect()}
        assert all(math.isclose(got[k]["ema"], want[k]["ema"]) and got[k]["steps"] == want[k]["steps"] for k in want) and len(got) == 3

    def test_events_in_a_folder_are_all_read(self, spark, tmp_path):
        from sievework.plans import evaluation_queries as q

        rows = spark.range(90).selectExpr("id as event_id", "timestamp_seconds(1704067200 + 97 * id) as ts", "concat('k', id % 2) as event_type", "cast(id as double) as value")
        rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
        rows.write.parquet(f"{tmp_path}/other_events.parquet")
        assert q.streaming_windows(spark, str(tmp_path)).agg({"n": "sum"}).first()[0] == 90
        assert values(q.streaming_ema(spark, str(tmp_path)), "event_type", "steps") == [("k0", 45), ("k1", 45)]

    def test_hooks(self, spark, tmp_path):
        rows = spark.range(6).selectExpr("'k' as key", "timestamp_seconds(1704067200 + id) as ts", "1.0D as x")
        rows.repartition(6, "ts").write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/in")
        stream, seen = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), []
        averages.run_to_table(averages.windowed(stream, "ts", "key", "x"), f"{tmp_path}/out", f"{tmp_path}/state", hooks=[(2, seen.append), (3, lambda k: seen.append(-k))])
        assert seen[:3] == [2, -3, 4]

    def test_missed_rows_are_an_error(self, spark, tmp_path):
        rows = spark.range(4).selectExpr("'k' as key", "timestamp_seconds(1704067200) as ts", "1.0D as x")
        rows.write.parquet(f"{tmp_path}/in")
        stream = averages.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "key", "x")
        with pytest.raises(ValueError, match="4 rows of 5"):
            averages.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state", rows=5)


class TestQuantiles:
    @pytest.fixture
    def small(self, monkeypatch):
        """Few values are sorted at once, and sketches are small, so that brackets are drawn again and again."""
        monkeypatch.setattr(quantiles, "FEW", 20)
        monkeypatch.setattr(quantiles, "SKETCH", 64)
        monkeypatch.setattr(quantiles, "SLACK", 0.02)

    @pytest.mark.parametrize("kind", ["normal", "ties", "one", "steps"])
    def test_as_numpy(self, spark, small, kind):
        rng = np.random.default_rng(5)
        x = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(500, 2.5), "steps": np.repeat([1.0, 1.0 + 1e-12, 7.0], [900, 900, 900])}[kind]
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(6)
        shares = [0.0, 0.05, 0.333, 0.5, 0.95, 0.9501, 1.0]
        assert np.allclose(quantiles.percentiles(df, "x", shares), np.quantile(x, shares), rtol=0, atol=1e-13)
        ranks = [0, 17, 18, len(x) // 2, len(x) - 1, 17]
        assert quantiles.order_statistics(df, "x", ranks) == np.sort(x)[ranks].tolist()

    def test_cases(self, spark):
        none = spark.createDataFrame([(None,)], "x double")
        assert quantiles.percentiles(none, "x", [0.5]) == [None] and quantiles.order_statistics(none, "x", []) == []
        one = spark.createDataFrame([(3,)], "x int")
        assert quantiles.percentiles(one, "x", [0.0, 0.7, 1.0]) == [3.0, 3.0, 3.0]
        with pytest.raises(ValueError, match="there are 1 values"):
            quantiles.order_statistics(one, "x", [1])
        with pytest.raises(ValueError, match="between 0 and 1"):
            quantiles.percentiles(one, "x", [1.5])


class TestArraySums:
    def test_by_hand(self, spark, monkeypatch):
        rng = np.random.default_rng(2)
        rows = [(int(k), int(w), rng.normal(size=4).tolist()) for k, w in zip(rng.integers(0, 5, 200), rng.integers(0, 3, 200), strict=True)]
        df = spark.createDataFrame([*rows, (1, 1, None)], "k int, w int, v array<double>").repartition(4)
        for keys in (["k"], []):
            got = {tuple(r[k] for k in keys): (r["n"], r["total"]) for r in array_sums.array_sums(df, keys, "v", F.col("w")).collect()}
            for key, (n, total) in got.items():
                mine = [(w, v) for k, w, v in rows if not keys or k == key[0]]
                assert n == sum(w for w, _ in mine) and np.allclose(total, sum(w * np.array(v) for w, v in mine))
            assert len(got) == (5 if keys else 1)
        assert array_sums.array_sums(df.limit(0), ["k"], "v").count() == 0


class TestTokenLoss:
    def rows(self, seed=1, n=60):
        rng = np.random.default_rng(seed)
        rows = []
        for i in range(n):
            ids = rng.integers(0, 7, rng.integers(0, 12)).tolist()
            rows.append((i, ids, [-100 if rng.random() < 0.3 else t for t in ids]))
        return [*rows, (n, None, None), (n + 1, [3], [3]), (n + 2, [6, 6, 6], [6, None, 6])]

    @staticmethod
    def slow(train, rows, order, vocabulary):
        count, follow = {}, {}
        places = lambda ids, labels: [(tuple([vocabulary] * order + ids[:i]), labels[i]) for i in range(1, len(ids or [])) if labels[i] not in (None, -100)]
        for _, ids, labels in train:
            for context, w in places(ids, labels):
                for k in range(order):
                    h = context[len(context) - k :]
                    count.setdefault(h, {}).setdefault(w, 0)
                    count[h][w] += 1
        out = {}
        for i, ids, labels in rows:
            each = []
            for context, w in places(ids, labels):
                p = 1 / vocabulary
                for k in range(order):
                    seen = count.get(context[len(context) - k :])
                    if seen:
                        p = (seen.get(w, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
                each.append(-math.log(p))
            out[i] = (sum(each) / len(each) if each else None, len(each))
        return out

    @pytest.mark.parametrize("order", [1, 2, 3, 4])
    def test_by_hand(self, spark, order, monkeypatch):
        monkeypatch.setattr(token_loss, "OFTEN", 3)
        rows, train = self.rows(), self.rows(9, 25)
        frame = lambda x: spark.createDataFrame(x, "id long, input_ids array<int>, labels array<int>").repartition(4)
        for of in (train, rows, []):
            got = token_loss.token_losses(frame(rows), "id", token_loss.fit(frame(of), order, 7))
            want = self.slow(of, rows, order, 7)
            found = {r["id"]: (r["loss"], r["tokens"]) for r in got.collect()}
            assert found.keys() == want.keys()
            for i, (loss, n) in want.items():
                assert found[i][1] == n and (loss is None and found[i][0] is None or abs(found[i][0] - loss) < 1e-9)

    def test_a_large_batch_is_handled_in_parts(self):
        """What is held beside a batch does not grow with its rows."""
        coding, peaks = token_loss.Coding(), []
        for rows in (2_000, 10_000):
            x = pa.array([[7, 8, 9] * 50] * rows, pa.list_(pa.int32()))
            batch = pa.RecordBatch.from_arrays([x, x], ["input_ids", "labels"])
            tracemalloc.start()
            n = [len(coding.grams(b.column(0), b.column(1))[0]) for b in token_loss.slices([batch], 0)]
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert sum(n) == 149 * rows
        assert peaks[1] < 1.2 * peaks[0]
        x = pa.array([None, [1] * token_loss.TOKENS, [], [1, 2], [3] * (token_loss.TOKENS + 5), None, [4]], pa.list_(pa.int32()))
        found = list(token_loss.slices([pa.RecordBatch.from_arrays([x], ["x"])], 0))
        assert [r for b in found for r in b.column(0).to_pylist()] == x.to_pylist() and len(found) == 4

    def test_the_holdout_is_the_reference(self, spark):
        rows = spark.createDataFrame(self.rows(3, 200), "id long, input_ids array<int>, labels array<int>")
        model = token_loss.fit(rows, 2, 7)
        kept = selectors.get_selector("rho_loss")(rows, "id", fraction=0.1, model=model)
        held = sampling.split_holdout(rows, "id").where("holdout")
        losses = [dict(values(token_loss.token_losses(rows, "id", m), "id", "loss")) for m in (model, token_loss.fit(held, 2, 7))]
        out = {r["id"] for r in held.collect()}
        score = {i: losses[0][i] - losses[1][i] for i in losses[0] if losses[0][i] is not None and i not in out}
        assert {r["id"] for r in kept.collect()} == set(sorted(score, key=lambda i: (score[i], i))[-20:])
        with pytest.raises(ValueError, match="needs losses"):
            selectors.get_selector("rho_loss")(rows, "id")

    def test_bad_ids(self, spark):
        with pytest.raises(ValueError, match="do not fit"):
            token_loss.Coding(5, 32_000)
        coding = token_loss.Coding(2, 4)
        for ids, labels in (([[4]], [[0]]), ([[0, -1]], [[0, 1]]), ([[0, 1]], [[0]]), ([[0, 1]], [[0, 9]])):
            with pytest.raises(ValueError):
                coding.grams(pa.array(ids), pa.array(labels))


class TestStreamedBatches:
    HOW = {"batch": 2, "multiplier": 3, "length": 30}

    def steps(self, **more):
        return batches.Steps("id", "step", "loss", "at", F.timestamp_seconds((F.col("step") + 1) * 60 + 480_000), how=self.HOW, **more)

    @pytest.fixture
    def rows(self, spark):
        rng = np.random.default_rng(6)
        rows = [(1000 * k + i, k, float(rng.gamma(2.0)), 60 * k + int(rng.integers(0, 60))) for k in range(24) for i in range(int(rng.integers(1, 15)))]
        rows += [(77_000, None, 1.0, 5), (77_001, 3, None, 190)]
        return spark.createDataFrame(rows, "id long, step long, loss double, sec long").withColumn("at", F.timestamp_seconds(F.col("sec") + 480_000)).drop("sec")

    @pytest.mark.parametrize("threshold", [-1e9, 0.5, -3.0])
    def test_as_the_batch_form(self, spark, rows, tmp_path, threshold):
        own, steps = batches.session(spark), self.steps(threshold=threshold)
        for k in range(3):  # stopped and taken up again
            rows.where(f"floor((unix_timestamp(at) - 480000) / 480) = {k}").write.mode("append").parquet(f"{tmp_path}/in")
            batches.run(own.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), steps, f"{tmp_path}/out", f"{tmp_path}/state")
        closed = batches.batches(own, f"{tmp_path}/out").select("step").distinct().count()
        assert 0 < closed < 24
        batches.finish(own, steps, f"{tmp_path}/out", f"{tmp_path}/state")
        got = batches.batches(own, f"{tmp_path}/out")
        want = sampling.guarded_batches(rows.where("step is not null and loss is not null"), "id", "step", "loss", threshold=threshold, **self.HOW)
        plain = lambda df: sorted((r["step"], r["id"], round(r["p"], 9), r["n"], round(r["weight"], 9)) for r in df.collect())
        assert plain(got) == plain(want)
        ema, first = batches.last_state(own, f"{tmp_path}/out")
        assert (first is None) == (threshold == -1e9) and ema is not None
        figures = sampling.step_stats(got).collect()
        assert len(figures) == 24 and all(r["rows"] <= 2 and r["candidates"] <= 6 for r in figures)

    def test_open_steps_begin_a_new_stream(self, spark, rows, tmp_path):
        own, steps = batches.session(spark), self.steps(threshold=-1e9)
        first = rows.where("step < 5 or step = 5 and id % 2 = 0")
        first.write.parquet(f"{tmp_path}/a")
        batches.run(own.readStream.schema(rows.schema).parquet(f"{tmp_path}/a"), steps, f"{tmp_path}/out", f"{tmp_path}/state")
        left = batches.open_candidates(own, f"{tmp_path}/state")
        assert {r["step"] for r in left.collect()} >= {5}
        rows.where("step > 5 or step = 5 and id % 2 = 1").write.parquet(f"{tmp_path}/b")
        batches.run(own.readStream.schema(rows.schema).parquet(f"{tmp_path}/b"), steps, f"{tmp_path}/more", f"{tmp_path}/state2", initial=left)
        batches.finish(own, steps, f"{tmp_path}/more", f"{tmp_path}/state2")
        got = batches.batches(own, f"{tmp_path}/out").unionByName(batches.batches(own, f"{tmp_path}/more"))
        want = sampling.guarded_batches(rows.where("step is not null and loss is not null"), "id", "step", "loss", threshold=-1e9, **self.HOW)
        assert values(got, "step", "id") == values(want, "step", "id")


class TestFoldedAverages:
    def test_over_micro_batches(self, spark, tmp_path):
        rng = np.random.default_rng(8)
        rows = [(f"k{rng.integers(0, 3)}", i, float(rng.normal()), i) for i in range(300)] + [("gone", 5, 1.0, 500), ("k0", 7, None, 501)]
        df = spark.createDataFrame(rows, "key string, sec long, x double, id long").withColumn("at", F.timestamp_seconds("sec"))
        for k in range(3):
            df.where(f"floor(sec / 100) = {k}").write.mode("append").parquet(f"{tmp_path}/in")
            averages.fold_averages(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "key", "at", "x", "id", f"{tmp_path}/out", f"{tmp_path}/state", alpha=0.9, forget="150 seconds")
        want = {}
        for key, _, x, _ in sorted(rows[:300], key=lambda r: r[1]):
            ema, n = want.get(key, (None, 0))
            want[key] = (x if ema is None else 0.9 * ema + 0.1 * x, n + 1)
        got = {r["key"]: (r["ema"], r["steps"]) for r in averages.averages(spark, f"{tmp_path}/out").collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


class TestScalarClusters:
    @staticmethod
    def cost(parts):
        return sum(((p - p.mean()) ** 2).sum() for p in parts)

    @pytest.mark.parametrize("k", [1, 2, 3, 5, 11, 20])
    def test_by_trying_all_cuts(self, spark, k):
        x = np.sort(np.random.default_rng(3).normal(size=11)) ** 3
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(90, None), (91, float("nan"))], "id long, x double").repartition(4)
        best = min(self.cost([x[a:b] for a, b in itertools.pairwise((0, *c, 11))]) for c in itertools.combinations(range(1, 11), min(k, 11) - 1))
        rows = scalar_clusters.scalar_kmeans(df, "x", k).collect()
        by = {}
        for r in rows:
            by.setdefault(r["cluster"], []).append(r["x"])
        by.pop(None)
        assert abs(self.cost([np.array(v) for v in by.values()]) - best) < 1e-9 and len(by) == min(k, 11)
        assert all(abs(r["center"] - np.mean(by[r["cluster"]])) < 1e-9 for r in rows if r["cluster"] is not None)
        assert {r["id"] for r in rows if r["cluster"] is None} == {90, 91}

    def test_cuts_of_many_bins(self):
        x = np.sort(np.concatenate([np.random.default_rng(1).normal(c, 0.2, 60) for c in (0, 1e6, 1e6 + 3)]))
        bins = np.stack([x, x, np.ones(180), x, x * x], axis=1)
        assert scalar_clusters.best_cuts(bins, 3).tolist() == [0, 60, 120]
        # as a plain dynamic program has it
        best = [self.cost([x[:j]]) if j else 0.0 for j in range(181)]
        for _ in range(6):
            best = [min((best[i] + self.cost([x[i:j]]) for i in range(j) if math.isfinite(best[i])), default=math.inf) if j else math.inf for j in range(181)]
        cuts = scalar_clusters.best_cuts(bins, 7)
        assert abs(self.cost([x[a:b] for a, b in itertools.pairwise((*cuts, 180))]) - best[180]) < 1e-3

    def test_partitions_and_bins(self, spark):
        rng = np.random.default_rng(9)
        x = np.concatenate([rng.normal(size=3000), rng.normal(5, 0.001, 3000), [0.0, -0.0, -1e9, 1e9]])
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
        found = scalar_clusters.histogram(df, "x", 200)
        assert found[:, 2].sum() == len(x) and (found[1:, 0] > found[:-1, 1]).all() and found[:, 2].max() <= len(x) / 200 + 1 and len(found) < 6000
        first = values(scalar_clusters.scalar_kmeans(df, "x", 40, 200), "id", "cluster")
        assert values(scalar_clusters.scalar_kmeans(df.repartition(7), "x", 40, 200), "id", "cluster") == first
        assert scalar_clusters.scalar_kmeans(df.limit(0), "x", 3).count() == 0


class TestPositions:
    @pytest.fixture
    def rows(self, spark, tmp_path):
        for k, n in enumerate((3, 0, 5, 2)):
            spark.range(100 * k, 100 * k + n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/part={k}")
        return positions.read_numbered(spark, f"{tmp_path}/t")

    def test_numbers_over_files(self, rows):
        assert values(rows, "position", "id") == list(enumerate([0, 1, 2, 200, 201, 202, 203, 204, 300, 301]))
        assert values(positions.rows_between(rows, 2, 4), "id") == [(2,), (200,)]

    def test_gathered(self, spark, rows):
        wanted = spark.createDataFrame([(0, 9), (1, -1), (2, 0), (3, 9), (4, -10)], "place int, position long")
        got = positions.gathered(rows, wanted)
        assert [r["id"] for r in got.collect()] == [301, 301, 0, 301, 0]
        with pytest.raises(IndexError):
            positions.gathered(rows, spark.createDataFrame([(0, 10)], "place int, position long"))

    def test_joined(self, spark, rows):
        values_ = rows.select("position", (F.col("id") + 1).alias("v"))
        assert all(r["v"] == r["id"] + 1 for r in positions.with_column_by_position(rows, values_, "v").collect())
        with pytest.raises(ValueError, match="10 rows on the left and 9"):
            positions.joined_by_position(rows, values_.where("position > 0"))
        with pytest.raises(ValueError, match="there is a column"):
            positions.with_column_by_position(rows, values_, "id")


class TestArchives:
    @pytest.fixture
    def own(self, spark):
        archives.register(spark)
        return spark

    ROWS = [(i, step, dim, i / 7 + step, "kept" if i % 3 else None) for step in (1, 5, 20) for dim in ("a", "b c") for i in range(7)]

    def write(self, own, path, rows, mode="append", about=None):
        df = own.createDataFrame(rows, archives.SCORES).repartition(3)
        writer = df.write.format("score_archive").mode(mode)
        (writer.option("about", about) if about else writer).save(path)

    def test_round_trip(self, own, tmp_path):
        path = f"{tmp_path}/x"
        self.write(own, path, self.ROWS, about='{"seed": 7}')
        found = own.read.format("score_archive").load(path)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(self.ROWS, key=str) and archives.about(path) == {"seed": 7}
        for where, keep in (("dim = 'b c'", lambda r: r[2] == "b c"), ("step > 1 and step <= 5", lambda r: r[1] == 5), ("step in (1, 20) and score > 3", lambda r: r[1] != 5 and r[3] > 3), ("step = 2", lambda r: False)):
            assert sorted(map(tuple, found.where(where).collect()), key=str) == sorted(filter(keep, self.ROWS), key=str)
        self.write(own, path, self.ROWS[:5], "overwrite")
        assert own.read.format("score_archive").load(path).count() == 5

    def test_filters_choose_files(self):
        reader = archives.ScoreReader("/nowhere")
        left = list(reader.pushFilters([archives.EqualTo(("step",), 3), archives.GreaterThan(("score",), 0.5), archives.In(("dim",), ("a",))]))
        assert [type(f) for f in left] == [archives.GreaterThan] and len(reader.tests) == 2

    def test_a_broken_job_leaves_nothing(self, own, tmp_path):
        path = f"{tmp_path}/x"
        self.write(own, path, self.ROWS)
        with pytest.raises(Exception, match="cannot name an archive"):
            self.write(own, path, [*self.ROWS, (1, 1, "a,b", 0.0, None)])
        assert own.read.format("score_archive").load(path).count() == len(self.ROWS)
        assert not [x for x in (tmp_path / "x").iterdir() if x.name.startswith("_job")]

    def test_other_files_are_passed_over(self, own, tmp_path):
        path = f"{tmp_path}/x"
        self.write(own, path, self.ROWS)
        for name in ("notes.npz", "step=x,dim=a,00.npz", "_job-1/step=1,dim=a,00.npz"):
            (tmp_path / "x" / name).parent.mkdir(exist_ok=True)
            (tmp_path / "x" / name).write_bytes(b"no archive")
        assert own.read.format("score_archive").load(path).count() == len(self.ROWS)
        assert archives.about(f"{tmp_path}") == {} and own.read.format("score_archive").load(f"{tmp_path}/none").count() == 0

    def test_arrow_tasks_by_bytes(self, tmp_path, monkeypatch):
        batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 1000] * 100)], ["id", "t"])
        with pa.OSFile(f"{tmp_path}/a.arrow", "wb") as f, pa.ipc.new_file(f, batch.schema) as out:
            for _ in range(10):
                out.write_batch(batch)
        monkeypatch.setattr(archives, "TASK_BYTES", 250_000)
        reader = archives.ArrowReader(str(tmp_path), archives.arrow_schema(str(tmp_path)), 100_000)
        assert [p.batches for p in reader.partitions()] == [(k, k + 2) for k in range(0, 10, 2)]
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1000

    def test_checkpoint_folders(self, tmp_path):
        for name, whole in (("checkpoint-100", True), ("checkpoint-20", True), ("checkpoint-x", True), ("checkpoint-7", False), ("other-3", True)):
            (tmp_path / name).mkdir()
            if whole:
                (tmp_path / name / "adapter_config.json").write_text("{}")
        assert list(archives.adapter_checkpoints(str(tmp_path))) == [20, 100] and archives.adapter_checkpoints(f"{tmp_path}/none") == {}

    def test_arrow_files(self, own, tmp_path):
        path = f"{tmp_path}/a"
        t = pa.table({"id": list(range(1000)), "t": [f"text {i}" if i % 5 else None for i in range(1000)], "v": [[float(i)] for i in range(1000)]})
        (tmp_path / "a").mkdir()
        with pa.OSFile(f"{path}/one.arrow", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t, max_chunksize=100)
        with pa.OSFile(f"{path}/two.arrow", "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, max_chunksize=300)
        df = archives.arrow_scan(own, path, ["t", "id"])
        assert df.columns == ["t", "id"] and values(df.where("t is not null").groupBy("id").count(), "id", "count") == [(i, 2) for i in range(1000) if i % 5]
        reader = archives.ArrowReader(path, df.schema, 250)
        assert [p.batches for p in reader.partitions()] == [(0, 3), (3, 6), (6, 9), (9, 10), None]
        assert values(archives.arrow_scan(own, path), "id", "v") == sorted([(i, [float(i)]) for i in range(1000)] * 2)
        own.createDataFrame([(1, "x")], "id long, t string").write.format("arrow_ipc").mode("append").save(f"{tmp_path}/b")
        assert values(archives.arrow_scan(own, f"{tmp_path}/b"), "id", "t") == [(1, "x")]
        with pytest.raises(FileNotFoundError):
            archives.arrow_scan(own, f"{tmp_path}/none")
