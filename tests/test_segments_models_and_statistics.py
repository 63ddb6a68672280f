import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftcorpus.functions import distributions as D
from weftcorpus.functions import rules
from weftcorpus.functions.segment import Trie, costs, segmented, word_ngrams
from weftcorpus.operators import models, tracking, training
from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.diversity import TemplateRateEvaluator
from weftcorpus.operators.scorers import FactualityEvaluator
from weftcorpus.operators.slots import Matcher, needed, spans, spans_native
from weftcorpus.plans.pipeline import DataPipeline
from weftcorpus.sources import records
from weftcorpus.sources.shared import read_text, write_text


# words


def cheapest(text, words, unknown):
    """The least cost over all ways to cut a text."""
    best = None
    for cuts in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[last:i])
                last = i
        parts.append(text[last:])
        price = [min(words.get(p, unknown), unknown) if len(p) == 1 else words.get(p) for p in parts]
        if None not in price and (best is None or sum(price) < best):
            best = sum(price)
    return best


def test_segments_are_the_cheapest_path(spark):
    random.seed(3)
    words = {"".join(random.choice("abc") for _ in range(random.randrange(1, 4))): random.randrange(1, 30) for _ in range(14)}
    trie = Trie(words, 25)
    for _ in range(120):
        text = "".join(random.choice("abcd") for _ in range(random.randrange(1, 10)))
        got = trie.words(text)
        assert "".join(got) == text
        assert sum(min(words.get(w, 25), 25) if len(w) == 1 else words[w] for w in got) == cheapest(text, words, 25)
    assert Trie({"ab": 2, "a": 1, "b": 1}, 9).words("ab") == ["ab"] and Trie({}, 5).words("") == []
    assert costs({"a": 1, "b": 3, "c": 0}) == {"a": 1386, "b": 288}
    df = spark.createDataFrame([("手机价格",), ("",), (None,)], "t string").select(segmented(F.col("t"), {"手机": 10, "价格": 10}).alias("w"))
    assert [r.w for r in df.collect()] == [["手机", "价格"], [], []]
    assert df.select(word_ngrams(F.col("w"), 2).alias("g")).first().g == [["手机", "价格"]]


# spans


def test_literals_that_a_match_needs():
    assert needed("(?:今天|明天)") == ["今天", "明天"] and needed(r"\d+\s*元") == ["元"] and needed(r"\d+") is None
    assert needed("ab?c") == ["a"] and needed("(?:a|b)?c") == ["c"] and needed(r"(?:x|\d)y") == ["y"]
    for patterns in rules.SLOTS.values():
        for p in patterns:
            need = needed(p)
            assert need is None or need and all(need)


def test_one_pass_finds_what_each_pattern_finds(spark):
    random.seed(9)
    bits = "售价 ：199 元 ¥1,299.00 满300减50 华为 现货 优惠 50 2024年5月1日 明天 下周三 还剩 3 件 买2送1 8.5折 Nike coupon：abc 库存：5 到货：三天 活动截止5月1日 \x00 😀 天内 3天内 最后 9 OPPO vivo 。".split(" ")
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(0, 14))) for _ in range(300)] + ["", None, "华为现货"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(spans(F.coalesce("t", F.lit(""))).alias("a"), spans_native(F.coalesce("t", F.lit(""))).alias("b")).collect()
    assert sum(len(r.a) for r in rows) > 300 and all(r.a == r.b for r in rows)
    # patterns that look at borders go text by text
    m = Matcher({"k": ["^a+", r"b\b", "c."]})
    assert m.spans(["aab", "ab c", "", "cax"]) == [[(0, 2, 0), (2, 3, 0)], [(0, 1, 0), (1, 2, 0)], [], [(0, 2, 0)]]


# statistics of a run


def test_observed_statistics_are_those_of_the_steps(spark, tmp_path):
    text = "这款 手机 价格 实在，屏幕 清楚，电池 耐用，适合 长辈 日常 使用，售价：199元。"
    rows = [(1, text, "p", "r" * 30), (2, text, "p", None), (3, "短", None, None), (4, None, None, None), (5, "哈" * 40, None, None), (6, "另一款 电脑 适合 办公 出差 携带，重量 不大，键盘 手感 也好，现货 明天 到。", None, "")]
    df = spark.createDataFrame(rows, "row_id long, text string, prompt string, response string")
    config = {"template_rewrite": {"enabled": True}}
    p = DataPipeline(config)
    got = {(r.step, r.metric): r.value for r in p.statistics(df).collect()}
    out, stats = p.transform(df)
    for step, one in stats.items():
        for k, v in one.first().asDict(recursive=True).items():
            for name, value in ({f"{k}.{x}": y for x, y in v.items()} if isinstance(v, dict) else {k: v}).items():
                assert got[step, name] == pytest.approx(value), (step, name)
    # nothing left to observe
    none = {(r.step, r.metric): r.value for r in p.statistics(df.where("false")).collect()}
    assert none["dedup", "original_count"] == 0 and none["quality_filter", "filtered_count"] == 0
    write_text(f"{tmp_path}/in.jsonl", "\n".join('{"text": "%s"}' % t for t in (text, text, "短")))
    report = DataPipeline().run(spark, f"{tmp_path}/in.jsonl", f"file:{tmp_path}/out.jsonl")
    assert (report["input_count"], report["output_count"]) == (3, 1) and records.load_json(f"file:{tmp_path}/out_stats.json")["steps"]["dedup"][0]["removed_count"] == 1
    assert read_text(f"file:{tmp_path}/in.jsonl") == read_text(f"{tmp_path}/in.jsonl")


# models


def test_a_model_is_loaded_once_a_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return "m"

    def answer(model, prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("boom")
        return [f"{model}{len(p) % 5 + 1}" for p in prompts]

    judge = models.model_column(f"test-{id(loads)}", load, answer, batch_size=7)
    df = spark.createDataFrame([(i, "boom" if i % 50 == 0 else "x" * i) for i in range(200)], "row_id long, response string").repartition(16)
    for _ in range(2):
        got = {r.row_id: r.a for r in df.select("row_id", judge(F.col("response")).alias("a")).collect()}
        assert got == {i: None if i % 50 == 0 else f"m{i % 5 + 1}" for i in range(200)}
    # local[4]: a few workers, not a load for each of 32 tasks
    assert 1 <= loads.value <= 8
    scored = FactualityEvaluator(judge=judge).score(df)
    assert scored.where("judge_status = 'parsed'").count() + scored.where("judge_status = 'no_answer'").count() == 200
    rewards = training.scored_rewards(df.withColumn("prompt", F.lit("p")), models.model_column("len", dict, lambda m, a, b: [float(len(y)) for y in b], "double"))
    assert rewards.where("reward = length(response)").count() == 200
    seeded = [training.scored_rewards(df.select("row_id").coalesce(1).sort("row_id"), seed=3).agg(F.sum("reward")).first()[0] for _ in range(2)]
    assert seeded[0] == seeded[1] != 0


def test_parse_status(spark):
    rows = spark.createDataFrame([(None,), (" ",), ("no number",), ("score 4",)], "a string").select(models.parse_status(F.col("a")).alias("s")).collect()
    assert [r.s for r in rows] == ["no_answer", "empty", "unparsed", "parsed"]


# tests of significance


def test_tails_and_quantiles_against_tables(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda x: F.lit(float(x))
    for t, dof, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 100_000, 0.05), (0.0, 5, 1.0), (-2.228, 10, 0.05)):
        assert one(D.t_p_value(lit(t), lit(dof))) == pytest.approx(p, abs=5e-5)
        if t:
            assert one(D.t_p_value(lit(t), lit(dof))) == pytest.approx(tracking.t_p_value(t, dof), abs=1e-10)
    for f, a, b, p in ((4.96, 1, 10, 0.05), (3.33, 4, 11, 0.051), (2.37, 4, 10_000, 0.05)):
        assert one(D.f_p_value(lit(f), lit(a), lit(b))) == pytest.approx(p, abs=1e-3)
        assert one(D.f_p_value(lit(f), lit(a), lit(b))) == pytest.approx(tracking.f_p_value(f, a, b), abs=1e-10)
    for dof, t in ((1, 12.7062), (2, 4.30265), (10, 2.22814), (30, 2.04227), (1e6, 1.95997)):
        assert one(D.t_quantile(0.95, lit(dof))) == pytest.approx(t, abs=2e-4)
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 5.0)], "a double, b double")
    r = tracking.paired_effect(df, "a", "b").first()
    assert r.ci_low < r.mean_difference < r.ci_high and r.p_value == pytest.approx(tracking.t_p_value(r.t, 2)) and r.effect_size == pytest.approx(r.t / 3**0.5)
    alone = tracking.paired_effect(df.limit(1), "a", "b").first()
    assert alone.p_value is None and alone.ci_low is None


def test_error_matrix_has_all_levels(spark):
    df = spark.createDataFrame([(1, "m", "短"), (2, "m", "据我所知，这款" + "很好" * 30), (3, "n", "正常" * 40), (4, None, "短")], "row_id long, model string, response string")
    got = {(r.level, r.model, r.error_type): (r.n, r.share) for r in ErrorBucketing().matrix(df).collect()}
    assert got[3, None, None] == (6, 1.0) and got[1, "m", None] == (3, 0.5) and got[0, "n", "no_error"] == (1, 1.0) and got[2, None, "omission"] == (2, pytest.approx(1 / 3)) and got[0, None, "omission"] == (1, 0.5)


def test_best_flags_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), (None, 5.0)], "g string, score double")
    for most in (0, 10):
        got = {(r.g, r.score): r.score_best for r in tracking.best_flags(df, ["score"], by=("g",), most_groups=most).collect()}
        assert got == {("a", 1.0): False, ("a", 2.0): True, (None, 3.0): False, (None, 5.0): True}


# early stopping


def loop(values, patience, delta):
    best, bad = None, 0
    for i, v in enumerate(values):
        if best is None or v < best - delta:
            best, bad = v, 0
        else:
            bad += 1
            if bad >= patience:
                return best, True, i
    return best, False, None


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_stretches_of_runs_give_the_loops_answer(spark, stretch):
    random.seed(stretch)
    runs = {r: [float(random.randrange(random.choice([4, 40]))) for _ in range(random.randrange(1, 60))] for r in range(12)}
    df = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run long, step long, metric double").repartition(4)
    for patience, delta in ((1, 0.0), (3, 1.5)):
        got = {r.run: (r.best, r.stopped, r.stop_step) for r in training.early_stop(df, "run", patience=patience, min_delta=delta, stretch=stretch).collect()}
        assert got == {r: loop(vs, patience, delta) for r, vs in runs.items()}
    up = {r.run: (r.best, r.stopped, r.stop_step) for r in training.early_stop(df.withColumn("metric", -F.col("metric")), "run", patience=2, mode="max", min_delta=0.0, stretch=stretch).collect()}
    assert up == {r: (-b, s, at) for r, (b, s, at) in ((r, loop(vs, 2, 0.0)) for r, vs in runs.items())}
    assert training.early_stop(df.where("run = 3").drop("run")).count() == 1 and training.early_stop(df.where("false"), "run").count() == 0


def test_streamed_runs_stop_where_the_table_says(spark, tmp_path):
    from weftcorpus.streaming.rowlocal import early_stops

    random.seed(2)
    rows = [(r, i, float(random.randrange(30))) for i in range(24) for r in range(5)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "run long, step long, metric double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("run long, step long, metric double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = early_stops(stream, patience=4, min_delta=0.5).writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert out.awaitTermination(180)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("run").agg(F.max_by(F.struct("best", "stopped", "stop_step"), "steps").alias("s"))
    table = spark.createDataFrame(rows, "run long, step long, metric double")
    want = {r.run: (r.best, r.stopped, r.stop_step) for r in training.early_stop(table, "run", patience=4, min_delta=0.5).collect()}
    assert {r.run: tuple(r.s) for r in last.collect()} == want


# cosines


def test_tiles_count_every_pair_once(spark):
    import numpy as np

    random.seed(4)
    bits = ["推荐手机", "价格很低", "可能不错", "今天现货", "abc def", "好的"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(1, 7))) for _ in range(220)] + ["推荐手机价格很低"] * 9 + ["x", ""]
    df = spark.createDataFrame([(i, "m" if i % 10 else "n", t) for i, t in enumerate(texts)], "row_id long, model string, response string")
    for by in ((), ("model",)):
        e = TemplateRateEvaluator(tile=16)
        v = e.vectors(df, *by).collect()
        got = {tuple(r[c] for c in by): r.semantic_cluster_rate for r in e.cluster_rate(df, *by).collect()}
        large = {tuple(r[c] for c in by): r.semantic_cluster_rate for r in TemplateRateEvaluator(tile=4096).cluster_rate(df, *by).collect()}
        for key, rate in got.items():
            own = [r for r in v if tuple(r[c] for c in by) == key]
            dense = np.zeros((len(own), 6000))
            for i, r in enumerate(own):
                dense[i, r.terms] = r.weights
            n = np.array([r.copies for r in own])
            hit = np.triu(dense @ dense.T >= 0.85, 1)
            pairs = n @ hit @ n + sum(c * (c - 1) // 2 for c in n.tolist())
            total = df.where("response <> ''" + "".join(f" AND {c} = '{k}'" for c, k in zip(by, key))).count()
            assert rate == pytest.approx(pairs / (total * (total - 1) / 2)) and large[key] == pytest.approx(rate)


def test_whole_json_documents(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text\n{i}", None) for i in range(25)], "doc_id long, text string, source string")
    records.save_arrays(df, f"{tmp_path}/x.json", rows_per_file=10)
    assert sorted(map(tuple, records.load(spark, f"{tmp_path}/x.json", df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert re.match(r"\[\{", spark.read.text(f"{tmp_path}/x.json").first().value)


def test_json_documents_are_written_row_by_row(spark, tmp_path):
    """No line holds more than a row, whatever a document holds; no rows give no document."""
    df = spark.createDataFrame([(i, "x" * 50) for i in range(2_000)], "doc_id long, text string").coalesce(1)
    records.save_arrays(df, f"{tmp_path}/y.json", rows_per_file=1_000)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/y.json").collect()]
    assert max(map(len, lines)) < 100 and lines.count("]") == 2
    assert records.load(spark, f"{tmp_path}/y.json", df.schema).count() == 2_000
    records.save_arrays(df.where("false"), f"{tmp_path}/z.json")
    assert records.load(spark, f"{tmp_path}/z.json", df.schema).count() == 0
