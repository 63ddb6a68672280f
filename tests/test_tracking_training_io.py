import json

import pytest
from pyspark.sql import functions as F

from weftcorpus.operators import tracking, training
from weftcorpus.plans import cli
from weftcorpus.plans.pipeline import DataPipeline, merged
from weftcorpus.sources import records
from weftcorpus.streaming import rowlocal


def test_advantage(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (2, 5.0), (3, 1.0)], "p long, reward double")
    got = [(r.p, r.advantage) for r in training.group_advantage(df, "p").orderBy("p", "reward").collect()]
    assert [round(a, 6) if a is not None else None for _, a in got] == [-1.0, 0.0, 1.0, 0.0, 0.0, None]
    steps = spark.createDataFrame([(1, 1, 1.0), (1, 1, 3.0), (1, 2, 6.0)], "step long, prompt_id long, reward double")
    assert training.mean_reward(steps).first().mean_reward == 4.0


def test_early_stopping_and_checkpoints(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1.0, 0.9, 0.9, 0.9, 0.9, 0.1])], "step long, metric double")
    r = training.early_stop(df).first()
    assert (r.best, r.stopped, r.stop_step) == (0.9, True, 4)
    r = training.early_stop(df.where("step < 3")).first()
    assert (r.best, r.stopped, r.stop_step) == (0.9, False, None)
    assert training.early_stop(df.withColumn("metric", -F.col("metric")), mode="max").first().stop_step == 4
    assert [x.step for x in training.best_checkpoints(df, keep=3).orderBy("place").collect()] == [5, 1, 2]


def test_batches_follow_the_order(spark):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("row_id"), F.col("id").cast("string").alias("prompt")).repartition(7)
    rows = training.prompt_batches(df, 8).orderBy("row_id").collect()
    assert [r.batch for r in rows] == [i // 8 for i in range(100)]
    assert training.scored_rewards(df.withColumn("response", F.lit("r"))).agg(F.count("reward")).first()[0] == 100


BENCH = {"meta": {"dataset_version": "v1"}, "models": {m: {"display_name": m.upper(), "metrics": {"overall_score": s, "factuality": 3.0}, "training_cost": {"gpu_hours": g}, "inference": {"latency_ms_p95": 9}, "error_buckets": {"omission": 5, "safe": 7}} for m, s, g in (("a", 3.6, 10.0), ("b", 4.1, 5.0))}}


def test_leaderboard_from_a_document(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps(BENCH, indent=1))
    assert [r.model for r in tracking.leaderboard(records.benchmark(spark, str(path))).collect()] == ["b", "a"]
    out, log = str(tmp_path / "s.json"), str(tmp_path / "log")
    assert cli.main(["tracker", "--benchmark", str(path), "--output", out, "--log", log], spark) == 0
    cli.main(["tracker", "--benchmark", str(path), "--output", out, "--log", log], spark)
    assert records.load_json(out)["leaderboard"][0]["model"] == "b" and spark.read.json(log).count() == 2


def test_statistics(spark):
    a, b = [3.92, 4.00, 4.05, 3.98, 4.08], [3.53, 3.58, 3.64, 3.60, 3.67]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = tracking.paired_t(df, "a", "b").first()
    d = [x - y for x, y in zip(a, b)]
    m = sum(d) / 5
    s = (sum((x - m) ** 2 for x in d) / 4) ** 0.5
    assert r.t == pytest.approx(m / (s / 5**0.5)) and r.dof == 4
    g = df.unpivot([], ["a", "b"], "g", "x")
    f = tracking.anova_f(g, "g", "x").first()
    ma, mb = sum(a) / 5, sum(b) / 5
    within = sum((x - ma) ** 2 for x in a) + sum((x - mb) ** 2 for x in b)
    assert f.f == pytest.approx(5 * (ma - mb) ** 2 / 2 / (within / 8))
    # known quantiles
    assert tracking.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tracking.f_p_value(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)


def test_shares_baselines_and_flags(spark):
    df = spark.createDataFrame([("a", 3.6, 60.0, 10.0), ("b", 4.1, 30.0, 5.0)], "model string, overall_score double, template_rate double, gpu_hours double")
    flags = {r.model: (r.overall_score_best, r.template_rate_best) for r in tracking.best_flags(df, ["overall_score", "template_rate"]).collect()}
    assert flags == {"a": (False, False), "b": (True, True)}
    r = {x.metric: x for x in tracking.against_baseline(df, "a", ["overall_score", "template_rate"]).collect()}
    assert r["template_rate"].relative_percent == -50.0
    assert [x.model for x in tracking.efficiency(df).collect()] == ["b", "a"]
    t = tracking.transposed(df, "model", ["overall_score", "template_rate"], ["a", "b"]).orderBy("metric").collect()
    assert (t[0].a, t[0].b) == (3.6, 4.1)
    e = spark.createDataFrame([("a", "x", 1), ("a", "y", 3)], "model string, e string, n long")
    assert sorted(r.share for r in tracking.error_shares(e).collect()) == [0.25, 0.75]
    s = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.7), ("r", 3, 1.9)], "experiment_id string, step long, eval_loss double")
    assert tracking.convergence_step(s).first().convergence_step == 2


def test_records(spark, tmp_path):
    lines, doc, lone = tmp_path / "a.jsonl", tmp_path / "b.json", tmp_path / "c.json"
    lines.write_text('{"text": "一"}\n\n{"text": "二"}\n', encoding="utf-8")
    doc.write_text('[{"text": "一"},\n {"text": "二"}]', encoding="utf-8")
    lone.write_text('{"text":\n "一"}', encoding="utf-8")
    assert [records.load(spark, str(p)).count() for p in (lines, doc, lone)] == [2, 2, 1]
    with pytest.raises(FileNotFoundError):
        records.load(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        records.load(spark, str(tmp_path / "x.csv"))
    assert records.load_splits(spark, {"train": str(lines), "eval": str(doc)}).groupBy("split").count().count() == 2
    records.save(records.load(spark, str(lines)), str(tmp_path / "deep/out"))
    assert spark.read.json(str(tmp_path / "deep/out")).count() == 2
    log = tmp_path / "m.json"
    log.write_text(json.dumps({"experiment_id": "e", "method": "m", "seed": 1, "dataset_version": "v", "steps": [{"step": 1, "loss": 2.0}, {"step": 2, "loss": 1.0}]}))
    steps = records.metric_steps(spark, str(log))
    assert steps.count() == 2
    for _ in range(2):
        records.append_metrics(steps.withColumn("recorded_at", F.current_timestamp()), str(tmp_path / "metrics"))
    assert records.recent_runs(spark, str(tmp_path / "metrics"), 3).count() == 3


def test_pipeline(spark, tmp_path):
    assert merged({"dedup": {"enabled": False}})["dedup"]["threshold"] == 0.85
    with pytest.raises(ValueError):
        merged({"nothing": {}})
    t = "华为手机现货，售价：199元，屏幕清晰，电池耐用，拍照也不错。"
    data = tmp_path / "in.jsonl"
    data.write_text("\n".join(json.dumps({"text": x}, ensure_ascii=False) for x in (t, t, "短", "一款适合长辈使用的大屏幕智能手机，字体清晰可见。")), encoding="utf-8")
    report = DataPipeline().run(spark, str(data), str(tmp_path / "out"))
    assert (report["input_count"], report["output_count"]) == (4, 2)
    assert report["steps"]["dedup"][0]["removed_count"] == 1 and report["steps"]["quality_filter"][0]["filter_reasons"] == {"too_short": 1}
    assert (tmp_path / "out_stats.json").exists()
    rows = spark.read.json(str(tmp_path / "out")).orderBy("row_id").collect()
    assert '<slot type="brand">华为</slot>' in rows[0].text and rows[0].text_original == t
    # question and answer records have no text: the default filter removes them all
    qa = spark.createDataFrame([("推荐一款适合长辈的手机", "可以考虑大屏幕而且续航久的型号，声音也要足够大")], "prompt string, response string")
    assert DataPipeline().transform(qa)[0].count() == 0
    assert DataPipeline({"quality_filter": {"require_qa_pair": True}}).transform(qa)[0].count() == 1


def test_command_lines(spark, tmp_path):
    data = tmp_path / "in.jsonl"
    data.write_text(json.dumps({"prompt": "推荐一款适合长辈的手机", "response": "可以考虑大屏幕而且续航久的型号，声音也要足够大"}, ensure_ascii=False) + "\n", encoding="utf-8")
    assert cli.main(["pipeline", "--input", str(data), "--output", str(tmp_path / "o"), "--qa"], spark) == 0
    assert cli.main(["evaluate", "--input", str(data), str(data), "--model-name", "a", "b", "--output-dir", str(tmp_path / "r")], spark) == 0
    assert len(list((tmp_path / "r").iterdir())) == 2


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "全网最低价"), ("2024-01-01 00:01:00", "好"), ("2024-01-01 00:02:00", "好"), ("2024-01-01 01:00:00", "不错")]
    spark.createDataFrame(rows, "ts string, response string").select(F.col("ts").cast("timestamp").alias("ts"), "response").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, response string").parquet(str(tmp_path / "s"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(rowlocal.scored(stream), "scored").where("safety_score = 2").count() == 1
    assert run(rowlocal.without_copies(stream, "response"), "unique").count() == 3
    w = run(rowlocal.windowed_safety(stream), "windows", "complete")
    assert w.agg(F.sum("unsafe_count"), F.sum("total")).first() == (1, 4)
