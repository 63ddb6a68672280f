import json

import pytest
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.diversity import TemplateRateEvaluator
from weftcorpus.operators.evalrun import EvalRunner, overall_score
from weftcorpus.operators.scorers import FactualityEvaluator, SafetyEvaluator, TaskCompletionEvaluator, with_id


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, question string, response string, reference string")


def test_factuality_keeps_the_order_of_operations(spark):
    words = rules.UNCERTAIN_WORDS
    expected = [3.0, 2.7, 2.4000000000000004, 2.1000000000000005, 1.8000000000000005, 1.5000000000000004, 1.2000000000000004]
    df = frame(spark, [(None, "，".join(words[:k]), "") for k in range(7)] + [(None, "可能是¥199", "")])
    got = [r.factuality_score for r in FactualityEvaluator().score(df).orderBy("row_id").collect()]
    assert got[:2] == expected[:2] and got[2:7] == pytest.approx(expected[2:], abs=1e-12) and got[7] == pytest.approx(3.2)


def test_entities(spark):
    df = frame(spark, [("", "¥199", "¥199"), ("", "199", "199元"), ("", "x", ""), ("", None, "价格 5 和 7.5"), ("", "5", "5 7.5")])
    got = [r.entity_accuracy for r in FactualityEvaluator().score(df).orderBy("row_id").collect()]
    # a number before a word character is no bare number, so the second reference has none
    assert got == [1.0, 1.0, 1.0, 0.0, 0.5]


def test_factuality_summary_and_judge(spark):
    df = frame(spark, [("q", "好", ""), ("q", "可能", "")])
    s = FactualityEvaluator().evaluate(df).first()
    assert s.mean_factuality_score == pytest.approx(2.85) and s.std_factuality_score == pytest.approx(0.15) and s.score_distribution["3"] == 1
    e = FactualityEvaluator().evaluate(df.where("false")).first()
    assert (e.mean_factuality_score, e.std_factuality_score, e.total) == (0.0, 0.0, 0)
    judged = FactualityEvaluator(judge=lambda p: F.when(p.contains("可供对照的答案：无"), "评分 4 分").otherwise("?"))
    assert [r.factuality_score for r in judged.score(df).collect()] == [4.0, 4.0]


def test_task_completion(spark):
    df = frame(spark, [("推荐手机", "推荐手机", ""), ("hi", "¥5 8GB 30w 优点", ""), ("推荐 手机", "手机 适合", "")])
    got = TaskCompletionEvaluator().score(df).orderBy("row_id").collect()
    assert got[0].need_understanding == 5.0 and got[0].recommendation_relevance == 4.0
    assert got[1].need_understanding == 3.0 and got[1].information_completeness == 5.0
    assert got[2].need_understanding == 3.0
    judge = TaskCompletionEvaluator(judge=lambda p: F.lit("需求理解：5\n推荐相关性: 4\n综合评分：3"))
    r = judge.score(df).first()
    # an overall of exactly 3 is computed again
    assert (r.need_understanding, r.information_completeness, r.task_completion_score) == (5.0, 3.0, 4.0)


def test_safety(spark):
    df = frame(spark, [("", "全网最低价", ""), ("", "手机号：13812345678", ""), ("", "", ""), ("", "100%正品保证", ""), ("", "无条件退款。", ""), ("", "限时优惠，请马上下单，史上最低", "")])
    rows = SafetyEvaluator().score(df).orderBy("row_id").collect()
    assert [r.safety_score for r in rows] == [2.0, 0.0, 5.0, 5.0, 5.0, 2.0]
    assert rows[0].violations["false_promotion"].matches == ["全网最低价"] and rows[1].max_severity == "critical" and rows[2].max_severity == "safe"
    assert set(rows[5].violations) == {"false_promotion", "price_misleading"}
    s = SafetyEvaluator().evaluate(df).first()
    assert (s.safe_count, s.unsafe_count, s.violation_counts["false_promotion"], s.violation_counts["prohibited_items"]) == (3, 3, 2, 0)
    e = SafetyEvaluator().evaluate(df.where("false")).first()
    assert (e.mean_safety_score, e.safety_rate) == (5.0, 0.0)
    own = SafetyEvaluator(custom_rules={"false_promotion": {"patterns": ["好"], "description": "", "severity": "low"}})
    assert [r.safety_score for r in own.score(frame(spark, [("", "好", ""), ("", "全网最低价", "")])).orderBy("row_id").collect()] == [4.0, 5.0]


def test_buckets(spark):
    neutral = "这是一段没有任何问题的普通介绍文字内容还不错"
    df = frame(spark, [("", neutral[:18], ""), ("", neutral + neutral[:8], ""), ("", neutral * 3, ""), ("", "根据我的了解，" + neutral, ""), ("", "售价¥0" + neutral * 3, "")])
    b = ErrorBucketing()
    rows = b.bucket(df).orderBy("row_id").collect()
    assert rows[0].error_types == ["omission", "format_issue"] and rows[0].primary_error == "omission" and rows[0].error_details["omission"] == "回答过短（18字）"
    assert rows[1].error_types == ["omission"] and rows[2].primary_error == "no_error" and not rows[2].has_error
    assert rows[3].primary_error == "hallucination" and rows[3].needs_human_review and rows[4].error_types == ["factual_error"]
    s = b.stats(df).first()
    assert s.error_counts == {"hallucination": 1, "omission": 3, "over_generalization": 0, "factual_error": 1, "format_issue": 1, "no_error": 0}
    assert s.human_review_needed == 2 and s.error_rate == pytest.approx(0.8)
    assert b.examples(df).count() == 5


def rates(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, response string")
    return TemplateRateEvaluator().evaluate(df).first()


def test_diversity(spark):
    r = rates(spark, [])
    assert (r.total_responses, r.cross_ngram_rep_3, r.distinct_2, r.overall_template_rate) == (0, 0.0, 1.0, 0.0)
    r = rates(spark, ["abcd", "", None])
    assert (r.cross_ngram_rep_3, r.distinct_2) == (0.0, 1.0)
    r = rates(spark, ["abcd", "abcd"])
    assert (r.cross_ngram_rep_3, r.distinct_2, r.semantic_cluster_rate) == (1.0, 0.5, 1.0)
    assert r.overall_template_rate == pytest.approx((1 + 0 + 1 + 0.5) / 4)


def cosine_rate(texts, t=0.85, most=5000):
    import math
    import re
    from collections import Counter

    docs = []
    for x in texts:
        s = re.sub(r"\s\s+", " ", " ".join(x).lower())
        docs.append(Counter(s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)))
    df, total = Counter(k for d in docs for k in d), Counter()
    for d in docs:
        total.update(d)
    vocabulary = set(sorted(total, key=lambda k: (-total[k], k))[:most])
    vectors = []
    for d in docs:
        v = {k: c * (math.log((1 + len(docs)) / (1 + df[k])) + 1) for k, c in d.items() if k in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({k: x / norm for k, x in v.items()})
    hits = sum(sum(x * b.get(k, 0) for k, x in a.items()) >= t for i, a in enumerate(vectors) for b in vectors[i + 1 :])
    return hits / (len(texts) * (len(texts) - 1) / 2)


@pytest.mark.parametrize("most", [5000, 12])
def test_cluster_rate_is_that_of_all_pairs(spark, most):
    texts = ["手机 不错 推荐", "手机 不错 推荐！", "Phone ok\nfine", "phone OK fine", "完全不同", "abcd abce abcf", "abcd abce abcg", "手机 不错 推荐"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, response string")
    got = TemplateRateEvaluator(max_features=most).cluster_rate(df).first().semantic_cluster_rate
    assert got == pytest.approx(cosine_rate(texts, most=most))


def test_overall_renormalises(spark):
    row = lambda **k: spark.range(1).select(overall_score(**{n: F.lit(v) for n, v in k.items()}).alias("o")).first().o
    assert row(factuality=4.0, task_completion=2.0) == pytest.approx(3.0)
    assert row(factuality=4.0, task_completion=None, safety=5.0) == pytest.approx((1.2 + 1.25) / 0.55)
    assert row(factuality=3.24, task_completion=3.51, safety=4.54, template_percentage=62.0) == pytest.approx(3.445)
    assert row() == 3.0


def test_models_comparison_and_reports(spark, tmp_path):
    good, bad = frame(spark, [("推荐手机", "推荐手机，价格¥99，优点很多，续航长久，屏幕清晰，适合长辈日常使用，也方便携带外出，售后网点多。", "")]), frame(spark, [("推荐手机", "全网最低价，可能吧", "")])
    e = EvalRunner(output_dir=str(tmp_path))
    results, table = e.compare_models({"坏": bad, "好": good})
    rows = [r.asDict() for r in table.collect()]
    assert [r["model"] for r in rows] == ["好", "坏"] and e.best_model(results).first().best_model == "好"
    paths = e.report({"comparison_table": rows, "best_model": "好"}, "cmp")
    assert "| 好 |" in open(paths["markdown"], encoding="utf-8").read()
    one = e.run(good, "好")
    assert json.load(open(one["report"]["json"], encoding="utf-8"))["model"] == "好"
    assert EvalRunner(factuality=None, task=None, template=None, safety=None).run_single_model(good, "m").first().overall_score == 3.0


def test_ids_fall_back_to_the_row(spark):
    df = spark.createDataFrame([(7, None), (8, "x")], "row_id long, id string")
    assert [r.id for r in with_id(df).orderBy("row_id").collect()] == ["7", "x"]


def test_equal_responses_are_worked_out_once(spark, monkeypatch):
    """Template metrics of a table and of its distinct responses with their numbers are the same."""
    from weftcorpus.operators import diversity

    sizes = {}
    monkeypatch.setattr(diversity, "written", lambda df, name, real=diversity.written: sizes.setdefault(name, real(df, name)))
    texts = ["综上所述，推荐 手机", "价格 100元", "价格 200元", ""]
    rows = [(i, "ab"[i % 2], texts[i % 4 if i % 3 else 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, model string, response string")
    got = {r.model: r for r in diversity.TemplateRateEvaluator().evaluate(df, "model").collect()}
    assert sizes["classes"].count() == len({r[1:] for r in rows if r[2]})
    for m in "ab":
        own = [t.replace(" ", "") for _, x, t in rows if x == m and t]
        grams = [t[i : i + 2] for t in own for i in range(len(t) - 1)]
        assert got[m].total_responses == len(own)
        assert abs(got[m].distinct_2 - len(set(grams)) / len(grams)) < 1e-12
        assert abs(got[m].cross_ngram_rep_2 - sum(grams.count(g) > 1 for g in grams) / len(grams)) < 1e-12
        assert abs(got[m].sentence_pattern_rate - sum(t.startswith("综上所述") for t in own) / len(own)) < 1e-12


def test_rows_that_read_alike_are_scored_once(spark):
    """Their copies count in every summary, also across blocks of copies."""
    kinds = [("推荐 手机", "推荐 手机，价格：100元", "¥100"), ("买 什么", "可能 要 5元", ""), ("", "", None)]
    df = spark.createDataFrame([(i, "ab"[i % 2], *kinds[i % 5 % 3]) for i in range(70)], "row_id long, model string, question string, response string, reference string")

    class Small(EvalRunner):
        COPIES = 3

    e = Small(template=None)
    assert e._distinct(df, "model").count() == 6
    got = {r.model: r for r in e.models(df).collect()}
    for part in (e.factuality, e.task, e.safety):
        for r in part.evaluate(df, "model").collect():
            for k, v in r.asDict().items():
                assert got[r.model][k] == v or abs(got[r.model][k] - v) < 1e-12
    for r in e.buckets.stats(df, "model").collect():
        assert got[r.model].error_counts == r.error_counts and got[r.model].total == r.total
