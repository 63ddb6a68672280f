"""Queries over the response view against a computation row by row: no row may be left out."""

import re
from collections import Counter

import pytest
from test_scores_and_evaluation import cosine_rate

from weftcorpus import queries
from weftcorpus.functions import rules
from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.scorers import FactualityEvaluator, SafetyEvaluator, TaskCompletionEvaluator


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    spark.range(1, 121).withColumnRenamed("id", "o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return folder


def of_model(rows, model):
    return [r.response for r in rows if r.model == model and r.response]


def template(texts):
    out = {"total_responses": len(texts), "semantic_cluster_rate": cosine_rate(texts)}
    out["sentence_pattern_rate"] = sum(any(re.search(p, t) for p in rules.TEMPLATE_SENTENCES) for t in texts) / len(texts)
    for n in (2, 3, 4):
        bare = [re.sub(r"[ \n]", "", t) for t in texts]
        grams = Counter(t[i : i + n] for t in bare for i in range(len(t) - n + 1))
        out[f"cross_ngram_rep_{n}"] = sum(c for c in grams.values() if c > 1) / sum(grams.values())
        out[f"distinct_{n}"] = len(grams) / sum(grams.values())
    out["overall_template_rate"] = (out["cross_ngram_rep_3"] + out["sentence_pattern_rate"] + out["semantic_cluster_rate"] + 1 - out["distinct_2"]) / 4
    out["template_rate_percentage"] = out["overall_template_rate"] * 100
    return out


def test_template_overall_reads_every_response(spark, orders):
    rows = queries.qa(spark, orders).collect()
    got = {r.model: r.asDict() for r in queries.template_overall(spark, orders).collect()}
    assert set(got) == {"alpha", "beta", "gamma"}
    for model, r in got.items():
        expected = template(of_model(rows, model))
        assert {k: v for k, v in r.items() if k != "model"} == pytest.approx({k: expected[k] for k in r if k != "model"}, abs=2e-8)


def test_full_evaluation_reads_every_response(spark, orders):
    qa = queries.qa(spark, orders)
    scored = ErrorBucketing().bucket(SafetyEvaluator().score(TaskCompletionEvaluator().score(FactualityEvaluator().score(qa)))).collect()
    got = {r.model: r for r in queries.full_evaluation(spark, orders).collect()}
    assert set(got) == {"alpha", "beta", "gamma"}
    for model, r in got.items():
        own = [x for x in scored if x.model == model]
        mean = lambda c: sum(x[c] for x in own) / len(own)
        expected = 0.3 * mean("factuality_score") + 0.3 * mean("task_completion_score") + 0.25 * mean("safety_score") + 0.15 * 5 * (1 - template(of_model(scored, model))["overall_template_rate"])
        assert (r.total, r.human_review_needed, r.unsafe_count) == (40, sum(x.needs_human_review for x in own), sum(not x.is_safe for x in own))
        assert r.overall_score == pytest.approx(expected, abs=2e-8)


def test_response_cluster_rate_reads_every_response(spark, orders):
    texts = [r.response for r in queries.qa(spark, orders).collect() if r.response]
    assert queries.QUERIES["response_cluster_rate"](spark, orders).first().semantic_cluster_rate == pytest.approx(cosine_rate(texts), abs=2e-9)
