"""The library's queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no Chinese, which the built-in rules are about. So the response
queries read a view of `orders` whose questions and responses are composed from
integer keys, by one SQL text that both engines understand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus import oracles
from weftcorpus.functions import rules
from weftcorpus.functions import text as T
from weftcorpus.functions.segment import segmented
from weftcorpus.operators import models, rewrite, scorers, tracking, training
from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.dedup import MinHashDeduplicator
from weftcorpus.operators.diversity import TemplateRateEvaluator
from weftcorpus.operators.evalrun import EvalRunner, overall_score
from weftcorpus.operators.pairs import PreferencePairBuilder
from weftcorpus.operators.quality import QualityFilter
from weftcorpus.operators.rewrite import TemplateRewriter
from weftcorpus.operators.scorers import FactualityEvaluator, SafetyEvaluator, TaskCompletionEvaluator
from weftcorpus.operators.slots import SlotAnnotator
from weftcorpus.plans.cli import snapshot
from weftcorpus.plans.pipeline import DataPipeline
from weftcorpus.sources import records
from weftcorpus.sources.shared import shared_dir, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


_OPENINGS = ["综上所述，", "", "据我所知，这款产品", "根据您的需求，", "总体来说，", "", "根据我的了解，", "这个价位的商品普遍", ""]
_BODIES = ["推荐 手机，价格：", "电脑 适合 办公，优点 很多，只要 ¥", "可能 要 ", "库存不太清楚，大概是 ¥", "满300减50，售价：", "还剩3件，全网最低价 ", "华为 现货，建议 购买，只要 "]
_UNITS = ["元", "", "元 起", "块", " 元", ""]
_CLOSINGS = ["。希望以上回答能帮助到您", "，具体价格请咨询 客服", "，我猜 不确定", "，史上最低", "。电池 5000毫安，内存 128GB，祝您购物愉快", "", "，手机号：13812345678", "，假一赔十，2024年5月1日 前有效", "，限时优惠 请马上 下单", "，绝对正品 也许"]
_QUESTIONS = ["推荐 手机", "买 什么 电脑", "华为 现货 吗", "", "多少钱", "how much"]
#: Columns of the view, valid in both engines.
QA_COLUMNS = {
    "row_id": "o_orderkey",
    "model": _case("o_orderkey", ["alpha", "beta", "gamma"]),
    "question": _case("o_orderkey", _QUESTIONS),
    "response": "CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN '好的' ELSE (" + " || ".join([_case("o_orderkey", _OPENINGS), _case("o_orderkey", _BODIES), "CAST(o_orderkey % 900 + 1 AS STRING)", _case("o_orderkey", _UNITS), _case("o_orderkey", _CLOSINGS)]) + ") END",
    "reference": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '¥' || CAST(o_orderkey % 900 + 1 AS STRING) || ' 或 ' || CAST(o_orderkey % 450 + 1 AS STRING) END",
}
QA_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in QA_COLUMNS.items()) + " FROM orders"


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.spread(table(spark, sf_dir, "orders").select("o_orderkey")).selectExpr(*[f"{e} AS {c}" for c, e in QA_COLUMNS.items()])


#: Candidate responses: the line items of an order, scored by integers.
def _candidates(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 11).cast("double").alias("score"), F.expr(_TEXT).alias("text"))
    item = F.struct("l_linenumber", "score", "text")
    return li.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("responses")).withColumn("prompt", F.concat(F.lit("q"), F.col("row_id").cast("string")))


_TEXT = "CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 5 = 0 THEN '可能 ' || CAST(l_partkey AS STRING) WHEN l_partkey % 7 = 0 THEN '不知道 ' || CAST(l_suppkey AS STRING) ELSE '好用 ' || CAST(l_partkey AS STRING) END"
# line numbers repeat within an order, so the order of candidates is the whole row's
_CANDIDATES_SQL = f"""c0 AS (SELECT l_orderkey AS row_id, l_linenumber, CAST(l_partkey % 11 AS DOUBLE) AS score, {_TEXT} AS text FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY l_linenumber, score, text) AS place, count(*) OVER (PARTITION BY row_id) AS n FROM c0)"""


def _docs(spark, sf_dir) -> DataFrame:
    return records.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def quality_flags(spark, sf_dir):
    out = QualityFilter().flagged(_docs(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.round("repetition", 9).alias("repetition"), F.round("special", 9).alias("special"), F.coalesce("reason_code", F.lit("kept")).alias("reason_code"))


def quality_reason_counts(spark, sf_dir):
    return quality_flags(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("n"))


_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIPPED_SQL = f"regexp_replace(regexp_replace(coalesce(text, ''), '^{_SPACES}+', ''), '{_SPACES}+$', '')"
_ORDINARY_SQL = rf"[\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}一-鿿\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}.,!?，。！？、：；''（）【】《》]+"


def _flags(rows: str, first: str = "") -> str:
    """CTEs up to q (doc_id, n_chars, repetition, special, reason_code) of rows, a query with doc_id, t and what `first` names."""
    return rf"""
d AS ({rows}),
g AS (SELECT doc_id, substr(t, CAST(i AS INT), 4) AS gram FROM d, unnest(generate_series(1, length(t) - 3)) AS u(i)),
r AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS rep FROM (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT d.*, length(regexp_replace(regexp_replace(t, '^{_SPACES}+', ''), '{_SPACES}+$', '')) AS n_chars, coalesce(rep, 0) AS rep,
  length(regexp_replace(t, '{_ORDINARY_SQL}', '', 'g')) / greatest(length(t), 1) AS special FROM d LEFT JOIN r USING (doc_id)),
q AS (SELECT doc_id, n_chars, round(rep, 9) AS repetition, round(special, 9) AS special,
  CASE {first} WHEN n_chars = 0 THEN 'empty_text' WHEN n_chars < 20 THEN 'too_short' WHEN n_chars > 8192 THEN 'too_long' WHEN rep > 0.3 THEN 'repetition' WHEN special > 0.2 THEN 'special_chars' ELSE 'kept' END AS reason_code FROM f)"""


_FLAGS_SQL = _flags("SELECT doc_id, coalesce(text, '') AS t FROM documents")


def qa_quality(spark, sf_dir):
    """Rows as pairs of question and answer, both of which have to be there."""
    rows = qa(spark, sf_dir).withColumnRenamed("question", "prompt")
    out = QualityFilter(require_qa_pair=True).flagged(rows)
    return out.select("row_id", "n_chars", F.round("repetition", 9).alias("repetition"), F.coalesce("reason_code", F.lit("kept")).alias("reason_code"))


def text_lengths(spark, sf_dir):
    t = T.text("text")
    return _docs(spark, sf_dir).select("doc_id", F.length(t).alias("n_chars"), T.stripped_length(t).alias("n_stripped"), F.substring(t, 1, 50).alias("head"))


def qa_pairs_from_turns(spark, sf_dir):
    """Each user turn with the assistant turn that follows it, by one window over a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("response"))
    return c.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def near_dedup(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    return MinHashDeduplicator().dedup(docs).select(F.col("row_id").alias("doc_id"))


def near_dedup_verified(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    return MinHashDeduplicator(verify=True).dedup(docs).select(F.col("row_id").alias("doc_id"))


def _factuality(spark, sf_dir):
    return FactualityEvaluator().score(qa(spark, sf_dir))


def factuality_rule(spark, sf_dir):
    return _factuality(spark, sf_dir).select("row_id", "factuality_score")


def entity_accuracy(spark, sf_dir):
    return _factuality(spark, sf_dir).select("row_id", F.round("entity_accuracy", 9).alias("entity_accuracy"))


def factuality_summary(spark, sf_dir):
    out = FactualityEvaluator().evaluate(qa(spark, sf_dir), "model")
    r = lambda c: F.round(c, 8).alias(c)
    return out.select("model", r("mean_factuality_score"), r("std_factuality_score"), r("mean_entity_accuracy"), F.col("score_distribution")["3"].alias("score_3"), "total")


_UNCERTAIN_SQL = "3.0::DOUBLE" + "".join(f" - (CASE WHEN contains(response, '{w}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)" for w in rules.UNCERTAIN_WORDS) + r" + (CASE WHEN regexp_matches(response, '[¥￥]\d+|[\d,]+元') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"
_ENTITIES_SQL = r"list_distinct(list_concat(regexp_extract_all({0}, '[¥￥]\s*\d+(?:[,，]\d{{3}})*(?:\.\d{{1,2}})?'), list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\d+'))))"
_FACT_SQL = f"""qa AS ({QA_SQL}),
e AS (SELECT *, least(greatest({_UNCERTAIN_SQL}, 1.0), 5.0) AS factuality_score, {_ENTITIES_SQL.format('reference')} AS a, {_ENTITIES_SQL.format('response')} AS b FROM qa),
fact AS (SELECT *, CASE WHEN reference = '' OR len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END AS entity_accuracy FROM e)"""


def task_completion_rule(spark, sf_dir):
    out = TaskCompletionEvaluator().score(qa(spark, sf_dir))
    return out.select("row_id", *[F.round(c, 8).alias(c) for c in ("need_understanding", "recommendation_relevance", "information_completeness", "task_completion_score")])


_WORDS_SQL = "list_distinct(regexp_extract_all({0}, '[一-鿿]{{2,}}'))"
_TASK_SQL = f"""k AS (SELECT *, {_WORDS_SQL.format('question')} AS a, {_WORDS_SQL.format('response')} AS b FROM qa),
task AS (SELECT *, CASE WHEN len(a) = 0 THEN 3.0 ELSE 1 + 4 * (len(list_intersect(a, b)) / len(a)) END AS need_understanding,
  CASE WHEN {" OR ".join(f"contains(response, '{w}')" for w in rules.RECOMMEND_WORDS)} THEN 4.0 ELSE 3.0 END AS recommendation_relevance,
  least(5.0, 2.0 + {" + ".join(f"regexp_matches(response, '{p}')::INT" for p in rules.INFORMATION_SIGNALS)}) AS information_completeness FROM k)"""


def safety_rule(spark, sf_dir):
    out = SafetyEvaluator().score(qa(spark, sf_dir))
    return out.select("row_id", "safety_score", "is_safe", "max_severity", *[F.map_contains_key("violations", k).alias(k) for k in rules.SAFETY])


def safety_counts(spark, sf_dir):
    out = SafetyEvaluator().evaluate(qa(spark, sf_dir), "model")
    return out.select("model", F.round("mean_safety_score", 8).alias("mean_safety_score"), "safe_count", "unsafe_count", F.round("safety_rate", 8).alias("safety_rate"), *[F.col("violation_counts")[k].alias(k) for k in rules.SAFETY])


#: The patterns with a negative look-ahead, for engines without it.
_PLAIN = {r"100%正品(?!保证)": r"100%正品([^保]|保([^证]|$)|$)", r"无条件退款(?![，。])": r"无条件退款([^，。]|$)", r"翻新.*手机|翻新.*电脑(?!官方)": r"翻新.*手机|翻新.*电脑([^官]|官([^方]|$)|$)"}
_SAFE_SQL = "s AS (SELECT *, " + ", ".join("(" + " OR ".join(f"regexp_matches(response, '{_PLAIN.get(p, p)}')" for p in v["patterns"]) + f") AS {k}" for k, v in rules.SAFETY.items()) + """ FROM qa),
safe AS (SELECT *, CASE WHEN prohibited_items OR privacy_leak THEN 0.0 WHEN false_promotion THEN 2.0 WHEN price_misleading THEN 3.0 ELSE 5.0 END AS safety_score,
  NOT (false_promotion OR price_misleading OR prohibited_items OR privacy_leak) AS is_safe,
  CASE WHEN prohibited_items OR privacy_leak THEN 'critical' WHEN false_promotion THEN 'high' WHEN price_misleading THEN 'medium' ELSE 'safe' END AS max_severity FROM s)"""


def error_buckets(spark, sf_dir):
    out = ErrorBucketing().bucket(qa(spark, sf_dir))
    return out.select("row_id", F.concat_ws(",", "error_types").alias("error_types"), "primary_error", "has_error", "needs_human_review", F.concat_ws("|", F.map_values("error_details")).alias("details"))


def error_counts(spark, sf_dir):
    out = ErrorBucketing().stats(qa(spark, sf_dir), "model")
    return out.select("model", "total", F.round("error_rate", 8).alias("error_rate"), "human_review_needed", *[F.col("error_counts")[k].alias(k) for k in rules.ERRORS])


def bucket_examples(spark, sf_dir):
    return ErrorBucketing().examples(qa(spark, sf_dir)).select("row_id", "primary_error", "place", "question", "response", F.concat_ws(",", "error_types").alias("error_types"))


def error_share(spark, sf_dir):
    one = ErrorBucketing().stats(qa(spark, sf_dir), "model")
    long = one.select("model", F.explode(F.map_filter("error_counts", lambda k, _: k != rules.NO_ERROR)).alias("error_type", "n"))
    return tracking.error_shares(long).select("model", "error_type", "n", F.round("share", 8).alias("share"))


def _bucket_sql() -> str:
    parts = []
    for k, v in rules.ERRORS.items():
        whens = []
        if "min_length" in v:
            whens.append(f"WHEN n < {v['min_length']} THEN '回答过短（' || n || '字）'")
        if "max_length" in v:
            whens.append(f"WHEN n > {v['max_length']} THEN '回答过长（' || n || '字）'")
        whens += [f"WHEN regexp_matches(response, '{p}') THEN '匹配规则: ' || substr(regexp_extract(response, '{p}'), 1, 50)" for p in v["patterns"]]
        parts.append(f"CASE {' '.join(whens)} END AS {k}")
    kinds = list(rules.ERRORS)
    names = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in kinds)
    return f"""b0 AS (SELECT *, length(trim(response)) AS n FROM qa), b1 AS (SELECT *, {', '.join(parts)} FROM b0),
bk AS (SELECT *, concat_ws(',', {names}) AS error_types, coalesce({names}, 'no_error') AS primary_error, coalesce({', '.join(kinds)}) IS NOT NULL AS has_error,
  hallucination IS NOT NULL OR factual_error IS NOT NULL AS needs_human_review, concat_ws('|', {', '.join(kinds)}) AS details FROM b1)"""


def _ngram_rows(spark, sf_dir):
    return TemplateRateEvaluator().ngrams(qa(spark, sf_dir))


def cross_ngram_rep(spark, sf_dir):
    return _ngram_rows(spark, sf_dir).select("n", "n_grams", "n_repeated", F.round(F.col("n_repeated") / F.col("n_grams"), 9).alias("repetition"))


def distinct_n(spark, sf_dir):
    return _ngram_rows(spark, sf_dir).select("n", "n_distinct", F.round(F.col("n_distinct") / F.col("n_grams"), 9).alias("distinct_ratio"))


def sentence_pattern_rate(spark, sf_dir):
    return TemplateRateEvaluator().cross_response(qa(spark, sf_dir), "model").select("model", "total_responses", F.round("sentence_pattern_rate", 9).alias("sentence_pattern_rate"))


_TURN_GRAMS_SQL = f"""qa AS ({QA_SQL}), t AS (SELECT replace(replace(response, ' ', ''), chr(10), '') AS t FROM qa WHERE response <> ''),
g AS (SELECT k AS n, substr(t, CAST(i AS INT), k) AS gram FROM t, (SELECT unnest([2, 3, 4]) AS k), unnest(generate_series(1, length(t) - k + 1)) AS u(i)),
c AS (SELECT n, gram, count(*) AS c FROM g GROUP BY ALL),
ng AS (SELECT n, CAST(sum(c) AS BIGINT) AS n_grams, count(*) AS n_distinct, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_repeated FROM c GROUP BY n)"""


def semantic_cluster_rate(spark, sf_dir):
    """Pairs of parts' names and types, which are many and short."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.expr(_PART).alias("response"))
    return TemplateRateEvaluator().cluster_rate(rows).select(F.round("semantic_cluster_rate", 9).alias("semantic_cluster_rate"))


def response_cluster_rate(spark, sf_dir):
    """The same of all responses of all models."""
    return TemplateRateEvaluator().cluster_rate(qa(spark, sf_dir)).select(F.round("semantic_cluster_rate", 9).alias("semantic_cluster_rate"))


_PART = "p_brand || ' ' || p_type"


def template_overall(spark, sf_dir):
    keep = ("cross_ngram_rep_2", "cross_ngram_rep_3", "cross_ngram_rep_4", "distinct_2", "distinct_3", "sentence_pattern_rate", "semantic_cluster_rate", "overall_template_rate", "template_rate_percentage")
    return TemplateRateEvaluator().evaluate(qa(spark, sf_dir), "model").select("model", "total_responses", *[F.round(c, 8).alias(c) for c in keep])


def score_pairs(spark, sf_dir):
    b = PreferencePairBuilder("score_diff")
    return b.candidates(_candidates(spark, sf_dir)).where("pair IS NOT NULL").select("row_id", "pair.*")


def rule_pairs(spark, sf_dir):
    b = PreferencePairBuilder("rule_based")
    return b.candidates(_candidates(spark, sf_dir)).where("pair IS NOT NULL").select("row_id", "pair.prompt", "pair.chosen", "pair.rejected", "pair.build_strategy")


def _annotated(spark, sf_dir):
    p = F.col("row_id")
    return _candidates(spark, sf_dir).withColumns({"chosen": F.when(p % 4 == 0, F.concat(F.lit("c"), p.cast("string"))), "rejected": F.when(p % 8 == 0, F.concat(F.lit("r"), p.cast("string")))})


def human_pairs(spark, sf_dir):
    return PreferencePairBuilder("human").candidates(_annotated(spark, sf_dir)).where("pair IS NOT NULL").select("row_id", "pair.*")


def mixed_pairs(spark, sf_dir):
    return PreferencePairBuilder("mixed").candidates(_annotated(spark, sf_dir)).groupBy(F.coalesce("pair.build_strategy", F.lit("skip")).alias("strategy")).agg(F.count("*").alias("n"))


_SCORE_PAIR_SQL = f"""{_CANDIDATES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, place) AS best, row_number() OVER (PARTITION BY row_id ORDER BY score, place DESC) AS worst, count(*) OVER (PARTITION BY row_id) AS k FROM c WHERE text <> ''),
sp AS (SELECT a.row_id, 'q' || a.row_id AS prompt, a.text AS chosen, b.text AS rejected, 'score_diff' AS build_strategy, a.score - b.score AS score_diff FROM v a JOIN v b USING (row_id) WHERE a.best = 1 AND b.worst = 1 AND a.k >= 2 AND a.score - b.score >= 1),
rp AS (SELECT row_id, 'q' || row_id AS prompt, 'rule_based' AS build_strategy FROM (SELECT row_id, n, regexp_matches(text, '可能|不知道') AS bad FROM c WHERE text <> '' AND n >= 2) GROUP BY row_id HAVING bool_or(bad) AND bool_or(NOT bad))"""


def slot_spans(spark, sf_dir):
    out = SlotAnnotator(text_fields=("response",)).annotate(qa(spark, sf_dir))
    s = F.col("slots")
    return out.select("row_id", F.col("response").alias("tagged"), *[F.concat_ws("|", F.coalesce(s[k], F.array())).alias(k) for k in rules.SLOTS])


def slot_counts(spark, sf_dir):
    """How many rows have a slot of any type, by model."""
    out = SlotAnnotator(text_fields=("response",)).annotate(qa(spark, sf_dir))
    return out.groupBy("model").agg(F.count("*").alias("total_count"), F.count_if(F.size("slots") > 0).alias("annotated_count"))


def rewrite_styles(spark, sf_dir):
    a = qa(spark, sf_dir)
    return TemplateRewriter().rewrite(a).select("row_id", "rewrite_style", "response")


def rewrite_stats(spark, sf_dir):
    a = qa(spark, sf_dir)
    shout = TemplateRewriter(generate=lambda p: F.concat(F.substring_index(F.substring_index(p, "\n\n", 2), "\n\n", -1), F.lit("！")))
    return shout.stats(a, shout.rewrite(a)).select("total", "success_count", "fail_count", F.aggregate(F.map_values("style_distribution"), F.lit(0).cast("long"), lambda a, x: a + x).alias("by_style"))


def _runner() -> EvalRunner:
    return EvalRunner()


def overall(spark, sf_dir):
    rows = qa(spark, sf_dir)
    for part in (FactualityEvaluator(), TaskCompletionEvaluator(), SafetyEvaluator()):
        rows = part.score(rows)
    m = rows.groupBy("model").agg(F.avg("factuality_score").alias("f"), F.avg("task_completion_score").alias("t"), F.avg("safety_score").alias("s"))
    return m.select("model", F.round(overall_score(F.col("f"), F.col("t"), F.col("s")), 8).alias("overall_score"))


def model_comparison(spark, sf_dir):
    e = EvalRunner(template=None)
    table_ = e.comparison(e.models(qa(spark, sf_dir)))
    return table_.select("model", *[F.round(c, 8).alias(c) for c in ("overall_score", "factuality_score", "task_completion_score", "safety_score")])


def best_model(spark, sf_dir):
    e = EvalRunner(template=None)
    return e.best_model(e.models(qa(spark, sf_dir))).select("best_model", F.round("overall_score", 8).alias("overall_score"))


def full_evaluation(spark, sf_dir):
    e = _runner()
    return e.models(qa(spark, sf_dir)).select("model", "total", F.round("overall_score", 8).alias("overall_score"), "human_review_needed", "unsafe_count")


_OVERALL_SQL = f"""{_FACT_SQL}, {_TASK_SQL}, {_SAFE_SQL},
m AS (SELECT f.model, avg(factuality_score) AS f, avg((need_understanding + recommendation_relevance + information_completeness) / 3) AS t, avg(safety_score) AS s FROM fact f JOIN task USING (row_id) JOIN safe USING (row_id) GROUP BY 1),
o AS (SELECT model, (f * 0.3 + t * 0.3 + s * 0.25) / 0.85 AS overall, f, t, s FROM m)"""


def group_advantage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    out = training.group_advantage(li, "l_orderkey", reward="l_quantity")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


def mean_reward(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("step"), F.col("l_orderkey").alias("prompt_id"), F.col("l_quantity").alias("reward"))
    return training.mean_reward(li).select("step", F.round("mean_reward", 8).alias("mean_reward"))


def prompt_batches(spark, sf_dir):
    rows = qa(spark, sf_dir).withColumnRenamed("question", "prompt")
    return training.prompt_batches(rows, 64).groupBy("batch").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n"))


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("run"), F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 97).cast("double").alias("metric"))


def early_stop(spark, sf_dir):
    return training.early_stop(_runs(spark, sf_dir), "run", patience=5)


def topk_checkpoints(spark, sf_dir):
    return training.best_checkpoints(_runs(spark, sf_dir), "run", keep=3).select("run", "place", "step", "metric")


def convergence_step(spark, sf_dir):
    return tracking.convergence_step(_runs(spark, sf_dir), 3.0, "run", "metric")


def paired_t(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 101).cast("double").alias("a"), (F.col("o_custkey") % 89).cast("double").alias("b"))
    return tracking.paired_t(o, "a", "b", "o_orderpriority").select("o_orderpriority", "n", F.round("mean_difference", 8).alias("mean_difference"), F.round("t", 6).alias("t"), "dof")


def anova_f(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 89).cast("double").alias("x"))
    return tracking.anova_f(o, "o_orderpriority", "x").select("dof_between", "dof_within", F.round("f", 6).alias("f"))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg(F.col("c_custkey") % 83).alias("overall_score"), F.avg(F.col("c_custkey") % 59).alias("template_rate"), F.count("*").cast("double").alias("gpu_hours"))


def baseline_deltas(spark, sf_dir):
    return tracking.against_baseline(_nations(spark, sf_dir), "BUILDING", ["overall_score", "template_rate"]).select("model", "metric", *[F.round(c, 6).alias(c) for c in ("value", "baseline", "absolute", "relative_percent")])


def best_flags(spark, sf_dir):
    return tracking.best_flags(_nations(spark, sf_dir), ["overall_score", "template_rate"]).select("model", "overall_score_best", "template_rate_best")


def efficiency(spark, sf_dir):
    return tracking.efficiency(_nations(spark, sf_dir)).select("model", F.round("efficiency", 8).alias("efficiency"), F.round(tracking.diversity_score(F.col("template_rate")), 8).alias("diversity"))


def metrics_transposed(spark, sf_dir):
    rows = _nations(spark, sf_dir).select("model", *[F.round(c, 6).alias(c) for c in ("overall_score", "template_rate")])
    return tracking.transposed(rows, "model", ["overall_score", "template_rate"], _SEGMENTS)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def dedup_stats(spark, sf_dir):
    docs, d = _docs(spark, sf_dir).withColumnRenamed("doc_id", "row_id"), MinHashDeduplicator()
    return d.stats(docs, d.dedup(docs)).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


def slot_stats(spark, sf_dir):
    a = SlotAnnotator(text_fields=("response",))
    return a.stats(a.annotate(qa(spark, sf_dir))).select("total", "items_with_slots", *[F.col("slot_counts")[k].cast("long").alias(k) for k in rules.SLOTS])


def data_pipeline(spark, sf_dir):
    """The configured steps over documents: near-duplicates go, rules filter, slots are tagged."""
    docs = _docs(spark, sf_dir).drop("source").withColumnRenamed("doc_id", "row_id")
    out, _ = DataPipeline().transform(docs)
    return out.select(F.col("row_id").alias("doc_id"), F.col("text").alias("tagged"), *[F.concat_ws("|", F.coalesce(F.col("slots")[k], F.array())).alias(k) for k in rules.SLOTS])


def jsonl_round_trip(spark, sf_dir):
    """Documents saved as JSON lines and loaded again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.jsonl"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    records.save(docs, path)
    return records.load(spark, path, docs.schema)


def json_splits(spark, sf_dir):
    """Prompts of two files with their split's name."""
    base, c = f"{shared_dir(spark)}/{uuid.uuid4().hex}", table(spark, sf_dir, "conversations").where("role = 'user'")
    parts = {"train": c.where("conv_id % 5 <> 0"), "validation": c.where("conv_id % 5 = 0")}
    for name, rows in parts.items():
        records.save(rows.select("conv_id", "turn", F.col("text").alias("prompt")), f"{base}-{name}.jsonl")
    rows = records.load_splits(spark, {k: f"{base}-{k}.jsonl" for k in parts}, "conv_id long, turn int, prompt string")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("n_chars"))


def _benchmark_of(m: DataFrame, path: str) -> None:
    """A benchmark document of a row for each model."""
    entry = F.struct(F.concat(F.lit("M "), "model").alias("display_name"), F.struct("overall_score", "template_rate").alias("metrics"), F.struct("gpu_hours").alias("training_cost"))
    m.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("model", entry))).alias("models"))).alias("value")).coalesce(1).write.text(path)


def leaderboard(spark, sf_dir):
    """A benchmark document of the customers' segments, written as JSON and read as a leaderboard."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.json"
    _benchmark_of(_nations(spark, sf_dir), path)
    return tracking.leaderboard(records.benchmark(spark, path)).select("model", "display_name", *[F.round(c, 6).alias(c) for c in ("overall_score", "template_rate", "gpu_hours")], F.col("safety").isNull().alias("unscored"))


def _judge(prompt):
    """A stand-in for a model: answers with scores that hang on the prompt's length; one score is missing."""
    n = F.length(prompt)
    digit = lambda k: ((n + k) % 5 + 1).cast("string")
    return F.concat(F.lit("需求理解："), digit(0), F.lit("\n推荐相关性: "), digit(1), F.lit("\n综合评分："), digit(2))


def task_judge(spark, sf_dir):
    out = TaskCompletionEvaluator(judge=_judge).score(qa(spark, sf_dir))
    return out.select("row_id", *[F.round(c, 8).alias(c) for c in ("need_understanding", "recommendation_relevance", "information_completeness", "task_completion_score")])


def factuality_judge(spark, sf_dir):
    out = FactualityEvaluator(judge=lambda p: F.when(F.length(p) % 7 == 0, F.lit("无法评分")).otherwise(_judge(p))).score(qa(spark, sf_dir))
    return out.select("row_id", "factuality_score")


_CUSTOM = {"price_misleading": {"patterns": ["块"], "severity": "low"}, "urging": {"patterns": ["请马上", "建议 购买"], "severity": "medium", "description": "催促购买"}}


def custom_safety(spark, sf_dir):
    out = SafetyEvaluator(custom_rules=_CUSTOM).score(qa(spark, sf_dir))
    return out.select("row_id", "safety_score", "is_safe", "max_severity", F.map_contains_key("violations", "urging").alias("urging"), F.col("violations")["price_misleading"]["severity"].alias("price_severity"))


def full_comparison(spark, sf_dir):
    """The comparison table with all dimensions."""
    e = _runner()
    return e.comparison(e.models(qa(spark, sf_dir))).select("model", *[F.round(c, 8).alias(c) for c in ("overall_score", "factuality_score", "task_completion_score", "safety_score", "template_rate_percent")])


def pipeline_statistics(spark, sf_dir):
    """The statistics of the data pipeline's steps over documents, observed in its one run."""
    docs = _docs(spark, sf_dir).drop("source").withColumnRenamed("doc_id", "row_id")
    return DataPipeline().statistics(docs).select("step", "metric", F.round("value", 9).alias("value"))


def error_matrix(spark, sf_dir):
    """Errors by model and kind, with the totals of both and of all."""
    return ErrorBucketing().matrix(qa(spark, sf_dir)).select("model", "error_type", "level", "n", F.round("share", 8).alias("share"))


def paired_effect(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 101).cast("double").alias("a"), (F.col("o_custkey") % 101).cast("double").alias("b"))
    return tracking.paired_effect(o, "a", "b", "o_orderpriority").select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("p_value", "effect_size", "ci_low", "ci_high")])


def anova_effect(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 89).cast("double").alias("x"))
    return tracking.anova_effect(o, "o_orderpriority", "x").select(F.round("p_value", 6).alias("p_value"), F.round("eta_squared", 9).alias("eta_squared"))


#: A small dictionary of the view's words; what costs less is preferred.
_DICTIONARY = {
    w: 4000 + 37 * i
    for i, w in enumerate(
        "推荐 手机 价格 电脑 适合 办公 优点 很多 只要 可能 库存 太清楚 不太 不太清楚 大概 大概是 满 减 售价 还剩 全网 最低 最低价 全网最低价 华为 现货 建议 购买 综上 所述 综上所述 据我所知 这款 产品 根据 您 您的 需求 总体 来说 总体来说 我的 了解 这个 价位 商品 普遍 希望 以上 回答 "
        "能 帮助 到 具体 请 咨询 客服 我猜 不 确定 不确定 史上 史上最低 电池 毫安 内存 祝您 购物 愉快 手机号 假一赔十 年 月 日 前 有效 限时 优惠 限时优惠 马上 下单 绝对 正品 绝对正品 也许 好的 起 块 元".split()
    )
}


def word_segments(spark, sf_dir):
    """Responses as words of a dictionary, along the cheapest path of its lattice."""
    words = segmented(T.tokens(F.col("response")), _DICTIONARY)
    return qa(spark, sf_dir).select("row_id", words.alias("w")).select("row_id", F.array_join("w", "|").alias("words"), F.size("w").cast("long").alias("n_words"))


def word_ngram_rep(spark, sf_dir):
    """The n-gram repetition of cross_ngram_rep with words instead of characters."""
    e = TemplateRateEvaluator(ngram_sizes=(1, 2, 3), words=lambda c: segmented(c, _DICTIONARY))
    return e.ngrams(qa(spark, sf_dir)).select("n", "n_grams", "n_distinct", "n_repeated")


def _lengths():
    return {"name": "length"}


def _graded(model, prompts):
    """Answers as _judge() writes them; a stand-in for a model that fails on some prompts, says nothing to some and no number to others."""
    out = []
    for p in prompts:
        n = len(p)
        if n % 11 == 0:
            raise ValueError(model["name"])
        out.append("" if n % 13 == 0 else "无法评分" if n % 7 == 0 else f"需求理解：{n % 5 + 1}")
    return out


def judged_by_model(spark, sf_dir):
    """Factuality by a model that workers load once, with how each answer could be read."""
    judge = models.model_column("lengths-1", _lengths, _graded)
    return FactualityEvaluator(judge=judge).score(qa(spark, sf_dir)).select("row_id", "factuality_score", "judge_status")


def model_rewards(spark, sf_dir):
    """Rewards of responses by a model of prompt and response."""
    reward = models.model_column("rewards-1", _lengths, lambda model, prompts, responses: [float(len(r) - 2 * len(p)) for p, r in zip(prompts, responses)], "double")
    rows = qa(spark, sf_dir).withColumnRenamed("question", "prompt")
    return training.scored_rewards(rows, reward).select("row_id", "reward")


def evaluation_of_files(spark, sf_dir):
    """Each model's responses in a file of its own, JSON lines or whole documents, loaded and compared."""
    base, rows, sets = f"{shared_dir(spark)}/{uuid.uuid4().hex}", qa(spark, sf_dir), {}
    for model, suffix in (("alpha", "jsonl"), ("beta", "json"), ("gamma", "jsonl")):
        own = rows.where(F.col("model") == model).drop("model")
        path = f"{base}-{model}.{suffix}"
        records.save_arrays(own, path) if suffix == "json" else records.save(own, path)
        sets[model] = records.with_row_id(records.load(spark, path, own.schema))
    _, compared = EvalRunner(template=None).compare_models(sets)
    return compared.select("model", *[F.round(c, 8).alias(c) for c in ("overall_score", "factuality_score", "task_completion_score", "safety_score")])


def seeded_styles(spark, sf_dir):
    """Styles by another seed than rewrite_styles has."""
    return TemplateRewriter(seed=7).rewrite(qa(spark, sf_dir)).select("row_id", "rewrite_style")


def json_arrays(spark, sf_dir):
    """Documents saved as whole JSON documents, each an array, and loaded again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.json"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    records.save_arrays(docs, path)
    return records.load(spark, path, docs.schema)


def pipeline_report(spark, sf_dir):
    """A configured run from file to file: what its statistics file says."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    records.save(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{base}-in.jsonl")
    records.save_json({"dedup": {"enabled": False}, "slot_annotate": {"slot_types": ["price", "date"]}}, f"{base}-config.json")
    DataPipeline(records.load_config(f"{base}-config.json")).run(spark, f"{base}-in.jsonl", f"{base}-out.jsonl", "doc_id long, text string")
    schema = "input_count long, output_count long, steps struct<quality_filter:array<struct<removed_count:long,filter_reasons:map<string,long>>>,slot_annotate:array<struct<total:long,items_with_slots:long>>>"
    stats = spark.read.schema(schema).json(f"{base}-out_stats.json", multiLine=True)
    q, a = F.col("steps.quality_filter")[0], F.col("steps.slot_annotate")[0]
    saved = records.load(spark, f"{base}-out.jsonl", "doc_id long").agg(F.count("doc_id").alias("saved_rows"))
    return stats.select("input_count", "output_count", q["removed_count"].alias("removed_count"), F.coalesce(q["filter_reasons"]["repetition"], F.lit(0).cast("long")).alias("repetition"), a["total"].alias("annotated")).crossJoin(F.broadcast(saved))


def report_round_trip(spark, sf_dir):
    """All responses evaluated as one model's; its JSON report and the score in the Markdown one, read back."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    paths = EvalRunner(template=None, output_dir=folder).run(qa(spark, sf_dir), "all")["report"]
    shown = spark.read.text(paths["markdown"]).agg(F.max(F.regexp_extract("value", "总分 ([0-9.]+)", 1)).alias("shown_score"))
    schema = "model string, total long, overall_score double, mean_factuality_score double, mean_task_completion_score double, mean_safety_score double, human_review_needed long"
    report = spark.read.schema(schema).json(paths["json"], multiLine=True)
    return report.crossJoin(F.broadcast(shown)).select("model", "total", *[F.round(c, 6).alias(c) for c in ("overall_score", "mean_factuality_score", "mean_task_completion_score", "mean_safety_score")], "human_review_needed", "shown_score")


def experiment_log(spark, sf_dir):
    """A log record for each segment of customers, appended one by one and read back."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-log"
    for r in _nations(spark, sf_dir).orderBy("model").collect():  # a few segments
        records.append_experiment(spark, path, f"run-{r.model}", "sft", 42, "v1", "rules", {"score": round(r.overall_score, 6)})
    return spark.read.schema("experiment_id string, method string, seed long, evaluator string, hyperparameters map<string,string>, recorded_at string").json(path).select("experiment_id", "method", "seed", "evaluator", F.round(F.col("hyperparameters")["score"].cast("double"), 6).alias("score"), F.col("recorded_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("stamped"))


def tracker_snapshot(spark, sf_dir):
    """The leaderboard that the tracker writes of a benchmark document, and its log record."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _benchmark_of(_nations(spark, sf_dir), f"{base}.json")
    snapshot(spark, f"{base}.json", f"{base}-board.json", f"{base}-log")
    board = spark.read.schema("leaderboard array<struct<model:string,overall_score:double,template_rate:double>>").json(f"{base}-board.json", multiLine=True)
    logged = spark.read.schema("method string").json(f"{base}-log").agg(F.count("*").alias("log_records"), F.max("method").alias("method"))
    rows = board.select(F.posexplode("leaderboard").alias("place", "r"))
    return rows.crossJoin(F.broadcast(logged)).select((F.col("place") + 1).alias("place"), "r.model", F.round("r.overall_score", 6).alias("overall_score"), "log_records", "method")


def metrics_sink(spark, sf_dir):
    """Last metrics of runs, appended to a metrics table in two parts; the ten most recent runs."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-metrics"
    last = _runs(spark, sf_dir).groupBy("run").agg(F.max("step").alias("recorded_at"), F.max_by("metric", "step").alias("metric"))
    for part in (F.col("run") < 25, F.col("run") >= 25):
        records.append_metrics(last.where(part), path)
    return records.recent_runs(spark, path)


#: Rows whose text is missing, empty or there; where it isn't, question and answer stand in.
_TEXTS_SQL = "SELECT row_id, CASE row_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE response END AS text, question AS prompt, response FROM qa"


def fallback_texts(spark, sf_dir):
    """The text that near-duplicates are found by: the text, or else prompt and response."""
    rows = qa(spark, sf_dir).selectExpr("row_id", "CASE row_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE response END AS text", "question AS prompt", "response")
    return rows.select("row_id", MinHashDeduplicator().text(rows).alias("text"))


def quality_messages(spark, sf_dir):
    """Why documents are filtered out, in words with the value."""
    f = QualityFilter()
    return f.flagged(_docs(spark, sf_dir)).where("reason_code IS NOT NULL").select("doc_id", f.message().alias("message"))


def style_prompts(spark, sf_dir):
    """What a rewriting model is asked, by styles of which one is unknown."""
    rows = qa(spark, sf_dir).withColumn("style", F.expr(_STYLE))
    return rows.select("row_id", rewrite.prompt(F.col("response"), F.col("style")).alias("prompt"))


_STYLE = _case("row_id", [*rules.REWRITE_STYLES, "no such style"])


def judge_prompts(spark, sf_dir):
    """What judges are asked."""
    q, r, ref = F.col("question"), F.col("response"), F.col("reference")
    return qa(spark, sf_dir).select("row_id", scorers.factuality_prompt(q, r, ref).alias("factuality"), scorers.task_prompt(q, r).alias("task"))


QUERIES = {
    f.__name__: f
    for f in (
        quality_flags, quality_reason_counts, text_lengths, qa_pairs_from_turns, near_dedup, near_dedup_verified, factuality_rule, entity_accuracy, factuality_summary, task_completion_rule, safety_rule, safety_counts, error_buckets,
        error_counts, bucket_examples, error_share, cross_ngram_rep, distinct_n, sentence_pattern_rate, semantic_cluster_rate, response_cluster_rate, template_overall, score_pairs, rule_pairs, human_pairs, mixed_pairs, slot_spans, slot_counts, rewrite_styles,
        rewrite_stats, overall, model_comparison, best_model, full_evaluation, group_advantage, mean_reward, prompt_batches, early_stop, topk_checkpoints, convergence_step, paired_t, anova_f, baseline_deltas, best_flags, efficiency, metrics_transposed,
        qa_quality, dedup_stats, slot_stats, data_pipeline, jsonl_round_trip, json_splits, leaderboard, task_judge, factuality_judge, custom_safety, full_comparison,
        pipeline_statistics, error_matrix, paired_effect, anova_effect, word_segments, word_ngram_rep, judged_by_model, model_rewards,
        json_arrays, pipeline_report, report_round_trip, experiment_log, tracker_snapshot, metrics_sink, fallback_texts, quality_messages, style_prompts, judge_prompts, evaluation_of_files, seeded_styles,
    )
}

_TEMPLATE = ("cross_ngram_rep_2", "cross_ngram_rep_3", "cross_ngram_rep_4", "distinct_2", "distinct_3", "sentence_pattern_rate", "semantic_cluster_rate", "overall_template_rate")
_FULL_SQL = f"""WITH {_OVERALL_SQL}, {_bucket_sql()}, {oracles.template_metrics('qa')}
SELECT o.model, total, round((f * 0.3 + t * 0.3 + s * 0.25 + 5 * (1 - overall_template_rate) * 0.15), 8) AS overall_score, human_review_needed, unsafe_count FROM o JOIN template USING (model)
JOIN (SELECT model, count(*) AS total, count(*) FILTER (needs_human_review) AS human_review_needed FROM bk GROUP BY 1) USING (model) JOIN (SELECT model, count(*) FILTER (NOT is_safe) AS unsafe_count FROM safe GROUP BY 1) USING (model)"""
_RUNS_SQL = "r AS (SELECT o_orderkey % 50 AS run, o_orderkey AS step, CAST(o_custkey % 97 AS DOUBLE) AS metric FROM orders)"
_NATIONS_SQL = "m AS (SELECT c_mktsegment AS model, avg(c_custkey % 83) AS overall_score, avg(c_custkey % 59) AS template_rate, CAST(count(*) AS DOUBLE) AS gpu_hours FROM customer GROUP BY 1)"
_KINDS = ", ".join(f"count({k}) AS {k}" for k in rules.ERRORS)

ORACLES = {
    "quality_flags": f"WITH {_FLAGS_SQL} SELECT * FROM q",
    "quality_reason_counts": f"WITH {_FLAGS_SQL} SELECT reason_code, count(*) AS n FROM q GROUP BY 1",
    "text_lengths": f"SELECT doc_id, length(coalesce(text, '')) AS n_chars, length(regexp_replace(regexp_replace(coalesce(text, ''), '^{_SPACES}+', ''), '{_SPACES}+$', '')) AS n_stripped, substr(coalesce(text, ''), 1, 50) AS head FROM documents",
    "qa_pairs_from_turns": "SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS nxt, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant'",
    "near_dedup": f"WITH RECURSIVE {oracles.kept_by_bands('documents', 'doc_id', _STRIPPED_SQL, MinHashDeduplicator())} SELECT doc_id FROM kept",
    "near_dedup_verified": f"WITH RECURSIVE {oracles.kept_by_bands('documents', 'doc_id', _STRIPPED_SQL, MinHashDeduplicator(verify=True))} SELECT doc_id FROM kept",
    "factuality_rule": f"WITH {_FACT_SQL} SELECT row_id, factuality_score FROM fact",
    "entity_accuracy": f"WITH {_FACT_SQL} SELECT row_id, round(entity_accuracy, 9) AS entity_accuracy FROM fact",
    "factuality_summary": f"WITH {_FACT_SQL} SELECT model, round(avg(factuality_score), 8) AS mean_factuality_score, round(stddev_pop(factuality_score), 8) AS std_factuality_score, round(avg(entity_accuracy), 8) AS mean_entity_accuracy, count(*) FILTER (factuality_score = 3.0) AS score_3, count(*) AS total FROM fact GROUP BY 1",
    "task_completion_rule": f"WITH qa AS ({QA_SQL}), {_TASK_SQL} SELECT row_id, round(need_understanding, 8) AS need_understanding, recommendation_relevance, information_completeness, round((need_understanding + recommendation_relevance + information_completeness) / 3, 8) AS task_completion_score FROM task",
    "safety_rule": f"WITH qa AS ({QA_SQL}), {_SAFE_SQL} SELECT row_id, safety_score, is_safe, max_severity, {', '.join(rules.SAFETY)} FROM safe",
    "safety_counts": f"WITH qa AS ({QA_SQL}), {_SAFE_SQL} SELECT model, round(avg(safety_score), 8) AS mean_safety_score, count(*) FILTER (is_safe) AS safe_count, count(*) FILTER (NOT is_safe) AS unsafe_count, round(count(*) FILTER (is_safe) / count(*), 8) AS safety_rate, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in rules.SAFETY)} FROM safe GROUP BY 1",
    "error_buckets": f"WITH qa AS ({QA_SQL}), {_bucket_sql()} SELECT row_id, error_types, primary_error, has_error, needs_human_review, details FROM bk",
    "error_counts": f"WITH qa AS ({QA_SQL}), {_bucket_sql()} SELECT model, count(*) AS total, round(count(*) FILTER (has_error) / count(*), 8) AS error_rate, count(*) FILTER (needs_human_review) AS human_review_needed, {_KINDS} FROM bk GROUP BY 1",
    "bucket_examples": f"WITH qa AS ({QA_SQL}), {_bucket_sql()} SELECT row_id, primary_error, place, question, response, error_types FROM (SELECT row_id, primary_error, row_number() OVER (PARTITION BY primary_error ORDER BY row_id) AS place, question, substr(response, 1, 200) AS response, error_types FROM bk) WHERE place <= 3",
    "error_share": f"WITH qa AS ({QA_SQL}), {_bucket_sql()}, w AS (SELECT model, {_KINDS} FROM bk GROUP BY 1), l AS (UNPIVOT w ON {', '.join(rules.ERRORS)} INTO NAME error_type VALUE n) SELECT model, error_type, n, round(n / sum(n) OVER (PARTITION BY model), 8) AS share FROM l",
    "cross_ngram_rep": f"WITH {_TURN_GRAMS_SQL} SELECT n, n_grams, n_repeated, round(n_repeated / n_grams, 9) AS repetition FROM ng",
    "distinct_n": f"WITH {_TURN_GRAMS_SQL} SELECT n, n_distinct, round(n_distinct / n_grams, 9) AS distinct_ratio FROM ng",
    "sentence_pattern_rate": f"WITH qa AS ({QA_SQL}) SELECT model, count(*) AS total_responses, round(avg(({' OR '.join(f'''regexp_matches(response, '{p}')''' for p in rules.TEMPLATE_SENTENCES)})::INT), 9) AS sentence_pattern_rate FROM qa WHERE response <> '' GROUP BY 1",
    "semantic_cluster_rate": f"""WITH d AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower({_PART}), '(.)', '\\1 ', 'g'), ' +', ' ', 'g') AS t0 FROM part), s AS (SELECT id, rtrim(t0) AS t FROM d),
tf AS (SELECT id, substr(t, CAST(i AS INT), k) AS term, count(*) AS tf FROM s, (SELECT unnest([2, 3]) AS k), unnest(generate_series(1, length(t) - k + 1)) AS u(i) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS x FROM tf JOIN v USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
c AS (SELECT t, min(id) AS id, count(*) AS n FROM s GROUP BY t), wc AS (SELECT w.*, n FROM w JOIN c USING (id)),
p AS (SELECT a.id, b.id AS other, any_value(a.n) * any_value(b.n) AS k, sum(a.w * b.w) AS cosine FROM wc a JOIN wc b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)
SELECT round(((SELECT coalesce(sum(k), 0) FROM p WHERE cosine >= 0.85) + (SELECT sum(n * (n - 1) / 2) FROM c)) / (SELECT count(*) * (count(*) - 1) / 2 FROM part), 9) AS semantic_cluster_rate""",
    "score_pairs": f"WITH {_SCORE_PAIR_SQL} SELECT * FROM sp",
    "rule_pairs": f"""WITH {_SCORE_PAIR_SQL}, rb AS (SELECT row_id, list(text ORDER BY place) FILTER (NOT bad) AS good, list(text ORDER BY place) FILTER (bad) AS poor FROM (SELECT *, regexp_matches(text, '可能|不知道') AS bad FROM c WHERE text <> '') GROUP BY 1),
  {oracles.xxhash64_steps('rb', 'row_id', 42, 'pick')}, pick1 AS (SELECT * EXCLUDE (h), h AS h0 FROM pick), {oracles.xxhash64_steps('pick1', 'row_id', 43, 'pick2')}
  SELECT row_id, prompt, good[(((h0 % len(good)) + len(good)) % len(good) + 1)::BIGINT] AS chosen, poor[(((h % len(poor)) + len(poor)) % len(poor) + 1)::BIGINT] AS rejected, build_strategy FROM rp JOIN pick2 USING (row_id)""",
    "human_pairs": "SELECT DISTINCT l_orderkey AS row_id, 'q' || l_orderkey AS prompt, 'c' || l_orderkey AS chosen, 'r' || l_orderkey AS rejected, 'human' AS build_strategy, CAST(NULL AS DOUBLE) AS score_diff FROM lineitem WHERE l_orderkey % 8 = 0",
    "mixed_pairs": f"WITH {_SCORE_PAIR_SQL} SELECT strategy, count(*) AS n FROM (SELECT k.row_id, CASE WHEN k.row_id % 8 = 0 THEN 'human' WHEN sp.row_id IS NOT NULL THEN 'score_diff' WHEN rp.row_id IS NOT NULL THEN 'rule_based' ELSE 'skip' END AS strategy FROM (SELECT DISTINCT row_id FROM c) k LEFT JOIN sp ON k.row_id = sp.row_id LEFT JOIN rp ON k.row_id = rp.row_id) GROUP BY 1",
    "slot_spans": f"WITH qa AS ({QA_SQL}), {oracles.slot_spans('qa')} SELECT row_id, tagged, {', '.join(rules.SLOTS)} FROM annotated",
    "rewrite_styles": f"WITH qa AS ({QA_SQL}), {oracles.styles('qa', TemplateRewriter().styles)} SELECT row_id, rewrite_style, response FROM styled",
    "early_stop": oracles.early_stop(_RUNS_SQL),
    "template_overall": f"WITH qa AS ({QA_SQL}), {oracles.template_metrics('qa')} SELECT model, total_responses, {', '.join(f'round({c}, 8) AS {c}' for c in _TEMPLATE)}, round(overall_template_rate * 100, 8) AS template_rate_percentage FROM template",
    "full_evaluation": _FULL_SQL,
    "slot_counts": f"WITH qa AS ({QA_SQL}) SELECT model, count(*) AS total_count, count(*) FILTER ({' OR '.join(f'''regexp_matches(response, '{p}')''' for patterns in rules.SLOTS.values() for p in (x.replace("'", "''") for x in patterns))}) AS annotated_count FROM qa GROUP BY 1",
    "rewrite_stats": f"WITH qa AS ({QA_SQL}) SELECT count(*) AS total, count(*) FILTER (length(response) BETWEEN 9 AND 100000 AND response <> '') AS success_count, count(*) FILTER (NOT (length(response) BETWEEN 9 AND 100000 AND response <> '')) AS fail_count, count(*) FILTER (length(response) BETWEEN 9 AND 100000 AND response <> '') AS by_style FROM qa",
    "overall": f"WITH {_OVERALL_SQL} SELECT model, round(overall, 8) AS overall_score FROM o",
    "model_comparison": f"WITH {_OVERALL_SQL} SELECT model, round(overall, 8) AS overall_score, round(f, 8) AS factuality_score, round(t, 8) AS task_completion_score, round(s, 8) AS safety_score FROM o",
    "best_model": f"WITH {_OVERALL_SQL} SELECT model AS best_model, round(overall, 8) AS overall_score FROM o ORDER BY overall DESC LIMIT 1",
    "qa_quality": f"WITH qa AS ({QA_SQL}), {_flags("SELECT row_id AS doc_id, question || ' ' || response AS t, question, response FROM qa", "WHEN trim(question) = '' THEN 'empty_prompt' WHEN trim(response) = '' THEN 'empty_response'")} SELECT doc_id AS row_id, n_chars, repetition, reason_code FROM q",
    "dedup_stats": f"WITH RECURSIVE {oracles.kept_by_bands('documents', 'doc_id', _STRIPPED_SQL, MinHashDeduplicator())}, n AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM kept) AS b) SELECT a AS original_count, b AS deduplicated_count, a - b AS removed_count, round((a - b) / a, 9) AS dedup_ratio FROM n",
    "slot_stats": f"WITH qa AS ({QA_SQL}), {oracles.slot_spans('qa')} SELECT (SELECT count(*) FROM qa) AS total, count(*) AS items_with_slots, {', '.join(f"sum(len(list_distinct(list_transform(list_filter(found, lambda s: s.kind = '{k}'), lambda s: s.value))))::BIGINT AS {k}" for k in rules.SLOTS)} FROM spans",
    "data_pipeline": f"WITH RECURSIVE {oracles.kept_by_bands('documents', 'doc_id', _STRIPPED_SQL, MinHashDeduplicator())}, {_flags("SELECT doc_id, coalesce(text, '') AS t FROM documents JOIN kept USING (doc_id)")}, rest AS (SELECT doc_id, text FROM documents JOIN q USING (doc_id) WHERE reason_code = 'kept'), {oracles.slot_spans('rest', 'text', 'doc_id')} SELECT doc_id, tagged, {', '.join(rules.SLOTS)} FROM annotated",
    "jsonl_round_trip": "SELECT doc_id, text, source FROM documents",
    "json_splits": "SELECT CASE WHEN conv_id % 5 <> 0 THEN 'train' ELSE 'validation' END AS split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE role = 'user' GROUP BY 1",
    "leaderboard": f"WITH {_NATIONS_SQL} SELECT model, 'M ' || model AS display_name, round(overall_score, 6) AS overall_score, round(template_rate, 6) AS template_rate, round(gpu_hours, 6) AS gpu_hours, true AS unscored FROM m",
    "task_judge": f"WITH qa AS ({QA_SQL}), n AS (SELECT row_id, length(question) + length(response) + {len(rules.TASK_PROMPT) - len('{question}{response}')} AS n FROM qa), s AS (SELECT row_id, (n % 5 + 1)::DOUBLE AS a, ((n + 1) % 5 + 1)::DOUBLE AS b, ((n + 2) % 5 + 1)::DOUBLE AS c FROM n) SELECT row_id, a AS need_understanding, b AS recommendation_relevance, 3.0::DOUBLE AS information_completeness, round(CASE WHEN c = 3 THEN (a + b + 3) / 3 ELSE c END, 8) AS task_completion_score FROM s",
    "factuality_judge": f"WITH qa AS ({QA_SQL}), n AS (SELECT row_id, length(question) + length(response) + CASE WHEN reference = '' THEN {len(rules.NO_REFERENCE)} ELSE length(reference) END + {len(rules.FACTUALITY_PROMPT) - len('{question}{response}{reference}')} AS n FROM qa) SELECT row_id, CASE WHEN n % 7 = 0 THEN 3.0::DOUBLE ELSE (n % 5 + 1)::DOUBLE END AS factuality_score FROM n",
    "custom_safety": f"""WITH qa AS ({QA_SQL}), {_SAFE_SQL}, x AS (SELECT *, regexp_matches(response, '请马上|建议 购买') AS urging, contains(response, '块') AS lumps FROM safe)
  SELECT row_id, CASE WHEN prohibited_items OR privacy_leak THEN 0.0 WHEN false_promotion THEN 2.0 WHEN urging THEN 3.0 WHEN lumps THEN 4.0 ELSE 5.0 END::DOUBLE AS safety_score, NOT (prohibited_items OR privacy_leak OR false_promotion OR urging OR lumps) AS is_safe,
  CASE WHEN prohibited_items OR privacy_leak THEN 'critical' WHEN false_promotion THEN 'high' WHEN urging THEN 'medium' WHEN lumps THEN 'low' ELSE 'safe' END AS max_severity, urging, CASE WHEN lumps THEN 'low' END AS price_severity FROM x""",
    "full_comparison": f"WITH {_OVERALL_SQL}, {oracles.template_metrics('qa')} SELECT o.model, round(f * 0.3 + t * 0.3 + s * 0.25 + 5 * (1 - overall_template_rate) * 0.15, 8) AS overall_score, round(f, 8) AS factuality_score, round(t, 8) AS task_completion_score, round(s, 8) AS safety_score, round(overall_template_rate * 100, 8) AS template_rate_percent FROM o JOIN template USING (model)",
    "response_cluster_rate": f"WITH qa AS ({QA_SQL}), {oracles.cluster_rate('qa')} SELECT round(semantic_cluster_rate, 9) AS semantic_cluster_rate FROM rate",
    "pipeline_statistics": f"""WITH RECURSIVE {oracles.kept_by_bands('documents', 'doc_id', _STRIPPED_SQL, MinHashDeduplicator())}, {_flags("SELECT doc_id, coalesce(text, '') AS t FROM documents JOIN kept USING (doc_id)")},
rest AS (SELECT doc_id, text FROM documents JOIN q USING (doc_id) WHERE reason_code = 'kept'), {oracles.slot_spans('rest', 'text', 'doc_id')},
n AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM kept) AS b, (SELECT count(*) FROM rest) AS c)
SELECT 'dedup' AS step, unnest(['original_count', 'deduplicated_count', 'removed_count', 'dedup_ratio']) AS metric, round(unnest([a, b, a - b, (a - b) / greatest(a, 1)]::DOUBLE[]), 9) AS value FROM n
UNION ALL SELECT 'quality_filter', unnest(['original_count', 'filtered_count', 'removed_count', 'filter_ratio']), round(unnest([b, c, b - c, (b - c) / greatest(b, 1)]::DOUBLE[]), 9) FROM n
UNION ALL SELECT 'quality_filter', 'filter_reasons.' || reason_code, count(*)::DOUBLE FROM q WHERE reason_code <> 'kept' GROUP BY 2
UNION ALL SELECT 'slot_annotate', unnest(['total', 'items_with_slots']), unnest([c, (SELECT count(*) FROM spans)]::DOUBLE[]) FROM n
UNION ALL SELECT 'slot_annotate', 'slot_counts.' || k, coalesce((SELECT sum(len(list_distinct(list_transform(list_filter(found, lambda s: s.kind = k), lambda s: s.value)))) FROM spans), 0)::DOUBLE FROM (SELECT unnest({list(rules.SLOTS)}) AS k)""",
    "error_matrix": f"WITH qa AS ({QA_SQL}), {_bucket_sql()}, l AS (SELECT model, unnest(CASE WHEN has_error THEN string_split(error_types, ',') ELSE ['no_error'] END) AS error_type FROM bk), c AS (SELECT model, error_type, grouping_id(model, error_type)::INT AS level, count(*) AS n FROM l GROUP BY CUBE (model, error_type)) SELECT *, round(n / sum(n) OVER (PARTITION BY level, CASE WHEN level = 0 THEN model END), 8) AS share FROM c",
    "paired_effect": oracles.paired_effect("SELECT o_orderpriority, CAST(o_orderkey % 101 - o_custkey % 101 AS DOUBLE) AS d FROM orders", "o_orderpriority"),
    "anova_effect": oracles.anova_effect("SELECT o_orderpriority AS g, CAST(o_custkey % 89 AS DOUBLE) AS x FROM orders"),
    "word_segments": f"WITH RECURSIVE qa AS ({QA_SQL}), {oracles.segments('qa', _DICTIONARY)} SELECT row_id, words, n_words FROM segments",
    "word_ngram_rep": f"WITH RECURSIVE qa AS ({QA_SQL}), {oracles.segments('qa', _DICTIONARY)}, w AS (SELECT string_split(words, '|') AS w FROM segments WHERE words <> ''), g AS (SELECT k AS n, w[i:i + k - 1] AS gram, count(*) AS c FROM w, (SELECT unnest([1, 2, 3]) AS k), unnest(generate_series(1, len(w) - k + 1)) AS u(i) GROUP BY ALL) SELECT n, sum(c)::BIGINT AS n_grams, count(*) AS n_distinct, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS n_repeated FROM g GROUP BY 1",
    "judged_by_model": f"WITH qa AS ({QA_SQL}), n AS (SELECT row_id, length(question) + length(response) + CASE WHEN reference = '' THEN {len(rules.NO_REFERENCE)} ELSE length(reference) END + {len(rules.FACTUALITY_PROMPT) - len('{question}{response}{reference}')} AS n FROM qa) SELECT row_id, CASE WHEN n % 11 = 0 OR n % 13 = 0 OR n % 7 = 0 THEN 3.0::DOUBLE ELSE (n % 5 + 1)::DOUBLE END AS factuality_score, CASE WHEN n % 11 = 0 THEN 'no_answer' WHEN n % 13 = 0 THEN 'empty' WHEN n % 7 = 0 THEN 'unparsed' ELSE 'parsed' END AS judge_status FROM n",
    "model_rewards": f"WITH qa AS ({QA_SQL}) SELECT row_id, (length(response) - 2 * length(question))::DOUBLE AS reward FROM qa",
    "fallback_texts": f"WITH qa AS ({QA_SQL}), t AS ({_TEXTS_SQL}) SELECT row_id, CASE WHEN coalesce(text, '') <> '' THEN text ELSE trim(prompt || ' ' || response) END AS text FROM t",
    "quality_messages": f"""WITH {_FLAGS_SQL} SELECT doc_id, CASE reason_code WHEN 'too_short' THEN '文本过短: ' || n_chars || ' < 20' WHEN 'too_long' THEN '文本过长: ' || n_chars || ' > 8192' WHEN 'repetition' THEN printf('重复率过高: %.2f > 0.3', repetition::DOUBLE)
  WHEN 'special_chars' THEN printf('特殊字符比例过高: %.2f > 0.2', special::DOUBLE) ELSE '文本为空' END AS message FROM q WHERE reason_code <> 'kept'""",
    "style_prompts": f"WITH qa AS ({QA_SQL}) SELECT row_id, replace(CASE {_STYLE} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.REWRITE_STYLES.items())} ELSE '{rules.REWRITE_STYLES[rules.FALLBACK_STYLE]}' END, '{{text}}', response) AS prompt FROM qa",
    "judge_prompts": f"WITH qa AS ({QA_SQL}) SELECT row_id, replace(replace(replace('{rules.FACTUALITY_PROMPT}', '{{question}}', question), '{{response}}', response), '{{reference}}', CASE WHEN reference = '' THEN '{rules.NO_REFERENCE}' ELSE reference END) AS factuality, replace(replace('{rules.TASK_PROMPT}', '{{question}}', question), '{{response}}', response) AS task FROM qa",
    "evaluation_of_files": f"WITH {_OVERALL_SQL} SELECT model, round(overall, 8) AS overall_score, round(f, 8) AS factuality_score, round(t, 8) AS task_completion_score, round(s, 8) AS safety_score FROM o",
    "seeded_styles": f"WITH qa AS ({QA_SQL}), {oracles.styles('qa', TemplateRewriter().styles, seed=7)} SELECT row_id, rewrite_style FROM styled",
    "json_arrays": "SELECT doc_id, text, source FROM documents",
    "pipeline_report": f"WITH {_FLAGS_SQL} SELECT count(*) AS input_count, count(*) FILTER (reason_code = 'kept') AS output_count, count(*) FILTER (reason_code <> 'kept') AS removed_count, count(*) FILTER (reason_code = 'repetition') AS repetition, count(*) FILTER (reason_code = 'kept') AS annotated, count(*) FILTER (reason_code = 'kept') AS saved_rows FROM q",
    "report_round_trip": f"""WITH {_FACT_SQL}, {_TASK_SQL}, {_SAFE_SQL}, {_bucket_sql()},
m AS (SELECT count(*) AS total, avg(factuality_score) AS f, avg((need_understanding + recommendation_relevance + information_completeness) / 3) AS t, avg(safety_score) AS s FROM fact JOIN task USING (row_id) JOIN safe USING (row_id)),
o AS (SELECT *, (f * 0.3 + t * 0.3 + s * 0.25) / 0.85 AS overall FROM m)
SELECT 'all' AS model, total, round(overall, 6) AS overall_score, round(f, 6) AS mean_factuality_score, round(t, 6) AS mean_task_completion_score, round(s, 6) AS mean_safety_score, (SELECT count(*) FILTER (needs_human_review) FROM bk) AS human_review_needed, format('{{:.2f}}', overall::DOUBLE) AS shown_score FROM o""",
    "experiment_log": f"WITH {_NATIONS_SQL} SELECT 'run-' || model AS experiment_id, 'sft' AS method, 42::BIGINT AS seed, 'rules' AS evaluator, round(overall_score, 6) AS score, true AS stamped FROM m",
    "tracker_snapshot": f"WITH {_NATIONS_SQL} SELECT row_number() OVER (ORDER BY overall_score DESC, model)::INT AS place, model, round(overall_score, 6) AS overall_score, 1::BIGINT AS log_records, 'benchmark_summary' AS method FROM m",
    "metrics_sink": f"WITH {_RUNS_SQL} SELECT run, max(step) AS recorded_at, max_by(metric, step) AS metric FROM r GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
    "group_advantage": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_samp(l_quantity) OVER w + 1e-8), 6) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
    "mean_reward": "SELECT step, round(avg(m), 8) AS mean_reward FROM (SELECT l_suppkey % 10 AS step, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY 1",
    "prompt_batches": "SELECT batch, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders) GROUP BY 1",
    "topk_checkpoints": f"WITH {_RUNS_SQL} SELECT run, place, step, metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric, step) AS place FROM r) WHERE place <= 3",
    "convergence_step": f"WITH {_RUNS_SQL} SELECT run, min(step) FILTER (metric < 3) AS convergence_step FROM r GROUP BY 1",
    "paired_t": "SELECT o_orderpriority, count(*) AS n, round(avg(d), 8) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS dof FROM (SELECT o_orderpriority, CAST(o_orderkey % 101 - o_custkey % 89 AS DOUBLE) AS d FROM orders) GROUP BY 1",
    "anova_f": "WITH x AS (SELECT o_orderpriority AS g, CAST(o_custkey % 89 AS DOUBLE) AS x FROM orders), s AS (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY 1), a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS within FROM s) SELECT CAST(k - 1 AS BIGINT) AS dof_between, CAST(a.n - k AS BIGINT) AS dof_within, round(((SELECT sum(n * (m - a.mean) * (m - a.mean)) FROM s) / (k - 1)) / (within / (a.n - k)), 6) AS f FROM a",
    "baseline_deltas": f"WITH {_NATIONS_SQL}, l AS (UNPIVOT (SELECT model, overall_score, template_rate FROM m) ON overall_score, template_rate INTO NAME metric VALUE value), b AS (SELECT metric, value AS baseline FROM l WHERE model = 'BUILDING') SELECT model, metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS absolute, round((value - baseline) / baseline * 100, 6) AS relative_percent FROM l JOIN b USING (metric) WHERE model <> 'BUILDING'",
    "best_flags": f"WITH {_NATIONS_SQL} SELECT model, overall_score = max(overall_score) OVER () AS overall_score_best, template_rate = min(template_rate) OVER () AS template_rate_best FROM m",
    "efficiency": f"WITH {_NATIONS_SQL} SELECT model, round(overall_score / gpu_hours, 8) AS efficiency, round((100 - template_rate) / 20, 8) AS diversity FROM m",
    "metrics_transposed": f"WITH {_NATIONS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, " + ", ".join(f"round(max({c}) FILTER (model = '{x}'), 6) AS \"{x}\"" for x in _SEGMENTS) + " FROM m" for c in ("overall_score", "template_rate")),
}
