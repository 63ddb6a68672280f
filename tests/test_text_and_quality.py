import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T
from weftcorpus.operators.quality import QualityFilter


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def repetition(t, n=4):
    grams = [t[i : i + n] for i in range(len(t) - n + 1)]
    c = Counter(grams)
    return sum(v for v in c.values() if v > 1) / max(len(grams), 1)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab中😀 \n", max_size=40))
def test_repetition_is_that_of_a_counter(t):
    assert T.ngram_repetition(t, 4) == pytest.approx(repetition(t))


def test_repetition_with_wide_alphabets():
    t = "".join(chr(0x4E00 + i % 20000) for i in range(0, 70000, 7)) * 2
    assert T.ngram_repetition(t, 4) == pytest.approx(repetition(t))
    assert T.ngram_repetition(t, 9) == pytest.approx(repetition(t, 9))


def test_native_and_batch_repetition_agree(spark):
    rows = [("哈" * 40,), ("abcabcabc",), ("abc",), ("",), (None,), ("a😀b中" * 3 + "x",)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select(T.repetition_ratio(T.text("t")).alias("a"), T.repetition_ratio_native(T.text("t")).alias("b")).collect():
        assert r.a == pytest.approx(r.b)


def test_ngrams_take_whole_code_points(spark):
    assert one(spark, "a😀b中", T.char_ngrams(F.col("t"), 2).alias("g")).g == ["a😀", "😀b", "b中"]
    assert one(spark, " ab ", T.shingles(F.col("t"), 3).alias("g")).g == ["ab"]


def test_strip_is_unicode(spark):
    assert one(spark, "　\x1c a b \n", T.strip(F.col("t")).alias("s")).s == "a b"


def test_double_and_typographic_quotes_are_special(spark):
    t = "a\"中’、x—é_😀"
    assert one(spark, t, (T.special_ratio(F.col("t")) * len(t)).alias("n")).n == pytest.approx(4)


def test_patterns_are_unicode_and_stop_at_line_feeds_only(spark):
    r = one(spark, "中\rb", F.col("t").rlike(T.rx(r"\w.b")).alias("a"))
    assert r.a


def test_all_rules_match_as_in_python(spark):
    """Every pattern on texts that it is about: the same matches as Python's re."""
    texts = ["售价：199元，¥1,299.00", "2024年5月1日 下周末 3天内 618", "现货 库存：99 还剩 5 件 最后3件 到货时间：三天", "满300减50 8.5折 立减¥20 买一送一 coupon：abc_1 活动截5月1日", "华为 levi's Nike SK-II", "100%正品保证 100%正品 无条件退款。无条件退款了", "原价¥99，现价¥9 限时优惠xx马上 最后 3 件yy抢购", "翻新xx电脑官方 山寨", "手机号：13812345678 身份证：12345678901234567X 卡号：1234567890123 地址：北京市", "据我所知，这款产品 可能是 大概有 ¥3", "总结一下，希望以上x帮助到您", "199元 12.5 a1"]
    patterns = [p for ps in rules.SLOTS.values() for p in ps] + [p for v in rules.SAFETY.values() for p in v["patterns"]] + [p for v in rules.ERRORS.values() for p in v["patterns"]] + rules.PAIR_HALLUCINATIONS + rules.TEMPLATE_SENTENCES + rules.INFORMATION_SIGNALS + [rules.PRICE_MENTION, rules.ENTITY_PRICE, rules.ENTITY_NUMBER, rules.KEYWORD_RUN]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[T.found_all(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for r in rows:
        for i, p in enumerate(patterns):
            q = p.replace(r"[\p{L}\p{N}_]", r"\w")
            assert r[f"p{i}"] == [m[0] for m in re.finditer(q, r.t)], (p, r.t)


def reasons(spark, rows, **options):
    f = QualityFilter(**options)
    df = spark.createDataFrame(rows, "row_id long, text string, prompt string, response string")
    return [r.reason_code for r in f.flagged(df).orderBy("row_id").collect()], f, df


def test_first_failing_rule_wins(spark):
    good = "这是一段足够长而且没有什么重复内容的普通商品介绍文字。"
    rows = [(1, good, None, None), (2, "  ", None, None), (3, "短", None, None), (4, "哈" * 40, None, None), (5, "".join(f"{c}\"—“" for c in "甲乙丙丁戊己庚辛"), None, None), (6, None, "p", "r"), (7, "长" * 9000, None, None)]
    codes, f, df = reasons(spark, rows)
    assert codes == [None, "empty_text", "too_short", "repetition", "special_chars", "empty_text", "too_long"]
    s = f.stats(df).first()
    assert (s.original_count, s.filtered_count, s.removed_count) == (7, 1, 6)
    assert s.filter_reasons["empty_text"] == 2
    assert f.message() is not None and f.filter(df).columns == df.columns


def test_question_and_answer_mode(spark):
    rows = [(1, None, " ", "x"), (2, None, "x", ""), (3, None, "你好", "好的"), (4, None, "推荐一款手机给我父母使用", "可以考虑大字体而且续航久的型号")]
    codes, _, _ = reasons(spark, rows, require_qa_pair=True)
    assert codes == ["empty_prompt", "empty_response", "too_short", None]


def test_bounds_are_inclusive(spark):
    codes, _, _ = reasons(spark, [(1, "abcdefghijklmnopqrst", None, None), (2, "abcdefghijklmnopqrs ", None, None)], max_repetition_ratio=0.0)
    assert codes == [None, "too_short"]


def test_empty_table(spark):
    _, f, df = reasons(spark, [(1, "x", None, None)])
    s = f.stats(df.where("false")).first()
    assert (s.original_count, s.filtered_count, s.filter_ratio) == (0, 0, 0.0)


def test_a_filter_on_repetition_runs_it_once_in_small_batches(spark):
    from weftcorpus import queries

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plan = queries.quality_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
