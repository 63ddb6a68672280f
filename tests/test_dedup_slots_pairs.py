import random

from pyspark.sql import functions as F

from weftcorpus.operators.dedup import MinHashDeduplicator, grams, optimal_bands, signature
from weftcorpus.operators.pairs import PreferencePairBuilder
from weftcorpus.operators.rewrite import TemplateRewriter, prompt
from weftcorpus.operators.slots import SlotAnnotator


def test_band_layout():
    assert optimal_bands(0.85, 128) == (8, 16)


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 512, dtype=np.uint64)
    random.seed(1)
    t = "".join(random.choice("abcdefgh") for _ in range(400))
    u = t[:360] + "".join(random.choice("ijkl") for _ in range(40))
    x, y = set(grams(t, 3)), set(grams(u, 3))
    same = (signature(grams(t, 3), a, b) == signature(grams(u, 3), a, b)).mean()
    assert abs(same - len(x & y) / len(x | y)) < 0.1


def greedy(bands: dict):
    kept = []
    for row in sorted(bands):
        if not any(bands[row] & bands[k] for k in kept):
            kept.append(row)
    return kept


def test_a_dropped_row_drops_nothing(spark):
    """The kept rows are those of a loop in input order, also along chains."""

    class Fixed(MinHashDeduplicator):
        def bands(self, df):
            return df.select(F.col("row_id").alias("row"), F.explode(F.split("text", ",")).alias("x")).select("row", F.lit(0).alias("band"), F.xxhash64("x").alias("hash"))

    random.seed(5)
    for n in range(3):
        table = {i: {f"{random.randrange(25)}" for _ in range(2)} for i in range(40)} if n else {0: {"a"}, 1: {"a", "b"}, 2: {"b", "c"}, 3: {"c", "d"}, 4: {"d"}}
        df = spark.createDataFrame([(i, ",".join(sorted(s))) for i, s in table.items()], "row_id long, text string")
        assert sorted(r.row_id for r in Fixed().dedup(df).collect()) == greedy(table)


class Listed(MinHashDeduplicator):
    """Rows whose bands are listed."""

    def bands(self, df):
        return df.select(F.col("row_id").alias("row"), F.explode("bands").alias("hash")).select("row", F.lit(0).alias("band"), "hash")


def test_ranges_give_the_loops_answer(spark):
    random.seed(8)
    for size in (1, 7, 40, 10_000):
        table = {i: {random.randrange(60) for _ in range(random.randrange(1, 4))} | ({99} if i % 3 == 0 else set()) for i in range(150)}
        df = spark.createDataFrame([(i, "t", sorted(b)) for i, b in table.items()], "row_id long, text string, bands array<long>").repartition(5)
        assert sorted(r.row_id for r in Listed(range_rows=size).dedup(df).collect()) == greedy(table)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from weftcorpus.operators import dedup

    rounds = []
    monkeypatch.setattr(dedup, "written", lambda df, name, real=dedup.written: rounds.append(name) or real(df, name))
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("t").alias("text"), F.array(F.col("id"), F.col("id") + 1).alias("bands"))
    kept = Listed(range_rows=50_000).dedup(df)
    assert kept.count() == n // 2 and kept.where("row_id % 2 = 1").count() == 0
    assert rounds.count("kept") <= 6


def test_verified_ranges_give_the_loops_answer(spark, monkeypatch):
    """Rows that share a band and are unlike stay; they take a round for each range, not one each."""
    from weftcorpus.operators import dedup

    rounds = []
    monkeypatch.setattr(dedup, "written", lambda df, name, real=dedup.written: rounds.append(name) or real(df, name))
    random.seed(4)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts, table = {}, {}
    for i in range(120):
        own = texts[random.randrange(i)].split() if i % 2 else random.sample(words, 12)
        texts[i] = " ".join(own[:-1] + [random.choice(words)]) if i % 4 < 2 else " ".join(own)
        table[i] = {random.randrange(30) for _ in range(2)} | {99}
    shingles = {i: {t[j : j + 3] for j in range(len(t) - 2)} for i, t in texts.items()}
    kept = []
    for i in sorted(table):
        if not any(table[i] & table[k] and len(shingles[i] & shingles[k]) >= 0.85 * len(shingles[i] | shingles[k]) for k in kept):
            kept.append(i)
    assert 40 < len(kept) < 115
    df = spark.createDataFrame([(i, texts[i], sorted(b)) for i, b in table.items()], "row_id long, text string, bands array<long>").repartition(5)
    for size in (40, 10_000):
        rounds.clear()
        got = sorted(r.row_id for r in Listed(verify=True, range_rows=size).dedup(df).collect())
        assert got == kept and rounds.count("goes") <= (1 if size == 10_000 else 12)


def test_unlike_rows_of_a_bucket_take_no_rounds(spark, monkeypatch):
    """Rounds follow similar rows, not the ranges that rows of a bucket lie in."""
    from weftcorpus.operators import dedup

    names = []
    monkeypatch.setattr(dedup, "written", lambda df, name, real=dedup.written: names.append(name) or real(df, name))
    random.seed(6)
    texts = {i: "".join(random.choice("abcdefghijklmnop") for _ in range(40)) for i in range(120)}
    texts |= {i: texts[0] + random.choice("abcdef") for i in range(120, 160)} | {i: texts[i % 7] for i in range(160, 200)}
    df = spark.createDataFrame([(i, t, [1, 2 + i % 2]) for i, t in texts.items()], "row_id long, text string, bands array<long>").repartition(5)
    assert sorted(r.row_id for r in Listed(verify=True, range_rows=20).dedup(df).collect()) == list(range(120))
    assert names.count("goes") <= 2 and len(names) < 40


def test_tiles_find_what_the_loop_finds(spark):
    """Whatever the size of tiles, with copies, rows that share an id and rows that are first in some of their buckets only."""
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts, table = {}, {}
    for i in range(150):
        own = texts[random.randrange(i)].split() if i % 3 else random.sample(words, 12)
        texts[i] = " ".join(own[:-1] + [random.choice(words)]) if i % 4 < 2 else " ".join(own)
        table[i] = {random.randrange(25) for _ in range(3)}
    twice = {i: texts[i + 1] for i in range(0, 149, 10)}
    sets = {i: [{t[j : j + 3] for j in range(len(t) - 2)} for t in [texts[i], *([twice[i]] if i in twice else [])]] for i in texts}
    kept = []
    for i in sorted(table):
        if not any(table[i] & table[k] and any(len(x & y) >= 0.85 * len(x | y) for x in sets[i] for y in sets[k]) for k in kept):
            kept.append(i)
    assert 40 < len(kept) < 140
    df = spark.createDataFrame([(i, t, sorted(table[i])) for part in (texts, twice) for i, t in part.items()], "row_id long, text string, bands array<long>").repartition(5)
    for options in ({"tile_rows": 4}, {"range_rows": 100}):
        gone = {r.row for r in Listed(verify=True, **options).dropped(df).collect()}
        assert sorted(set(table) - gone) == kept


def test_common_counts_and_packed_sets():
    import numpy as np

    from weftcorpus.operators.dedup import common_counts, packed, unpacked

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64) * np.uint64(1 << 55)) for n in (0, 1, 50, 200, 400)]
    assert all((unpacked(packed(x)) == x).all() and len(unpacked(packed(x))) == len(x) for x in sets)
    every = np.arange(len(sets))
    for columns in (3, 4096):
        got = common_counts(sets, every, every[1:], columns)
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[1:]] for x in sets]
        assert [[v if i != j + 1 else len(sets[i]) for j, v in enumerate(r)] for i, r in enumerate(got.tolist())] == want


def test_dedup_of_copies_empty_and_missing_texts(spark):
    t = "这款手机屏幕很大，电池也耐用，拍照清晰，适合长辈使用。"
    rows = [(1, t, None, None), (2, t, None, None), (3, "", "问", t), (4, None, None, None), (5, " ", None, None), (6, "完全不同的一句话，讲的是另一件事情。", None, None), (7, t + "！", None, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, prompt string, response string")
    for verify in (False, True):
        d = MinHashDeduplicator(verify=verify)
        kept = d.dedup(df)
        ids = sorted(r.row_id for r in kept.collect())
        assert ids[:1] == [1] and 2 not in ids and 4 not in ids and 6 in ids
        assert d.stats(df, kept).first().original_count == 7
    assert MinHashDeduplicator().dedup(df.where("false")).count() == 0


def annotated(spark, text, **options):
    df = spark.createDataFrame([(1, text, None)], "row_id long, text string, response string")
    return SlotAnnotator(**options).annotate(df).first()


def test_spans_go_left_to_right_and_longest_first(spark):
    r = annotated(spark, "售价：199元")
    assert r.text == '<slot type="price">售价：199</slot>元' and r.text_original == "售价：199元" and r.slots == {"price": ["售价：199"]}
    assert annotated(spark, "¥1,299.00").slots == {"price": ["¥1,299.00"]}
    assert annotated(spark, "满300减50").slots == {"promotion": ["满300减50"]}
    assert annotated(spark, "优惠50").slots == {"promotion": ["优惠50"]}
    r = annotated(spark, "华为现货，华为😀小米")
    assert r.slots == {"brand": ["华为", "小米"], "stock": ["现货"]}
    assert r.text == '<slot type="brand">华为</slot><slot type="stock">现货</slot>，<slot type="brand">华为</slot>😀<slot type="brand">小米</slot>'


def test_empty_fields_have_no_original(spark):
    df = spark.createDataFrame([(1, "", "无"), (2, None, "今天有货")], "row_id long, text string, response string")
    a = SlotAnnotator()
    out = a.annotate(df)
    rows = out.orderBy("row_id").collect()
    assert rows[0].text == "" and rows[0].text_original is None and rows[0].slots == {}
    assert rows[1].text is None and rows[1].slots == {"date": ["今天"], "stock": ["有货"]}
    s = a.stats(out).first()
    assert (s.total, s.items_with_slots) == (2, 1) and s.slot_counts == {"price": 0, "date": 1, "stock": 1, "promotion": 0, "brand": 0}
    assert annotated(spark, "华为现货", slot_types=("stock",)).slots == {"stock": ["现货"]}


def pairs(spark, rows, strategy, **options):
    df = spark.createDataFrame(rows, "row_id long, prompt string, chosen string, rejected string, responses array<struct<text:string,score:double>>")
    b = PreferencePairBuilder(strategy, **options)
    return b.build(df).collect(), b.stats(df).first()


def test_score_pairs(spark):
    c = lambda *xs: [{"text": t, "score": s} for t, s in xs]
    rows = [(1, "q", None, None, c(("A", 4.5), ("B", 2.0))), (2, "q", None, None, c(("A", 3.0), ("B", 2.5))), (3, "q", None, None, c(("A", 3.0), ("B", 2.0))), (4, "q", None, None, c(("A", 4.0), ("B", 1.0), ("C", 1.0))), (5, "q", None, None, c(("A", 1.0))), (6, "q", None, None, c(("A", 3.0), ("", 0.0))), (7, "q", None, None, None), (8, "q", None, None, c(("A", 2.0), ("B", None)))]
    got, stats = pairs(spark, rows, "score_diff")
    assert [(r.chosen, r.rejected, r.score_diff) for r in got] == [("A", "B", 2.5), ("A", "B", 1.0), ("A", "C", 3.0), ("A", "B", 2.0)]
    assert (stats.input_count, stats.pairs_count, stats.skip_count, stats.strategy_distribution) == (8, 4, 4, {"score_diff": 4})


def test_rule_human_and_mixed_pairs(spark):
    c = [{"text": "好用", "score": 1.0}, {"text": "可能不错", "score": 1.5}]
    got, _ = pairs(spark, [(1, "q", None, None, c)], "rule_based")
    assert (got[0].chosen, got[0].rejected, got[0].score_diff) == ("好用", "可能不错", None)
    rows = [(1, "q", "好", "坏", c), (2, "q", "好", "", c), (3, "", "好", "坏", None), (4, "q", None, None, [{"text": "甲", "score": 9.0}, {"text": "乙", "score": 1.0}])]
    got, stats = pairs(spark, rows, "mixed")
    assert [r.build_strategy for r in got] == ["human", "rule_based", "score_diff"]
    assert stats.skip_count == 1


def test_rewriting(spark):
    df = spark.createDataFrame([(1, "这是一个比较长的回答文本"), (2, ""), (3, None)], "row_id long, response string")
    plain = TemplateRewriter()
    out = plain.rewrite(df).orderBy("row_id").collect()
    assert out[0].response == "这是一个比较长的回答文本" and out[0].rewrite_style in plain.styles and out[1].rewrite_style is None and out[2].response is None
    louder = TemplateRewriter(generate=lambda p: F.lit("改写之后也还是一个比较长的回答"))
    after = louder.rewrite(df)
    assert after.orderBy("row_id").first().response == "改写之后也还是一个比较长的回答"
    s = louder.stats(df, after).first()
    assert s.total == 3 and s.success_count == 1 and s.fail_count == 2 and sum(s.style_distribution.values()) == 1 and set(s.style_distribution) == set(louder.styles)
    p = spark.range(1).select(prompt(F.lit("好"), F.lit("unknown")).alias("p")).first().p
    assert "更简洁" in p and p.endswith("改写后：") and "好" in p
