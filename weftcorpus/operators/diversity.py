"""Corpus metrics of how alike responses are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T
from weftcorpus.functions.segment import word_ngrams
from weftcorpus.sources.shared import written


def _keys(by: Sequence[str], *more: str) -> list[str]:
    return [*by, *more]


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-row (or one-row-a-group) results side by side."""
    return left.join(right, list(by), "left") if by else left.crossJoin(right)


class _Tile:
    """The vectors of a tile, from its Arrow rows: copies of each; row, term, weight and place of each entry; which are in a prefix."""

    def __init__(self, rows: pa.StructArray):
        lists = rows.field("terms")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.copies = rows.field("copies").to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.term = lists.flatten().to_numpy(zero_copy_only=False)
        self.weight = rows.field("weights").flatten().to_numpy(zero_copy_only=False)
        place = np.arange(len(self.row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.listed = place < rows.field("prefix").to_numpy(zero_copy_only=False)[self.row]

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.copies), len(columns)))
        out[self.row, np.searchsorted(columns, self.term)] = self.weight
        return out

    def prefixes(self, columns: np.ndarray) -> np.ndarray:
        """1 for each of these terms that is in a vector's prefix."""
        out = np.zeros((len(self.copies), len(columns)), np.float32)
        own = self.listed & (self.term <= columns[-1])
        out[self.row[own], np.searchsorted(columns, self.term[own])] = 1
        return out


def _alike(term: int, lo: _Tile, hi: _Tile, same: bool, threshold: float) -> int:
    """How many pairs of responses (one of a class of lo, one of a class of hi) have a cosine of threshold or more and share `term`,
    but no rarer term, in their prefixes. Terms are numbered from the rarest on."""
    columns = np.unique(np.concatenate([lo.term, hi.term]))
    hit = lo.matrix(columns) @ hi.matrix(columns).T >= threshold
    if same:
        hit &= np.arange(hit.shape[0])[:, None] < np.arange(hit.shape[1])[None, :]
    rarer = columns[columns < term]
    if len(rarer) and hit.any():
        hit &= lo.prefixes(rarer) @ hi.prefixes(rarer).T == 0
    return int(lo.copies @ hit @ hi.copies)


@dataclass(frozen=True)
class TemplateRateEvaluator:
    """Empty responses don't count. Every method takes the columns to group by, none for the whole table."""

    ngram_sizes: tuple[int, ...] = (2, 3, 4)
    cluster_threshold: float = 0.85
    response_field: str = "response"
    id_field: str = "row_id"
    max_features: int = 5000
    #: So many responses of a term are multiplied out at once.
    tile: int = 512
    #: From a column of texts to their words (arrays); characters where none is given.
    words: Callable[[Column], Column] | None = None

    def responses(self, df: DataFrame, *by: str) -> DataFrame:
        return df.where(T.text(self.response_field) != "").select(*by, F.col(self.id_field).alias("_id"), F.col(self.response_field).alias("_r"))

    def classes(self, df: DataFrame, *by: str) -> DataFrame:
        """(by..., _r, class, copies): each distinct response, its least id and how often it occurs. Whatever
        hangs on a response's text alone is worked out once for each of them."""
        return self.responses(df, *by).groupBy(*by, "_r").agg(F.min("_id").alias("class"), F.count("*").alias("copies"))

    def ngrams(self, df: DataFrame, *by: str, classes: DataFrame | None = None) -> DataFrame:
        """For each size: n_grams, n_distinct and n_repeated (occurrences of grams that occur more than once)."""
        r = self.classes(df, *by) if classes is None else classes
        if self.words:
            r = r.withColumn("_w", self.words(T.tokens(F.col("_r"))))
            grams = lambda n: F.transform(word_ngrams(F.col("_w"), n), lambda g: F.array_join(g, "\x01"))
        else:
            grams = lambda n: T.char_ngrams(T.tokens(F.col("_r")), n)
        sized = lambda n: F.transform(grams(n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
        every = F.concat(*map(sized, self.ngram_sizes))
        counts = r.select(*by, "copies", F.explode(every).alias("g")).groupBy(*by, "g.n", "g.gram").agg(F.sum("copies").alias("c"))
        return counts.groupBy(*by, "n").agg(F.sum("c").alias("n_grams"), F.count("*").alias("n_distinct"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_repeated"))

    def cross_response(self, df: DataFrame, *by: str, classes: DataFrame | None = None) -> DataFrame:
        """total_responses, cross_ngram_rep_n for every size and distinct_n for the first two."""
        classes = self.classes(df, *by) if classes is None else classes
        matching = F.sum(F.when(T.matches_any(F.col("_r"), rules.TEMPLATE_SENTENCES), F.col("copies")).otherwise(0))
        r = classes.groupBy(*by).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_responses"), (matching / F.sum("copies")).alias("sentence_pattern_rate"))
        at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
        wide = self.ngrams(df, *by, classes=classes).groupBy(*by).agg(*[at(n, c).alias(f"_{c}_{n}") for n in self.ngram_sizes for c in ("n_grams", "n_distinct", "n_repeated")])
        both = _join(r, wide, by)
        rep = {f"cross_ngram_rep_{n}": F.when(F.col("total_responses") < 2, 0.0).otherwise(F.coalesce(F.col(f"_n_repeated_{n}") / F.col(f"_n_grams_{n}"), F.lit(0.0))) for n in self.ngram_sizes}
        distinct = {f"distinct_{n}": F.coalesce(F.col(f"_n_distinct_{n}") / F.col(f"_n_grams_{n}"), F.lit(1.0)) for n in self.ngram_sizes[:2]}
        return both.select(*by, "total_responses", F.coalesce("sentence_pattern_rate", F.lit(0.0)).alias("sentence_pattern_rate"), *[c.alias(k) for k, c in {**rep, **distinct}.items()])

    def weights(self, df: DataFrame, *by: str, classes: DataFrame | None = None) -> DataFrame:
        """TF-IDF of character 2- and 3-grams of the spaced text: (class, copies, term, w, df, place), rows of
        length 1; a class is a distinct response, of size `copies`, `place` the term's number."""
        spaced = F.regexp_replace(F.lower(F.regexp_replace("_r", "(?s)(.)(?!\\z)", "$1 ")), r"(?U)[\s\x1c-\x1f]{2,}", " ")
        classes = self.classes(df, *by) if classes is None else classes
        n = classes.groupBy(*by).agg(F.sum("copies").alias("n"))
        grams = F.explode(F.concat(T.char_ngrams(spaced, 2), T.char_ngrams(spaced, 3)))
        tf = classes.select(*by, "class", "copies", grams.alias("term")).groupBy(*by, "class", "copies", "term").agg(F.count("*").alias("tf"))
        totals = tf.groupBy(*by, "term").agg(F.sum(F.col("tf") * F.col("copies")).alias("total"), F.sum("copies").alias("df"))
        # the most frequent of each share of the terms, then of those: no window has a group's whole vocabulary
        rank = lambda *keys: F.row_number().over(Window.partitionBy(*by, *keys).orderBy(F.desc("total"), "term"))
        most = totals.withColumn("share", F.pmod(F.xxhash64("term"), F.lit(64))).withColumn("place", rank("share")).where(F.col("place") <= self.max_features)
        top = most.withColumn("place", rank(F.lit(0))).where(F.col("place") <= self.max_features)
        rarity = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("df", "term"))
        top = _join(top.select(*by, "term", "df", rarity.alias("place")), n, by).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
        top = written(top.select(*by, "term", "df", "place", "idf"), "terms")
        # max_features rows for each group: broadcast only while the groups are few
        w = tf.join(F.broadcast(top) if top.count() <= 100_000 else top, _keys(by, "term")).withColumn("x", F.col("tf") * F.col("idf"))
        return w.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by, "class")))).select(*by, "class", "copies", "term", "w", "df", "place")

    def vectors(self, df: DataFrame, *by: str, classes: DataFrame | None = None) -> DataFrame:
        """(by..., class, copies, terms, weights, prefix): a row for each distinct response, its terms from the rarest on; prefix
        is how many of them to look at: what comes behind is shorter than the threshold."""
        t = self.cluster_threshold
        v = self.weights(df, *by, classes=classes).groupBy(*by, "class", "copies").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("v"))
        tails = F.aggregate(
            F.reverse("v"),
            F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("short")),
            lambda a, x: F.struct((a["sum"] + x["w"] * x["w"]).alias("sum"), (a["short"] + (a["sum"] + x["w"] * x["w"] < t * t - 1e-9).cast("int")).alias("short")),
            lambda a: a["short"],
        )
        return v.select(*by, "class", "copies", F.col("v.place").alias("terms"), F.col("v.w").alias("weights"), (F.size("v") - tails).alias("prefix"))

    def cluster_rate(self, df: DataFrame, *by: str, classes: DataFrame | None = None) -> DataFrame:
        """semantic_cluster_rate: the share of all pairs of responses with a cosine of cluster_threshold or more.

        Two vectors that reach the threshold share a term of both their prefixes, their rarest terms. So the vectors
        are posted under the terms of their prefixes; the postings of a term are cut into tiles of bounded size, and
        pairs of tiles, dealt over all tasks whatever their term, are multiplied as matrices. A pair counts under the
        rarest term that its prefixes share. Only counts leave a task, never pairs."""
        t, size = self.cluster_threshold, self.tile
        classes = written(self.classes(df, *by), "classes") if classes is None else classes
        v = written(self.vectors(df, *by, classes=classes), "vectors")
        posted = v.select(*by, F.struct("class", "copies", "terms", "weights", "prefix").alias("c"), F.explode(F.slice("terms", F.lit(1), F.col("prefix"))).alias("term"))
        # a row for each term of each group
        tiles = v.select(*by, F.explode(F.slice("terms", F.lit(1), F.col("prefix"))).alias("term")).groupBy(*by, "term").agg(F.ceil(F.count("*") / size).cast("int").alias("n"), F.count("*").alias("m")).where("m > 1").drop("m")
        tiles = written(tiles, "tiles")
        placed = posted.join(F.broadcast(tiles) if tiles.count() <= 200_000 else tiles, _keys(by, "term")).withColumn("tile", F.pmod(F.xxhash64("c.class"), F.col("n")).cast("int"))
        packed = written(placed.groupBy(*by, "term", "tile", "n").agg(F.collect_list("c").alias("c")), "packed")
        lo = packed.select(*by, "term", F.col("tile").alias("lo"), F.explode(F.sequence("tile", F.col("n") - 1)).alias("hi"), F.col("c").alias("a"))
        hi = packed.select(*by, "term", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("lo"), F.col("tile").alias("hi"), F.col("c").alias("b"))
        pairs = lo.join(hi.hint("shuffle_hash"), _keys(by, "term", "lo", "hi")).select(*by, "term", (F.col("lo") == F.col("hi")).alias("same"), "a", "b")

        def run(batches):
            for batch in batches:
                at = len(by)
                terms, same, a, b = (batch.column(at + i) for i in range(4))
                found = [_alike(terms[i].as_py(), _Tile(a[i].values), _Tile(b[i].values), same[i].as_py(), t) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(found, pa.int64())], [*by, "k"])

        kinds = dict(df.dtypes)
        across = pairs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "k long"]))
        within = v.select(*by, (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("k"))
        hits = across.unionByName(within).groupBy(*by).agg(F.sum("k").alias("k"))
        n = classes.groupBy(*by).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("m"))
        rate = F.coalesce(F.col("k"), F.lit(0)) / F.greatest(F.col("m") * (F.col("m") - 1) / 2, F.lit(1))
        return _join(n, hits, by).select(*by, rate.alias("semantic_cluster_rate"))

    def evaluate(self, df: DataFrame, *by: str) -> DataFrame:
        """All metrics, overall_template_rate and template_rate_percentage."""
        classes = written(self.classes(df, *by), "classes")
        out = _join(self.cross_response(df, *by, classes=classes), self.cluster_rate(df, *by, classes=classes), by)
        has = lambda c, d: F.col(c) if c in out.columns else F.lit(d)
        overall = (has("cross_ngram_rep_3", 0.0) + F.col("sentence_pattern_rate") + F.col("semantic_cluster_rate") + (F.lit(1.0) - has("distinct_2", 1.0))) / 4
        return out.withColumn("overall_template_rate", overall).withColumn("template_rate_percentage", F.col("overall_template_rate") * 100)


def sentence_pattern(c: Column) -> Column:
    return T.matches_any(c, rules.TEMPLATE_SENTENCES)
