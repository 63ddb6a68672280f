"""Error buckets of responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T


def reason(r: Column, rule: dict) -> Column:
    """Why a response falls into a bucket, or null. A length out of bounds comes before the patterns."""
    n = T.stripped_length(r)
    out = F.when(F.lit(False), F.lit(""))
    if "min_length" in rule:
        out = out.when(n < rule["min_length"], F.format_string(rules.TOO_SHORT, n))
    if "max_length" in rule:
        out = out.when(n > rule["max_length"], F.format_string(rules.TOO_LONG, n))
    for p in rule["patterns"]:
        out = out.when(r.rlike(T.rx(p)), F.format_string(rules.MATCHED, F.substring(F.regexp_extract(r, T.rx(p), 0), 1, 50)))
    return out


@dataclass(frozen=True)
class ErrorBucketing:
    response_field: str = "response"
    question_field: str = "question"
    id_field: str = "row_id"

    def bucket(self, df: DataFrame) -> DataFrame:
        """df with error_types, primary_error, error_details, has_error and needs_human_review."""
        r = T.text(self.response_field)
        found = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), reason(r, v).alias("reason")) for k, v in rules.ERRORS.items()]), lambda e: e["reason"].isNotNull())
        out = df.withColumn("_e", found)
        out = out.withColumn("error_types", F.transform("_e", lambda e: e["type"])).withColumn("error_details", F.map_from_entries("_e"))
        return out.withColumns(
            {"primary_error": F.coalesce(F.get("error_types", F.lit(0)), F.lit(rules.NO_ERROR)), "has_error": F.size("error_types") > 0, "needs_human_review": F.arrays_overlap("error_types", F.array(*map(F.lit, rules.REVIEWED_ERRORS)))}
        ).drop("_e")

    @staticmethod
    def summary_columns() -> list[Column]:
        """error_counts (several a response, zeros too; no_error never counts), error_rate, human_review_needed."""
        kinds = [*rules.ERRORS, rules.NO_ERROR]
        counts = F.create_map(*[x for k in kinds for x in (F.lit(k), F.count_if(F.array_contains("error_types", k)))])
        return [counts.alias("error_counts"), T.safe_ratio(F.count_if("has_error"), F.count("*")).alias("error_rate"), F.count_if("needs_human_review").alias("human_review_needed")]

    def stats(self, df: DataFrame, *by: str) -> DataFrame:
        return self.bucket(df).groupBy(*by).agg(F.count("*").alias("total"), *self.summary_columns())

    def matrix(self, df: DataFrame, by: str = "model") -> DataFrame:
        """Errors by group and kind at all levels, from one scan: by, error_type (null where a level has all of them), level
        (grouping_id: 0 a group's kind, 1 a group, 2 a kind, 3 all), n (errors; rows without one count as no_error)
        and share, of the group at level 0, of all groups or kinds at levels 1 and 2."""
        kinds = F.when(F.size("error_types") > 0, F.col("error_types")).otherwise(F.array(F.lit(rules.NO_ERROR)))
        every = self.bucket(df).select(F.col(by), F.explode(kinds).alias("error_type")).cube(by, "error_type").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))
        # the cube has a row for each group and kind: its windows are small
        whole = F.sum("n").over(Window.partitionBy("level", F.when(F.col("level") == 0, F.struct(by))))
        return every.select(by, "error_type", "level", "n", T.safe_ratio(F.col("n"), whole).alias("share"))

    def examples(self, df: DataFrame, most: int = 3) -> DataFrame:
        """The first rows of each primary bucket, responses cut to 200 characters."""
        q = T.text(self.question_field) if self.question_field in df.columns else F.lit("")
        rows = self.bucket(df).select(self.id_field, "primary_error", q.alias("question"), F.substring(T.text(self.response_field), 1, 200).alias("response"), "error_types")
        w = Window.partitionBy("primary_error").orderBy(self.id_field)
        return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
