"""Submission rules over reference lists: one summary for each document, then one row for each rule that is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import any_word, js_round, let, staged, text_of
from foliospark.operators.stats import year_number

PUBLISHERS = "(?i)\\b(elsevier|springer|wiley|sage|taylor\\s*&\\s*francis|ieee|emerald|nature|science direct|mdpi|jstor)\\b"


def origin(raw: Column | str) -> Column:
    """struct<origin, confidence>: local by word or domain (high), by ISSN without an international publisher (low), else international (low)."""
    return let(F.lower(text_of(raw)), _origin_of)


def _origin_of(t: Column) -> Column:
    local = t.rlike(any_word(dims.LOCAL_WORDS)) | (t.contains(".id") & t.rlike("\\.ac\\.id\\b|\\.go\\.id\\b|\\.or\\.id\\b|\\.id/\\S*$"))
    weak = t.contains("issn") & t.rlike("\\bp-?issn\\b|\\be-?issn\\b") & ~t.rlike(PUBLISHERS)
    return F.struct(F.when(local | weak, "local").otherwise("international").alias("origin"), F.when(local, "high").otherwise("low").alias("confidence"))


def with_origin(refs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """References with origin and its confidence; an override (doc_id, line_no, origin) replaces the guess."""
    out = staged(staged(refs, low=F.lower(text_of("raw"))), o=_origin_of(F.col("low"))).select(*refs.columns, F.col("o.origin").alias("origin"), F.col("o.confidence").alias("origin_confidence"))
    if overrides is None:
        return out
    manual = overrides.select("doc_id", "line_no", F.col("origin").alias("manual"))
    out = out.join(manual, ["doc_id", "line_no"], "left")
    return out.withColumn("origin", F.coalesce("manual", "origin")).withColumn("origin_confidence", F.when(F.col("manual").isNotNull(), "manual").otherwise(F.col("origin_confidence"))).drop("manual")


def reference_summary(refs: DataFrame, as_of: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """doc_id, as_of_year and kinds: how many references of each (year, source type, origin, registry status) a document has.

    References are counted twice, first by kind and then into one array for each document, so what any number of rule sets is evaluated on is one
    row a document with as many entries as it has different kinds.
    """
    if statuses is not None:
        refs = refs.join(statuses.select("doc_id", "line_no", "status"), ["doc_id", "line_no"], "left")
    else:
        refs = refs.withColumn("status", F.lit(None).cast("string"))
    kind = [year_number().alias("y"), F.col("source_type").alias("st"), (F.col("origin") == "international").alias("intl"), F.col("status")]
    counted = refs.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("doc_id").agg(F.collect_list(F.struct("y", "st", "intl", "status", "n")).alias("kinds"))
    return rows.join(as_of.select("doc_id", "as_of_year"), "doc_id")


#: Rule sets that may be broadcast; more are dealt out as a table of their own.
MOST_RULE_SETS = 10_000


def evaluate_rules(refs: DataFrame, rules: DataFrame, as_of: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """doc_id, rule_set, rule_id, actual, required and pass of every rule that is on.

    refs: with origin. as_of: doc_id, as_of_year. statuses: registry results; without any for a document that rule fails with a null
    actual. Every document meets every rule set after references are summed up, so only that result has a row for each of both.
    """
    few = rules.limit(MOST_RULE_SETS + 1).count() <= MOST_RULE_SETS
    r = reference_summary(refs, as_of, statuses).crossJoin(F.broadcast(rules) if few else rules)
    counted = lambda p: F.aggregate(F.filter("kinds", p), F.lit(0).cast("long"), lambda n, k: n + k["n"])
    share = lambda part, whole: F.when(whole > 0, js_round(100.0 * part / whole, 1)).otherwise(0.0)
    n = counted(lambda k: F.lit(True))
    recent = share(counted(lambda k: k["y"] >= F.col("as_of_year") - F.col("years")), counted(lambda k: k["y"].isNotNull()))
    listed = F.when(counted(lambda k: k["status"].isNotNull()) > 0, share(counted(lambda k: k["status"].isin("SCOPUS", "SCOPUS_SOURCE_ONLY")), n))
    checks = [
        ("min_count", n.cast("double"), "min_count"), ("year_range", recent, "years_min_pct"), ("source_type", share(counted(lambda k: k["st"] == F.col("source_type")), n), "type_min_pct"),
        ("origin", share(counted(lambda k: k["intl"]), n), "intl_min_pct"), ("registry", listed, "registry_min_pct"),
    ]
    made = F.array(*[F.when(F.col(need).isNotNull(), F.struct(F.lit(k).alias("rule_id"), actual.alias("actual"), F.col(need).cast("double").alias("required"))) for k, actual, need in checks])
    return r.select("doc_id", "rule_set", F.explode(F.array_compact(made)).alias("c")).select("doc_id", "rule_set", "c.*", F.coalesce(F.col("c.actual") >= F.col("c.required"), F.lit(False)).alias("pass"))


def rule_summary(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """doc_id, passed, failed and overall of every document; without a rule overall is false."""
    g = checks.groupBy("doc_id").agg(F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"), F.bool_and("pass").alias("overall"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(g, "doc_id", "left").select("doc_id", zero("passed"), zero("failed"), F.coalesce("overall", F.lit(False)).alias("overall"))
