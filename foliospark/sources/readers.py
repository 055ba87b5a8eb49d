"""Scans. Schemas are stated, so no file is read to infer one, and all columns can be pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOI_WORKS = (
    "doi string, title array<string>, author array<struct<family:string,given:string>>, "
    "issued struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>"
)
DOCUMENTS = "doi string, title string, firstAuthor string, journal string, issn string, eissn string, year string, volume string, issue string, pages string, articleNumber string"
RULES = (
    "rule_set string, minCount struct<enabled:boolean,min:int>, yearRange struct<enabled:boolean,years:int,minPercent:double>, "
    "sourceType struct<enabled:boolean,type:string,minPercent:double>, origin struct<enabled:boolean,minPercent:double>, scopus struct<enabled:boolean,minPercent:double>"
)


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text files, one manuscript each: path and text. A folder of Parquet with doc_id and text is read by ``spark.read`` itself."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {doc_id, paragraphs[], tableCount, imageCount} as paragraph rows with the document's counts."""
    docs = spark.read.schema("doc_id long, paragraphs array<string>, tableCount int, imageCount int").json(path)
    return docs.select(
        "doc_id",
        F.posexplode_outer("paragraphs").alias("para_no", "text"),
        F.coalesce("tableCount", F.lit(0)).alias("table_count"),
        F.coalesce("imageCount", F.lit(0)).alias("image_count"),
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run rows (doc_id, para_no, run_no, text, italic) in Parquet; neighbouring runs of one flag become one."""
    return merge_runs(spark.read.schema("doc_id long, para_no int, run_no int, text string, italic boolean").parquet(path))


def merge_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "para_no").orderBy("run_no")
    flag = F.coalesce("italic", F.lit(False))
    islands = runs.where(F.length("text") > 0).withColumn("italic", flag).withColumn("turn", (F.lag("italic").over(w) != F.col("italic")).cast("int"))
    islands = islands.withColumn("island", F.coalesce(F.sum("turn").over(w), F.lit(0)))
    merged = islands.groupBy("doc_id", "para_no", "island", "italic").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(run_no, text))), x -> x.text), '')").alias("text")
    )
    return merged.select("doc_id", "para_no", F.col("island").cast("int").alias("run_no"), "text", "italic")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON array of arrays, cells as strings; rows may differ in length."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("load_order", "row"))


def _flag(c):
    return F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))


def read_registry_sources(spark: SparkSession, path: str) -> DataFrame:
    """Compact journal rows of six or nine columns; columns that are missing get their defaults."""
    cell = lambda k: F.get("row", F.lit(k))
    return _rows(spark, path).select(
        cell(0).alias("issn"), cell(1).alias("eissn"), cell(2).alias("title"), _flag(cell(3)).alias("active"), cell(4).alias("coverage"), cell(5).alias("source_type"),
        _flag(cell(6)).alias("discontinued"), F.nullif(cell(7), F.lit("")).alias("history_note"), F.nullif(cell(8), F.lit("")).alias("related_title"), "load_order",
    )


def read_registry_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(DOCUMENTS).json(path)
    return docs.select("doi", "title", F.col("firstAuthor").alias("first_author"), "journal", "issn", "eissn", "year", "volume", "issue", "pages", F.col("articleNumber").alias("article_number"))


def read_registry_proceedings(spark: SparkSession, path: str) -> DataFrame:
    cell = lambda k: F.get("row", F.lit(k))
    return _rows(spark, path).select(cell(0).alias("isbn"), cell(1).alias("title"), cell(2).cast("int").alias("year"), cell(3).alias("publisher"), "load_order")


def read_doi_works(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of DOI metadata: first title, authors and the year of each of the five dates."""
    year = lambda c: F.get(F.get(F.col(c)["date-parts"], F.lit(0)), F.lit(0))
    works = spark.read.schema(DOI_WORKS).json(path)
    return works.select(
        F.lower("doi").alias("doi"), F.get("title", F.lit(0)).alias("title"), F.col("author").alias("authors"), year("issued").alias("issued"), year("published").alias("published"),
        year("`published-print`").alias("published_print"), year("`published-online`").alias("published_online"), year("created").alias("created"),
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule sets, a null threshold where a rule is off, defaults where a rule is on without a value."""
    on = lambda rule, field, default: F.when(F.col(f"{rule}.enabled"), F.coalesce(F.col(f"{rule}.{field}"), F.lit(default)))
    return spark.read.schema(RULES).json(path).select(
        "rule_set", on("minCount", "min", 20).alias("min_count"), on("yearRange", "years", 5).alias("years"), on("yearRange", "minPercent", 80.0).alias("years_min_pct"),
        on("sourceType", "type", "journal-article").alias("source_type"), on("sourceType", "minPercent", 80.0).alias("type_min_pct"),
        on("origin", "minPercent", 50.0).alias("intl_min_pct"), on("scopus", "minPercent", 50.0).alias("registry_min_pct"),
    )
