"""Bibliographic text rendered from the star schema.

The given tables hold no citations, so manuscripts are rendered from orders and their lineitems with string
expressions that Spark and other SQL engines read alike: an order is a manuscript, a lineitem a reference. The truth about
every reference is known from the base columns, so an oracle needs no parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SURNAMES = ("Smith", "Garcia", "Okafor", "Tanaka", "Novak", "Silva", "Haddad", "Larsen")


def _pick(expression: str, values: tuple[str, ...]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: One row a reference: doc_id, line_no and what its text says. Null where the text leaves it out.
FACTS = f"""
SELECT doc_id, line_no, partkey, suppkey, surname, initial, n_authors,
       CASE WHEN partkey % 17 = 0 THEN NULL WHEN partkey % 11 = 0 THEN 'n.d.' ELSE yr END AS year,
       title, journal, volume, issue, first_page || '-' || last_page AS pages,
       CASE WHEN partkey % 5 = 0 THEN NULL ELSE '10.' || CAST(1000 + suppkey AS varchar(20)) || '/p' || CAST(partkey AS varchar(20)) END AS doi,
       (partkey + line_no) % 3 <> 0 AS cited
FROM (
  SELECT l_orderkey AS doc_id, l_partkey AS partkey, l_suppkey AS suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no,
         {_pick('l_suppkey % 8', SURNAMES)} AS surname,
         substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(l_partkey % 26 + 1 AS int), 1) AS initial,
         CASE WHEN l_partkey % 7 = 1 THEN 3 WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_authors,
         CAST(year(l_shipdate) AS varchar(4)) AS yr,
         'On the use of item' || CAST(l_partkey AS varchar(20)) || ' in a new way' AS title,
         'Journal of ' || replace(p_brand, '#', ' ') AS journal,
         CAST(10 + l_linenumber AS varchar(4)) AS volume, CAST(1 + l_suppkey % 4 AS varchar(4)) AS issue,
         CAST(l_partkey % 900 + 1 AS varchar(6)) AS first_page, CAST(l_partkey % 900 + 11 AS varchar(6)) AS last_page
  FROM lineitem JOIN part ON p_partkey = l_partkey
) base
"""

_APA_AUTHORS = "surname || ', ' || initial || '.' || CASE n_authors WHEN 2 THEN ', & Lee, K.' WHEN 3 THEN ', Brown, B., & Lee, K.' ELSE '' END"
_APA_LINE = f"""({_APA_AUTHORS}) || CASE WHEN year IS NULL THEN ' undated. ' ELSE ' (' || year || '). ' END || title || '. ' || journal || ', ' || volume || '(' || issue || '), ' || pages || '.'
 || coalesce(' https://doi.org/' || doi, '')"""
_APA_CITE = """CASE WHEN year IS NULL THEN '' WHEN line_no % 2 = 0
 THEN ' Earlier work (' || surname || CASE n_authors WHEN 2 THEN ' & Lee' WHEN 3 THEN ' et al.' ELSE '' END || ', ' || year || ') agrees.'
 ELSE ' However, ' || surname || CASE n_authors WHEN 2 THEN ' and Lee' WHEN 3 THEN ' et al.' ELSE '' END || ' (' || year || ') found this.' END"""
_IEEE_LINE = """'[' || CAST(line_no AS varchar(6)) || '] ' || initial || '. ' || surname || CASE n_authors WHEN 2 THEN ' and K. Lee' WHEN 3 THEN ', B. Brown, and K. Lee' ELSE '' END
 || ', "' || title || '," ' || journal || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || CASE WHEN year IS NULL OR year = 'n.d.' THEN '' ELSE ', ' || year END || '.' || coalesce(' doi: ' || doi, '')"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The named tables as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem", "part")
    return spark.sql(FACTS.replace("AS varchar(20)", "AS string").replace("AS varchar(4)", "AS string").replace("AS varchar(6)", "AS string"))


def _rendered(spark: SparkSession, sf_dir: str, line: str, cite: str, tail: str, style: str) -> DataFrame:
    facts(spark, sf_dir).createOrReplaceTempView("facts")
    spark_sql = f"""
    SELECT doc_id, 'Introduction\nThis order is studied here.' || array_join(transform(array_sort(collect_list(struct(line_no, cite))), x -> x.cite), '') || {tail} AS article,
           array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\n') AS reference_text,
           '{style}' AS style_id, 2002 AS as_of_year
    FROM (SELECT doc_id, line_no, {line} AS line, CASE WHEN cited THEN {cite} ELSE '' END AS cite FROM facts) r
    GROUP BY doc_id
    """
    for n in (4, 6, 20):
        spark_sql = spark_sql.replace(f"AS varchar({n})", "AS string")
    return spark.sql(spark_sql)


def apa_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, article, reference_text, style_id, as_of_year: author-date manuscripts; every seventh has a dangling citation."""
    return _rendered(spark, sf_dir, _APA_LINE, _APA_CITE, "CASE WHEN doc_id % 7 = 0 THEN ' Others disagree (Nobody, 1999).' ELSE '' END", "apa7")


def numeric_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders with numbered references: single citations, a range where three are there, a dangling number."""
    cite = "' See [' || CAST(line_no AS varchar(6)) || '].'"
    tail = "CASE WHEN count(*) >= 3 THEN ' In sum [1-3].' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' But see [99, 1].' ELSE '' END"
    return _rendered(spark, sf_dir, _IEEE_LINE, cite, tail, "ieee")


def full_texts(manuscripts: DataFrame) -> DataFrame:
    """doc_id and the whole text of manuscripts, reference list under its heading."""
    from pyspark.sql import functions as F

    return manuscripts.select("doc_id", F.concat("article", F.lit("\n\nReferences\n"), "reference_text").alias("text"))


#: A registry of works, one row for each DOI whose part isn't a third one, with the first year it was shipped in.
WORKS = f"SELECT doi, min(title) AS title, min(surname) AS family, min(CAST(CASE WHEN year = 'n.d.' OR year IS NULL THEN '1999' ELSE year END AS int)) AS issued FROM ({FACTS}) f WHERE doi IS NOT NULL AND partkey % 3 <> 0 GROUP BY doi"

#: Journals of odd brands with coverage; every fourth brand is discontinued.
SOURCES = """SELECT 'Journal of Brand ' || CAST(k AS varchar(4)) AS title, CASE WHEN k % 4 = 1 THEN '1995-1997; 2000' ELSE '1996-2005' END AS coverage, k % 4 = 3 AS discontinued
FROM (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS int) AS k FROM part) b WHERE k % 2 = 1"""


def _spark_sql(spark: SparkSession, sql: str) -> DataFrame:
    for n in (4, 6, 20):
        sql = sql.replace(f"AS varchar({n})", "AS string")
    return spark.sql(sql)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of works in the schema of a DOI snapshot."""
    from pyspark.sql import functions as F

    tables(spark, sf_dir, "lineitem", "part")
    w = _spark_sql(spark, WORKS)
    none = F.lit(None).cast("int")
    return w.select("doi", "title", F.array(F.struct("family", F.lit(None).cast("string").alias("given"))).alias("authors"), "issued", none.alias("published"), none.alias("published_print"), none.alias("published_online"), none.alias("created"))


def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    none = F.lit(None).cast("string")
    return works(spark, sf_dir).select("doi", "title", F.col("authors")[0]["family"].alias("first_author"), none.alias("journal"), none.alias("issn"), none.alias("eissn"), F.col("issued").cast("string").alias("year"), none.alias("volume"), none.alias("issue"), none.alias("pages"), none.alias("article_number"))


def registry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    tables(spark, sf_dir, "part")
    s = _spark_sql(spark, SOURCES)
    return s.select(F.lit(None).cast("string").alias("issn"), F.lit(None).cast("string").alias("eissn"), "title", F.lit(True).alias("active"), "coverage", F.lit("Journal").alias("source_type"), "discontinued", F.lit(0).alias("load_order"))


#: References whose titles are names of parts with misprints, and a registry of one work for each part. Where a reference names no DOI, doi is null.
MISPRINTS = f"""
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, l_partkey AS partkey,
       CASE l_linenumber % 4 WHEN 0 THEN 'q' || substring(p_name, 2, 200) WHEN 1 THEN substring(p_name, 1, 7) || substring(p_name, 9, 200) WHEN 2 THEN p_name || ' review' ELSE p_name END AS title,
       {_pick('l_suppkey % 8', SURNAMES)} AS surname, 1990 + l_suppkey % 10 AS y
FROM lineitem JOIN part ON p_partkey = l_partkey"""
PART_WORKS = f"SELECT '10.1/p' || CAST(p_partkey AS varchar(20)) AS doi, p_name AS title, {_pick('p_partkey % 8', SURNAMES)} AS family, 1990 + p_partkey % 10 AS issued FROM part"


def misprinted_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    tables(spark, sf_dir, "lineitem", "part")
    r = _spark_sql(spark, MISPRINTS)
    none = F.lit(None).cast("string")
    return r.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.when(F.col("partkey") % 5 != 0, F.concat(F.lit("10.2/"), "partkey")).alias("doi"), "title", F.concat("surname", F.lit(", A.")).alias("first_author"), none.alias("journal"), F.col("y").cast("string").alias("year"), none.alias("volume"), none.alias("pages"), none.alias("article_number"))


def part_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of parts in the schema of a DOI snapshot."""
    from pyspark.sql import functions as F

    tables(spark, sf_dir, "part")
    none = F.lit(None).cast("int")
    w = _spark_sql(spark, PART_WORKS)
    return w.select("doi", "title", F.array(F.struct("family", F.lit(None).cast("string").alias("given"))).alias("authors"), F.col("issued").cast("int").alias("issued"), none.alias("published"), none.alias("published_print"), none.alias("published_online"), none.alias("created"))
