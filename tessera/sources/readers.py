"""Sources with explicit schemas. Tabs separate fields and nothing quotes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Partitions of a text up to which their first line numbers are broadcast.
BROADCAST_PARTS = 100_000
TSV = {"sep": "\t", "quote": "", "encoding": "UTF-8"}
DOCUMENT_FIELDS = ["title", "description", "num_ratings", "rating", "num_sitelinks"]


def table_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table of strings with a header line; empty fields are null and values are stripped.

    columns may name the header to save reading it first. Empty or repeated names raise ValueError.
    """
    if columns is None:
        head = spark.read.text(path).first()
        columns = [c.strip() for c in head[0].split("\t")] if head else []
    if not columns or any(not c for c in columns) or len(set(columns)) < len(columns):
        raise ValueError(f"column names must be given and differ: {columns}")
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.options(**TSV, header=True, mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="", emptyValue="").schema(schema).csv(path)
    return rows.select([F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in columns])


def typed_tsv(spark: SparkSession, path: str, schema: str, view: str | None = None) -> DataFrame:
    """A file without header into declared columns, and a view for SQL if named."""
    df = spark.read.options(**TSV, header=False, nullValue="").schema(schema).csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def untyped_tsv(spark: SparkSession, path: str, columns: list[str], view: str | None = None) -> DataFrame:
    """As typed_tsv, all strings."""
    return typed_tsv(spark, path, ", ".join(f"`{c}` STRING" for c in columns), view)


def _line_numbers(lines: DataFrame) -> DataFrame:
    """line: 1-based line number, without bringing the lines to one task: the partitions' counts are added up first and joined."""
    marked = lines.select("value", F.monotonically_increasing_id().alias("m"))
    marked = marked.select("value", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"))
    counts = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    starts = list(accumulate((r["n"] for r in counts), initial=0))
    table = lines.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(counts, starts)], "part long, start long")
    table = F.broadcast(table) if len(counts) <= BROADCAST_PARTS else table
    return marked.join(table, "part").select("value", (F.col("start") + F.col("at") + 1).alias("line"))


def documents_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, description, num_ratings, rating, num_sitelinks); ids are line numbers of a single file, from 1."""
    lines = _line_numbers(spark.read.text(path))
    parts = F.split("value", "\t")
    fields = [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(DOCUMENT_FIELDS)]
    out = lines.select(F.col("line").alias("doc_id"), *fields)
    return out.withColumns({"num_ratings": F.expr("try_cast(num_ratings AS int)"), "rating": F.expr("try_cast(rating AS double)"), "num_sitelinks": F.expr("try_cast(num_sitelinks AS int)")})


def entities_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(ent_id, name, score, synonyms array, info array): header skipped, ids from 1, any number of trailing fields."""
    lines = _line_numbers(spark.read.text(path)).where("line > 1")
    parts = F.split("value", "\t", -1)
    return lines.select(
        (F.col("line") - 1).alias("ent_id"),
        parts[0].alias("name"),
        F.expr("try_cast(split(value, '\t')[1] AS long)").alias("score"),
        F.filter(F.split(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), ";"), lambda s: s != "").alias("synonyms"),
        F.when(F.size(parts) > 3, F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("info"),
    )


def qrels_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, text), qrels(query_id, doc_id)) from lines of query, tab, ids separated by spaces."""
    lines = _line_numbers(spark.read.text(path)).select(F.col("line").alias("query_id"), F.split("value", "\t").alias("parts"))
    queries = lines.select("query_id", F.trim(F.col("parts")[0]).alias("text"))
    ids = lines.select("query_id", F.explode(F.split(F.coalesce(F.try_element_at("parts", F.lit(2)), F.lit("")), " ")).alias("doc_id"))
    return queries, ids.select("query_id", F.expr("try_cast(doc_id AS long)").alias("doc_id")).where("doc_id is not null").distinct()


def triples_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, predicate, object) of all files together."""
    return typed_tsv(spark, list(paths), "subject STRING, predicate STRING, object STRING")  # type: ignore[arg-type]


def token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec array<float>) from Parquet."""
    return spark.read.schema("token STRING, vec ARRAY<FLOAT>").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SQL query over the given tables as views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def sparql_file(spark: SparkSession, path: str) -> str:
    """The text of a query file in any store that Spark reads."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
