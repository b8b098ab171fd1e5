"""Readers into the pages schema (doc_id, page, text), and writers of what comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A row group has about so many bytes. A table with less for each core may be a single row group, and
#: then a single task reads it.
ROW_GROUP_BYTES = 128 << 20


#: Bytes of a table's files whose rows one task gets where they are dealt by a key.
PART_BYTES = 4 << 20


def _bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def dealt(rows: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of a table at `path`, those of a key in one part. There are as many parts as the table's size asks for,
    so that what groups and sorts a part needs no more memory for a larger table."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-_bytes(spark, path) // PART_BYTES)), key)


def spread(pages: DataFrame, path: str) -> DataFrame:
    """The pages of a table at `path`, dealt to all cores where the table is too small to be split among
    them; larger tables stay as they are read."""
    spark = pages.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return pages.repartition(4 * cores) if _bytes(spark, path) < cores * ROW_GROUP_BYTES else pages


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one page."""
    return table(spark, folder, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def searched_pages(pages: DataFrame, folder: str, name: str = "documents") -> DataFrame:
    """Pages of a given table that are about to be searched."""
    return spread(pages, f"{folder}/{name}.parquet")


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every source as one document, its documents as pages that keep their doc_id as number, so
    that no row has to be counted or moved."""
    return table(spark, folder, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as one document, its turns as its pages."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "html")


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", schema: str = "doc_id string, page int, text string") -> DataFrame:
    """Pages from Parquet, JSON or CSV files, of a given schema."""
    return spark.read.schema(schema).format(kind).load(path)


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each text file as one document of one page, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.lit(1).alias("page"), F.col("value").alias("text"))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value, type) from JSON files {source, pii: [{value, type}]}; a file without values
    gives one row with null ones, so that its document isn't lost."""
    rows = spark.read.schema("source string, pii array<struct<value:string,type:string>>").json(path, multiLine=True)
    return rows.select(F.col("source").alias("doc_id"), F.inline_outer("pii")).select("doc_id", "value", "type")


def write_redacted(redacted: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes redacted pages. With partition columns, partitions that `redacted` has rows of are replaced and all
    others stay, so a part of the pages can be redacted anew, and a run that is repeated adds nothing."""
    out = redacted.write.mode("overwrite").option("compression", "zstd")
    (out.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else out).parquet(path)


def redacted_sink(path: str) -> Callable[[DataFrame, int], None]:
    """What a stream hands its batches to, by foreachBatch: each is a partition named by its id, and one that is
    delivered again replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        write_redacted(batch.withColumn("batch", F.lit(batch_id)), path, ["batch"])

    return put


def write_report(report: DataFrame, path: str, run_id: str, **run: str) -> None:
    """The report as JSON lines with the run's data in columns of their own: under `runs/run=...`
    for good (the same run_id again replaces that run), and under `latest` until the next run."""
    rows = report.withColumns({k: F.lit(v) for k, v in run.items()})
    rows.write.mode("overwrite").json(f"{path}/runs/run={run_id}")
    report.sparkSession.read.schema(rows.schema).json(f"{path}/runs/run={run_id}").write.mode("overwrite").json(f"{path}/latest")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All runs' reports, with column `run`."""
    return spark.read.json(f"{path}/runs")


def write_expected(expected: DataFrame, path: str) -> None:
    """Expected values (doc_id, value, type) as JSON files {source, pii: [{value, type}]}, one for each document."""
    own = expected.groupBy(F.col("doc_id").cast("string").alias("source")).agg(F.sort_array(F.collect_list(F.struct("value", "type"))).alias("pii"))
    own.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
