"""Findings of round 3, second part."""

from pyspark.sql import functions as F

from inkveil.operators import model
from inkveil.plans import pipeline, queries
from inkveil.sources import pages as sources


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_chat_models_replies_are_salvaged_once(spark):
    replies = spark.createDataFrame([(1, 1, 0, '{"message": {"content": "[{\\"type\\": \\"Org\\", \\"value\\": \\"Acme\\"}]"}, "done": true, "done_reason": "stop"}')], "doc_id long, page int, seq int, line string")
    pages = spark.createDataFrame([(1, 1, "Acme, a@b.org")], "doc_id long, page int, text string")
    found = pipeline.detect_chat(pages, replies)
    assert sorted((r["value"], r["ord"]) for r in found.collect()) == [("Acme", 2), ("a@b.org", 1)]
    # What is parsed is read back from a table, wherever it is used again.
    assert "parseJson" not in plan_of(found)
    content = model.assemble_replies(replies)
    assert plan_of(model.reply_entities(content)).count("parseJson") == 1


def test_a_larger_table_is_dealt_to_more_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lineitem.parquet")
    spark.range(100000).selectExpr("id % 1000 as l_orderkey", "id").write.parquet(path)
    monkeypatch.setattr(sources, "PART_BYTES", 1 << 14)
    parts = sources.dealt(spark.read.parquet(path), path, "l_orderkey")
    own = parts.groupBy(F.spark_partition_id().alias("p"), "l_orderkey").count().collect()
    assert len(own) == 1000 and sum(r["count"] for r in own) == 100000
    size = sum(f.stat().st_size for f in tmp_path.glob("*/*.parquet"))
    assert parts.rdd.getNumPartitions() >= size // (1 << 14) > 2 * spark.sparkContext.defaultParallelism


def test_tokens_are_grouped_in_the_parts_that_line_items_are_dealt_to(spark, folder):
    plan = queries.grouped_tokens(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
