"""Sinks that can be run again, and replies put together from streams."""

import json
from datetime import datetime, timedelta


from inkveil.operators import model
from inkveil.sources import pages as sources
from inkveil.streaming import replies


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, redacted_text string, source string")
    sources.write_redacted(rows((1, "a", "x"), (2, "b", "y")), path, ["source"])
    for _ in range(2):
        sources.write_redacted(rows((3, "c", "y"), (4, "d", None)), path, ["source"])
    assert sorted(map(tuple, spark.read.parquet(path).select("doc_id", "source").collect())) == [(1, "x"), (3, "y"), (4, None)]


def test_a_batch_delivered_again_replaces_itself(spark, tmp_path):
    path, put = str(tmp_path / "out"), sources.redacted_sink(str(tmp_path / "out"))
    batch = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id long, redacted_text string")
    put(batch(1, 2), 0)
    put(batch(3), 1)
    put(batch(1, 2), 0)
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    src = str(tmp_path / "in")
    batch(7, 8).write.parquet(src)
    q = spark.readStream.schema("doc_id long, redacted_text string").parquet(src).writeStream.foreachBatch(sources.redacted_sink(str(tmp_path / "s"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [7, 8]


def test_expected_values_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "v", "t"), ("a", "w", "t"), ("b", "x", "u")], "doc_id string, value string, type string")
    sources.write_expected(rows, str(tmp_path / "e"))
    assert sorted(map(tuple, sources.read_expected(spark, str(tmp_path / "e")).collect())) == [("a", "v", "t"), ("a", "w", "t"), ("b", "x", "u")]


def line(text, done=False, error=None):
    return json.dumps({"message": {"content": text}, "done": done, "done_reason": "stop" if done else None, "error": error})


def test_streamed_replies_equal_the_batch(spark, tmp_path):
    one = lambda v: '{"type": "Person", "value": "%s"}, ' % v
    pages = {
        1: [line("[" + one("Ann")), line(one("Bo B")[:9]), line(one("Bo B")[9:]), line("]", True)],
        2: [line("[" + one("Ann")), line("", error="lost"), line(one("Never"))],
        3: [line("[")] + [line(one("Ann")) for _ in range(9)] + [line(one("Later")), line("]", True)],
        4: [line(one("Cy") + one("Di")) for _ in range(8)] + [line("]", True)],
        5: [line(one("Held")), line(one("Gap")), line(one("Late"))],
    }
    began = datetime(2024, 1, 1)
    rows = [(d, 1, k, x, began + timedelta(seconds=k)) for d, ls in pages.items() for k, x in enumerate(ls)]
    schema = "doc_id long, page int, seq int, line string, ts timestamp"
    # Three arrivals: lines out of turn first, then the rest with repeats; document 5's middle line never comes.
    rows = [r for r in rows if not (r[0] == 5 and r[2] == 1)]
    arrivals = [[r for r in rows if r[2] % 2 == 1 or r[0] == 5], [r for r in rows if r[2] % 2 == 0] + rows[:5], rows[3:9] + [(9, 1, 0, line("x", True), began + timedelta(hours=5))], [(9, 1, 0, line("x", True), began + timedelta(hours=9))]]
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.parquet(src)
    stream = replies.stream_replies(spark.readStream.schema(schema).parquet(src))

    def put(batch, _):
        seen.extend(map(tuple, batch.collect()))

    for own in arrivals:
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = {r[0]: r[2:] for r in seen}
    assert len(seen) == len(got) == 6
    assert got[1][1:] == ("stop", None) and got[2][1:] == (None, "lost") and got[3][1] == got[4][1] == "repeat" and got[5] == (one("Held") + one("Late"), None, None)
    assert "Later" not in got[3][0] and got[3][0].count("Ann") == 3
    batch = spark.createDataFrame([r[:4] for r in rows], "doc_id long, page int, seq int, line string")
    kept = lambda df: sorted(map(tuple, model.dedupe_reply(model.reply_entities(df)).where("doc_id < 9").select("doc_id", "page", "pos", "type", "value").collect()))
    made = spark.createDataFrame([(r[0], r[1], r[2]) for r in seen], "doc_id long, page int, content string")
    want = kept(model.assemble_replies(batch))
    assert kept(made) == want and len(want) == 8


def test_repeats():
    one = lambda v: '{"type": "P", "value": "%s"}' % v
    assert not replies.repeats(one("ab") * 2 + "{oops}" + one("cd") + one("ab") * 2)
    assert replies.repeats(one("ab") * 2 + '{"type": 1, "value": "x"}' + one("AB "))
    assert replies.repeats((one("ab") + one("cd")) * 6) and not replies.repeats((one("ab") + one("cd")) * 5)
