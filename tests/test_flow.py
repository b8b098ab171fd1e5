import time
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.operators import entities, evaluate, hidden, layout, locate, model, redact, review
from inkveil.plans import pipeline
from inkveil.sources import pages as sources
from inkveil.streaming import pages as streams

ENTITY = "doc_id string, type string, value string, value_key string, page int, approved boolean, source string, ord long"


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, page int, text string")


def test_first_page_wins(spark):
    rows = pipeline.detect(pages_of(spark, ("d", 2, "x@y.com 10.0.0.1"), ("d", 1, "X@Y.com"), ("e", 1, "x@y.com"))).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["value"], r["page"], r["ord"]) for r in rows] == [("d", "X@Y.com", 1, 1), ("d", "10.0.0.1", 2, 2), ("e", "x@y.com", 1, 1)]


def test_surnames_spread_once(spark):
    names = ["Jane Doe, Jr.", "Smith,", "Ann Lee", "Bob Doe", "li po", "Max Stone", "stone"]
    rows = [("d", "Person", v, v.lower(), 1, True, None, k + 1) for k, v in enumerate(names)]
    out = entities.spread_surnames(spark.createDataFrame(rows, ENTITY)).orderBy("ord").collect()
    assert [(r["value"], r["ord"]) for r in out[len(names) :]] == [("Doe", 8), ("Lee", 9)]


def test_overlaps_are_united(spark):
    pages = pages_of(spark, ("d", 1, "Jane Doe Smith and doe smith jr"), ("d", 2, "nobody"), ("d", 3, None))
    values = spark.createDataFrame([("d", "Jane Doe"), ("d", "Doe Smith"), ("d", ""), ("x", "nobody")], "doc_id string, value string")
    found = locate.locate(values, pages)
    spans = redact.span_union(found).orderBy("s").collect()
    assert [(r["s"], r["e"]) for r in spans] == [(0, 14), (19, 28)]
    out = {r["page"]: (r["n_redacted"], r["redacted_text"]) for r in redact.redact_text(pages, redact.span_union(found)).collect()}
    assert out == {1: (2, "█" * 14 + " and " + "█" * 9 + " jr"), 2: (0, "nobody"), 3: (0, "")}
    assert redact.redact_text(pages, redact.span_union(found), "[X]").where("page = 1").first()["redacted_text"] == "[X] and [X] jr"
    assert [(r["value"], r["pages"], r["count"]) for r in locate.match_summary(found).orderBy("value").collect()] == [("Doe Smith", [1], 2), ("Jane Doe", [1], 1)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.lists(st.sampled_from(["Ann", "Bo", "ann", "x", "_", "\n", " "]), max_size=12), values=st.lists(st.sampled_from(["Ann", "Bo x", "Ann Bo"]), min_size=1, max_size=3))
def test_redacted_text_holds_no_value(spark, text, values):
    pages = pages_of(spark, ("d", 1, " ".join(text)))
    own = spark.createDataFrame([("d", v) for v in values], "doc_id string, value string")
    out = redact.redact_text(pages, redact.span_union(locate.locate(own, pages)))
    again = out.select("doc_id", "page", F.col("redacted_text").alias("text"))
    assert locate.locate(own, again).count() == 0
    assert out.first()["redacted_text"].__len__() == len(" ".join(text))


def test_tokens_merge(spark):
    tags = [(1, "B-PER", "Ja"), (2, "I-PER", "##ne"), (3, "I-LOC", "Rome"), (5, "I-LOC", "gap"), (6, "S-PER", "Bo"), (7, "I-PER", "Al"), (8, "E-PER", "Li"), (9, "I-PER", "no"), (10, "PER", "ok"), (20, "E-PER", "Ann"), (21, "I-PER", "Lee"), (30, "E-PER", "a"), (31, "E-PER", "b"), (32, "E-PER", "c")]
    rows = spark.createDataFrame([("d", 1, 1, i, t, 0.5, p) for i, t, p in tags], "doc_id string, page int, chunk int, idx int, tag string, score double, piece string")
    out = model.group_tokens(rows).orderBy("grp").collect()
    assert [(r["tag"], r["word"]) for r in out] == [("PER", "Ja##ne".replace("##", "")), ("LOC", "Rome"), ("LOC", "gap"), ("PER", "Bo"), ("PER", "Al Li"), ("PER", "no ok"), ("PER", "Ann Lee"), ("PER", "a b"), ("PER", "c")]


def test_tagger_filters(spark):
    pages = pages_of(spark, ("d", 1, "Dr JaneDoe met Acme Corp on 1/2/2020; born 3/4/1980. JANE x@y.com email"))
    found = [("PERSON", "janedoe", 0.9), ("PERSON", "met", 0.9), ("ORGANIZATION", "acme  corp", 0.9), ("ORGANIZATION", "Acme Corp", 0.8), ("DATE", "1/2/2020", 0.9), ("DATE", "3/4/1980", 0.9), ("TITLE", "Dr", 0.9), ("PERSON", "JANE", 0.9), ("EMAIL", "x@y.com", 0.9), ("USERNAME", "email", 0.9)]
    rows = spark.createDataFrame([("d", 1, 1, k, t, s, w) for k, (t, w, s) in enumerate(found)], "doc_id string, page int, chunk int, grp int, tag string, score double, word string")
    out = pipeline.detect(pages, rows).orderBy("ord").collect()
    assert [(r["type"], r["value"]) for r in out if r["type"] in ("Person", "Organization", "Date")] == [("Person", "JaneDoe"), ("Organization", "Acme Corp")]


def test_person_lines_and_small_words(spark):
    rows = spark.createDataFrame([("Jane\nMary Ann Doe",), ("Jane\nDoe",), ("Jane Doe of the",), ("of",)], "v string")
    assert [r[0] for r in rows.select(model.clean_person(F.col("v"))).collect()] == ["Mary Ann Doe", "Jane Doe", "Jane Doe", "of"]


def test_replies(spark):
    lines = [('{"message":{"content":"[{\\"type\\":\\"A\\","},"done":false}', 0), ('{"message":{"content":"\\"value\\":\\" xy \\"}"},"done":false}', 1), ('{"error":"lost"}', 2), ('{"message":{"content":"more"},"done":true}', 3)]
    rows = model.assemble_replies(spark.createDataFrame([("d", 1, s, x) for x, s in lines], "doc_id string, page int, seq int, line string"))
    r = rows.first()
    assert (r["content"], r["error"]) == ('[{"type":"A","value":" xy "}', "lost")
    assert [(x["type"], x["value"]) for x in model.reply_entities(rows).collect()] == [("A", "xy")]
    odd = spark.createDataFrame([("d", 1, '{"type":1,"value":"ab"} {"type":"T","value":"a"} {bad} {"type":"T","value":"ok"}')], "doc_id string, page int, content string")
    assert [(x["pos"], x["value"]) for x in model.reply_entities(odd).collect()] == [(3, "ok")]
    assert evaluate.run_flags(rows).first()["incomplete"] == 1


def test_repeat_loops(spark):
    make = lambda *v: spark.createDataFrame([("d", 1, k, "T", x) for k, x in enumerate(v)], "doc_id string, page int, pos int, type string, value string")
    assert model.repeat_loops(make("a", "b", "B", "b", "c")).first()["pos"] == 3
    assert model.repeat_loops(make(*"abababababa")).first()["pos"] == 10
    assert model.repeat_loops(make("a", "b")).count() == 0
    assert [r["value"] for r in model.dedupe_reply(make("a", "a", "A", "b")).collect()] == ["a"]


def test_layout_rows(spark):
    lines = spark.createDataFrame([("d", 1, 1, 5.0, 10.0, "b"), ("d", 1, 2, 1.0, 13.0, "a"), ("d", 1, 3, 0.0, 15.0, "c"), ("d", 1, 4, 0.0, 1.0, "� "), ("d", 1, 5, 0.0, 2.0, " top ")], "doc_id string, page int, ord int, x double, y double, text string")
    assert layout.page_text(lines).first()["text"] == "top\na b\nc"


def test_stats_and_image_pages(spark):
    pages = pages_of(spark, ("d", 1, "x" * 25), ("d", 2, "few"), ("e", 1, None))
    images = spark.createDataFrame([("d", 1, 0, -10.0, 0.0, 700.0, 800.0), ("d", 2, 0, 0.0, 0.0, 612.0, 792.0), ("d", 2, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id string, page int, idx int, x0 double, y0 double, x1 double, y1 double")
    stats = layout.page_stats(pages, images)
    got = {(r["doc_id"], r["page"]): (r["char_count"], r["image_coverage"], r["has_text"], r["scanned"]) for r in stats.collect()}
    assert got == {("d", 1): (25, 1.0, True, True), ("d", 2): (3, 1.0, False, False), ("e", 1): (0, 0.0, False, False)}
    assert [r["doc_id"] for r in layout.documents_with_text(stats).collect()] == ["d"]
    assert layout.image_only_pages(stats).first()["pages"] == [2]
    found = layout.image_inventory(images, pages)
    assert [r["id"] for r in found.collect()] == ["2:0"]
    kept = {r["page"]: (r["kept"], r["error"]) for r in layout.remove_image_pages(pages.where("doc_id = 'd'"), found, found).collect()}
    assert kept == {1: (True, False), 2: (False, False)}
    only = layout.remove_image_pages(pages.where("page = 2"), found, found).first()
    assert (only["kept"], only["error"]) == (True, True)


def test_review(spark):
    rows = spark.createDataFrame([("d", "Email", "x@y", "x@y", 1, True, None, 1), ("d", "Person", "Ann", "ann", 2, False, None, 2), ("d", "Custom", "old", "old", 1, True, None, 3)], ENTITY)
    decided = review.apply_decisions(rows, spark.createDataFrame([("d", "ann", True)], "doc_id string, value_key string, approved boolean"))
    assert {r["value"]: r["approved"] for r in decided.collect()} == {"x@y": True, "Ann": True, "old": True}
    pages = pages_of(spark, ("d", 3, "new  thing and Ann"))
    custom = spark.createDataFrame([("d", " new thing "), ("d", "absent"), ("d", "ann"), ("d", "x")], "doc_id string, value string")
    out = review.add_custom(rows, custom, locate.locate(custom, pages)).orderBy("ord").collect()
    assert [(r["type"], r["value"], r["page"], r["approved"]) for r in out] == [("Email", "x@y", 1, True), ("Person", "Ann", 2, True), ("Custom", "old", 1, True), ("Custom", "new thing", 3, True)]
    assert review.remove_custom(rows, spark.createDataFrame([("d", "old"), ("d", "ann")], "doc_id string, value_key string")).count() == 2
    hits = review.classify_hits(rows, spark.createDataFrame([("d", "ANN"), ("d", "x@y"), ("d", "zzz")], "doc_id string, value string"))
    assert {r["value_key"]: r["action"] for r in hits.collect()} == {"ann": "approve", "x@y": "skip", "zzz": "add"}
    summary = spark.createDataFrame([("d", "x@y", [2], 1), ("d", "Ann", [1], 4), ("d", "old", [5], 1)], "doc_id string, value string, pages array<int>, count long")
    listed = review.review_list(review.group_entities(rows), summary).orderBy("category_order").collect()
    assert [r["type"] for r in listed] == ["Custom", "Person", "Email"]
    ids = spark.createDataFrame([("d", "1:0")], "doc_id string, id string")
    assert review.unapplied_changes(rows, rows, ids, ids).first()["changed"] is False
    assert review.unapplied_changes(rows, decided, ids, ids).first()["changed"] is True
    assert review.unapplied_changes(rows, rows, ids, ids.where("false")).first()["changed"] is True


def test_evaluation(spark):
    pages = pages_of(spark, ("d", 1, "mail x@y.com and Jane Doe"), ("e", 1, "nothing"))
    found = pipeline.detect(pages)
    done = redact.redact_values(pages, found)
    expected = spark.createDataFrame([("d", "X@y.com"), ("d", "jane  doe"), ("e", "gone")], "doc_id string, value string")
    rows = {r["doc_id"]: r for r in evaluate.evaluate_documents(expected, found, done).collect()}
    assert (rows["d"]["n_missed"], rows["d"]["catch_rate"], rows["d"]["n_detected"], rows["d"]["n_false"]) == (1, 0.5, 1, 0)
    assert rows["e"]["n_missed"] == 0
    total = evaluate.evaluate_corpus(evaluate.evaluate_documents(expected, found, done)).first()
    assert (total["n_expected"], round(total["catch_rate"], 6)) == (3, round(2 / 3, 6))


def test_streams(spark, tmp_path):
    rows = [("d", 1, "x@y.com", datetime(2024, 1, 1)), ("d", 2, "X@y.com 10.0.0.1", datetime(2024, 1, 1, 0, 1))]
    schema = "doc_id string, page int, text string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(f"out_{mode}").collect()

    assert sorted(r["redacted_text"] for r in run(streams.stream_redacted(read()), "append")) == ["█" * 7, "█" * 7 + " " + "█" * 8]
    totals = run(streams.stream_match_totals(read()), "update")
    assert {r["type"]: r["n"] for r in totals} == {"Email": 2, "IP Address": 1}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "expected.json").write_text('{"source": "a", "pii": [{"value": "v", "type": "t"}]}')
    assert sources.read_expected(spark, str(tmp_path / "expected.json")).collect()[0].asDict() == {"doc_id": "a", "value": "v", "type": "t"}
    pages = pages_of(spark, ("d", 1, "x"))
    sources.write_redacted(pages, str(tmp_path / "out"), ["doc_id"])
    assert sources.read_pages(spark, str(tmp_path / "out"), schema="page int, text string, doc_id string").count() == 1
    (tmp_path / "none.json").write_text('{"source": "b", "pii": []}')
    assert sources.read_expected(spark, str(tmp_path / "none.json")).collect()[0].asDict() == {"doc_id": "b", "value": None, "type": None}
    for run in ("r1", "r2"):
        sources.write_report(pages, str(tmp_path / "report"), run, model=f"m{run}")
    assert spark.read.json(str(tmp_path / "report/latest")).first()["model"] == "mr2"
    assert {(r["run"], r["model"]) for r in sources.read_reports(spark, str(tmp_path / "report")).collect()} == {("r1", "mr1"), ("r2", "mr2")}


def test_model_runs_once_for_each_task(spark):
    def load():
        return lambda texts: [[{"idx": 1, "tag": "B-PERSON", "score": 1.0, "piece": t[:3]}] for t in texts]

    chunks = spark.createDataFrame([("d", 1, 0, "Ann Lee"), ("d", 1, 1, "y" * 20_001)], "doc_id string, page int, chunk int, text string")
    assert [r["piece"] for r in model.tokens_of(model.score_chunks(chunks, load)).collect()] == ["Ann"]


def test_fallback_by_document(spark):
    first = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, x int")
    second = spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, x int")
    out = model.fallback(first, second, first.where("doc_id = 'a'").select("doc_id"))
    assert {r["doc_id"]: r["x"] for r in out.collect()} == {"a": 1, "b": 2}


def test_rejected_replies_say_why(spark):
    cases = [("Person", "x" * 61, "too long"), ("Person", "absent", "not found in page text"), ("Miscellaneous", "here", None), ("Person", "12-3", "no letters"), ("Place", "here", "all lowercase"), ("Person", "Ann Bo Cy Di Ed", "person longer than 4 words"), ("Person", "Al", "single-word person too short"), ("Person", "Ann 2", "person contains digits"), ("Person", "Acme", "part of an organization name"), ("Organization", "Acme Corp", None), ("Person", "Ann", None)]
    text = " ; ".join(v for _, v, r in cases if r not in ("too long", "not found in page text"))
    rows = spark.createDataFrame([("d", 1, k, t, v) for k, (t, v, _) in enumerate(cases)], "doc_id string, page int, pos int, type string, value string")
    got = {r["pos"]: r["reason"] for r in model.with_reasons(rows, pages_of(spark, ("d", 1, text))).collect()}
    assert got == {k: r for k, (_, _, r) in enumerate(cases)}


def test_instruction_keeps_strings_only(spark):
    replies = spark.createDataFrame([("d", 1, '["Ann Lee", 5, " Bo ", {"a": 1}, "x", "absent", null]'), ("d", 2, '"Ann"'), ("d", 3, "oops"), ("d", 4, '["Ann"]')], "doc_id string, page int, content string")
    pages = pages_of(spark, ("d", 1, "ann  lee met Bo 5"), ("d", 2, "Ann"), ("d", 3, "Ann"), ("d", 4, " "))
    assert [(r["page"], r["pos"], r["value"]) for r in model.instruction_hits(replies, pages).orderBy("pos").collect()] == [(1, 0, "Ann Lee"), (1, 2, "Bo")]


def test_review_is_merged_and_run_again(spark):
    pages = pages_of(spark, ("d", 1, "x@y.com met Ann and Bob Ray"), ("d", 2, "ann again"))
    own = pipeline.detect(pages)
    no = spark.createDataFrame([("d", "x@y.com", False)], "doc_id string, value_key string, approved boolean")
    custom = spark.createDataFrame([("d", "Bob Ray"), ("d", "nobody")], "doc_id string, value string")
    hits = spark.createDataFrame([("d", 2, "ann"), ("d", 1, "Ann")], "doc_id string, page int, value string")
    rows = pipeline.reviewed(pages, own, no, custom, hits)
    assert {(r["value"], r["type"], r["source"], r["page"], r["approved"]) for r in rows.collect()} == {("x@y.com", "Email", None, 1, False), ("Bob Ray", "Custom", None, 1, True), ("Ann", "Custom", "ai", 1, True)}
    out = {r["page"]: r["redacted_text"] for r in pipeline.rerun(pages, rows, "-").collect()}
    assert out == {1: "x@y.com met - and -", 2: "- again"}
    inventory = spark.createDataFrame([("d", 2, 0, "2:0", True)], "doc_id string, page int, idx int, id string, full_page boolean")
    assert [r["page"] for r in pipeline.rerun(pages, rows, images=(inventory, inventory.select("doc_id", "id"))).collect()] == [1]


def test_links_go_but_for_those_kept(spark):
    html = """<a class=x href="https://a.b/c">A</a> <a href='mailto:q@r'>B</a> <a href="#top">C</a>"""
    pages = spark.createDataFrame([(1, html), (2, html), (3, None)], "doc_id long, html string")
    keep = spark.createDataFrame([(1, "mailto:q@r")], "doc_id long, url string")
    got = {r["doc_id"]: r["html"] for r in hidden.unlinked(pages, keep).collect()}
    assert got == {1: """A <a href='mailto:q@r'>B</a> <a href="#top">C</a>""", 2: """A B <a href="#top">C</a>""", 3: None}
    assert hidden.unlinked(pages).where("doc_id = 1").first()["html"] == got[2]


def test_changed_values_are_unapplied(spark):
    ids = spark.createDataFrame([("d", "1:0")], "doc_id string, id string")
    rows = spark.createDataFrame([("d", "Person", "Ann", "ann", 1, True, None, 1)], ENTITY)
    assert review.unapplied_changes(rows, rows.withColumn("value", F.lit("Anne")), ids, ids).first()["changed"] is True


def test_values_meet_pages_by_their_first_word(spark):
    pages = pages_of(spark, *[("d", k, t) for k, t in enumerate(["Ann Lee and ANN  LEE", "(555) 1 or annlee", "*** x", None, "élan, Élan"])])
    values = spark.createDataFrame([("d", v) for v in ("ann lee", "(555) 1", "***", "élan", " ", "x")], "doc_id string, value string")
    rows = lambda by: sorted((r["value"], r["page"], r["n"]) for r in locate.locate(values, pages, by).collect())
    assert rows(True) == rows(False) == [("(555) 1", 1, 1), ("***", 2, 1), ("ann lee", 0, 2), ("x", 2, 1), ("élan", 4, 2)]


def test_a_very_long_page(spark):
    text = ("mail a.b@example.com, call (212) 555-0123 at 10.0.0.1; " + "word " * 40) * 2000
    assert len(text) > 500_000
    pages = pages_of(spark, ("d", 1, text))
    began = time.time()
    rows = pipeline.detect(pages)
    done = pipeline.redact(pages, rows).first()
    assert {r["type"] for r in rows.collect()} == {"Email", "Phone", "IP Address"} and done["n_redacted"] == 6000
    assert done["redacted_text"].count("█") == 2000 * (15 + 14 + 8) and len(done["redacted_text"]) == len(text)
    assert time.time() - began < 240
