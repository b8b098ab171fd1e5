import __spark_entry__ as entry

TEXT = "SSN 123-45-6789; IBAN GB82 WEST 1234 5698 7654 32; passport no: AB100001, Mr. Alan Stone."


def test_documents_are_searched_by_all_detectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, TEXT, "en", "src1", len(TEXT))], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    run = entry.queries()
    done = run["redacted_documents"](spark, str(tmp_path)).first()["redacted_text"]
    assert not any(x in done for x in ("123-45-6789", "GB82", "AB100001", "Alan Stone"))
    for name in ("claimed_entities", "first_seen_entities"):
        assert {"SSN", "IBAN", "Passport", "Person"} <= {r["type"] for r in run[name](spark, str(tmp_path)).collect()}
