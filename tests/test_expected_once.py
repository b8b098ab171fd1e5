from inkveil.operators import evaluate
from inkveil.plans import queries


def test_expected_values_are_made_once(spark, folder, monkeypatch):
    """Expected values come from a search of all texts, which a second use of them would repeat."""
    plans, put = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda rows, tag: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), put(rows, tag))[1])
    assert queries.evaluated_corpus(spark, folder).count() == 1
    assert sum(p.count("@[\\w-]+(?:") for p in plans) == 1


def test_documents_without_expected_values_stay(spark):
    expected = spark.createDataFrame([(1, None, None), (2, "Vega", "Person"), (2, None, None), (3, None, None), (3, None, None)], "doc_id long, value string, type string")
    detected = spark.createDataFrame([(2, "Vega", "Person"), (3, "Stone", "Person")], "doc_id long, value string, type string")
    redacted = spark.createDataFrame([(2, 1, "by Vega", "by Vega"), (3, 1, "Stone", "")], "doc_id long, page int, text string, redacted_text string")
    rows = evaluate.evaluate_documents(expected, detected, redacted).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_expected"], r["n_missed"], r["n_detected"], r["n_false"]) for r in rows] == [(1, 0, 0, 0, 0), (2, 1, 1, 1, 0), (3, 0, 0, 1, 1)]
