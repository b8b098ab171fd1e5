from inkveil.operators import redact
from inkveil.plans import queries
from inkveil.sources import pages as sources


def test_stored_redactions_hold_no_original_text_and_locate_values_once(spark, folder, monkeypatch):
    stored, located, write, spans = [], [], sources.write_redacted, redact.spans_in
    monkeypatch.setattr(queries.sources, "write_redacted", lambda rows, *x: (stored.append(rows), write(rows, *x)))
    monkeypatch.setattr(redact, "spans_in", lambda *x: (located.append(x), spans(*x))[1])
    assert queries.stored_redactions(spark, folder).count() > 0
    assert len(stored) == 3 and len(located) == 1
    for rows in stored:
        assert "text" not in rows.columns
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
