import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["claimed_entities", "surnames", "redacted_documents", "image_inventory", "grouped_tokens", "link_inventory", "evaluated_documents", "chunked_documents", "tagged_entities", "merged_hits", "rerun_notes", "chat_entities", "fallback_entities", "claimed_values", "stripped_forms", "unlinked_pages", "run_flags", "model_flags", "fallback_conversations", "evaluated_rollup", "stored_redactions", "report_history", "expected_values", "tagger_only", "match_summary"]


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 200


def test_all_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    mine = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert mine == theirs
