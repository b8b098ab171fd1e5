"""Operator 1: a document is digested where its ids are decoded."""

import zlib

from inkveil.llm import token_store


def test_digests_are_those_of_the_ids_and_no_ids_leave_the_decoder(spark, tmp_path):
    path, docs = str(tmp_path / "store"), [(k, bytes([k % 7, 0]) * (k % 5) + b"\x01\x00") for k in range(1200)]
    token_store.write_store(spark.createDataFrame(docs, "doc_id long, ids binary"), path, 16)
    digest = token_store.store_digest(spark, path, 16)
    assert digest._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    ids = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_store(spark, path, 16).collect()}
    start = 0
    got = {r["doc_id"]: r for r in digest.collect()}
    assert len(got) == len(ids) == 1200
    for k, own in docs:
        wide = b"".join(own[i : i + 2] + b"\0\0" for i in range(0, len(own), 2))
        assert ids[k] == wide
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(own) // 2, zlib.crc32(wide))
        start += len(own) // 2
