"""Queries without SQL cover all rows."""

from __future__ import annotations

from arbora import catalog

from .conftest import DATA


def test_cdc_reuse_has_odd_documents(spark):
    want = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("text <> ''").select("doc_id").collect()}
    assert {r["doc_id"] for r in catalog.QUERIES["cdc_reuse"](spark, DATA).select("doc_id").collect()} == want
