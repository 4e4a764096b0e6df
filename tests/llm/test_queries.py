"""Registered queries: their columns, whole results, and the checking SQL where there is one."""

import duckdb
import pytest

from servertide.llm.oracles import ORACLES
from servertide.llm.queries import QUERIES

KEYS = {
    "op1_embedding_near_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op2_quality_resampling": ("documents", ["doc_id", "selected"]),
    "op3_personal_data": ("documents", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    "op4_line_dedup": ("documents", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
    "op6_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op8_bpe_codec": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op9_simhash_near_dedup": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op10_url_filters": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
}


@pytest.mark.parametrize("name", KEYS)
def test_one_row_for_each_row(spark, sf_dir, name):
    table, columns = KEYS[name]
    result = QUERIES[name](spark, sf_dir)
    assert set(columns) <= set(result.columns)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    assert sorted(r[0] for r in result.select(columns[0]).collect()) == sorted(r[0] for r in rows.select(columns[0]).collect())


@pytest.mark.parametrize("name", ORACLES)
def test_checking_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*columns).collect()) == expected
