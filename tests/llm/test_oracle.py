"""Registered queries with a DuckDB twin, and the shapes of all results, on the smallest tables."""

import duckdb
import pytest

from briefloom.llm.queries import ORACLE_SQL, QUERIES

SF_SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_jaccard_join": "doc_id n_shingles component_id",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_token_counts": "doc_id n_words n_tokens",
    "op4_nearest": "query_id rank vec_id score",
    "op5_source_mix": "doc_id size source_size target taken",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_line_dedup": "doc_id lines_dropped n_chars text_sha256",
    "op11_near_copies": "doc_id n_shingles component_id kept",
    "op12_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_ranked_search": "item_id rank doc_id score",
    "op10_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
}


def test_one_query_for_each_operator():
    assert set(COLUMNS) == set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SF_SMALL)
    want = con.sql(ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLE_SQL)))
def test_one_row_for_each_document(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    assert got.columns == COLUMNS[name].split()
    if name not in ("op4_nearest", "op7_best_fit_packing"):
        n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
        assert got.count() == n == got.select("doc_id").distinct().count()
