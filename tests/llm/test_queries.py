"""The registered queries against their SQL twins and fixed columns."""

import os

import duckdb
import pytest

from __spark_entry__ import queries
from pairloom.llm.catalog import ORACLES, QUERIES

NO_SQL = {"op1_packing", "op2_pitman_yor", "op4_secret_scan", "op5_suffix_dedup", "op6_line_dedup", "op7_collision_neighbours", "op9_language_id", "op12_whitening"}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_pitman_yor": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_jaccard_join": "doc_id n_shingles component_id",
    "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_line_dedup": "doc_id n_removed kept_sha256",
    "op7_collision_neighbours": "query_id rank vec_id score",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_mixing": "doc_id size source_size target taken",
    "op11_exact_topk": "query_id rank vec_id score",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_filter_interaction": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


def test_registration():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) - set(ORACLES) == NO_SQL
    assert {*QUERIES, "pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_come_first(spark, sf_dir, name):
    wanted = COLUMNS[name].split()
    found = QUERIES[name](spark, sf_dir).columns
    assert set(wanted) <= set(found) and found[0] == wanted[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    frame = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema} == described
    columns = sorted(described)
    want = [dict(zip(described, row)) for row in cursor.fetchall()]
    got = frame.select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((tuple(r[c] for c in columns) for r in want), key=str)
