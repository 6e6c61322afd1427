"""Each query of the training-data operators on a whole small table: the columns and types that it promises, one row for each of its input, its SQL."""

import duckdb
import pytest

from tessitura.llm import queries
from tests.test_queries import TABLES, normal

DIGEST = "string"
COLUMNS = {
    "op1_ctph": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": DIGEST, "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_near_dup": {"doc_id": "bigint", "class_id": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": DIGEST, "decoded_sha256": DIGEST},
    "op4_decontaminate": {"doc_id": "bigint", "contaminated": "boolean", "n_hits": "bigint"},
    "op5_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6_pii": {"doc_id": "bigint", "n_found": "bigint", "text": "string"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": DIGEST},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": DIGEST},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": DIGEST, "loss_chars": "bigint", "loss_sha256": DIGEST, "formatted_chars": "bigint"},
}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_all_have_a_contract():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = df.toPandas()
    key, table = ("conv_id", "conversations") if name == "op10_chat_format" else ("doc_id", "documents")
    ids = {r[0] for r in duck.sql(f"select {key} from {table}").fetchall()} | ({-1} if key == "conv_id" else set())
    assert len(got) == len(ids) and set(got[key]) == ids
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
    if name == "op10_chat_format":
        assert got["layout"].nunique() > 2
