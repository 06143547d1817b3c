"""Queries with SQL give its rows; the others run on the small tables."""

import duckdb
import pytest

from tidewrack.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, small)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


COLUMNS = {
    "op2": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op12": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, small, name):
    got = QUERIES[name](spark, small)
    want = COLUMNS.get(name.split("_")[0], {})
    assert want.items() <= dict(got.dtypes).items()
    table = "pages" if name.startswith("op10") else "documents"
    if want and not name.startswith("op12"):
        assert got.count() == spark.read.parquet(f"{small}/{table}.parquet").count()
