"""Queries on tables that hold every entity twice, against their SQL."""

import __spark_entry__ as entry
import duckdb
import pytest
from conftest import SF

from facetry.operators import inverted
from facetry.operators import neighbours as nb
from facetry.operators import similarity

SHIFTED = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
           "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """Tables of sf0.001 and a copy of each row with keys beyond all others."""
    folder = tmp_path_factory.mktemp("doubled")
    con = duckdb.connect()
    for name in ("region", "nation", *SHIFTED):
        source = f"read_parquet('{SF}/{name}.parquet')"
        types = {c: t for c, t, *_ in con.execute(f"DESCRIBE SELECT * FROM {source}").fetchall()}
        moved = ", ".join(f"({c} + 1000000)::{types[c]} AS {c}" for c in SHIFTED.get(name, ()))
        both = f"SELECT * FROM {source}" + (f" UNION ALL SELECT * REPLACE ({moved}) FROM {source}" if moved else "")
        con.execute(f"COPY ({both}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


def same(spark, doubled, name):
    folder, con = doubled
    got = sorted(tuple(r) for r in entry.queries()[name](spark, folder).collect())
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    return got


def test_similar_pairs_lists_copies(spark, doubled):
    got = same(spark, doubled, "similar_pairs")
    assert any(b - a == 1000000 for a, b, _ in got)


def test_feature_without_score_is_absent(spark):
    cells = [(1, "ing", "x", 1.0), (1, "ing", "y", None), (2, "ing", "x", 2.0), (2, "ing", "z", 0.1), (3, "ing", "w", None)]
    rows = nb.sparse_rows(spark.createDataFrame(cells, "entity_id long, kind string, feature string, score double"))
    got = similarity.listed_pairs(rows, 0.8).collect()
    assert [(r["id"], r["neighbour_id"], round(r["value"], 6)) for r in got] == [(1, 2, 0.998752)]


def test_similar_customers_compares_distinct_profiles(spark, doubled, monkeypatch):
    joined = []
    plain = inverted.similar_join
    monkeypatch.setattr(inverted, "similar_join", lambda rows, *rest: (joined.append(rows.count()), plain(rows, *rest))[1])
    got = same(spark, doubled, "similar_customers")
    assert any(b - a == 1000000 for a, b, _ in got)
    assert joined == [len({a for a, b, _ in got if b - a == 1000000})]  # one of each two copies
