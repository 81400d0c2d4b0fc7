"""Queries against their SQL on rows that lie on a limit or tie."""

import duckdb
import pytest

from stratum.plans import registry


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL give the same rows on tables given as SQL."""

    def run(name: str, **tables: str) -> list[tuple]:
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()), key=repr)
        assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall(), key=repr)
        return got

    return run


def test_label_lines_through_labels(same):
    """Lines that pass through a label, given by points at different places on them."""
    supplier = "SELECT k AS s_suppkey, 0 AS s_nationkey, (k * 379 % 1000) * 10.01 AS s_acctbal FROM range(1, 300) t(k)"
    customer = "SELECT k + i * 18180 AS c_custkey, 0 AS c_nationkey, (k * 379 % 1000) * 10.01 AS c_acctbal FROM range(1, 300) t(k), range(4) r(i)"
    assert any(r[-1] == 0 for r in same("label_lines", supplier=supplier, customer=customer))


def test_label_snap_of_halves(same):
    rows = same("label_snap", lineitem="SELECT 1::BIGINT AS l_orderkey, k::INT AS l_linenumber, k * 500.0::DOUBLE AS l_extendedprice FROM range(1, 200) t(k)")
    assert (1, 87, -2.2) in rows and (1, 23, -0.6) in rows


def test_ocr_retry_on_the_limit(same):
    lineitem = "SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, 20.0::DOUBLE AS l_quantity, (CASE n WHEN 1 THEN 3 + o % 8 WHEN 3 THEN 11 - o % 8 ELSE 7 END / 100)::DOUBLE AS l_discount, (CASE n WHEN 1 THEN o % 7 ELSE (o + n * 3) % 9 END / 100)::DOUBLE AS l_tax FROM range(400) a(o), range(1, 6) b(n) WHERE n <= 3 + o % 3"
    rows = same("ocr_retry", lineitem=lineitem)
    assert any(r[2] == 0.93 for r in rows) and {r[3] for r in rows} == {"original"}


def test_reading_kinds_with_many_equal_labels(same):
    """A gap lies before 100,000 equal labels of one map, which all belong to the run behind it."""
    lineitem = "SELECT (i % 2)::BIGINT AS l_suppkey, 1::INT AS l_linenumber, CASE WHEN i % 11 < 4 THEN 3.0 WHEN i % 11 < 9 THEN 19.0 ELSE 12.0 END::DOUBLE AS l_quantity, 0.0::DOUBLE AS l_discount FROM range(600000) t(i)"
    assert [r[3] for r in same("reading_kinds", lineitem=lineitem)] == [190908, 190908]
