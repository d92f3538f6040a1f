"""Every registered engine query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from rowloom.catalog import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["q_sum_by_keyed", "q_sum_by_bare", "q_shift_within", "q_sum_back_wrap", "q_cases", "q_mask_count", "q_mask_condition", "q_labels_masked", "q_rows", "q_window_slices", "q_stitch"]


def rows(found):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in found), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="the sample tables aren't here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = QUERIES[name](spark, str(DATA)), con.sql(ORACLE_SQL[name])
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours.select(*[f"`{c}`" for c in columns]).collect()) == rows(con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
