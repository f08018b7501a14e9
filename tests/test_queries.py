"""Every registered query of the library against its SQL, on the small tables."""

from pathlib import Path

import duckdb
import pytest

from worktide.plans import registry

SF = "/root/testdata/sf0.001"
BRUTE = {"name_clusters": "tests/test_clusters.py", "project_merges": "tests/test_merge_map.py"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rounded(rows, columns, order):
    at = [columns.index(c) for c in order]
    value = lambda x: round(float(x), 3) if type(x).__name__ in ("float", "Decimal") else x
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in BRUTE:  # not SQL: tested against a brute-force version
        return
    sql = registry.ORACLE_SQL[name]
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rounded(rows, got.columns, sorted(names)) == rounded(want.fetchall(), names, sorted(names))
