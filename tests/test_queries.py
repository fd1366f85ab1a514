"""Every query against its DuckDB SQL on the smallest tables."""

import glob
import importlib
import math
from pathlib import Path

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query_matches_sql(spark, sf_dir, db, name):
    found, wanted = QUERIES[name](spark, sf_dir), db.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    at = [wanted.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES)


def test_package_works_without_optional_parts(monkeypatch):
    real = importlib.import_module

    def missing(name, *args):
        if name in ("chunkwise.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name="chunkwise.llm" if "llm" in name else name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = set(entry.queries())
    assert "topk_chunks" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names

    def broken(name, *args):
        raise ModuleNotFoundError("other", name="other")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
