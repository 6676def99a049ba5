"""Every registered query against its SQL counterpart on the given tables."""

import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyweave.plans import ORACLES, QUERIES


def plain(value):
    if isinstance(value, float):
        return None if value != value else int(value) if value == int(value) else round(value, 9)
    return bytes(value) if isinstance(value, bytearray) else value


def rows(names, found):
    order = sorted(names)
    return sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tenant_id", "vault_id", "action", "n"] and df.count() > 0


def test_registry_needs_no_session():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.import_module("tallyweave.schemas").KEY == ["tenant_id", "vault_id", "path"]
