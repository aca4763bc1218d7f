"""Every registered query against its SQL on the smallest tables; the rest must at least run to the end."""

from pathlib import Path

import pytest

import __spark_entry__
from plumbline.plans import queries as q


@pytest.fixture(scope="module")
def duck(data):
    import os

    import duckdb

    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, data, duck, tmp_path, name):
    q.QUERIES[name](spark, data).write.parquet(str(tmp_path / "got"))
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    if name in q.ORACLES:
        duck.execute(f"CREATE OR REPLACE TABLE want AS {q.ORACLES[name]}")
        columns = ", ".join(f'"{r[0]}"' for r in duck.execute("DESCRIBE want").fetchall())
        for a, b in (("want", "got"), ("got", "want")):
            assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    found = __spark_entry__.queries()
    assert set(q.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    root = Path(__spark_entry__.__file__).parent
    assert ("pipeline" in found) == ((root / "plumbline/llm/queries.py").exists() and (root / "corpus_pipeline.py").exists())
    assert __spark_entry__.entry(spark).columns == ["user", "period", "triggered", "signal_id"]
