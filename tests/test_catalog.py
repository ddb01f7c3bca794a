"""Every query runs, and agrees with its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF

from docuforge.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        wanted = con.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_cosine_query_batch_of_ids_with_gaps(spark, tmp_path):
    """Ids need not be dense, unique or positive; each query keeps the number that the SQL gives it."""
    c = duckdb.connect()
    c.execute(f"CREATE TABLE embeddings AS SELECT CASE WHEN vec_id < 100 THEN vec_id * 7 - 200 WHEN vec_id < 104 THEN 40 ELSE vec_id + 1000000 END AS vec_id, embedding FROM '{SF}/embeddings.parquet'")
    c.execute("INSERT INTO embeddings SELECT NULL, embedding FROM embeddings LIMIT 1")
    c.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    found, wanted = QUERIES["cosine_query_batch"](spark, str(tmp_path)).toPandas().astype({"vec_id": "Int64"}), c.execute(ORACLES["cosine_query_batch"]).df().astype({"vec_id": "Int64"})
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "level", "chunk_id", "score"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
