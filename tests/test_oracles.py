"""Every query with SQL gives the rows of DuckDB on the same tables."""

import duckdb
import pytest

from passbook.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(repr(tuple(v)) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert rows(got) == rows(con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall())
    else:  # learned or drawn at random
        assert name in ("category_model", "copula_rows") and len(got) == {"category_model": spark.read.parquet(f"{SF}/part.parquet").count(), "copula_rows": 1000}[name] == len({r[-1 if name == "category_model" else columns.index("customer_id")] for r in got})
