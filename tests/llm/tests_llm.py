"""Helpers of these tests."""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_sql(spark, sf_dir, name):
    """A query's rows are those of its DuckDB SQL."""
    import glob
    import os

    import duckdb
    from ledgerloom.llm import registry

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, want = registry.queries()[name](spark, sf_dir), con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    place = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=key)
