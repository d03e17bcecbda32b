import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con.sql(sql).df()
