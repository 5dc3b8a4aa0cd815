"""Every registered repository query against its SQL, value by value."""

import math

import pytest

from sparkloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = duck.execute(Q.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_env_keys_of_documents_with_keys_of_their_own(spark, duck, tmp_path):
    """a document's own KEY= lines are comments of the example file, a null text has its key's line all the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    text = "CASE doc_id % 4 WHEN 0 THEN 'token = 1\\nexport K3=2\\r\\n K4 = 5' WHEN 1 THEN NULL WHEN 2 THEN 'password=x' ELSE text END"
    docs.selectExpr("doc_id", f"{text} AS text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q.queries()["s10_env_keys"](spark, str(tmp_path))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.oracle_sql()["s10_env_keys"]).fetchall()
    assert len(want) == 20 and rows(["key", "path"], want) == rows(df.columns, df.collect())
    found = spark.createDataFrame([(None, "A=1\n"), ("b.env", "A=1\n# C=2"), (None, "B=1")], "path string, text string")
    from sparkloom.functions import extract as X

    assert rows(["key", "path", "line_number"], [("A", "b.env", 1), ("B", None, 1)]) == rows(["key", "path", "line_number"], X.env_keys(found).collect())
