"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from parlance import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        return None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("first, rest, upper", [("THE CAT DOG", "the cat sat dog on", False), ("the cat dog", "THE CAT SAT DOG ON", True)])
def test_case_vote_is_over_all_texts(spark, tmp_path, first, rest, upper):
    """The first 100 documents, by key and in the file, are of the other case than the corpus; some have no letters or no text."""
    from hashlib import md5

    texts = [first] * 150 + [rest] * 300 + ["12 34", None, " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("the cat on",)], "text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    words = [[w if w in ("the", "cat", "on") else "<UNK>" for w in (t or "").lower().split()] for t in texts]
    want = [(k, md5(" ".join(x if x == "<UNK>" or not upper else x.upper() for x in w).encode()).hexdigest()) for k, w in enumerate(words) if w]
    got = sorted(map(tuple, registry.queries()["replace_oov"](spark, str(tmp_path)).collect()))
    assert got == want
    if not upper:  # the SQL has the lower case only
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        assert got == sorted(con.sql(registry.oracle_sql()["replace_oov"]).fetchall())
