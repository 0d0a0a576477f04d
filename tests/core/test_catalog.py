import duckdb
import pytest

from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if v is not None and type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_queries_without_sql(spark):
    """Their rows, against what their inputs say."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"exit_messages", "redact_secrets", "redact_documents", "human_text"}
    rows = lambda name: catalog.QUERIES[name](spark, FOLDER)
    for name in ("exit_messages", "human_text"):
        got = rows(name).collect()
        assert got and all(v is not None for r in got for v in r)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    shown = rows("redact_secrets").collect()
    assert len(shown) == len(pages) and all("***" in str(tuple(r)) and pages[r.page_id] not in str(tuple(r)) for r in shown if " " not in pages[r.page_id])
    assert rows("redact_documents").count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
