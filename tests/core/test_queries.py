import hashlib
import os

import duckdb
import pytest

from blockstrata.plans import file_queries as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(rows):
    return sorted(tuple(repr(bytes(v) if isinstance(v, bytearray) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    assert _plain(tuple(r) for r in df.select(*columns).collect()) == _plain(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.fixture(scope="module")
def long_events(spark, tmp_path_factory):
    """Blocks of one type take more than two index blocks of the usual size, half of them more than one."""
    folder = str(tmp_path_factory.mktemp("long"))
    spark.range(1_110_050).selectExpr("id AS event_id", "if(id % 100000 = 7, 'view', 'click') AS event_type", "id / 8D AS value").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["file_ends"])
def test_long_files_equal_sql(spark, long_events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{long_events}/events.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, long_events)
    found = con.execute(queries.ORACLE[name])
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert _plain(tuple(r) for r in df.collect()) == _plain(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", ["index_roundtrip", "source_index"])
def test_long_indexes_equal_sql(spark, long_events, name):
    test_long_files_equal_sql(spark, long_events, name)


def test_messages_keep_null_ids_and_texts(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, ""), (3, None), (None, "x"), (None, "x"), (None, None), (-4, "é\n\x00"), (2**52, "word " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(d, None, None) if t is None else (d, len(t.encode()), hashlib.md5(t.encode()).hexdigest()) for d, t in rows]
    assert _plain(tuple(r) for r in queries.QUERIES["message_raw"](spark, str(tmp_path)).collect()) == _plain(want)
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["message_raw"](spark, str(tmp_path)).collect() == []
