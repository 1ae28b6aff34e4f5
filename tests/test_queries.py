"""Every query with SQL gives the rows that its SQL gives, in another engine."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_rows(spark, tmp_path, name):
    out = str(tmp_path / "out")
    entry_point.queries()[name](spark, SF).write.parquet(out)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.sql(f"CREATE TABLE want AS {entry_point.oracle_sql()[name]}")
    con.sql(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    columns = sorted(r[0] for r in con.sql("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in con.sql("DESCRIBE got").fetchall())
    k = ", ".join(f'"{c}"' for c in columns)
    assert con.sql(f"SELECT {k} FROM want EXCEPT ALL SELECT {k} FROM got").fetchall() == []
    assert con.sql(f"SELECT {k} FROM got EXCEPT ALL SELECT {k} FROM want").fetchall() == []


def test_changes_in_the_last_half_second_of_a_day(spark, tmp_path):
    """The SQL rounds times to seconds, so that such changes belong to the next day's batch."""
    con, sf = duckdb.connect(), str(tmp_path)
    con.sql(f"COPY (SELECT * FROM '{SF}/conversations.parquet' LIMIT 20) TO '{sf}/conversations.parquet'")
    times = [("12:00:00.5", t) for t in ("23:59:59.4", "23:59:59.5", "23:59:59.500001", "23:59:59.999999")]
    rows = ", ".join(f"({n}, TIMESTAMP '2024-01-0{1 + n % 4} {t}', {n}, 'view', 1.0, '')" for n in range(16) for t in times[n // 4])
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) AS e(event_id, ts, user_id, event_type, value, props)) TO '{sf}/events.parquet'")
    for t in ("conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(f"SELECT path, n_done, n_failed, known_us FROM ({entry_point.oracle_sql()['watch_replay']}) ORDER BY path").fetchall()
    got = entry_point.queries()["watch_replay"](spark, sf).select("path", "n_done", "n_failed", "known_us").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["png_pipeline", "encoded_choice"])
def test_pictures_of_one_file_are_work_for_all_tasks(spark, name):
    assert entry_point.queries()[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
