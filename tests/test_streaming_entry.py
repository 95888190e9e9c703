import datetime as dt
import re

import __spark_entry__
from siftmill.streaming import decisions as S

ROW = "run_id string, review string, work_id string, decision string, span_verified boolean, verify_note string, created_at timestamp"


def batch(spark, path, rows):
    base = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("run", "r", w, d, False, n, base + dt.timedelta(minutes=m)) for w, d, n, m in rows], ROW).coalesce(1).write.mode("append").parquet(path)


def test_failures_by_window(spark, tmp_path):
    path = str(tmp_path / "in")
    batch(spark, path, [("W1", "unverified", "not_found", 1), ("W2", "unverified", "not_found", 5), ("W3", "error", None, 70)])
    batch(spark, path, [("W4", "unverified", "not_found", 400)])
    q = S.windowed_failures(S.without_repeats(S.read_stream(spark, path, ROW), ["run_id", "review", "work_id"], "created_at", "1 hour"), late=None).writeStream.outputMode("append").format("memory").queryName("fails").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"].hour, r["note"]): r["n"] for r in spark.sql("SELECT * FROM fails").collect()}
    assert got[0, "not_found"] == 2 and got[1, ""] == 1


def test_upsert_of_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch(spark, path, [("W1", "include", "a", 1), ("W2", "exclude", "b", 1)])
    batch(spark, path, [("W1", "exclude", "c", 9)])
    q = S.read_stream(spark, path, ROW).writeStream.foreachBatch(S.upsert_into(out, ["run_id", "review", "work_id"], "created_at")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    got = {r["work_id"]: r["decision"] for r in spark.read.parquet(f"{out}/{last}").collect()}
    assert got == {"W1": "exclude", "W2": "exclude"}


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(re.fullmatch(r"[a-z][a-z0-9_]*", q) for q in queries)
    assert __spark_entry__.entry(spark).columns[0] == "review"
