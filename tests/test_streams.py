"""A stream read in several files gives what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shortlist.operators.ranking import cosine_scores
from shortlist.streaming.arrivals import first_arrivals, run_available, stream_dedup_url, stream_first_by_event, stream_score


@pytest.fixture()
def arrivals(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(i, f"u{i % 7}" if i % 3 else "hot", t0 + timedelta(minutes=i), [float(i), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, url string, ts timestamp, embedding array<double>")
    for part in range(3):
        df.filter((F.col("id") >= part * 30) & (F.col("id") < part * 30 + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def follow(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scores_equal_the_batch(spark, arrivals):
    df, path, tmp = arrivals
    run_available(stream_score(follow(spark, df, path), [1.0, 0.0]), str(tmp / "out"), str(tmp / "state"))
    got = {r["id"]: r["similarity_score"] for r in spark.read.parquet(str(tmp / "out")).collect()}
    assert got == {r["id"]: r["similarity_score"] for r in cosine_scores(df, [1.0, 0.0]).collect()}


def test_one_row_per_url_and_restart_adds_nothing(spark, arrivals):
    df, path, tmp = arrivals
    for _ in range(2):
        run_available(stream_dedup_url(follow(spark, df, path), "ts", "10 days"), str(tmp / "out"), str(tmp / "state"))
        urls = [r["url"] for r in spark.read.parquet(str(tmp / "out")).collect()]
        assert sorted(urls) == sorted({r["url"] for r in df.collect()})


def test_a_late_repeat_inside_the_delay_is_dropped(spark, tmp_path):
    schema = "url string, ts timestamp"
    for n, (url, minute) in enumerate([("a", 0), ("b", 30), ("a", 5)]):
        spark.createDataFrame([(url, datetime(2026, 1, 1) + timedelta(minutes=minute))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        run_available(stream_dedup_url(stream, "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def arrive(spark, tmp_path, files, delay):
    """Run each file as its own batch; the winners after every batch, and all rows that were sent."""
    schema = "url string, ts timestamp, priority int, id long"
    states = []
    for n, rows in enumerate(files):
        made = [(u, None if m is None else datetime(2026, 1, 1) + timedelta(minutes=m), p, i) for u, m, p, i in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        run_available(stream_first_by_event(stream, "ts", delay, ["priority", "id"]), str(tmp_path / "out"), str(tmp_path / "state"))
        sent = spark.read.schema(f"{schema}, version int, period timestamp").parquet(str(tmp_path / "out"))
        states.append(sorted((r["url"] or "", r["id"]) for r in first_arrivals(sent).collect()))
    return states, sent.count()


def test_an_earlier_event_in_a_later_file_wins(spark, tmp_path):
    states, sent = arrive(spark, tmp_path, [
        [("a", 30, 2, 1), ("a", 40, 0, 2), ("b", 10, 1, 3), (None, 5, 1, 4)],
        [("a", 20, 3, 5), ("b", 10, 0, 6), ("b", 10, 0, 7), ("  ", 6, 0, 8), ("c", None, 0, 9)],
        [("a", 20, 3, 5), ("a", 25, 0, 10), ("b", 10, None, 0)]], "10 days")
    assert states[0] == [("", 4), ("a", 1), ("b", 3)]
    assert states[1] == states[2] == [("", 4), ("a", 5), ("b", 6)] and sent == 5


def test_states_end_with_the_watermark(spark, tmp_path):
    states, _ = arrive(spark, tmp_path, [
        [("a", 0, 0, 1)], [("b", 200, 0, 2)], [("a", 30, 0, 3), ("a", 201, 0, 4)], [("a", 150, 0, 5)], [("a", 205, 0, 6)]], "1 hour")
    assert states[1] == [("a", 1), ("b", 2)]            # minute 30 is late, minute 201 begins a new period
    assert states[2] == [("a", 1), ("a", 4), ("b", 2)]
    assert states[4] == states[3] == [("a", 1), ("a", 5), ("b", 2)]


def test_many_urls_equal_the_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f"u{draw.randint(0, 30)}", draw.randint(0, 500), draw.choice([0, 1, None]), i) for i in range(400)]
    states, _ = arrive(spark, tmp_path, [rows[i::4] for i in range(4)], "30 days")
    first = {}
    for u, m, p, i in rows:
        first[u] = min(first.get(u, (10**6,)), (m, p is None, p or 0, i))
    assert states[-1] == sorted((u, f[3]) for u, f in first.items())
