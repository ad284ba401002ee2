"""Streams over several files give what the batch jobs give."""

import shutil

import pytest
from conftest import SMALL
from micro import values
from pyspark.sql import functions as F

from tidecrew.operators.changes import decrement_stock
from tidecrew.sources.requests import request_batch, request_stream
from tidecrew.streaming import jobs


@pytest.fixture()
def split_events(spark, tmp_path):
    """The events in time order, as files that arrive one after the other."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").toPandas()
    folder = tmp_path / "events"
    folder.mkdir()
    step = len(events) // 3 + 1
    for i in range(3):
        part = events.iloc[i * step : (i + 1) * step]
        frame = spark.createDataFrame(part, spark.read.parquet(f"{SMALL}/events.parquet").schema)
        frame.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        source = next((tmp_path / f"part{i}").glob("*.parquet"))
        shutil.copy(source, folder / f"events-{i}.parquet")
    return folder


def stream_of(spark, folder):
    schema = spark.read.parquet(str(folder)).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def test_totals_and_days_over_several_files(spark, split_events, monkeypatch):
    monkeypatch.setattr(jobs, "event_stream", lambda spark, folder: stream_of(spark, folder))
    events = spark.read.parquet(str(split_events)).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(values(jobs.live_totals(events)))
    assert sorted(values(jobs.live_impact(spark, split_events))) == want
    days = jobs.donations_by_day(spark, split_events).orderBy("day")
    batch = events.filter("event_type = 'purchase'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).count()
    closed = sorted(values(batch, "day", "count"))[:-1]
    assert values(days, "day", "donations") == closed
    joins = values(jobs.first_join(spark, split_events))
    assert sorted(joins) == sorted(values(events.select("user_id", "event_type").distinct()))


def test_ledger_over_several_batches_equals_one_batch(spark, small, split_events):
    got = jobs.stock_ledger(request_stream(stream_of(spark, split_events), "stock_requests"), small)
    want = decrement_stock(small, request_batch(small, "stock_requests")).verdicts
    columns = ("request_id", "product_id", "quantity", "reason")
    assert sorted(values(got, *columns)) == sorted(values(want, *columns))


def test_an_interrupted_ledger_goes_on(spark, small, split_events, tmp_path):
    """Two runs over the same folder give what one run gives, and the stock that is left."""
    first = tmp_path / "first"
    first.mkdir()
    out = str(tmp_path / "ledger")
    for name in ("events-0.parquet", "events-1.parquet"):
        shutil.copy(split_events / name, first / name)
    jobs.stock_ledger(request_stream(stream_of(spark, first), "stock_requests"), small, out)
    shutil.copy(split_events / "events-2.parquet", first / "events-2.parquet")
    got = jobs.stock_ledger(request_stream(stream_of(spark, first), "stock_requests"), small, out)
    want = decrement_stock(small, request_batch(small, "stock_requests"))
    assert sorted(values(got, "request_id", "reason")) == sorted(values(want.verdicts, "request_id", "reason"))
    left = want.tables["products"].filter("quantity is not null")
    assert sorted(values(jobs.current_stock(spark, out), "id", "quantity")) == sorted(values(left, "id", "quantity"))


def test_a_batch_reads_nothing_of_the_batches_before(spark, small, split_events, tmp_path):
    """The stored verdicts are gone before the second run: only the state is needed to go on."""
    first = tmp_path / "first"
    first.mkdir()
    out = str(tmp_path / "ledger")
    shutil.copy(split_events / "events-0.parquet", first / "events-0.parquet")
    done = jobs.stock_ledger(request_stream(stream_of(spark, first), "stock_requests"), small, out).count()
    for file in (tmp_path / "ledger" / "verdicts").glob("part-*.parquet"):
        file.write_bytes(b"")
    shutil.copy(split_events / "events-1.parquet", first / "events-1.parquet")
    jobs.stock_ledger(request_stream(stream_of(spark, first), "stock_requests"), small, out)
    files = [str(f) for f in (tmp_path / "ledger" / "verdicts").glob("part-*.parquet") if f.stat().st_size]
    rows = spark.read.parquet(*files).select("request_id", "reason")
    events = spark.read.parquet(str(split_events / "events-0.parquet"), str(split_events / "events-1.parquet"))
    want = decrement_stock(small, request_stream(events, "stock_requests")).verdicts
    assert done + rows.count() == want.count()
    assert set(values(rows)) <= set(values(want, "request_id", "reason"))


def test_late_donations_are_added_to_their_day(spark, tmp_path):
    def arrive(name: str, *rows: tuple[str, str, float]) -> None:
        text = " union all ".join(
            f"select {i}L as event_id, 1L as user_id, '{kind}' as event_type, {value}d as value, timestamp_ntz'{ts}' as ts"
            for i, (ts, kind, value) in enumerate(rows)
        )
        spark.sql(text).coalesce(1).write.parquet(str(tmp_path / "arrived" / name))
        (file,) = (tmp_path / "arrived" / name).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(file.read_bytes())

    def run() -> list:
        rows = jobs.corrected_donations(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
        return sorted((r.day, r.donations, float(r.amount), r.late_donations) for r in rows)

    source = jobs.event_stream
    jobs.event_stream = lambda spark, folder: source(spark, folder, "*.parquet", 1)
    try:
        arrive("a", ("2001-01-01 10:00:00", "purchase", 5.0), ("2001-01-01 11:00:00", "signup", 9.0), ("2001-01-02 10:00:00", "purchase", 7.0))
        assert run() == [("2001-01-01", 1, 5.0, 0)]
        arrive("b", ("2001-01-05 10:00:00", "purchase", 1.5), ("2001-01-02 12:00:00", "purchase", 2.0))
        assert run() == [("2001-01-01", 1, 5.0, 0), ("2001-01-02", 2, 9.0, 0)]
        arrive("c", ("2001-01-02 23:00:00", "purchase", 3.0), ("2001-01-01 00:00:00", "purchase", 0.25))
        assert run() == [("2001-01-01", 2, 5.25, 1), ("2001-01-02", 3, 12.0, 1)]
        assert run() == [("2001-01-01", 2, 5.25, 1), ("2001-01-02", 3, 12.0, 1)]
    finally:
        jobs.event_stream = source


def test_a_later_run_goes_on_and_repeats_are_dropped_for_ever(spark, tmp_path):
    from tidecrew.streaming import jobs

    def arrive(day: str, user: int, name: str) -> None:
        rows = spark.sql(
            f"select 1L as event_id, {user}L as user_id, 'signup' as event_type, 1.0d as value, timestamp_ntz'{day}' as ts"
        )
        rows.coalesce(1).write.parquet(str(tmp_path / "arrived" / name))
        (file,) = (tmp_path / "arrived" / name).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(file.read_bytes())

    def run() -> list:
        stream = jobs.event_stream(spark, str(tmp_path / "in"), "*.parquet")
        out = str(tmp_path / "out")
        jobs._run(
            jobs.first_of_kind(stream).select("user_id").writeStream.outputMode("append").format("parquet").option("path", f"{out}/joins"),
            out,
        )
        return sorted(r.user_id for r in spark.read.parquet(f"{out}/joins").collect())

    arrive("2001-01-01 00:00:00", 1, "a")
    assert run() == [1]
    arrive("2001-08-01 00:00:00", 1, "b")
    arrive("2001-08-02 00:00:00", 2, "c")
    assert run() == [1, 2]


def test_only_products_asked_for_have_a_state(spark, small, split_events, tmp_path):
    """The ledger does not start with a call and a state for each product of the whole table."""
    out = str(tmp_path / "ledger")
    jobs.stock_ledger(request_stream(stream_of(spark, split_events), "stock_requests"), small, out)
    asked = request_batch(small, "stock_requests").select("product_id").distinct().count()
    state = spark.read.format("statestore").option("stateVarName", "left").load(f"{out}/progress").count()
    assert 0 < state <= asked < small.products.count()
    assert jobs.current_stock(spark, out).count() == small.products.filter("quantity is not null").count()
