"""Streams in several batches give what one batch job gives; a restart adds nothing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from curalens.operators.lists import latest_readings
from curalens.plans.registry import all_queries
from curalens.schemas import SUPPLIED
from curalens.sources.standins import Views
from curalens.streaming import jobs
from curalens.streaming.levels import LeveledTable, admit, admitted, current_rows, seen_before, upsert, write_keys


def split_events(spark, tmp_path):
    events = spark.read.schema(SUPPLIED["events"]).parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return events, str(tmp_path / "in")


def test_updates_equal_batch(spark, tmp_path):
    events, path = split_events(spark, tmp_path)
    own = jobs.stream_session(spark)

    def shaped(df):
        return df.selectExpr("concat('m', event_id % 40) AS media_id", "ts AS read_at", "event_id AS reach")

    folder = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        jobs.land_updates(jobs.latest_reach(shaped(jobs.read_events(own, path, 1))), folder, ["media_id"])
    got = {tuple(r) for r in current_rows(own, folder, ["media_id"]).select("media_id", "reach", "readings").collect()}
    want = shaped(events).groupBy("media_id").agg(F.max_by("reach", "read_at").alias("reach"), F.count("*").alias("n"))
    assert got == {tuple(r) for r in want.collect()}
    assert LeveledTable(own, folder).manifest()["batch"] == 3


def test_keys_once_over_batches(spark, tmp_path):
    events, path = split_events(spark, tmp_path)
    own = jobs.stream_session(spark)
    folder = str(tmp_path / "out")
    urls = jobs.read_events(own, path, 1).selectExpr("IF(event_id % 50 = 0, NULL, concat('u', user_id % 60)) AS source_url")
    for _ in range(2):
        jobs.land_once(urls, folder, "source_url")
    rows = [r.source_url for r in admitted(own, folder, "source_url").collect()]
    assert len(rows) == len(set(rows)) == events.filter("event_id % 50 <> 0").selectExpr("user_id % 60").distinct().count()


def test_many_batches_of_keys_stay_unique_and_merge(spark, tmp_path):
    table = LeveledTable(spark, str(tmp_path / "keys"), fanout=3)
    seen = set()
    for batch in range(11):
        keys = [f"k{i}" for i in range(batch * 700, batch * 700 + 1500)] + [None, "k5", "k5"]
        admit(table, spark.createDataFrame([(k,) for k in keys], "source_url string"), batch, "source_url")
        seen |= {k for k in keys if k}
    admit(table, spark.createDataFrame([("late",)], "source_url string"), 4, "source_url")          # a batch that is in already
    rows = [r.source_url for r in admitted(spark, table.folder, "source_url").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == seen
    runs = table.manifest()["runs"]
    levels = [r["level"] for r in runs]
    assert max(levels) == 2 and all(levels.count(k) < 3 for k in levels) and sum(r["keys"] for r in runs) == len(seen)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(0, 9000, 7)] + [("new",)], "source_url string")
    assert {r[0] for r in seen_before(table, asked, "source_url").collect()} == {f"k{i}" for i in range(0, 9000, 7)} & seen


def test_a_filter_sends_few_new_keys_to_the_stored_ones(spark, tmp_path):
    write_keys(spark.range(5000).selectExpr("concat('k', id) AS url"), "url", str(tmp_path / "run"))
    bits = spark.read.parquet(str(tmp_path / "run" / "filter"))
    assert bits.count() == 3 and 0 < bits.agg(F.sum(F.bitmap_count("bits"))).first()[0] <= 5000


def test_a_crash_between_run_and_manifest(spark, tmp_path, monkeypatch):
    table = LeveledTable(spark, str(tmp_path / "t"), fanout=2)

    def rows(batch):
        return spark.createDataFrame([(k, batch * 10 + k) for k in range(batch, batch + 4)], "k long, v long")

    upsert(table, rows(0), 0, ["k"])
    commit = LeveledTable._commit
    monkeypatch.setattr(LeveledTable, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        upsert(table, rows(1), 1, ["k"])
    assert table.manifest()["batch"] == 0 and current_rows(spark, table.folder, ["k"]).count() == 4      # the run is there, nobody reads it
    calls = []
    monkeypatch.setattr(LeveledTable, "_commit", lambda self, old, **k: commit(self, old, **k) if not calls.append(k) and len(calls) == 1 else
                        (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):                                                                         # the batch is in, its merge is lost
        upsert(table, rows(1), 1, ["k"])
    monkeypatch.setattr(LeveledTable, "_commit", commit)
    for batch in (1, 2, 3, 4):
        upsert(table, rows(batch), batch, ["k"])
    want = {}
    for batch in range(5):
        want |= {k: batch * 10 + k for k in range(batch, batch + 4)}
    assert {r.k: r.v for r in current_rows(spark, table.folder, ["k"]).collect()} == want
    assert len(table.manifest()["runs"]) <= 3


def test_two_writers_of_one_manifest(spark, tmp_path):
    table = LeveledTable(spark, str(tmp_path / "t"))
    old = table.manifest()
    table._commit(old, batch=0)
    with pytest.raises(RuntimeError):
        table._commit(old, batch=0)


def retries_by_hand(failures, passed):
    out = []
    for item in {f[0] for f in failures}:
        times = sorted(t for i, t in failures if i == item)[:jobs.RETRY_LIMIT]
        for n, t in enumerate(times, 1):
            again = times[n] if n < len(times) else None
            if n == jobs.RETRY_LIMIT:
                out.append((item, n, "given up", t))
            elif (again is not None and again >= t + 600) or (again is None and t + 600 <= passed):
                out.append((item, n, "retry", t + 600))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_retries_come_out_when_due_and_once(spark, tmp_path, files):
    rng = random.Random(files)
    failures = sorted(((rng.randrange(12), rng.randrange(0, 20_000)) for _ in range(30)), key=lambda f: f[1]) + [(99, 40_000)]
    step = -(-len(failures) // files)
    own = jobs.stream_session(spark, 2)
    for i in range(files):
        (spark.createDataFrame(failures[i * step:(i + 1) * step], "item_id long, t long").select("item_id", F.timestamp_seconds("t").alias("at"))
         .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
        time.sleep(1.1)                    # files are taken in the order of their times
    folder = str(tmp_path / "out")
    for _ in range(2):                     # started again from its checkpoint it adds nothing
        stream = own.readStream.schema("item_id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.land_appends(jobs.retries(stream), folder)
    got = sorted((r.item_id, r.attempt, r.outcome, int(r.s)) for r in own.read.parquet(f"{folder}/rows").select("*", F.unix_seconds("at").alias("s")).collect())
    assert got == retries_by_hand(failures, 40_000 - 600)


def test_weekly_over_batches(spark, tmp_path):
    events, path = split_events(spark, tmp_path)
    own = jobs.stream_session(spark)
    folder = str(tmp_path / "out")
    cols = ["ts AS published_at", "CAST(value AS BIGINT) AS reach"]
    jobs.land_updates(jobs.weekly(jobs.read_events(own, path, 1).selectExpr(*cols)), folder, ["week_from"])
    got = {(r.week_from, r.posts, r.reach_total) for r in current_rows(own, folder, ["week_from"]).collect()}
    monday = F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp("published_at", "Asia/Tokyo")), "Asia/Tokyo")
    want = events.selectExpr(*cols).groupBy(monday.alias("w")).agg(F.count("*").alias("n"), F.sum("reach").alias("r"))
    assert got == {tuple(r) for r in want.collect()}


def test_stale_rows_are_routed(spark, tmp_path):
    _, path = split_events(spark, tmp_path)
    own = jobs.stream_session(spark)
    folder = str(tmp_path / "out")
    jobs.land_appends(jobs.route_stale(jobs.read_events(own, path).selectExpr(
        "event_id AS id", "ts AS arrived_at", "ts - make_interval(0, 0, 0, 0, 0, 0, value * 60) AS scheduled_at")), folder, ["route"])
    assert own.read.parquet(f"{folder}/rows").count() == spark.read.parquet(path).count()


def tied_events(spark, tmp_path):
    """Three readings of five at the last instant: as in the SQL, where ``arg_max`` keeps the first of equals, the third counts."""
    events = spark.read.schema(SUPPLIED["events"]).parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id", "timestamp_seconds(1704067200 + event_id div 5 * 60 + least(event_id % 5, 2)) AS ts", "user_id", "event_type",
        "CAST(event_id AS DOUBLE) AS value", "props")
    events.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "tied" / "events.parquet"))
    firsts = events.filter("event_id % 5 = 0").select("event_id").collect()
    return str(tmp_path / "tied"), {f"m{r.event_id}": (r.event_id + 2) * 10 for r in firsts}


def test_readings_at_one_instant_keep_the_first(spark, tmp_path):
    base, want = tied_events(spark, tmp_path)
    for sign in (1, -1):
        readings = Views(spark, base).reach_readings.repartition(3).orderBy(F.col("seq") * sign)
        assert {r.media_id: r.reach for r in latest_readings(readings).collect()} == want
    reached = all_queries()["reach_by_media"](spark, base).filter("reach_checked_at IS NOT NULL").select("id", "reach").collect()
    assert reached and all(want[f"m{r.id}"] == r.reach for r in reached)


def test_stream_of_readings_at_one_instant_keeps_the_first(spark, tmp_path):
    base, want = tied_events(spark, tmp_path)
    assert {r.media_id: r.reach for r in all_queries()["stream_latest_reach"](spark, base).collect()} == want
