"""State by key over several batches and restarts: repeated and late rows, bounded sets, the sweep's timers."""

import datetime as dt

import pytest

from tidewell.streaming import state, streams

TICKS = "symbol string, ts timestamp, id long, value double"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


class Feed:
    """A folder of deliveries, and runs of a stream over what is new in it; each run is a restart."""

    def __init__(self, spark, folder, schema, make, files=1):
        self.spark, self.folder, self.schema, self.make, self.files = spark, str(folder), schema, make, files

    def deliver(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        with state.rocksdb(self.spark):
            stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(f"{self.folder}/in")
            return streams.run_once(self.make(stream), f"{self.folder}/out", f"{self.folder}/progress")


def test_prices_outlive_restarts_and_repetition(spark, tmp_path):
    feed = Feed(spark, tmp_path, TICKS, lambda s: state.prices(s, parts=3, most=4))
    got = lambda: {r.symbol: (r.value, r.previous, r.session_open) for r in state.latest(feed.run()).collect()}
    feed.deliver(("a", at(10), 1, 10.0), ("a", at(11), 2, 11.0), ("a", at(9), 7, None))
    assert got() == {"a": (11.0, 10.0, 10.0)}
    feed.deliver(("a", at(11), 2, 11.0))  # again, in a later run
    assert got() == {"a": (11.0, 10.0, 10.0)}
    feed.deliver(("a", at(5), 0, 5.0), ("b", at(9), 9, 1.0))  # late: only the opening price changes
    feed.deliver(*[("a", at(20 + i), 20 + i, 20.0 + i) for i in range(10)], ("a", at(21), 21, 21.0))
    assert got() == {"a": (29.0, 28.0, 5.0), "b": (1.0, None, 1.0)}
    n = feed.spark.read.parquet(f"{feed.folder}/out").count()
    feed.deliver(("a", at(29), 29, 29.0), ("a", at(10), 1, 10.0))
    assert got()["a"] == (29.0, 28.0, 5.0) and feed.spark.read.parquet(f"{feed.folder}/out").count() == n


def test_carried_versions_take_a_repeated_row_as_one(spark, tmp_path):
    write = streams.carry(f"{tmp_path}/state")
    rows = [[("a", at(10), 1, 10.0), ("a", at(11), 2, 11.0), ("a", at(11), 2, 11.0)], [("a", at(11), 2, 11.0)], [("a", at(11), 2, 11.0), ("a", at(11), 3, 12.0)]]
    found = []
    for epoch, batch in enumerate(rows):
        write(spark.createDataFrame(batch, TICKS), epoch)
        found.append(tuple(streams.carried(spark, f"{tmp_path}/state").first())[1:])
    assert found == [(11.0, 10.0, 10.0), (11.0, 10.0, 10.0), (12.0, 11.0, 10.0)]


def test_a_bounded_set_forgets_only_what_is_old(spark, tmp_path):
    feed = Feed(spark, tmp_path, TICKS, lambda s: state.unseen(s, parts=1, most=3))
    feed.deliver(*[("a", at(i), i, float(i)) for i in range(1, 6)])
    feed.deliver(*[("a", at(i), i, float(i)) for i in range(1, 8)], ("b", at(1), 1, 1.0))
    feed.deliver(("a", at(0), 99, 0.0), ("a", at(7), 98, 0.5))
    assert sorted((r.key, r.id) for r in feed.run().collect()) == [("a", i) for i in (1, 2, 3, 4, 5, 6, 7, 98)] + [("b", 1)]


def test_the_newest_rows_as_a_listing(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, ts timestamp, title string", lambda s: state.newest(s, "news", ["title"], parts=2, most=3))
    listing = lambda: [(r.place, r.id, r.row) for r in state.newest_listing(feed.run()).orderBy("place").collect()]
    feed.deliver((1, at(1), "one"), (5, at(5), "five"))
    assert [x[:2] for x in listing()] == [(1, 5), (2, 1)]
    feed.deliver((5, at(5), "five"), (3, at(3), "three"), (4, at(4), None))
    feed.deliver((0, at(0), "old"))
    assert listing() == [(1, 5, '{"title":"five"}'), (2, 4, "{}"), (3, 3, '{"title":"three"}')]


def test_the_sweep_delivers_again_until_acknowledged(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, kind string, ts timestamp, action string, score double", lambda s: state.sweep(s, grace_s=90, every_s=60, most=3))
    news = lambda i, s, action="RECALC_H1_H2", score=85.0: (i, "news", at(s), action, score)
    ack = lambda i, s: (i, "ack", at(s), None, None)
    made = lambda: sorted((r.id, r.kind, r.attempt, r.at_ms // 1000 - int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())) for r in feed.run().collect())
    feed.deliver(news(1, 0), news(2, 0), news(3, 0, "ARCHIVE_ONLY"), news(4, 0, score=70.0), ack(5, 0), news(5, 0))
    feed.deliver(ack(2, 50), news(1, 0), news(9, 100))
    first = [(1, "notify", 1, 90), (4, "notify", 1, 90)]
    assert made() == first
    feed.deliver(ack(4, 120), news(9, 160))
    second = first + [(1, "notify", 2, 150)]
    assert made() == sorted(second)
    feed.deliver(news(10, 3600))
    assert made() == sorted(second + [(1, "notify", 3, 210), (1, "alert", 3, 210)] + [(9, "notify", k, 130 + 60 * k) for k in (1, 2, 3)] + [(9, "alert", 3, 310)])
    feed.deliver(news(1, 0), news(11, 7200))
    assert len([r for r in made() if r[0] == 1]) == 4


@pytest.mark.parametrize("hours", [0, 2])
def test_seen_rows_may_age(spark, hours):
    """The clock is taken where state ages, and only there."""
    stream = spark.readStream.format("rate").load().selectExpr("'a' as symbol", "timestamp as ts", "value as id", "1D as value")
    plan = state.unseen(stream, ttl_hours=hours)._jdf.queryExecution().analyzed().toString()
    assert ("ProcessingTime" in plan) == bool(hours)


def test_the_sweep_keeps_ids_apart_that_share_a_part(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, kind string, ts timestamp, action string, score double", lambda s: state.sweep(s, grace_s=90, every_s=60, most=2))
    news = [(i, "news", at(i % 7), "RECALC_H1_H2", 60.0 + i % 40) for i in range(2**60, 2**60 + 5000)]
    feed.deliver(*news, (None, "news", at(0), "RECALC_H1_H2", 99.0), (None, "news", at(3), "RECALC_H1_H2", 99.0), (7, "news", None, "RECALC_H1_H2", 99.0))
    feed.deliver(*[(r[0], "ack", at(50), None, None) for r in news if r[0] % 3 == 0], (2**60, "ack", None, None, None), (-1, "news", at(93), "RECALC_H1_H2", 60.0))
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    expected = lambda until: sorted(
        x
        for i, _, t, _, score in [*[r for r in news if r[0] % 3 and r[0] != 2**60], (-99, "", at(0), "", 99.0), (-1, "", at(93), "", 60.0)]
        for s in [(t - at(0)).seconds]
        for x in [(i, "notify", k, s + 30 + 60 * k) for k in (1, 2)] + [(i, "alert", 2, s + 150)] * (score >= 80)
        if x[3] <= until
    )
    made = lambda: sorted((-99 if r.id is None else r.id, r.kind, r.attempt, r.at_ms // 1000 - start) for r in feed.run().collect())
    assert made() == expected(93)
    feed.deliver((2**60 + 1, "news", at(400), "RECALC_H1_H2", 99.0))
    assert made() == expected(400)


def test_an_unbounded_set_forgets_nothing_and_touches_only_its_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, TICKS, lambda s: state.unseen(s, parts=1, most=0))
    feed.deliver(*[("a", at(i), i, float(i)) for i in range(1, 1200)])
    feed.deliver(*[("a", at(i), i, float(i)) for i in range(1, 1200)], ("b", at(1), 1, 1.0), ("a", at(1), 1, 1.0))
    assert feed.run().count() == 1200
    feed.deliver(("a", at(0), 5000, 0.0), ("a", at(1), 1, 1.0))  # older than all; repeated after a restart
    assert sorted((r.key, r.id) for r in feed.run().collect()) == [("a", i) for i in [*range(1, 1200), 5000]] + [("b", 1)]
    with pytest.raises(ValueError):
        state.unseen(spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in"), most=0, ttl_hours=1)


def test_few_rows_of_a_batch_reach_the_state_and_the_ends_are_among_them(spark):
    rows = spark.range(0, 60_000, 1, 2).selectExpr("if(id % 7 = 0, null, concat('k', id % 5)) as key", "hash(id % 9000) % 500 as at", "id % 9000 as id", "cast(id as double) as value")
    rows = rows.withColumn("at", rows["at"].cast("long")).union(spark.sql("select 'k1', cast(null as long), 1L, 1D"))
    for most, oldest in ((2, True), (60, False)):
        kept = state.ends(rows, "key", most, oldest).collect()
        assert len(kept) <= 9 * 6 * (most + oldest)  # Arrow batches by keys
        for key in (None, "k0", "k1", "k2", "k3", "k4"):
            places = lambda found: sorted({(r["at"], r["id"]) for r in found if r["key"] == key and r["at"] is not None})
            mine, all_ = places(kept), places(rows.collect())
            assert mine[-most:] == all_[-most:] and (not oldest or mine[0] == all_[0])


def test_state_of_few_groups_lies_in_few_partitions(spark, tmp_path):
    before = spark.conf.get(state.PARTITIONS), spark.conf.get(state.PROVIDER)
    spark.createDataFrame([("a", at(1), 1, 1.0)], TICKS).write.parquet(f"{tmp_path}/in")
    for most, expected in ((2, "2"), (64, before[0]), (None, before[0])):
        with state.rocksdb(spark, most):
            assert spark.conf.get(state.PARTITIONS) == expected
            if most == 2:
                streams.run_once(state.prices(spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/progress")
        assert (spark.conf.get(state.PARTITIONS), spark.conf.get(state.PROVIDER)) == before
    assert {p.name for p in (tmp_path / "progress/state/0").iterdir() if p.name.isdigit()} == {"0", "1"}


def test_a_listing_hands_few_rows_to_its_state(spark, tmp_path):
    rows = [(i, at(i * 7919 % 20_000), f"t{i}") for i in range(20_000)]
    feed = Feed(spark, tmp_path, "id long, ts timestamp, title string", lambda s: state.newest(s, "news", ["title"], parts=2, most=5))
    feed.deliver(*rows, (99_999, None, "no time"))
    listing = [(r.place, r.id) for r in state.newest_listing(feed.run()).orderBy("place").collect()]
    assert listing == [(k + 1, r[0]) for k, r in enumerate(sorted(rows, key=lambda r: r[1], reverse=True)[:5])]
    plan = state.newest(spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/in"), "news", ["title"])._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan
