"""Operators on small frames: order of checks, ties, ledgers, merges, constraints, sources."""

import datetime as dt
import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scoring, sql
from tidewell.functions import values as V
from tidewell.operators import access, committee, constraints, ledger, market, news, views
from tidewell.plans import market_queries
from tidewell.sources import http, payloads
from tidewell.streaming import streams

NOW = dt.datetime(2026, 8, 1, 12)
POINT = "symbol string, value double, observed_at timestamp, open double, high double, low double, bid double, ask double"


def reasons(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + POINT)
    return [r.reason for r in market.validate_points(df, market.point_rules(spark), F.lit(NOW)).orderBy("i").collect()]


def test_points_fail_at_their_first_check(spark):
    g = lambda v, at=NOW, o=None, h=None, l=None, b=None, a=None: ("XAUUSD", v, at, o, h, l, b, a)
    got = reasons(
        spark, g(3401.55, NOW, 3395.2, 3405.1, 3392.0), g(None), g(float("nan")), g(-12.0), g(999999999.0), g(3400.0, None), g(3400.0, NOW + dt.timedelta(seconds=301)), g(3400.0, NOW - dt.timedelta(days=4)),
        g(3400.0, NOW, 3390.0, 3395.0, 3380.0), g(3400.0, b=0.0), g(3400.0, b=5.0, a=4.0), ("US10YR", -0.85, NOW, None, None, None, None, None), ("XXX", 1.0, NOW, None, None, None, None, None),
    )
    assert got == [None, "absent", "not_finite", "negative", "implausible", "no_time", "future", "too_old", "ohlc", "bid", "book", None, "no_rule"]


def test_stamps_are_null_where_a_macro_is_missing(spark):
    df = spark.createDataFrame([("XAUUSD", 3400.0, NOW), ("US10YR", -0.85, NOW), ("US10YR", 1.0, NOW - dt.timedelta(hours=1))], "symbol string, value double, observed_at timestamp")
    row = market.stamp(df).collect()
    assert len(row) == 1 and row[0].real_yield == -0.85 and row[0].vix is None


@pytest.mark.parametrize("weights,shares", [((33, 33, 33, 33), (25, 25, 25, 25)), ((40, 30, 20, 10), (40, 30, 20, 10)), ((70, 20, 5, 5), (70, 20, 5, 5)), ((0, 0, 0, 0), (25, 25, 25, 25)), ((99, 1, 0, 0), (99, 1, 0, 0)), ((35, 30, 20, 16), (34, 30, 20, 16))])
def test_largest_remainder(spark, weights, shares):
    df = spark.createDataFrame([(1, h, float(w)) for h, w in zip(V.HORIZONS, weights)], "analysis_id int, horizon string, probability double")
    got = committee.largest_remainder(df, "analysis_id", "horizon", "probability").orderBy("horizon").collect()
    assert tuple(r.share for r in got) == shares


@pytest.mark.parametrize("scope,expected", [("H1_H2", (30, 10, 35, 25)), ("H3", (20, 20, 35, 25)), ("FULL", (60, 20, 10, 10))])
def test_scoped_merge(spark, scope, expected):
    def table(ps):
        return spark.createDataFrame([(1, h, float(p)) for h, p in zip(V.HORIZONS, ps)], "analysis_id int, horizon string, probability double")

    got = committee.scoped_merge(table((60, 20, 10, 10)), table((20, 20, 35, 25)), scope).orderBy("horizon").collect()
    assert tuple(r.probability for r in got) == expected


def test_scenarios_report_all_structural_errors_then_geometry(spark):
    cols = "i int, direction string, probability double, target double, invalidation double, activation_condition string, reasoning string"
    good = ("bullish", 50.0, 3450.0, 3380.0, "breaks above 3420 on volume", "real yields fall and the dollar weakens")
    rows = [good, (good[0], None, 3450.0, 0.0, "court", "short"), ("bearish", *good[1:]), ("bullish", 50.0, 3410.0, 3380.0, *good[4:]), ("neutral", 50.0, 3400.0, 3400.0, *good[4:])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], cols)
    got = [r.errors for r in committee.scenario_errors(df, F.lit(3400.0)).orderBy("i").collect()]
    assert got == [[], ["reasoning", "probability", "activation", "invalidation"], ["geometry"], ["ratio"], []]


def test_publishers_resolve_to_the_longest_parent(spark):
    df = spark.createDataFrame([("uk.finance.yahoo.com",), ("reuters.com",), ("x.y.z",), (None,)], "domain string")
    got = [(r.source, r.reliability) for r in news.resolve_source(df, news.registry(spark)).collect()]
    assert got == [("yahoo_finance", 80.0), ("reuters", 95.0), V.FALLBACK, V.FALLBACK]


def test_best_of_duplicates_keeps_the_first_on_ties(spark):
    df = spark.createDataFrame([("gold rises", 80.0, False, 1), ("gold rises", 75.0, True, 2), ("gold rises", 85.0, False, 3), ("short", 99.0, True, 4)], "dedup_key string, reliability double, has_body boolean, ordinal int")
    assert [r.ordinal for r in news.best_of_duplicates(df).collect()] == [2]


def test_insert_ignore_twice_adds_nothing(spark):
    df = spark.createDataFrame([("XAUUSD", "m5", 1), ("XAUUSD", "m5", 1), (None, "m5", 2)], "symbol string, timeframe string, n int")
    once = ledger.insert_ignore(df, df.limit(0), ["symbol", "timeframe"], F.col("n"))
    assert once.count() == 2 and ledger.insert_ignore(df, once, ["symbol", "timeframe"], F.col("n")).count() == 0


def test_locks(spark):
    runs = spark.createDataFrame([("market", "running", NOW - dt.timedelta(minutes=30), []), ("news", "running", NOW, [])], "engine string, status string, started_at timestamp, errors array<string>").withColumn("duration_ms", F.lit(None).cast("long"))
    assert not ledger.may_start(runs, "market")
    after = ledger.reclaim_stale(runs, F.lit(NOW))
    assert ledger.may_start(after, "market") and not ledger.may_start(after, "news")
    assert after.where("engine = 'market'").first().duration_ms == 1_800_000


def test_only_failed_deliveries_count(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "id int, notify_attempts int").withColumn("notified_at", F.lit(None).cast("timestamp"))
    done = ledger.mark_notified(df, spark.createDataFrame([(1, True), (2, False)], "id int, delivered boolean"), F.lit(NOW)).orderBy("id").collect()
    assert [(r.notified_at, r.notify_attempts) for r in done] == [(NOW, 0), (None, 1), (None, 5)]


def test_expired_analyses(spark):
    rows = [(1, "X", NOW - dt.timedelta(hours=2), NOW + dt.timedelta(hours=4)), (2, "X", NOW - dt.timedelta(hours=1), NOW - dt.timedelta(minutes=1))]
    a = spark.createDataFrame(rows, "analysis_id int, symbol string, analysis_ts timestamp, valid_until timestamp")
    s = spark.createDataFrame([(1, "H1", "bullish")], "analysis_id int, horizon string, direction string")
    assert views.ai_latest(a, s, F.lit(NOW)).first().scenarios["H1"].direction == "bullish"
    assert views.ai_latest(a, s, F.lit(NOW), latest_then_filter=True).count() == 0


def test_unknown_passes_and_false_breaks(spark):
    cols = "risk_verdict string, execution_status string, overall_bias string, rejection_reasons array<string>, confidence_cap double, model_version string, valid_until timestamp, analysis_ts timestamp, tick_id string, tick_ts timestamp"
    rows = [("REJECTED", "NO_VALID_SETUP", "neutral", [], None, "a.b", None, NOW, None, None), ("DATA_INSUFFICIENT", "VALID_SETUP", None, ["x"], 0.5, "a+b", NOW, NOW, "t", None), ("CONFLICT", "NO_VALID_SETUP", "neutral", ["y"], 0.4, "v1", None, NOW, None, None), (None, "NO_VALID_SETUP", "bullish", None, 2.0, None, None, None, None, None)]
    got = [r.violations for r in constraints.check(spark.createDataFrame(rows, cols), "ai_analyses").collect()]
    assert got == [["C21"], ["C14", "C15", "C16", "C22"], [], ["C23", "C24"]]


def test_every_table_of_rules_parses(spark):
    assert {name for name, _, _ in constraints.RULES} == {f"C{i}" for i in range(1, 32)} - {"C10", "C20"}


def test_roles(spark):
    tables = {"instruments": spark.range(1), "alerts": spark.range(1)}
    assert list(access.view(tables, "anon")) == ["instruments"] and len(access.view(tables, "authenticated")) == 2 and not access.view(tables, "nobody")


def test_payloads(spark):
    series = ['{"observations":[{"date":"2026-08-01","value":"4.21"},{"date":"2026-08-02","value":"."}]}', '{"observations":[{"date":"2026-08-01","value":"."}]}', '{"observations":[{"date":"2026-08-01"}]}', "<html>"]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(series)], "symbol string, payload string")
    assert [(r.value, r.unavailable_reason) for r in payloads.parse_series(df).orderBy("symbol").collect()] == [(4.21, None), (None, "no_numeric_observation"), (None, "no_numeric_observation"), (None, "unreadable")]
    articles = '{"status":"ok","articles":[{"title":"[Removed]","publishedAt":"2026-08-01T00:00:00Z"},{"title":"Gold &amp; oil","description":"d","content":"c [+20 chars]","url":"https://www.ft.com/x","publishedAt":"2026-08-01T00:00:00Z"},{"title":"No time"}]}'
    got = payloads.parse_articles(spark.createDataFrame([(articles,), ('{"status":"error"}',)], "payload string")).collect()
    assert [(r.title, r.content, r.domain) for r in got] == [("Gold & oil", "d c", "ft.com")]


def test_retries():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b'{"a": 1}')

    assert http.fetch("u", opener=opener, sleep=lambda s: None) == ('{"a": 1}', None) and len(calls) == 3

    def refused(url, timeout):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    calls.clear()
    assert http.fetch("u", opener=refused, sleep=lambda s: None) == (None, "http 404") and len(calls) == 1
    assert http.backoff(10, 0.4, 8.0, lambda: 1.0) == 8.0 and http.retry_after("7", 0) == 7.0


def test_the_http_source_reports_errors_as_rows(spark):
    spark.dataSource.register(http.HttpJson)
    got = spark.read.format("http_json").option("urls", "http://127.0.0.1:9/a http://127.0.0.1:9/b").option("retries", "0").load().collect()
    assert len(got) == 2 and all(r.payload is None and r.error for r in got)


def test_claims_survive_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = spark.createDataFrame([("e1",), ("e1",), ("e2",)], "event_id string")
    write = streams.claim(path)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == 2


def test_claims_of_two_writers(spark, tmp_path):
    from tidewell.sources import commits

    path = f"file://{tmp_path}/log"
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "event_id string")
    one, two = streams.claims(path, "one", 4), streams.claims(path, "two", 4)
    one(batch("e1", "e1", "e2"), 0)
    one(batch("e1", "e1", "e2"), 0)
    two(batch("e2", "e3"), 0)
    one(batch("e4", None), 1)
    assert sorted(r.event_id or "" for r in commits.Log(spark, path).read("claims").collect()) == ["", "e1", "e2", "e3", "e4"]


def test_monthly_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "ticks")
    df = spark.createDataFrame([(1, dt.datetime(2026, 7, 31)), (2, NOW)], "id int, ts timestamp")
    ledger.write_monthly(df, path)
    assert [r.id for r in spark.read.parquet(path).where("year_month = '2026_08'").collect()] == [2]


def test_agent_replies(spark):
    df = spark.createDataFrame([("a", "risk", '```json\n{"verdict":"APPROVED","confidence":72}\n```'), ("b", "risk", "not json"), ("c", "macro", '{"overall_bias":"UP"}')], "analysis_id string, agent string, reply_json string")
    got = [(r.verdict, r.confidence, r.overall_bias) for r in committee.coerce_replies(df).orderBy("analysis_id").collect()]
    assert got == [("APPROVED", 0.72, "neutral"), ("DATA_INSUFFICIENT", 0.5, "neutral"), (None, 0.5, "neutral")]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_s_rows_are_kept_in_files(spark, tmp_path, mode):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(6).selectExpr("id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 20 as int), 0) as ts", "'s' as symbol", "double(id) as value").write.parquet(source)
    feed = lambda: streams.change_feed(spark, source, spark.read.parquet(source).schema)
    run = lambda: streams.run_once(streams.dedup(feed(), "id").select("id") if mode == "append" else streams.hourly(feed(), "symbol"), at, str(tmp_path / "state"), mode)
    first = run()
    assert len(first.inputFiles()) > 0 and all(at in f for f in first.inputFiles())
    spark.sql("select 99L as id, timestamp '2024-01-01 00:30:00' as ts, 's' as symbol, 7.0D as value").write.mode("append").parquet(source)
    second = run()
    if mode == "append":
        assert sorted(r.id for r in second.collect()) == [0, 1, 2, 3, 4, 5, 99]
    else:
        assert sorted((r.window.start.hour, r.n, r.total) for r in second.collect()) == [(0, 4, 10.0), (1, 3, 12.0)]


def test_no_payload_holds_a_whole_series(spark, tmp_path, monkeypatch):
    spark.range(9000).selectExpr("if(id = 8999, 9000, id) as event_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id div 2 % 3000 as int)) as ts", "if(id < 8990, 'hot', if(id < 8999, 'few', 'none')) as event_type", "double(id) as value", "id as user_id").write.parquet(str(tmp_path / "events.parquet"))
    seen, parse = [], payloads.parse_series
    monkeypatch.setattr(payloads, "parse_series", lambda docs: seen.append(docs) or parse(docs))
    got = {r.symbol: (r.value, r.unavailable_reason) for r in market_queries.macro_last_obs(spark, str(tmp_path)).collect()}
    most = max((i for i in range(8990) if i % 3), key=lambda i: (i // 2 % 3000, str(i)))
    few = max((i for i in range(8990, 8999) if i % 3), key=lambda i: (i // 2 % 3000, str(i)))
    assert got == {"hot": (most, None), "few": (few, None), "none": (None, "no_numeric_observation")}
    sizes = seen[0].selectExpr("size(from_json(payload, 'observations array<struct<date: string>>').observations) as n").collect()
    assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 9000


def test_carried_state_survives_late_rows_and_a_replayed_batch(spark, tmp_path):
    write, path = streams.carry(str(tmp_path / "state")), str(tmp_path / "state")
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, ts timestamp, id long, value double")
    at = lambda minute: dt.datetime(2024, 1, 1, 10, minute)
    write(frame([("A", at(5), 1, 1.0)]), 0)
    second = frame([("A", at(3), 2, 2.0), ("A", at(9), 3, 3.0), ("B", at(1), 4, 4.0), ("B", at(1), 5, 5.0), (None, at(1), 6, 6.0)])
    for _ in range(2):
        write(second, 1)
    write(frame([]), 2)
    assert {tuple(r) for r in streams.carried(spark, path).collect()} == {("A", 3.0, 1.0, 2.0), ("B", 5.0, 4.0, 4.0), (None, 6.0, None, 6.0)}


def test_a_scheduled_stream_appends_in_batches(spark, tmp_path):
    table, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).selectExpr("id", "timestamp '2024-01-01 00:00:00' as ts", "if(id = 0, null, if(id < 3, 'major', 'noise')) as classification").write.parquet(table)
    feed = streams.notable(streams.change_feed(spark, table, spark.read.parquet(table).schema))
    query = streams.scheduled(feed, out, str(tmp_path / "progress"), "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_lists_fall_back_only_where_they_are_empty(spark):
    schema = "drivers array<string>, risks array<string>, invalidations array<string>, main_driver string, contradictions array<string>, bias_flags array<string>, levels map<string,string>"
    rows = [(None, [], None, "m", None, ["", "f"], {"H2": "7"}), (["d"], ["r"], ["i"], "m", ["c"], None, {})]
    first, second = committee.with_fallbacks(spark.createDataFrame(rows, schema)).select("drivers", "risks", "invalidations").collect()
    assert first.drivers == ["m"] and first.risks == ["f"] and first.invalidations[:2] == ["H1 : invalidation à null", "H2 : invalidation à 7"]
    assert tuple(second) == (["d"], ["r"], ["i"])


def test_the_sweep_raises_one_alert_for_a_row(spark):
    waiting = spark.createDataFrame([("a", "t", 80.0), ("b", "t", 95.0), ("c", "t", 79.9), ("d", "t", 90.0), ("d", "t", 90.0)], "id string, title string, news_score double")
    active = spark.createDataFrame([("notify-stuck:b", "acknowledged"), ("notify-stuck:a", "resolved")], "dedup_key string, status string")
    found = news.sweep_alerts(waiting, waiting.where("id = 'none'"), active)
    assert sorted(r.news_id for r in found.collect()) == ["a", "d"]
    assert news.sweep_alerts(waiting, waiting, active).isEmpty()


def test_the_sql_function_is_null_for_a_null(spark):
    sql.register(spark)
    row = spark.sql("select fn_news_score(100, 95, 80, 50, 70) as a, fn_news_score(null, 95, 80, 50, 70) as b").first()
    assert float(row.a) == 81.5 and row.b is None


def test_weights_must_sum_to_one(monkeypatch):
    monkeypatch.setattr(V, "WEIGHTS", ("0.30", "0.20", "0.15", "0.20", "0.20"))
    with pytest.raises(ValueError):
        scoring.news_score(*[None] * 5)


def test_calibration_is_a_gap_and_drift_goes_both_ways(spark):
    """A model that promises too little is as far off as one that promises too much, and a jump up is a drift too."""
    from tidewell.operators import committee

    rows = spark.createDataFrame([("low", 0.2, 1), ("low", 0.2, 1), ("high", 0.9, 0), ("high", 0.7, 0)], "horizon string, p double, y int")
    assert {r.horizon: round(r.calibration, 9) for r in committee.scorecard(rows, "horizon").collect()} == {"low": 0.8, "high": 0.8}
    card = lambda *pairs: spark.createDataFrame(pairs, "k string, accuracy double")
    alerts = committee.drift_alerts(card(("up", 0.7), ("down", 0.3), ("small", 0.6)), card(("up", 0.5), ("down", 0.5), ("small", 0.5)), "k").collect()
    assert {(r.k, round(r.drift, 9)) for r in alerts} == {("up", 0.2), ("down", -0.2)}


def test_cards_are_written_once_a_day(spark):
    from tidewell.operators import committee

    rows = [("m", "d1", h, f"2024-01-0{d}", 0.5, y, True, False, True) for d, y in ((1, 1), (2, 0), (3, 0)) for h in ("H1", "H2")]
    outcomes = spark.createDataFrame(rows, "model_version string, evaluation_window string, horizon string, evaluation_date string, p double, y int, direction_ok boolean, timing_ok boolean, risk_ok boolean")
    cards = committee.daily_cards(outcomes)
    assert {(r.horizon, r.evaluation_date, r.model_drift) for r in cards.collect()} == {(h, f"2024-01-0{d}", drift) for h in ("H1", "H2", None) for d, drift in ((1, 0.0), (2, -1.0), (3, 0.0))}
    twice = committee.upsert_cards(cards, committee.daily_cards(outcomes.where("evaluation_date = '2024-01-01'").withColumn("y", F.lit(0))))
    assert twice.count() == 9 and {r.prediction_accuracy for r in twice.where("evaluation_date = '2024-01-01'").collect()} == {0.0}
    assert {r.evaluation_date for r in committee.degraded(cards).collect()} == {"2024-01-02"}


def test_quotes_as_texts(spark):
    from tidewell.operators import display

    x = spark.createDataFrame([(1, 2.5), (2, -0.25), (3, 0.0), (4, None), (5, float("nan")), (6, float("inf")), (7, 1e-10)], "i int, x double")
    got = {r.i: (r.a, r.b, r.c) for r in x.select("i", display.shown(F.col("x"), 1).alias("a"), display.shown_signed(F.col("x")).alias("b"), display.moves(F.col("x")).alias("c")).collect()}
    none = ("N/A", "N/A", "flat")
    assert got == {1: ("2.5", "+2.50", "up"), 2: ("-0.3", "-0.25", "down"), 3: ("0.0", "0.00", "flat"), 4: none, 5: none, 6: none, 7: ("0.0", "+0.00", "flat")}


def test_integrity_probes_equal_their_sql_where_events_hold_zeros(spark, tmp_path):
    import duckdb

    rows = [(i, dt.datetime(2024, 1, 14, 23, 30) + dt.timedelta(minutes=i), 1, ("view", "click", "purchase")[i % 3], [0.0, -0.0, 5.0, None][i % 4]) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    theirs = dict(con.execute(market_queries.ORACLE_SQL["integrity_probes"]).fetchall())
    assert theirs["zero_close"] == 3
    assert {r.probe: r.n for r in market_queries.integrity_probes(spark, str(tmp_path)).collect()} == theirs
