"""News sources as streams, against a server of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewell.sources import payloads, pulls
from tidewell.streaming import streams

T0 = 1_704_067_200.0  # 2024-01-01


@pytest.fixture
def server():
    """A source whose articles carry the times of the window that is asked for; `seen` has the requests, `fail` makes it answer 503."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            fields = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            server.seen.append((fields, dict(self.headers)))
            articles = [{"title": f"Gold moves again, part {i}", "url": f"https://www.example.org/{i}", "publishedAt": "2024-01-01T00:10:00Z", "seendate": "20240101T001000Z", "domain": "Example.org", "description": "d", "content": "c"} for i in (1, 2)]
            body = json.dumps({"status": "ok", "articles": articles + [{"title": "[Removed]", "publishedAt": "2024-01-01T00:10:00Z"}, {"title": None}]}).encode()
            self.send_response(503 if server.fail else 200)
            self.end_headers()
            self.wfile.write(b"{}" if server.fail else body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.seen, server.fail = [], False
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_requests():
    feed = pulls.request("feed", T0, T0 + 3601)
    asked = {k: v[0] for k, v in parse_qs(urlparse(feed.url).query).items()}
    assert asked["timespan"] == "61min" and asked["maxrecords"] == "250" and asked["sort"] == "datedesc" and "sourcelang:english" in asked["query"] and feed.timeout == 20
    assert pulls.request("search", T0, T0 + 60) is None and pulls.pull("search", T0, T0 + 60, None, "") == ("disabled", None, None)
    search = pulls.request("search", T0, T0 + 60, key="secret")
    assert "secret" not in search.url and search.headers["X-Api-Key"] == "secret" and parse_qs(urlparse(search.url).query)["from"] == ["2024-01-01T00:00:00.000Z"]
    assert len(parse_qs(urlparse(search.url).query)["q"][0]) <= 500


def run(spark, server, at, now, source, **options):
    spark.dataSource.register(pulls.NewsPull)
    reader = spark.readStream.format("news_pull").option("source", source).option("base", f"http://127.0.0.1:{server.server_port}/x").option("start", T0).option("now", now).option("retries", 0)
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load().writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(once=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def test_windows_go_on_after_a_restart(spark, server, tmp_path):
    run(spark, server, tmp_path, T0 + 600, "search", key="k", lookback_min=5)
    out = run(spark, server, tmp_path, T0 + 1800, "search", key="k", lookback_min=5)
    windows = sorted((r.window_from.timestamp() - T0, r.window_to.timestamp() - T0, r.state) for r in out.collect())
    assert windows == [(-300.0, 600.0, "ok"), (300.0, 1800.0, "ok")]
    assert [s[0]["from"] for s in server.seen] == ["2023-12-31T23:55:00.000Z", "2024-01-01T00:05:00.000Z"] and all(s[1]["X-Api-Key"] == "k" for s in server.seen)
    found = payloads.parse_articles(out)
    assert found.count() == 4 and found.dropDuplicates(["url"]).count() == 2 and found.first().content == "d c"


def test_a_source_without_key_is_disabled_and_one_that_fails_says_so(spark, server, tmp_path):
    assert [(r.state, r.payload, r.error) for r in run(spark, server, f"{tmp_path}/a", T0 + 600, "search").collect()] == [("disabled", None, None)] and not server.seen
    server.fail = True
    assert [(r.state, r.payload, r.error) for r in run(spark, server, f"{tmp_path}/b", T0 + 600, "feed").collect()] == [("failed", None, "http 503")]


def test_overlapping_windows_give_each_article_once(spark, server, tmp_path):
    for now in (T0 + 600, T0 + 1200):
        run(spark, server, tmp_path, now, "feed")
    landed = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/out").schema).parquet(f"{tmp_path}/out")
    once = streams.run_once(streams.dedup(payloads.parse_feed(landed), "url"), f"{tmp_path}/once", f"{tmp_path}/once-progress")
    assert sorted((r.title, r.domain, r.content) for r in once.collect()) == [(f"Gold moves again, part {i}", "example.org", None) for i in (1, 2)]


def test_a_feed_reply_by_itself(spark):
    reply = {"articles": [{"title": "A &amp; B", "url": "https://www.x.org/1", "seendate": "20240101T001000Z"}, {"title": "no time", "url": "u"}, {"title": "  ", "seendate": "20240101T001000Z"}]}
    rows = payloads.parse_feed(spark.createDataFrame([(json.dumps(reply),), ("not json",), (None,)], "payload string"))
    assert [(r.title, r.domain, str(r.ts)) for r in rows.select("title", "domain", F.date_format("ts", "HH:mm").alias("ts")).collect()] == [("A & B", "x.org", "00:10")]
