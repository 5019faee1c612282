"""News sources as streams: offsets are times, a batch asks for the window since the last one with a look-back, and a missing key disables a source.

spark.readStream.format("news_pull").option("source", ...).load() gives rows of (source, window_from, window_to, state, payload, error),
state being ok, failed or disabled. Windows overlap by the look-back, so what comes late is still seen; readers drop repetitions by key
(`streams.dedup`, `state.unseen`). A restart goes on from the checkpointed time, whatever passed meanwhile.
"""

from __future__ import annotations

import datetime as dt
import os
import time
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import values as V
from . import http


@dataclass(frozen=True)
class Request:
    url: str
    headers: dict[str, str]
    timeout: float


def iso(seconds: float) -> str:
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def request(source: str, begin: float, end: float, base: str | None = None, key: str | None = None) -> Request | None:
    """What to ask the source for the window; None where it needs a key and there is none: it is disabled, which is no failure.

    `feed` takes a span back from now, so it is asked for the window's whole minutes; `search` takes the window's start, and its key
    in a header, never in the address, which logs may hold.
    """
    settings = V.NEWS_PULLS[source]
    headers = {"accept": "application/json", "user-agent": V.AGENT}
    if settings["key"]:
        if not key:
            return None
        headers["X-Api-Key"] = key
    fields = dict(settings["fields"])
    if settings["window"] == "timespan":
        fields["timespan"] = f"{max(1, -(-int(end - begin) // 60))}min"
    else:
        fields[settings["window"]] = iso(begin)
    return Request(f"{base or settings['base']}?{urllib.parse.urlencode(fields)}", headers, settings["timeout"])


def pull(source: str, begin: float, end: float, base: str | None, key: str | None, retries: int = 3, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[str, str | None, str | None]:
    """(state, payload, error) of one request."""
    asked = request(source, begin, end, base, key)
    if asked is None:
        return "disabled", None, None
    target = urllib.request.Request(asked.url, headers=asked.headers)
    body, error = http.fetch(target, asked.timeout, retries, opener=opener, sleep=sleep)
    return ("failed" if body is None else "ok"), body, error


class NewsPull(DataSource):
    """Options: source (feed, search), base (another address), key or key_env (a name in the workers' environment), lookback_min, retries, start and now (seconds; for tests and backfills)."""

    @classmethod
    def name(cls) -> str:
        return "news_pull"

    def schema(self) -> str:
        return "source string, window_from timestamp, window_to timestamp, state string, payload string, error string"

    def streamReader(self, schema):
        return NewsPullReader(self.options)


class NewsPullReader(DataSourceStreamReader):
    def __init__(self, options):
        self.source, self.base = options["source"], options.get("base")
        self.key, self.key_env = options.get("key"), options.get("key_env")
        self.lookback_s, self.retries = 60 * float(options.get("lookback_min", V.NEWS_PULLS[self.source]["lookback_min"])), int(options.get("retries", 3))
        self.start, self.now = float(options.get("start", time.time())), options.get("now")

    def initialOffset(self) -> dict:
        return {"until": self.start}

    def latestOffset(self) -> dict:
        return {"until": float(self.now) if self.now else time.time()}

    def partitions(self, start: dict, end: dict):
        return [InputPartition((start["until"], end["until"]))] if end["until"] > start["until"] else []

    def read(self, partition):
        begin, end = partition.value
        key = self.key or os.environ.get(self.key_env or "")
        at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
        yield (self.source, at(begin - self.lookback_s), at(end), *pull(self.source, begin - self.lookback_s, end, self.base, key, self.retries))

    def commit(self, end: dict) -> None:
        """Nothing is held between batches: the offset is the state."""
