"""A Python data source that pulls JSON replies over HTTP with retries; each URL is one partition and one row."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retry_after(header: str | None, now: float) -> float | None:
    """Seconds from a Retry-After header, a number or an HTTP date."""
    if not header:
        return None
    if header.strip().isdigit():
        return float(header)
    from email.utils import parsedate_to_datetime

    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except ValueError:
        return None


def retryable(status: int) -> bool:
    return status in (408, 429) or status >= 500


def backoff(attempt: int, base: float, ceiling: float, draw=random.random) -> float:
    """Full jitter below an exponential ceiling."""
    return draw() * min(base * 2**attempt, ceiling)


def fetch(url: str, timeout: float = 12, retries: int = 3, base: float = 0.4, ceiling: float = 8.0, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(body, error): retries what may pass, gives up at once on other client errors and on a Retry-After beyond the ceiling."""
    error = None
    for attempt in range(retries + 1):
        wait = None
        try:
            with opener(url, timeout=timeout) as reply:
                body = reply.read().decode()
                json.loads(body)
                return body, None
        except urllib.error.HTTPError as e:
            error, wait = f"http {e.code}", retry_after(e.headers.get("Retry-After") if e.headers else None, time.time())
            if not retryable(e.code) or (wait or 0) > ceiling:
                break
        except (OSError, ValueError) as e:
            error = type(e).__name__
        if attempt < retries:
            sleep(wait if wait is not None else backoff(attempt, base, ceiling))
    return None, error


class HttpJson(DataSource):
    """spark.read.format("http_json").option("urls", "a b c").load() -> url, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, payload string, error string"

    def reader(self, schema):
        return HttpJsonReader(self.options)


class HttpJsonReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.timeout, self.retries = options.get("urls", "").split(), float(options.get("timeout", 12)), int(options.get("retries", 3))

    def partitions(self):
        return [InputPartition(url) for url in self.urls]

    def read(self, partition):
        yield (partition.value, *fetch(partition.value, self.timeout, self.retries))
