"""State by key that outlives a restart: last prices with a bounded set of seen rows, and the sweep that delivers news again.

Both run on transformWithState; its store must be RocksDB, which `rocksdb` sets for the queries that a block starts.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
NEVER = np.iinfo("int64").max


@contextlib.contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """Sets the store; with `partitions` state lies in that many at most. Each runs a Python worker in each batch, whether it has a group or not, so a query of few groups takes few."""
    own = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        own[PARTITIONS] = str(min(partitions, int(spark.conf.get(PARTITIONS))))
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Fresh(StatefulProcessor):
    """Passes rows (at, id, value) that the key has not seen. Seen are the newest `most` by (at, id), a list that goes `ttl_ms` after its last
    change (0: never); of a full list what is older than all of it is old too, so forgotten ids don't come back.

    With `ends` only the two newest of the new rows go on, and the oldest of all while it is the oldest so far.
    """

    def __init__(self, most: int, ttl_ms: int, ends: bool):
        self.most, self.ttl_ms, self.ends = most, ttl_ms, ends

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "at long, id long", self.ttl_ms or None)
        self.first = handle.getValueState("first", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {tuple(x) for x in self.seen.get()} if self.seen.exists() else set()
        floor = min(seen) if len(seen) >= self.most else None
        first = tuple(self.first.get()) if self.first.exists() else None
        new: dict[tuple, float] = {}
        oldest = None
        for part in rows:
            for at, i, value in zip(part["at"].tolist(), part["id"].tolist(), part["value"].tolist()):
                place = (at, i)
                if (first is None or place < first) and (oldest is None or place < oldest[0]):
                    oldest = (place, value)
                if place not in seen and (floor is None or place > floor):
                    new[place] = value
                    if self.ends and len(new) > 2 * self.most:  # what can't stay among the newest needs no memory
                        new = dict(sorted(new.items())[-self.most :])
        if oldest:
            self.first.update(oldest[0])
        if new:
            self.seen.put([tuple(x) for x in sorted(seen | new.keys())[-self.most :]])
        out = dict(sorted(new.items())[-2:]) | ({oldest[0]: oldest[1]} if oldest else {}) if self.ends else new
        if out:
            yield pd.DataFrame({"key": key[0], "part": key[1], "at": [p[0] for p in out], "id": [p[1] for p in out], "value": list(out.values())})

    def close(self) -> None:
        pass


class Prices(StatefulProcessor):
    """Keeps last, previous and session_open of a key by (at, id), and passes them with a growing `n` when they change."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "n long, " + ", ".join(f"{w}_at long, {w}_id long, {w} double" for w in ("last", "previous", "first")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = tuple(self.kept.get()) if self.kept.exists() else (0, *[None] * 9)
        held = {was[i : i + 2]: was[i + 2] for i in (1, 4, 7) if was[i] is not None}
        for part in rows:
            held |= {(at, i): v for at, i, v in zip(part["at"].tolist(), part["id"].tolist(), part["value"].tolist())}
        order = sorted(held)
        places = [order[-1], order[-2] if len(order) > 1 else None, order[0]]
        now = tuple(x for p in places for x in ((*p, held[p]) if p else (None, None, None)))
        if now != was[1:]:
            self.kept.update((was[0] + 1, *now))
            yield pd.DataFrame({"key": [key[0]], "n": [was[0] + 1], "value": [now[2]], "previous": [now[5]], "session_open": [now[8]]}).astype({"previous": "float64"})

    def close(self) -> None:
        pass


def placed(stream: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows of (key, ts, id, value) dealt over `parts` by id: a hot key's ids are known to several tasks, each id to one."""
    return stream.where("value is not null").select(F.col(key).alias("key"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.unix_micros("ts").alias("at"), "id", F.col("value").cast("double").alias("value"))


def ends(rows: DataFrame, key: str, most: int, oldest: bool) -> DataFrame:
    """Of each Arrow batch the newest `most` rows of a key, different by (at, id), and with `oldest` the oldest one. It keeps no state: rows that nothing
    after it could keep are not handed to Python's state one by one. Rows without a time or an id have no place and go.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch[key].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            at, i = batch["at"].to_numpy(), batch["id"].to_numpy()
            order = np.lexsort((-np.arange(len(i)), i, at, code))  # of one (at, id) the first to come stands last
            code, at, i = code[order], at[order], i[order]
            next_key = np.append(code[1:] != code[:-1], True)
            last = next_key | np.append((at[1:] != at[:-1]) | (i[1:] != i[:-1]), True)
            order, next_key = order[last], next_key[last]
            end = np.flatnonzero(next_key)
            sizes = np.diff(end, prepend=-1)
            behind = np.repeat(end, sizes) - np.arange(len(order))
            stays = behind < most
            if oldest:
                stays |= behind == np.repeat(sizes, sizes) - 1
            yield batch.take(pa.array(np.sort(order[stays])))

    return rows.where("at is not null and id is not null").mapInArrow(cut, rows.schema)


def fresh(stream: DataFrame, key: str, parts: int, most: int, ttl_hours: int, only_ends: bool) -> DataFrame:
    # state that ages needs a clock, and a query with a clock never runs out of batches: a trigger that ends takes ttl_hours=0
    mode = "ProcessingTime" if ttl_hours else "None"
    rows = placed(stream, key, parts)
    if only_ends:
        rows = ends(rows, "key", 2, True)
    return rows.groupBy("key", "part").transformWithStateInPandas(Fresh(most, ttl_hours * 3_600_000, only_ends), "key string, part int, at long, id long, value double", "Append", mode)


def unseen(stream: DataFrame, key: str = "symbol", parts: int = 16, most: int = 500, ttl_hours: int = 0) -> DataFrame:
    """Each row of (key, ts, id, value) once, though it is delivered again, in one batch or after a restart: key, part, at (microseconds), id, value.

    A key's seen rows go `ttl_hours` after their last change, in queries that run on a schedule; 0 keeps them. With `most` of 0 every row is
    remembered, a state each that only its repetitions touch, so that a batch costs what it holds; such rows don't age.
    """
    if not most:
        if ttl_hours:
            raise ValueError("rows age only in a bounded set: give most")
        return placed(stream, key, parts).dropDuplicates(["key", "at", "id"])
    return fresh(stream, key, parts, most, ttl_hours, False)


def prices(stream: DataFrame, key: str = "symbol", parts: int = 16, most: int = 500, ttl_hours: int = 0) -> DataFrame:
    """Changes of last, previous and session_open by key; `latest` reads the newest of each from where they are appended.

    A row that is delivered again changes nothing, late rows take their place. A hot key is cut to three rows an Arrow batch first, and to three a part and batch.
    """
    mode = "ProcessingTime" if ttl_hours else "None"
    return fresh(stream, key, parts, most, ttl_hours, True).groupBy("key").transformWithStateInPandas(Prices(), "key string, n long, value double, previous double, session_open double", "Append", mode)


def latest(changes: DataFrame, key: str = "symbol") -> DataFrame:
    return changes.groupBy(F.col("key").alias(key)).agg(F.max_by(F.struct("value", "previous", "session_open"), "n").alias("s")).select(key, "s.*")


class Newest(StatefulProcessor):
    """Keeps the newest `most` rows (at, id, row) of a key and passes those that enter; with `listing`, the whole list as a version `n` instead."""

    def __init__(self, most: int, listing: bool):
        self.most, self.listing = most, listing

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "at long, id long, row string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {(x[0], x[1]): x[2] for x in self.kept.get()} if self.kept.exists() else {}
        now = dict(before)
        for part in rows:
            now |= {(at, i): row for at, i, row in zip(part["at"].tolist(), part["id"].tolist(), part["row"].tolist()) if (at, i) not in now}
            now = dict(sorted(now.items(), reverse=True)[: self.most])
        if now.keys() == before.keys():
            return
        self.kept.put([(*place, row) for place, row in now.items()])
        if self.listing:
            n = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.version.update((n,))
            yield pd.DataFrame({"listing": key[0], "n": n, "place": range(1, len(now) + 1), "id": [p[1] for p in now], "at": [p[0] for p in now], "row": list(now.values())})
        else:
            entered = {p: row for p, row in now.items() if p not in before}
            yield pd.DataFrame({"listing": key[0], "at": [p[0] for p in entered], "id": [p[1] for p in entered], "row": list(entered.values())})

    def close(self) -> None:
        pass


def newest(stream: DataFrame, listing: str, columns: list[str], parts: int = 16, most: int = 60) -> DataFrame:
    """Versions of the listing of the newest `most` rows of (id, ts, columns): listing, n, place, id, at, row (the columns as JSON).

    Rows are cut to the newest of each Arrow batch, then of each part, before they meet, so a batch sends `most` rows a part at most. `newest_listing` reads the last version.
    """
    rows = stream.select(F.lit(listing).alias("listing"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.unix_micros("ts").alias("at"), "id", F.to_json(F.struct(*columns)).alias("row"))
    cut = ends(rows, "listing", most, False).groupBy("listing", "part").transformWithStateInPandas(Newest(most, False), "listing string, at long, id long, row string", "Append", "None")
    return cut.groupBy("listing").transformWithStateInPandas(Newest(most, True), "listing string, n long, place int, id long, at long, row string", "Append", "None")


def newest_listing(versions: DataFrame) -> DataFrame:
    last = versions.groupBy("listing").agg(F.max("n").alias("n"))
    return versions.join(last, ["listing", "n"]).drop("n")


#: News that is still delivered, packed.
OPEN = np.dtype([("id", "<i8"), ("due", "<i8"), ("attempts", "<i4"), ("score", "<f8")])


class Sweep(StatefulProcessor):
    """News of a part of all ids, delivered again until it is acknowledged: `grace_ms` after its time, then every `every_ms`, `most` times; then one alert
    for a score of `least` or more.

    Repeated news changes nothing, an acknowledgement ends it, whichever comes first. A part's open news is one packed value and its closed ids are
    another, with one timer at the first due time: state is opened once a part and batch, not once an id. Part -1 is the news without an id.
    """

    def __init__(self, grace_ms: int, every_ms: int, most: int, least: float):
        self.grace_ms, self.every_ms, self.most, self.least = grace_ms, every_ms, most, least

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")
        self.closed = handle.getValueState("closed", "ids binary")

    def held(self, state, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(bytes(state.get()[0]), kind) if state.exists() else np.empty(0, kind)

    def keep(self, news: np.ndarray, closed: np.ndarray) -> None:
        self.open.update((news.tobytes(),))
        self.closed.update((closed.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, gone = news, closed = self.held(self.open, OPEN), self.held(self.closed, np.dtype("<i8"))
        for part in rows:
            ack = (part["kind"] == "ack").to_numpy()
            closed = np.union1d(closed, part["id"].to_numpy()[ack])
            new = part[~ack].drop_duplicates("id")
            new = new[~np.isin(new["id"], news["id"]) & ~np.isin(new["id"], closed)]
            added = np.empty(len(new), OPEN)
            added["id"], added["due"], added["attempts"], added["score"] = new["id"], new["at_ms"] + self.grace_ms, 0, new["score"]
            news = np.concatenate([news[~np.isin(news["id"], closed)], added])
        if len(closed) > len(gone) or not np.array_equal(news["id"], before["id"]):
            self.keep(news, closed)
            was, due = before["due"].min(initial=NEVER), news["due"].min(initial=NEVER)
            if was != due:
                if was < NEVER:
                    self.handle.deleteTimer(int(was))
                if due < NEVER:
                    self.handle.registerTimer(int(due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        news, closed, now = self.held(self.open, OPEN).copy(), self.held(self.closed, np.dtype("<i8")), timerValues.getCurrentWatermarkInMs()
        ripe = np.flatnonzero(news["due"] <= now)
        for of in np.array_split(ripe, len(ripe) // 10_000 + 1):
            if len(of):
                yield self.made(key[0], news, of, now)
        done = news["attempts"] >= self.most
        self.keep(news[~done], np.union1d(closed, news["id"][done]))
        if not done.all():
            self.handle.registerTimer(int(news["due"][~done].min()))

    def made(self, part: int, news: np.ndarray, of: np.ndarray, now: int) -> pd.DataFrame:
        """The deliveries and alerts that `of` come to by `now`, and moves them on; a late watermark may have passed several of one."""
        was = news[of]
        n = (self.most - was["attempts"]).astype("<i8")
        if self.every_ms:
            n = np.minimum(n, (now - was["due"]) // self.every_ms + 1)
        news["attempts"][of] += n.astype("<i4")
        news["due"][of] += n * self.every_ms
        at = news[of]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        notify = pd.DataFrame({"id": np.repeat(was["id"], n), "kind": "notify", "attempt": np.repeat(was["attempts"], n) + step + 1, "at_ms": np.repeat(was["due"], n) + step * self.every_ms})
        at = at[(at["attempts"] >= self.most) & (at["score"] >= self.least)]
        out = pd.concat([notify, pd.DataFrame({"id": at["id"], "kind": "alert", "attempt": at["attempts"], "at_ms": at["due"] - self.every_ms})])
        return out if part >= 0 else out.assign(id=pd.array([None] * len(out), "Int64"))

    def close(self) -> None:
        pass


def sweep(stream: DataFrame, grace_s: int = 90, every_s: int = 300, most: int = 10, least: float = 80, late: str = "0 seconds", parts: int = 1024) -> DataFrame:
    """Deliveries to make (id, kind `notify`, attempt, at_ms) and alerts (kind `alert`) for a stream of (id, kind `news` or `ack`, ts, action, score).

    Time is event time: what is due by the watermark is made. Archived news is never delivered, nor news without a time. State lies in `parts` by id;
    the number is fixed with the first batch.
    """
    rows = stream.where("kind = 'ack' or action <> 'ARCHIVE_ONLY' and ts is not null").withWatermark("ts", late)
    part = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(parts))).cast("int")
    rows = rows.select(part.alias("part"), F.coalesce("id", F.lit(0)).alias("id"), "kind", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at_ms"), F.col("score").cast("double").alias("score"), "ts")
    return rows.groupBy("part").transformWithStateInPandas(Sweep(grace_s * 1000, every_s * 1000, most, least), "id long, kind string, attempt int, at_ms long", "Append", "EventTime")
