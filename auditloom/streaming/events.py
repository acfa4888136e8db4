"""Structured Streaming over crawl events: live totals, once-only alerts, an adaptive limit for each host."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "session_id string, seq long, kind string, url string, host string, at timestamp, latency_ms double, failed boolean, retry_after_s double"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, per_trigger: int = 100) -> DataFrame:
    """A stream of event files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_totals(events: DataFrame) -> DataFrame:
    """Events of each kind so far in each session, for the update or complete mode; works on batches too."""
    return events.groupBy("session_id", "kind").agg(F.count("*").alias("events"), F.max("at").alias("last_at"))


def progress(events: DataFrame, planned: int) -> DataFrame:
    """Per session: pages done, percent of ``planned``, pages a second and seconds left."""
    done = events.where("kind = 'page_crawled'").groupBy("session_id").agg(F.count("*").alias("pages"), F.min("at").alias("began"), F.max("at").alias("last"))
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))) / 1e6
    rate = F.try_divide(F.col("pages").cast("double"), seconds)
    return done.select("session_id", "pages", F.round(F.least(F.col("pages") / planned * 100, F.lit(100.0)), 1).alias("percent"), F.round(rate, 2).alias("pages_per_second"),
                       F.round(F.try_divide(F.greatest(F.lit(planned) - F.col("pages"), F.lit(0)).cast("double"), rate), 1).alias("seconds_left"))


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: events of each kind in event-time windows, late ones up to ``late``."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count("*").alias("events"))


def new_alerts(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose (rank_check_id, kind, channel) isn't stored; equal ones once."""
    keys = ["rank_check_id", "kind", "channel"]
    return alerts.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def deliver_alerts(alerts: DataFrame, path: str, checkpoint: str, send: Callable[[DataFrame], None]) -> StreamingQuery:
    """Store each new alert first, then send it: one is sent at most once, also when a batch is run again."""
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        kind = df.schema
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        begun = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # any other error rises, and nothing is sent
        stored = spark.read.schema(kind).parquet(path) if begun else spark.createDataFrame([], kind)
        fresh = new_alerts(df, stored).persist()
        fresh.write.mode("append").parquet(path)
        send(fresh)
        fresh.unpersist()

    return alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HostPace:
    """How many requests a host may have under way: more while answers stay quick, half when they don't.

    Answers, timed or not, fill windows. The median of the first window is the measure: a later one of more
    than ``SLOW`` times it halves the limit, one of at most ``QUICK`` times it without a failure adds
    ``GROWTH``. A failure halves at once, unless it may be of a request that was under way at the last cut:
    until as many answers have come as there were requests then, failures only spoil their window. A wait
    that is asked for is heeded up to ``LONGEST_WAIT`` seconds from the answer on.
    """

    # Fixed values of the rule.
    QUICK, SLOW, GROWTH, LONGEST_WAIT = 1.5, 2.0, 4, 60.0

    def __init__(self, limit: int = 8, least: int = 4, most: int = 64, window: int = 50):
        self.least = max(1, min(least, limit))
        self.most, self.window = max(1, most), window
        self.limit = min(max(limit, self.least), self.most)
        self.measured, self.measure = False, None
        self.spared = 0  # answers still to come whose failures don't cut
        self.wait_until = 0.0
        self.times, self.answers, self.spoilt = [], 0, False

    def record(self, latency_ms: float | None, failed: bool = False, wait_s: float | None = None, at_s: float = 0.0) -> int:
        """The limit after one answer."""
        if wait_s is not None:
            self.wait_until = max(self.wait_until, at_s + min(wait_s, self.LONGEST_WAIT))
        spare, self.spared = self.spared > 0, max(0, self.spared - 1)
        if failed and not spare:
            return self._restart(cut=True)
        self.spoilt |= failed
        self.times += [] if latency_ms is None else [latency_ms]
        self.answers += 1
        return self.limit if self.answers < self.window else self._judge()

    def _judge(self) -> int:
        middle = median(self.times) if self.times else None
        if not self.measured:
            self.measured, self.measure = True, middle
            return self._restart()
        ratio = middle / self.measure if middle is not None and self.measure else None
        if ratio is not None and ratio > self.SLOW:
            return self._restart(cut=True)
        if not self.spoilt and (ratio is None or ratio <= self.QUICK):
            self.limit = min(self.limit + self.GROWTH, self.most)
        return self._restart()

    def _restart(self, cut: bool = False) -> int:
        if cut:
            self.spared, self.limit = self.limit, max(self.limit // 2, self.least)
        self.times, self.answers, self.spoilt = [], 0, False
        return self.limit

    def dump(self) -> tuple:
        """State as plain values."""
        return (self.limit, self.measured, self.measure, self.spared, self.wait_until, list(self.times), self.answers, self.spoilt)

    @classmethod
    def load(cls, state: tuple, **options: int) -> HostPace:
        """A controller in a dumped state."""
        c = cls(**options)
        c.limit, c.measured, c.measure, c.spared, c.wait_until, times, c.answers, c.spoilt = state
        c.times = list(times)
        return c


_STATE = "limit int, measured boolean, measure double, spared int, wait_until double, times array<double>, answers int, spoilt boolean"
_OUT = "host string, answers long, limit int, wait_until double"


def adaptive_limits(events: DataFrame) -> DataFrame:
    """A stream of ``(host, answers, limit, wait_until)``: each host's limit after every batch of its answers.

    State is a few numbers and less than one window of times a host; events of a batch are taken by ``seq``.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        c = HostPace.load(state.get) if state.exists else HostPace()
        rows = pd.concat(list(frames)).sort_values("seq")
        known = lambda x: None if pd.isna(x) else float(x)
        for r in rows.itertuples():
            c.record(known(r.latency_ms), bool(r.failed) if not pd.isna(r.failed) else False, known(r.retry_after_s), 0.0 if pd.isna(r.at) else r.at.timestamp())
        state.update(c.dump())
        yield pd.DataFrame({"host": [key[0]], "answers": [len(rows)], "limit": [c.limit], "wait_until": [c.wait_until]})

    return events.groupBy("host").applyInPandasWithState(step, _OUT, _STATE, "update", "NoTimeout")
