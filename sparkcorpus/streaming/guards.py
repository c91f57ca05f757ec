"""Guards and sessions over event streams.  Event time must be a timestamp: cast TIMESTAMP_NTZ first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from sparkcorpus.config import Limits
from sparkcorpus.operators.chains import first_within


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


class Replays(StatefulProcessor):
    """Lets an event pass if none of its nonce passed within the time to live; what is refused does not prolong that."""

    def __init__(self, ts: str, columns: list[str], seconds: int):
        self.ts, self.columns, self.span = ts, columns, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.passed = handle, handle.getValueState("passed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.passed.get()[0] if self.passed.exists() else None
        frame = pd.concat(list(rows), ignore_index=True)
        at = frame[self.ts].astype("datetime64[us]").astype("int64")
        keep = []
        for i in frame.assign(__at=at).sort_values(["__at", *[c for c in self.columns if c != self.ts]]).index:
            if last is None or at[i] > last + self.span:
                last = int(at[i])
                keep.append(i)
        if keep:
            self.passed.update((last,))
            self.handle.registerTimer((last + self.span) // 1000 + 1)
        yield frame.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No event that still comes can be within the time to live."""
        if self.passed.exists() and self.passed.get()[0] + self.span < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.passed.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def replay_guard(df: DataFrame, nonce: str = "nonce", ts: str = "ts", key: str = "event_id", seconds: int = Limits().nonce_seconds) -> DataFrame:
    """(nonce, ts, key) of a stream's events that pass: the first of each nonce, then the first one later than its time to
    live, and so on; events of one time by key.  A nonce is forgotten when the watermark says that its time is over."""
    columns = [nonce, ts, key]
    rows = df.select(*columns).filter(F.col(nonce).isNotNull()).withWatermark(ts, f"{seconds} seconds")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return rows.groupBy(nonce).transformWithStateInPandas(Replays(ts, columns, seconds), kinds, "Append", "EventTime")


def replay_guard_batch(df: DataFrame, nonce: str, ts: str, key: str, seconds: int = Limits().nonce_seconds) -> DataFrame:
    """The same over a table, as chains of events that pass."""
    return first_within(df, nonce, F.col(ts), key, seconds)


def on_time(df: DataFrame, sent: Column, now: Column, seconds: int = Limits().clock_skew_seconds) -> DataFrame:
    return df.filter(F.abs(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(sent.cast("timestamp"))) <= seconds)


def lockouts(failures: DataFrame, who: str, ts: str = "ts", most: int = Limits().failures, seconds: int = Limits().failure_seconds) -> DataFrame:
    """Runs of failures, each within the time to live of the one before, that reach the limit."""
    rows = failures.groupBy(who, F.session_window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") >= most).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quiet_gaps(events: DataFrame, key: str, ts: str = "ts", seconds: int = Limits().quiet_seconds) -> DataFrame:
    """Busy stretches and when they fell quiet."""
    rows = events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("quiet_from"), "n")


def stage_latency(events: DataFrame, run: str, kind: str = "event_type", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Milliseconds from each event of a run to the next."""
    w = Window.partitionBy(run).orderBy(ts, key)
    ms = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    return events.withColumn("ms", ms)


def flushes(tokens: DataFrame, run: str = "run", seq: str = "seq", text: str = "text", least: int = Limits().flush_chars) -> DataFrame:
    """Token stream as the pieces that are sent: each holds `least` characters or more, the last what is left."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out, held = [], ""
        for t in frame.sort_values(seq)[text]:
            held += t
            if len(held) >= least:
                out.append(held)
                held = ""
        out += [held] * bool(held)
        return pd.DataFrame({run: [frame[run].iloc[0]] * len(out), "piece": range(1, len(out) + 1), "text": out})

    return tokens.groupBy(run).applyInPandas(fold, f"{run} {tokens.schema[run].dataType.simpleString()}, piece long, text string")


def throughput_bins(frames: DataFrame, run: str = "run", t: str = "t", size: str = "len", bins: int = 20) -> DataFrame:
    """Characters of each run in bins of equal time."""
    w = Window.partitionBy(run)
    lo, hi = F.min(t).over(w), F.max(t).over(w)
    place = F.least(F.floor((F.col(t) - lo) * bins / F.greatest(hi - lo, F.lit(1))), F.lit(bins - 1)).cast("int")
    return frames.withColumn("bin", place).groupBy(run, "bin").agg(F.sum(size).alias("chars"))


def time_at_share(frames: DataFrame, share: float, run: str = "run", t: str = "t", size: str = "len") -> DataFrame:
    """When each run had sent this share of its characters, between frames by linear interpolation."""
    w = Window.partitionBy(run).orderBy(t)
    rows = frames.withColumns({"__c": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum(size).over(Window.partitionBy(run))})
    rows = rows.withColumns({"__c0": F.coalesce(F.lag("__c").over(w), F.lit(0)), "__t0": F.coalesce(F.lag(t).over(w), F.col(t))})
    goal = F.col("__all") * share
    hit = rows.filter((F.col("__c0") < goal) & (F.col("__c") >= goal))
    return hit.select(run, (F.col("__t0") + (F.col(t) - F.col("__t0")) * (goal - F.col("__c0")) / F.col(size)).alias("t"))


class FailureCounter(StatefulProcessor):
    """Failures in a row, forgotten a while after the last one and on success; says when the limit is reached."""

    def __init__(self, most: int = Limits().failures, seconds: int = Limits().failure_seconds):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "n int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() or (0, 0)
        out = []
        for frame in rows:
            for r in frame.sort_values("ts").itertuples():
                now = int(r.ts.timestamp())
                n = 0 if r.ok or now - last > self.seconds else n
                n += not r.ok
                last = now
                if not r.ok and n >= self.most:
                    out.append((key[0], r.ts, n))
        self.state.update((n, last))
        yield pd.DataFrame(out, columns=["who", "ts", "n"])

    def close(self) -> None:
        pass


def count_failures(stream: DataFrame, most: int = Limits().failures, seconds: int = Limits().failure_seconds) -> DataFrame:
    """Locks (who, ts, n) of a stream (who, ts, ok)."""
    return stream.groupBy("who").transformWithStateInPandas(FailureCounter(most, seconds), "who string, ts timestamp, n int", "Append", "none")


class Sessions(StatefulProcessor):
    """Refresh tokens of a user: issue, rotate, revoke and revoke all; a token lives so many seconds."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "token string", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for r in frame.sort_values("ts").itertuples():
                now = int(r.ts.timestamp())
                live = self.tokens.exists() and self.tokens.containsKey((r.token,)) and self.tokens.getValue((r.token,))[0] >= now
                ok = live or r.action in ("issue", "revoke_all")
                if r.action in ("rotate", "revoke") and live:
                    self.tokens.removeKey((r.token,))
                if r.action == "revoke_all":
                    self.tokens.clear()
                if r.action == "issue":
                    self.tokens.updateValue((r.token,), (now + self.seconds,))
                if r.action == "rotate" and live:
                    self.tokens.updateValue((r.new_token,), (now + self.seconds,))
                out.append((key[0], r.ts, r.action, bool(ok)))
        yield pd.DataFrame(out, columns=["who", "ts", "action", "ok"])

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, seconds: int) -> DataFrame:
    """Verdicts on a stream (who, ts, action, token, new_token)."""
    return stream.groupBy("who").transformWithStateInPandas(Sessions(seconds), "who string, ts timestamp, action string, ok boolean", "Append", "none")


class Batches(StatefulProcessor):
    """Holds rows of a conversation until there are n, or until the first of them has waited for so many seconds."""

    def __init__(self, n: int, seconds: float, kinds: list[tuple[str, str]]):
        self.n, self.wait, self.kinds = n, int(seconds * 1000), kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{c} {k}" for c, k in self.kinds[1:]))
        self.mark = handle.getValueState("mark", "batch long, waiting long")

    def handed_on(self, key, rows: list[tuple], batch: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r, batch + i // self.n + 1) for i, r in enumerate(rows)], columns=[*[c for c, _ in self.kinds], "batch"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c for c, _ in self.kinds[1:]]
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        batch, waiting = self.mark.get() if self.mark.exists() else (0, 0)
        new = pd.concat(list(rows), ignore_index=True).sort_values(names[0])
        held += list(new[names].itertuples(index=False, name=None))
        full = len(held) - len(held) % self.n
        now, rest = held[:full], held[full:]
        if full and waiting:
            self.handle.deleteTimer(waiting)
            waiting = 0
        if rest and not waiting:
            waiting = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(waiting)
        self.held.put(rest) if rest else self.held.clear()
        self.mark.update((batch + full // self.n, waiting))
        yield self.handed_on(key, now, batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        batch, waiting = self.mark.get() if self.mark.exists() else (0, 0)
        if not rest or waiting != expiredTimerInfo.getExpiryTimeInMs():
            yield self.handed_on(key, [], batch)
            return
        self.held.clear()
        self.mark.update((batch + 1, 0))
        yield self.handed_on(key, rest, batch)

    def close(self) -> None:
        pass


def in_batches(stream: DataFrame, n: int, seconds: float, key: str = "conv_id", order: str = "id") -> DataFrame:
    """Rows of a stream with `batch`, the number of their batch within `key`: n rows in order, or fewer once the first of them has
    waited for `seconds`.  Rows wait in the state, so a query that stops and starts again hands on each row once."""
    names = [key, order, *[c for c in stream.columns if c not in (key, order)]]
    kinds = [(c, stream.schema[c].dataType.simpleString()) for c in names]
    schema = ", ".join(f"{c} {k}" for c, k in kinds) + ", batch long"
    return stream.select(*names).groupBy(key).transformWithStateInPandas(Batches(n, seconds, kinds), schema, "Append", "ProcessingTime")


def once(path: str):
    """A foreachBatch function that writes each micro-batch into a folder of its own, named by its number: one that is repeated after
    a failure replaces what it wrote before, so readers find each row once."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def single_flight(jobs: DataFrame, key: str, job: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, job): jobs that may start, in order of start; of one key none starts before the last one that did ends.

    Which of them start is a chain, so each key's jobs are folded in order, a sorted batch after the other.
    """
    kinds = [jobs.schema[c].dataType.simpleString() for c in (key, job)]
    rows = jobs.select(key, job, start, end).repartition(key).sortWithinPartitions(key, start, job)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, None
        for batch in batches:
            keep = []
            for k, a, b in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
                ok = k != last or until is None or a >= until
                last, until = k, b if ok else until
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], [key, job]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, f"{key} {kinds[0]}, {job} {kinds[1]}")
