"""Streams that need state per key: readiness, hold, correlation, live counts.

State holds what the lateness bound or the hold leaves open, and nothing else: what is settled is cleared, so a
stream that runs for months keeps the keys of its last minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _millis(us: int) -> int:
    """First whole millisecond that is not before ``us``."""
    return -(-us // 1000)


class Readiness(StatefulProcessor):
    """Emits a path once ``n`` observations with equal size and mtime have followed each other.

    Observations wait until the watermark has passed them and are judged in time order, whatever batch they came
    in; equal times go by size, then mtime. After a path was emitted only that fact stays, for ``forget_ms`` of
    event time, and further observations are ignored."""

    def __init__(self, n: int = 3, forget_ms: int = 86_400_000):
        self.n, self.forget_ms = n, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, size long, mtime long")
        self.run = handle.getValueState("run", "size long, mtime long, n long")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.until.exists():
            return
        for batch in rows:
            seen = batch[["at_us", "size", "mtime"]]
            self.waiting.appendList([tuple(map(int, r)) for r in seen.itertuples(index=False)])
            self.handle.registerTimer(_millis(int(seen["at_us"].min())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.until.exists():
            if self.until.get()[0] <= passed:
                self.until.clear()
            return
        waiting = np.array(sorted(self.waiting.get()), np.int64).reshape(-1, 3)
        due = waiting[waiting[:, 0] <= passed * 1000]
        later = waiting[len(due) :]
        if not len(due):
            return
        size, mtime, run = self.run.get() if self.run.exists() else (0, 0, 0)
        values, place = due[:, 1:], np.arange(len(due))
        changed = np.ones(len(due), bool)
        changed[1:] = (values[1:] != values[:-1]).any(axis=1)
        changed[0] = run == 0 or tuple(values[0]) != (size, mtime)
        begun = np.maximum.accumulate(np.where(changed, place, -1))
        runs = np.where(begun >= 0, place - begun + 1, run + place + 1)
        ready = np.flatnonzero(runs >= self.n)
        if len(ready):
            at_us = int(due[ready[0], 0])
            self.waiting.clear()
            self.run.clear()
            self.until.update((_millis(at_us) + self.forget_ms,))
            self.handle.registerTimer(_millis(at_us) + self.forget_ms)
            yield pd.DataFrame({"path": [key[0]], "ready_at": pd.to_datetime([at_us], unit="us")})
            return
        self.run.update((int(values[-1, 0]), int(values[-1, 1]), int(runs[-1])))
        if len(later):
            self.waiting.put([tuple(map(int, r)) for r in later])
            self.handle.registerTimer(_millis(int(later[0, 0])))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def readiness_stream(observations: DataFrame, n: int = 3, late: str = "0 seconds", forget_ms: int = 86_400_000) -> DataFrame:
    """Observations (path string, observed_at, size, mtime) → (path, ready_at), in whatever order they come within ``late``."""
    timed = observations.withWatermark("observed_at", late).withColumn("at_us", F.unix_micros("observed_at"))
    return timed.groupBy("path").transformWithStateInPandas(
        statefulProcessor=Readiness(n, forget_ms), outputStructType="path string, ready_at timestamp", outputMode="Append", timeMode="EventTime",
    )


SHARES = 512  # state per share of the keys; as many calls to the state store, however many keys a batch has


def _share(key: str) -> list[Column]:
    """Share of a key, and whether it is known: null keys are one key, as in any grouping."""
    return [F.pmod(F.xxhash64(key), F.lit(SHARES)).alias("share"), F.col(key).isNotNull().alias("known")]


def _read(rows) -> np.ndarray:
    """Rows of a binary state value."""
    return np.zeros((0, 2), np.int64) if rows is None else np.frombuffer(rows[0], np.int64).reshape(-1, 2)


def _write(state, rows: np.ndarray) -> None:
    if len(rows):
        state.update((rows.astype(np.int64).tobytes(),))
    else:
        state.clear()


class Hold(StatefulProcessor):
    """Holds a job for a fixed time from its first event, by the clock, and lets it go without any later event.

    A later event never restarts a hold; a released job is remembered for ``remember_ms`` and ignored meanwhile. A
    job none of whose first events has a time has nothing to wait for and goes at once, without a time.

    State belongs to a share of the jobs, as arrays: a call to the state store costs far more than a row."""

    NO_TIME = np.iinfo(np.int64).max

    def __init__(self, seconds: float = 30, remember_ms: int = 60_000):
        self.ms, self.remember_ms = int(seconds * 1000), remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")  # job, time taken
        self.gone = handle.getValueState("gone", "rows binary")  # job, time until which it is remembered

    def _due(self, held: np.ndarray) -> np.ndarray:
        return np.where(held[:, 1] == self.NO_TIME, 0, held[:, 1] + self.ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = pd.concat(list(rows)).groupby("job_id")["taken_ms"].min()
        new = np.column_stack([first.index.to_numpy(np.int64), first.to_numpy(np.int64)])
        held, gone = _read(self.held.get()), _read(self.gone.get())
        gone = gone[gone[:, 1] > timerValues.getCurrentProcessingTimeInMs()]
        new = new[~np.isin(new[:, 0], held[:, 0]) & ~np.isin(new[:, 0], gone[:, 0])]
        if len(new):
            _write(self.held, np.concatenate([held, new]))
            self.handle.registerTimer(max(1, int(self._due(new).min())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, gone = _read(self.held.get()), _read(self.gone.get())
        due = self._due(held) <= now
        kept, out, left = gone[gone[:, 1] > now], held[due], held[~due]
        if len(out):
            until = now + self.remember_ms
            _write(self.held, left)
            if len(left):
                self.handle.registerTimer(int(self._due(left).min()))
            if until > now:
                kept = np.concatenate([kept, np.column_stack([out[:, 0], np.full(len(out), until)])])
                self.handle.registerTimer(until)
        if len(out) or len(kept) < len(gone):
            _write(self.gone, kept)
        if len(out):
            released = pd.array(out[:, 1], "Int64")
            released[out[:, 1] == self.NO_TIME] = pd.NA
            jobs = pd.array(out[:, 0], "Int64")
            if not key[1]:
                jobs[:] = pd.NA
            yield pd.DataFrame({"job_id": jobs, "released_ms": released + self.ms})

    def close(self) -> None:
        pass


def hold_stream(jobs: DataFrame, seconds: float = 30, remember_ms: int = 60_000) -> DataFrame:
    """(job_id, taken_at) → (job_id, released_ms) once the clock passes the hold; run it with ``runner.run_until``."""
    taken = F.coalesce(F.unix_millis(F.col("taken_at").cast("timestamp")), F.lit(int(Hold.NO_TIME))).alias("taken_ms")
    timed = jobs.select(*_share("job_id"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job_id"), taken)
    return timed.groupBy("share", "known").transformWithStateInPandas(
        statefulProcessor=Hold(seconds, remember_ms), outputStructType="job_id long, released_ms long", outputMode="Append", timeMode="ProcessingTime",
    )


class Correlation(StatefulProcessor):
    """Gives each confirm or cancel the nearest notice of its key within ``reach_us``, before or after it.

    A message is answered when the watermark says that no notice can come any more. Of equally near notices the
    earlier counts, then the smaller id. Without one it is an orphan; with one that came later it is out of
    order. A notice stays while a message to come could reach it, so a share of the keys holds what arrives within
    twice the reach, and one row leaves per message, however many notices there are."""

    NOTICES, MESSAGES = ["business_key", "at_us", "id"], ["business_key", "at_us", "id", "kind"]

    def __init__(self, reach_us: int):
        self.reach_us = reach_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notices = handle.getListState("notices", "rows binary")  # Arrow streams of NOTICES
        self.messages = handle.getListState("messages", "rows binary")  # and of MESSAGES

    def _next(self, due_us: int) -> None:
        self.handle.registerTimer(_millis(due_us))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            notice = batch["kind"] == "notice"
            for state, found, names, reach in ((self.notices, batch[notice], self.NOTICES, 2), (self.messages, batch[~notice], self.MESSAGES, 1)):
                if len(found):
                    state.appendValue((_packed(found[names]),))
                    self._next(int(found["at_us"].min()) + reach * self.reach_us)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        notices, messages = _unpacked(self.notices.get(), self.NOTICES), _unpacked(self.messages.get(), self.MESSAGES)
        due = messages["at_us"] + self.reach_us <= passed
        kept = notices["at_us"] + 2 * self.reach_us > passed
        if due.any():
            yield self._answers(messages[due], notices.sort_values(self.NOTICES), bool(key[1]))
        for state, stays, rows, reach in ((self.messages, ~due, messages, 1), (self.notices, kept, notices, 2)):
            if stays.all():
                continue
            if stays.any():
                state.put([(_packed(rows[stays]),)])
                self._next(int(rows.loc[stays, "at_us"].min()) + reach * self.reach_us)
            else:
                state.clear()

    def _answers(self, due: pd.DataFrame, notices: pd.DataFrame, known: bool) -> pd.DataFrame:
        """Nearest notices of the messages ``due`` among ``notices``, which are in order."""
        keys, at = (np.unique(np.concatenate([due[c], notices[c]])) for c in ("business_key", "at_us"))
        place = lambda df: np.searchsorted(keys, df["business_key"]) * len(at) + np.searchsorted(at, df["at_us"])
        there, asked = place(notices), place(due)
        asked_at, asked_key = due["at_us"].to_numpy(), due["business_key"].to_numpy()
        best, gap = np.full(len(due), -1), np.full(len(due), self.reach_us + 1)
        notice_at, notice_key, ids = (notices[c].to_numpy() for c in ("at_us", "business_key", "id"))
        if len(there):
            after = np.searchsorted(there, asked, "right")
            first = np.searchsorted(there, there, "left")  # of notices at one time the smallest id stands first
            before = np.where(after > 0, first[np.maximum(after - 1, 0)], -1)
            for near in (before, after):
                row = np.clip(near, 0, len(there) - 1)
                ok = (near >= 0) & (near < len(there)) & (notice_key[row] == asked_key)
                d = np.where(ok, np.abs(asked_at - notice_at[row]), self.reach_us + 1)
                nearer = d < gap
                best, gap = np.where(nearer, row, best), np.where(nearer, d, gap)
        found = best >= 0
        notice, late = pd.array(np.zeros(len(due), np.int64), "Int64"), np.zeros(len(due), bool)
        notice[~found] = pd.NA
        if found.any():
            notice[found] = ids[best[found]]
            late[found] = notice_at[best[found]] > asked_at[found]
        key = pd.array(asked_key, "Int64")
        if not known:
            key[:] = pd.NA
        return pd.DataFrame(
            {
                "business_key": key, "message_id": due["id"].to_numpy(), "kind": due["kind"].to_numpy(),
                "notice_id": notice, "outcome": np.where(~found, "Orphan", np.where(late, "OutOfOrder", "InOrder")),
            }
        )

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(values: Iterator[tuple], names: list[str]) -> pd.DataFrame:
    found = [pa.ipc.open_stream(bytes(v[0])).read_pandas() for v in values]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n: np.zeros(0, object if n == "kind" else np.int64) for n in names})


def correlate_stream(events: DataFrame, reach_seconds: int, late: str) -> DataFrame:
    """(business_key long, kind in notice/confirm/cancel, id, at) → one row per message with its nearest notice and outcome.

    Events may come in any order within ``late``. State belongs to a share of the keys, as that of ``Hold``."""
    timed = events.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    shared = timed.select(*_share("business_key"), F.coalesce("business_key", F.lit(0)).alias("business_key"), "kind", "id", "at", "at_us")
    return shared.groupBy("share", "known").transformWithStateInPandas(
        statefulProcessor=Correlation(reach_seconds * 1_000_000),
        outputStructType="business_key long, message_id long, kind string, notice_id long, outcome string", outputMode="Append", timeMode="EventTime",
    )


def status_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts, to be written in update mode."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
