"""Keyed state over event time: survey cadence, bounded sessions, and stale runs.

Events may arrive in any order within the watermark. They wait in the state of their key until the watermark has passed them
and then count in the order of (time, event_id), so results do not depend on files or batches; what comes before the
watermark has passed it is not counted yet.

Keys are dealt to a fixed number of buckets, and a bucket is what Spark groups by: calls into Python and reads of the state store
cost milliseconds each, so there are as many as buckets and not as many as keys. The state of a bucket is one value, the states
of its keys and an Arrow batch of events that wait. Keys whose events have all counted and left nothing behind have no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Settings that a session needs for these operators.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Routes and hours between two questions, the life of a session in seconds, activations that a session
# and sessions that a user keeps, seconds after which a run without end is stale.
SURVEY_EVERY, SURVEY_HOURS = 12, 24
SESSION_SECONDS, MOST_ACTIVATIONS, MOST_SESSIONS = 24 * 3600, 12, 32
STALE_SECONDS = 7200


#: Buckets of keys (a stream that goes on must keep their number), and events of a bucket that are Python rows at once.
BUCKETS, STEPS = 2048, 100_000


class InOrder:
    """Hands the events of each key to ``step`` one by one in the order of time, once the watermark has passed them."""

    #: Columns of an event after micros and event_id.
    columns: dict[str, pa.DataType] = {}
    #: Columns of a key's state, as a schema, and the state before the first event.
    state = ""
    start: tuple = ()
    #: Names of the result's columns after the key.
    result: tuple[str, ...] = ()

    def __init__(self, key: str):
        self.key = key

    def step(self, state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
        """The state after an event, and rows of the result."""
        raise NotImplementedError

    def wake(self, state: tuple) -> int | None:
        """When the state ends without an event, in microseconds."""
        return None

    def passed(self, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        """The state once all events up to a time have counted, and rows of the result."""
        return state, []

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(dict(zip((self.key, *self.result), zip(*rows, strict=True), strict=True)))

    def __call__(self, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        schema = pa.schema({self.key: pa.int64(), "micros": pa.int64(), "event_id": pa.int64(), **self.columns})
        parts = [pa.RecordBatch.from_arrays([pa.array(b[f.name], f.type, from_pandas=True) for f in schema], schema=schema) for b in batches]
        waiting, held = group.get if group.exists else (None, [])
        if waiting:
            parts.append(pa.ipc.read_record_batch(pa.py_buffer(waiting), schema))
        events, states = pa.Table.from_batches(parts, schema), {key: tuple(state) for key, state in held}
        watermark = group.getCurrentWatermarkMs()
        before = pc.less(events["micros"], watermark * 1000)
        due, rest = events.filter(before), events.filter(pc.invert(before)).combine_chunks()
        if due.num_rows:
            due = due.sort_by([(name, "ascending") for name in schema.names])
        for at in range(0, due.num_rows, STEPS):
            out = []
            for key, *event in zip(*(c.to_pylist() for c in due.slice(at, STEPS).columns), strict=True):
                states[key], rows = self.step(states.get(key, self.start), event)
                out += [(key, *row) for row in rows]
            yield from self._rows(out)
        out = []
        for key, state in states.items():
            states[key], rows = self.passed(state, watermark * 1000 - 1)
            out += [(key, *row) for row in rows]
        yield from self._rows(out)
        held = [(key, state) for key, state in states.items() if state != self.start]
        if not rest.num_rows and not held:
            if group.exists:
                group.remove()
            return
        left = rest.to_batches()[0].serialize().to_pybytes() if rest.num_rows else None
        group.update((left, held))
        times = [pc.min(rest["micros"]).as_py() if rest.num_rows else None, *(self.wake(state) for _, state in held)]
        times = [t // 1000 for t in times if t is not None]
        if times:
            group.setTimeoutTimestamp(max(min(times), watermark + 1))


class _Survey(InOrder):
    columns, state, start, result = {"answered": pa.bool_()}, "count: bigint, last: bigint", (0, -1), ("micros",)

    def __init__(self, key: str, every: int, hours: int):
        super().__init__(key)
        self.every, self.wait = every, hours * 3_600_000_000

    def step(self, state, event):
        (count, last), (micros, _, answered) = state, event
        if answered:
            return self.start, []
        due = count + 1 >= self.every and (last < 0 or micros - last >= self.wait)
        return (count + 1, micros if due else last), [(micros,)] if due else []


class _Sessions(InOrder):
    """State: sessions, the one used last coming last: id, time of the last activation, names of activations, oldest first."""

    columns, state, start = {"session": pa.string(), "name": pa.string()}, "sessions: array<struct<id: string, at: bigint, names: array<string>>>", ([],)
    result = ("event_id", "session", "names", "live")

    def __init__(self, key: str, seconds: int, names: int, sessions: int):
        super().__init__(key)
        self.micros, self.names, self.sessions = seconds * 1_000_000, names, sessions

    def step(self, state, event):
        micros, event_id, session, name = event
        live = [(s[0], s[1], list(s[2])) for s in state[0] if micros - s[1] <= self.micros]
        own = next((s[2] for s in live if s[0] == session), [])
        own = ([n for n in own if n != name] + [name])[-self.names :]
        live = ([s for s in live if s[0] != session] + [(session, micros, own)])[-self.sessions :]
        return (live,), [(event_id, session, own, len(live))]


class _Stale(InOrder):
    """A run that starts waits for its end until its time is over; an event after that starts the next one. State: start, or -1."""

    columns, state, start, result = {"finished": pa.bool_()}, "started: bigint", (-1,), ("started", "stale")

    def __init__(self, key: str, seconds: int):
        super().__init__(key)
        self.micros = seconds * 1_000_000

    def passed(self, state, until):
        late = state[0] >= 0 and until - state[0] > self.micros
        return ((-1,), [(state[0], state[0] + self.micros)]) if late else (state, [])

    def wake(self, state):
        return state[0] + self.micros if state[0] >= 0 else None

    def step(self, state, event):
        micros, _, finished = event
        state, out = self.passed(state, micros)
        if finished:
            return (-1,), out
        return (micros,) if state[0] < 0 else state, out


def _run(events: DataFrame, key: str, columns: list, late: str, processor: InOrder, kind: str) -> DataFrame:
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = rows.select(bucket, F.col(key).cast("long"), "ts", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long"), *columns)

    def run(_, batches, group):
        yield from processor(batches, group)

    held = f"waiting binary, held array<struct<key: bigint, state: struct<{processor.state}>>>"
    return rows.groupBy("bucket").applyInPandasWithState(run, f"{key} long, {kind}", held, "append", GroupStateTimeout.EventTimeTimeout)


def survey_prompts(events: DataFrame, every: int = SURVEY_EVERY, hours: int = SURVEY_HOURS, late: str = "1 hour") -> DataFrame:
    """(user_id, ts): when a user is asked whether the help was useful.

    events: user_id, ts, event_id, answered. Each event that is no answer counts; from the ``every``-th on the user is asked,
    but again only ``hours`` after the last time. An answer begins anew: with the count, and with the wait.
    """
    out = _run(events, "user_id", ["answered"], late, _Survey("user_id", every, hours), "micros long")
    return out.select("user_id", F.timestamp_micros("micros").alias("ts"))


def bounded_sessions(
    events: DataFrame, seconds: int = SESSION_SECONDS, names: int = MOST_ACTIVATIONS, sessions: int = MOST_SESSIONS, late: str = "1 hour"
) -> DataFrame:
    """(user_id, event_id, session, names, live): after each activation what its session holds, and the user's live sessions.

    events: user_id, ts, event_id, session, name. A session ends ``seconds`` after its last activation, or when the user has
    used ``sessions`` others since; it holds the last ``names`` different names, the latest last.
    """
    processor = _Sessions("user_id", seconds, names, sessions)
    return _run(events, "user_id", ["session", "name"], late, processor, "event_id long, session string, names array<string>, live long")


def stale_runs(events: DataFrame, key: str, seconds: int = STALE_SECONDS, late: str = "1 hour") -> DataFrame:
    """(key, started, stale): runs that had no end for more than ``seconds``.

    events: key, ts, event_id, finished. The first event of a key that is no end starts a run; an end closes it, and so does its
    time. A run is reported once the watermark has passed its time, also where no further event of the key comes.
    """
    out = _run(events, key, ["finished"], late, _Stale(key, seconds), "started long, stale long")
    return out.select(key, *[F.timestamp_micros(c).alias(c) for c in ("started", "stale")])
