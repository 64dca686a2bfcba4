"""Structured Streaming over the trace: windows, sessions, duplicate suppression, session state.

Event time is a timestamp (files hold timestamp_ntz, which watermarks don't take). Late rows are
dropped after WATERMARK; append mode gives a window or session once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# The states of a session.
STATES = ("CREATED", "CONNECTING", "READY", "LISTENING", "USER_SPEAKING", "PROCESSING", "TOOL_EXECUTION", "AGENT_SPEAKING", "INTERRUPTED", "WAITING_FOR_CONFIRMATION", "ESCALATING", "ENDED", "FAILED")


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet*") -> DataFrame:
    """Events of a folder as a stream, with event time as timestamp. The table is a file or a folder of files."""
    s = spark.readStream.schema(EVENTS).parquet(f"{path.rstrip('/')}/{glob}")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", WATERMARK).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


def sliding_counts(stream: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    w = F.window("ts", width, slide)
    return stream.withWatermark("ts", WATERMARK).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "event_type", "n")


def rate_windows(stream: DataFrame, most: int, width: str = "1 hour") -> DataFrame:
    """Keys with more than most events in a window, once the watermark has passed it."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", WATERMARK).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "user_id", "n").where(F.col("n") > most)


def cancelled_requests(requests: DataFrame, cancels: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Stream-stream join: requests with each cancellation of the same user that follows within a time.
    Watermarks on both sides and the bound let Spark drop old state."""
    r = requests.withWatermark("ts", WATERMARK).select(F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), F.col("event_id").alias("request_id"))
    c = cancels.withWatermark("ts", WATERMARK).select(F.col("user_id").alias("c_user"), F.col("ts").alias("c_ts"), F.col("event_id").alias("cancel_id"))
    return r.join(c, (F.col("r_user") == F.col("c_user")) & (F.col("c_ts") > F.col("r_ts")) & (F.col("c_ts") <= F.col("r_ts") + F.expr(f"INTERVAL {within}"))).select("request_id", "cancel_id")


TURNS = "conv_id long, turn long, role string, text string"


def transcript_stream(spark: SparkSession, path: str, glob: str = "conversations.parquet*") -> DataFrame:
    """Partial and final transcripts of a folder as a stream: a later turn of a conversation's role
    replaces the ones before it."""
    return spark.readStream.schema(TURNS).parquet(f"{path.rstrip('/')}/{glob}")


def merged_transcripts(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a transcript stream to its end: conv_id, role, the last text and the number of revisions. The
    stream keeps one row a key; every batch appends the keys it changed, and the latest change counts."""
    latest = stream.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"), F.count("*").alias("revisions"))
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    latest.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    changes = stream.sparkSession.read.schema(latest.schema).parquet(path)
    return changes.groupBy("conv_id", "role").agg(F.max_by("text", "revisions").alias("text"), F.max("revisions").alias("revisions"))


def in_order(rows: Iterator[pd.DataFrame], by: tuple[str, ...], *more: str) -> list[tuple]:
    """The rows of a key as tuples (by, more), sorted by ``by``, nulls last. Most keys have few rows: plain tuples
    take a fraction of the time of a frame of their own."""
    found = [r for part in rows for r in zip(*(part[c].tolist() for c in (*by, *more)), strict=True)]
    gone = lambda x: x is None or x != x
    return sorted(found, key=lambda r: [(True, 0) if gone(x) else (False, x) for x in r[: len(by)]])


class Budget(StatefulProcessor):
    """A running sum by key: each event with what its key has spent, and whether that is over the cap. Fails
    closed: an event without an amount is denied. Rows of one key come in order of time within a batch."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent = self.spent.get()[0] if self.spent.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        amounts = batch["k"].to_numpy("float64", na_value=float("nan"))
        out = []
        for event_id, amount in zip(batch["event_id"], amounts, strict=True):
            known = amount == amount
            spent += int(amount) if known else 0
            out.append((key[0], int(event_id), spent, not known or spent > self.cap))
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "spent", "denied"])

    def close(self) -> None:
        pass


def budgets(stream: DataFrame, cap: int) -> DataFrame:
    """Needs the RocksDB state store provider. The stream has user_id, event_id, ts and k."""
    return stream.groupBy("user_id").transformWithStateInPandas(Budget(cap), outputStructType="user_id long, event_id long, spent long, denied boolean", outputMode="Append", timeMode="None")


class SessionClock(StatefulProcessor):
    """Ends sessions by inactivity and, where there is one, by maximum duration. Times are compared in
    microseconds, as the events have them. Events and the sessions that are kept are merged in order of time, so
    an event of a later batch may extend or join sessions before it. A session leaves once the watermark has passed
    its last event plus the gap, also one that later events follow; one of maximum duration leaves at once. A
    key has one timer, at the earliest end, and no state without a session."""

    def __init__(self, gap_us: int, most_us: int | None):
        self.gap, self.most = gap_us, most_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "sessions array<struct<start long, last long, events long>>")

    def _due(self, session: tuple) -> int:
        return (session[1] + self.gap) // 1000

    def _frame(self, key, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], start // 1000, last // 1000, n, reason, last) for start, last, n, reason in ended], columns=["user_id", "start_ms", "end_ms", "n_events", "reason", "end_us"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.sessions.get()
        before = [tuple(s) for s in known[0]] if known else []
        events = [(us, us, 1) for part in rows for us in part["us"].tolist()]
        kept, ended = [], []
        for start, last, n in sorted(before + events):
            if kept and start - kept[-1][1] < self.gap:
                if self.most is None or start - kept[-1][0] < self.most:
                    kept[-1] = (kept[-1][0], max(kept[-1][1], last), kept[-1][2] + n)
                    continue
                ended.append((*kept.pop(), "duration"))
            kept.append((start, last, n))
        self.sessions.update((kept,))
        if not before or self._due(before[0]) != self._due(kept[0]):
            if before:
                self.handle.deleteTimer(self._due(before[0]))
            self.handle.registerTimer(self._due(kept[0]))
        if ended:
            yield self._frame(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, kept = timerValues.getCurrentWatermarkInMs(), [tuple(s) for s in self.sessions.get()[0]]
        open_ = [s for s in kept if self._due(s) > mark]
        if open_:
            self.sessions.update((open_,))
            self.handle.registerTimer(self._due(open_[0]))
        else:
            self.sessions.clear()
        yield self._frame(key, [(*s, "inactivity") for s in kept[: len(kept) - len(open_)]])

    def close(self) -> None:
        pass


class VoiceMachine(StatefulProcessor):
    """All 13 states of a voice session, from stage events. A session starts CREATED, CONNECTING, READY; each
    stage leads to the state that STATE_OF names, or to none; a tool that fails again in a session leads to
    ESCALATING. Silence of ``gap_ms`` ends a session, by the next event or by a timer, and its state goes.
    Emits each change of state."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string, last long, turn long, failures int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.session.get()
        state, last, turn, failures = known or (None, None, None, 0)
        out = []
        for at_ms, turn_id, _, stage, event_type in in_order(rows, ("at_ms", "turn_id", "no"), "stage", "event_type"):
            if state is not None and at_ms - last >= self.gap:
                out.append((key[0], turn, "SESSION", state, "ENDED"))
                state = None
            if state is None:
                out += [(key[0], turn_id, "SESSION", "CREATED", "CONNECTING"), (key[0], turn_id, "SESSION", "CONNECTING", "READY")]
                state, failures = "READY", 0
            after = "WAITING_FOR_CONFIRMATION" if stage == "RESPONSE_READY" and event_type == "purchase" else STATE_OF.get(stage, state)
            if stage == "TOOL_FAILED":
                failures += 1
                after = "ESCALATING" if failures > 1 else "FAILED"
            if after != state:
                out.append((key[0], turn_id, stage, state, after))
            state, last, turn = after, int(at_ms), int(turn_id)
        for timer in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(timer)
        self.session.update((state, last, turn, failures))
        self.handle.registerTimer(last + self.gap)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "turn_id", "stage", "from_state", "to_state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, _, turn, _ = self.session.get()
        self.session.clear()
        yield pd.DataFrame([(key[0], turn, "SESSION", state, "ENDED")], columns=["user_id", "turn_id", "stage", "from_state", "to_state"])

    def close(self) -> None:
        pass


# The state that a stage leads to.
STATE_OF = {
    "USER_SPEECH_STARTED": "USER_SPEAKING",
    "USER_SPEECH_ENDED": "PROCESSING",
    "TOOL_STARTED": "TOOL_EXECUTION",
    "TOOL_COMPLETED": "PROCESSING",
    "TTS_FIRST_AUDIO": "AGENT_SPEAKING",
    "INTERRUPTION_DETECTED": "INTERRUPTED",
    "TTS_CANCELLED": "LISTENING",
    "TURN_COMPLETED": "LISTENING",
}


def voice_states(stages: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """stages: user_id, turn_id, ts, event_type, no, stage, at_ms. Needs the RocksDB provider."""
    return stages.withWatermark("ts", WATERMARK).groupBy("user_id").transformWithStateInPandas(
        VoiceMachine(gap_minutes * 60_000), outputStructType="user_id long, turn_id long, stage string, from_state string, to_state string", outputMode="Append", timeMode="EventTime"
    )


def timed_sessions(stream: DataFrame, gap_minutes: int = 30, most_minutes: int | None = 480) -> DataFrame:
    """Ended sessions: user_id, start_ms, end_ms, n_events, reason, end_us; of any duration if most_minutes is None. The
    watermark is in whole milliseconds, so a session that ends within the watermark's millisecond is among them.
    Needs the RocksDB provider."""
    timed = stream.withWatermark("ts", WATERMARK).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    clock = SessionClock(gap_minutes * 60_000_000, None if most_minutes is None else most_minutes * 60_000_000)
    return timed.groupBy("user_id").transformWithStateInPandas(clock, outputStructType="user_id long, start_ms long, end_ms long, n_events long, reason string, end_us long", outputMode="Append", timeMode="EventTime")


def session_windows(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity. Bounds are the first and last event's times, as aggregates: nothing
    downstream may filter on the window itself."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", WATERMARK).groupBy("user_id", w).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events")).drop("session_window")


def without_repeats(stream: DataFrame, *keys: str) -> DataFrame:
    """Repeated tool requests within the watermark are dropped."""
    return stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(list(keys))


class SessionMachine(StatefulProcessor):
    """A session's state by key. A protected request opens a pending confirmation, which an
    affirmation within ``expiry`` turns executes, a cancellation or an interruption clears, and
    further turns expire. Emits each change of state. A session that starts from a ``snapshot`` goes on
    from there."""

    def __init__(self, expiry: int = 3):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "state string, turn int, pending string, requested int")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        state, turn, pending, requested = (initialState[c].tolist()[0] for c in ("state", "turn", "pending", "requested"))
        self.state.update((state, int(turn), None if pd.isna(pending) else pending, None if pd.isna(requested) else int(requested)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, turn, pending, requested = self.state.get() or ("READY", 0, None, None)
        out = []
        for _, event_id, event_type in in_order(rows, ("ts", "event_id"), "event_type"):
            turn += 1
            action = None
            if pending is not None and turn - requested > self.expiry:
                pending, requested, action = None, None, "expired"
            before = state
            if event_type == "purchase":
                pending, requested, state = "create_dispute", turn, "WAITING_FOR_CONFIRMATION"
            elif event_type == "click" and pending is not None:
                action, state, pending, requested = f"executed {pending}", "TOOL_EXECUTION", None, None
            elif event_type == "error":
                action, state, pending, requested = ("cancelled" if pending is not None else action), "INTERRUPTED", None, None
            elif event_type == "signup":
                state = "LISTENING"
            elif pending is None:
                state = "PROCESSING"
            if state != before or action:
                out.append((key[0], int(event_id), before, state, action))
        self.state.update((state, turn, pending, requested))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "from_state", "to_state", "action"])

    def close(self) -> None:
        pass


CHANGES = "user_id long, event_id long, from_state string, to_state string, action string"


def state_machine(stream: DataFrame, expiry: int = 3, start: DataFrame | None = None) -> DataFrame:
    """Each change of state of each user; from where ``start``, a snapshot, has them, if given. Needs the
    RocksDB state store provider."""
    begun = None if start is None else start.groupBy("user_id")
    return stream.groupBy("user_id").transformWithStateInPandas(SessionMachine(expiry), outputStructType=CHANGES, outputMode="Append", timeMode="None", initialState=begun)


def snapshot(trace: DataFrame, changes: DataFrame, cut: Column, expiry: int = 3) -> DataFrame:
    """Where the machine stood after the events of a stored trace for which ``cut`` holds: user_id, state,
    turn, pending, requested. trace: user_id, event_id, event_type, turn (from 1 by user); cut holds of the
    first turns of each user, all or none too (users without any aren't in the snapshot). changes: what the
    machine recorded. The state is that of the latest change; a request is pending if nothing has closed it
    since and it hasn't expired."""
    kept = trace.where(cut)
    c = changes.select(F.col("user_id").alias("_user"), F.col("event_id").alias("_event"), "to_state")
    moved = kept.join(c, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("event_id").eqNullSafe(F.col("_event")), "left")
    latest = lambda *events: F.max(F.when(F.col("event_type").isin(*events), F.col("turn")))
    at = moved.groupBy("user_id").agg(F.max("turn").alias("turn"), F.max_by("to_state", F.when(F.col("to_state").isNotNull(), F.col("turn"))).alias("state"), latest("purchase").alias("asked"), latest("click", "error").alias("closed"))
    is_open = (F.col("asked") > F.coalesce("closed", F.lit(0))) & (F.col("turn") - F.col("asked") <= expiry)
    return at.select("user_id", F.coalesce("state", F.lit("READY")).alias("state"), F.col("turn").cast("int").alias("turn"), F.when(is_open, "create_dispute").alias("pending"), F.when(is_open, F.col("asked")).cast("int").alias("requested"))


def compared(replayed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Changes of a replay and of the record, one row for both where they are equal in every column:
    the columns of a change, in_replay and in_record."""
    both = replayed.withColumn("r", F.lit(1)).unionByName(recorded.withColumn("r", F.lit(2)))
    return both.groupBy(*replayed.columns).agg(F.max(F.col("r") == 1).alias("in_replay"), F.max(F.col("r") == 2).alias("in_record"))


class PendingConfirmations(StatefulProcessor):
    """The open confirmation requests of a session, one per resource. Rows: ms, event_id, role (request,
    answer, interruption or other), resource.

    A request opens. An answer for its resource executes it; an interruption cancels all that are open;
    another request for its resource supersedes it. It expires after ``turns`` further events of its session,
    or ``ttl_ms`` in event time, by the next event or by a timer. An answer that finds no open request
    (late, repeated or for something else) is unmatched. The turn counter goes with the last open request,
    so a session without one leaves no state."""

    def __init__(self, turns: int, ttl_ms: int):
        self.turns, self.ttl = turns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "resource long", "request_id long, turn long, ms long")
        self.turn = handle.getValueState("turn", "turn long")

    def _requests(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}

    def _settle(self, before: dict, after: dict, turn: int) -> None:
        """Write what changed; a timer for each time at which a request that is open now expires."""
        for resource in before.keys() - after.keys():
            self.open.removeKey((resource,))
        for resource, request in after.items():
            if before.get(resource) != request:
                self.open.updateValue((resource,), request)
        wanted, have = {ms + self.ttl for _, _, ms in after.values()}, set(self.handle.listTimers()) if before else set()
        for ms in have - wanted:
            self.handle.deleteTimer(ms)
        for ms in wanted - have:
            self.handle.registerTimer(ms)
        if after:
            self.turn.update((turn,))
        elif before:
            self.turn.clear()
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.turn.get()  # there as long as a request is open
        before = self._requests() if known else {}
        open_, turn, out = dict(before), known[0] if known else 0, []
        for ms, event, role, resource in in_order(rows, ("ms", "event_id"), "role", "resource"):
            turn += 1
            ms, event, resource = int(ms), int(event), int(resource)
            for name, (request, asked, at) in sorted(open_.items()):
                if turn - asked > self.turns or ms > at + self.ttl:
                    out.append((key[0], request, None, "expired"))
                    del open_[name]
            if role == "interruption":
                out += [(key[0], request, event, "cancelled") for request, _, _ in open_.values()]
                open_ = {}
            elif role in ("request", "answer"):
                found = open_.pop(resource, None)
                if found or role == "answer":
                    out.append((key[0], found[0] if found else None, event, "unmatched" if not found else "executed" if role == "answer" else "superseded"))
                if role == "request":
                    open_[resource] = (event, turn, ms)
        self._settle(before, open_, turn)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "request_id", "event_id", "outcome"]).astype({"request_id": "Int64", "event_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, before = expiredTimerInfo.getExpiryTimeInMs(), self._requests()
        gone = {k: v for k, v in before.items() if v[2] + self.ttl <= now}
        self._settle(before, {k: v for k, v in before.items() if k not in gone}, self.turn.get()[0] if self.turn.exists() else 0)
        yield pd.DataFrame([(key[0], request, None, "expired") for request, _, _ in gone.values()], columns=["user_id", "request_id", "event_id", "outcome"]).astype({"request_id": "Int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


def pending_confirmations(stream: DataFrame, turns: int = 3, ttl_minutes: int = 120) -> DataFrame:
    """stream: user_id, event_id, ts, role, resource. One row per request that is no longer open, with the
    event that closed it, and per unmatched answer. Needs the RocksDB provider."""
    timed = stream.withWatermark("ts", WATERMARK).select("user_id", "event_id", "ts", "role", "resource", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("user_id").transformWithStateInPandas(PendingConfirmations(turns, ttl_minutes * 60_000), outputStructType="user_id long, request_id long, event_id long, outcome string", outputMode="Append", timeMode="EventTime")


class Utterances(StatefulProcessor):
    """Partial and final transcripts of an utterance. Rows: ms, seq, text, final. A partial with a greater
    seq replaces the one before; the final row closes the utterance with its own text, whatever came before
    it. Partials that come after it are dropped until a timer, ``timeout_ms`` after its latest row, forgets
    the utterance. One without a final row is closed by that timer with its latest partial. Rows that come
    together are read by seq, the final one last. Emits text, rows (read until then) and closed_by (final
    or timeout)."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "seq long, text string, rows long, ms long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, text, n, latest, closed = (known := self.latest.get()) or (None, None, 0, None, False)
        out = []
        for final, order, ms, said in in_order(rows, ("final", "seq"), "ms", "text"):
            latest = int(ms) if latest is None else max(latest, int(ms))
            if closed:
                continue
            n += 1
            if final:
                out.append((*key, said, n, "final"))
                closed, text = True, None
            elif seq is None or order > seq:
                seq, text = int(order), said
        for timer in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(timer)
        self.latest.update((seq, text, n, latest, closed))
        self.handle.registerTimer(latest + self.timeout)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "utterance", "text", "rows", "closed_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, text, n, _, closed = self.latest.get()
        self.latest.clear()
        if not closed:
            yield pd.DataFrame([(*key, text, n, "timeout")], columns=["conv_id", "utterance", "text", "rows", "closed_by"])

    def close(self) -> None:
        pass


def utterances(stream: DataFrame, timeout_minutes: int = 30) -> DataFrame:
    """stream: conv_id, utterance, ts, seq, text, final. One row per utterance that is closed. Needs the
    RocksDB provider."""
    timed = stream.withWatermark("ts", WATERMARK).select("conv_id", "utterance", "ts", "seq", "text", "final", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("conv_id", "utterance").transformWithStateInPandas(Utterances(timeout_minutes * 60_000), outputStructType="conv_id long, utterance long, text string, rows long, closed_by string", outputMode="Append", timeMode="EventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, append to Parquet, and read the result."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
