"""Structured Streaming jobs; each has a batch twin in ``operators.ordered`` or ``operators.governance``.

Event time is ``ts``; the watermark is an explicit argument.  Fold functions run
per key and micro-batch: a trigger limit on the source bounds what one task
holds, and the state itself is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskspark import fixed_values as fv


def debounce_stream(events: DataFrame, keys: list[str], gap: str = "400 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Batches of distinct paths, emitted once a workspace was quiet for ``gap``."""
    return (
        events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
        .select(*keys, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closed_at"), "paths", "events")
    )


def write_settled_stream(events: DataFrame, keys: list[str], quiet: str = "150 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row per path and burst, emitted when the burst is over."""
    return (
        events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("events"))
        .select(*keys, F.col("w.end").alias("settled_at"), "events")
    )


def webhook_dedupe_stream(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


# --- keyed folds -----------------------------------------------------------------------------------

CHUNK = 20_000


def _order(ts: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Places by (ts, tie), nulls last, ties of equal rows in order of arrival."""
    if ties.dtype == object:
        return pd.DataFrame({"ts": ts, "tie": ties}).sort_values(["ts", "tie"]).index.to_numpy()
    return np.lexsort((ties, np.where(np.isnat(ts), np.iinfo(np.int64).max, ts.view("i8"))))


def _fold(events: DataFrame, keys: list[str], tie: str, reads: list[str], out_fields: str, state_fields: str, step, expiry=None, late: str = "10 minutes") -> DataFrame:
    """applyInPandasWithState over a per-row ``step(state, microsecond, values of reads) -> (state, results)``; a state of None is not kept.

    Only the columns a step reads go to Python, where a key's rows of a micro-batch are held as arrays; answers leave in
    chunks.  With ``expiry(state)``, the microsecond from which a state means as much as none, an event-time timer takes the
    state away once the watermark (``late`` behind the latest event) has passed it.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    names = [c.split()[0] for c in out_fields.split(",")]
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{tie} {types[tie]}", "ts timestamp", out_fields])
    held = [tie, "ts", *reads]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [[f[c].to_numpy() for c in held] for f in frames]
        columns = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
        del parts
        ties, ts, *values = columns
        ts = ts.astype("datetime64[ns]")
        order = _order(ts, ties)
        current = tuple(state.get) if state.exists else None
        for at in range(0, len(order), CHUNK):
            part = order[at:at + CHUNK]
            out = []
            for us, *row in zip((ts[part].view("i8") // 1000).tolist(), *[v[part].tolist() for v in values]):
                current, found = step(current, us, *row)
                out.append(found)
            if at + CHUNK >= len(order):
                if current is not None:
                    state.update(current)
                    if expiry is not None:
                        state.setTimeoutTimestamp(max(-(-expiry(current) // 1000), state.getCurrentWatermarkMs() + 1))
                elif state.exists:
                    state.remove()
            answers = {n: list(c) for n, c in zip(names, zip(*out))}
            yield pd.DataFrame({**dict(zip(keys, ([k] * len(part) for k in key))), tie: ties[part], "ts": ts[part], **answers})

    timeout = GroupStateTimeout.NoTimeout if expiry is None else GroupStateTimeout.EventTimeTimeout
    rows = events.select(*dict.fromkeys([*keys, *held]))
    rows = rows if expiry is None else rows.withWatermark("ts", late)
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state_fields, "append", timeout)


def cooldown_stream(alerts: DataFrame, keys: list[str], tie: str = "event_id", seconds: int = fv.COOLDOWN_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``emitted``: no alert of the key was emitted in the seconds before; the state goes when they are over."""
    gap = seconds * 1_000_000

    def step(state, us):
        last = state[0] if state else None
        emit = last is None or us - last >= gap
        return ((us,) if emit else state), (emit,)

    return _fold(alerts, keys, tie, [], "emitted boolean", "last bigint", step, lambda state: state[0] + gap, late)


def rate_limit_stream(requests: DataFrame, keys: list[str], tie: str = "event_id", limit: int = fv.RATE_LIMIT, seconds: int = fv.RATE_WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``status`` 429 beyond the limit of a window that opens with its first request; the state goes when it closes."""
    width = seconds * 1_000_000

    def step(state, us):
        if state is None or state[1] <= us:
            return (1, us + width), (200, None)
        count, reset = state
        if count >= limit:
            return state, (429, max(1, -(-(reset - us) // 1_000_000)))
        return (count + 1, reset), (200, None)

    return _fold(requests, keys, tie, [], "status int,retry_after int", "count bigint, reset bigint", step, lambda state: state[1], late)


def free_quota_stream(requests: DataFrame, keys: list[str], tie: str = "event_id", limit: int = fv.FREE_FIX_LIMIT) -> DataFrame:
    """``applied`` (boolean) is an input column."""

    def step(state, us, applied):
        used = state[0] if state else 0
        allowed = used < limit
        return (used + int(allowed and bool(applied)),), (allowed, limit - used)

    return _fold(requests, keys, tie, ["applied"], "allowed boolean,remaining int", "used bigint", step)


def credit_stream(events: DataFrame, keys: list[str], opening: int, tie: str = "event_id") -> DataFrame:
    """``delta`` (int) is an input column, as in the batch ledger."""

    def step(state, us, delta):
        balance = state[0] if state else opening
        return (max(balance + int(delta), 0),), (balance, balance > 0)

    return _fold(events, keys, tie, ["delta"], "balance_before bigint,allowed boolean", "balance bigint", step)


def key_activation_stream(uses: DataFrame, tie: str = "event_id", days: int = fv.KEY_TTL_DAYS) -> DataFrame:
    """Uses carry ``known`` and the preset expiry ``preset_us`` (NULL if none) of their key."""
    ttl = days * 86400 * 1_000_000

    def step(state, us, known, preset_us):
        if not known:
            return (state or (-1,)), (False, "Unauthorized")
        if state is None or state[0] < 0:
            preset = None if pd.isna(preset_us) else int(preset_us)
            if preset is not None and preset < us:
                return (-1,), (False, fv.MSG_KEY_EXPIRED)
            state = (preset if preset is not None and preset > us else us + ttl,)
        ok = us <= state[0]
        return state, (ok, None if ok else fv.MSG_KEY_EXPIRED)

    return _fold(uses, ["key_string"], tie, ["known", "preset_us"], "allowed boolean,error string", "expiry bigint", step)


def alert_state_stream(scans: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Per file: HARD_BLOCK while blocked (``announce`` on the first), CLEAR once when it ends.

    ``blocked`` (boolean) is an input column; quiet files give a NULL type.
    """

    def step(state, us, blocked):
        active = bool(state[0]) if state else False
        blocked = bool(blocked)
        kind = "HARD_BLOCK" if blocked else ("CLEAR" if active else None)
        return ((True,) if blocked else None), (kind, blocked and not active)  # a clear file needs no state

    return _fold(scans, keys, tie, ["blocked"], "type string,announce boolean", "active boolean", step)
