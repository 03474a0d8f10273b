"""Time-ordered operators that survive a key holding a large share of all rows.

A plain window over such a key would sort it in one task.  Here rows are dealt by
range of key and order, so parts are even whatever the keys are; summaries (one row
per key and part) are combined in a window over parts, and row-level windows run
per (key, part).  Windows anchored on the first event use time slices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark import fixed_values as fv
from riskspark.session import checkpoint

def by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned on (keys, order) with their part ``_p``: parts hold about as many rows each, however many
    rows one key or one minute has.

    The rows are checkpointed, so part numbers stay the same for every pass when a task is run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return checkpoint(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()))


def _carried(ranged: DataFrame, keys: list[str], part: Column, over: Callable[[str], Column], empty=None) -> DataFrame:
    """(keys..., _p, _before): ``over`` of the key's earlier parts, from one summary row per key and part."""
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    found = over("_part").over(w)
    sums = ranged.groupBy(*keys, "_p").agg(part.alias("_part"))
    return sums.withColumn("_before", found if empty is None else F.coalesce(found, F.lit(empty))).drop("_part")


def prefix_by_range(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: sum of ``value`` over the key's earlier rows in the given order."""
    ranged = by_range(df.withColumn("_v", value.cast("bigint")), keys, order)
    inner = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return out.join(_carried(ranged, keys, F.sum("_v"), F.sum, 0), keys + ["_p"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_in", "_before", "_p")


def prior_sum(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, name: str) -> DataFrame:
    """Add ``name``: sum of ``value`` over the key's earlier rows (ts, tie order)."""
    return prefix_by_range(df, keys, [ts, tie], value, name)


def prior_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the key's previous row; NULL for its first."""
    ranged = by_range(df, keys, order)
    inner = Window.partitionBy(*keys, "_p").orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    out = ranged.withColumn("_lag", F.lag(boxed).over(inner))
    before = _carried(ranged, keys, F.max_by(boxed, F.struct(*order)), F.last)
    return out.join(before, keys + ["_p"]).withColumn(name, F.coalesce("_lag", "_before")["v"]).drop("_lag", "_before", "_p")


def prior_ts(df: DataFrame, keys: list[str], ts: str, tie: str, name: str) -> DataFrame:
    """Add ``name``: time of the key's previous row."""
    return prior_value(df, keys, [ts, tie], ts, name)


# --- sessions ------------------------------------------------------------------------------------

def quiet_sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: float, **aggs: Column) -> DataFrame:
    """Sessions closed by a quiet period of at least ``gap_seconds``, with the given aggregates.

    Rows of one (key, ts) are folded first.
    """
    points = events.groupBy(*keys, ts).agg(F.count("*").alias("_n"))
    lagged = prior_ts(points, keys, ts, "_n", "_prev")
    far = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) >= int(gap_seconds * 1_000_000)
    opens = lagged.withColumn("_open", F.when(F.col("_prev").isNull() | far, 1).otherwise(0))
    numbered = prior_sum(opens, keys, ts, "_n", F.col("_open"), "_prior").withColumn("session", F.col("_prior") + F.col("_open"))
    tagged = events.join(numbered.select(*keys, ts, "session"), keys + [ts])
    return tagged.groupBy(*keys, "session").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), *[a.alias(n) for n, a in aggs.items()]
    )


def debounce(events: DataFrame, keys: list[str], ts: str = "ts", path: str = "path", gap_seconds: float = fv.DEBOUNCE_MS / 1000) -> DataFrame:
    """Trailing quiet period over all paths of a workspace; each batch is the sorted set of paths."""
    return quiet_sessions(events, keys, ts, gap_seconds, paths=F.array_sort(F.collect_set(path)))


def write_settled(events: DataFrame, keys: list[str], ts: str = "ts", quiet_seconds: float = fv.SETTLE_MS / 1000) -> DataFrame:
    """Per path: one row per burst, once it has been quiet long enough."""
    return quiet_sessions(events, keys, ts, quiet_seconds)


# --- windows anchored on the first event -----------------------------------------------------------

def anchored_windows(events: DataFrame, keys: list[str], ts: str, width_seconds: int, slices_per_width: int = 32) -> DataFrame:
    """(keys…, ts, anchor): each window opens at the first event at or after the end of the one before.

    The next anchor depends on the last one, so a slice cannot be solved alone.
    Pass 1 works out, per (key, slice), the last anchor of the slice for every
    event that could open its first window; pass 2 walks a key's slices with
    these small maps to find the anchor each slice inherits; pass 3 assigns
    anchors inside slices.  No pass sees more than one slice of a key's events.
    """
    width = int(width_seconds * 1_000_000)
    span = width * slices_per_width
    points = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).distinct().withColumn("slice", F.floor(F.col("us") / span))
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)

    def exits(group: dict) -> dict:
        t = group["us"]
        nxt = np.searchsorted(t, t + width)
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        # a slice is entered at one of the events of its first width, or at the first one after that
        early = int(np.searchsorted(t, int(group["slice"][0]) * span + width))
        entry = np.arange(min(early + 1, len(t)))
        # runs of entries with one exit are kept as their latest entry
        keep = entry[np.append(last[entry][1:] != last[entry][:-1], True)]
        return {"slice": group["slice"][:1], "entry": [t[keep].tolist()], "exit": [last[keep].tolist()]}

    def carry(group: dict) -> dict:
        out, anchor = [], None
        for entry, exit_ in zip(group["entry"], group["exit"]):
            out.append(anchor)
            due = -(2**62) if anchor is None else anchor + width
            at = np.searchsorted(np.asarray(entry), due)
            if at < len(entry):
                anchor = int(exit_[at])
        return {"slice": group["slice"], "inherited": out}

    def assign(group: dict) -> dict:
        t, inherited = group["us"], group["inherited"][0]
        anchors = np.empty(len(t), dtype="int64")
        i = 0
        if not pd.isna(inherited):
            i = int(np.searchsorted(t, int(inherited) + width))
            anchors[:i] = int(inherited)
        while i < len(t):
            j = int(np.searchsorted(t, t[i] + width))
            anchors[i:j] = t[i]
            i = j
        return {"us": t, "anchor_us": anchors}

    maps = sorted_groups(points, keys + ["slice"], ["us"], keys, exits, f"{key_ddl}, slice bigint, entry array<bigint>, exit array<bigint>")
    carried = sorted_groups(maps, keys, ["slice"], keys, carry, f"{key_ddl}, slice bigint, inherited bigint")
    solved = sorted_groups(points.join(carried, keys + ["slice"]), keys + ["slice"], ["us"], keys, assign, f"{key_ddl}, us bigint, anchor_us bigint")
    return solved.select(*keys, F.timestamp_micros("us").alias(ts), F.timestamp_micros("anchor_us").alias("anchor"))


def sorted_groups(df: DataFrame, by: list[str], order: list[str], out_keys: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run ``fn`` on the columns of each group of a hash-partitioned, sorted table.

    Groups are cut out of Arrow batches, so thousands of small groups cost one
    Python call per batch; a group is held whole only in its own task.
    """

    def run(frames):
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if len(pdf) == 0:
                continue
            held.append(pdf)
            first, last = held[0][by].iloc[0], pdf[by].iloc[-1]
            if first.equals(last):
                continue
            whole = pd.concat(held) if len(held) > 1 else pdf
            cut = _starts(whole, by)
            held = [whole.iloc[cut[-1] :]]
            yield _apply(whole.iloc[: cut[-1]], cut[:-1])
        if held:
            whole = pd.concat(held) if len(held) > 1 else held[0]
            yield _apply(whole, _starts(whole, by))

    def _starts(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for c in cols:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def _apply(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        out: dict[str, list] = {}
        for a, b in zip(starts, np.append(starts[1:], len(pdf))):
            result = fn({c: v[a:b] for c, v in cols.items()})
            n = len(next(iter(result.values())))
            for k in out_keys:
                out.setdefault(k, []).extend([cols[k][a]] * n)
            for name, values in result.items():
                out.setdefault(name, []).extend(values)
        names = [part.split()[0] for part in schema.split(", ")]
        return pd.DataFrame({n: pd.Series(out[n], dtype="Int64" if n == "inherited" else None) for n in names})

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _with_anchor(events: DataFrame, keys: list[str], ts: str, tie: str, width: int) -> DataFrame:
    base = events.withColumn(ts, F.col(ts).cast("timestamp"))
    anchored = base.join(anchored_windows(base, keys, ts, width), keys + [ts])
    w = Window.partitionBy(*keys, "anchor").orderBy(ts, tie)
    return anchored.withColumn("rank", F.row_number().over(w))


def cooldown(alerts: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", seconds: int = fv.COOLDOWN_SECONDS) -> DataFrame:
    """Add ``emitted``: at least ``seconds`` since the last emitted alert of the key."""
    return _with_anchor(alerts, keys, ts, tie, seconds).withColumn("emitted", F.col("rank") == 1).drop("rank", "anchor")


def rate_limit(
    requests: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", limit: int = fv.RATE_LIMIT, seconds: int = fv.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Add ``status`` (200/429) and ``retry_after``; a window opens at its first request."""
    rows = _with_anchor(requests, keys, ts, tie, seconds)
    left = F.unix_micros("anchor") + seconds * 1_000_000 - F.unix_micros(ts)
    over = F.col("rank") > limit
    return rows.withColumn("status", F.when(over, 429).otherwise(200)).withColumn(
        "retry_after", F.when(over, F.greatest(F.lit(1), F.ceil(left / 1_000_000)).cast("int"))
    ).drop("rank", "anchor")


# --- quotas and keys ---------------------------------------------------------------------------------

def free_quota(requests: DataFrame, keys: list[str], applied: Column, ts: str = "ts", tie: str = "event_id", limit: int = fv.FREE_FIX_LIMIT) -> DataFrame:
    """Add ``allowed`` and ``remaining``: allowed while fewer than ``limit`` fixes were applied before."""
    rows = prior_sum(requests, keys, ts, tie, F.when(applied, 1).otherwise(0), "used")
    used = F.least(F.col("used"), F.lit(limit))
    return rows.withColumn("allowed", used < limit).withColumn("remaining", (limit - used).cast("int")).drop("used")


def credit_ledger(events: DataFrame, keys: list[str], delta: Column, opening: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``balance_before`` and ``allowed`` for debits that need a positive balance.

    ``delta`` is -1 for a request that succeeds, 0 for one that fails (debited,
    then refunded), +n for a grant.  The clamped balance is the running sum plus
    the largest overdraft so far, so no row-by-row fold is needed.
    """
    d = events.withColumn("_d", delta.cast("bigint"))
    before = prior_sum(d, keys, ts, tie, F.col("_d"), "_s")
    after = by_range(before.withColumn("_after", F.col("_s") + F.col("_d")), keys, [ts, tie])
    low = _carried(after, keys, F.min("_after"), F.min).withColumnRenamed("_before", "_low")
    w = Window.partitionBy(*keys, "_p").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = after.withColumn("_in", F.min("_after").over(w)).join(low, keys + ["_p"])
    floor = F.least(F.col("_in"), F.col("_low"))
    balance = F.col("_s") + F.greatest(F.lit(opening), F.coalesce(-floor, F.lit(opening)))
    return rows.withColumn("balance_before", balance).withColumn("allowed", F.col("balance_before") > 0).drop(
        "_d", "_s", "_after", "_p", "_in", "_low"
    )


def key_activation(uses: DataFrame, records: DataFrame, key: str = "key_string", ts: str = "ts", days: int = fv.KEY_TTL_DAYS) -> DataFrame:
    """Add ``allowed`` and ``error`` per use; the first use of a key starts its clock.

    ``records`` has (key, activated_at, expires_at).  A preset expiry still in
    the future is kept; an expired one refuses the activation.
    """
    first = uses.groupBy(key).agg(F.min(ts).alias("_first"))
    known = records.select(key, "activated_at", "expires_at").withColumn("_known", F.lit(True))
    state = first.join(known, key, "left")
    fresh = F.col("activated_at").isNull()
    refused = fresh & (F.col("expires_at") < F.col("_first"))
    expiry = F.when(fresh, F.when(F.col("expires_at") > F.col("_first"), F.col("expires_at")).otherwise(F.col("_first") + F.make_interval(days=F.lit(days)))).otherwise(F.col("expires_at"))
    state = state.withColumn("_refused", F.coalesce(refused, F.lit(False))).withColumn("_expiry", expiry)
    rows = uses.join(state.select(key, "_known", "_refused", "_expiry"), key, "left")
    error = (
        F.when(F.col("_known").isNull(), "Unauthorized")
        .when(F.col("_refused") | F.col("_expiry").isNull() | (F.col(ts) > F.col("_expiry")), fv.MSG_KEY_EXPIRED)
    )
    return rows.withColumn("error", error).withColumn("allowed", F.col("error").isNull()).drop("_known", "_refused", "_expiry")
