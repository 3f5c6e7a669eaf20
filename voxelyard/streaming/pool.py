"""The point pool as a fold over frames: a point gains support and rejections, and is pruned once
rejections lead by `lead`; what comes after is ignored. The same step runs over tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAD = 3
OUT = "user_id long, support long, reject long, last_seen long, alive boolean"
STATE = "support long, reject long, last_seen long, alive boolean"
START = (0, 0, -1, True)


def step(state: tuple, rows: pd.DataFrame, lead: int = LEAD) -> tuple:
    """State after some rows (event_id, support, reject), taken by event_id."""
    s, r, seen, alive = state
    for e, up, down in rows.sort_values("event_id")[["event_id", "support", "reject"]].itertuples(index=False):
        if not alive:
            break
        s, r, seen = s + int(up), r + int(down), int(e)
        alive = r - s < lead
    return s, r, seen, alive


def settle(events: DataFrame) -> DataFrame:
    """Last state of each key of a whole table, by running sums: a key's events count up to the first where rejections
    lead by LEAD. One shuffle; a key with very many events is sorted with spilling and read as a stream of rows.
    Nulls count as 0; events of equal id are taken in the order of their reject, then support; a null key is a key, a null
    id comes first."""
    order = Window.partitionBy("user_id").orderBy("event_id", "reject", "support").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = F.coalesce("support", F.lit(0)).cast("long"), F.coalesce("reject", F.lit(0)).cast("long")
    rows = events.select("user_id", F.col("event_id").cast("long").alias("event_id"), up.alias("support"), down.alias("reject"))
    led = rows.withColumn("lead", F.sum(F.col("reject") - F.col("support")).over(order))
    ended = led.withColumn("ends", F.sum((F.col("lead") >= LEAD).cast("long")).over(order))
    counted = ended.filter((F.col("ends") == 0) | ((F.col("ends") == 1) & (F.col("lead") >= LEAD)))
    return counted.groupBy("user_id").agg(F.sum("support").alias("support"), F.sum("reject").alias("reject"), F.max("event_id").alias("last_seen"), (F.max("ends") == 0).alias("alive"))


def settle_stream(events: DataFrame) -> DataFrame:
    """State of each key after each batch of a stream, in update mode; a batch's rows are ordered by
    event_id, and batches follow the source's order."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        now = step(tuple(now), pd.concat(list(parts), ignore_index=True))
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["user_id", "support", "reject", "last_seen", "alive"])

    return events.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", "NoTimeout")


#: When a point of the pool is kept in any case, and when it may go.
SUPPORT_KEEP, RATIO_KEEP, REJECT_DROP, STALE_FRAMES, PRUNE_EVERY = 3, 0.6, 4, 20, 1
POINT = "there boolean, support long, reject long, last_seen long, pruned long"


def hysteresis(events: DataFrame, keys: list[str], support_keep: int = SUPPORT_KEEP, ratio_keep: float = RATIO_KEEP, reject_drop: int = REJECT_DROP, stale: int = STALE_FRAMES, every: int = PRUNE_EVERY) -> DataFrame:
    """(keys, there, support, reject, last_seen, pruned) of a pool's points after all frames, from a row (keys, frame, added,
    support, reject) for each point and frame that it is looked at in: an absent point comes in by ``added`` with a support of
    1, a present one gains support (it is then seen) or a rejection; in every ``every``-th frame one with enough rejections
    that wasn't seen for long goes, unless its support or share of support keeps it, and may come in again. ``pruned`` counts
    that. A point's frames are one row's array, as many as its scene has. Null numbers are 0, rows without a frame are
    ignored; several rows of a frame are one; null keys are keys."""
    numbers = [F.max(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ("added", "support", "reject")]
    once = events.filter("frame is not null").groupBy(*keys, F.col("frame").cast("long").alias("frame")).agg(*numbers)
    rows = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", "added", "support", "reject"))).alias("_rows"))

    def step(now, e):
        comes = ~now["there"] & (e["added"] > 0)
        there = now["there"] | comes
        up = F.when(comes, 1).otherwise(now["support"]) + F.when(there, e["support"]).otherwise(0)
        down = F.when(comes, 0).otherwise(now["reject"]) + F.when(there, e["reject"]).otherwise(0)
        seen = F.when(comes | (there & (e["support"] > 0)), e["frame"]).otherwise(now["last_seen"])
        kept = (up >= support_keep) | (up / F.greatest(up + down, F.lit(1)) >= ratio_keep)
        goes = there & (e["frame"] % every == 0) & (down >= reject_drop) & (e["frame"] - seen >= stale) & ~kept
        return F.struct((there & ~goes).alias("there"), up.cast("long").alias("support"), down.cast("long").alias("reject"), seen.alias("last_seen"), (now["pruned"] + goes.cast("long")).alias("pruned"))

    start = F.struct(F.lit(False).alias("there"), *[F.lit(v).cast("long").alias(c) for c, v in (("support", 0), ("reject", 0), ("last_seen", -1), ("pruned", 0))])
    return rows.select(*keys, F.aggregate("_rows", start.cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in POINT.split(', '))}>"), step).alias("_now")).select(*keys, "_now.*")


def hysteresis_step(now: tuple, rows: pd.DataFrame, support_keep: int = SUPPORT_KEEP, ratio_keep: float = RATIO_KEEP, reject_drop: int = REJECT_DROP, stale: int = STALE_FRAMES, every: int = PRUNE_EVERY) -> tuple:
    """A point's state after some frames' rows, as in hysteresis()."""
    there, up, down, seen, pruned = now
    for frame, added, s, r in rows.groupby("frame")[["added", "support", "reject"]].max().fillna(0).astype(int).itertuples():
        if not there and added > 0:
            there, up, down, seen = True, 1, 0, int(frame)
        if there:
            up, down, seen = up + s, down + r, int(frame) if s > 0 else seen
            kept = up >= support_keep or up / max(1, up + down) >= ratio_keep
            if frame % every == 0 and down >= reject_drop and frame - seen >= stale and not kept:
                there, pruned = False, pruned + 1
    return bool(there), int(up), int(down), int(seen), int(pruned)


def hysteresis_stream(events: DataFrame, key: str = "point", **limits) -> DataFrame:
    """hysteresis() over a stream, in update mode: each point's state after each batch. A batch holds whole frames, and batches
    follow the frames. A stale point that goes keeps only its last counts."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (False, 0, 0, -1, 0)
        now = hysteresis_step(now, pd.concat(list(parts), ignore_index=True), **limits)
        state.update(now)
        yield pd.DataFrame([(*k, *now)], columns=[key, "there", "support", "reject", "last_seen", "pruned"])

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, {POINT}", POINT, "update", "NoTimeout")
