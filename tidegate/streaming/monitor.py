"""Streaming forms: exactly-once windows of score monitoring, and stateful velocity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_stats(stream: DataFrame, t_decline: float, t_review: float, days: int = 7, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Per tumbling window of event time: rows, mean score, flag rates and fraud, final once the watermark has passed."""
    s = F.col("score")
    rate = lambda c: F.avg(c.cast("double"))
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days").alias("w"))
    out = w.agg(F.count("*").alias("n"), F.avg(s).alias("mean_score"), rate(s >= t_decline).alias("decline_rate"), rate((s >= t_review) & (s < t_decline)).alias("review_rate"), F.avg("y").alias("fraud_rate"))
    return out.select(F.col("w.start").alias("start"), "n", "mean_score", "decline_rate", "review_rate", "fraud_rate")


def score_bins(stream: DataFrame, edges: list[float], days: int = 7, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """(start, bin, n) per window against fixed reference edges: the counts a stability index needs."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("score")))
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days").alias("w"), at.alias("bin"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def velocity_stream(stream: DataFrame, key: str, windows: dict[str, int], dt: str = "dt", amount: str = "amount", row_id: str = "id") -> DataFrame:
    """(key, id, dt, late, cnt_<w>, amt_<w>) for each row as it arrives.

    A key's state is its rows of the last longest window, in order of time,
    with running sums, so a row costs two searches a window.  The state ends
    one longest window before the latest time seen.  Rows may come in any
    order: one that is not older than that finds all its windows' rows that
    have arrived; an older one is told as late, its windows hold only what the
    state still has, and it is not kept.  Rows told before a late arrival stay
    as they were.  Null keys have no history and are left out; a null amount
    counts as 0.
    """
    names, spans = list(windows), list(windows.values())
    longest = max(spans)
    fields = ", ".join(f"cnt_{n} long, amt_{n} double" for n in names)
    kind = dict(stream.dtypes)
    columns = [key, row_id, dt, "late", *[f"{p}_{n}" for n in names for p in ("cnt", "amt")]]

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_t, old_a = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        new = pd.concat(list(chunks)).sort_values([dt, row_id], kind="stable")
        t, a = new[dt].to_numpy(np.int64), new[amount].fillna(0.0).to_numpy(float)
        begin = old_t[-1] - longest if len(old_t) else None
        late = t < begin if begin is not None else np.zeros(len(t), bool)
        times, amounts = np.concatenate((old_t, t[~late])), np.concatenate((old_a, a[~late]))
        order = np.argsort(times, kind="stable")
        times, amounts = times[order], amounts[order]
        total = np.concatenate(([0.0], np.cumsum(amounts)))
        out = {key: group[0], row_id: new[row_id].to_numpy(), dt: t, "late": late}
        upto = np.searchsorted(times, t)
        for n, span in windows.items():
            since = np.searchsorted(times, t - span)
            out[f"cnt_{n}"], out[f"amt_{n}"] = upto - since, total[upto] - total[since]
        keep = times >= times[-1] - longest if len(times) else np.zeros(0, bool)
        state.update((times[keep].tolist(), amounts[keep].tolist()))
        yield pd.DataFrame(out)[columns]

    known = stream.where(F.col(key).isNotNull())
    return known.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {row_id} {kind[row_id]}, {dt} {kind[dt]}, late boolean, {fields}", "times array<long>, amounts array<double>", "append", GroupStateTimeout.NoTimeout)
