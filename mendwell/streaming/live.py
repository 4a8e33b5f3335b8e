"""Samples and kept plans as streams.

``windowed`` is a plain event-time aggregation with a watermark. ``serve`` keeps plans by key with a lifetime: a complaint
that finds its key alive is a hit, else it is a miss and its plan is kept, if it is admitted. State is per key, so keys spread over
executors, and it is dropped when it dies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..operators import metrics as M

SAMPLES = "sample_id bigint, client_key string, t timestamp, written_at timestamp, ms double, hit boolean, contexts int, result_id bigint"


def windowed(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, requests, hit_rate, within_budget) of each window; samples later than the watermark don't count."""
    w = samples.filter("t IS NOT NULL").withWatermark("t", late).groupBy(F.window("t", width).alias("w"))
    agg = w.agg(F.count("*").alias("requests"), M.share(F.col("hit"), F.lit(True), 0.0).alias("hit_rate"), M.share(F.col("ms") < C.BUDGET_MS, F.col("ms").isNotNull(), 1.0).alias("within_budget"))
    return agg.select(F.col("w.start").alias("start"), "requests", "hit_rate", "within_budget")


def serve(requests: DataFrame, lifetime_s: int = C.LIFETIME_S, admitted: str | None = None) -> DataFrame:
    """requests: (key, request_id, at). (key, request_id, match): 'exact' where the key was kept and alive, else 'miss'.

    admitted: a boolean column that says whether the plan made for a missed request may be kept (it answers, and breaks no rule);
    without it every plan is. Null is no. Requests without a key give no rows. Within a batch, a key's requests are served in the order of their time.
    """

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "request_id"])
        stored = state.get[0] if state.exists else None
        out = []
        for request, at, good in zip(rows["request_id"], rows["at"], rows["admitted"]):
            now = at.timestamp()
            if stored is not None and now - stored <= lifetime_s:
                out.append((key[0], request, "exact"))
            else:
                out.append((key[0], request, "miss"))
                stored = now if good else stored
        if stored is not None:
            state.update((stored,))
            state.setTimeoutTimestamp(max(int((stored + lifetime_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "request_id", "match"])

    good = F.coalesce(F.col(admitted), F.lit(False)) if admitted else F.lit(True)
    source = requests.filter("key <> '' AND at IS NOT NULL").select("key", "request_id", "at", good.alias("admitted")).withWatermark("at", f"{lifetime_s} seconds")
    return source.groupBy("key").applyInPandasWithState(each, "key string, request_id bigint, match string", "stored double", "append", GroupStateTimeout.EventTimeTimeout)
