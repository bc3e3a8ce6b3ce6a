"""The engine's operators over unbounded logs, with Structured Streaming.

Streams have rows ``ts`` (timestamp), ``batch_id``, ``event_idx``, ``t``, ``src``, ``dst`` and so on, as logs have.  State is
kept by node and is bounded: a buffer of ``k`` entries, or a flag.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECENT = "node long, batch_id long, event_idx long, role int, q long, slot int, nbr long, nbr_t long"
RECENT_STATE = "nbrs array<long>, times array<long>"
SEEN = "nid long, batch_id long, event_idx long"


def snapshots(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """``window, n_edges, n_pairs`` of tumbling windows; rows later than ``late`` are left out.  ``n_pairs`` is approximate: an exact count would keep every pair."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n_edges"), F.approx_count_distinct(F.struct("src", "dst")).alias("n_pairs"))


def sliding(stream: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """``window, src, dst, last_ts``: the pairs that a sliding memory holds at the end of each step."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "src", "dst").agg(F.max("ts").alias("last_ts"))


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """``session, src, n``: runs of a node's events without a pause longer than ``gap``."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "src").agg(F.count("*").alias("n"))


def first_per_bucket(stream: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """One event for each bucket, source and destination: the first to arrive; keys are forgotten when the watermark has passed them."""
    bucketed = stream.withColumn("bucket", F.floor(F.unix_seconds("ts") / seconds))
    return bucketed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["bucket", "src", "dst"])


def recent(stream: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """The last ``k`` neighbours of the ends of each edge (columns ``RECENT``), as the batch operator gives them.

    A batch (``batch_id``) must arrive within one trigger, and batches in order.  An edge sees its node's buffer as it
    was before its batch, and there the entries before its own time.
    """
    ends = [F.struct(F.lit(0).alias("role"), F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.lit(1).alias("role"), F.col("dst").alias("node"), F.col("src").alias("nbr"))]
    rows = stream.select("batch_id", "event_idx", "t", F.explode(F.array(*ends)).alias("e")).select("batch_id", "event_idx", "t", "e.*")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nbrs, times = map(list, state.get) if state.exists else ([], [])
        out = []
        rows = pd.concat(list(chunks)).sort_values(["batch_id", "t", "role", "event_idx"])
        for batch, of_batch in rows.groupby("batch_id", sort=True):
            for r in of_batch.itertuples():
                earlier = [(n, t) for n, t in zip(nbrs, times, strict=True) if t < r.t][-k:]
                out += [(key[0], batch, r.event_idx, r.role, r.t, i, n, t) for i, (n, t) in enumerate(earlier)]
            entering = of_batch if not directed else of_batch[of_batch["role"] == 0]
            nbrs = [*nbrs, *entering["nbr"].tolist()][-k:]
            times = [*times, *entering["t"].tolist()][-k:]
        state.update((nbrs, times))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECENT.split(", ")])

    return rows.groupBy("node").applyInPandasWithState(step, RECENT, RECENT_STATE, "append", GroupStateTimeout.NoTimeout)


def seen_nodes(stream: DataFrame) -> DataFrame:
    """``nid, batch_id, event_idx`` of labels whose node was in an edge of their batch or an earlier one.  A batch must arrive within one trigger."""
    touched = F.when(F.col("kind") == 0, F.array("src", "dst")).when(F.col("kind") == 2, F.array("nid"))
    rows = stream.select("batch_id", "event_idx", "kind", F.explode(touched).alias("node"))

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = pd.concat(list(chunks))
        edges = rows[rows["kind"] == 0]
        if len(edges):
            first = int(edges["batch_id"].min()) if first is None else min(first, int(edges["batch_id"].min()))
            state.update((first,))
        labels = rows[rows["kind"] == 2]
        found = labels[labels["batch_id"] >= first] if first is not None else labels.iloc[:0]
        yield pd.DataFrame({"nid": key[0], "batch_id": found["batch_id"], "event_idx": found["event_idx"]})

    return rows.groupBy("node").applyInPandasWithState(step, SEEN, "first_batch long", "append", GroupStateTimeout.NoTimeout)
