"""Verification of reports as a state machine on a stream of status changes.

Each report's status is kept state. A change that the status allows is applied and becomes an entry of the audit log; one that it doesn't
allow goes to a side output with the reason. The state and the offsets are checkpointed together, so a restart goes on behind the last batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import TRANSITIONS

CHANGE = "id long, seq long, at timestamp, new_status string, user_id long, notes string"
ENTRY = f"{CHANGE}, previous_status string, processing_status string, applied boolean, reason string"
FIRST = "PENDING"
#: Groups of reports whose states are kept together: a call for each report of a batch would cost more than its changes.
GROUPS = 4096
# What a report's processing is after a change, and why a change isn't allowed.
PROCESSING = {"VERIFIED": "COMPLETED", "REJECTED": "CLOSED", "DUPLICATE": "CLOSED", "UNDER_REVIEW": "IN_PROGRESS"}
ENDED = "Cannot transition report from terminal state '{0}' to '{1}'. Terminal verification states (VERIFIED, REJECTED, DUPLICATE) cannot be modified."
NOT_ALLOWED = "Cannot transition report from '{0}' to '{1}'. Allowed transitions from '{0}' are: {2}."


def step(status: str, wanted: str | None) -> tuple[str, str, str | None]:
    """(status after, status asked for, reason why not) of a change."""
    clean = (wanted or "").strip().upper()
    allowed = TRANSITIONS.get(status, ())
    if clean in allowed:
        return clean, clean, None
    return status, clean, NOT_ALLOWED.format(status, clean, ", ".join(sorted(allowed))) if allowed else ENDED.format(status, clean)


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The changes of one group of reports in a batch, each report's in the order of their time and number."""
    rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable", na_position="first")
    known = json.loads(state.get[0]) if state.exists else {}
    made = []
    for report, wanted in zip(map(str, rows["id"]), rows["new_status"], strict=True):
        status = known.get(report, FIRST)
        known[report], clean, reason = step(status, wanted)
        made.append((clean, status, PROCESSING.get(known[report]) if reason is None else None, reason is None, reason))
    state.update((json.dumps(known),))
    texts = ["new_status", "previous_status", "processing_status", "reason", "notes"]
    judged = pd.DataFrame(made, index=rows.index, columns=["new_status", "previous_status", "processing_status", "applied", "reason"])
    rows = rows.assign(**judged)[[c.split()[0] for c in ENTRY.split(", ")]]
    yield rows.astype(dict.fromkeys(texts, "string"))


def verified(changes: DataFrame) -> DataFrame:
    """A stream of changes (see ``CHANGE``) as a stream of entries (see ``ENTRY``): each change, whether it is applied, and why not.

    Reports start as PENDING. Within a batch a report's changes are taken in the order of their time and number; a change that comes in a later batch
    is judged by the status as it is then. Changes of no report are left out.
    """
    rows = changes.where(F.col("id").isNotNull()).selectExpr(*(c.split()[0] for c in CHANGE.split(", ")))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("id"), F.lit(GROUPS)))
    return rows.groupBy("__group").applyInPandasWithState(_apply, ENTRY, "statuses string", "append", "NoTimeout")


def outputs(path: str):
    """For ``foreachBatch``: entries that were applied go to the audit log, the others to ``invalid``, both under the number of their batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.where("applied").drop("applied", "reason").write.mode("overwrite").parquet(f"{path}/audit/batch={batch_id}")
            batch.where("not applied").drop("applied", "processing_status").write.mode("overwrite").parquet(f"{path}/invalid/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
