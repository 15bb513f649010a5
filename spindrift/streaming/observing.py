"""The observation state machine as a stream: state by key, the same outcomes as the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.state import CLOSED, KEY, THRESHOLD

INPUT = "source string, identity_key string, run_id string, seq bigint, observed_at timestamp, hash string, score int, status string"
OUTPUT = "source string, identity_key string, run_id string, seq bigint, stale boolean, created boolean, changed boolean, reopened boolean, task string, new_status string"
_STATE = "last_seen timestamp, hash string, status string"


def _fold(threshold: int):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for run, seq, at, content, score, status in zip(*(rows[c] for c in ("run_id", "seq", "observed_at", "hash", "score", "status"))):
            at = at.to_pydatetime()
            if old is not None and at < old[0]:
                out.append((*key, run, seq, True, False, False, False, None, status))
                continue
            created = old is None
            changed = not created and content != old[1]
            reopened = not created and old[2] in CLOSED and status in ("open", "reopened")
            task = ("source_new" if score >= threshold else None) if created else "source_reopened" if reopened else "source_changed" if changed else None
            new = "reopened" if reopened and status == "open" else status
            out.append((*key, run, seq, False, created, changed, reopened, task, new))
            # the next poll is compared with what was sent, so a reopening lasts for one observation
            old = (at, content, status)
        if old is not None:
            state.update(old)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return fold


def observe(stream: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Outcomes of a stream of observations; within a micro-batch rows of a key are taken by ``seq``.

    State is one small row a key and never expires: a posting may return after any time.
    """
    return stream.groupBy(*KEY).applyInPandasWithState(_fold(threshold), OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def read_landed(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Observation files as they land."""
    return spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
