"""Micro-batches in named steps, with a ledger: a batch that runs again goes on after the last step that ended.

A step takes the batch's rows and gives rows, which are written to a folder of the batch and the
step. The folder's success marker is the ledger's entry, written by the commit of the write itself;
a step with an entry is never run again, its rows are read. So effects of a step (an upsert, an audit
row, a publication) happen once for a batch unless the driver dies between the effect and the entry,
and a repetition gets the same rows, whatever the source gives then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lantern.sinks.notes import filesystem

#: Groups that the rows of a step that fails are divided into, again and again, until the one that fails is alone.
SPLIT = 8


@dataclass(frozen=True)
class Step:
    """A named step: `run(rows, batch number)` gives rows, or None to pass on those it got.

    A `best_effort` step that fails is left out. Of others, the rows that make it fail go to quarantine, each alone.
    """

    name: str
    run: Callable[[DataFrame, int], DataFrame | None]
    best_effort: bool = False


class Ledger:
    """The entries below a folder that driver and executors share."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def place(self, batch: int, step: str) -> str:
        return f"{self.folder}/batch={batch:09d}/{step}"

    def has(self, batch: int, step: str) -> bool:
        fs, path = filesystem(self.place(batch, step))
        return fs.get_file_info(f"{path}/_SUCCESS").type != pafs.FileType.NotFound

    def enter(self, batch: int, step: str, rows: DataFrame) -> DataFrame:
        """Write rows under a step, whole, and read them."""
        rows.write.mode("overwrite").parquet(self.place(batch, step))
        return self.rows(batch, step, rows)

    def rows(self, batch: int, step: str, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.parquet(self.place(batch, step))


def _attempt(step: Step, rows: DataFrame, batch: int, ledger: Ledger, name: str) -> DataFrame:
    made = step.run(rows, batch)
    return ledger.enter(batch, name, rows if made is None else made)


def _isolated(step: Step, rows: DataFrame, batch: int, ledger: Ledger, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that the step made, rows it fails on): groups by a hash of the key are tried, and those that fail divided further.

    Every group is tried once for each level, so a batch of n rows with one that fails costs about SPLIT * log(n) runs.
    """
    made: DataFrame | None = None
    bad: DataFrame | None = None
    left = [(rows, 0)]
    trial = 0
    while left:
        group, depth = left.pop()
        for part in range(SPLIT):
            here = group.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(depth)), F.lit(SPLIT)) == part)
            n = here.select(key).distinct().limit(2).count()
            if not n:
                continue
            trial += 1
            try:
                done = _attempt(step, here, batch, ledger, f"{step.name}-trial-{trial}")
                made = done if made is None else made.unionByName(done)
            except Exception as error:
                if n == 1:
                    why = here.withColumn("_step", F.lit(step.name)).withColumn("_error", F.lit(f"{type(error).__name__}: {error}"[:500]))
                    bad = why if bad is None else bad.unionByName(why)
                else:
                    left.append((here, depth + 1))
    # Without a row that works, the step gives what it would have got, and none of it.
    return (rows.limit(0) if made is None else made), (rows.limit(0).withColumn("_step", F.lit("")).withColumn("_error", F.lit("")) if bad is None else bad)


def run_batch(rows: DataFrame, batch: int, steps: Sequence[Step], ledger: Ledger, quarantine: str, key: str = "item_id") -> list[str]:
    """Take a batch through the steps that aren't in the ledger yet; returns the names of those that ran.

    Rows that make a step fail are written to `quarantine` (JSON, with `_step` and `_error`), each alone; the
    others go on. `key` tells rows apart; rows of one key go together.
    """
    if len({s.name for s in steps}) < len(steps) or any(s.name == "rows" for s in steps):
        raise ValueError("steps need names of their own, and none may be named rows")
    ran = []
    if not ledger.has(batch, "rows"):
        ledger.enter(batch, "rows", rows)
    now = ledger.rows(batch, "rows", rows)
    for step in steps:
        if ledger.has(batch, step.name):
            now = ledger.rows(batch, step.name, rows)
            continue
        ran.append(step.name)
        try:
            now = _attempt(step, now, batch, ledger, step.name)
        except Exception:
            if step.best_effort:
                now = ledger.enter(batch, step.name, now)
                continue
            made, bad = _isolated(step, now, batch, ledger, key)
            bad.write.mode("overwrite").json(f"{quarantine}/batch={batch:09d}/{step.name}")
            now = ledger.enter(batch, step.name, made)
    return ran


def run_steps(stream: DataFrame, steps: Sequence[Step], folder: str, quarantine: str, checkpoint: str, key: str = "item_id") -> StreamingQuery:
    """A stream whose micro-batches go through the steps; all that is there is taken, then the query ends."""
    ledger = Ledger(folder)
    handle = lambda rows, batch: run_batch(rows, batch, steps, ledger, quarantine, key)
    return stream.writeStream.foreachBatch(lambda rows, batch: handle(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
