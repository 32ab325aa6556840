"""Progress of jobs as a state machine: events move a job from stage to stage, illegal steps are told and change nothing.

One fold serves both ways: in batch over rows sorted by job and order, a row at a time, and in a stream with its state kept by job
(``transformWithState``), which is dropped when a job has been silent for a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "job string, seq long, stage string, progress int, verdict string, now string, now_progress int"


@dataclass(frozen=True)
class Machine:
    """Stages with the stages that may follow each; ``start`` is where a job begins, ``ends`` are final."""

    start: str
    follows: Mapping[str, Sequence[str]]
    ends: Sequence[str] = ()
    failed: str = "FAILED"
    pairs: frozenset = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "pairs", frozenset((a, b) for a, all_ in self.follows.items() for b in all_))

    def step(self, state: tuple[str, int] | None, stage: str | None, progress: int | None) -> tuple[tuple[str, int], str]:
        """The next state, and what became of the event: ok, or why it is illegal (unknown, ended, skipped, backwards)."""
        now, so_far = state or (self.start, 0)
        stages = {self.start, self.failed, *self.follows, *self.ends}
        if stage not in stages:
            return (now, so_far), "unknown"
        if now in self.ends or now == self.failed:
            return (now, so_far), "ended"
        if stage == self.failed:
            return (stage, so_far), "ok"  # how far it came stays
        if stage != now and (now, stage) not in self.pairs:
            return (now, so_far), "skipped"
        if progress is not None and progress < so_far:
            return (now, so_far), "backwards"
        return (stage, so_far if progress is None else progress), "ok"


#: The stages of a document's preparation.
PREPARATION = Machine("QUEUED", {"QUEUED": ("BUILDING_SECTION", "READY"), "BUILDING_SECTION": ("BUILDING_INDEX",), "BUILDING_INDEX": ("BUILDING_PACKAGES",), "BUILDING_PACKAGES": ("READY",)}, ("READY",))


def _folded(machine: Machine, state, rows) -> tuple[list[tuple], tuple[str, int] | None]:
    out = []
    for job, seq, stage, progress in rows:
        state, verdict = machine.step(state, stage, None if pd.isna(progress) else int(progress))
        out.append((job, int(seq), stage, progress, verdict, *state))
    return out, state


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job", "seq", "stage", "progress", "verdict", "now", "now_progress"]).astype({"progress": "Int32", "seq": "int64", "now_progress": "int32"})


def judged(events: DataFrame, machine: Machine = PREPARATION) -> DataFrame:
    """Every event (job string, seq long, stage string, progress int) with its verdict and the job's state after it, in the order of ``seq``.

    A job's rows are folded one after the other, never held together, however many they are. Rows without a job or seq are
    left out; equal seqs are taken by stage and progress.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, None
        for frame in frames:
            out = []
            for row in frame[["job", "seq", "stage", "progress"]].itertuples(index=False, name=None):
                if row[0] != job:
                    job, state = row[0], None
                done, state = _folded(machine, state, [row])
                out += done
            yield _frame(out)

    rows = events.where("job IS NOT NULL AND seq IS NOT NULL").select("job", F.col("seq").cast("long").alias("seq"), "stage", F.col("progress").cast("int").alias("progress"))
    return rows.repartition("job").sortWithinPartitions("job", "seq", "stage", "progress").mapInPandas(fold, SCHEMA)


def last_states(verdicts: DataFrame) -> DataFrame:
    """job, stage, progress, events, illegal, first_illegal (its seq) and ended of each job, from judged()."""
    last = F.max_by(F.struct("now", "now_progress"), "seq")
    illegal = F.col("verdict") != "ok"
    out = verdicts.groupBy("job").agg(last.alias("s"), F.count("*").alias("events"), F.count_if(illegal).alias("illegal"), F.min(F.when(illegal, F.col("seq"))).alias("first_illegal"))
    return out.select("job", F.col("s.now").alias("stage"), F.col("s.now_progress").alias("progress"), "events", "illegal", "first_illegal")


class _Jobs(StatefulProcessor):
    def __init__(self, machine: Machine, silent_ms: int | None) -> None:
        self.machine, self.silent_ms = machine, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "stage string, progress int", self.silent_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        # A trigger brings what has come since the last one; its rows may be out of order.
        new = sorted((r for f in rows for r in f[["job", "seq", "stage", "progress"]].itertuples(index=False, name=None)), key=lambda r: (r[1], r[2] or "", -1 if pd.isna(r[3]) else r[3]))
        out, state = _folded(self.machine, None if known is None else (known[0], int(known[1])), new)
        if state is not None:
            self.state.update(state)
        yield _frame(out)

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, machine: Machine = PREPARATION, silent_ms: int | None = None) -> DataFrame:
    """judged() over a stream; needs the RocksDB state store. State of a job silent for ``silent_ms`` goes (then it begins anew)."""
    mode = "None" if silent_ms is None else "ProcessingTime"
    return stream.where("job IS NOT NULL AND seq IS NOT NULL").groupBy("job").transformWithStateInPandas(_Jobs(machine, silent_ms), outputStructType=SCHEMA, outputMode="Append", timeMode=mode)
