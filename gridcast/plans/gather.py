"""Sums over the tasks of a stage, for learners that keep their rows in the tasks and agree on a model step by step.

With one task a sum is the array itself. With several the stage is a barrier stage: its tasks run together, exchange their arrays and add them up in the
same order, so that all go on from the same numbers to the last bit. If one is lost Spark runs the stage anew; learners therefore train in rounds, a stage each.
Barrier stages need a free slot for every task and no dynamic allocation, and an exchange takes about a second.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Generator, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Sum = Callable[[np.ndarray], np.ndarray]


def spread(rows: DataFrame, per_task: int) -> tuple[DataFrame, int]:
    """The rows in as many partitions as hold ``per_task`` rows each, at most one for every slot, and their number."""
    spark = rows.sparkSession
    parts = max(1, min(-(-rows.count() // per_task), spark.sparkContext.defaultParallelism))
    return (rows.coalesce(1) if parts == 1 else rows.repartition(parts)), parts


def drive(learners: list[Generator], summed: Sum, alone: bool = False) -> list:
    """Run learners that yield arrays and go on with their sums, side by side: one exchange serves all that are still at work. Returns what they return.

    ``alone``: there are no other tasks to sum over.
    """
    made: list = [None] * len(learners)
    asked: dict[int, np.ndarray] = {}

    def go_on(k: int, answer: np.ndarray | None) -> None:
        try:
            asked[k] = learners[k].send(answer)
        except StopIteration as end:
            asked.pop(k, None)
            made[k] = end.value

    for k in range(len(learners)):
        go_on(k, None)
        while alone and k in asked:
            go_on(k, asked[k])
    while asked:
        now = sorted(asked.items())
        # Counts are whole numbers under 2^53, exact as doubles.
        total = summed(np.concatenate([x.ravel().astype(np.float64) for _, x in now]))
        for (k, x), part in zip(now, np.split(total, np.cumsum([x.size for _, x in now])[:-1]), strict=True):
            go_on(k, part.reshape(x.shape).astype(x.dtype))
    return made


def at_once(jobs: list[Callable[[], object]], threads: int = 8) -> list:
    """Run Spark jobs side by side from threads of the driver, as long as there are free slots; in the order given."""
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs, chunksize=1)


def in_tasks(rows: DataFrame, parts: int, work: Callable[[pa.Table, Sum, int], bytes | None]) -> bytes:
    """What the first task makes of its rows and the sums over all tasks; ``work(rows, sum, task)`` runs in each.

    Every task must ask for the same sums in the same order.
    """
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext, TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        held = list(batches)
        tab = pa.Table.from_batches(held) if held else to_arrow_schema(schema).empty_table()
        task = TaskContext.get().partitionId()

        def gathered(x: np.ndarray) -> np.ndarray:
            if parts == 1:
                return x
            sent = BarrierTaskContext.get().allGather(base64.b64encode(np.ascontiguousarray(x).tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(m), x.dtype).reshape(x.shape) for m in sent)

        made = work(tab, gathered, task)
        yield pa.RecordBatch.from_arrays([pa.array([made] if task == 0 else [], pa.binary())], ["made"])

    return bytes(rows.mapInArrow(run, "made binary", barrier=parts > 1).collect()[0][0])
