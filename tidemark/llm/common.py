"""What the operators share: scratch tables in the cluster's shared folder, and the word pattern."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import drop, materialise, scratch, shared_dir

__all__ = ["WORD", "drop", "give_back", "materialise", "released", "scratch", "shared_dir", "spread_join", "tidy", "words"]

#: A key with more than one in so many of all rows is frequent; at most so many keys are, whatever the input.
SHARES = 20_000

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The array of words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key of `on` once and says in `weight` how many of the `total` rows have it.

    The frequent keys, a bounded number, are broadcast, so that no task gathers the rows of one; the others are shuffled.
    `weight` is not returned; how: inner or left.
    """
    often = F.col(weight) > total // SHARES + 100
    hot, rest = F.broadcast(table.filter(often).drop(weight)), table.filter(~often).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on, how))


#: Megabytes of a worker from which freed memory goes back to the system after a group, and not only after a task.
LARGE_MB = 200


def give_back() -> None:
    """Return memory that Arrow and the C library have freed to the system: an idle worker keeps what it holds, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def released(table: pa.Table) -> pa.Table:
    """A group's result, after a large worker has given freed memory back."""
    pa.default_memory_pool().release_unused()
    try:
        with open("/proc/self/statm") as f:
            large = int(f.read().split()[1]) * 4096 > LARGE_MB << 20
    except OSError:
        large = True
    if large:
        give_back()
    return table


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back when a task's last batch is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
