"""Columns computed from texts in Arrow batches, beside columns that pass unchanged.

Columns that aren't computed never become pandas or Python values: ids above 2^53
beside nulls, timestamps and nested values come out as they went in.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from glossia.llm.durable import unused

#: Rows of a batch whose texts are Python strings at one time.
ROWS = 2000
#: From the texts of a batch to the values of each new column.
Work = Callable[[list], Sequence]


def give_back() -> None:
    """What a task has freed goes back to the system; workers stay for the next tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: The module whose work this worker did last.
_last: list[str] = []


def turn_to(owner: str) -> None:
    """Called as a task begins: a worker that turns to another operator forgets what it kept for the last one."""
    if _last and _last[0] != owner:
        forget = getattr(sys.modules.get(_last[0]), "forget", None)
        if forget is not None:
            forget()
            gc.collect()
            give_back()
    _last[:] = [owner]


def small(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have ``ROWS`` rows at most: JVM and worker hold one each for every task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(spark.conf.get(name))
    if not 0 < most <= ROWS:
        spark.conf.set(name, str(ROWS))


def added(df: DataFrame, text: Column | str, fields: str, make: Callable[[], Work], keep: Sequence[str | Column] = ("*",), rows: int = ROWS) -> DataFrame:
    """The columns ``keep`` of ``df``, and new ones of the schema ``fields`` worked out from ``text``.

    A text given by the name of a column that is kept goes to the tasks once. ``rows``
    texts at most are worked on together.
    ``make`` is called once in each task. Rows keep their number and their order.
    """
    new = StructType.fromDDL(fields)
    kept = df.select(*keep)
    schema = StructType([*kept.schema.fields, *new.fields])
    types, names = [to_arrow_type(f.dataType) for f in new.fields], schema.names
    width = len(kept.columns)
    at_text = kept.columns.index(text) if isinstance(text, str) and text in kept.columns else width

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(owner)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(part.column(at_text).to_pylist())
                arrays = [pa.array(values, kind) for values, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names)
                del part, made, arrays
            del batch
        give_back()

    if at_text < width:
        return kept.mapInArrow(run, schema)
    text = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, text.alias(unused(kept, "_text"))).mapInArrow(run, schema)


_PLAIN = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def frame(rows: list[tuple], fields: str) -> pa.RecordBatch:
    """Rows of plain Python values as a batch; ``fields``: names with plain types, comma-separated."""
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _PLAIN[k]) for c, k in zip(columns, kinds, strict=True)], list(names))
