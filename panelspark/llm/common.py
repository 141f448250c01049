"""Reading tables and running Arrow-batched work over whole texts."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelspark.session import stage

#: Rows handled at a time inside a task; a batch of Arrow rows is cut into parts of this size.
PART_ROWS = 128
#: Row numbers that may be broadcast (8 bytes each); beyond it the rows are shuffled to them.
SENT_IDS = 2_000_000
#: Tasks of a Python worker after which it drops the tables that none of them asked for. More than one, as operators that
#: follow each other in a task may take turns in a worker.
UNUSED = 4
#: The calls of each function of ``worker_tables`` as the last task began, and the tasks since then without any.
_TABLES: dict[Callable, list[int]] = {}


def worker_tables(make: Callable) -> Callable:
    """``functools.cache`` for what an operator builds once in a Python worker and does not need after its last task.

    Spark goes on with the same workers for the operators after it, and its tables would be added to theirs.
    """
    cached = functools.cache(make)
    _TABLES[cached] = [0, 0]
    return cached


def drop_unused() -> None:
    """As a task begins: give back the memory of earlier ones, and tables that the last ``UNUSED`` tasks did not ask for."""
    for cached, state in _TABLES.items():
        info = cached.cache_info()
        calls = info.hits + info.misses
        state[:] = [calls, 0 if calls != state[0] else state[1] + 1]
        if info.currsize and state[1] >= UNUSED:
            cached.cache_clear()
            state[:] = [0, 0]
            gc.collect()  # tables and what they remember refer to each other
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: str) -> T.StructField:
    """A nullable field from its SQL type."""
    return T.StructField(name, T._parse_datatype_string(kind))


def map_texts(
    df: DataFrame,
    text: str,
    passed: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[[pa.Array], Sequence]],
) -> DataFrame:
    """``passed`` columns plus new ``fields``, computed from the column ``text`` part by part.

    ``start`` runs once in each task and gives a function from an Arrow array of texts to one column of values
    for each field. Only the named columns travel to Python, a ``text`` that is ``passed`` once; other columns of ``df``,
    whatever their names, do not.
    """
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*passed, *(f.name for f in fields)]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in passed] + list(fields))
    sent = [F.col(c) for c in passed] + [F.col(text).alias("_text")] * (text not in passed)
    at_column = list(passed).index(text) if text in passed else len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unused()
        work = start()
        for batch in batches:
            texts = batch.column(at_column)
            for at in range(0, batch.num_rows, PART_ROWS):
                new = work(texts.slice(at, PART_ROWS))
                new = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, PART_ROWS) for i in range(len(passed))] + new, names)

    return df.select(*sent).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, start: Callable[[], Callable[[pa.Array], Sequence[bool]]]) -> DataFrame:
    """The whole rows of ``df`` for whose text the function that ``start`` gives says True; all columns stay as they are."""
    at_column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unused()
        work = start()
        for batch in batches:
            texts = batch.column(at_column)
            for at in range(0, batch.num_rows, PART_ROWS):
                yield batch.slice(at, PART_ROWS).filter(pa.array(work(texts.slice(at, PART_ROWS)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text without decoding them first."""
    return texts.cast(pa.binary()).to_pylist()


def lists(values: pa.Array, lengths: Sequence[int]) -> pa.Array:
    """A list column from its values laid end to end."""
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def pick(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``column`` is in ``wanted`` (that column, no null, each once), as a broadcast join where ids are few enough.

    Wide rows then stay where they are. The ids to be left out are sent instead where those are fewer.
    """
    wanted = stage(wanted.select(column), "wanted")
    n, left = wanted.count(), rows.count()
    if n <= min(SENT_IDS, left - n):
        return rows.join(F.broadcast(wanted), column, "left_semi")
    if left - n <= SENT_IDS:
        others = stage(rows.select(column).join(wanted.hint("merge"), column, "left_anti"), "others")
        return rows.join(F.broadcast(others), column, "left_anti")
    return rows.join(wanted, column, "left_semi")
