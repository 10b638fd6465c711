"""Two tables that meet in blocks: every block of one side with each block of the other.

A block is copied once for each block of the other side, so what is shuffled follows from the
number of blocks. Blocks are therefore large, and their number is that of a fixed grid until they
are full: up to ``GRID * ROWS`` rows the copies grow in proportion to the rows. A task holds the
rows of two blocks and works through them in slices, whose results it hands on one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a full block.
ROWS = 32_768
#: Blocks of a side that is not large, at most.
GRID = 8
#: Rows of the smallest blocks that are worth a task of their own.
FEWEST = 1024
#: Products that are worked out at a time: a slice of one block's rows with all of the other's.
SLICE = 2_000_000
#: Texts that Python takes out of a batch at a time.
TEXTS = 256


def blocks_of(rows: Column, full: int = ROWS) -> Column:
    """The number of blocks that so many rows are dealt into."""
    grid = F.least(F.lit(GRID), F.ceil(rows / F.lit(FEWEST)))
    return F.greatest(F.lit(1), grid, F.ceil(rows / F.lit(full))).cast("int")


def blocks_for(rows: int, full: int = ROWS) -> int:
    return max(1, min(GRID, -(-rows // FEWEST)), -(-rows // full))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def slices(n_rows: int, n_others: int) -> Iterator[slice]:
    """Slices of ``n_rows`` rows, each of which makes about ``SLICE`` products with the others."""
    step = max(1, SLICE // max(1, n_others))
    return (slice(i, i + step) for i in range(0, n_rows, step))


def meet(left: DataFrame, right: DataFrame, keys: list[str], scan: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], out: str) -> DataFrame:
    """``scan`` of both sides' rows of equal keys, where both have some; it yields its results piece by piece."""
    schema = to_arrow_schema(StructType.fromDDL(out))
    columns = {True: [c for c in left.columns if c not in keys], False: [c for c in right.columns if c not in keys]}

    def run(batches):
        sides: dict[bool, list[pa.Table]] = {True: [], False: []}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for side, mask in ((True, table["__left"]), (False, pc.invert(table["__left"]))):
                part = table.filter(mask).select(columns[side])
                if part.num_rows:
                    sides[side].append(part)
        if sides[True] and sides[False]:
            # A column that one side lacks is null there: the sides are told apart before numbers become floating ones.
            for found in scan(*(pa.concat_tables(sides[side]).to_pandas() for side in (True, False))):
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, schema, preserve_index=False)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    both = left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    return both.groupBy(*keys).applyInArrow(run, out)


def texts_to_rows(docs: DataFrame, id_col: str, value: Column, rows_of: Callable[[list], tuple[list[int], list]], out: str) -> DataFrame:
    """Rows made of each document's value in Python: its id, and what ``rows_of`` makes of some values.

    ``rows_of`` gives the place among the values that each of its rows comes from, and the rows'
    columns. A few documents are taken out of a batch at a time, so that a worker never holds the
    rows of a whole batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"id {kind}, {out}"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                of, columns = rows_of(some.column(1).to_pylist())
                if of:
                    ids = some.column(0).take(pa.array(of, pa.int64())).cast(schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col).alias("id"), value.alias("value")).mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)
