"""Joins with a side whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a side that is broadcast, at most.
MOST_BYTES = 32_000_000


#: Bytes of a row besides its strings.
ROW_BYTES = 64


def small_side(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size, worked out from its rows and its strings' lengths, is small; Spark joins by shuffle beyond.

    Rows are looked at up to the number at which they are too many whatever they hold.
    """
    most = MOST_BYTES // ROW_BYTES
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    held = sum(texts, F.lit(0).cast("long"))
    n_rows, n_bytes = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if n_rows * ROW_BYTES + n_bytes <= MOST_BYTES else df
