"""Places of rows in the files they are read from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_place() -> Column:
    """Place of a row in its file: the start of its split and then its turn in the split,
    whatever the order in which splits are read."""
    turn = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(11,0)")
    return (F.col("_metadata.file_block_start").cast("decimal(19,0)") * F.lit(1 << 33).cast("decimal(11,0)") + turn).cast("decimal(38,0)")
