"""Small helpers the text operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines end at LF or CRLF; the CR or LF is not part of the line.
LINE_BREAK = re.compile(r"\r?\n")


def one_text(frame: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by its other columns, in their order.

    Rows of a key are told apart before they are worked on, so that no result
    mixes two texts.  The aggregate deals the rows out by key as well, which
    spreads the work whatever the layout of the files.
    """
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(*frame.columns)
