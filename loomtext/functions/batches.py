"""Arrow-batched functions of texts, for what Column expressions can't say. A null argument gives null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


#: Characters (or items) of texts whose lists are held as Python objects at a time.
HELD = 1 << 18


def _lists(f: Callable[[str], object], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of a batch, put into Arrow memory piece by piece: their objects take some hundred bytes a word."""
    done, held, size = [], [], 0
    for x in texts:
        value = x.as_py()
        held.append(None if value is None else f(value))
        size += len(value or ())
        if size >= HELD:
            done.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, kind)])


def text_udf(f: Callable[[str], object], returns: str):
    """A Column function of one text."""
    if returns.startswith("array<"):
        kind = to_arrow_type(_parse_datatype_string(returns))

        def lists(texts: pa.Array) -> pa.Array:
            return _lists(f, texts, kind)

        return F.arrow_udf(lists, returns)

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in texts], dtype=object)

    return F.pandas_udf(apply, returns)


def pair_udf(f: Callable[[object, object], object], returns: str):
    """A Column function of two values."""

    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(apply, returns)
