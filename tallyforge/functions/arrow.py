"""The functions that need Python, as Arrow batches: similarity ratio, exact rounding, nested redaction."""

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts (difflib); null if either is."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def py_round(c: Column, digits: int) -> Column:
    """Rounding of the binary value, as Python does; Spark's ``round`` rounds the decimal text."""

    def exact(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits) if v == v else v)

    return F.pandas_udf(exact, "double")(c)


def redact_json(c: Column) -> Column:
    """JSON text with the values of secret keys masked at any depth and non-finite numbers null; invalid JSON is null."""
    from tallyforge.operators.tracking import redacted

    def masked(x: pd.Series) -> pd.Series:
        out = []
        for raw in x:
            try:
                out.append(None if raw is None else json.dumps(redacted(json.loads(raw)), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(masked, "string")(c)
