"""Text cleaning: the ordered chain over recognised text, with a log of the steps that changed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import values as V

#: Order matters: each step sees the output of the one before.
STEPS = (
    ("control_character_removal", T.drop_controls),
    ("whitespace_normalization", T.normalize_whitespace),
    ("common_ocr_correction", T.correct_errors),
    ("punctuation_normalization", T.squeeze_punctuation),
    ("currency_normalization", T.strip_currency),
    ("date_normalization", V.normalize_dates),
    ("noise_line_removal", T.drop_noise_lines),
    ("adjacent_duplicate_removal", T.drop_adjacent_repeats),
)


def clean_text(df: DataFrame, column: str, unicode: bool = True, into: str = "cleaned", changes: str = "changes") -> DataFrame:
    """Adds the cleaned text and the tags of the steps that changed it.

    Every step is a column of its own, so each is computed once. ``unicode`` puts NFKC first, the
    only step that leaves generated code.
    """
    names = [f"__{column}_0"]
    df = df.withColumn(names[0], F.col(column))
    steps = (("unicode_normalization", T.nfkc), *STEPS) if unicode else STEPS
    for i, (_, f) in enumerate(steps):
        names.append(f"__{column}_{i + 1}")
        df = df.withColumn(names[-1], f(F.col(names[-2])))
    tags = V.codes(*((F.col(a) != F.col(b), tag) for (tag, _), a, b in zip(steps, names, names[1:])))
    return df.withColumn(into, F.col(names[-1])).withColumn(changes, tags).drop(*names)


def region_extents(bbox: Column) -> Column:
    """Extents of a list of points, as a struct; null for an empty list."""
    xs = F.transform(bbox, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(bbox, lambda p: F.get(p, F.lit(1)))
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    made = F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"), F.greatest(F.lit(0.0), x1 - x0).alias("width"), F.greatest(F.lit(0.0), y1 - y0).alias("height"))
    return F.when(F.size(bbox) > 0, made)


def status(regions_left: Column, text: Column) -> Column:
    """success if any region survives, partial if only the full text does, failed otherwise."""
    return F.when(regions_left > 0, "success").when(F.length(text) > 0, "partial").otherwise("failed")
