"""The three duplicate policies, adjacent repeats, and reading order. One shuffle by key each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def meet(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Rows left-joined to the row of ``table`` that has their key (null equals null); ``count`` tells how many rows a key has.

    A key with more than a quarter of a partition's share of all rows is salted: its rows are dealt,
    by a hash of their values, so that a task that runs again deals alike, over as many parts as it has
    such quarters, and its row of ``table`` is repeated for each. Such keys number four a partition at
    most, so they are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = table.agg(F.greatest(F.lit(1.0), F.sum(count) / (4 * parts)).alias("__share"))
    hot = table.crossJoin(F.broadcast(share)).where(F.col(count) > F.col("__share")).select(F.col(key).alias("__hot"), F.ceil(F.col(count) / F.col("__share")).cast("int").alias("__parts"))
    dealt = lambda df, salt: df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left").withColumn("__salt", salt).drop("__hot", "__parts")
    one = F.coalesce("__parts", F.lit(1))
    values = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    left = dealt(rows, F.pmod(F.xxhash64(*values), one).cast("int"))
    right = dealt(table.drop(count), F.explode(F.sequence(F.lit(0), one - 1))).withColumnsRenamed({key: "__key", "__salt": "__other"})
    return left.join(right, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__other")), "left").drop("__key", "__salt", "__other")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order, nulls last. A grouped minimum, so a hot key is one row per map task."""
    place = F.struct(F.col(order).isNull(), order)
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*df.columns), place).alias("__row")).select("__row.*")


def drop_ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands alone; a repeated key loses all its rows."""
    once = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("__row"))
    return once.where("__n = 1").select("__row.*")


def flag_repeats(df: DataFrame, key: str, flag: str = "duplicate") -> DataFrame:
    """All rows, those of repeated keys flagged; null keys are one key.

    Keys are counted first, from the key column alone and combined on the map side; the counts then
    join back, with hot keys salted.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__n"), (F.count("*") > 1).alias(flag))
    return meet(df, counts, key, "__n").withColumn(flag, F.coalesce(flag, F.lit(False)))


def first_with_hash(df: DataFrame, content: str, order: str) -> DataFrame:
    """Adds the content hash, the first row's order value among equal contents, and whether this is a later copy.

    The first of each hash comes from a grouped minimum, which combines on the map side, and joins
    back with hot hashes salted, so a content shared by a third of all rows makes no large task.
    """
    hashed = df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)
    first = hashed.groupBy("sha256").agg(F.min(order).alias("first"), F.count("*").alias("__n"))
    return meet(hashed, first, "sha256", "__n").withColumn("is_duplicate", F.col(order) != F.col("first"))


def reading_order(df: DataFrame, key: str, y: str = "y_min", x: str = "x_min", height: str = "height", pos: str = "pos") -> DataFrame:
    """Numbers regions in reading order: rows of a tolerance of half the median height, then left to right."""
    w = Window.partitionBy(key)
    tall = F.median(F.when(F.col(height) > 0, F.col(height))).over(w)
    tolerance = F.greatest(F.lit(10.0), F.coalesce(tall * 0.5, F.lit(20.0)))
    df = df.withColumn("__row", F.bround(F.col(y) / tolerance, 0))
    return df.withColumn("reading_order", F.row_number().over(w.orderBy("__row", x, pos))).drop("__row")
