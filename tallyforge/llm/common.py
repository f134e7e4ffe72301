"""Shared helpers of the training-data operators: shared-folder tables and Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR_HINT = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the same package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all nodes share: ``spark.checkpoint.dir``; on a local master, one of our own where unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """``mapInArrow`` over column lists.

    ``make()`` runs once per task and returns ``f(*columns) -> {name: values}``; it gets the input
    columns of one Arrow batch as Python lists.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            # texts are long, so rows go through in slices: memory stays that of a slice
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                made = step(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in out],
                    schema=out,
                )

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, table: DataFrame, key: str, limit: float, count: str = "n") -> DataFrame:
    """Rows joined to the row of ``table`` that has their key; ``count`` tells how many rows a key has.

    Keys of more than ``limit`` rows are broadcast, so their rows stay where they are: with a limit of
    total / (4 x partitions) these are 4 x partitions keys at most. The others meet in a plain join.
    """
    hot, cold = F.broadcast(table.where(F.col(count) > limit).drop(count)), table.where(F.col(count) <= limit).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def hex64(col: Column) -> Column:
    """A signed 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")




_HELD: list = [None, None]


def held(name: tuple, make: Callable[[], object]) -> object:
    """The one large object (model with its cache) that a worker process holds; another name replaces it."""
    if _HELD[0] != name:
        had = _HELD[1] is not None
        _HELD[:] = [None, None]
        if had:
            give_back()
        _HELD[:] = [name, make()]
    return _HELD[1]


def release() -> None:
    """For operators without a large object: those of others go."""
    held((), lambda: None)


def give_back() -> None:
    """Freed memory back to the system; workers live on over stages, and their peaks would add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
