"""Sources and sinks: JSON document folders, images, archives, hashes, and table outputs."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accepted image suffixes and their MIME types.
IMAGES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}
UPLOAD_LIMIT = 25 * 1024 * 1024


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mime_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in IMAGES.items() for x in kv])
    return F.try_element_at(kinds, suffix(path))


def scan_images(spark: SparkSession, folder: str, recursive: bool = True, suffixes: Iterable[str] = tuple(IMAGES)) -> DataFrame:
    """Image files below a folder with path, length and content. Spark's file source skips files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return raw.where(suffix(F.col("path")).isin(*suffixes)).withColumn("receipt_id", stem(F.col("path")))


def parsed(df: DataFrame, raw: str, schema: StructType) -> DataFrame:
    """Columns of ``schema`` from JSON texts; a malformed or non-object text is null in all and stands whole in ``_corrupt``."""
    full = StructType([*schema.fields]).add("_corrupt", "string")
    made = F.from_json(raw, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    held = df.withColumn("__parsed", F.when(F.json_object_keys(raw).isNotNull(), made))
    broken = F.col("__parsed").isNull() | F.col("__parsed._corrupt").isNotNull()
    return held.select(*(F.col(c) for c in df.columns if c != raw), *(F.when(~broken, F.col(f"__parsed.{f.name}")).alias(f.name) for f in schema.fields), F.when(broken, F.col(raw)).alias("_corrupt"))


def texts(spark: SparkSession, folder: str, excluded: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """One row per JSON file: ``source_file`` and its whole text; manifests are excluded by name."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json")
    out = read.text(folder).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))
    names = [n for n in excluded]
    return out.where(~F.element_at(F.split("source_file", "/"), -1).isin(*names)) if names else out


def scan_json(spark: SparkSession, folder: str, schema: StructType, excluded: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """One row per JSON document; a malformed or non-object file becomes a row with ``_corrupt``.

    ``source_file`` is the ordering key of the duplicate policies.
    """
    return parsed(texts(spark, folder, excluded, recursive), "raw", schema)


def keyed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the top-level keys of JSON texts, and whether the text is no object at all."""
    return df.withColumn("keys", F.json_object_keys(raw)).withColumn("load_failed", F.col("keys").isNull())


def present(*names: str) -> list[Column]:
    """Whether each name is a key, after ``keyed``; a null value is present."""
    return [F.coalesce(F.array_contains("keys", n), F.lit(False)) for n in names]


def first_given(raw: str, *paths: str) -> Column:
    """The value at the first path that has one, as text."""
    return F.coalesce(*(F.get_json_object(raw, f"$.{p}") for p in paths))


def scan_documents(spark: SparkSession, folder: str, excluded: Iterable[str] = ()) -> DataFrame:
    """Raw JSON texts with their top-level keys, where absent, null and wrong type must be told apart."""
    return keyed(texts(spark, folder, excluded))


#: Keys that a canonical document must have.
REQUIRED = ("store_name", "date", "items", "total_amount", "overall_confidence", "reliability", "review_required", "metadata")


def financial_input(docs: DataFrame) -> DataFrame:
    """Input of the financial summary from raw canonical documents, with codes for what is absent or of a wrong type."""
    get = lambda p: F.get_json_object("raw", f"$.{p}")
    v = F.try_parse_json("raw")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant"))
    missing = F.transform(F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.array_contains("keys", k)), lambda k: F.concat(F.lit("missing_required_field:"), k))
    wrong = kind("total_amount").isin("BOOLEAN") | kind("total_amount").startswith("OBJECT") | kind("total_amount").startswith("ARRAY") | (~kind("items").startswith("ARRAY") & get("items").isNotNull()) | ~kind("store_name").isin("STRING", "VOID")
    schema = F.when(F.coalesce(wrong, F.lit(False)), F.array(F.lit("schema_invalid"))).otherwise(F.array().cast("array<string>"))
    rid = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in (get("metadata.receipt_id"), get("receipt_id"))), stem(F.col("source_file")))
    return docs.where(~F.col("load_failed")).select(
        rid.alias("receipt_id"), "source_file", get("store_name").alias("store_name"), get("date").alias("date"), get("total_amount").alias("total_amount"), get("overall_confidence").alias("overall_confidence"),
        get("review_required").alias("review_required"), get("_validation.status").alias("validation_status"), F.concat(missing, schema).alias("malformed"),
    )


def unzip(archives: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Members of zip archives as rows ``path, member, length, content, error``.

    A member that leaves the archive's root is an error row without content; so is an unreadable or
    empty archive. Members stream one by one.
    """

    def read(frames):
        import io
        import posixpath
        import zipfile

        for frame in frames:
            for name, raw in zip(frame[path], frame[content]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                        if not members:
                            yield pd.DataFrame({"path": [name], "member": [None], "length": [0], "content": [None], "error": ["empty_archive"]})
                        for m in members:
                            clean = posixpath.normpath(m.filename)
                            bad = clean.startswith(("/", "..")) or ":" in clean.split("/")[0]
                            body = None if bad else z.read(m)
                            yield pd.DataFrame({"path": [name], "member": [m.filename], "length": [m.file_size], "content": [body], "error": ["unsafe_member" if bad else None]})
                except (zipfile.BadZipFile, EOFError, OSError) as e:
                    yield pd.DataFrame({"path": [name], "member": [None], "length": [0], "content": [None], "error": [type(e).__name__]})

    return archives.select(path, content).mapInPandas(read, "path string, member string, length long, content binary, error string")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def fingerprint(df: DataFrame, content: str, order: str, levels: int = 3) -> DataFrame:
    """One digest of a whole table, as a tree: a node hashes at most a thousand children in order.

    Leaves are row hashes; the nodes above them are ranges of a thousand, a million and so on of the
    ``order`` values, so the digest depends on content and order, not on partitions, and no task
    gathers more than a thousand digests (of dense order values).
    """
    rows = df.select(F.col(order).alias("o"), F.coalesce(content_hash(F.col(content)), F.lit("")).alias("h"), F.lit(1).alias("n"))
    for _ in range(levels):
        nodes = rows.groupBy(F.floor(F.col("o") / 1000).alias("up")).agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("hs"), F.sum("n").alias("n"))
        rows = nodes.select(F.col("up").alias("o"), F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256).alias("h"), "n")
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("hs"), F.sum("n").alias("n_rows"))
    return whole.select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256).alias("fingerprint"))


def write_json(df: DataFrame, folder: str, overwrite: bool = True) -> None:
    """JSON lines under Spark's commit protocol: all or nothing."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(folder)


def write_csv(df: DataFrame, folder: str, overwrite: bool = True, single: bool = False) -> None:
    """CSV with header; a single file only where the caller knows the table to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(folder)


def write_documents(df: DataFrame, folder: str, key: str = "receipt_id", buckets: int = 256) -> None:
    """Documents partitioned by a bucket of their key, so one key is found by reading one bucket."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").json(folder)
