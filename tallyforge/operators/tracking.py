"""Run log: parameters, metrics and tags as long tables appended under Spark's commit protocol."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T

#: Parts of names whose values are never logged, and the caps of one run.
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "authorization", "cookie", "session", "bearer")
MOST_METRICS, LONGEST_VALUE = 500, 500
SCHEMA = "run_id string, kind string, key string, value string, number double, logged_at timestamp"
STATUSES = ("running", "success", "partial", "failed")


def secret_key(name: str) -> bool:
    plain = name.lower().replace("-", "_").replace(" ", "_")
    return any(s in plain for s in SECRET_KEYS)


def redacted(value: object) -> object:
    """A nested value with what secret keys hold masked at any depth, and numbers that are not finite null."""
    if isinstance(value, Mapping):
        return {str(k): "***" if secret_key(str(k)) else redacted(v) for k, v in value.items()}
    if isinstance(value, Sequence) and not isinstance(value, (str, bytes)):
        return [redacted(v) for v in value]
    return None if isinstance(value, float) and (value != value or abs(value) == float("inf")) else value


class RunLog:
    """One run of a long-table log below ``folder``; as a context manager it records success or failure."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "run", run_id: str | None = None):
        self.spark, self.folder, self.run_id, self.metrics = spark, folder, run_id or uuid.uuid4().hex, 0
        self.log_tags({"name": name, "status": "running"})

    def _append(self, kind: str, rows: Mapping[str, object]) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        made = []
        for k, v in rows.items():
            number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(float(v)) < float("inf") else None
            nested = isinstance(v, (Mapping, list, tuple))
            text = json.dumps(redacted(v), ensure_ascii=False, default=str) if nested else str(v)
            made.append((self.run_id, kind, k, "***" if secret_key(k) else None if v is None else text, None if secret_key(k) else number, now))
        df = self.spark.createDataFrame(made, SCHEMA)
        df = df.withColumn("key", T.sanitize_name(F.col("key"))).withColumn("value", T.truncate(T.redact(F.col("value")), LONGEST_VALUE))
        df.write.mode("append").parquet(self.folder)

    def log_params(self, params: Mapping[str, object]) -> None:
        self._append("param", params)

    def log_metrics(self, metrics: Mapping[str, float]) -> None:
        finite = {k: v for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")}
        self.metrics += len(finite)
        if self.metrics > MOST_METRICS:
            raise ValueError(f"a run logs {MOST_METRICS} metrics at most")
        self._append("metric", finite)

    def log_tags(self, tags: Mapping[str, object]) -> None:
        self._append("tag", tags)

    def log_row(self, df: DataFrame, prefix: str = "") -> None:
        """Numeric columns of a one-row table as metrics."""
        row = df.first()
        self.log_metrics({prefix + k: v for k, v in (row.asDict() if row else {}).items() if isinstance(v, (int, float))})

    def end(self, status: str = "success") -> None:
        if status not in STATUSES:
            raise ValueError(status)
        self.log_tags({"status": status})

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, kind, value, trace) -> bool:
        self.end("failed" if kind else "success")
        return False


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's last status, and its parameters and metrics as maps."""
    log = spark.read.schema(SCHEMA).parquet(folder)
    latest = log.groupBy("run_id", "kind", "key").agg(F.max_by("value", "logged_at").alias("value"), F.max_by("number", "logged_at").alias("number"))
    pick = lambda kind, v: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", v))))
    return latest.groupBy("run_id").agg(F.max(F.when((F.col("kind") == "tag") & (F.col("key") == "status"), F.col("value"))).alias("status"), pick("param", "value").alias("params"), pick("metric", "number").alias("metrics"))


def manifest(df: DataFrame, stage: str, ok: Column, value: str) -> DataFrame:
    """Per stage: rows, successful ones, their share, and the mean of a value over them."""
    return df.groupBy(F.col(stage).alias("stage")).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.round(F.try_divide(F.count_if(ok), F.count("*")), 6).alias("success_rate"), F.round(F.avg(F.when(ok, F.col(value))), 2).alias("mean_value"),
    )


def unpivoted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide numeric columns to ``key, value`` rows."""
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "key", "value")
