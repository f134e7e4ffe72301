"""HTTP interface to inference, on the standard library.

``Service`` answers (status, body) for a method, a path and a body, so it is testable without a
socket; ``serve`` binds it. A batch is one Spark job over all its receipts.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.sql import SparkSession

from tallyforge.operators import regions
from tallyforge.plans import inference
from tallyforge.sources.files import IMAGES, UPLOAD_LIMIT

VERSION = "1.0.0"
STAGES = ("Image Preprocessing", "OCR", "OCR Text Cleaning", "Field Extraction", "Confidence & Reliability", "JSON Generation")
ENDPOINTS = ("/predict", "/predict/upload", "/predict/batch", "/predict/directory", "/health", "/health/live", "/health/ready", "/metrics", "/api/info", "/api/pipeline/info")


class Service:
    """Inference behind paths. ``recognise`` turns an image into text regions; without one only regions are accepted."""

    def __init__(self, spark: SparkSession | None, recognise: Callable[[bytes], list[dict]] | None = None, config: dict | None = None):
        self.spark, self.recognise, self.config = spark, recognise, config or {}
        self.counts = {"requests": 0, "predictions": 0, "failures": 0}
        self.lock = Lock()

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict | str]:
        with self.lock:
            self.counts["requests"] += 1
        routes = {
            ("GET", "/"): self.home, ("GET", "/health"): self.health, ("GET", "/health/live"): self.live, ("GET", "/health/ready"): self.ready, ("GET", "/api/info"): self.info,
            ("GET", "/api/pipeline/info"): self.pipeline_info, ("GET", "/metrics"): self.metrics, ("POST", "/predict"): self.predict, ("POST", "/predict/upload"): self.upload,
            ("POST", "/predict/batch"): self.batch, ("POST", "/predict/directory"): self.directory,
        }
        known = routes.get((method, path.split("?")[0]))
        if known is None:
            return 404, {"success": False, "error": "not found", "timestamp_utc": now()}
        try:
            return known() if method == "GET" else known(json.loads(body or b"{}"))
        except (ValueError, KeyError, TypeError) as e:
            return 400, {"success": False, "error": str(e), "timestamp_utc": now()}
        except Exception as e:  # noqa: BLE001  the service answers and goes on
            with self.lock:
                self.counts["failures"] += 1
            return 500, {"success": False, "error": f"{type(e).__name__}: {e}", "timestamp_utc": now()}

    @property
    def is_ready(self) -> bool:
        return self.spark is not None

    def home(self):
        return 200, "<html><body><h1>Receipt OCR inference</h1><a href='/health'>health</a></body></html>"

    def health(self):
        return 200, {"status": "healthy" if self.is_ready else "unhealthy", "model_loaded": self.is_ready, "version": VERSION, "pipeline_ready": self.is_ready, "timestamp_utc": now()}

    def live(self):
        return 200, {"status": "alive", "timestamp_utc": now()}

    def ready(self):
        return (200, {"status": "ready", "timestamp_utc": now()}) if self.is_ready else (503, {"status": "not_ready", "reason": "no session", "timestamp_utc": now()})

    def info(self):
        return 200, {"success": True, "service": "receipt inference", "version": VERSION, "description": "Recognised regions to canonical receipt documents.", "pipeline": "ReceiptInferencePipeline", "stages": list(STAGES),
                     "supported_extensions": list(IMAGES), "max_upload_size_mb": UPLOAD_LIMIT // 1048576, "endpoints": list(ENDPOINTS)}

    def pipeline_info(self):
        return 200, {"success": True, "pipeline": "ReceiptInferencePipeline", "supported_extensions": list(IMAGES), "timestamp_utc": now(), **self.config}

    def metrics(self):
        return 200, "".join(f"tallyforge_{k}_total {v}\n" for k, v in self.counts.items())

    def _regions(self, item: dict) -> list[dict]:
        if "regions" in item:
            return item["regions"]
        if self.recognise is None:
            raise ValueError("no recogniser: send regions")
        content = base64.b64decode(item["content"])
        inference.check_upload(item.get("filename", "x.png"), content)
        return self.recognise(content)

    def predict(self, item: dict):
        began = time.perf_counter()
        receipt_id = str(item["receipt_id"])
        out = inference.predict_one(self.spark, receipt_id, self._regions(item))
        with self.lock:
            self.counts["predictions"] += 1
        return 200, {"success": out["status"] == "success", "receipt_id": receipt_id, "prediction": out["prediction"] or {}, "processing_time_ms": round(1000 * (time.perf_counter() - began), 2), "timestamp_utc": now(), "error": None}

    def upload(self, item: dict):
        name, content = item["filename"], base64.b64decode(item.get("content", ""))
        inference.check_upload(name, content)
        status, body = self.predict({"receipt_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "regions": item["regions"] if "regions" in item else self._regions(item)})
        return status, {**body, "filename": name}

    def batch(self, request: dict):
        """All receipts of a request in one plan; duplicate ids keep their first, as everywhere in inference."""
        items = request["receipts"]
        if not items:
            raise ValueError("a batch needs a receipt")
        rows = [(str(x["receipt_id"]), f"{i:09d}", [(r["text"], float(r["confidence"]), [[float(v) for v in p] for p in r.get("bbox") or []]) for r in self._regions(x)]) for i, x in enumerate(items)]
        seen: dict[str, tuple] = {}
        for row in rows:
            seen.setdefault(row[0], row)
        df = self.spark.createDataFrame(list(seen.values()), "receipt_id string, source_file string, regions " + regions.REGION)
        made = [r.asDict(recursive=True) for r in inference.from_regions(df).collect()]  # as many rows as the request has
        good = sum(m["_validation"]["status"] == "passed" for m in made)
        with self.lock:
            self.counts["predictions"] += len(made)
        return 200, {"success": good == len(items), "total_requested": len(items), "total_successful": good, "total_failed": len(items) - good, "predictions": made, "timestamp_utc": now()}

    def directory(self, request: dict):
        """Recognises and predicts a folder of images and writes the documents; answers with counts only."""
        from pyspark.sql import functions as F

        from tallyforge.sources import files, images

        if self.recognise is None:
            raise ValueError("no recogniser")
        hook = self.recognise
        found = files.scan_images(self.spark, request["input_dir"], bool(request.get("recursive", True)))
        read = images.recognise(found, lambda: hook).select(files.stem(F.col("path")).alias("receipt_id"), F.col("path").alias("source_file"), "regions")
        inference.from_regions(read).write.mode("overwrite").json(request["output_dir"])
        n = self.spark.read.json(request["output_dir"]).count()
        return 200, {"success": True, "documents": n, "output_dir": request["output_dir"], "timestamp_utc": now()}


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server bound to the service; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > 2 * UPLOAD_LIMIT:
                status, body = 413, {"success": False, "error": "request too large"}
            else:
                status, body = service.handle(self.command, self.path, self.rfile.read(size))
            raw = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if not isinstance(body, str) else "text/html" if body.startswith("<") else "text/plain")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
