"""The HTTP contract, without and with a socket."""

import base64
import json
import threading
import urllib.request

import pytest

from tallyforge.plans.service import Service, serve

LINES = ["STORE: Corner Shop", "DATE 05/01/2024", "TEA 2x10.00", "TOTAL 10.00"]
REGIONS = [{"text": t, "confidence": 0.95, "bbox": [[0, 30 * i], [9, 30 * i], [9, 30 * i + 9], [0, 30 * i + 9]]} for i, t in enumerate(LINES)]


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark, recognise=lambda content: REGIONS)


@pytest.mark.parametrize(
    ("path", "field", "value"),
    [("/health", "model_loaded", True), ("/health", "pipeline_ready", True), ("/health/live", "status", "alive"), ("/health/ready", "status", "ready"), ("/api/info", "success", True), ("/api/pipeline/info", "pipeline", "ReceiptInferencePipeline")],
)
def test_information(service, path, field, value):
    status, body = service.handle("GET", path)
    assert status == 200 and body[field] == value


def test_home_and_missing(service):
    assert "Receipt OCR" in service.handle("GET", "/")[1]
    assert service.handle("GET", "/nowhere")[0] == 404
    assert Service(None).handle("GET", "/health/ready")[0] == 503
    assert "requests_total" in service.handle("GET", "/metrics")[1]


def test_predict(service):
    status, body = service.handle("POST", "/predict", json.dumps({"receipt_id": "r1", "regions": REGIONS}).encode())
    assert status == 200 and body["success"] and body["prediction"]["store_name"] == "Corner Shop"


def test_upload(service):
    send = lambda name, content: service.handle("POST", "/predict/upload", json.dumps({"filename": name, "content": base64.b64encode(content).decode()}).encode())
    assert send("malware.exe", b"x")[0] == 400
    assert send("receipt.jpg", b"")[0] == 400
    status, body = send("shop/receipt.jpg", b"x")
    assert status == 200 and body["receipt_id"] == "receipt" and body["filename"] == "shop/receipt.jpg"


def test_batch(service):
    body = {"receipts": [{"receipt_id": "a", "regions": REGIONS}, {"receipt_id": "b", "regions": []}]}
    status, out = service.handle("POST", "/predict/batch", json.dumps(body).encode())
    assert status == 200 and out["total_requested"] == 2 and {p["receipt_id"] for p in out["predictions"]} == {"a", "b"}
    assert service.handle("POST", "/predict/batch", b'{"receipts": []}')[0] == 400
    assert service.handle("POST", "/predict", b"not json")[0] == 400


def test_socket(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health/live", timeout=20) as answer:
        assert json.load(answer)["status"] == "alive"
    server.shutdown()
