"""Image validation from file headers, and the pluggable image and recogniser hooks."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators.dedup import first_with_hash
from tallyforge.sources.files import IMAGES, mime_type, suffix


def header(raw: bytes) -> tuple[str, int, int, int] | None:
    """Format, width, height and channels from the header of a PNG, JPEG, BMP, TIFF or WebP file; None if unreadable."""
    if not raw:
        return None
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, _, kind = struct.unpack(">IIBB", raw[16:26])
            return "png", w, h, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        if raw[:2] == b"BM":
            w, h, _, bits = struct.unpack("<iiHH", raw[18:30])
            return "bmp", w, abs(h), max(1, bits // 8)
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            if raw[12:16] == b"VP8X":
                return "webp", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little"), 4 if raw[20] & 16 else 3
            if raw[12:16] == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 4
            w, h = struct.unpack("<HH", raw[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF, 3
        if raw[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(raw):
                if raw[at] != 0xFF:
                    return None
                mark = raw[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w, n = struct.unpack(">HHB", raw[at + 5 : at + 10])
                    return "jpeg", w, h, n
                at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
            return None
        if raw[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if raw[:1] == b"I" else ">"
            at = struct.unpack(e + "I", raw[4:8])[0]
            tags = {}
            for i in range(struct.unpack(e + "H", raw[at : at + 2])[0]):
                tag, kind, _, value = struct.unpack(e + "HHI4s", raw[at + 2 + 12 * i : at + 14 + 12 * i])
                tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
            return "tiff", tags[256], tags[257], tags.get(277, 1)
    except (struct.error, KeyError, IndexError):
        return None
    return None


def validate(files: DataFrame, suffixes: tuple[str, ...] = tuple(IMAGES)) -> DataFrame:
    """Per-file validity: readable header, known format, size, duplicates of earlier contents, errors and warnings."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [header(bytes(c) if c is not None else b"") or (None, None, None, None) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "length": frame["length"], "content": frame["content"], **{n: pd.Series([m[i] for m in made], dtype="string" if not i else "Int64") for i, n in enumerate(("format", "width", "height", "channels"))}})

    rows = files.select("path", "length", "content").mapInPandas(probe, "path string, length long, content binary, format string, width int, height int, channels int")
    rows = first_with_hash(rows, "content", "path").withColumnRenamed("first", "duplicate_of")
    known, corrupt, empty = suffix(F.col("path")).isin(*suffixes), F.col("format").isNull(), F.col("length") == 0
    return rows.select(
        "path", suffix(F.col("path")).alias("extension"), mime_type(F.col("path")).alias("mime_type"), F.col("length").alias("file_size_bytes"), "width", "height", "channels",
        F.round(F.col("width") * F.col("height") / 1e6, 4).alias("megapixels"), known.alias("valid_format"), empty.alias("is_empty"), (corrupt & ~empty).alias("is_corrupt"), "is_duplicate",
        F.when(F.col("is_duplicate"), F.col("duplicate_of")).alias("duplicate_of"), "sha256", (known & ~corrupt & ~empty).alias("valid"),
        V.codes((~known, "unsupported_format"), (empty, "empty_file"), (corrupt & ~empty, "corrupt_image")).alias("errors"),
        V.codes((F.col("is_duplicate"), "duplicate_image")).alias("warnings"),
    )


def statistics(validated: DataFrame) -> DataFrame:
    """One row: counts by predicate, validity rate, size, and width and height ranges."""
    sizes = [f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return validated.agg(F.count("*").alias("total"), *(F.count_if(c).alias(c) for c in ("valid", "is_corrupt", "is_empty", "is_duplicate")), F.round(F.try_divide(F.count_if("valid"), F.count("*")), 6).alias("validity_rate"), F.round(F.sum("file_size_bytes") / 1048576, 4).alias("size_mb"), *sizes)


def quality_gate(stats: DataFrame, fail_on_corrupt: bool = True) -> None:
    """Raises on an empty data set, on corrupt files, or if nothing is valid; reads the one-row statistics."""
    row = stats.first()
    if not row["total"]:
        raise ValueError("the data set is empty")
    if fail_on_corrupt and row["is_corrupt"]:
        raise ValueError(f"{row['is_corrupt']} corrupt images")
    if not row["valid"]:
        raise ValueError("no valid image")


def resized(width: int, height: int, target_width: int) -> tuple[int, int]:
    """Size after scaling down to the target width; never up."""
    if width <= target_width:
        return width, height
    return target_width, max(1, round(height * target_width / width))


def order_points(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners as top left, top right, bottom right, bottom left."""
    by_sum, by_gap = sorted(points, key=lambda p: p[0] + p[1]), sorted(points, key=lambda p: p[1] - p[0])
    return [by_sum[0], by_gap[0], by_sum[-1], by_gap[-1]]


#: A codec turns content into (content, notes); a chain of them is the preprocessing of one image.
Step = Callable[[bytes], tuple[bytes, dict]]


def preprocess(files: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """Runs named image steps in order; a failing image becomes a failed row, not a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, raw in zip(frame["path"], frame["content"]):
                body, done, error = bytes(raw), [], None
                try:
                    for name, step in steps.items():
                        body, _ = step(body)
                        done.append(name)
                except Exception as e:  # noqa: BLE001  errors are data here
                    error = f"{type(e).__name__}: {e}"
                out.append((path, None if error else body, "failed" if error else "success", done, [error] if error else []))
            yield pd.DataFrame(out, columns=["path", "content", "status", "steps", "errors"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, status string, steps array<string>, errors array<string>")


REGIONS = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"


def recognise(files: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Text regions of images by a recogniser that ``make`` builds once per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = make()
        for frame in frames:
            out = []
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    out.append((path, recogniser(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "regions", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, regions {REGIONS}, error string")
