"""Settings of the stages, with the default values of the documented configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cleaning:
    min_text_length: int = 1
    confidence_digits: int = 4


@dataclass(frozen=True)
class Extraction:
    vendor_lines: int = 8
    tail_lines: int = 15
    name_length: tuple[int, int] = (2, 80)
    price_range: tuple[float, float] = (0.0, 1_000_000.0)
    total_keywords: tuple[str, ...] = ("GRAND TOTAL", "TOTAL AMOUNT", "AMOUNT PAYABLE", "NET AMOUNT", "TOTAL DUE", "BALANCE DUE", "TOTAL")


@dataclass(frozen=True)
class Confidence:
    low: float = 0.70
    medium: float = 0.90
    ocr_weight: float = 0.50
    pattern_weight: float = 0.30
    context_weight: float = 0.20
    conflict_penalty: float = 0.15
    count_penalty: float = 0.20
    total_count_penalty: float = 0.10
    absolute_tolerance: float = 1.00
    relative_tolerance: float = 0.05
    digits: int = 4

    def __post_init__(self):
        if abs(self.ocr_weight + self.pattern_weight + self.context_weight - 1) > 1e-6:
            raise ValueError("weights must sum to 1")
        if not 0 <= self.low < self.medium <= 1:
            raise ValueError("thresholds must satisfy 0 <= low < medium <= 1")


@dataclass(frozen=True)
class Financial:
    minimum_confidence: float = 0.70
    exclude_review: bool = True
    require_validation: bool = True
    decimals: int = 2


@dataclass(frozen=True)
class Evaluation:
    amount_tolerance: float = 0.01
    price_tolerance: float = 0.01
    name_similarity: float = 0.80
    date_order: str = "DMY"
    bins: int = 10
    strict_strings: bool = True
    string_threshold: float = 0.95
    max_cer: float = 0.20
    max_wer: float = 0.30
    min_store: float = 0.90
    min_date: float = 0.90
    min_total: float = 0.95
    min_item_f1: float = 0.85
    gates_enabled: bool = True

    def __post_init__(self):
        if self.date_order not in ("DMY", "MDY", "YMD") or not 1 <= self.bins <= 100:
            raise ValueError("date_order is DMY, MDY or YMD; bins 1 to 100")


def load(kind: type, section: dict):
    """Settings of one stage from a configuration section; unknown keys are ignored, lists become tuples."""
    known = {f for f in kind.__dataclass_fields__}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in section.items() if k in known})


def read_yaml(path: str) -> dict:
    """Sections of a YAML file, where a YAML reader is installed."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
