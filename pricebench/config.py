"""Matching configuration (M5) and its fingerprint (Q7)."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, replace

MODES = ("fuzzy-name", "hybrid", "exact-pn", "category")

# The wording of the mode in a dispute-pack summary.
MODE_LABELS = {
    "hybrid": "Hybrid (part-number first",
    "fuzzy-name": "Fuzzy part name",
    "exact-pn": "Exact part number",
    "category": "Category",
}


@dataclass(frozen=True)
class MatchConfig:
    """How lines are grouped into parts and when a spread counts as reliable.

    ``strict_guards`` and ``exclude_review`` are off by default, which follows
    the behaviour to be matched; switching them on applies the grade and basis
    guards to part-number and category groups, and drops lines under review
    from the analytics that otherwise keep them.
    """

    mode: str = "fuzzy-name"
    threshold: float = 0.65
    token_weight: float = 0.6
    same_make: bool = True
    same_model: bool = False
    bridge: bool = False
    sep_grade: bool = True
    sep_side: bool = False
    min_quotes: int = 4
    strict_guards: bool = False
    exclude_review: bool = False
    # Recency and tax: off unless set, and only what is set enters the fingerprint.
    as_of: str | None = None  # ISO date
    window_months: int | None = None
    half_life_months: int | None = None
    ex_gst: bool | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")
        if not 0.0 < self.threshold <= 1.0:
            raise ValueError("threshold must be above 0 and at most 1")
        if not 0.0 <= self.token_weight <= 1.0:
            raise ValueError("token_weight must be between 0 and 1")
        if (self.window_months is not None or self.half_life_months is not None) and self.as_of is None:
            raise ValueError("a window or half-life needs as_of, the day that ages are counted to")
        for name in ("window_months", "half_life_months"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.as_of is not None:
            dt.date.fromisoformat(self.as_of)

    def as_of_date(self) -> dt.date:
        if self.as_of is None:
            raise ValueError("as_of is not set")
        return dt.date.fromisoformat(self.as_of)

    def with_(self, **changes) -> "MatchConfig":
        return replace(self, **changes)

    def fingerprint(self) -> str:
        """Key-sorted hash, so the same settings give the same id anywhere."""
        text = json.dumps({k: v for k, v in asdict(self).items() if v is not None}, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:8]

    def mode_label(self) -> str:
        label = MODE_LABELS[self.mode]
        if self.mode == "hybrid":
            label += ", name bridging ON)" if self.bridge else ", name bridging OFF)"
        return label
