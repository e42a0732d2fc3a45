"""Options and limits of a check, and their validation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """Exceeding a limit makes a pair an error row; nothing is ever cut short."""

    max_alignment_pairs: float = 4_000_000
    max_similarity_candidates: float = 1_000_000
    max_similarity_work: float = math.inf
    max_nesting_depth: int = 1024

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or math.isnan(v) or v <= 0:
                raise TypeError(f"{name} must be a positive number")


@dataclass(frozen=True)
class Options:
    selector: str | None = None
    html_profile: str = "generic"
    front_matter: str = "keep"
    strict: bool = False
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if self.selector is not None and not self.selector.strip():
            raise ValueError("selector must not be blank")
        if self.html_profile not in ("generic", "starlight"):
            raise ValueError("html_profile: generic or starlight")
        if self.front_matter not in ("keep", "strip"):
            raise ValueError("front_matter: keep or strip")


def positive_int(name: str, raw: str | None, default: int, most: int = 2**31 - 1) -> int:
    """A whole number from 1 to most, written in digits."""
    if raw is None:
        return default
    if not raw.isascii() or not raw.isdigit() or not 0 < int(raw) <= most:
        raise ValueError(f"{name} must be a whole number from 1 to {most}")
    return int(raw)
