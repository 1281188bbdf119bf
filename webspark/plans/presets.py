"""Settings of a run: plain values on the driver, with checks and presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from ..functions import url as U


@dataclass
class CrawlSettings:
    max_pages: int = 50
    max_depth: int = 3
    max_urls_per_page: int = 20
    max_text_length: int = 10_000
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 50
    allowed_domains: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=lambda: list(U.EXCLUDE_PATTERNS))
    priority_patterns: list[str] = field(default_factory=lambda: list(U.PRIORITY_PATTERNS_V2))
    depth_penalty: float = 0.1
    epsilon: float = 0.1

    def __post_init__(self) -> None:
        if self.max_pages < 1 or self.max_depth < 0:
            raise ValueError("max_pages must be at least 1 and max_depth at least 0")
        if self.chunk_size <= 2 * self.chunk_overlap:
            raise ValueError("chunk_size must be over twice chunk_overlap")

    @classmethod
    def from_json(cls, text: str) -> CrawlSettings:
        """From JSON; unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


def fast() -> CrawlSettings:
    return CrawlSettings(max_pages=10, max_depth=2, max_text_length=5000)


def deep() -> CrawlSettings:
    return CrawlSettings(max_pages=100, max_depth=5, max_text_length=20_000)
