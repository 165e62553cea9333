"""Options of all profiling entry points."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ProfileOptions:
    """None, zero and negative numbers stand for the default; max_rows 0 is no limit."""

    top_n: int = 5
    max_tracked: int = 10_000
    max_sample_rows: int = 5
    max_rows: int = 0
    schema: str = "public"
    include_comments: bool = False
    sample_size: int = 10_000
    batch_size: int = 1_000  # rows that a database sends at once

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "schema" and not value or isinstance(f.default, int) and not isinstance(f.default, bool) and (value is None or value <= 0):
                object.__setattr__(self, f.name, f.default)
