"""Times, files and rows that the tests share."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
BASE_S = int(BASE.timestamp())
US = 1_000_000


def iso(seconds: float) -> str:
    return (BASE + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def ms(seconds: float) -> int:
    return int((BASE_S + seconds) * 1000)


def us(seconds: float) -> int:
    return int((BASE_S + seconds) * US)


def write_jsonl(path: Path, records, tail: str = "") -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    body = "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
    path.write_text(body + tail)
    return path


def rows(df, *columns):
    """Sorted tuples of a small result."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
