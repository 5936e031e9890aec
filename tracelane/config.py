"""Tunable constants. Every default is a value that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

US = 1_000_000

# Seconds per column of the time grid, finest to coarsest.
ZOOM_WIDTHS = (10, 15, 30, 60, 120, 180, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)


@dataclass(frozen=True)
class Params:
    """Durations are whole seconds unless the name says otherwise."""

    idle_gap: int = 30
    debounce: int = 5
    echo_before: int = 10
    echo_after: int = 1
    slack_start: int = 1
    slack_end: int = 8
    live_within: int = 120
    now_within: int = 60
    min_gap_cols: int = 6
    break_cols: int = 3
    right_margin: int = 3
    widths: tuple[int, ...] = ZOOM_WIDTHS
    home: str = "/home/user"
    tz: str = "UTC"
    temp_roots: tuple[str, ...] = ("/tmp", "/private/tmp")


DEFAULTS = Params()
