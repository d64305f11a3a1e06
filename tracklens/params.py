"""Report parameters (period, thinning, grid) and fixed constants."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

# --- fixed values that must equal the reference's for equal results ---
MS_TO_MPH = 2.23694          # metres/second -> miles/hour
EARTH_RADIUS_M = 6371010.0   # spherical earth used for step distances
TIMELINE_BIN_MINUTES = 5
PAGE_MAX_TRACKS = 500        # the report page's own cap
DEFAULT_THIN_INTERVAL_MS = 100
DEFAULT_MIN_DISTANCE_M = 1
DEFAULT_PRECISION = 5
DEFAULT_MIN_POINTS = 1
DEFAULT_HEX_RADIUS_M = 10
TRAIL_LENGTH_MS = 180000
PLAYBACK_STEP_MS = 5000
FREIGHT_ZONE = "freight_yard"
FALLBACK_HOURS = 24
PLAIN_INSTANT = r"(?P<time>\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})(?P<zone>Z?)"
SLUG_PATTERN = r"^[a-z][a-z0-9_-]{0,62}$"
# ----------------------------------------------------------------------


def _parse_instant(text: str) -> datetime:
    """Parse an ISO-8601 period bound to a naive UTC datetime."""
    t = text.strip()
    if t.endswith("Z"):
        t = t[:-1] + "+00:00"
    dt = datetime.fromisoformat(t)
    if dt.tzinfo is not None:
        dt = dt.astimezone(timezone.utc).replace(tzinfo=None)
    return dt


@dataclass(frozen=True)
class Period:
    """Closed reporting period ``[start, end]`` (UTC).

    ``end_inclusive=False`` gives the half-open ``[start, end)`` variant so
    that back-to-back daily reports do not share the midnight rows.
    """

    start: str
    end: str
    end_inclusive: bool = True

    @property
    def start_dt(self) -> datetime:
        return _parse_instant(self.start)

    @property
    def end_dt(self) -> datetime:
        return _parse_instant(self.end)

    def hours(self) -> float:
        """Length of the period in hours, one at least.

        A period whose bounds are not both written to the second, with the
        same ending (``Z`` or none), counts as a whole day.
        """
        bounds = [re.fullmatch(PLAIN_INSTANT, text) for text in (self.start, self.end)]
        if not all(bounds) or bounds[0]["zone"] != bounds[1]["zone"]:
            return FALLBACK_HOURS
        try:
            start, end = (datetime(*map(int, re.findall(r"\d+", m["time"]))) for m in bounds)
        except ValueError:  # no such day or time
            return FALLBACK_HOURS
        return max(1, (end - start) / timedelta(hours=1))

    def browser_hours(self) -> float:
        """Period length as the report page computes it (any ISO layout)."""
        delta = (self.end_dt - self.start_dt).total_seconds() / 3600
        return max(delta, 1)

    def slug(self) -> str:
        """``{startdate}_to_{enddate}`` used as the snapshot folder name."""
        return f"{self.start.split('T')[0]}_to_{self.end.split('T')[0]}"


@dataclass(frozen=True)
class ThinParams:
    """Map-track thinning: time bucket and minimum step; ``max_tracks`` keeps the tracks seen first, all if None."""

    max_tracks: int | None = None
    interval_ms: int = DEFAULT_THIN_INTERVAL_MS
    min_distance_m: float = DEFAULT_MIN_DISTANCE_M
    # Rows of one track are processed in time chunks of about this span so
    # that a single very long track never lands in one task.
    chunk_ms: int = 3_600_000


def validate_slug(org: str) -> str:
    if not isinstance(org, str) or not re.match(SLUG_PATTERN, org):
        raise ValueError(f"invalid org_subdomain {org!r}")
    return org
