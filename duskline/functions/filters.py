"""Explorer filters to and from query parameters, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import genres, time

MODES = ("all", "tonight", "this-weekend", "next-weekend")
MOST_QUERY = 200


@dataclass(frozen=True)
class Filters:
    mode: str = "all"
    genre: str | None = None
    venue: str | None = None
    query: str = ""
    #: A genre parameter that names none, for a message.
    unknown_genre: str | None = None

    def parameters(self) -> dict[str, str]:
        """What differs from the defaults."""
        found = {"mode": self.mode if self.mode != "all" else "", "genre": self.genre, "venue": self.venue, "q": self.query}
        return {k: v for k, v in found.items() if v}


def parse(parameters: dict[str, str]) -> Filters:
    """Unknown modes and malformed venues fall back to the defaults; queries are trimmed and cut."""
    mode, genre, venue = (parameters.get(k) or "" for k in ("mode", "genre", "venue"))
    known = genre if genre in genres.TAXONOMY and genre not in genres.LEGACY or genre in genres.LEGACY_FILTERS else None
    return Filters(
        mode=mode if mode in MODES else "all",
        genre=known,
        venue=venue if re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", venue) else None,
        query=(parameters.get("q") or "").strip()[:MOST_QUERY],
        unknown_genre=genre if genre and known is None else None,
    )


def apply(events: DataFrame, f: Filters, now: Column) -> DataFrame:
    """Events (start, tags, venue_slug, search_text) that pass all filters."""
    night, today = time.night_key(F.col("start")), time.night_key(now)
    friday = time.friday_of(today)
    tests = {"tonight": night == today, "this-weekend": time.in_weekend(night, friday), "next-weekend": time.in_weekend(night, F.date_add(friday, 7))}
    out = events.where(tests[f.mode]) if f.mode in tests else events
    out = out.where(genres.matches(F.col("tags"), f.genre)) if f.genre else out
    out = out.where(F.col("venue_slug") == f.venue) if f.venue else out
    return out.where(F.contains(F.lower("search_text"), F.lit(f.query.lower()))) if f.query else out
