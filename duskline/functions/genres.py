"""The genre taxonomy, and what is computed from an event's tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "electronic-other"
#: Slug -> (label, parent).
TAXONOMY = {
    "techno": ("Techno", None),
    "hard-techno": ("Hard Techno", "techno"),
    "industrial-techno": ("Industrial Techno", "techno"),
    "hypnotic-techno": ("Hypnotic Techno", "techno"),
    "melodic-techno": ("Melodic Techno", "techno"),
    "minimal-techno": ("Minimal Techno", "techno"),
    "house": ("House", None),
    "deep-house": ("Deep House", "house"),
    "tech-house": ("Tech House", "house"),
    "progressive-house": ("Progressive House", "house"),
    "afro-house": ("Afro House", "house"),
    "disco": ("Disco", None),
    "trance": ("Trance", None),
    "psytrance": ("Psytrance", "trance"),
    "drum-and-bass": ("Drum & Bass", None),
    "jungle": ("Jungle", "drum-and-bass"),
    "breakbeat": ("Breakbeat", None),
    "garage": ("UK Garage", None),
    "dubstep": ("Dubstep", None),
    "hardstyle": ("Hardstyle", None),
    "rawstyle": ("Rawstyle", "hardstyle"),
    "hardcore": ("Hardcore", None),
    "electro": ("Electro", None),
    "industrial": ("Industrial", None),
    "ambient": ("Ambient", None),
    "experimental": ("Experimental", None),
    "electronic-other": ("Electronic / Other", None),
    "ambient-experimental": ("Ambient / Experimental", None),
}
#: Tags that can no longer be chosen, and the tags that they also match.
LEGACY = {"ambient-experimental": ("ambient", "experimental")}
#: Old filter values and the tags they stand for.
LEGACY_FILTERS = {
    "garage-bass": ("garage", "dubstep"),
    "hardstyle-hardcore": ("hardstyle", "rawstyle", "hardcore"),
    "ambient-experimental": ("ambient", "experimental", "ambient-experimental"),
}


def matched_by(selection: str) -> list[str]:
    """The tags that a filter value matches: itself, its subgenres, legacy tags that stand for it."""
    if selection in LEGACY_FILTERS:
        return list(LEGACY_FILTERS[selection])
    return [s for s, (_, parent) in TAXONOMY.items() if s == selection or parent == selection or selection in LEGACY.get(s, ())]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def matches(tags: Column, selection: str) -> Column:
    return F.coalesce(F.arrays_overlap(tags, strings(matched_by(selection))), F.lit(False))


def parent_of(tag: Column) -> Column:
    pairs = [F.lit(x) for s, (_, p) in TAXONOMY.items() if p for x in (s, p)]
    return F.element_at(F.create_map(*pairs), tag)


def label_of(tag: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for s, (label, _) in TAXONOMY.items() for x in (s, label)]), tag)


def with_parents(tags: Column) -> Column:
    """Tags and their parents, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: F.array_compact(F.array(t, parent_of(t))))))


def tags_or_fallback(tags: Column) -> Column:
    unique = F.array_distinct(F.coalesce(tags, strings(())))
    return F.when(F.size(unique) > 0, unique).otherwise(strings([FALLBACK]))


def primary_of(tags: Column) -> Column:
    return F.element_at(tags_or_fallback(tags), 1)


def shown(tags: Column, most: int = 2) -> Column:
    return F.slice(F.array_distinct(tags), 1, most)


def tag_problems(tags: Column, allowed_legacy: Column | None = None) -> Column:
    """Kinds of what is wrong with a list of tags, in the order in which they are reported."""
    known = F.filter(tags, lambda t: t.isin(*TAXONOMY))
    allowed = allowed_legacy if allowed_legacy is not None else strings(())
    each = F.flatten(
        F.transform(
            tags,
            lambda t, i: F.array_compact(
                F.array(
                    F.when(F.array_position(tags, t) < i + 1, "duplicate"),
                    F.when(~t.isin(*TAXONOMY), "unknown").when(t.isin(*LEGACY) & ~F.array_contains(allowed, t), "legacy"),
                )
            ),
        )
    )
    families = F.transform(F.filter(known, lambda t: F.coalesce(F.array_contains(known, parent_of(t)), F.lit(False))), lambda t: F.lit("parent-and-subgenre"))
    combined = F.array_contains(known, FALLBACK) & (F.size(F.array_distinct(tags)) > 1)
    return F.concat(F.when(F.size(tags) > 2, strings(["too-many"])).otherwise(strings(())), each, families, F.when(combined, strings(["fallback-combined"])).otherwise(strings(())))


def fields_mismatch(primary: Column, tags: Column) -> Column:
    """Whether the stored primary genre is not the first tag, or there are no tags."""
    return (F.size(tags) == 0) | ~F.get(tags, F.lit(0)).eqNullSafe(primary)


def lock_group(fields: Column) -> Column:
    """Locking either genre field locks both."""
    both = strings(["primaryGenre", "subgenres"])
    return F.when(F.arrays_overlap(fields, both), F.array_union(fields, both)).otherwise(fields)
