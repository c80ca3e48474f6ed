"""Evidence about artists: profiles that a text links to a name, videos, and rules replayed over what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text
from ..sources.tables import checkpointed

# ------------------------------------------------------------------ labels and links

URL = r"(?i)https?://[^\s<>\"'()]+"
BLANK = r"^[\s:;,\-–—|]*\z"


def link_labels(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, line, place, label, url: each URL of a text with the label that names it, the text since the URL before it in its line; a URL right after another has the other's label."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line", "_line"))
    lines = lines.where(F.col("_line").rlike(URL)).withColumn("_found", F.regexp_extract_all("_line", F.lit(URL), F.lit(0))).withColumn("_between", F.split("_line", URL, -1))
    rows = lines.select(key, "line", "_between", F.posexplode("_found").alias("place", "_url"))
    own = F.get("_between", F.col("place"))
    # the nearest label at or before the URL that says anything
    named = F.filter(F.slice("_between", 1, F.col("place") + 1), lambda x: ~x.rlike(BLANK))
    label = F.when(own.rlike(BLANK), F.try_element_at(named, F.lit(-1))).otherwise(own)
    return rows.select(key, "line", "place", F.trim(F.regexp_replace(label, r"^[\s:;,.\-–—|]+|[\s:;,\-–—|]+\z", "")).alias("label"), F.regexp_replace("_url", r"[.,;:!?]+\z", "").alias("url"))


def _variants(label: Column) -> Column:
    """What of a label may be the name, the whole first: then without brackets, and what stands before a dash or colon."""
    heads = [F.trim(F.regexp_extract(label, p, 1)) for p in (r"^(.*?)\s*\(", r"^(.*?)\s+[–—-]\s+", r"^(.*?)\s*:")]
    return F.array_distinct(F.filter(F.array(label, *heads), lambda x: F.coalesce(x != "", F.lit(False))))


def paired_profiles(events: DataFrame, key: str = "event_id", artists: str = "artists", text_col: str = "text") -> DataFrame:
    """key, entry, name_key, url, conflict: the profile of each billed name that a text links to it.

    A label names an entry if the keys agree, in the most specific of its forms
    that any entry agrees with; one that agrees with two is none's. conflict is
    entry_not_single_artist, two_handles_same_event, two_handles_same_key (over all
    events) or null. Labels are matched by an equi-join of keys.
    """
    labels = link_labels(events, key, text_col).withColumn("profile", text.profile(F.col("url"))["url"]).where("profile IS NOT NULL")
    forms = labels.select(key, "line", "place", "profile", F.posexplode(_variants(F.col("label"))).alias("form", "_name")).withColumn("name_key", text.artist_key(F.col("_name")))
    billed = events.select(key, F.posexplode(artists).alias("_at", "entry"))
    sides = F.when(F.size(text.split_lineup(F.col("entry"))) > 1, F.concat(F.array("entry"), text.split_lineup(F.col("entry")))).otherwise(F.array("entry"))
    targets = billed.select(key, "_at", "entry", F.explode(sides).alias("part")).withColumn("name_key", text.artist_key(F.col("part"))).where("name_key <> ''")
    met = forms.join(targets, [key, "name_key"])
    at = F.struct("_at", "part")
    by_form = met.groupBy(key, "line", "place", "profile", "form").agg((F.min(at) == F.max(at)).alias("one"), F.min(F.struct("entry", "part", "name_key")).alias("t"))
    best = by_form.groupBy(key, "line", "place", "profile").agg(F.min_by(F.struct("one", "t"), "form").alias("b")).where("b.one")
    # stored, as what is found of a name and what is found of an event would otherwise each read all texts again
    pairs = checkpointed(best.select(key, "b.t.entry", "b.t.part", "b.t.name_key", F.col("profile").alias("url")).distinct())
    here = F.count("*").over(Window.partitionBy(key, "entry", "part"))
    # a key's profiles differ if its least is not its greatest: no set is gathered for a popular name
    every = pairs.groupBy("name_key").agg((F.min("url") != F.max("url")).alias("_differ"))
    out = pairs.withColumn("_here", here).join(every, "name_key")
    conflict = F.when(text.has_weak_separator(F.col("part")), "entry_not_single_artist").when(F.col("_here") > 1, "two_handles_same_event").when(F.col("_differ"), "two_handles_same_key")
    return out.select(key, "entry", "part", "name_key", "url", conflict.alias("conflict"))


# ------------------------------------------------------------------ videos

#: Channels that only show performances, names that are too common for a channel of their own, and what follows a name without making another of it.
TRUSTED = ["boiler room", "tomorrowland", "dgtl", "ukf on air", "hör berlin", "cercle", "mixmag", "keep hush"]
COMMON_NAMES = ["nat", "jersey", "utopia"]
AFTER_NAME = ["b2b", "x", "vs", "ft", "feat", "w", "live", "at"]
#: Wording of titles.
NO_PERFORMANCE = [r"\bpodcasts?\b", r"\bepisodes?\b", r"\bep\b", r"\blp\b", r"\balbums?\b", r"\bearly listen\b", r"\blistening (?:session|party)\b", r"\bradio show\b", r"\bessential mix\b", r"\bguest mix\b", r"\bmixtapes?\b", r"\binterviews?\b", r"\btutorials?\b", r"\bmasterclass\b", r"\bdocumentary\b", r"\bstudio session\b", r"\bin the studio\b", r"\bmaking of\b", r"\bhow i made\b", r"\bbehind the scenes\b", r"\btrack[\s-]by[\s-]track\b", r"\bq\s*&\s*a\b"]
PERFORMANCE = [r"\blive\b", r"\blivestream\b", r"\bset\b", r"\bb2b\b", r"\bboiler room\b", r"\bfestival\b", r"\bconcert\b", r"\bkoncert\b", r"\bperformance\b", r"\bshowcase\b", r"@", r"\bsessions?\b", r"\bdj\b", r"\bdjing\b"]
STOPS = r"\||@|\bat\b|\blive\b|\bdj set\b|\bfestival\b|\bpresents\b|\bfull set\b"
BETWEEN_NAMES = r",|&|(?:\bx\b)|(?:\bvs\.?\b)|(?:\bb2b\b)"
SUPPORTING = r"\b(?:warm(?:ing)?[\s-]?up(?:\s+set)?|opening|support(?:ing)?)\s+for\s*"
MOST_BILLED = 2
_OPEN, _SHUT = r"(^|[^\p{L}\p{N}])", r"(?=[^\p{L}\p{N}]|\z)"


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _pattern(before: str, name: Column, after: str) -> Column:
    return F.concat(F.lit("(?iu)" + before), _quoted(name), F.lit(after))


def billing(title: Column) -> Column:
    """What a title says before the first mark of a place or kind of event, tags in brackets at its front left out."""
    bare = F.regexp_replace(title, r"^\s*(?:[\[(【][^\])】]*[\])】]\s*)+", "")
    return F.regexp_extract(bare, r"(?ius)^(.*?)(?:" + spans.word(STOPS, any_case=False) + r"|\z)", 1)


def billed_names(title: Column) -> Column:
    parts = F.transform(spans.parted(billing(title), spans.word(BETWEEN_NAMES)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def video_checks(name: Column, title: Column, channel: Column) -> dict[str, Column]:
    """What holds of a video for an artist, by the name of the rule that asks for it.

    A pattern made of a name is compiled for every row. So where a name of ASCII stands
    at most once in a title of ASCII, what is before and after it is looked at by fixed patterns.
    """
    name, title, channel = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, title, channel))
    own = (F.lower(channel) == F.lower(name)) & (name != "") & ~F.lower(name).isin(*COMMON_NAMES)
    trusted = F.lower(channel).isin(*TRUSTED)
    ascii_ = lambda c: F.octet_length(c) == F.length(c)
    at = F.position(F.lower(name), F.lower(title))
    known = ascii_(name) & ascii_(title) & (name != "")
    once = known & ((at == 0) | (F.position(F.lower(name), F.lower(title), at + 1) == 0))
    head, tail = F.substr(title, F.lit(1), at - 1), F.substr(title, at + F.length(name))
    opened = (at > 0) & ~head.rlike(r"[\p{L}\p{N}]\z")
    alone = F.when(opened, ~tail.rlike(r"^[\p{L}\p{N}]")).otherwise(False)
    supporting = spans.word(SUPPORTING, any_case=False)
    by_name = lambda plain, pattern: F.when(once, plain).otherwise(pattern)
    bare = by_name(F.when(alone, F.concat(head, F.lit(" "), tail)).otherwise(title), F.regexp_replace(title, _pattern(_OPEN, name, _SHUT), F.lit("$1 ")))
    whole = by_name(
        F.when(alone, ~head.rlike("(?iu)" + supporting + r"\z")).otherwise(False),
        (name != "") & F.rlike(title, _pattern(_OPEN, name, _SHUT)) & ~F.rlike(title, _pattern(supporting, name, _SHUT)),
    )
    token = F.lower(by_name(F.when(opened, F.regexp_extract(tail, r"^ +(\p{L}[\p{L}\p{N}]*)", 1)).otherwise(""), F.call_function("regexp_extract", title, _pattern(_OPEN, name, r" +(\p{L}[\p{L}\p{N}]*)"), F.lit(2))))
    continues = spans.let(token, lambda t: (t == "") | t.isin(*AFTER_NAME) | (t == F.regexp_extract(F.lower(channel), r"^\S*", 0)) | t.rlike(r"\p{N}"))
    begins = lambda p: F.when(known, F.startswith(F.lower(p), F.lower(name)) & ~F.substr(p, F.length(name) + 1).rlike(r"^[\p{L}\p{N}]")).otherwise(F.rlike(p, _pattern("^", name, _SHUT)))
    first = F.when(known & (at == 0), False).otherwise(F.exists(billed_names(title), lambda p: begins(F.regexp_replace(p, r"^[^\p{L}\p{N}]+", ""))))
    return {
        "channel": own | trusted,
        "name": whole,
        "performance": ~bare.rlike(spans.any_of(NO_PERFORMANCE)),
        "cue": F.when(own, bare.rlike(spans.any_of(PERFORMANCE))).otherwise(True),
        "billed": F.size(billed_names(title)) <= MOST_BILLED,
        "continuation": F.when(trusted & ~own, continues).otherwise(True),
        "position": first,
    }


def video_match(name: Column, title: Column, channel: Column) -> Column:
    """struct<accepted, failed>: whether a video is of an artist, and the rules that it fails."""
    failed = F.array_compact(F.array(*[F.when(~ok, rule) for rule, ok in video_checks(name, title, channel).items()]))
    return F.struct((F.size(failed) == 0).alias("accepted"), failed.alias("failed"))


# ------------------------------------------------------------------ replay

#: The most rows of rules: they become part of the plan.
RULES = 1000


def replayed(candidates: DataFrame, rules: list[tuple[int, str, str | None]], alternatives: bool = True) -> DataFrame:
    """artist, version, outcome and, unless told otherwise, alternative: what each version of the rules makes of the video chosen for an artist, over the stored candidates.

    candidates: artist, name, video, title, channel, published, attempt (primary
    or fallback), verified (null: never looked at), chosen (the artist's video),
    match_rule. rules: (version, rule, pattern); a rule is one of video_checks,
    or reject or require with a pattern for the title. Candidates are judged under each
    version by an expression, not a join, and those that fail a rule of every version
    by that rule alone. They are summed up by artist and attempt with a column for each
    version, which becomes a row only then.
    outcome: manual_pin, not_replayable, unchanged, other_candidate_available (the
    newest verified one), needs_fallback_query or would_abstain.
    """
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    checks = video_checks(F.col("name"), F.col("title"), F.col("channel"))
    versions = sorted({v for v, _, _ in rules})
    shared = [r for r in checks if all((v, r) in {(v, r) for v, r, p in rules if not p} for v in versions)]
    asked = {rule for _, rule, pattern in rules if not pattern} - set(shared)

    def passes(version: int) -> Column:
        every = F.lit(True)
        for v, rule, pattern in rules:
            if v == version and rule not in shared:
                met = F.coalesce(F.col("title").rlike(spans.word(pattern)), F.lit(False)) if pattern else None
                every = every & (~met if rule == "reject" else met if rule == "require" else F.col(f"_{rule}"))
        return F.when(F.col("_shared"), every).otherwise(False)

    passed = F.lit(True)
    for rule in reversed(shared):
        passed = F.when(checks[rule], passed).otherwise(False)
    judged = candidates.withColumn("_shared", passed)
    judged = judged.withColumns({f"_{rule}": F.when(F.col("_shared"), checks[rule]).otherwise(False) for rule in sorted(asked)})
    judged = judged.withColumns({f"_ok{i}": passes(v) for i, v in enumerate(versions)})
    mine = F.col("video") == F.col("chosen")
    open_ = lambda i: F.col(f"_ok{i}") & ~F.coalesce(mine, F.lit(False)) & F.coalesce("verified", F.lit(False))
    each = range(len(versions))
    sums = {"mine": F.max(F.when(mine, True))}
    for i in each:
        sums |= {f"ok{i}": F.max(F.when(mine, F.col(f"_ok{i}"))), f"any{i}": F.max(open_(i))}
        if alternatives:
            sums[f"newest{i}"] = F.max(F.when(open_(i), F.struct("published", "video")))
    # match_rule is a key at first: with sums of booleans only, rows are hashed and not sorted
    parts = judged.groupBy("artist", "attempt", "match_rule").agg(*[c.alias(n) for n, c in sums.items()])
    tried = parts.groupBy("artist", "attempt").agg(F.max("match_rule").alias("match_rule"), *[F.max(n).alias(n) for n in sums])
    at_owner = F.when(F.col("mine"), F.col("attempt"))
    g = tried.groupBy("artist").agg(
        F.max("match_rule").alias("match_rule"),
        F.max(at_owner).alias("owner"),
        F.max(F.col("attempt") == "fallback").alias("fallback"),
        *[F.max_by(n, at_owner).alias(n) for n in sums if n != "mine"],
    )

    def outcome(i: int) -> Column:
        o = F.when(F.col("match_rule") == "manual", "manual_pin").when(F.col(f"ok{i}").isNull(), "not_replayable").when(F.col(f"ok{i}"), "unchanged")
        return o.when(F.coalesce(f"any{i}", F.lit(False)), "other_candidate_available").when((F.col("owner") == "primary") & ~F.col("fallback"), "needs_fallback_query").otherwise("would_abstain")

    def row(i: int) -> Column:
        other = [F.when(outcome(i) == "other_candidate_available", F.col(f"newest{i}.video")).alias("alternative")] if alternatives else []
        return F.struct(F.lit(versions[i]).alias("version"), outcome(i).alias("outcome"), *other)

    return g.select("artist", F.explode(F.array(*map(row, each))).alias("_v")).select("artist", "_v.*")


def replay_report(outcomes: DataFrame) -> DataFrame:
    """version, outcome, artists, lost, gained: how many artists have an outcome under a version, and of them those whose video the version before accepted or refused otherwise."""
    before = F.lag("outcome").over(Window.partitionBy("artist").orderBy("version"))
    o = outcomes.withColumn("_before", before)
    lost = (F.col("_before") == "unchanged") & (F.col("outcome") != "unchanged")
    gained = (F.col("_before") != "unchanged") & (F.col("outcome") == "unchanged")
    return o.groupBy("version", "outcome").agg(F.count("*").alias("artists"), F.count_if(lost).alias("lost"), F.count_if(gained).alias("gained"))
