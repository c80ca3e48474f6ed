"""Rules over videos: what fixed patterns say beside a name is what patterns made of the name say, and candidates are summed before versions are made of them."""

import itertools

from pyspark.sql import functions as F

from duskline.functions import spans
from duskline.operators import evidence

NAMES = ["Ann", "ann lee", "a b a", "A.B", r"x\Ey", "", " Ann ", "Øl", "K", "utopia", "(Ann)", None]
FRAMES = ["{0} live at Hall", "x{0} {0}", "{0}", "[SET] {0} b2b x", "warm up set for {0}", "warm up forx{0}", "{0}b", "{0} Riding, A & B", "Hall | {0} dj set", "A x {0} x B", "x{0} b a", "é {0} é", "{0}\x01a x {0}", "support for {0}", "{0}9", "(({0})) B9", "@{0}", "K {0}", "else", "", None]
CHANNELS = ["Ann", "Boiler Room", "\tA b", "fan", None]


def by_patterns(name, title, channel):
    """The checks by patterns that are made of the name."""
    name, title, channel = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, title, channel))
    shut, opened, pattern = evidence._SHUT, evidence._OPEN, evidence._pattern
    own = (F.lower(channel) == F.lower(name)) & (name != "") & ~F.lower(name).isin(*evidence.COMMON_NAMES)
    trusted = F.lower(channel).isin(*evidence.TRUSTED)
    bare = F.regexp_replace(title, pattern(opened, name, shut), F.lit("$1 "))
    token = F.lower(F.call_function("regexp_extract", title, pattern(opened, name, r" +(\p{L}[\p{L}\p{N}]*)"), F.lit(2)))
    continues = (token == "") | token.isin(*evidence.AFTER_NAME) | (token == F.get(F.split(F.lower(channel), r"\s+"), F.lit(0))) | token.rlike(r"\p{N}")
    tagless = F.regexp_replace(title, r"^\s*(?:[\[(【][^\])】]*[\])】]\s*)+", "")
    billing = F.get(F.split(tagless, spans.word(evidence.STOPS), 2), F.lit(0))
    names = F.filter(F.transform(F.split(billing, spans.word(evidence.BETWEEN_NAMES)), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "channel": own | trusted,
        "name": (name != "") & F.rlike(title, pattern(opened, name, shut)) & ~F.rlike(title, pattern(spans.word(evidence.SUPPORTING, any_case=False), name, shut)),
        "performance": ~bare.rlike(spans.any_of(evidence.NO_PERFORMANCE)),
        "cue": ~own | bare.rlike(spans.any_of(evidence.PERFORMANCE)),
        "billed": F.size(names) <= evidence.MOST_BILLED,
        "continuation": ~trusted | own | continues,
        "position": F.exists(names, lambda p: F.rlike(F.regexp_replace(p, r"^[^\p{L}\p{N}]+", ""), pattern("^", name, shut))),
    }


def test_checks_are_those_of_patterns_made_of_the_name(spark):
    rows = [(n, None if f is None else f.format(case(n or "Ann")), c) for n, f, c, case in itertools.product(NAMES, FRAMES, CHANNELS, (str, str.upper))]
    df = spark.createDataFrame(rows, "n string, t string, c string").repartition(4)
    cols = (F.col("n"), F.col("t"), F.col("c"))
    got = [f(*cols) for f in (evidence.video_checks, by_patterns)]
    other = df.select(*cols, *[F.array(*[g[k] for g in got]).alias(k) for k in got[0]])
    differ = other.where(" OR ".join(f"{k}[0] IS DISTINCT FROM {k}[1]" for k in got[0]))
    assert [r.asDict() for r in differ.limit(3).collect()] == []


def test_candidates_are_summed_before_versions_are_made(spark):
    rows = [("a", "Ann", 1, "Ann live", "Ann", 1, "primary", True, 1, "A"), ("a", "Ann", 2, "Ann set", "Ann", 2, "fallback", True, 1, "B"), ("a", "Ann", 3, "Ann dj", "Ann", 3, "primary", True, 1, "A"), ("a", "Ann", 4, "Ann dj", "Ann", None, "primary", True, 1, "A")]
    df = spark.createDataFrame(rows, "artist string, name string, video long, title string, channel string, published int, attempt string, verified boolean, chosen long, match_rule string")
    rules = [(1, "name", None), (2, "name", None), (2, "reject", r"\blive\b")]
    out = evidence.replayed(df, rules)
    assert {tuple(r) for r in out.collect()} == {("a", 1, "unchanged", None), ("a", 2, "other_candidate_available", 3)}
    short = evidence.replayed(df, rules, alternatives=False)
    assert {tuple(r) for r in short.collect()} == {("a", 1, "unchanged"), ("a", 2, "other_candidate_available")}
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Aggregate")
    # the first sums are over all candidates: hashed, not sorted
    assert "HashAggregate(keys=[artist" in short._jdf.queryExecution().executedPlan().toString()
