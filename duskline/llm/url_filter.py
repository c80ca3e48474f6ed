"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Host: what follows the first :// up to /, ? or #, A-Z lower-cased. Path: what
follows up to ? or #. Without :// (or for null) both are empty. A rule fits its
host and all subdomains, if the path starts with the rule's path; the longest
rule that fits decides. Other URLs get the classifier's verdict. DataFrame
functions only; the classifier is fitted on the driver to a labelled table of
at most MOST_LABELS rows.

n-grams are the windows of three, four and five characters of "^" host "$" and
of "^" path "$"; a window's bucket comes from its code points, host and path
apart. A URL with neither host nor path has the n-grams of the marks alone.

The labelled table is made by rule from two lists of words, those of the usual
categories of host blocklists (gambling, drugs, adult, scams, advertising,
pirated software) and those of ordinary sites, with the same prefixes, suffixes
and endings on both sides, so that the words tell and not their surroundings.
It knows words of those categories and what is spelt like them, and no others.

Repeated rows get equal verdicts; columns named like results are replaced, and a
null id passes through. URLs of any length are read whole; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed_once

#: Rules of the contract: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BUCKETS = 16384
#: Multipliers that mix the code points of a window into a bucket.
MIX = (1009, 9176, 31, 5381, 257)
SIZES = (3, 4, 5)
PATH_SHIFT = 131
MOST_LABELS = 4000
EPOCHS, RATE, DECAY = 120, 5.0, 3e-4
#: A URL is blocked if its score is at least this.
MIN_BLOCK = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table is made of these words: of the categories that blocklists have, and of ordinary sites.
BLOCKED_WORDS = (
    "casino poker roulette jackpot slots betting bookmaker blackjack lottery wager sportsbook bingo baccarat gambling bets gamble "
    "viagra cialis pills pharmacy tablets steroids meds drugstore levitra xanax "
    "porn xxx sexcam escort nude camgirls erotic adult milf hentai hookup sexshop "
    "payday quickloan cashadvance getrich forexsignals doublecoins freemoney replica fakewatch easycash "
    "adserver ads tracker popunder clicktrack adnetwork spam linkfarm backlinks doorway adclick spyware "
    "warez keygen cracked torrent serials pirated"
).split()
ALLOWED_WORDS = (
    "news library school garden thought history science cooking weather stories theatre times museum readers university college hospital council "
    "parish railway bakery orchestra gallery archive journal institute kitchen travel village harbour forest mountain river market insurance health "
    "doctor dentist software programming docs forum wiki photos music festival cinema radio sports football cycling tennis chess charity church recipe "
    "books poetry language dictionary maps transport letters essex sussex wine window winter cast cashew tablet adventure address advice trackfield farm "
    "pillar spanish slow better lotus gardening bookshop porter pottery torrential crackers medicine pharmacology research students family children pets "
    "energy water bridge castle painting sculpture design architecture engineering physics chemistry biology law justice parliament election economy"
).split()
PREFIXES = ["", "the", "best", "online", "free", "top", "live", "my", "city", "super", "national", "cheap", "buy", "win", "daily", "old"]
SUFFIXES = ["", "online", "shop", "store", "club", "hub", "24", "now", "today", "world", "zone", "group", "centre", "x", "deals", "house"]
SUBDOMAINS = ["", "www.", "m.", "blog.", "en."]
ENDINGS = ["com", "net", "io", "example.com", "example.net", "co.uk", "info", "site"]
#: # stands for a number.
NEUTRAL_PATHS = ["/", "/en/#", "/de/#.html", "/fr/#/", "/index.html", "/page/#", "/es/#", ""]
BLOCKED_PATHS = ["/bonus", "/free-spins", "/buy-now/cheap", "/click/track", "/redirect/aff", "/promo/win-cash", "/join-now/xxx", "/download/keygen.exe"]
ALLOWED_PATHS = ["/about", "/articles/2021/05", "/wiki/Main_Page", "/news/story-123.html", "/docs/guide", "/contact", "/category/history", "/opening-hours"]
#: Hosts made of each word, and hosts of invented names among the ordinary ones.
EACH, INVENTED = 14, 1100


ONSETS = "b c d f g h j k l m n p r s t v w th sh ch st tr br gr pl cl fr".split()
CODAS = ["", "n", "r", "st", "nd", "th", "ng", "l", "t", "s", "nt"]


def invented(i: int) -> str:
    """A pronounceable name that a number determines."""
    out, n = "", i * 7919 + 104729
    for _ in range(2 + i % 3):
        out += ONSETS[n % len(ONSETS)] + "aeiou"[n // 31 % 5] + CODAS[n // 155 % len(CODAS)]
        n = n * 31 % 1000003
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table (1: block): each word with prefixes, suffixes, subdomains, endings and paths, dealt out in turn."""
    rows = []

    def add(word: str, label: int, k: int, own: list[str]) -> None:
        prefix, suffix, mark = PREFIXES[k % 16], SUFFIXES[k * 7 // 3 % 16], ["-", ""][k % 2]
        host = mark.join(x for x in (prefix, word, suffix) if x)
        path = own[k // 3 % 8] if k % 3 == 0 else NEUTRAL_PATHS[k // 2 % 8].replace("#", str(len(rows) * 6151 % 99991))
        rows.append((f"https://{SUBDOMAINS[k % 5]}{host}.{ENDINGS[k % 8]}{path}", label))

    for label, words, own in ((1, BLOCKED_WORDS, BLOCKED_PATHS), (0, ALLOWED_WORDS, ALLOWED_PATHS)):
        for i, word in enumerate(words):
            for j in range(EACH):
                add(word, label, i * 5 + j * 3 + j // 4, own)
    for i in range(INVENTED):
        add(invented(i), 0, i, ALLOWED_PATHS)
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones, the first listed."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def buckets_of(host: str, path: str) -> list[int]:
    """The buckets of a URL's n-grams, as gram_buckets gives them."""
    out = []
    for text, shift in ((f"^{host}$", 0), (f"^{path}$", PATH_SHIFT)):
        c = [ord(x) for x in text]
        for size in SIZES:
            out += [(sum(c[i + k] * MIX[k] for k in range(size)) + shift + size) % BUCKETS for i in range(len(c) - size + 1)]
    return out


def code_points(text: Column) -> Column:
    """The code points of a text between its marks, worked out once: the windows look into them."""
    return computed_once(F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda x: F.ascii(x).cast("long")))


def gram_buckets(host: Column, path: Column) -> Column:
    """host, path: columns of code points."""

    def one(code: Column, shift: int) -> list[Column]:
        def gram(size: int) -> Column:
            def mixed(x: Column, i: Column) -> Column:
                total = x * MIX[0]
                for k in range(1, size):
                    total = total + F.get(code, i + k) * MIX[k]
                return (total + (shift + size)) % BUCKETS

            return F.filter(F.transform(code, mixed), lambda x: x.isNotNull())

        return [gram(size) for size in SIZES]

    return F.concat(*one(host, 0), *one(path, PATH_SHIFT))


def split_url(url: str) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    end = min((rest.find(x) for x in "/?#" if x in rest), default=len(rest)) if found else 0
    path = rest[end:] if found else ""
    cut = min((path.find(x) for x in "?#" if x in path), default=len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:cut]


def fit(rows: list[tuple[str, int]]) -> tuple[list[int], int]:
    """Fixed-point (millionths) weights by bucket and bias of a logistic regression over n-gram counts, by gradient steps over all rows."""
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labelled URLs")
    if not rows:
        return [0] * BUCKETS, 0
    x, y = np.zeros((len(rows), BUCKETS), np.float32), np.array([label for _, label in rows], np.float32)
    for i, (url, _) in enumerate(rows):
        np.add.at(x[i], buckets_of(*split_url(url)), 1)
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    weights, bias = np.zeros(len(used), np.float32), np.float32(0)
    for _ in range(EPOCHS):
        miss = (1 / (1 + np.exp(-(x @ weights + bias))) - y) / np.float32(len(rows))
        weights -= RATE * (miss @ x + DECAY * weights)
        bias -= RATE * miss.sum()
    out = np.zeros(BUCKETS, np.int64)
    out[used] = np.round(weights * 1e6)
    return out.tolist(), round(float(bias) * 1e6)


@lru_cache(maxsize=1)
def default_model() -> tuple[list[int], int]:
    return fit(labelled_urls())


def filter_urls(df: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: list[tuple[str, int]] | None = None) -> DataFrame:
    """Adds host, path, rule, score (of the classifier, 1: block) and verdict to df."""
    weights, bias = default_model() if labels is None else fit(labels)
    table = F.from_json(F.lit(str(weights)), "array<long>")
    host, path = host_and_path(F.col(url_col))
    out = df.withColumns({"host": host, "path": path})
    out = out.withColumns({"_host_points": code_points(F.col("host")), "_path_points": code_points(F.col("path"))})
    logit = F.aggregate(gram_buckets(F.col("_host_points"), F.col("_path_points")), F.lit(bias).cast("long"), lambda acc, b: acc + F.get(table, b))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # the long literal of weights comes last, as each step above it is analysed with it
    out = out.withColumns({"rule": rule, "_verdict": verdict}).withColumn("_logit", logit)
    by_score = F.when(F.col("_logit") >= round(1e6 * math.log(MIN_BLOCK / (1 - MIN_BLOCK))), "block").otherwise("allow")
    return out.withColumns({"score": F.round(1 / (1 + F.exp(-F.col("_logit") / 1e6)), 6), "verdict": F.coalesce("_verdict", by_score)}).drop("_verdict", "_logit", "_host_points", "_path_points")


def oracle() -> str:
    """DuckDB SQL for the query over pages."""
    weights, bias = default_model()
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in cases)
    codes = lambda c: f"list_transform(string_split('^' || {c} || '$', ''), lambda x: unicode(x)::BIGINT)"
    one = lambda c, shift, n: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: ({' + '.join(f'{c}[i + {k}] * {MIX[k]}' for k in range(n))} + {shift + n}) % {BUCKETS})"
    grams = ", ".join(one(c, shift, n) for c, shift in (("hc", 0), ("pc", PATH_SHIFT)) for n in SIZES)
    return f"""
WITH model AS (SELECT {weights} AS w),
cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
coded AS (SELECT *, {codes("host")} AS hc, {codes("path")} AS pc FROM parts),
scored AS (SELECT page_id, host, path, {bias} + coalesce(list_sum(list_transform(flatten([{grams}]), lambda b: w[b + 1])), 0) AS logit FROM coded, model)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN logit >= {round(1e6 * math.log(MIN_BLOCK / (1 - MIN_BLOCK)))} THEN 'block' ELSE 'allow' END AS verdict FROM scored
"""


def example_labels(spark: SparkSession) -> DataFrame:
    """The labelled table as a DataFrame."""
    return spark.createDataFrame(labelled_urls(), "url string, label int")
