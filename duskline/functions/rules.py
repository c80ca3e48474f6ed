"""Ordered rules over text: genre words, languages, practical sentences, names.

Words end where an ASCII letter, digit or underscore does, whatever stands
beside them in other alphabets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans

B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Patterns in the order in which they are tried, and the genre each stands for.
GENRE_PATTERNS = [
    (rf"{B}hard\s?techno{E}", "hard-techno"),
    (rf"{B}industrial[\s-]?techno{E}", "industrial-techno"),
    (rf"{B}industrial{E}", "industrial"),
    (rf"{B}hypnotic[\s-]?techno{E}", "hypnotic-techno"),
    (rf"{B}melodic\s?techno{E}", "melodic-techno"),
    (rf"{B}minimal\s?techno{E}", "minimal-techno"),
    (rf"{B}techno{E}", "techno"),
    (rf"{B}deep\s?house{E}", "deep-house"),
    (rf"{B}tech\s?house{E}", "tech-house"),
    (rf"{B}progressive\s?house{E}", "progressive-house"),
    (rf"{B}afro\s?house{E}", "afro-house"),
    (rf"{B}house{E}", "house"),
    (rf"{B}psytrance", "psytrance"),
    (rf"{B}psy{E}", "psytrance"),
    (rf"{B}trance{E}(?!-\w)(?!\s+state{E})", "trance"),
    (rf"{B}d\s?&\s?b{E}|drum\s?(and|&)\s?bass{E}|{B}dnb{E}", "drum-and-bass"),
    (rf"{B}breakbeats?{E}|{B}nu[\s-]?sk(?:oo|u)l\s+breaks{E}", "breakbeat"),
    (rf"{B}rawstyle{E}|{B}raw\s+hardstyle{E}", "rawstyle"),
    (rf"{B}hardstyle{E}", "hardstyle"),
    (rf"{B}dubstep{E}", "dubstep"),
    (rf"{B}garage{E}|{B}ukg{E}", "garage"),
    (rf"{B}electro{E}", "electro"),
    (rf"{B}disco{E}", "disco"),
    (rf"{B}ambient{E}", "ambient"),
]
#: Words that tell the languages apart.
DANISH = "og er det til af på med som har vi du der ikke kan vil fra også eller når hvor mere hele dig jer jeres sig sin sit være bliver blev skal her så men nu deres vores kl".split()
ENGLISH = "the and of to in is for with on at this that you your are be will we our from by it as an or all their they have has not but night".split()
#: What sentences of practical information hold.
PRACTICAL = r"(?iu)udsolgt|sold ?out|forsalg|dørsalg|ståplads|siddeplads|handicap|kørestol|wheelchair|ledsager|garderob|ticketmaster|servicecenter|billet|(?<![\p{L}\d])(?:doors?|tickets?|entr[ée]e?|age|tlf|dkk|gratis|free|vip|fees?|kr\.?)(?![\p{L}\d])|aldersgrænse|praktisk info|practical info|kontakt|contact|info@|www\.|https?://|telefon|donation|on sale"


def first_genre(text: Column, patterns: list[tuple[str, str]] = GENRE_PATTERNS) -> Column:
    """The genre of the first pattern that a text matches, quoted spans left out."""
    bare = F.regexp_replace(text, r'"[^"]*"|“[^”]*”', " ")
    return F.coalesce(*[F.when(bare.rlike("(?i)" + p), F.lit(g)) for p, g in patterns])


def all_genres(text: Column) -> Column:
    """array<struct<start, name>> of all genres named that don't overlap one of an earlier rule, by place."""
    return spans.claims(text, GENRE_PATTERNS)


def genre_names_masked(text: Column, names: Column) -> Column:
    """text without those of the names that hold a genre word."""
    telling = "(?iu)" + "|".join(f"(?:{p})" for p, _ in GENRE_PATTERNS)
    return spans.masked(text, F.filter(names, lambda n: n.rlike(telling)))


def language_votes(text: Column) -> tuple[Column, Column]:
    """(Danish, English) function words of a text."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " "), F.lit(r"\p{L}+"), F.lit(0))
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return count(DANISH), count(ENGLISH)


def reads_as_danish(text: Column) -> Column:
    danish, english = language_votes(text)
    return (danish >= 2) & (danish > english)


def clearly_english(text: Column) -> Column:
    danish, english = language_votes(text)
    return (english >= 3) & (danish * 10 <= english)


def practical_only(text: Column) -> Column:
    """Whether every sentence with a letter is about tickets, doors and the like."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[^\d\s][.!?])\s+|\n+"), lambda s: s.rlike(r"\p{L}"))
    return ~F.exists(sentences, lambda s: ~s.rlike(PRACTICAL))


def name_verdict(name: Column) -> Column:
    """artist, cleanable (once brackets or URLs are gone) or not_artist."""
    bad = name.rlike(rf"(?i)^(?:tba|tbc|tbd|special guests?|more|and more|support|line-?up|resident djs?|\W*)$|^.*{B}(?:tickets?|doors?|entry|free entry){E}.*$")
    return F.when(F.coalesce(bad, F.lit(True)), "not_artist").when(name.rlike(r"https?://|\([^)]*\)\s*$|\[[^\]]*\]\s*$"), "cleanable").otherwise("artist")


def appearance_bucket(not_artist: Column, venue: Column, handle: Column, title_copy: Column, marker: Column, weak: Column, short: Column) -> Column:
    """The bucket of an appearance, the first that holds."""
    return F.when(not_artist, "not_artist").when(venue, "venue").when(handle, "handle").when(title_copy & marker, "title_marker").when(marker, "marker").when(weak, "weak_split").when(short, "short").when(title_copy, "title_copy").otherwise("distinct")
