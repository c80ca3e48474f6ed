"""How central electronic music is to an event, from what its text says and in what context.

A contrary genre counts only where it describes the event: not in one of its
artists' names, a comparison, a credit of the past, a proper noun amid a
sentence, or the name of another event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

#: Genres that speak against an electronic night, a family each.
CONTRARY_GENRES = [
    r"\bgrime\b",
    r"\b(?:hip[\s-]?hop|rapper)\b",
    r"\b(?:death|black|thrash|doom|sludge|heavy)[\s-]?metal\b",
    r"\bmetalcore\b",
    r"\bpunk\b",
    r"\b\w*rock\b",
    r"\bjazz\b",
    r"\bfolk\b",
    r"\breggae\b",
    r"\bska\b",
    r"\bchiptune\b",
    r"\bsinger[\s-]?songwriter\b",
    r"\bcomedy\b",
    r"\bstand[\s-]?up\b",
    r"\bbingo\b",
    r"\bquiz\b",
    r"\bgoth(?:ic)?\b",
    r"\bpost[\s-]?punk\b",
    r"\bflamenco\b",
]
#: What an event is when it is no club night.
CONTRARY_CATEGORIES = [
    r"\b(?:speed|quality)[\s-]?dating\b",
    r"\bmakeup\s+masterclass\b",
    r"(?:vin|øl)smagning\b",
    r"\bwine\s+(?:festival|tasting)\b",
    r"\blopp(?:e|er)(?:marked|linda)?\b",
    r"\bkammermusik\w*",
    r"\bchamber\s+music\b",
    r"\b(?:guided\s+)?(?:bike|walking)\s+tour\b",
    r"vandring(?:er)?\b",
    r"\bsoundbath\b",
    r"\bmindful\s+cuddling\b",
    r"\bmusikforedrag\b",
    r"\bmúsica\s+popular\s+brasileira\b",
    r"\(mpb\)",
    r"\bvernissage\b",
    r"\bfernisering\b",
    r"\bgalleriåbning\b",
    r"\bkunstudstilling\b",
    r"\budstillingsåbning\b",
    r"\bforedrag\b",
    r"\bworkshop\b",
    r"\bperformance[\s-]?kunst\b",
]
#: Genres that an electronic act may cross over with. NOT_POP follows no such word.
CROSSOVER_GENRES = [r"\bpop\b", r"\bR&B\b", r"\brnb\b", r"\brhythm\s+and\s+blues\b", r"\bpop[\s-]?musik(?:ken)?\b", r"\bpop[\s-]?sang(?:er(?:inde)?)?\b"]
NOT_POP = "-up"
#: Wording of comparisons, past credits, other events and influences.
COMPARISON = r"\b(?:the way|like|similar to|compared to|reminiscent of|influenced by|inspired by|shaped by|roots?\s+in|cues?\s+from|nods?\s+to|redefined|channels?)\b[^.;!?]{0,40}\z"
PAST_CREDIT = r"\b(?:has (?:played|performed|opened|toured)|played (?:at|with)|performed (?:at|with)|opened for|supported|toured with|previously played|known for playing|kunne(?:\s+\w+){0,2}\s+opleves|har\s+(?:tidligere\s+)?spillet|har\s+(?:tidligere\s+)?optrådt|optrådte|spillede\s+(?:på|til)|tidligere\s+(?:spillet|optrådt))\b"
OTHER_EVENT = r"^[\s-]?(?:event|festival|koncert|show|tour|klub|club)\b\s+[A-ZÆØÅ]"
INFLUENCE_AFTER = r"^[^.;!?]{0,50}?-\s*(?:inspirerede?|inspireret|inspired|influenced|infused|tinget|flavou?red)\b"
#: Claims to a scene, and to an electronic sound; instruments; the word that may be one of them.
CONTRARY_IDENTITY = r"\b(?:grime|hip[\s-]?hop|rap|(?:death|black|thrash|doom|sludge|heavy)?[\s-]?metal|metalcore|punk|rock|jazz|folk|reggae|ska|chiptune)[\s-]?(?:scene|genre)\w*"
ELECTRONIC_CLAIM = r"\b(?:electronic music|electronic sound|electronica|dance music|EDM)\b|\belektronisk[e]?\s+(?:musik\w*|lyd\w*|produktion\w*|scene\w*|kunstner\w*|artist\w*)"
INSTRUMENTS = r"\b(?:trumpet|guitar|bass|drums?|piano|violin|cello|saxophone|clarinet|flute|percussion|vocals?|voice|keys|keyboard|trombone|horns?|strings?|acoustic\s+instruments?)\b"
DRUM_MACHINES = r"\bdrums?\s+machines?"
ELECTRONICS = r"\belectronics?\b"
#: How far a comparison and an instrument are looked for, and how far ahead.
NEAR, AHEAD, FAR_AHEAD = 40, 30, 60
BROAD_MIX = 3
GENERIC_GENRE = "electronic-other"

#: Columns that with_signals adds.
SIGNALS = ["families", "crossover", "contrary_category", "contrary_identity", "electronic_claim", "instruments_only", "contrary", "broad_mix"]

#: Rules that drop a span, of (text, span).
DROPPED = (
    lambda t, s: spans.before(t, s, NEAR).rlike(spans.word(COMPARISON)),
    lambda t, s: spans.sentence_before(t, s).rlike(spans.word(PAST_CREDIT)),
    spans.amid_sentence,
    lambda t, s: spans.after(t, s, AHEAD).rlike(spans.word(OTHER_EVENT, any_case=False)),
)


def _influence(text: Column, span: Column) -> Column:
    return spans.after(text, span, FAR_AHEAD).rlike(spans.word(INFLUENCE_AFTER))


def _pop_up(text: Column, span: Column) -> Column:
    return (F.lower(span["text"]) == "pop") & (F.lower(spans.after(text, span, len(NOT_POP))) == NOT_POP)


def genre_families(masked: Column) -> Column:
    """How many contrary genres a text names of itself."""
    own = F.filter(spans.patterns(CONTRARY_GENRES), lambda p: F.when(F.rlike(masked, p), F.size(spans.kept(masked, p, *DROPPED)) > 0).otherwise(False))
    return F.when(masked.rlike(spans.any_of(CONTRARY_GENRES)), F.size(own)).otherwise(0)


def crossover(masked: Column) -> Column:
    """Whether a text names pop or R&B of itself."""
    own = F.exists(spans.patterns(CROSSOVER_GENRES), lambda p: F.when(F.rlike(masked, p), F.size(spans.kept(masked, p, _pop_up, *DROPPED, _influence)) > 0).otherwise(False))
    return F.when(masked.rlike(spans.any_of(CROSSOVER_GENRES)), own).otherwise(False)


def instruments_only(masked: Column) -> Column:
    """Whether all that is electronic in a text is an instrument beside others."""
    found = spans.spans(masked, F.lit(spans.word(ELECTRONICS)))

    def beside(s: Column) -> Column:
        around = F.concat(spans.before(masked, s, NEAR), s["text"], spans.after(masked, s, NEAR))
        return F.regexp_replace(around, spans.word(DRUM_MACHINES), " ").rlike(spans.word(INSTRUMENTS))

    return (F.size(found) > 0) & F.forall(found, beside)


def with_signals(df: DataFrame, text_col: str, names_col: str) -> DataFrame:
    """Adds families (int) and the booleans contrary, broad_mix, crossover, contrary_category, contrary_identity, electronic_claim and instruments_only."""
    m = F.col("_masked")
    out = df.withColumn("_masked", spans.masked(F.col(text_col), F.col(names_col)))
    out = out.withColumns(
        {
            "families": genre_families(m),
            "crossover": crossover(m),
            "contrary_category": m.rlike(spans.any_of(CONTRARY_CATEGORIES)),
            "contrary_identity": m.rlike(spans.word(CONTRARY_IDENTITY)),
            "electronic_claim": F.coalesce(F.col(text_col).rlike(spans.word(ELECTRONIC_CLAIM)), F.lit(False)),
            "instruments_only": instruments_only(m),
        }
    )
    contrary = (F.col("families") > 0) | F.col("contrary_category")
    return out.withColumns({"contrary": contrary, "broad_mix": F.col("families") >= BROAD_MIX}).drop("_masked")


def assessed(genre: Column, rich: Column, ticketing: Column, artists: Column) -> Column:
    """strong, weak or none, from the columns of with_signals, the genre, whether its evidence is rich, a trusted ticket link and what is known of the artists."""
    specific = F.coalesce(genre != GENERIC_GENRE, F.lit(False))
    direct = specific.cast("int") + F.col("electronic_claim").cast("int")
    indirect = F.when(F.col("crossover") & ~specific, 0).otherwise(ticketing.cast("int") + artists.cast("int"))
    strong = direct + indirect
    outweighed = (strong == 0) | ((strong == 1) & (F.col("contrary_identity") | F.col("broad_mix") | F.col("instruments_only")))
    thin = F.col("crossover") & specific & ~rich
    backed = F.col("electronic_claim") | ticketing | artists
    return (
        F.when(F.col("contrary"), F.when(outweighed, "none").otherwise("weak"))
        .when(thin, F.when(backed, "strong").otherwise("weak"))
        .when(strong > 0, "strong")
        .when(genre.isNotNull(), "weak")
        .otherwise("none")
    )
