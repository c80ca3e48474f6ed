"""Names, titles and URLs in the form in which they are compared.

Unicode decomposition has no built-in function, so names that are not ASCII go
through one Arrow function; ASCII ones never leave the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import let

#: Title words that tell no event from another.
GENERIC_TITLE_WORDS = (
    "black red box boxes room stage hall floor techno house electronic electro melodic hard deep party showcase club rave raves festival gig "
    "night nights session sessions edition vol volume presents present live dj djs afterparty after special guest guests selects selecta collective "
    "the and w x b2b ft feat featuring"
).split()
#: Query parameters that only track.
TRACKING_PARAMETERS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "affiliate", "igshid"]
#: Words of ASCII letters and digits, one space apart, as most names are: nothing is to be taken away from these.
_PLAIN = r"^[A-Za-z0-9]+(?: [A-Za-z0-9]+)*+\z"


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def squeezed(text: Column) -> Column:
    # single spaces, most of all white space, are no matches
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def plain_name(decomposed: Column) -> Column:
    """Lower case letters, digits and single spaces of a decomposed name: venues and titles."""
    return F.when(decomposed.rlike(_PLAIN), F.lower(decomposed)).otherwise(squeezed(F.regexp_replace(F.lower(decomposed), r"[^a-z0-9\s]", "")))


def slug(decomposed: Column) -> Column:
    marked = F.replace(F.lower(F.regexp_replace(decomposed, r"[̀-ͯ]", "")), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_url_noise(name: Column) -> Column:
    """A name without zero-width characters, URLs and the separators they leave."""
    bare = F.regexp_replace(name, r"[​-‏⁠﻿]", "")
    bare = F.regexp_replace(bare, r"(?i)https?://\S+", "")
    bare = F.regexp_replace(bare, r"(?i)(?<![A-Za-z0-9_])(?:www\.)?[a-z0-9-]+\.(?:com|dk|net|org|io|co|uk|fm|ly)/\S*", "")
    bare = F.trim(F.regexp_replace(bare, r"[ \t]{2,}", " "))
    before, after = F.regexp_extract(bare, r"^(.*?):\s*-\s*(.+)$", 1), F.regexp_extract(bare, r"^(.*?):\s*-\s*(.+)$", 2)
    repeated = (after != "") & F.endswith(squeezed(F.lower(before)), squeezed(F.lower(after)))
    bare = F.when(repeated, F.trim(before)).otherwise(bare)
    return F.trim(F.regexp_replace(bare, r"^[\s:;,|–—-]+|[\s:;,|–—-]+$", ""))


def artist_key(name: Column) -> Column:
    """The form in which line-up names are compared; of a decomposed name. Combining marks stay."""
    return F.when(name.rlike(_PLAIN), F.lower(name)).otherwise(squeezed(F.lower(F.regexp_replace(without_url_noise(name), r"\s*\([^)]*\)\s*$", ""))))


def cache_key(name: Column) -> Column:
    """The second form, of the artist cache: trimmed, lower case, single spaces."""
    return squeezed(F.lower(name))


def search_name(name: Column) -> Column:
    """A name without its trailing brackets, unless nothing else is left."""
    bare = F.trim(F.regexp_replace(name, r"(\s*[(\[][^)\]]*[)\]])+\s*$", ""))
    return F.when(bare == "", F.trim(name)).otherwise(bare)


def title_words(plain: Column) -> Column:
    """The words of a plain title that tell it from others."""
    # array_except would hash all generic words for each row
    return F.array_distinct(F.filter(F.split(plain, " "), lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC_TITLE_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other holds; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def lineup_keys(names: Column) -> Column:
    keys = F.array_distinct(F.transform(names, artist_key))
    return F.filter(keys, lambda k: (k != "") & (k != "tba"))


def first_spellings(names: Column) -> Column:
    """Names cleaned of URL noise, the first spelling of each key, in order."""
    clean = F.filter(F.transform(names, without_url_noise), lambda n: (n != "") & (artist_key(n) != ""))
    return F.filter(clean, lambda n, i: F.array_position(F.transform(clean, artist_key), artist_key(n)) == i + 1)


def normal_url(url: Column) -> Column:
    """https, no www., no tracking parameters, parameters sorted, no closing slashes, fragment kept; text that is no URL is only trimmed."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    scheme = r"^[a-zA-Z][\w+.-]*://"

    def ordered(base: Column) -> Column:
        kept = F.filter(F.split(F.regexp_extract(base, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*TRACKING_PARAMETERS))
        return F.array_join(F.sort_array(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")

    def parts(base: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(base, scheme + "([^/?]+)", 1)), r"^www\.", "")
        path = F.regexp_replace(F.regexp_extract(base, scheme + "[^/?]+([^?]*)", 1), "/+$", "")
        return F.struct(host.alias("host"), path.alias("path"), ordered(base).alias("query"))

    def normal(text: Column, v: Column) -> Column:
        fragment = F.when(F.instr(text, "#") > 0, F.substr(text, F.instr(text, "#") + 1)).otherwise("")
        whole = F.concat(F.lit("https://"), v["host"], F.when(v["path"] == "", "/").otherwise(v["path"]), F.when(v["query"] == "", "").otherwise(F.concat(F.lit("?"), v["query"])), F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)))
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(v["host"] == "", text).otherwise(whole)

    return let(F.trim(url), lambda text: let(let(F.substring_index(text, "#", 1), parts), lambda v: normal(text, v)))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_host(url: Column, domain: str) -> Column:
    """Whether a URL is on a domain or one below it."""
    host = host_of(url)
    return F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False))


def valid_email(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def valid_url(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)^https?://[^\s/?#]+\S*$"), F.lit(False))


#: Paths of a profile host that are no profiles.
RESERVED_PROFILES = ["discover", "search", "you", "upload", "pages", "terms-of-use"]


def profile(link: Column) -> Column:
    """struct<url, rejected>: a link as an artist's profile in normal form, or why it is none."""
    bare = F.trim(F.coalesce(link, F.lit("")))
    handle = F.lower(F.regexp_extract(bare, r"(?i)^https?://(?:www\.|m\.)?soundcloud\.com/([\w-]+)/?(?:[?#].*)?$", 1))
    why = F.when(bare == "", "empty").when(~F.contains(F.lower(bare), F.lit("soundcloud.com")), "other-host").when(handle == "", "not-a-profile").when(handle.isin(*RESERVED_PROFILES), "reserved")
    return F.struct(F.when(why.isNull(), F.concat(F.lit("https://soundcloud.com/"), handle)).alias("url"), why.alias("rejected"))


def shortened(text: Column, most: int = 400) -> Column:
    """White space collapsed, at most so many characters and an ellipsis."""
    flat = squeezed(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def at_boundary(text: Column, most: int) -> Column:
    """Cut at the last sentence end within the limit, or else the last word end."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    cut = F.when(F.length(sentence) >= most // 2, sentence).when(word != "", word).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def lowest_price(text: Column) -> Column:
    """The lowest price in kroner that a text names."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(\d{1,5})(?:[.,]\d{2})?\s*(?:kr\.?|dkk)"), F.lit(1))
    return F.array_min(F.transform(found, lambda x: x.cast("int")))


def split_lineup(entry: Column) -> Column:
    """Names joined by back-to-back marks, apart."""
    return F.filter(F.transform(F.split(entry, r"(?i)\s+(?:b2b|b3b|vs\.?)\s+"), lambda x: F.trim(x)), lambda x: x != "")


def has_weak_separator(entry: Column) -> Column:
    return F.coalesce(entry.rlike(r"(?i)\s(?:&|and|x|\+|feat\.?|ft\.?)\s|,"), F.lit(False))


def title_cased(name: Column) -> Column:
    """Words of names written in one case get a capital each; mixed ones stay."""
    one_case = (name == F.upper(name)) | (name == F.lower(name))
    words = F.transform(F.split(name, " "), lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.when(one_case, F.array_join(words, " ")).otherwise(name)


def names_in_title(title: Column, names: Column) -> Column:
    """How many names the title holds."""
    return F.size(F.filter(names, lambda n: F.contains(F.lower(title), F.lower(n))))


def html_text(html: Column) -> Column:
    """The text of HTML: no scripts, styles or comments; blocks on lines of their own, paragraphs apart; common entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)</p\s*>|<p\b[^>]*>", "\n\n")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>|</?(?:div|li|ul|ol|h[1-6]|tr|article|section|nav|header|footer)\b[^>]*>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]*>", "")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def anchors(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
