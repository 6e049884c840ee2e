"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Letters and digits whose compatibility decomposition is one ASCII character, by rule over the basic plane."""
    source, target = [], []
    for code in range(0x80, 0xFFFF):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


@functools.cache
def _long_folds() -> dict[str, str]:
    """Characters that decompose into several, such as ligatures and fractions, by the same rule; what is not ASCII becomes a blank."""
    out = {}
    for code in range(0x80, 0xFFFF):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        kept = "".join(x if x.isascii() and x.isalnum() else " " for x in plain)
        if len(plain) > 1 and kept.strip() and c != "ß":
            out[c] = kept
    return out


def _spelled_out(text: Column, raw: Column) -> Column:
    """Folded texts with such characters go through a map letter by letter; all others, by a look at the raw text, are left alone."""
    folds = _long_folds()
    table = F.create_map(*[F.lit(x) for pair in folds.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # the long class is tried on texts that are not ASCII only: each of its characters is one step per letter
    return F.when(raw.rlike(r"[^\x00-\x7F]") & raw.rlike("[" + "".join(folds) + "]"), spelled).otherwise(text)


def normalize_title(title: Column) -> Column:
    """Lower case, no diacritics, runs of other characters one blank, trimmed; null stays null."""
    source, target = _fold_table()
    folded = F.replace(F.lower(title), F.lit("ß"), F.lit("ss"))
    folded = _spelled_out(F.translate(F.regexp_replace(folded, r"\p{Mn}+", ""), source, target), title)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def slug(value: Column, longest: int = 72) -> Column:
    """Normalised words joined by hyphens, cut to `longest` characters; `record` where nothing is left."""
    cut = F.regexp_replace(F.substring(F.replace(normalize_title(value), F.lit(" "), F.lit("-")), 1, longest), "^-+|-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("record"))


def words(text: Column) -> Column:
    """Array of normalised words; empty for blank text."""
    return F.filter(F.split(normalize_title(text), " "), lambda w: w != "")


def dice(left: Column, right: Column) -> Column:
    """Sorensen-Dice of the word sets of two texts; 0 where either is empty."""
    a, b = F.array_distinct(words(left)), F.array_distinct(words(right))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of the word sets of two texts; 0 where both are empty."""
    a, b = F.array_distinct(words(left)), F.array_distinct(words(right))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)).cast("double") / union).otherwise(0.0)


def phrase_pattern(phrases: list[str]) -> str:
    """Regular expression for whole-phrase containment in a padded normalised text."""
    return " (?:" + "|".join(sorted(phrases)) + ") "


def contains_phrase(text: Column, phrases: list[str]) -> Column:
    return F.concat(F.lit(" "), F.coalesce(normalize_title(text), F.lit("")), F.lit(" ")).rlike(phrase_pattern(phrases))


def host(url: Column) -> Column:
    """Host of a URL in lower case without `www.` and port; empty where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def latest_year(text: Column) -> Column:
    """Largest year from 1950 to 2049 named in the text; null where none is."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(19[5-9][0-9]|20[0-4][0-9])\b"), F.lit(1)), lambda y: y.cast("int")))


def age_band(text: Column) -> Column:
    """Struct (low, high) of `6-12`-like bands; null where the text is none or runs backwards."""
    low = F.regexp_extract(text, r"^(\d{1,2})-(\d{1,2})$", 1).try_cast("int")
    high = F.regexp_extract(text, r"^(\d{1,2})-(\d{1,2})$", 2).try_cast("int")
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def half_up(num: Column, den: Column, digits: int) -> Column:
    """num / den of integers, rounded half up at `digits` decimals with integer arithmetic."""
    scale = 10**digits
    return F.when(den != 0, F.floor((2 * num * scale + den) / (2 * den)) / F.lit(float(scale)))


# --- texts, identifiers and small parsers --------------------------------------------------------------------------

#: Typographic quotes, dashes and blanks and their plain forms.
_QUOTES = (("‘’‚‛′", "'"), ("“”„‟″", '"'), ("‐‑‒–—―−", "-"), ("\u00a0", " "))
#: Patterns of identifiers and addresses in running text, and of addresses of page parts.
DOI, URL, ASSET = r"(?i)\b(10\.\d{4,9}/[^\s\"<>)\]]+)", r"(?i)(https?://[^\s\"<>)\]]+)", r"(?i)\.(png|jpe?g|gif|svg|css|js|woff2?)$"


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Compatibility composition (NFKC), which Spark has no function for; Arrow batches."""
    return _compatible(text)


def plain_key(text: Column) -> Column:
    """Lower case with runs of anything but ASCII letters and digits as one blank; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_form(text: Column) -> Column:
    """Text for verbatim comparison: plain quotes and dashes, words broken at line ends joined, blanks squeezed; words stay as they are."""
    source, target = "".join(a for a, _ in _QUOTES), "".join(b * len(a) for a, b in _QUOTES)
    return _squeezed(F.regexp_replace(F.translate(compatible(text), source, target), r"\u00ad\s*|-\s*\n\s*", ""))


def verbatim(passage: Column, text: Column, shortest: int = 40) -> Column:
    """The passage in its match form if it stands in the text and is long enough, else null."""
    p = match_form(passage)
    return F.when((F.length(p) >= shortest) & F.contains(match_form(text), p), p)


def clean_extracted(text: Column) -> Column:
    """Extracted pages as readable text: line ends unified, hyphenation undone, blanks and empty lines squeezed, one final line end."""
    t = F.regexp_replace(F.regexp_replace(compatible(text), r"\r\n?", "\n"), r"\u00ad", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[\w&&[^\n]])-\n(?=\w)", ""), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" +(?=\n|$)", ""), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(t != "", F.concat(t, F.lit("\n"))).otherwise(t)


def cut_at_sentence(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut behind the last sentence or paragraph inside; hard where there is none."""
    head = F.substring(text, 1, limit)
    inner = F.regexp_extract(head, r"(?s)^(.*(?:\.(?=[ \n])|\n(?=\n)))", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.when(F.length(inner) > 1, inner).otherwise(head))


def age_span(text: Column) -> Column:
    """Struct (low, high) of all numbers of a text; null without any."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.when(F.size(numbers) > 0, F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high")))


def ages_match(gold: Column, predicted: Column, low: int = 1, high: int = 2) -> Column:
    """Spans overlap and their ends differ by `low` and `high` at most; texts without numbers must be equal but for case and blanks."""
    g, p = age_span(gold), age_span(predicted)
    near = (g["low"] <= p["high"]) & (p["low"] <= g["high"]) & (F.abs(g["low"] - p["low"]) <= low) & (F.abs(g["high"] - p["high"]) <= high)
    return F.when(g.isNull() | p.isNull(), F.lower(F.trim(gold)) == F.lower(F.trim(predicted))).otherwise(near)


def first_year(text: Column) -> Column:
    """The first year of 1900 to 2099 named in a text; null where none is."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def plausible_year(texts: list[Column], current: int) -> Column:
    """Struct (year, provisional): the latest year of 1950 to 2049 named in any of the texts, else `current`, which is provisional."""
    found = F.array_max(F.filter(F.array(*[latest_year(t) for t in texts]), lambda y: y.isNotNull()))
    return F.struct(F.coalesce(found, F.lit(current)).alias("year"), found.isNull().alias("provisional"))


def topics_of_context(context: Column, marker: str = "matched topics:") -> Column:
    """Sorted topics of a line `... matched topics: a, b. ...`; empty without the marker."""
    tail = F.regexp_extract(F.coalesce(context, F.lit("")), marker + r"([^.]*)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(tail, ","), lambda x: F.trim(x)), lambda t: t != "")))


def _bare(address: Column) -> Column:
    return F.regexp_replace(address, r"[.,;:!?»'\"]+$", "")


def address_in(text: Column, publisher: Column | None = None) -> Column:
    """A DOI printed in the text, as an address; else the address on the publisher's host, on the most frequent one, or the first.

    Only the first 20,000 and the last 8,000 characters count, where title pages and imprints stand.
    """
    hay = F.concat(F.substring(text, 1, 20_000), F.lit("\n"), F.right(text, F.lit(8_000)))
    doi = _bare(F.regexp_extract(hay, DOI, 1))
    found = F.filter(F.transform(F.regexp_extract_all(hay, F.lit(URL), F.lit(1)), _bare), lambda u: ~u.rlike(ASSET))
    named = F.transform(found, lambda u: F.struct(host(u).alias("host"), u.alias("url")))
    often = F.transform(named, lambda x: F.struct(F.size(F.filter(named, lambda y: (y["host"] == x["host"]) & (x["host"] != ""))).alias("n"), x["url"].alias("url")))
    top = F.array_max(F.transform(often, lambda x: x["n"]))
    best = F.try_element_at(F.filter(often, lambda x: x["n"] == top), F.lit(1))["url"]
    if publisher is not None:
        p = F.lower(F.trim(F.coalesce(publisher, F.lit(""))))
        own = F.filter(named, lambda x: (p != "") & (x["host"] != "") & (F.contains(x["host"], p) | F.contains(p, F.split_part(x["host"], F.lit("."), F.lit(1)))))
        best = F.coalesce(F.try_element_at(own, F.lit(1))["url"], best)
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(best)


def guess_title(text: Column, lines: int = 25) -> Column:
    """The longest of the first filled lines that can be a title: 15 to 200 characters, half of them letters, no contents line; the first of equals."""
    filled = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines)
    letters = lambda x: F.length(F.regexp_replace(x, "[^A-Za-zÄÖÜäöüß]", ""))
    fit = F.filter(filled, lambda x: F.length(x).between(15, 200) & ~x.rlike(r"\.{4,}|^\d+(\s|\.|$)") & (letters(x) * 2 >= F.length(x)))
    longest = F.array_max(F.transform(fit, F.length))
    return F.coalesce(F.try_element_at(F.filter(fit, lambda x: F.length(x) == longest), F.lit(1)), F.lit(""))


def canonical_hash(*values: Column) -> Column:
    """SHA-256 of the values as one JSON document in their order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[v.alias(f"v{i:03}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"}), 256)


def inverted_text(index: Column) -> Column:
    """Text of an inverted index (word to places): words in order of place, then of word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
