"""Canonical forms and comparison of bibliographic records and of stated findings."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from urllib.parse import unquote

#: Letters without a decomposition and their plain spelling.
_PLAIN = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}
#: Combining marks of the Latin, Greek and Cyrillic scripts; in others they carry meaning.
_MARKS = re.compile(r"[\u0300-\u036f]+")
#: Remarks that feeds append to a title.
_REMARK = re.compile(r"[\s(\[–—\-]*\b(?:full text|preprint|postprint|accepted manuscript|author version|working paper version|online first|advance online publication|pdf)\b[)\]\s.]*$", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_REMARK_PARTS = ("text", "print", "manuscript", "version", "paper", "online", "pdf")
_REMARK_WORD = re.compile("|".join(_REMARK_PARTS), re.I)
#: Roman numerals of part numbers.
_ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
_TOKEN = re.compile(r"\d+|[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+")
_SEGMENT = re.compile(r"\s*[:：]\s*|\s+[–—-]\s+|\.\s+")
_WORDINGS = re.compile(r"\s+[=|/]\s+")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_SCRIPTS = re.compile(r"[぀-ヿ㐀-鿿]")
#: Titles of fewer words say little on their own ("Book reviews").
GENERIC_WORDS = 6


@lru_cache(200_000)
def fold(text: str) -> str:
    """Lower case without accents, nor their spelling-out."""
    plain = text.lower()
    if not plain.isascii():
        for letter, spelling in _PLAIN.items():
            plain = plain.replace(letter, spelling)
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", plain))
    return plain.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def doi_key(doi: str | None) -> str | None:
    if not isinstance(doi, str):
        return None
    m = _DOI.search(re.sub(r"\s+", "", unquote(doi)).lower())
    return m.group().rstrip(".,;)") if m else None


@lru_cache(400_000)
def near(a: str, b: str) -> bool:
    """Equal but for a typing error: one edit or swap, two in long words of the same ends; none in scripts without letters."""
    if a == b:
        return True
    n, m = len(a), len(b)
    allowed = 2 if min(n, m) >= 9 and a[0] == b[0] and a[-2:] == b[-2:] else 1
    if abs(n - m) > allowed or min(n, m) < 3 or max(n, m) < 4 or _SCRIPTS.search(a) or a[0].isdigit() or b[0].isdigit():
        return False
    if len(set(a) ^ set(b)) > 2 * allowed:
        return False
    before, last = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[m] <= allowed


@dataclass(frozen=True)
class Wording:
    tokens: tuple[str, ...]
    numbers: tuple[str, ...]
    segments: tuple[tuple[str, ...], ...]
    cut: bool
    joined: str = ""

    def __hash__(self) -> int:
        return hash((self.joined, self.cut))


@dataclass(frozen=True)
class Record:
    wordings: tuple[Wording, ...] = ()
    authors: frozenset[tuple[str, str]] = field(default_factory=frozenset)
    partial_authors: bool = False
    year: int | None = None
    doi: str | None = None


def _may_have_remark(part: str) -> bool:
    if not part.isascii():
        return _REMARK_WORD.search(part) is not None
    low = part.lower()
    return any(x in low for x in _REMARK_PARTS)


@lru_cache(100_000)
def title_wordings(title: str) -> tuple[Wording, ...]:
    text = html.unescape(title) if "&" in title else title
    text = " ".join((_TAG.sub(" ", text) if "<" in text else text).split()).strip("[]\"“”„«» ")
    out = []
    for part in _WORDINGS.split(text):
        part = (_REMARK.sub("", part) if _may_have_remark(part) else part).strip("[]\"“”„«» ")
        cut = part.endswith(("…", "..."))
        segments = []
        for s in _SEGMENT.split(part.rstrip(".… ")):
            tokens = tuple([_ROMAN.get(t, t) for t in _TOKEN.findall(fold(s))])
            if tokens:
                segments.append(tokens)
        if segments:
            flat = [t for s in segments for t in s]
            joined = "".join(flat)
            if cut and len(flat) > 1:
                flat = flat[:-1]
                segments[-1] = segments[-1][:-1]
                segments = [s for s in segments if s]
            numbers = [t for t in flat if t[0].isdigit()]
            out.append(Wording(tuple([t for t in flat if not t[0].isdigit()] if numbers else flat), tuple(sorted(numbers)), tuple(segments), cut, joined))
    return tuple(out)


@lru_cache(200_000)
def author_key(name: str) -> tuple[str, str] | None:
    """(surname, initial of the given name), both folded; None for "et al." and blanks."""
    name = " ".join(name.split())
    if not name or fold(name).strip(". ") in ("et al", "others", "and others", "anonymous"):
        return None
    if "," in name:
        last, _, first = name.partition(",")
    else:
        words = name.split()
        caps = [w for w in words if len(w) > 1 and w.isupper() and not w.endswith(".")]
        short = [w for w in words if w.endswith(".") or (len(w) == 1 and w.isupper())]
        if caps and len(caps) < len(words):
            last, first = " ".join(caps), " ".join(w for w in words if w not in caps)
        elif short and len(short) < len(words):
            last, first = " ".join(w for w in words if w not in short), short[0]
        else:
            last, first = " ".join(words[1:]) or words[0], words[0] if len(words) > 1 else ""
    letters = re.sub(r"[\W\d_]+", "", fold(last))
    return (letters, fold(first.strip())[:1]) if letters else None


def record(title, authors, year, doi) -> Record:
    keys, partial = set(), False
    for a in authors if authors is not None else ():
        k = author_key(a) if isinstance(a, str) else None
        if k:
            keys.add(k)
        else:
            partial = True
    year = None if year is None or year != year or not 1000 < year < 2200 else int(year)
    return Record(title_wordings(title) if isinstance(title, str) else (), frozenset(keys), partial, year, doi_key(doi if isinstance(doi, str) else None))


#: Two texts with more differing words on both sides are not taken for renderings of one.
_MOST_ERRORS = 4


def _left(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Tokens of either side without partner on the other, typing errors allowed."""
    x, y = [], list(b)
    for t in a:
        if t in y:
            y.remove(t)
        else:
            x.append(t)
    if min(len(x), len(y)) > _MOST_ERRORS:
        return x, y
    for t in x[:]:
        for u in y:
            if near(t, u):
                x.remove(t)
                y.remove(u)
                break
    # what is left of function words: a letter lost or doubled in a word of up to three letters
    for t in [t for t in x if len(t) <= 3 and t.isalpha()]:
        for u in y:
            if len(u) <= 3 and u.isalpha() and abs(len(t) - len(u)) == 1 and (t in u or u in t) and not (_SCRIPTS.search(t + u)):
                x.remove(t)
                y.remove(u)
                break
    return x, y


def _subset(short: Wording, long: Wording) -> bool:
    """Whether the shorter title is one that lost its subtitle or its end."""
    if short.cut:
        if len(short.joined) >= (8 if _SCRIPTS.search(short.joined) else 15) and long.joined.startswith(short.joined):
            return True
        return len(short.tokens) >= 2 and not _left(short.tokens, long.tokens)[0] and set(short.numbers) <= set(long.numbers)
    whole = tuple(t for s in short.segments for t in s)
    return len(whole) >= 3 and len(long.segments) > len(short.segments) and any(abs(len(whole) - len(s)) <= 1 and not any(_left(whole, s)) for s in long.segments)


@lru_cache(200_000)
def wording_score(a: Wording, b: Wording) -> float:
    """1: same title; 0.9: one lacks its subtitle or end; else at most 0.15, by the words in common."""
    if a.tokens == b.tokens and a.numbers == b.numbers:
        return 1.0
    if not (a.cut or b.cut) and (a.numbers == b.numbers or len(a.segments) == len(b.segments)):
        if a.numbers != b.numbers:
            return 0.15
        x, y = _left(a.tokens, b.tokens)
        if not x and not y and (a.tokens or a.numbers):
            return 1.0
    if _subset(a, b) or _subset(b, a):
        return 0.9
    common = len(a.tokens) - len([t for t in a.tokens if t not in b.tokens])
    return 0.15 * 2 * common / max(1, len(a.tokens) + len(b.tokens))


def _author_similarity(a: Record, b: Record) -> float:
    if not (a.authors and b.authors):
        return 0.5
    common = len(a.authors & b.authors)
    if common < min(len(a.authors), len(b.authors)):
        rest = [k for k in b.authors if k not in a.authors]
        common += sum(1 for k in a.authors - b.authors if any(k[1] == r[1] and near(k[0], r[0]) for r in rest))
    loose = a.partial_authors or b.partial_authors
    return min(1.0, common / (min if loose else max)(len(a.authors), len(b.authors)))


def other_people(a: Record, b: Record) -> bool:
    """Two titled records whose known authors have nobody in common: never one publication, whatever the titles."""
    return bool(a.wordings and b.wordings) and _author_similarity(a, b) == 0.0


def compare(a: Record, b: Record) -> tuple[float, float, float, float]:
    """Similarities in [0, 1] of title, authors, year and DOI; 0.5 where one side lacks the attribute."""
    title = max((wording_score(x, y) for x in a.wordings for y in b.wordings), default=0.5 if not (a.wordings and b.wordings) else 0.0)
    authors = _author_similarity(a, b)
    year = 0.5 if a.year is None or b.year is None else (1.0, 0.8)[abs(a.year - b.year)] if abs(a.year - b.year) <= 1 else 0.0
    doi = 0.5 if a.doi is None or b.doi is None else float(a.doi == b.doi)
    return title, authors, year, doi


def generic(r: Record) -> bool:
    return all(len(w.tokens) < GENERIC_WORDS and not any(_SCRIPTS.search(t) for t in w.tokens) for w in r.wordings)


def same_publication(a: Record, b: Record, similarities: tuple[float, float, float, float] | None = None) -> bool:
    """One publication, a preprint and its publication at most a year apart included.

    Title and authors must agree; a DOI alone proves nothing, as several works may carry it, but it makes up for
    a missing title or a wrong year. Other parts, volumes, places and studies are other works.
    """
    if similarities is None and other_people(a, b):
        return False
    title, authors, year, doi = similarities or compare(a, b)
    if not (a.wordings and b.wordings):
        return doi == 1.0 and authors >= 0.5 and year >= 0.5
    if title < 0.9 or authors == 0.0:
        return False
    if doi == 1.0:
        return (authors >= 0.5 or (title == 1.0 and not generic(a))) and (year >= 0.5 or (title == 1.0 and not generic(a)))
    if year < 0.5:
        return False
    if generic(a) or generic(b) or title < 1.0:
        return authors > 0.5 and (doi == 0.5 or title == 1.0 or authors == 1.0)
    return authors >= 0.5


#: Names of the percent sign, which stands for them in other renderings.
_PERCENT = re.compile(r"(?<=\d)\s*(?:percent|per cent|prozent|procent|pour cent|por ciento|per cento|por cento|процент\w*)", re.I)
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")


@dataclass(frozen=True)
class Finding:
    figures: tuple[str, ...]
    words: tuple[str, ...]


def finding(statement: str) -> Finding:
    """The whole statement as sorted figures and as words in order, folded; names of the percent sign drop out."""
    text = fold(" ".join(statement.split()))
    # the names in plain letters hold one of these; most statements hold none
    low = text.lower()
    if not text.isascii() or "cent" in low or "prozent" in low or "ciento" in low:
        text = _PERCENT.sub("%", text)
    return Finding(tuple(sorted([x.replace(",", ".") for x in _FIGURE.findall(text)])), tuple(_WORD.findall(text)))


@dataclass(frozen=True)
class Residue:
    """What two statements do not share: words added before and after the longer one, and the rest of either side in order."""

    lead: tuple[str, ...] = ()
    tail: tuple[str, ...] = ()
    left: tuple[str, ...] = ()
    right: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.lead or self.tail or self.left or self.right)


def _unshared(a: tuple[str, ...], b: tuple[str, ...]) -> list[int]:
    """Places of the words of `a` beyond what `b` has of each; of equal words the first ones are taken for the unshared."""
    spare = Counter(a)
    spare.subtract(b)
    out = []
    for i, t in enumerate(a):
        if spare[t] > 0:
            out.append(i)
            spare[t] -= 1
    return out


def residue(a: tuple[str, ...], b: tuple[str, ...]) -> Residue:
    """Whole texts are compared; the order of the shared words does not count, as renderings move clauses.

    A phrase is added where one side begins (ends) with words of its own and the other does not.
    """
    x, y = _unshared(a, b), _unshared(b, a)
    lead = tail = ()
    for t, at, far, other in ((a, x, b, y), (b, y, a, x)):
        k = 0
        while k < len(at) and at[k] == k:
            k += 1
        if k and not lead and not (other and other[0] == 0):
            lead = t[:k]
            del at[:k]
        k = 0
        while k < len(at) and at[-1 - k] == len(t) - 1 - k:
            k += 1
        if k and not tail and not (other and other[-1] == len(far) - 1):
            tail = t[len(t) - k :]
            del at[len(at) - k :]
    if bool(x) != bool(y):
        # one side has a rest and the other none: what stood at its edge replaces it and was not added
        return Residue((), (), tuple(a[i] for i in _unshared(a, b)), tuple(b[i] for i in _unshared(b, a)))
    return Residue(lead, tail, tuple(a[i] for i in x), tuple(b[i] for i in y))


def comparable(a: tuple[str, ...], b: tuple[str, ...], r: Residue) -> bool:
    """Whether about two thirds of the words of the shorter text are shared, added phrases apart; short texts may differ in two."""
    rest = max(len(r.left), len(r.right))
    return rest <= max(2, 0.34 * min(len(a), len(b)))


def garbled(a: str, b: str) -> bool:
    """Two or three typing errors in one word: same ends, the same letters but for two, nearly in order."""
    x, y = Counter(a), Counter(b)
    return min(len(a), len(b)) >= 5 and a[0] == b[0] and a[-1] == b[-1] and sum(((x - y) + (y - x)).values()) <= 2 and not _SCRIPTS.search(a + b) and SequenceMatcher(None, a, b).ratio() >= 0.75


def slip(a: str, b: str) -> bool:
    """A typing error in a word of any length; says nothing of whether both are words in their own right."""
    if near(a, b) or garbled(a, b):
        return True
    if _SCRIPTS.search(a + b) or max(len(a), len(b)) < 2 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or (len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]])
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
