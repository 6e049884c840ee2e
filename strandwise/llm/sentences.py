"""Sentence boundaries across languages and scripts.

Abbreviations, collocations and sentence starters are learned without labels, per language, by log-likelihood
ratios over the whole corpus; each full stop is then classified with these statistics and the case of the word
that follows. Quotations and brackets inside a sentence are passed over, line breaks end a sentence, and scripts
without full stops or spaces have their own marks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.language import LanguageModel
from strandwise.session import cut

#: Largest number of learned facts that are sent to every task; beyond, each text is joined with its own.
SENT_WORDS = 1_000_000
_ENDS = ".!?…。！？؟।॥｡"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
_BRACKETS = "([（【"
#: The opening marks that a mark may close.
_OPENERS_OF = {c: "".join(o for o, ends in _PAIRS.items() if c in ends) for ends in _PAIRS.values() for c in ends}
_ANY_PAIR = regex.compile("[" + regex.escape("".join({*_PAIRS, *_OPENERS_OF})) + "]")
_CLOSERS = "”»›」』)）]】》\"’"
_LINE = regex.compile(r"[^\n\r  ]+")
_MARK = regex.compile(r"[.!?…。！？؟।॥｡“„«‹「『(（\[【《\"]|(?<=\p{Thai})[^\S\n]+")
_SPACE = regex.compile(r"\s*")
_CASELESS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Thai}\p{Hebrew}\p{Bengali}\p{Tamil}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")
_TOKEN = regex.compile(r"\S+")
_WORD_END = regex.compile(r"[\p{L}\p{M}\p{N}]$")
_EDGE = "“”„«»‹›「」『』()（）[]【】《》\"'’‘,;:!?¿¡…–—"
_NUM, _INITIAL = "##number##", "##initial##"
_LONG_LATIN = regex.compile(r"\p{Lu}\p{Latin}*(?:[\s-]+\S+){2,}")


def type_of(token: str) -> str:
    """The word type of a token without its outer punctuation; numbers and single capitals are classes."""
    core = token.strip(_EDGE)
    bare = core[:-1] if core.endswith(".") else core
    if _NUMBER.fullmatch(bare):
        return _NUM
    if len(bare) == 1 and bare.isupper():
        return _INITIAL
    return bare.lower()


@dataclass
class LanguageFacts:
    """What was learned for one language."""

    #: abbreviation -> whether it mostly stands at the end of a sentence where case does not tell
    abbreviations: dict[str, bool] = field(default_factory=dict)
    #: words seen in lower case, so a capital speaks for a new sentence
    lower: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    #: words that follow a number and full stop more often than chance
    after_number: set[str] = field(default_factory=set)
    #: (abbreviation or initial, word) that stand together more often than chance, the word being no starter
    collocations: set[tuple[str, str]] = field(default_factory=set)


class Boundaries:
    """Classifier of one corpus; `facts` by language."""

    def __init__(self, facts: dict[str, LanguageFacts]) -> None:
        self.facts = facts
        #: what holds in every text
        self._common = facts.get("", LanguageFacts())

    @classmethod
    def of(cls, rows: Iterable) -> Boundaries:
        """From rows of FACTS."""
        facts: dict[str, LanguageFacts] = defaultdict(LanguageFacts)
        for r in rows:
            lang, role, kind, other, final = (r[c] for c in ("lang", "role", "type", "other", "final"))
            f = facts[lang]
            if role == "short":
                f.abbreviations[kind] = bool(final)
            elif role == "pair":
                f.collocations.add((kind, other))
            else:
                {"lower": f.lower, "starter": f.starters, "number": f.after_number}[role].add(kind)
        return cls(dict(facts))

    def split(self, text: str, langs: tuple[str, ...] = ()) -> list[tuple[int, int]]:
        """Sentences as (start, end), without outer white space; empty text gives none."""
        known = [*(self.facts[x] for x in langs if x in self.facts), self._common]
        out = []
        for line in _LINE.finditer(text):
            a = line.start()
            for b in [*self._cuts(text, line.start(), line.end(), known), line.end()]:
                s, e = a, b
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
                a = b
        return out

    def _cuts(self, text: str, start: int, stop: int, known: list[LanguageFacts]) -> list[int]:
        cuts: list[int] = []
        pairs: dict[int, int] | None = None
        skip = begin = start
        while begin < stop and text[begin].isspace():
            begin += 1
        for m in _MARK.finditer(text, start, stop):
            i = m.start()
            if i < skip:
                continue
            ch = text[i]
            end = None
            if ch.isspace():
                after = m.end()
                if after < stop and (regex.match(r"\p{Thai}", text[after]) or (text[after] in _PAIRS and regex.match(r"\p{Thai}", text[after + 1 : after + 2])) or _LONG_LATIN.match(text, after, stop)):
                    end = i
            elif ch in _PAIRS:
                pairs = self._closers(text, start, stop) if pairs is None else pairs
                close = pairs.get(i)
                if close is None:
                    continue
                skip = close + 1
                inner = text[i + 1 : close].rstrip()
                if inner and inner[-1] in _ENDS and self._after_quote(text, i, close + 1, stop, begin, ch in _BRACKETS):
                    end = close + 1
            else:
                e = i + 1
                while e < stop and text[e] in _ENDS:
                    e += 1
                skip = e
                while e < stop and text[e] in _CLOSERS:
                    e += 1
                if e < stop and self._is_end(text, i, e, start, stop, known):
                    end = e
            if end is not None and end < stop:
                skip = max(skip, end)
                cuts.append(end)
                begin = end
                while begin < stop and text[begin].isspace():
                    begin += 1
        return cuts

    @staticmethod
    def _closers(text: str, start: int, stop: int) -> dict[int, int]:
        """Place of the mark that closes each opening one of a line, nesting of the same kind counted; marks that stay open have none."""
        out: dict[int, int] = {}
        open_: dict[str, list[int]] = {o: [] for o in _PAIRS}
        for m in _ANY_PAIR.finditer(text, start, stop):
            c = m.group()
            for o in _OPENERS_OF.get(c, ""):
                if open_[o]:
                    out[open_[o].pop()] = m.start()
                    if o == c:
                        break
            else:
                if c in open_:
                    open_[c].append(m.start())
        return out

    @staticmethod
    def _after_quote(text: str, i: int, e: int, stop: int, begin: int, bracket: bool) -> bool:
        """Whether a sentence ends with the closed quotation or bracket text[i:e], which has an end mark inside."""
        after = _SPACE.match(text, e, stop).end()
        if after >= stop or (bracket and i != begin):
            return False
        nxt = text[after]
        if nxt in ",;:–—-、，；：)" or nxt in _ENDS or nxt.islower():
            return False
        if _CJK.match(nxt) or (after == e and _CJK.match(text[i + 1])):
            return after > e or (i != begin and not regex.match(r"[\p{Hiragana}]", nxt))
        if _CASELESS.match(nxt):
            return i != begin or bracket
        return after > e

    def _is_end(self, text: str, i: int, e: int, start: int, stop: int, known: list[LanguageFacts]) -> bool:
        ch, nxt = text[i], text[e]
        if ch in "。！？｡।॥":
            return True
        spaced = nxt.isspace()
        after = _SPACE.match(text, e, stop).end()
        if after >= stop:
            return False
        nxt = text[after]
        if not spaced:
            return bool(ch in ".!?" and nxt.isupper() and text[after + 1 : after + 2].islower() and self._glued(text, i, start, known))
        if nxt.islower() or nxt in ",;:–—)、，":
            return False
        if ch == "…" or text[i : i + 2] == "..":
            word = self._next(text, after, stop)
            return not word.islower() and (any(word.lower() in k.lower or word.lower() in k.starters for k in known) if nxt.isupper() else not nxt.isdigit())
        if ch != ".":
            return True
        a = i
        while a > start and not text[a - 1].isspace():
            a -= 1
        token = text[a:i]
        if not token or not _WORD_END.search(token):
            return True
        kind = type_of(token)
        word = self._next(text, after, stop)
        low = type_of(word)
        if kind == _NUM:
            return not any(low in k.after_number for k in known)
        seen = [k for k in known if kind in k.abbreviations]
        if not seen and kind != _INITIAL:
            return True
        if _CASELESS.match(nxt):
            return bool(seen) and seen[0].abbreviations[kind]
        if word[:1].isupper() and low not in (_INITIAL,):
            if any(low in k.lower or (low in k.starters and kind != _INITIAL) for k in known):
                return True
        if kind == _INITIAL or any((kind, low) in k.collocations for k in known):
            return False
        return seen[0].abbreviations[kind]

    @staticmethod
    def _glued(text: str, i: int, start: int, known: list[LanguageFacts]) -> bool:
        """An end mark right before a capital ends a sentence after a real word or a closed bracket."""
        a = i
        while a > start and not text[a - 1].isspace():
            a -= 1
        token = text[a:i]
        if not token or any(c in token for c in "/@") or "." in token.strip("."):
            return bool(token) and token[-1] in _CLOSERS
        if token[-1] in _CLOSERS or token[-1].isdigit():
            return True
        return len(token) > 2 and token[-2:].islower() and not any(type_of(token) in k.abbreviations and not k.abbreviations[type_of(token)] for k in known)

    @staticmethod
    def _next(text: str, after: int, stop: int) -> str:
        m = _TOKEN.match(text, after, stop)
        while m and not m.group().strip(_EDGE) and (n := _TOKEN.search(text, m.end(), stop)):
            m = n
        return m.group().strip(_EDGE) if m else ""


@lru_cache(300_000)
def _word(token: str) -> tuple[str, bool, int] | None:
    """Type of a token, whether it ends with a full stop, and 3 (4) if it begins in lower case (with a capital); None without a word."""
    core = token.strip(_EDGE)
    if not core:
        return None
    return type_of(core), core[-1] == ".", 3 if core[0].islower() else 4 if core[0].isupper() else 0


_COUNTS = ("stop", "plain", "line_end", "lower", "upper", "n")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One look at all words: per language and type how often it stands with full stop, without, at the end of a line, in lower
    case and with a capital (`after` null), and how often a capitalised word `after` follows a type with a full stop."""
    for pdf in batches:
        seen: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0, 0]))
        pairs: Counter[tuple[str, str, str]] = Counter()
        for text, langs in zip(pdf["text"], pdf["langs"], strict=True):
            own = langs[0] if len(langs) else ""
            mine = seen[own]
            for line in _LINE.finditer(text):
                last = before = None
                for token in line.group().split():
                    word = _word(token)
                    if word is None:
                        continue
                    kind, stop, case = word
                    c = mine[kind]
                    if case:
                        c[case] += 1
                        if case == 4 and before is not None:
                            pairs[own, before, kind] += 1
                    if stop:
                        c[0] += 1
                        last, before = c, kind
                    else:
                        c[1] += 1
                        last = before = None
                if last is not None:
                    last[2] += 1
        if seen:
            rows = [(lang, kind, None, *v, 0) for lang, kinds in seen.items() for kind, v in kinds.items()] + [(*k, 0, 0, 0, 0, 0, n) for k, n in pairs.items()]
            yield pd.DataFrame(rows, columns=["lang", "type", "after", *_COUNTS])


def _log_ratio(hits: Column, tries: Column, p0: Column, p1: Column) -> Column:
    """2 log of the likelihood of `hits` in `tries` at rate p1 over the one at p0."""
    p0, p1 = (F.greatest(F.least(p.cast("double"), F.lit(1 - 1e-9)), F.lit(1e-9)) for p in (p0, p1))
    return 2 * (hits * F.log(p1 / p0) + (tries - hits) * F.log((1 - p1) / (1 - p0)))


#: What is learned, one row each: `type` is the word a fact is found by, `other` the second word of a collocation.
FACTS = "lang string, role string, type string, other string, final boolean"


def learn_facts(texts: DataFrame) -> DataFrame:
    """The facts (FACTS) of all rows of `texts(text, langs)`, counted and tested in the cluster.

    Roles: `short` abbreviations, with `final` whether they mostly end a sentence; `lower` words seen in lower case; `starter`;
    `number` words that follow a number and full stop; `pair` collocations. Abbreviations of three or more languages are listed
    under the language '' too, which holds for every text.
    """
    counted = cut(
        texts.mapInPandas(_count_words, f"lang string, type string, after string, {', '.join(f'{c} long' for c in _COUNTS)}")
        .groupBy("lang", "type", "after").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    )
    types = counted.where("after is null").drop("after", "n").withColumn("places", F.col("stop") + F.col("plain"))
    # one row per language
    whole = F.broadcast(types.groupBy("lang").agg(F.sum("stop").alias("all_stop"), F.sum("places").alias("all_n"), F.sum("line_end").alias("all_end")))
    base = F.greatest(F.least(F.col("all_stop") / F.col("all_n"), F.lit(0.999)), F.lit(1e-6))
    ratio = 2 * (F.col("stop") * F.log(F.lit(0.99) / base) + F.col("plain") * F.log(F.lit(0.01) / (1 - base)))
    inner = F.length(F.regexp_replace("type", r"[^.]", ""))
    letters = F.greatest(F.length("type") - inner, F.lit(1))
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -F.col("plain").cast("double"))
    # where case does not tell, an abbreviation that stands at line ends as other words do is taken to end sentences
    ends = (F.col("line_end") / F.col("stop")) > 0.25 * F.col("all_end") / F.greatest(F.col("all_stop"), F.lit(1))
    likely = cut(
        types.join(whole, "lang").where(F.col("stop") > 0).where(~F.col("type").isin(_NUM, _INITIAL)).where(F.col("type").rlike(r"\p{L}"))
        .withColumn("score", score).where("score >= 0.3").select("lang", "type", ends.alias("ends"))
    )
    # before: an abbreviation, a number or an initial, or '' for a sure end
    followers = counted.where("after is not null").join(likely.select("lang", "type", F.lit(True).alias("known")), ["lang", "type"], "left")
    kept = F.when(F.col("known") | F.col("type").isin(_NUM, _INITIAL), F.col("type")).otherwise("")
    followers = followers.groupBy("lang", kept.alias("before"), F.col("after").alias("type")).agg(F.sum("n").alias("n"))
    cased = (F.col("lower") >= 2) & (F.col("lower") >= 0.02 * (F.col("lower") + F.col("upper")))
    followers = cut(followers.join(types.select("lang", "type", "places", "lower", "upper", cased.alias("cased")), ["lang", "type"], "left"))
    no = F.lit(None)

    def fact(df: DataFrame, role: str, other: Column = no, final: Column = no, kind: str = "type") -> DataFrame:
        return df.select("lang", F.lit(role).alias("role"), F.col(kind).alias("type"), other.cast("string").alias("other"), final.cast("boolean").alias("final"))

    after = followers.groupBy("lang", "before").agg(F.sum("n").alias("n_after"), F.sum(F.when((F.col("type") != _INITIAL) & F.col("cased"), F.col("n")).otherwise(0)).alias("evident"), F.sum(F.when(F.col("type") != _INITIAL, F.col("n")).otherwise(0)).alias("m"))
    told = likely.join(after.select("lang", F.col("before").alias("type"), "evident", "m"), ["lang", "type"], "left")
    short = fact(told, "short", final=F.when(F.col("m") >= 3, F.col("evident") > 0.5 * F.col("m")).otherwise(F.col("ends")))
    sums = after.select("lang", "before", F.col("n_after").alias("n_all"))
    tested = followers.where("n >= 3").join(whole.select("lang", "all_n"), "lang").join(F.broadcast(sums.where(F.col("before").isin("", _NUM))), ["lang", "before"])  # two rows per language
    tries = F.greatest("places", "n")
    rate, chance = F.col("n") / tries, F.col("n_all") / F.col("all_n")
    lower = cut(fact(followers.where("cased").select("lang", "type").distinct(), "lower"))
    starter = cut(fact(tested.where("before = ''").where((rate > chance) & (_log_ratio(F.col("n"), tries, chance, rate) > 30)), "starter"))
    # of all places of the word, the share after number and stop, against that of any word
    rarely = F.col("lower") < 0.02 * (F.col("lower") + F.col("upper"))
    number = fact(tested.where(F.col("before") == _NUM).where((rate > 0.2) & rarely & (_log_ratio(F.col("n"), tries, chance, rate) > 7.88)), "number")
    # pairs around a full stop: of all stops of the first word the share before the second, against that of any place
    stops = types.select("lang", F.col("type").alias("before"), "stop")
    pairs = followers.where(~F.col("before").isin("", _NUM)).where("n >= 3").join(stops, ["lang", "before"]).join(whole.select("lang", "all_n"), "lang")
    tries = F.greatest("stop", "n")
    rate, chance = F.col("n") / tries, F.col("places") / F.col("all_n")
    pairs = pairs.where((rate > chance) & (_log_ratio(F.col("n"), tries, chance, rate) > 7.88))
    for other in (lower, starter):
        pairs = pairs.join(other.select("lang", "type"), ["lang", "type"], "left_anti")
    pair = fact(pairs, "pair", other=F.col("type"), kind="before")
    common = short.groupBy("type").agg(F.count("*").alias("k"), F.count_if("final").alias("f")).where("k >= 3").withColumn("lang", F.lit(""))
    out = short
    for more in (lower, starter, number, pair, fact(common, "short", final=2 * F.col("f") > F.col("k"))):
        out = out.unionByName(more)
    return cut(out)


def _types_of(text: str) -> set[str]:
    return {w[0] for line in _LINE.finditer(text) for t in line.group().split() if (w := _word(t)) is not None}


def _needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The facts a text can need: its types in its languages."""
    for pdf in batches:
        rows = [(tid, lang, kind) for tid, text, langs in zip(pdf["tid"], pdf["text"], pdf["langs"], strict=True) for kind in _types_of(text) for lang in {*langs, ""}]
        if rows:
            yield pd.DataFrame(rows, columns=["tid", "lang", "type"])


def split_rule(known: DataFrame, sent_words: int = SENT_WORDS) -> tuple[DataFrame, Callable]:
    """`known(text, langs, ...)` and a function from its rows to their sentences.

    Facts are learned from all rows. Up to `sent_words` of them go to every task; beyond, each text is joined with those its
    words need, in a column of its own, with the same result.
    """
    facts = learn_facts(known)
    some = facts.limit(sent_words + 1).collect()
    if len(some) <= sent_words:
        bounds = Boundaries.of(some)
        return known, lambda r: bounds.split(r.text, tuple(r.langs))
    keyed = cut(known.withColumn("tid", F.monotonically_increasing_id()))
    own = keyed.mapInPandas(_needed, "tid long, lang string, type string").join(facts, ["lang", "type"])
    own = own.groupBy("tid").agg(F.collect_list(F.struct("lang", "role", "type", "other", "final")).alias("own_facts"))  # of the words of one text
    wide = keyed.join(own, "tid", "left").drop("tid")
    return wide, lambda r: Boundaries.of(r.own_facts if r.own_facts is not None else ()).split(r.text, tuple(r.langs))


#: A text whose confidence reaches this is taken for one language; in others each part is looked at.
ONE_LANGUAGE = 0.64


def with_languages(df: DataFrame, model: LanguageModel, part: int = 90) -> DataFrame:
    """`df` with `langs`: the language of the text first, then, if it may be mixed, those of its parts of about `part` characters."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            texts = pdf["text"].tolist()
            whole, sure = model.classify(texts)
            parts, owner = [], []
            for k, t in enumerate(texts):
                if sure[k] < ONE_LANGUAGE and len(t) > 1.5 * part:
                    pieces = [t[a : a + part] for a in range(0, len(t), part)]
                    parts += pieces
                    owner += [k] * len(pieces)
            each: list[list[str]] = [[] for _ in texts]
            for k, x in zip(owner, model.classify(parts)[0] if parts else [], strict=True):
                each[k].append(x)
            out = {c: pdf[c].to_numpy(dtype=object) for c in columns}
            langs = [[x for x, _ in Counter(e).most_common()] if e else [w] for w, e in zip(whole, each, strict=True)]
            yield pd.DataFrame(out | {"langs": langs}, dtype=object)

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{schema}, langs array<string>")


def sentences(texts: DataFrame, model: LanguageModel, sent_words: int = SENT_WORDS) -> DataFrame:
    """One row per sentence of `texts(kind, rec_id, text)`: `(kind, rec_id, start_pos, end_pos)`.

    Null and blank texts have no sentence. Positions count code points. Repeated rows give repeated sentences; other
    columns are ignored. Statistics are learned from all rows.
    """
    known, parts_of = split_rule(cut(with_languages(texts.select("kind", "rec_id", "text").where("text is not null"), model)), sent_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, ids, starts, stops = [], [], [], []
            for r in pdf.itertuples(index=False):
                for s, e in parts_of(r):
                    kinds.append(r.kind)
                    ids.append(r.rec_id)
                    starts.append(s)
                    stops.append(e)
            if kinds:
                yield pd.DataFrame({"kind": kinds, "rec_id": ids, "start_pos": np.array(starts, dtype=np.int32), "end_pos": np.array(stops, dtype=np.int32)})

    return known.mapInPandas(run, "kind string, rec_id string, start_pos int, end_pos int")
