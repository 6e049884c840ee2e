"""Runs of one language inside a text: sentences are classified and neighbours of the same language joined."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandwise.llm.language import UNKNOWN, LanguageModel
from strandwise.llm.sentences import SENT_WORDS, split_rule, with_languages
from strandwise.session import cut

_SEPARATOR = re.compile(r"\s+(?:[=|/–—·]|//|::)\s+")
_SCHEMA = "rec_id string, field string, start_pos int, end_pos int, lang string, confidence double"
#: Latin-script parts with fewer letters go with their neighbours.
_LEAST_LETTERS = 12


def join_runs(parts: list[tuple[int, int]], langs: list[str | None], confidence: list[float]) -> list[tuple[int, int, str, float]]:
    """Neighbouring parts of one language as (start, end, lang, confidence weighted by length).

    A part without a language of its own (None: too few letters) goes with the part before, else with the next one that has
    any. Rejected parts (`und`) stay parts of their own, as does a text of nothing else.
    """
    filled, last = list(langs), None
    for k, x in enumerate(filled):
        if x is None:
            filled[k] = last
        last = filled[k] if filled[k] is not None else last
    for k in range(len(filled) - 2, -1, -1):
        if filled[k] is None:
            filled[k] = filled[k + 1]
    out: list[list] = []
    for (s, e), x, c in zip(parts, filled, confidence, strict=True):
        x = UNKNOWN if x is None else x
        if out and out[-1][2] == x:
            out[-1][1] = e
            out[-1][3] += c * (e - s)
            out[-1][4] += e - s
        else:
            out.append([s, e, x, c * (e - s), e - s])
    return [(s, e, x, w / max(n, 1)) for s, e, x, w, n in out]


def _rows(model: LanguageModel, field: str, parts_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cuts = [parts_of(row) for row in pdf.itertuples(index=False)]
            texts = pdf["text"].tolist()
            flat = [t[s:e] for t, own in zip(texts, cuts, strict=True) for s, e in own]
            out: list[tuple] = []
            langs, conf = _judged(model, flat)
            k = 0
            short = []
            for rec, text, own in zip(pdf["rec_id"], texts, cuts, strict=True):
                mine = langs[k : k + len(own)]
                if own and all(x is None for x in mine):
                    short.append((rec, text, own, list(conf[k : k + len(own)])))
                else:
                    out += [(rec, field, *r) for r in join_runs(own, mine, list(conf[k : k + len(own)]))]
                k += len(own)
            # texts of short parts only are looked at as a whole
            for (rec, _, own, c), x in zip(short, model.classify([t for _, t, _, _ in short])[0], strict=True):
                out += [(rec, field, *r) for r in join_runs(own, [x] * len(own), c)]
            if out:
                yield pd.DataFrame(out, columns=["rec_id", "field", "start_pos", "end_pos", "lang", "confidence"])

    return run


def _judged(model: LanguageModel, parts: list[str]) -> tuple[list[str | None], np.ndarray]:
    """Language of each part (`und` beyond the floor, None for too few letters to tell) and confidence, from one look at the vectors."""
    if not model.languages:
        return [UNKNOWN] * len(parts), np.zeros(len(parts))
    best, top, conf = model.judge(parts)
    out: list[str | None] = []
    for t, b, x, far in zip(parts, best, top, model.rejected(parts, best, top), strict=True):
        if x <= 0 or (sum(map(str.isalpha, t)) < _LEAST_LETTERS and not _script_only(t)):
            out.append(None)
        else:
            out.append(UNKNOWN if far else model.languages[b])
    return out, conf


def _script_only(text: str) -> bool:
    """Texts in other scripts than Latin need few letters to be told apart."""
    letters = [c for c in text if c.isalpha()]
    return sum(0x36F < ord(c) < 0x1E00 or ord(c) > 0x2E7F for c in letters) * 2 > len(letters)


def abstract_runs(texts: DataFrame, model: LanguageModel, sent_words: int = SENT_WORDS) -> DataFrame:
    """Runs of `texts(kind, rec_id, text)`, each from the start of its first to the end of its last sentence.

    `(rec_id, field, start_pos, end_pos, lang, confidence)`, field `abstract`. Null and blank texts give no row; a
    text without any letters has the language `und`.
    """
    known, parts_of = split_rule(cut(with_languages(texts.select("kind", "rec_id", "text").where("text is not null"), model)), sent_words)
    return known.mapInPandas(_rows(model, "abstract", parts_of), _SCHEMA)


def title_parts(text: str) -> list[tuple[int, int]]:
    """The wordings of a title, cut at every separator; wordings of one language are joined again afterwards."""
    cuts, a = [], 0
    for m in _SEPARATOR.finditer(text):
        cuts.append((a, m.start()))
        a = m.end()
    cuts.append((a, len(text)))
    out = []
    for s, e in cuts:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def title_runs(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """Runs of titles `texts(rec_id, text)`; the separator of two wordings and the blanks around it belong to neither."""
    return texts.select("rec_id", "text").where("text is not null").mapInPandas(
        _rows(model, "title", lambda r: title_parts(r.text)), _SCHEMA
    )
