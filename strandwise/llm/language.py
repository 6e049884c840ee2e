"""Language identification by nearest centroids of TF-IDF character n-grams.

Vectors of hashed letter trigrams and single letters are compared by cosine with several centroids per language,
found by spherical clustering inside each language. Labels used for the fit may be wrong: pieces move to the
language whose centroid is nearest before the clusters are formed. What is too far from every centroid, or has
too few letters, is rejected (`und`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample the classifier is fitted on: texts per language, and characters per text.
TEXTS_PER_LANGUAGE, SAMPLE_CHARS = 400, 5_000
UNKNOWN = "und"
_TRI, _UNI = 1 << 14, 1 << 11
_DIM = _TRI + _UNI
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ROUGH = re.compile(r"(?<=[.!?؟])\s+|(?<=[。！？।])|\n+")

#: Spellings of language labels beside the two-letter code itself.
LABEL_NAMES = {
    "english": "en", "eng": "en", "deutsch": "de", "german": "de", "ger": "de", "deu": "de", "français": "fr", "french": "fr", "fre": "fr", "fra": "fr",
    "español": "es", "spanish": "es", "spa": "es", "italiano": "it", "italian": "it", "ita": "it", "nederlands": "nl", "dutch": "nl", "dut": "nl", "nld": "nl",
    "português": "pt", "portuguese": "pt", "por": "pt", "русский": "ru", "russian": "ru", "rus": "ru", "中文": "zh", "chinese": "zh", "chi": "zh", "zho": "zh",
    "日本語": "ja", "japanese": "ja", "jpn": "ja", "العربية": "ar", "arabic": "ar", "ara": "ar", "हिन्दी": "hi", "hindi": "hi", "hin": "hi", "ไทย": "th", "thai": "th", "tha": "th",
}


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any usual spelling (`en-GB`, `ENG`, `English`); null where it names none."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    return F.when(plain.rlike(r"^[a-z]{2}$") & ~plain.isin("xx"), plain).otherwise(F.try_element_at(names, plain))


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(row, feature, count)` of the letters of each text, ordered by row, then feature."""
    plain = [f" {_OTHER.sub(' ', t.lower()).strip()} " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    row = np.repeat(np.arange(len(plain)), size)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    tri = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) * np.uint64(31) + codes[2:] * np.uint64(0xC2B2AE3D) * np.uint64(1009)
    tri ^= tri >> np.uint64(29)
    tri = ((tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)  # 14 bits
    inside = row[:-2] == row[2:]
    uni = (((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64) & (_UNI - 1)) + _TRI
    letter = codes != 32
    key = np.concatenate((row[:-2][inside] * _DIM + tri[inside], row[letter] * _DIM + uni[letter]))
    key, count = np.unique(key, return_counts=True)
    return key // _DIM, key % _DIM, count.astype(float)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray  # [feature, centroid], unit columns
    owner: np.ndarray  # language of each centroid, as a number
    languages: list[str]
    floor: np.ndarray  # least cosine of each language, below which a text is too far from it

    def similarities(self, texts: Sequence[str]) -> np.ndarray:
        """Cosine with the nearest centroid of each language: [text, language]."""
        out = np.zeros((len(texts), len(self.languages)))
        done = 0
        # slices whose n-grams times centroids stay in the cache of a core
        while done < len(texts):
            to, n = done, 0
            while to < len(texts) and (to == done or n < 8_000):
                n += len(texts[to])
                to += 1
            row, f, x = features(texts[done:to])
            if len(row):
                sims = _cosines(row, f, x, self.idf, self.centroids, to - done)
                for k in range(len(self.languages)):
                    out[done:to, k] = sims[:, self.owner == k].max(1)
            done = to
        return out

    def judge(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest language, cosine with it and confidence of each text; ties go to the first language in order."""
        sims = self.similarities(texts)
        at = np.arange(len(texts))
        best = sims.argmax(1)
        top = sims[at, best]
        sims[at, best] = 0
        return best, top, np.where(top > 0, top / np.maximum(top + sims.max(1), 1e-12), 0.0)

    def rejected(self, texts: Sequence[str], best: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which texts are too far from their nearest language, for their length, or have no letter."""
        return (top <= 0) | (top < self.floor[best] * _length_share(texts))

    def classify(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; what lies below the floor is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, top, confidence = self.judge(texts)
        return [UNKNOWN if far else self.languages[b] for b, far in zip(best, self.rejected(texts, best, top), strict=True)], confidence


def _length_share(texts: Sequence[str]) -> np.ndarray:
    """Cosines of texts shorter than some 100 characters fall with the root of their length."""
    return np.sqrt(np.minimum(1.0, np.fromiter(map(len, texts), dtype=float, count=len(texts)) / 100))


def _cosines(row, f, x, idf, centroids, n: int) -> np.ndarray:
    v = (1 + np.log(x)) * idf[f]
    norm = np.sqrt(np.bincount(row, v * v, minlength=n))
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    sums = np.add.reduceat(centroids[f] * v[:, None].astype(np.float32), starts, axis=0)
    out = np.zeros((n, centroids.shape[1]))
    out[row[starts]] = sums / np.maximum(norm[row[starts]], 1e-12)[:, None]
    return out


def _centres(row, f, v, group, k: int) -> np.ndarray:
    """Unit mean vectors of the rows of each group, as columns; rows of group -1 are left out."""
    use = group[row] >= 0
    flat = np.bincount(f[use] * k + group[row[use]], v[use], minlength=_DIM * k).reshape(_DIM, k)
    return (flat / np.maximum(np.sqrt((flat**2).sum(0)), 1e-12)).astype(np.float32)


def fit_model(texts: Sequence[str], labels: Sequence[str], clusters: int = 3, rounds: int = 6, least: int = 5) -> LanguageModel:
    """Fit on labelled texts; labels may be wrong in part, languages of fewer than `least` texts are left out."""
    names, count = np.unique(np.array(labels, dtype=object).astype(str), return_counts=True) if len(labels) else (np.array([]), np.array([]))
    languages = [str(x) for x, n in zip(names, count, strict=True) if n >= least]
    pieces, group = [], []
    for t, lab in zip(texts, labels, strict=True):
        if lab in languages:
            own = [p for p in _ROUGH.split(t) if p and len(p) >= 12] or [t]
            pieces += own
            group += [languages.index(lab)] * len(own)
    if not pieces:
        return LanguageModel(np.zeros(_DIM), np.zeros((_DIM, 0), np.float32), np.zeros(0, int), [], np.zeros(0))
    row, f, x = features(pieces)
    n, group = len(pieces), np.array(group)
    idf = np.log((1 + n) / (1 + np.bincount(f, minlength=_DIM))) + 1.0
    v = (1 + np.log(x)) * idf[f]
    v /= np.maximum(np.sqrt(np.bincount(row, v * v, minlength=n)), 1e-12)[row]

    def nearest(centres: np.ndarray) -> np.ndarray:
        out = np.zeros((n, centres.shape[1]), np.float32)
        cuts = [*range(0, n, 4000), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = np.searchsorted(row, [a, b])
            if hi > lo:
                starts = np.flatnonzero(np.concatenate(([True], row[lo + 1 : hi] != row[lo : hi - 1])))
                out[row[lo:hi][starts]] = np.add.reduceat(centres[f[lo:hi]] * v[lo:hi, None].astype(np.float32), starts, axis=0)
        return out

    for _ in range(rounds):
        group = nearest(_centres(row, f, v, group, len(languages))).argmax(1)
    owner, centres = [], []
    for k in range(len(languages)):
        own = np.flatnonzero(group == k)
        if not len(own):
            continue
        part = np.full(n, -1)
        size = min(clusters, max(1, len(own) // 50))
        part[own] = np.arange(len(own)) % size
        for _ in range(rounds):
            c = _centres(row, f, v, part, size)
            part[own] = nearest(c)[own].argmax(1)
        for j in range(size):
            if (part == j).any():
                one = np.where(part == j, 0, -1)
                centres.append(_centres(row, f, v, one, 1)[:, 0])
                owner.append(k)
    centroids = np.stack(centres, 1)
    best = nearest(centroids).max(1)
    # scripts of many letters have few n-grams in common, so each language has a floor of its own
    best = best / np.maximum(_length_share(pieces), 1e-9)
    floor = np.array([np.quantile(best[group == k], 0.001) * 0.2 if (group == k).any() else 0.0 for k in range(len(languages))])
    return LanguageModel(idf, centroids, np.array(owner), languages, floor)


def fit_from(df: DataFrame, text: str, label: str, per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most about `per_language` different labelled texts a language, chosen by a hash of the text; copies count once."""
    named = df.select(F.col(text).alias("text"), language_code(F.col(label)).alias("code")).where(
        F.col("code").isNotNull() & F.length("text").between(40, SAMPLE_CHARS)
    ).withColumn("hash", F.xxhash64("text"))
    counts = {r.code: r["count"] for r in named.select("code", "hash").distinct().groupBy("code").count().collect()}  # at most one row per two-letter code
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col("code") == code, min(1.0, per_language / n)).otherwise(share)
    # copies have one hash, so they are picked together and fall together before anything reaches the driver
    picked = named.where(F.pmod("hash", F.lit(1_000_000)) < share * 1_000_000).select("text", "code").distinct()
    rows = picked.toPandas().sort_values(["code", "text"])
    return fit_model(rows["text"].tolist(), rows["code"].tolist())


def label_texts(df: DataFrame, model: LanguageModel, key: str, text: str) -> DataFrame:
    """`(key, lang, confidence)` of whole texts; null or letterless texts are `und` with confidence 0."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            lang, conf = model.classify([t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.DataFrame({"key": pdf["key"], "lang": lang, "confidence": conf})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, lang string, confidence double")
