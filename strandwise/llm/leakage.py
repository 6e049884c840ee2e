"""Evaluation texts leaking into training text, by spaced-seed hashing.

Seven fixed masks over word positions ignore the places where a word may be changed. They are complete for
the rule "at least 18 consecutive words, at most one in ten changed": let the changed words cut the stretch
into intact runs. One change leaves a run of 9 (mask 1). With k >= 2 changes at least 9k words are intact in
k+1 runs; were all runs below 9, two neighbours would have 5 words each (mask 2) or k = 2 with a middle run
under 5 between two runs of 6 or more (masks 3 to 7).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.fingerprints import in_map, map_of
from strandwise.session import cut

MASKS = ("1" * 9, "11111011111", *(f"11111{'0'}{'1' * b}{'0'}11111" for b in range(5)))
MIN_WORDS, CHANGED_SHARE = 18, 10
#: Largest number of rows (item, place, seed) of the evaluation side that are sent to every task; beyond it the join is shuffled.
SENT_SEEDS = 2_000_000

#: Odd multipliers: nine for the words of a run, three for the runs of each mask.
_ODD = np.random.default_rng(20_240_501).integers(1, 2**63, size=9 + 3 * len(MASKS), dtype=np.uint64) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Letters without a decomposition and their plain spelling.
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"})
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_BROKEN = re.compile(r"[-­‐‑]\s*[\r\n]\s*")
_INNER_BREAK = re.compile(r"(?<=[^\W\d_])[\r\n]+(?=[^\W\d_])")
_NO_SPACES = re.compile(r"([぀-ヿ㐀-鿿])")


@lru_cache(200_000)
def canonical(word: str) -> str:
    """A word without case, accents (and their spelling-out) and everything that is neither letter nor digit."""
    plain = unicodedata.normalize("NFKD", word.lower().translate(_PLAIN))
    plain = "".join(c for c in plain if c.isalnum())
    return plain.replace("ae", "a").replace("oe", "o").replace("ue", "u")


class _Hashes(dict):
    """Hash of the canonical form by word as written; 0 for words that have none."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = canonical(word)
        out = self[word] = (xxhash.xxh3_64_intdigest(plain.encode()) or 1) if plain else 0
        return out


_HASHES = _Hashes()


def _raw_words(text: str, variant: int) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = _BROKEN.sub("", text)
    if variant:
        text = _INNER_BREAK.sub("", text)
    if not text.isascii():
        text = _NO_SPACES.sub(r" \1 ", text)
    return text.split()


def words_of(text: str, variant: int = 0) -> list[str]:
    """Canonical words; variant 1 also takes line breaks between letters for breaks inside words."""
    return [w for w in map(canonical, _raw_words(text, variant)) if w]


def hashes_of(text: str, variant: int = 0) -> np.ndarray:
    """The hashes of `words_of`."""
    raw = _raw_words(text, variant)
    out = np.fromiter(map(_HASHES.__getitem__, raw), dtype=np.uint64, count=len(raw))
    return out[out != 0]


def seeds_of(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask its number and the hashes of all placements, by first word; runs of equal length share their sums."""
    n = len(tokens)
    runs = [np.zeros(n, dtype=np.uint64)]
    for k in range(9):
        if n <= k:
            break
        runs.append(runs[-1][: n - k] + tokens[k:] * _ODD[k])
    for m, mask in enumerate(MASKS):
        places = n - len(mask) + 1
        if places <= 0:
            continue
        total = np.full(places, m + 1, dtype=np.uint64)
        at = 0
        for j, run in enumerate(mask.split("0")):
            if run:
                total += runs[len(run)][at : at + places] * _ODD[9 + 3 * m + j % 3]
            at += len(run) + 1
        total ^= total >> np.uint64(31)
        yield m, total * _GOLDEN


def _variants(text: str) -> tuple[int, ...]:
    return (0, 1) if _INNER_BREAK.search(text) else (0,)


def _emit(id_col: str, text_col: str, variants: bool):
    """All seeds with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, places, hashes, kinds, held = [], [], [], [], 0
            for ident, text in zip(pdf[id_col], pdf[text_col], strict=True):
                for v in (_variants(text) if variants else (0,)) if isinstance(text, str) else ():
                    for _, h in seeds_of(hashes_of(text, v)):
                        ids += [ident] * len(h)
                        places.append(np.arange(len(h)))
                        hashes.append(h.view(np.int64))
                        kinds.append(np.full(len(h), v))
                        held += len(h)
                if held > 200_000:
                    yield pd.DataFrame({"id": ids, "variant": np.concatenate(kinds), "place": np.concatenate(places), "seed": np.concatenate(hashes)})
                    ids, places, hashes, kinds, held = [], [], [], [], 0
            if held:
                yield pd.DataFrame({"id": ids, "variant": np.concatenate(kinds), "place": np.concatenate(places), "seed": np.concatenate(hashes)})

    return run


def _scan(tests: pd.DataFrame, passages: dict):
    """Look up the seeds of each document and verify the hits while its words are at hand; for an evaluation side of bounded size."""
    tests = tests.sort_values("seed", key=lambda x: x.astype(np.int64).to_numpy().view(np.uint64))
    known, items, item_places = tests["seed"].to_numpy(np.int64).view(np.uint64), tests["item"].to_numpy(), tests["item_place"].to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[known >> np.uint64(44)] = True
        wanted = {k: hashes_of(t) for k, t in passages.items()}
        for pdf in batches:
            docs, found = [], []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                if not isinstance(text, str):
                    continue
                here: set = set()
                for v in _variants(text):
                    tokens, tried = hashes_of(text, v), set()
                    for _, h in seeds_of(tokens):
                        at = np.flatnonzero(bits[h >> np.uint64(44)])
                        lo = np.searchsorted(known, h[at], side="left")
                        hi = np.searchsorted(known, h[at], side="right")
                        for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                            for k in range(x, y):
                                item, offset = items[k], p - int(item_places[k])
                                if item not in here and (item, offset) not in tried:
                                    tried.add((item, offset))
                                    if holds(tokens, wanted[item], offset):
                                        here.add(item)
                docs += [doc] * len(here)
                found += here
            if docs:
                yield pd.DataFrame({"doc": docs, "item": found})

    return run


def holds(doc: np.ndarray, item: np.ndarray, offset: int) -> bool:
    """Whether `item` (hashes of words, as `doc`) placed at word `offset` of `doc` has a long enough stretch with few enough changes."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    if hi - lo < MIN_WORDS:
        return False
    wrong = (doc[offset + lo : offset + hi] != item[lo:hi]).astype(np.int64)
    # changed * 10 <= length for a stretch [a, b): the running sum of (1 - 10 * wrong) must not fall from a to b
    run = np.concatenate(([0], np.cumsum(1 - CHANGED_SHARE * wrong)))
    lowest = np.minimum.accumulate(run[: len(run) - MIN_WORDS])
    return bool((run[MIN_WORDS:] >= lowest).any())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for text, passage, offsets in zip(pdf["text"], pdf["passage"], pdf["offsets"], strict=True):
            item, docs = hashes_of(passage), {}
            ok = False
            for x in offsets:
                v, offset = int(x["variant"]), int(x["offset"])
                if v not in docs:
                    docs[v] = hashes_of(text, v)
                if holds(docs[v], item, offset):
                    ok = True
                    break
            keep.append(ok)
        if any(keep):
            yield pd.DataFrame({c: pdf[c].to_numpy()[keep] for c in ("doc", "item")})


def leaked_items(
    corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage",
    sent_seeds: int = SENT_SEEDS,
) -> DataFrame:
    """Distinct `(doc, item)`: the document holds 18 or more consecutive words of the passage, one in ten changed at most.

    Null texts and passages and passages under 18 words match nothing; repeated rows count once; empty tables give
    no rows; other columns are ignored, whatever their names. Whole texts are read. The seeds of the items go to
    every task only up to `sent_seeds` rows, and the hits are then verified in the same pass; more are joined by a
    shuffle, with the same result.
    """
    left = corpus.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0)
    right = items.select(F.col(item_id).alias("item"), F.col(passage).alias("passage")).where(F.length("passage") > 0).distinct()
    id_types = dict(left.dtypes)["doc"], dict(right.dtypes)["item"]
    emitted = "variant int, place int, seed long"
    tests = right.mapInPandas(_emit("item", "passage", False), f"id {id_types[1]}, {emitted}").select(
        F.col("id").alias("item"), F.col("place").alias("item_place"), "seed"
    )
    # passages of one item that differ are told apart by their number
    first = right.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    some = tests.limit(sent_seeds + 1).toPandas() if first else None
    if some is not None and len(some) <= sent_seeds:
        # as many passages as have seeds at most, and no more words than seeds
        passages = {r.item: r.passage for r in right.join(F.broadcast(tests.select("item").distinct()), "item").toLocalIterator()}
        return left.mapInPandas(_scan(some, passages), f"doc {id_types[0]}, item {id_types[1]}").distinct()
    hits = left.mapInPandas(_emit("doc", "text", True), f"id {id_types[0]}, {emitted}")
    offsets = cut(
        hits.join(tests.distinct(), "seed")
        .groupBy(F.col("id").alias("doc"), "item")
        .agg(F.collect_set(F.struct("variant", (F.col("place") - F.col("item_place")).alias("offset"))).alias("offsets"))
    )
    # texts of documents without a hit stay where they are: a map of fixed size tells them
    texts = in_map(left, F.xxhash64("doc"), map_of(offsets, F.xxhash64("doc")))
    return (
        offsets.join(texts, "doc").join(right, "item")
        .select("doc", "item", "text", "passage", "offsets")
        .mapInPandas(_verify, f"doc {id_types[0]}, item {id_types[1]}")
        .distinct()
    )
