"""Fuzzy title duplicates and order-dependent greedy deduplication.

Similarity is 2M / T, with M the characters in matching blocks and T the length of both titles. A pair at threshold t
loses at most (1 - t) T characters outside the blocks. Titles of years that fit are compared in blocks: by bits of which a
lost character changes one, then by their longest common subsequence, which the blocks are part of; so no pair at the
threshold is missed, and nothing but the titles is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.session import cut, shuffle_partitions

THRESHOLD, YEAR_WINDOW = 0.92, 1


def similarity(left: str, right: str) -> float:
    """Ratio of matching blocks of two normalised titles; 0 if either is empty. The order of the arguments matters."""
    return SequenceMatcher(None, left, right).ratio() if left and right else 0.0


#: Bits of a sketch; rows of a side that one task compares.
_SKETCH, _BLOCK = 256, 50_000
#: Pairs that are compared in one step of a task.
_STEP = 1 << 18


def _sketch(titles: list[str]) -> list[bytes]:
    """Parities of the characters with their occurrence numbers, by hash bucket: a lost character changes one bit."""
    size = np.array([len(t) for t in titles], dtype=np.int64)
    chars = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    one = np.repeat(np.arange(len(titles)), size) << 21 | chars
    order = np.argsort(one, kind="stable")
    one = one[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])[: len(one)]
    k = np.arange(len(one)) - np.repeat(first, np.diff(np.r_[first, len(one)])) + 1
    hashed = ((one & 0x1FFFFF) * 0x9E3779B1 + k * 0x85EBCA77 & 0xFFFFFFFF).astype(np.uint64) * np.uint64(0xC2B2AE35) >> np.uint64(15)
    at = (one >> 21) * _SKETCH + (hashed % np.uint64(_SKETCH)).astype(np.int64)
    odd = np.bincount(at, minlength=len(titles) * _SKETCH).astype(np.uint8) & 1
    return [x.tobytes() for x in np.packbits(odd.reshape(len(titles), _SKETCH), axis=1, bitorder="little")]


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(bits=_sketch(pdf["key"].tolist()))


def _bits(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), -1)


def _start(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; matching blocks are never longer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        m = masks.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _loses(a: str, b: str, most: float) -> bool:
    """Whether at most so many characters lie outside the longest common subsequence, which has the common start and end."""
    n = _start(a, b)
    x, y = a[n:], b[n:]
    n = _start(x[::-1], y[::-1])
    x, y = x[: len(x) - n], y[: len(y) - n]
    return len(x) + len(y) <= most or len(x) + len(y) - 2 * _common(x, y) <= most


def _bounds(threshold: float, size: np.ndarray) -> np.ndarray:
    """Characters that a pair of so many may lose."""
    return np.floor((1 - threshold) * size + 1e-9)


def _side(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A block of titles by length, and the lengths."""
    size = pdf["key"].str.len().to_numpy(dtype=np.int64)
    order = np.argsort(size, kind="stable")
    return pdf.iloc[order].reset_index(drop=True), size[order]


def _scan(key: tuple, left: pd.DataFrame, a: np.ndarray, right: pd.DataFrame, b: np.ndarray, threshold: float, window: int, shorter: bool) -> Iterator[tuple]:
    """Places (i, j) of two blocks by length with few enough bits apart and years that can fit, the bits, and what may be lost; all of an i together."""
    kind, cell = key[:2]
    wa, wb = _bits(left), _bits(right)
    fa, fb = np.bitwise_xor.reduce(wa, axis=1), np.bitwise_xor.reduce(wb, axis=1)
    x_low, x_high, y_low, y_high = [d[c].to_numpy() for d in (left, right) for c in ("low", "high")]
    ratio = threshold / (2 - threshold)
    sizes, starts = np.unique(a, return_index=True)
    for n, s, e in zip(sizes, starts, [*starts[1:], len(a)], strict=True):
        lo = np.searchsorted(b, int(np.ceil(n * ratio - 1e-9)))
        hi = np.searchsorted(b, n if shorter else int(n / ratio + 1e-9), side="right")
        if lo == hi:
            continue
        most = _bounds(threshold, n + b[lo:hi])
        step = max(1, _STEP // (hi - lo))
        for at in range(s, e, step):
            to = min(e, at + step)
            i, j = np.nonzero(np.bitwise_count(fa[at:to, None] ^ fb[None, lo:hi]) <= np.minimum(most, 255).astype(np.uint8))
            i, j, m = i + at, j + lo, most[j]
            apart = np.bitwise_count(wa[i] ^ wb[j]).sum(axis=1)
            keep = (apart <= m) & (x_low[i] <= y_high[j] + window) & (y_low[j] <= x_high[i] + window)
            if kind == 0:  # years that reach over several cells meet in the first
                keep &= np.maximum(x_low[i] - window, y_low[j]) == cell
            yield i[keep], j[keep], apart[keep], m[keep]


def _close(threshold: float, window: int, shorter: bool):
    """Rows (x, y) of two blocks of titles that lose few enough characters and have years that can fit."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"x": left["id"][:0], "y": right["id"][:0]})
        if left.empty or right.empty:
            return none
        (left, a), (right, b) = _side(left), _side(right)
        x_ids, x_keys, y_ids, y_keys = [d[c].to_numpy() for d in (left, right) for c in ("id", "key")]
        xs, ys = [], []
        for i, j, _, m in _scan(key, left, a, right, b, threshold, window, shorter):
            for x, y, most in zip(i.tolist(), j.tolist(), m.tolist(), strict=True):
                if x_ids[x] == y_ids[y] or (shorter and a[x] == b[y] and x_ids[x] < y_ids[y]):
                    continue
                if _loses(x_keys[x], y_keys[y], most):
                    xs.append(x)
                    ys.append(y)
        return pd.DataFrame({"x": x_ids[xs], "y": y_ids[ys]}) if xs else none

    return run


def _met(x_keys: np.ndarray, y_keys: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray, most: np.ndarray, threshold: float) -> list[int]:
    """Each i of which some pair is at the threshold; those with the fewest bits apart are tried first, and none after the first that is."""
    order = np.lexsort((apart, i))
    out, last = [], -1
    for x, y, m in zip(i[order].tolist(), j[order].tolist(), most[order].tolist(), strict=True):
        if x != last and _loses(x_keys[x], y_keys[y], m) and similarity(x_keys[x], y_keys[y]) >= threshold:
            out.append(x)
            last = x
    return out


def _any(threshold: float, window: int):
    """Ids of the left block's titles that some title of the right one is the same as."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[["id"]][:0]
        (left, a), (right, b) = _side(left), _side(right)
        x_keys, y_keys = left["key"].to_numpy(), right["key"].to_numpy()
        found = [x for some in _scan(key, left, a, right, b, threshold, window, False) for x in _met(x_keys, y_keys, *some, threshold)]
        return left[["id"]].iloc[found]

    return run


#: Rows before and after a title, in the order of titles, that it is compared with first.
_BESIDE = 64


def _beside(threshold: float, window: int):
    """Ids of new titles in sorted batches that some old title near them is the same as."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = pdf["new"].to_numpy(dtype=bool)
            asked, words = np.flatnonzero(new), _bits(pdf)
            size, low, high = pdf["key"].str.len().to_numpy(dtype=np.int64), pdf["low"].to_numpy(), pdf["high"].to_numpy()
            some = []
            for d in range(-_BESIDE, _BESIDE + 1):
                i = asked[(asked + d >= 0) & (asked + d < len(pdf))]
                i = i[~new[i + d] & (low[i] <= high[i + d] + window) & (low[i + d] <= high[i] + window)]
                apart, most = np.bitwise_count(words[i] ^ words[i + d]).sum(axis=1), _bounds(threshold, size[i] + size[i + d])
                keep = apart <= most
                some.append((i[keep], i[keep] + d, apart[keep], most[keep]))
            keys = pdf["key"].to_numpy()
            yield pdf[["id"]].iloc[_met(keys, keys, *[np.concatenate(x) for x in zip(*some, strict=True)], threshold)]

    return run


def _signed(df: DataFrame, *more: str) -> DataFrame:
    """Titles `(id, key, low, high)` and more columns with their bits, kept."""
    df = df.select("id", "key", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), *more)
    return cut(df.mapInPandas(_sketches, ", ".join(f"{n} {t}" for n, t in [*df.dtypes, ("bits", "binary")])))


def _cells(asked: DataFrame, known: DataFrame, window: int):
    """Groups of asked and of known signed titles whose years, from low to high, can fit: each pair meets in one at least.

    Titles meet in cells of one year, those without a year or of many years with all; a cell is cut into blocks of `_BLOCK`
    rows, each pair of them one group.
    """
    spark = asked.sparkSession
    low, high, wide = F.col("low"), F.col("high"), F.col("high") - F.col("low") > 3
    # kinds of cells: 0 both of some years, 1 asked of many with all, 2 asked of some with known of many
    year = lambda k, x: F.struct(F.lit(k).alias("kind"), x.cast("long").alias("cell"))
    sides = []
    for rows, many, some in (
        (asked, [1], lambda: F.concat(F.transform(F.sequence(low - window, high + window), lambda x: year(0, x)), F.array(year(2, F.lit(0))))),
        (known, [1, 2], lambda: F.concat(F.transform(F.sequence(low, high), lambda x: year(0, x)), F.array(year(1, F.lit(0))))),
    ):
        cells = F.when(wide, F.array(*[year(k, F.lit(0)) for k in many])).otherwise(some())
        sides.append(rows.withColumn("c", F.explode(cells)).select("id", "key", "low", "high", "bits", "c.kind", "c.cell"))
    # blocks of the cells that have more than one: no more cells than blocks come to the driver
    blocks = [{(r.kind, r.cell): -(-r.n // _BLOCK) for r in d.groupBy("kind", "cell").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK).collect()} for d in sides]

    def number(of: dict) -> Column:
        out = F.lit(1)
        for (k, c), n in of.items():
            out = F.when((F.col("kind") == k) & (F.col("cell") == c), n).otherwise(out)
        return out

    groups = []
    for k, d in enumerate(sides):
        own, other = F.pmod(F.xxhash64("id"), number(blocks[k])).cast("int"), F.explode(F.sequence(F.lit(0), number(blocks[1 - k]) - 1))
        d = d.withColumn("own", own).withColumn("other", other).withColumnsRenamed({"own": "bx", "other": "by"} if k == 0 else {"own": "by", "other": "bx"})
        groups.append(d.repartition(shuffle_partitions(spark), "kind", "cell", "bx", "by").groupBy("kind", "cell", "bx", "by"))
    return groups[0].cogroup(groups[1])


def _near(asked: DataFrame, known: DataFrame, threshold: float, window: int, shorter: bool = False) -> DataFrame:
    """`(x, y)`, each once: asked and known titles `(id, key, low, high)` that lose few enough characters by their longest common
    subsequence and have years, from low to high, that can fit; no pair at the threshold is missed.

    With `shorter` both are one table, and of a pair the longer title (of equal ones the larger id) is x.
    """
    kind = dict(asked.dtypes)["id"]
    return _cells(_signed(asked), _signed(known), window).applyInPandas(_close(threshold, window, shorter), f"x {kind}, y {kind}")


def _span(year: str = "year") -> tuple[Column, Column]:
    """`low` and `high` of years; a missing one reaches over all."""
    return F.min(F.coalesce(F.col(year), F.lit(-100_000_000))).alias("low"), F.max(F.coalesce(F.col(year), F.lit(100_000_000))).alias("high")


def fuzzy_pairs(df: DataFrame, threshold: float = THRESHOLD, window: int = YEAR_WINDOW) -> DataFrame:
    """`(id_a, id_b, ratio)`, id_a < id_b, of titles at or above the threshold and years within the window.

    `df(id, key, year)` with unique ids and normalised titles. Equal titles are one class: its members are paired with the
    smallest id of the class only, other pairs run between class representatives of the same year, so copies do not multiply.
    A missing year fits every year; null and empty titles pair with nothing.
    """
    kind = dict(df.dtypes)["id"]
    rows = df.select("id", "key", "year").where(F.length("key") > 0)
    heads = cut(rows.groupBy("key", "year").agg(F.min("id").alias("id")))
    top = rows.join(heads.select("key", "year", F.col("id").alias("head")), (rows["key"] == heads["key"]) & rows["year"].eqNullSafe(heads["year"])).where("id <> head")
    copies = top.select(F.col("head").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("ratio"))
    signed = heads.groupBy("id", "key").agg(*_span())
    hits = _near(signed, signed, threshold, window, shorter=True).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    a, b = [heads.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(f"k_{s}"), F.col("year").alias(f"y_{s}")) for s in "ab"]
    near = hits.join(a, "id_a").join(b, "id_b").where(F.coalesce(F.abs(F.col("y_a") - F.col("y_b")) <= window, F.lit(True)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratio = np.array([similarity(y, x) for x, y in zip(pdf["k_a"], pdf["k_b"], strict=True)], dtype=float)
            keep = ratio >= threshold
            if keep.any():
                yield pd.DataFrame({"id_a": pdf["id_a"].to_numpy()[keep], "id_b": pdf["id_b"].to_numpy()[keep], "ratio": ratio[keep]})

    return near.select("id_a", "id_b", "k_a", "k_b").mapInPandas(score, f"id_a {kind}, id_b {kind}, ratio double").unionByName(copies)


def _fits(left: str, right: str, window: int) -> Column:
    """Years within the window; a missing year fits every year."""
    return F.coalesce(F.abs(F.col(left) - F.col(right)) <= window, F.lit(True))


def _scored(hits: DataFrame, titles: DataFrame, threshold: float, window: int) -> DataFrame:
    """`(x, y, xy, yx)`: hits between `titles(tid, key, years)` with both similarities, one at the threshold, and years that can fit."""
    x, y = [titles.select(F.col("tid").alias(s), F.col("key").alias(f"k{s}"), F.col("years").alias(f"years_{s}")) for s in "xy"]
    fit = F.exists("years_x", lambda a: F.exists("years_y", lambda b: F.coalesce(F.abs(a - b) <= window, F.lit(True))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, left, right in zip(pdf["x"], pdf["y"], pdf["kx"], pdf["ky"], strict=True):
                m = SequenceMatcher(None, left, right)
                if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold:  # bounds of both
                    xy, yx = m.ratio(), similarity(right, left)
                    if max(xy, yx) >= threshold:
                        rows.append((a, b, xy, yx))
            if rows:
                yield pd.DataFrame(rows, columns=["x", "y", "xy", "yx"])

    near = hits.distinct().join(x, "x").join(y, "y").where(fit).select("x", "y", "kx", "ky")
    return near.mapInPandas(run, "x long, y long, xy double, yx double")


def _titles(df: DataFrame) -> DataFrame:
    """`(tid, key, years, low, high)` of the titles that are not empty, each once and under a number."""
    # years are two for most titles and never more than there are years
    once = df.where(F.length("key") > 0).groupBy("key").agg(F.collect_set(F.struct("year")).alias("years"), *_span())
    return cut(once.withColumn("years", F.transform("years", lambda y: y["year"])).withColumn("tid", F.monotonically_increasing_id()))


def record_pairs(df: DataFrame, threshold: float = THRESHOLD, window: int = YEAR_WINDOW) -> DataFrame:
    """`(id_a, id_b, ratio, exact_key)`: records whose titles are at the threshold and whose years fit, the earlier as `id_a`.

    `df(id, ord, identity, key, year)`. Every pair of records counts, with the ratio of the earlier against the later one, and
    `exact_key` where they share their identity; of records of one title and year, which share that key, each is paired with
    the first only, so copies do not multiply.
    """
    titles = _titles(df)
    signed = titles.select(F.col("tid").alias("id"), "key", "low", "high")
    pair = _near(signed, signed, threshold, window, shorter=True)
    found = _scored(pair.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), titles, threshold, window)
    one = F.lit(1.0)
    found = found.unionByName(titles.where(F.size("years") > 1).select(F.col("tid").alias("x"), F.col("tid").alias("y"), one.alias("xy"), one.alias("yx")))
    r = cut(df.join(titles.select("key", "tid"), "key").select("id", "ord", "identity", "tid", "year"))
    x, y = [r.select(F.col("tid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "ord", "identity", "year")]) for s in "xy"]
    both = found.join(x, "x").join(y, "y").where(_fits("year_x", "year_y", window) & (F.col("id_x") != F.col("id_y")))
    both = both.where((F.col("x") != F.col("y")) | (~F.col("year_x").eqNullSafe(F.col("year_y")) & (F.col("ord_x") < F.col("ord_y"))))
    early = F.col("ord_x") < F.col("ord_y")
    pairs = both.select(
        F.when(early, F.col("id_x")).otherwise(F.col("id_y")).alias("id_a"), F.when(early, F.col("id_y")).otherwise(F.col("id_x")).alias("id_b"),
        F.when(early, F.col("xy")).otherwise(F.col("yx")).alias("ratio"), (F.col("identity_x") == F.col("identity_y")).alias("exact_key"),
    ).where(F.col("ratio") >= threshold)
    first = r.groupBy("tid", "year").agg(F.min_by("id", "ord").alias("id_a")).select(F.col("tid").alias("t"), F.col("year").alias("y"), "id_a")
    copies = r.join(first, (F.col("tid") == F.col("t")) & F.col("year").eqNullSafe(F.col("y"))).where("id <> id_a")
    return pairs.unionByName(copies.select("id_a", F.col("id").alias("id_b"), one.alias("ratio"), F.lit(True).alias("exact_key"))).distinct()


def _repeated(known: DataFrame, fresh: DataFrame, threshold: float, window: int) -> DataFrame:
    """`(title_key)` of fresh titles that a known one is the same as, at the threshold and with a year that fits.

    One known title decides, so each is compared with its neighbours in the order of the titles first, read forwards and
    backwards, and only what meets none there with all the others.
    """
    old = known.where(F.length("key") > 0).select("key", "year").distinct()
    new = fresh.where(F.length("key") > 0).select("title_key", "key", "year").distinct()
    same = old.select(F.col("key").alias("k"), F.col("year").alias("y"))
    other = new.join(same, (F.col("key") == F.col("k")) & _fits("year", "y", window), "left_anti")
    units = other.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)), allowMissingColumns=True)
    low, high = F.coalesce("year", F.lit(-100_000_000)).alias("low"), F.coalesce("year", F.lit(100_000_000)).alias("high")
    signed = _signed(units.select(F.monotonically_increasing_id().alias("id"), "title_key", "key", low, high, "new"), "title_key", "new")
    asked, old = signed.where("new"), signed.where(~F.col("new"))
    for order in (F.col("key"), F.reverse("key")):
        rows = asked.unionByName(old).withColumn("_order", order).repartitionByRange(shuffle_partitions(known.sparkSession), "_order").sortWithinPartitions("_order")
        met = rows.select("id", "key", "low", "high", "bits", "new").mapInPandas(_beside(threshold, window), "id long")
        asked = cut(asked.join(met, "id", "left_anti"))
    met = _cells(asked, old, window).applyInPandas(_any(threshold, window), "id long")
    left = asked.join(met, "id", "left_anti").select("title_key", "key", "low")
    return new.select("title_key", "key", low).join(left, ["title_key", "key", "low"], "left_anti").select("title_key").distinct()


def keep_new(known: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, window: int = YEAR_WINDOW) -> DataFrame:
    """`(id, kept)`: going through the candidates in order, one is kept iff no known and no earlier kept record is the same.

    Same are records that share the identity or the key of title and year, or whose titles are at the threshold with years
    that fit. `known(identity, title_key, key, year)`, `candidates(id, ord, identity, title_key, key, year)` with unique ids and
    orders; all titles of `known` are compared. Conflicts run over keys, not pairs, so copies do not multiply.
    """
    fresh = candidates
    for k in ("identity", "title_key"):
        both = known.select("identity").unionByName(known.select(F.col("title_key").alias("identity"))).distinct()
        fresh = fresh.join(both.withColumnRenamed("identity", k), k, "left_anti")
    fresh = cut(fresh)
    left = cut(fresh.join(_repeated(known, fresh, threshold, window), "title_key", "left_anti"))
    titles = _titles(left)
    signed = titles.select(F.col("tid").alias("id"), "key", "low", "high")
    hits = _near(signed, signed, threshold, window, shorter=True)
    # the later record is the left one; the same title with another year is the same at any threshold
    found = _scored(hits, titles, threshold, window)
    found = found.where(F.col("xy") >= threshold).select("x", "y").unionByName(found.where(F.col("yx") >= threshold).select(F.col("y").alias("x"), F.col("x").alias("y")))
    found = cut(found.unionByName(titles.where(F.size("years") > 1).select(F.col("tid").alias("x"), F.col("tid").alias("y"))))
    x, y = [left.join(titles.select("key", "tid"), "key").select(F.col("tid").alias(s), F.col("title_key").alias(f"class_{s}"), F.col("year").alias(f"year_{s}")).distinct() for s in "xy"]
    arcs = found.join(x, "x").join(y, "y").where(_fits("year_x", "year_y", window)).select(F.col("class_y").alias("title_key"), F.col("class_x").alias("k"))
    own = left.select("id", "ord", F.explode(F.array("identity", "title_key")).alias("k"))
    asks, takes = cut(own.distinct()), cut(own.unionByName(left.join(arcs, "title_key").select("id", "ord", "k")).distinct())
    kept = None
    while not asks.isEmpty():
        first = takes.groupBy("k").agg(F.min("ord").alias("first"))
        waits = asks.join(first, "k").where("first < ord").select("id").distinct()
        now = cut(asks.select("id").distinct().join(waits, "id", "left_anti"))
        kept = now if kept is None else cut(kept.unionByName(now))
        taken = takes.join(now, "id").groupBy("k").agg(F.min("ord").alias("first"))
        done = cut(asks.join(taken, "k").where("first < ord").select("id").unionByName(now).distinct())
        asks, takes = cut(asks.join(done, "id", "left_anti")), cut(takes.join(done, "id", "left_anti"))
    if kept is None:
        return candidates.select("id", F.lit(False).alias("kept"))
    return candidates.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`(node, kept)`: going through the nodes in order, one is kept iff it conflicts with no earlier kept one.

    `nodes(node, ord)` with unique orders, `edges(a, b)` in any direction. Each round drops what has a kept earlier neighbour and
    keeps what has no undecided earlier neighbour left, which gives the sequential result; rounds are cut in the shared folder.
    """
    order = nodes.select("node", "ord").distinct()
    o1, o2 = order.select(F.col("node").alias("a"), F.col("ord").alias("oa")), order.select(F.col("node").alias("b"), F.col("ord").alias("ob"))
    arcs = edges.select("a", "b").join(o1, "a").join(o2, "b").where("oa <> ob")
    arcs = cut(arcs.select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("late")).distinct())
    dropped = None
    while not arcs.isEmpty():
        blocked = arcs.select(F.col("late").alias("early")).distinct()
        kept = arcs.select("early").distinct().join(blocked, "early", "left_anti")
        out = cut(arcs.join(kept, "early").select(F.col("late").alias("node")).distinct())
        dropped = out if dropped is None else cut(dropped.unionByName(out))
        # arcs of decided nodes decide nothing more
        arcs = cut(arcs.join(out.withColumnRenamed("node", "late"), "late", "left_anti").join(out.withColumnRenamed("node", "early"), "early", "left_anti"))
    if dropped is None:
        return order.select("node", F.lit(True).alias("kept"))
    return order.join(dropped.withColumn("_out", F.lit(True)), "node", "left").select("node", F.col("_out").isNull().alias("kept"))
