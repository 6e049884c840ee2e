"""Long exact spans shared between records, by hashing of lines.

A unit is a line or sentence: it ends after a line break, after an ideographic end mark, or after white space
that follows an end mark. Whether a place ends a unit depends on the two characters before it only, so two
records with a common stretch cut it at the same places. Digests of units are grouped globally, and only units that
stand in several records go on.

Two records that share `length` characters from a cut on share the shortest sequence of whole units from that cut which
is at least so long (a forward chain), or, up to a cut, the same backwards (a backward chain). The chains are sorted by
digest and by the text beside them, read away from the chain: the neighbour of another record in that order is the one
with the longest common text, so one comparison with it gives the exact end of the stretch. Stretches whose whole
units make less than `length` lie in no chain; for those, if the groups of their inner units are not covered by one
chain, and for windows without any whole unit, the windows themselves are digested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.fingerprints import in_map, map_of
from strandwise.session import cut, shuffle_partitions

_UNIT_END = re.compile(r"(?<=\n)|(?<=[。！？])|(?<=[.!?…:;।؟฀-๿]\s)")
_CONTEXT = 2


def unit_bounds(text: str) -> np.ndarray:
    """Offsets that cut the text into units, 0 and the length included."""
    inner = [m.start() for m in _UNIT_END.finditer(text) if 0 < m.start() < len(text)]
    return np.array([0, *inner, len(text)], dtype=np.int64)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _units(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, places, digests, before, after = [], [], [], [], []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                if not isinstance(text, str) or len(text) < length:
                    continue
                b = unit_bounds(text)
                own = [_digest(text[i:j]) for i, j in zip(b[:-1], b[1:], strict=True)]
                docs += [doc] * len(own)
                places.append(np.arange(len(own)))
                digests += own
                before += [0, *own[:-1]]
                after += [*own[1:], 0]
            if docs:
                yield pd.DataFrame({"doc": docs, "unit": np.concatenate(places), "digest": digests, "before": before, "after": after})

    return run


def window_starts(bounds: np.ndarray, shared: np.ndarray, left_fixed: np.ndarray, right_fixed: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows to digest, given what is known of each unit of the text.

    `left_fixed` (`right_fixed`): every occurrence of the unit in the corpus follows (precedes) the same unit.
    """
    size, n = int(bounds[-1]), len(bounds) - 1
    if size < length:
        return np.zeros(0, dtype=np.int64)
    p = np.arange(size - length + 1)
    first = np.searchsorted(bounds, p + _CONTEXT, side="left")
    # the end of the text ends no unit: elsewhere the same line may go on
    last = np.searchsorted(bounds[:-1], p + length, side="right") - 1
    lone = np.concatenate(([0], np.cumsum(~shared)))
    whole = last > first
    possible = ~whole | (lone[np.maximum(last, first)] == lone[first])
    # the unit that begins first after p is `first`, the one that ends last in the window is `last - 1`
    unit_at = np.searchsorted(bounds, p, side="right") - 1
    near = (p - bounds[unit_at] <= _CONTEXT) | (bounds[np.minimum(unit_at + 1, n)] - p <= _CONTEXT)
    left = ~left_fixed[np.minimum(first, n - 1)]
    right = ~right_fixed[np.maximum(last - 1, 0)] | np.isin(p + length, bounds)
    return p[possible & (~whole | near | left | right)]


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, starts, high, low, held = [], [], [], [], 0
            for doc, text, facts in zip(pdf["doc"], pdf["text"], pdf["facts"], strict=True):
                b = unit_bounds(text)
                known = np.zeros((3, len(b) - 1), dtype=bool)
                if facts is not None:
                    f = np.asarray(facts, dtype=np.int64)
                    known[0, f >> 2] = True
                    known[1, f >> 2] = (f & 2) > 0
                    known[2, f >> 2] = (f & 1) > 0
                p = window_starts(b, *known, length)
                if not len(p):
                    continue
                raw = text.encode("utf-32-le", "surrogatepass")
                for s in p.tolist():
                    h = xxhash.xxh3_128_intdigest(raw[4 * s : 4 * (s + length)])
                    high.append((h >> 64) - 2**63)
                    low.append((h & (2**64 - 1)) - 2**63)
                docs += [doc] * len(p)
                starts.append(p)
                held += len(p)
                if held > 200_000:
                    yield pd.DataFrame({"doc": docs, "start_pos": np.concatenate(starts), "high": high, "low": low})
                    docs, starts, high, low, held = [], [], [], [], 0
            if held:
                yield pd.DataFrame({"doc": docs, "start_pos": np.concatenate(starts), "high": high, "low": low})

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Touching and overlapping intervals of a document as one."""
    for pdf in batches:
        docs, begins, ends = [], [], []
        for doc, parts in zip(pdf["doc"], pdf["parts"], strict=True):
            x = np.sort(np.asarray(parts, dtype=np.int64))
            start, end = x >> 32, np.maximum.accumulate(x & (2**32 - 1))
            new = np.concatenate(([True], start[1:] > end[:-1]))
            begins.append(start[new])
            ends.append(end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(x) - 1]))])
            docs += [doc] * int(new.sum())
        if docs:
            yield pd.DataFrame({"doc": docs, "start_pos": np.concatenate(begins), "end_pos": np.concatenate(ends)})


_FORWARD, _BACKWARD, _INNER, _WINDOW = 0, 1, 2, 3
_CHAIN = ["kind", "high", "low", "beside", "doc", "at", "far"]


def _halves(h: int) -> tuple[int, int]:
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def _spread(known: np.ndarray, bounds: np.ndarray, length: int):
    """For each place the cut that follows with its context inside, the last cut of the window, and whether all units between are shared."""
    p = np.arange(int(bounds[-1]) - length + 1)
    first = np.searchsorted(bounds, p + _CONTEXT, side="left")
    # the end of the text ends no unit: elsewhere the same line may go on
    last = np.searchsorted(bounds[:-1], p + length, side="right") - 1
    lone = np.concatenate(([0], np.cumsum(~known)))
    whole = last > first
    return p, first, last, whole, lone, whole & (lone[np.maximum(last, first)] == lone[first])


def _chains(length: int):
    """Chains of shared units with the text beside them, inner sequences of windows, and digests of windows without whole units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text, facts in zip(pdf["doc"], pdf["text"], pdf["facts"], strict=True):
                b = unit_bounds(text)
                n = len(b) - 1
                known = np.zeros(n, dtype=bool)
                if facts is not None:
                    known[np.asarray(facts, dtype=np.int64)] = True
                p, first, last, whole, lone, inside = _spread(known, b, length)
                raw = text.encode("utf-32-le", "surrogatepass")
                digest = lambda x, y: xxhash.xxh3_128_intdigest(raw[4 * x : 4 * y])  # noqa: E731, B023
                forward, backward = {}, {}
                for i in range(1, n):
                    e = int(np.searchsorted(b[:-1], b[i] + length, side="left"))
                    if e < n and lone[e] == lone[i]:
                        h = digest(int(b[i]), int(b[e]))
                        forward[i] = h
                        lo = max(0, int(b[i - 1]) - _CONTEXT)
                        rows.append((_FORWARD, *_halves(h), text[lo : b[i]][::-1], doc, int(b[i]), int(b[e]), 0, 0))
                    s = int(np.searchsorted(b, b[i] - length, side="right")) - 1
                    # a chain begins at a cut that the other record makes too
                    if s >= 1 and lone[i] == lone[s]:
                        h = digest(int(b[s]), int(b[i]))
                        backward[i] = h
                        rows.append((_BACKWARD, *_halves(h), text[b[i] : b[i + 1]], doc, int(b[i]), int(b[s]), 0, 0))
                for x in np.unique(first[inside] * (n + 1) + last[inside]).tolist():
                    i, j = divmod(x, n + 1)
                    rows.append((_INNER, _digest(text[b[i] : b[j]]), 0, "", doc, i, j, forward.get(i, 0) & (2**63 - 1), backward.get(j, 0) & (2**63 - 1)))
                for x in p[~whole].tolist():
                    rows.append((_WINDOW, *_halves(digest(x, x + length)), "", doc, x, 0, 0, 0))
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=[*_CHAIN, "forward", "backward"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*_CHAIN, "forward", "backward"])

    return run


def _inner_windows(length: int):
    """Digests of the windows whose whole units are one of the given sequences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text, inner in zip(pdf["doc"], pdf["text"], pdf["inner"], strict=True):
                b = unit_bounds(text)
                p, first, last, _, _, _ = _spread(np.ones(len(b) - 1, dtype=bool), b, length)
                raw = text.encode("utf-32-le", "surrogatepass")
                for x in p[np.isin(first.astype(np.int64) << 32 | last, np.asarray(inner, dtype=np.int64))].tolist():
                    rows.append((*_halves(xxhash.xxh3_128_intdigest(raw[4 * x : 4 * (x + length)])), doc, x))
            if rows:
                yield pd.DataFrame(rows, columns=["high", "low", "doc", "at"])

    return run


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last row of a sorted partition, and the nearest ones of another document; four rows at most."""
    parts = [x for x in batches if len(x)]
    if not parts:
        return
    head, tail = parts[0].iloc[:1], parts[-1].iloc[-1:]
    other_head = next((o.iloc[:1] for x in parts if len(o := x[x["doc"] != head["doc"].iloc[0]])), None)
    other_tail = next((o.iloc[-1:] for x in reversed(parts) if len(o := x[x["doc"] != tail["doc"].iloc[0]])), None)
    for place, row in enumerate((head, other_head, other_tail, tail)):
        if row is not None:
            yield row.assign(place=place)


def _common(a: str, b: str) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        m = (lo + hi + 1) // 2
        lo, hi = (m, hi) if a[:m] == b[:m] else (lo, m - 1)
    return lo


def _neighbours(before: dict[int, list[tuple]], after: dict[int, list[tuple]]):
    """The stretch of each chain that the nearest neighbour of another document shares; `before` and `after` come from other partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        x = pd.concat(parts, ignore_index=True)
        pid = int(x["pid"].iloc[0])
        key = list(zip(x["kind"], x["high"], x["low"], strict=True))
        doc, beside = x["doc"].to_numpy(), x["beside"].to_numpy()
        n = len(x)
        change = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        run_of = np.repeat(np.arange(len(change) - 1), np.diff(change))
        docs, begins, ends = [], [], []
        at, far = x["at"].to_numpy(), x["far"].to_numpy()
        for t in range(n):
            best = -1
            for k, edge in ((int(change[run_of[t]]) - 1, before), (int(change[run_of[t] + 1]), after)):
                if 0 <= k < n:
                    found = (key[k], beside[k])
                else:
                    found = next(((o[0], o[1]) for o in edge.get(pid, ()) if o[2] != doc[t]), None)
                if found is not None and found[0] == key[t]:
                    best = max(best, _common(beside[t], found[1]))
            if best >= 0:
                docs.append(doc[t])
                forward = key[t][0] == _FORWARD
                begins.append(at[t] - best if forward else far[t])
                ends.append(far[t] if forward else at[t] + best)
        if docs:
            yield pd.DataFrame({"doc": docs, "start_pos": np.array(begins, dtype=np.int32), "end_pos": np.array(ends, dtype=np.int32)})

    return run


def _shared_intervals(corpus: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """`(doc, start_pos, end_pos)`: stretches, not merged yet, whose every window stands in another document, all of them together."""
    docs = corpus.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= length)
    kind = dict(docs.dtypes)["doc"]
    units = cut(docs.mapInPandas(_units(length), f"doc {kind}, unit int, digest long, before long, after long").select("doc", "unit", "digest"))
    shared = units.groupBy("digest").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("digest")
    facts = units.join(shared, "digest").groupBy("doc").agg(F.collect_list("unit").alias("facts"))
    chains = cut(docs.join(facts, "doc", "left").mapInPandas(
        _chains(length), f"kind int, high long, low long, beside string, doc {kind}, at int, far int, forward long, backward long"
    ))
    # sorted once over all partitions, so no group of copies is one task; four rows a partition tell its neighbours
    spark = corpus.sparkSession
    ends = chains.where(F.col("kind") <= _BACKWARD).select(*_CHAIN)
    order = ["kind", "high", "low", "beside", "doc"]
    ends = cut(ends.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    edges = ends.mapInPandas(_edges, f"{', '.join(f'{n} {t}' for n, t in ends.dtypes)}, place int").collect()
    before, after = _links(edges)
    grown = ends.mapInPandas(_neighbours(before, after), f"doc {kind}, start_pos int, end_pos int")
    # sequences of inner units that no one chain covers in all their documents
    inner = chains.where(F.col("kind") == _INNER)
    one_chain = [(F.min(c) == F.max(c)) & (F.min(c) != 0) for c in ("forward", "backward")]
    open_ = inner.groupBy("high").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), (one_chain[0] | one_chain[1]).alias("covered")).where("d0 < d1 and not covered").select("high")
    wanted = cut(inner.join(open_, "high").groupBy("doc").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("far")).alias("inner")))
    texts = in_map(docs, F.xxhash64("doc"), map_of(wanted, F.xxhash64("doc")))
    windows = texts.join(wanted, "doc").mapInPandas(_inner_windows(length), f"high long, low long, doc {kind}, at int")
    windows = cut(windows.unionByName(chains.where(F.col("kind") == _WINDOW).select("high", "low", "doc", "at")))
    twice = windows.groupBy("high", "low").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("high", "low")
    found = windows.join(twice, ["high", "low"]).select("doc", F.col("at").alias("start_pos"), (F.col("at") + length).alias("end_pos"))
    return grown.unionByName(found)


def _links(edges: list) -> tuple[dict[int, list[tuple]], dict[int, list[tuple]]]:
    """For each partition the nearest rows, of two documents at most, in the partitions before and after it: (key, text beside, document)."""
    by_pid: dict[int, dict[int, tuple]] = {}
    for r in edges:
        by_pid.setdefault(r.pid, {})[r.place] = ((r.kind, r.high, r.low), r.beside, r.doc)
    out: tuple[dict, dict] = ({}, {})
    for side, pids, places in ((0, sorted(by_pid), (3, 2)), (1, sorted(by_pid, reverse=True), (0, 1))):
        carry: list[tuple] = []
        for pid in pids:
            out[side][pid] = carry
            own = [by_pid[pid][k] for k in places if k in by_pid[pid]]
            # rows further away follow, as long as they are of another document
            carry = (own + [x for x in carry if all(x[2] != o[2] for o in own)])[:2]
    return out


def _shared_windows(corpus: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """`(doc, start_pos, first_doc)`: digested windows that stand in two or more documents, with the first of them."""
    docs = corpus.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= length)
    kind = dict(docs.dtypes)["doc"]
    units = docs.mapInPandas(_units(length), f"doc {kind}, unit int, digest long, before long, after long")
    shared = (
        units.groupBy("digest")
        .agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"))
        .where("d0 < d1")
        .select("digest", ((F.col("b0") == F.col("b1")).cast("int") * 2 + (F.col("a0") == F.col("a1")).cast("int")).alias("fixed"))
    )
    facts = (
        units.select("doc", "unit", "digest").join(shared, "digest")
        .groupBy("doc").agg(F.collect_list(F.col("unit").cast("long") * 4 + F.col("fixed")).alias("facts"))
    )
    windows = cut(
        docs.join(facts, "doc", "left").select("doc", "text", "facts").mapInPandas(_windows(length), f"doc {kind}, start_pos int, high long, low long")
    )
    twice = windows.groupBy("high", "low").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc")
    return windows.join(twice.drop("last_doc"), ["high", "low"]).select("doc", "start_pos", "first_doc")


def shared_spans(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 500, later_only: bool = False) -> DataFrame:
    """`(doc, start_pos, end_pos)`: the stretches covered by substrings of `length` code points found in another document.

    Ids must be unique. Positions count code points of the text as given. Touching or overlapping stretches are one
    row. With `later_only` the document with the smallest id keeps each shared substring and only the other
    occurrences are listed: what to remove so that one remains; the windows themselves are digested for it. Null and shorter
    texts give no rows, nor do repeats inside one document; an empty table gives none; other columns are ignored.
    """
    if later_only:
        found = _shared_windows(corpus, doc_id, text, length).where(F.col("first_doc") < F.col("doc")).select("doc", "start_pos", (F.col("start_pos") + length).alias("end_pos"))
    else:
        found = _shared_intervals(corpus, doc_id, text, length)
    kind = dict(found.dtypes)["doc"]
    parts = found.groupBy("doc").agg(F.collect_set(F.shiftleft(F.col("start_pos").cast("long"), 32) + F.col("end_pos")).alias("parts"))
    return parts.mapInPandas(_merge, f"doc {kind}, start_pos int, end_pos int")


def shared_share(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 500) -> DataFrame:
    """One row per document: its length, the characters that also stand elsewhere, and their share (null for an empty text)."""
    spans = shared_spans(corpus, doc_id, text, length).groupBy("doc").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"))
    return (
        corpus.select(F.col(doc_id).alias("doc"), F.length(text).alias("n_chars")).join(spans, "doc", "left")
        .select("doc", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
        .withColumn("shared_share", F.col("n_shared") / F.nullif(F.col("n_chars"), F.lit(0)))
    )
