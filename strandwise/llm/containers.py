"""Filling fixed-capacity containers: a configuration linear program over the length histogram.

Lengths are counted in tokens, long texts are divided, and the histogram of what remains (exact lengths, at most
`capacity` rows a partition) is all the driver sees. The program "fewest containers that cover all lengths" is solved by
multiplicative weights: prices of lengths fall with their coverage, a bounded knapsack dynamic program finds the dearest
container content, and the prices bound the optimum. The fractional solution is rounded down and the rest is packed from
the same histogram. Items learn their container from
their rank within their length class; ranks are made without gathering a class in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.session import cut, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
#: Splitting pattern of the tokenizer (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """`(key, n_tokens)` of whole texts; null counts 0. The vocabulary file must lie at `tokenizer` on every worker."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            if n:
                yield pd.DataFrame({"key": pdf["key"], "n_tokens": np.array(n, dtype=np.int64)})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, n_tokens long")


def knapsack(sizes: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size, `counts` at most, in the content of greatest price: dynamic program over the capacity.

    The copies of a size are bundles of 1, 2, 4, ... and a rest, so any number of them up to the bound can be taken.
    """
    best = np.zeros(capacity + 1)
    bundles: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(sizes)):
        s, left, n = int(sizes[k]), min(int(counts[k]), capacity // int(sizes[k])), 1
        while left > 0:
            n = min(n, left)
            w = n * s
            with_it = best[: capacity + 1 - w] + n * prices[k]
            take = with_it > best[w:] + 1e-12
            if take.any():
                best[w:] = np.where(take, with_it, best[w:])
                bundles.append((k, n, take))
            left -= n
            n *= 2
    copies = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    for k, n, take in reversed(bundles):
        w = n * int(sizes[k])
        if c >= w and take[c - w]:
            copies[k] += n
            c -= w
    return copies


def fullest(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size, `counts` at most, that fill a container best with its largest item inside; large items first.

    The same dynamic program for prices equal to sizes, where a set of reachable fillings is one long number.
    """
    order = np.argsort(-sizes, kind="stable")
    mask, full = (1 << (capacity + 1)) - 1, 1 << capacity
    copies = np.zeros(len(sizes), dtype=np.int64)
    first = int(order[0])
    copies[first] = 1
    reach, steps = 1 << int(sizes[first]), []
    for k, s, c in zip(order.tolist(), sizes[order].tolist(), counts[order].tolist(), strict=True):
        left, n = min(c - (k == first), capacity // s), 1
        while left > 0:
            n = min(n, left)
            steps.append((k, n, n * s, reach))
            reach = (reach | reach << n * s) & mask
            left -= n
            n *= 2
        if reach & full:
            break
    c = reach.bit_length() - 1
    # a smaller bundle is taken only where the larger ones alone don't reach the filling
    for k, n, w, before in reversed(steps):
        if not before >> c & 1:
            copies[k] += n
            c -= w
    return copies


@dataclass
class Plan:
    """Contents (copies by size) and how often each is used; and the least number of containers by the best dual prices."""

    contents: list[tuple[np.ndarray, int]]
    bound: float


def solve_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 80, gap: float = 0.002, step: float = 0.5, eta: float = 4.0) -> Plan:
    """The configuration program of exact sizes by multiplicative weights, rounded; `counts` are covered exactly.

    The weight of a size starts at its volume and falls exponentially with its coverage; its price is the weight of one item.
    Any prices bound the optimum: their total over all items, by the price of the dearest content. Rounds end when all is
    covered, when the fractional solution is within `gap` of the bound, or at `rounds`; what is left then, and what rounding
    down leaves, is packed by the same dynamic program with sizes as prices.
    """
    counts = counts.astype(np.int64)
    used: dict[bytes, float] = {}
    cover = np.zeros(len(sizes))
    # dual feasible prices to begin with: volumes, items above capacity - a counted whole and those below a not at all
    bound = max(
        float((np.where(sizes > capacity - a, 1.0, np.where(sizes < a, 0.0, sizes / capacity)) * counts).sum()) for a in range(capacity // 2 + 1)
    )
    for _ in range(rounds):
        open_ = cover < 1
        if not open_.any():
            break
        prices = sizes * np.exp(-eta * np.minimum(cover, 1))
        content = knapsack(sizes, np.where(open_, prices, 0.0), counts, capacity)
        dearest = float((prices * knapsack(sizes, prices, counts, capacity)).sum()) if not open_.all() else float((prices * content).sum())
        bound = max(bound, float((prices * counts).sum()) / max(dearest, 1e-12))
        on = content > 0
        times = min(step, float((1 - cover[on]).min()) + 1e-9) * float((counts[on] / content[on]).min())
        used[content.tobytes()] = used.get(content.tobytes(), 0.0) + times
        cover[on] += times * content[on] / counts[on]
        if open_.all() and sum(used.values()) <= (1 + gap) * bound and cover.min() >= 1:
            break
    plan: list[tuple[np.ndarray, int]] = []
    left = counts.copy()
    for raw, times in sorted(used.items(), key=lambda x: -x[1]):
        content = np.frombuffer(raw, dtype=np.int64)
        on = content > 0
        # only contents without room to speak of are worth fixing before the rest is known
        n = min(int(times + 1e-6), int((left[on] // content[on]).min())) if capacity - int((content * sizes).sum()) <= capacity * gap else 0
        if n > 0:
            plan.append((content, n))
            left -= n * content
    while left.any():
        there = np.flatnonzero(left)
        content = np.zeros(len(sizes), dtype=np.int64)
        content[there] = fullest(sizes[there], left[there], capacity)
        on = content > 0
        n = int((left[on] // content[on]).min())
        plan.append((content, n))
        left -= n * content
    return Plan(plan, bound)


def _segments(plan: list[tuple[np.ndarray, int]], n_sizes: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], int]:
    """For each class: first ranks, first containers and copies a container of its segments; and the containers used."""
    ranks: list[list[int]] = [[] for _ in range(n_sizes)]
    bases: list[list[int]] = [[] for _ in range(n_sizes)]
    copies: list[list[int]] = [[] for _ in range(n_sizes)]
    done, base = np.zeros(n_sizes, dtype=np.int64), 0
    for content, n in plan:
        for k in np.flatnonzero(content):
            ranks[k].append(int(done[k]))
            bases[k].append(base)
            copies[k].append(int(content[k]))
            done[k] += n * content[k]
        base += n
    return [np.array(x) for x in ranks], [np.array(x) for x in bases], [np.array(x) for x in copies], base


@dataclass
class Filling:
    """`items(key, part, start_token, n_tokens, container)`, the containers used and the least number possible by the program's bound."""

    items: DataFrame
    containers: int
    bound: int


def fill_containers(lengths: DataFrame, capacity: int = CAPACITY, rounds: int = 80) -> Filling:
    """The container of each item of `lengths(key, n_tokens)`.

    No container holds more than `capacity` tokens; only an item longer than that is divided, into full containers and
    a rest. Items of length 0 or null take no room and come out in container -1. Repeated keys are separate items;
    an empty table gives no rows. Containers are numbered from 0: mixed ones first, then the full ones.
    """
    spark = lengths.sparkSession
    kind = dict(lengths.dtypes)["key"]
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    # cut first: range partitioning samples its input, which would measure every text twice
    items = cut(lengths.select("key", n.alias("n"))).select("key", "n", F.expr(f"n div {capacity}").alias("full"), F.expr(f"n % {capacity}").alias("rest"))
    partitions = shuffle_partitions(spark)
    # Written once, sorted: ranks are counted over partitions, so a length may be of any number of items.
    ranked = cut(
        items.repartitionByRange(partitions, "rest", F.xxhash64("key"), "full").sortWithinPartitions("rest").withColumn("pid", F.spark_partition_id())
    )
    # at most one row for each partition and length
    per_pid = sorted((r.pid, r.rest, r.c, r.full) for r in ranked.groupBy("pid", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("full")).collect())
    counts = np.zeros(capacity, dtype=np.int64)
    for _, rest, c, _ in per_pid:
        counts[rest] += c
    counts[0] = 0
    on = np.flatnonzero(counts)
    plan = solve_configurations(on, counts[on], capacity, rounds) if len(on) else Plan([], 0.0)
    ranks, bases, copies, used = _segments(plan.contents, len(on))
    where = np.full(capacity, -1)
    where[on] = np.arange(len(on))
    # first rank of each length and first full container in each partition: partitions follow each other in order of length
    first: dict[int, tuple[dict[int, int], int]] = {}
    seen, fulls = np.zeros(capacity, dtype=np.int64), used
    for pid, rest, c, full in per_pid:
        if pid not in first:
            first[pid] = ({}, fulls)
        first[pid][0].setdefault(rest, int(seen[rest]))
        seen[rest] += c
        fulls += full or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_rank: dict[int, int] | None = None
        next_full = 0
        for pdf in batches:
            if pdf.empty:
                continue
            if next_rank is None:
                start, next_full = first[int(pdf["pid"].iloc[0])]
                next_rank = dict(start)
            rest, full = pdf["rest"].to_numpy(), pdf["full"].to_numpy()
            container = np.full(len(pdf), -1, dtype=np.int64)
            for length in np.unique(rest[rest > 0]):
                mine = np.flatnonzero(rest == length)
                r = next_rank.get(int(length), 0) + np.arange(len(mine))
                next_rank[int(length)] = int(r[-1]) + 1
                j = where[length]
                seg = np.searchsorted(ranks[j], r, side="right") - 1
                container[mine] = bases[j][seg] + (r - ranks[j][seg]) // copies[j][seg]
            tail = (rest > 0) | (full == 0)
            if tail.any():
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[tail], "part": full[tail], "start_token": full[tail] * capacity, "n_tokens": rest[tail], "container": container[tail]})
            if full.any():
                owner = np.repeat(np.arange(len(pdf)), full)
                part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[owner], "part": part, "start_token": part * capacity, "n_tokens": np.full(len(owner), capacity), "container": next_full + np.arange(len(owner))})
                next_full += len(owner)

    out = ranked.mapInPandas(run, f"key {kind}, part long, start_token long, n_tokens long, container long")
    return Filling(out, fulls, fulls - used + int(np.ceil(plan.bound - 1e-6)))
