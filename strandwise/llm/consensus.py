"""Consensus of several annotators by a mean-field variational confusion model.

Each annotator has, for every true class, a Dirichlet row of answer probabilities; classes have a Dirichlet
prior. A sweep takes the expected log probabilities (digammas) into the posterior of every item and adds the
posteriors up by annotator, class and answer. Annotators that share more wrong answers than their rows explain
are taken as dependent: where they give one item the same label, they count as one vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.session import cut

#: Largest number of parameters (fields x raters x classes squared) that is kept on the driver and sent to tasks.
SENT_PARAMETERS = 4_000_000
#: Up to so many raters the pairs are counted in a raters x raters matrix of each task; beyond, pair by pair in the cluster.
PAIRED_RATERS = 1_000


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    low = sum(1 / (x + i) for i in range(6))
    y = x + 6
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - low


def beta_share(a: float, b: float, x: float) -> float:
    """The share of a Beta law below `x` (regularised incomplete beta function, by its continued fraction)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return float(front * out)


def beta_quantile(mean: float, sd: float, share: float) -> float:
    """Quantile of the Beta law of given mean and standard deviation, by bisection."""
    if not 0 < mean < 1 or sd <= 0:
        return min(1.0, max(0.0, mean))
    n = max(mean * (1 - mean) / sd**2 - 1, 1e-3)
    a, b = mean * n, (1 - mean) * n
    lo, hi = 0.0, 1.0
    for _ in range(50):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if beta_share(a, b, x) < share else (lo, x)
    return (lo + hi) / 2


def _digamma_col(x: Column) -> Column:
    y = x + 6
    low = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6)) - low


def latest_answers(ratings: DataFrame, item: str = "item_key", rater: str = "rater", name: str = "field", value: str = "value", touched: str = "touched", at: str = "rated_at") -> DataFrame:
    """`(field, item, rater, label)`: the latest touched, non-null answer per rater, item and field.

    Labels come in the spelling of the schema: lower case, `_` for blanks and hyphens, no outer blanks; a blank
    answer is none. Among answers of the same time the largest label counts. Rows without item, rater or field drop out.
    """
    label = F.regexp_replace(F.lower(F.trim(F.col(value))), r"[\s\-]+", "_")
    return (
        ratings.where(F.col(touched) & F.col(value).isNotNull())
        .select(F.col(name).alias("field"), F.col(item).alias("item"), F.col(rater).alias("rater"), label.alias("label"), F.col(at).alias("at"))
        .where("label <> '' and item is not null and rater is not null and field is not null")
        .groupBy("field", "item", "rater").agg(F.max(F.struct("at", "label")).alias("last"))
        .select("field", "item", "rater", "last.label")
    )


@dataclass
class Space:
    """The names behind the numbers of the parameter arrays."""

    fields: list[str]
    raters: list[str]
    labels: dict[str, list[str]]
    width: int = 0
    cluster: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=int))

    def __post_init__(self) -> None:
        self.width = max((len(x) for x in self.labels.values()), default=1)
        self.cluster = np.arange(len(self.raters))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Field of each item; item, rater and label of each answer."""
    fields = batch.column("f").to_numpy(zero_copy_only=False).astype(int)
    codes = batch.column("answers")
    offsets = codes.offsets.to_numpy()
    flat = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return fields, np.repeat(np.arange(len(fields)), np.diff(offsets)), flat >> 16, flat & 0xFFFF


def _weights(item: np.ndarray, rater: np.ndarray, label: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    key = (item.astype(np.int64) * (len(cluster) + 1) + cluster[rater]) << 16 | label
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return 1.0 / count[inverse]


def _posterior(f, item, rater, label, w, elog, eprior) -> np.ndarray:
    """elog[field, rater, label, class]; classes a field doesn't have carry minus infinity in eprior."""
    scores = eprior[f].copy()
    np.add.at(scores, item, elog[f[item], rater, label] * w[:, None])
    scores -= scores.max(1, keepdims=True)
    post = np.exp(scores)
    return post / post.sum(1, keepdims=True)


def _vote(f, item, rater, label, w, n: int, shape, present) -> np.ndarray:
    votes = np.where(present[f], 0.01, 0.0)
    np.add.at(votes, (item, label), w)
    return votes / votes.sum(1, keepdims=True)


def _sweep(space: Space, elog, eprior, present, pairs: bool, rows=None):
    n_f, n_r, k = len(space.fields), len(space.raters), space.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, prior = np.zeros((n_f, n_r, k, k)), np.zeros((n_f, k))
        same, chance, wrong = (np.zeros((n_r, n_r)) for _ in range(3))
        any_row = False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row = True
            f, item, rater, label = _flat(batch)
            w = _weights(item, rater, label, space.cluster)
            post = _vote(f, item, rater, label, w, k, None, present) if elog is None else _posterior(f, item, rater, label, w, elog, eprior)
            if not pairs:
                np.add.at(count, (f[item], rater, label), post[item] * w[:, None])
                np.add.at(prior, f, post)
                continue
            best = post.argmax(1)
            off = label != best[item]
            # answers of one item side by side: raters are few, so a dense item x rater matrix per slice
            for lo in range(0, len(f), 2048):
                m = (item >= lo) & (item < lo + 2048)
                size = min(2048, len(f) - lo)
                given = np.full((size, n_r), -1)
                given[item[m] - lo, rater[m]] = label[m]
                there = given >= 0
                bad = there & (given != best[lo : lo + size, None])
                for c in np.unique(label[m & off]) if (m & off).any() else ():
                    x = (bad & (given == c)).astype(float)
                    same += x.T @ x
                    y = np.zeros((size, n_r))
                    own = rows[f[lo : lo + size], :, c, best[lo : lo + size]]
                    y[:] = np.where(there & (c != best[lo : lo + size, None]), own, 0)
                    chance += y.T @ y
                wrong += bad.astype(float).T @ there.astype(float)
        if not any_row:
            return
        flat = np.concatenate([same.ravel(), chance.ravel(), wrong.ravel()]) if pairs else np.concatenate([count.ravel(), prior.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["at", "x"])

    return run


def _sweep_pairs(space: Space, elog, eprior, rows):
    """The same counts of shared wrong answers as rows `(i, j, same, chance, wrong_i, wrong_j)`, for any number of raters."""
    n_r = len(space.raters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f, item, rater, label = _flat(batch)
            best = _posterior(f, item, rater, label, _weights(item, rater, label, space.cluster), elog, eprior).argmax(1)
            bad = label != best[item]
            n = np.bincount(item, minlength=len(f))
            start = np.cumsum(n) - n
            # answers of one item side by side, one distance at a time
            keys, sums = np.zeros(0, dtype=np.int64), np.zeros((0, 4))
            for d in range(1, int(n.max()) if len(n) else 0):
                a = np.flatnonzero(np.arange(len(item)) + d < (start + n)[item])
                b = a + d
                i, j = rater[a], rater[b]
                t, fa = best[item[a]], f[item[a]]
                own_i, own_j = rows[fa, i, :, t], rows[fa, j, :, t]
                wrong = np.arange(rows.shape[2])[None, :] != t[:, None]
                values = np.stack([(bad[a] & bad[b] & (label[a] == label[b])).astype(float), (own_i * own_j * wrong).sum(1), bad[a].astype(float), bad[b].astype(float)], 1)
                swap = i > j
                values[swap, 2], values[swap, 3] = values[swap, 3], values[swap, 2].copy()
                keys = np.concatenate((keys, np.minimum(i, j).astype(np.int64) * n_r + np.maximum(i, j)))
                sums = np.concatenate((sums, values))
                if len(keys) > 500_000:
                    keys, at = np.unique(keys, return_inverse=True)
                    sums = np.stack([np.bincount(at, sums[:, c]) for c in range(4)], 1)
            if len(keys):
                keys, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.bincount(at, sums[:, c])) for c in range(4)]], names=["pair", "same", "chance", "wrong_i", "wrong_j"])

    return run


def _totals(packed: DataFrame, run, size: int) -> np.ndarray:
    out = np.zeros(size)
    got = packed.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out[got["at"].to_numpy(dtype=np.int64)] = got["x"].to_numpy()
    return out


class ConfusionModel:
    """Fit of the variational confusion model to `latest_answers`.

    Every answer of every item enters each sweep, items with few answers too. Items of up to as many answers as
    there are raters are packed into one row each, so the parameters must fit `SENT_PARAMETERS`; a wider model
    raises, and `consensus_by_groups` gives the same posteriors by joins alone.
    """

    def __init__(self, answers: DataFrame, sweeps: int = 25, tolerance: float = 1e-3, prior_weight: float = 3.0, paired_raters: int = PAIRED_RATERS) -> None:
        self.prior_weight, self.paired_raters = prior_weight, paired_raters
        answers = cut(answers)
        # at most one row for each field, label and rater
        seen = answers.groupBy("field", "label", "rater").count().limit(SENT_PARAMETERS + 1).collect()
        names = {(r.field, r.label) for r in seen}
        raters = sorted({r.rater for r in seen})
        labels: dict[str, list[str]] = {}
        for name, label in sorted(names):
            labels.setdefault(name, []).append(label)
        self.space = s = Space(sorted(labels), raters, labels)
        if len(seen) > SENT_PARAMETERS or len(s.fields) * len(raters) * s.width**2 > SENT_PARAMETERS:
            raise ValueError("too many raters and labels for the packed model; use consensus_by_groups")
        n_f, n_r, k = len(s.fields), len(raters), s.width
        self.shape = (n_f, n_r, k, k)
        self.present = np.zeros((n_f, k), dtype=bool)
        for i, f in enumerate(s.fields):
            self.present[i, : len(labels[f])] = True
        spark = answers.sparkSession
        # bounded by the check above
        label_codes = spark.createDataFrame([(f, x, i, j) for i, f in enumerate(s.fields) for j, x in enumerate(labels[f])] or [("", "", 0, 0)], "field string, label string, f int, l int")
        rater_codes = spark.createDataFrame([(x, i) for i, x in enumerate(raters)] or [("", 0)], "rater string, r int")
        self.packed = cut(
            answers.join(F.broadcast(label_codes), ["field", "label"]).join(F.broadcast(rater_codes), "rater")
            .groupBy("item", "f").agg(F.sort_array(F.collect_list(F.shiftleft("r", 16) + F.col("l"))).alias("answers"))
        )
        self.counts, self.prior = np.zeros(self.shape), np.zeros((n_f, k))
        if n_f:
            self._fit(sweeps, tolerance)
            if n_r > 1 and self._tie_dependent():
                self._fit(sweeps, tolerance)

    def _alpha(self) -> np.ndarray:
        """Dirichlet parameters [field, rater, answer, class]: counts plus a prior row around the rater's own accuracy."""
        n_f, n_r, k, _ = self.shape
        total = self.counts.sum((2, 3))
        right = np.einsum("frkk->fr", self.counts)
        classes = self.present.sum(1)
        acc = (right + 2 * 0.6) / (total + 2)
        other = (1 - acc) / np.maximum(classes - 1, 1)[:, None]
        base = np.where(np.eye(k, dtype=bool), acc[:, :, None, None], other[:, :, None, None])
        here = self.present[:, None, :, None] & self.present[:, None, None, :]
        return np.where(here, self.counts + self.prior_weight * base + 1e-2, 1.0)

    def _expected(self) -> tuple[np.ndarray, np.ndarray]:
        a = self._alpha()
        here = self.present[:, None, :, None] & self.present[:, None, None, :]
        rows = np.where(here, a, 0).sum(2, keepdims=True)
        elog = np.where(here, digamma(a) - digamma(np.maximum(rows, 1e-9)), 0.0)
        p = self.prior + 1.0
        eprior = np.where(self.present, digamma(p) - digamma(np.where(self.present, p, 0).sum(1, keepdims=True)), -1e9)
        return elog, eprior

    def _fit(self, sweeps: int, tolerance: float) -> None:
        size = int(np.prod(self.shape))
        for n in range(sweeps):
            elog, eprior = (None, None) if n == 0 and not self.prior.any() else self._expected()
            got = _totals(self.packed, _sweep(self.space, elog, eprior, self.present, False), size + self.prior.size)
            old = self.prior
            self.counts, self.prior = got[:size].reshape(self.shape), got[size:].reshape(self.prior.shape)
            if n and np.abs(self.prior - old).sum() < tolerance * self.prior.sum():
                break

    def _tie_dependent(self) -> bool:
        n = len(self.space.raters)
        a = self._alpha()
        here = self.present[:, None, :, None] & self.present[:, None, None, :]
        rows = np.where(here, a / np.where(here, a, 0).sum(2, keepdims=True).clip(1e-9), 0)
        elog, eprior = self._expected()
        if n <= self.paired_raters:
            got = _totals(self.packed, _sweep(self.space, elog, eprior, self.present, True, rows), 3 * n * n).reshape(3, n, n)
            same, chance, wrong = got
            room = np.minimum(wrong, wrong.T) - chance
            with np.errstate(divide="ignore", invalid="ignore"):
                tied = ((same - chance) / np.sqrt(chance + 1) > 6) & ((same - chance) > 0.2 * np.maximum(room, 1))
            ties = np.argwhere(np.triu(tied, 1))
        else:
            sums = self.packed.mapInArrow(_sweep_pairs(self.space, elog, eprior, rows), "pair long, same double, chance double, wrong_i double, wrong_j double")
            sums = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("same", "chance", "wrong_i", "wrong_j")])
            more = F.col("same") - F.col("chance")
            room = F.greatest(F.least("wrong_i", "wrong_j") - F.col("chance"), F.lit(1.0))
            # only the pairs found dependent come back
            found = sums.where((more / F.sqrt(F.col("chance") + 1) > 6) & (more > 0.2 * room)).select("pair").toPandas()["pair"].to_numpy(dtype=np.int64)
            ties = np.stack([found // n, found % n], 1)
        self.dependent = sorted((self.space.raters[i], self.space.raters[j]) for i, j in ties)
        c = self.space.cluster
        for i, j in ties:
            c[c == c[j]] = c[i]
        return bool(len(ties))

    def labels(self, min_raters: int = 1) -> DataFrame:
        """`(item, field, label, confidence, n_raters)` for items with at least `min_raters` answers; the first label in order wins ties."""
        s, present = self.space, self.present
        if not s.fields:
            return self.packed.select("item", F.lit("").alias("field"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0).alias("n_raters")).limit(0)
        elog, eprior = self._expected()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                f, item, rater, label = _flat(batch)
                post = _posterior(f, item, rater, label, _weights(item, rater, label, s.cluster), elog, eprior)
                best = post.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item"), pa.array([s.fields[x] for x in f]), pa.array([s.labels[s.fields[x]][b] for x, b in zip(f, best, strict=True)]),
                     pa.array(post[np.arange(len(f)), best]), pa.array(np.bincount(item, minlength=len(f)).astype(np.int32))],
                    names=["item", "field", "label", "confidence", "n_raters"])

        kind = dict(self.packed.dtypes)["item"]
        return self.packed.where(F.size("answers") >= min_raters).mapInArrow(run, f"item {kind}, field string, label string, confidence double, n_raters int")

    def reliability(self) -> DataFrame:
        """`(rater, field, reliability, low, high, n_answers, cluster)`: posterior mean and central 95 % interval of the chance to give the true label.

        Over the classes the chance is a mean of Beta variables; the interval is that of the Beta law with its mean and variance.
        """
        a, s = self._alpha(), self.space
        rows = []
        for i, f in enumerate(s.fields):
            k = len(s.labels[f])
            share = self.prior[i, :k] / max(self.prior[i, :k].sum(), 1e-9)
            for r, name in enumerate(s.raters):
                own = a[i, r, :k, :k]
                total = own.sum(0)
                mean = np.diag(own) / total
                sd = float(np.sqrt((share**2 * mean * (1 - mean) / (total + 1)).sum()))
                m = float((share * mean).sum())
                rows.append((name, f, m, beta_quantile(m, sd, 0.025), beta_quantile(m, sd, 0.975), float(self.counts[i, r].sum()), s.raters[s.cluster[r]]))
        return self.packed.sparkSession.createDataFrame(rows, "rater string, field string, reliability double, low double, high double, n_answers double, cluster string")


def consensus_by_groups(answers: DataFrame, sweeps: int = 10, prior_weight: float = 3.0) -> DataFrame:
    """The same model by joins and group-bys, for rater tables of any size: `(item, field, label, confidence)`.

    Raters count as independent here. Each sweep is cut in the shared folder.
    """
    classes = answers.select("field", F.col("label").alias("k")).distinct()
    n_class = classes.groupBy("field").agg(F.count("*").alias("n_k"))
    votes = answers.groupBy("field", "item", "label").agg(F.count("*").alias("v"))
    total = answers.groupBy("field", "item").agg(F.count("*").alias("n"))
    post = votes.join(total, ["field", "item"]).select("field", "item", F.col("label").alias("k"), (F.col("v") / F.col("n")).alias("t"))
    for _ in range(sweeps):
        post = cut(post)
        prior = post.groupBy("field", "k").agg(F.sum("t").alias("p")).join(n_class, "field")
        whole = prior.groupBy("field").agg(F.sum(F.col("p") + 1).alias("p_all"))
        prior = prior.join(whole, "field").select("field", "k", "n_k", (_digamma_col(F.col("p") + 1) - _digamma_col(F.col("p_all"))).alias("e0"))
        counts = answers.join(post, ["field", "item"]).groupBy("field", "rater", "label", "k").agg(F.sum("t").alias("c"))
        acc = counts.groupBy("field", "rater").agg(((F.sum(F.when(F.col("label") == F.col("k"), F.col("c")).otherwise(0)) + 1.2) / (F.sum("c") + 2)).alias("acc"))
        grid = acc.join(classes, "field").join(classes.withColumnRenamed("k", "label"), "field").join(n_class, "field")
        base = F.when(F.col("label") == F.col("k"), F.col("acc")).otherwise((1 - F.col("acc")) / F.greatest(F.col("n_k") - 1, F.lit(1)))
        alpha = grid.join(counts, ["field", "rater", "label", "k"], "left").select("field", "rater", "label", "k", (F.coalesce("c", F.lit(0.0)) + prior_weight * base + 0.01).alias("a"))
        row = alpha.groupBy("field", "rater", "k").agg(F.sum("a").alias("a_all"))
        elog = cut(alpha.join(row, ["field", "rater", "k"]).select("field", "rater", "label", "k", (_digamma_col(F.col("a")) - _digamma_col(F.col("a_all"))).alias("e")))
        score = answers.join(elog, ["field", "rater", "label"]).groupBy("field", "item", "k").agg(F.sum("e").alias("e"))
        score = score.join(prior, ["field", "k"]).select("field", "item", "k", (F.col("e") + F.col("e0")).alias("s"))
        top = score.groupBy("field", "item").agg(F.max("s").alias("top"))
        score = score.join(top, ["field", "item"]).withColumn("x", F.exp(F.col("s") - F.col("top")))
        norm = score.groupBy("field", "item").agg(F.sum("x").alias("x_all"))
        post = score.join(norm, ["field", "item"]).select("field", "item", "k", (F.col("x") / F.col("x_all")).alias("t"))
    best = post.groupBy("field", "item").agg(F.max_by(F.struct("k", "t"), F.struct("t", F.col("k"))).alias("b"))
    return best.select("item", "field", F.col("b.k").alias("label"), F.col("b.t").alias("confidence"))


def krippendorff_alpha(answers: DataFrame) -> DataFrame:
    """`(field, n_items, n_values, alpha)` for nominal labels, over items with two or more answers; null where all values are equal."""
    by_value = answers.groupBy("field", "item", "label").agg(F.count("*").alias("n_c"))
    m = by_value.groupBy("field", "item").agg(F.sum("n_c").alias("m"), F.sum(F.col("n_c") * (F.col("n_c") - 1)).alias("pairs")).where("m > 1")
    observed = m.groupBy("field").agg(F.count("*").alias("n_items"), F.sum("m").alias("n"), F.sum(F.col("pairs") / (F.col("m") - 1)).alias("agree"))
    margins = by_value.join(m.select("field", "item"), ["field", "item"], "left_semi").groupBy("field", "label").agg(F.sum("n_c").alias("n_c"))
    squares = margins.groupBy("field").agg(F.sum(F.col("n_c") * F.col("n_c")).alias("sq"))
    away = F.nullif((F.col("n") * F.col("n") - F.col("sq")).cast("double"), F.lit(0.0))
    return observed.join(squares, "field").select(
        "field", "n_items", F.col("n").alias("n_values"), F.round(1 - (F.col("n") - 1) * (F.col("n") - F.col("agree")) / away, 6).alias("alpha")
    )
