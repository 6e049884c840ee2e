"""Decisions, ledgers, label layers and verdicts over records: event-sourced updates and reports as joins and grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import text as T


def apply_decisions(records: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """`records` with the status of their last decision, and `n_decisions`, `log`: all of theirs in order as (at, status, reason).

    `decisions(key, at, status, reason)` may come in any order and repeat; equal rows count once. Decisions of unknown records
    are ignored, records without one stay as they are with an empty log.
    """
    d = decisions.select(key, "at", F.col("status").alias("_to"), "reason").distinct()
    step = F.struct("at", F.col("_to").alias("status"), "reason")
    logs = d.groupBy(key).agg(F.max(step).alias("_last"), F.count("*").alias("n_decisions"), F.array_sort(F.collect_list(step)).alias("log"))
    out = records.join(logs, key, "left").withColumn("status", F.coalesce("_last.status", "status"))
    none = F.array().cast("array<struct<at:timestamp,status:string,reason:string>>")
    return out.withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0))).withColumn("log", F.coalesce("log", none)).drop("_last")


def attach(records: DataFrame, links: DataFrame, column: str, key: str = "id") -> DataFrame:
    """`records` with the ids of `links(key, ref)` appended to the list `column`, in order, those not there yet; a null list counts as empty."""
    more = links.where("ref is not null").groupBy(key).agg(F.array_sort(F.collect_set("ref")).alias("_more"))
    none = F.array().cast("array<string>")
    own, new = F.coalesce(column, none), F.coalesce("_more", none)
    return records.join(more, key, "left").withColumn(column, F.concat(own, F.array_except(new, own))).drop("_more")


def adopt(given: Column, suggested: Column, old: Column) -> Column:
    """An explicit value beats a suggestion, which beats what is stored; blank ones count as none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(given), blank(suggested), old)


def domain_ledger(sources: DataFrame, examples: int = 3) -> DataFrame:
    """`(host, accepted, rejected, open, rate, examples)` of `sources(id, status, url)`: the rate is of decided ones, 0 without any."""
    s = sources.select("id", "status", T.host(F.col("url")).alias("host")).distinct().where("host <> ''")
    counts = [F.count_if(F.col("status") == v).alias(n) for n, v in (("accepted", "reviewed"), ("rejected", "rejected"), ("open", "candidate"))]
    # the first ids of a host are found by rank, so a hot host is sorted and not gathered
    rank = F.row_number().over(Window.partitionBy("host").orderBy("id"))
    first = s.select("host", "id").distinct().withColumn("r", rank).where(F.col("r") <= examples).groupBy("host").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    ledger = s.groupBy("host").agg(*counts).join(first, "host")
    return ledger.withColumn("rate", F.coalesce(F.col("accepted") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0)), F.lit(0.0)))


def domain_proposals(ledger: DataFrame, infrastructure: Sequence[str] = (), accepted: int = 2, rate: float = 0.6, rejected: int = 2) -> DataFrame:
    """Hosts of a ledger with `tier` to promote (no tier, accepted often) or to review (a tier, only rejected); infrastructure is left out."""
    listed = F.col("tier") != "open"
    action = (
        F.when(~listed & (F.col("accepted") >= accepted) & (F.col("rate") >= rate), "promote")
        .when(listed & (F.col("accepted") == 0) & (F.col("rejected") >= rejected), "review")
    )
    inside = [(F.col("host") == d) | F.endswith("host", F.lit(f".{d}")) for d in infrastructure]
    for c in inside:
        ledger = ledger.where(~c)
    return ledger.withColumn("action", action).where("action is not null")


def layered(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Two layers of labels by key: values of the newer one where it has them, else of the older one."""
    a = old.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    return a.join(new.select(key, *values), key, "full").select(key, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def curated_first(curated: DataFrame, harvested: DataFrame, order: Sequence[str], title: str = "title") -> DataFrame:
    """Curated rows and the first harvested one of each other title, by normalised title; `origin` tells them apart."""
    k = T.normalize_title(F.col(title))
    c = curated.withColumn("_k", k)
    h = harvested.withColumn("_k", k).join(c.select("_k").distinct(), "_k", "left_anti")
    names = [x for x in harvested.columns]
    first = h.groupBy("_k").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("x")).select("x.*")
    return c.drop("_k").withColumn("origin", F.lit("curated")).unionByName(first.select(*curated.columns).withColumn("origin", F.lit("harvested")))


def split_agreement(pairs: DataFrame, exposed: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of `pairs(left, right, exposed, by...)` on the items named elsewhere and on the rest; null labels are answers."""
    same = F.col("left").eqNullSafe(F.col("right"))
    at = lambda c: F.count_if(c)
    e = F.col(exposed)
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), at(e).alias("n_exposed"), at(e & same).alias("same_exposed"), at(~e & same).alias("same_clean"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return out.withColumn("exposed_agreement", share(F.col("same_exposed"), F.col("n_exposed"))).withColumn("clean_agreement", share(F.col("same_clean"), F.col("n") - F.col("n_exposed")))


def gate_ready(n: Column, independent: Column, calibration: Column, least: int = 40) -> Column:
    """Whether a comparison may carry a floor: independent raters, no calibration round, enough items."""
    return F.coalesce(independent, F.lit(False)) & ~F.coalesce(calibration, F.lit(False)) & (n >= least)


def verdict(metrics: DataFrame, incumbent: str, gated: Sequence[str], margin: float = 0.02, loss: float = 0.05) -> DataFrame:
    """`(provider, delta, worst, verdict)` of `metrics(provider, field, hits, predicted)` against the incumbent provider.

    A challenger is activated if the pooled precision of the gated fields rises by more than `margin` and none falls by more than
    `loss`. Providers that predicted nothing have no row; precision is 1 where a field has no prediction.
    """
    m = metrics.where(F.col("field").isin(*gated)).groupBy("provider", "field").agg(F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted"))
    one = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0))
    m = m.withColumn("precision", one(F.col("hits"), F.col("predicted")))
    pooled = m.groupBy("provider").agg(F.sum("hits").alias("h"), F.sum("predicted").alias("p")).where("p > 0").select("provider", one(F.col("h"), F.col("p")).alias("pooled"))
    base = m.where(F.col("provider") == incumbent).select("field", F.col("precision").alias("base"))
    floor = pooled.where(F.col("provider") == incumbent).select(F.col("pooled").alias("base_pooled"))  # one row
    worst = m.join(base, "field").groupBy("provider").agg(F.min(F.col("precision") - F.col("base")).alias("worst"))
    out = pooled.where(F.col("provider") != incumbent).join(F.broadcast(floor)).join(worst, "provider").withColumn("delta", F.col("pooled") - F.col("base_pooled"))
    say = F.when(F.col("delta") <= margin, F.when(F.col("delta") >= -margin, "ties").otherwise("loses")).when(F.col("worst") < -loss, "regresses").otherwise("activate")
    return out.select("provider", F.round("delta", 6).alias("delta"), F.round("worst", 6).alias("worst"), say.alias("verdict"))


def best_by_title(queries: DataFrame, candidates: DataFrame, least: float = 0.7, bonus: float = 0.1) -> DataFrame:
    """The candidate of each query with the closest title: `(qid, cid, similarity)`.

    `queries(qid, title, year)` and `candidates(qid, cid, title, year, ord)`: word sets must agree by `least` (Sorensen-Dice) and the
    years, where both are known, within one; an exact year adds `bonus`; the first of equals wins.
    """
    c = candidates.select("qid", "cid", F.col("title").alias("title2"), F.col("year").alias("year2"), "ord")
    s = queries.join(c, "qid").withColumn("similarity", T.dice(F.col("title"), F.col("title2")))
    near = F.coalesce(F.abs(F.col("year") - F.col("year2")) <= 1, F.lit(True))
    score = F.col("similarity") + F.when(F.coalesce(F.col("year") == F.col("year2"), F.lit(False)), bonus).otherwise(0.0)
    best = s.where((F.col("similarity") >= least) & near).groupBy("qid").agg(F.max_by(F.struct("cid", "similarity"), F.struct(score, -F.col("ord"))).alias("x"))
    return best.select("qid", "x.cid", "x.similarity")


def first_backend(hits: DataFrame, query: str = "query", order: str = "backend_order") -> DataFrame:
    """The hits of the first backend that has any for a query: a chain of fallbacks, not a union."""
    first = hits.groupBy(query).agg(F.min(order).alias("_first"))
    return hits.join(first, query).where(F.col(order) == F.col("_first")).drop("_first")


def barren_rounds(rounds: DataFrame, group: str, order: str, found: str) -> DataFrame:
    """`rounds` with `barren`: how many rounds in a row, this one included, found nothing."""
    w = Window.partitionBy(group).orderBy(order)
    runs = rounds.withColumn("_run", F.sum((F.col(found) > 0).cast("int")).over(w))
    inside = Window.partitionBy(group, "_run").orderBy(order)
    return runs.withColumn("barren", F.sum((F.col(found) == 0).cast("int")).over(inside).cast("int")).drop("_run")


def message_kind(text: Column, document: Column | None = None, shortest: int = 200) -> Column:
    """What a message is: `command`, `submission` (a report as file, PDF address or long text), `guidance` or `ignore`."""
    t = F.trim(F.coalesce(text, F.lit("")))
    url = F.regexp_replace(F.regexp_extract(t, r"(?i)(https?://\S+)", 1), r"[.,;:!?»'\"]+$", "")
    prose = F.when(url != "", F.trim(F.replace(t, url, F.lit("")))).otherwise(t)
    pdf = F.lower(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))).endswith(".pdf")
    file = F.coalesce(F.lower(document).endswith(".pdf"), F.lit(False)) if document is not None else F.lit(False)
    return F.when(t.startswith("/"), "command").when(file | (F.length(prose) >= shortest) | pdf, "submission").when(t != "", "guidance").otherwise("ignore")


def slash_commands(body: Column, allowed: Sequence[str]) -> Column:
    """Array of (name, known, args) of the lines of a text that begin with a slash; unknown names are reported, not dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("/"))
    name = lambda x: F.lower(F.regexp_extract(x, r"^/([\w-]*)", 1))
    args = lambda x: F.filter(F.split(F.regexp_replace(x, r"^/[\w-]*(@\S+)?", ""), r"\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda a: a != "")
    return F.transform(lines, lambda x: F.struct(name(x).alias("name"), name(x).isin(*allowed).alias("known"), F.transform(args(x), lambda a: F.replace(a, F.lit('"'), F.lit(""))).alias("args")))
