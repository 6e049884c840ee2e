"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.consensus import ConfusionModel, consensus_by_groups, krippendorff_alpha, latest_answers
from strandwise.llm.containers import CAPACITY, Filling, fill_containers, token_counts
from strandwise.llm.entities import match_entities
from strandwise.llm.history import accept_batch, new_store, repeated_records
from strandwise.llm.language import LanguageModel, fit_from
from strandwise.llm.leakage import leaked_items
from strandwise.llm.runs import abstract_runs, title_runs
from strandwise.llm.sentences import sentences
from strandwise.llm.spans import shared_share, shared_spans
from strandwise.sources.tables import table


def _repeats(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "source":
        fields = ["id", "title", "authors", "year", "doi"]
        old = table(spark, sf_dir, "sources").select(*fields)
        new = table(spark, sf_dir, "source_batch").select(*fields, F.col("harvested_at").alias("at"))
    else:
        none = [F.lit(None).cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("doi")]
        old = table(spark, sf_dir, "claims").select("id", F.col("statement").alias("title"), *none)
        new = table(spark, sf_dir, "claim_batch").select("id", F.col("statement").alias("title"), *none, F.col("harvested_at").alias("at"))
    return repeated_records(old, new, kind)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        _repeats(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), F.least("id", "accepted").alias("id_a"), F.greatest("id", "accepted").alias("id_b"))
        for kind in ("source", "claim")
    ]
    return parts[0].unionByName(parts[1])


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and repeated source records per batch, each batch held against the stored tables and then appended to them."""
    fields = ["id", "title", "authors", "year", "doi"]
    store = new_store(spark, "source")
    store.append(table(spark, sf_dir, "sources").select(*fields, F.lit(None).cast("timestamp").alias("at")))
    batches = table(spark, sf_dir, "source_batch").select(*fields, "batch_id", F.col("harvested_at").alias("at"))
    weeks = batches.groupBy("batch_id").agg(F.min("at").alias("at")).orderBy("at", "batch_id").collect()  # one row per batch
    out = None
    for w in weeks:
        one = batches.where(F.col("batch_id").eqNullSafe(F.lit(w.batch_id)))
        found = accept_batch(store, one).select("id", F.lit(1).alias("repeated"))
        part = one.select("id", "batch_id").join(found, "id", "left").groupBy("batch_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("n_repeated"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_repeated"))


def _language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    return fit_from(table(spark, sf_dir, "sources"), "abstract", "lang")


def _once(df: DataFrame, text: str) -> DataFrame:
    """One row per id with its text; the latest load with a text counts, ids and texts that are null drop out."""
    return (
        df.where(F.col("id").isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col("id").alias("rec_id")).agg(F.max(F.struct("loaded_at", F.col(text).alias("text"))).alias("last"))
        .select("rec_id", "last.text")
    )


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(table(spark, sf_dir, "sources"), "abstract").where(F.length("text") >= 13).select(F.lit("source").alias("kind"), "rec_id", "text")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(table(spark, sf_dir, "claims"), "statement").select(F.lit("claim").alias("kind"), "rec_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _abstracts(spark, sf_dir).unionByName(_statements(spark, sf_dir))
    return sentences(texts, _language_model(spark, sf_dir))


def p3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their mean length by kind."""
    return p3_found(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_sentences"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean_chars"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _language_model(spark, sf_dir)
    titles = _once(table(spark, sf_dir, "sources"), "title").select("rec_id", "text")
    return abstract_runs(_abstracts(spark, sf_dir), model).unionByName(title_runs(titles, model))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("rec_id").alias("source_id"), "field", "start_pos", "end_pos", "lang")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, characters and mean confidence by field and language."""
    return _runs(spark, sf_dir).groupBy("field", "lang").agg(
        F.count("*").alias("n_runs"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_chars"), F.avg("confidence").alias("mean_confidence")
    )


def _model(spark: SparkSession, sf_dir: str) -> ConfusionModel:
    return ConfusionModel(latest_answers(table(spark, sf_dir, "ratings")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).labels(min_raters=3).select(F.col("item").alias("item_key"), "field", "label")


def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).reliability()


def p5_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels by group-bys alone, each rater for itself."""
    labels = consensus_by_groups(latest_answers(table(spark, sf_dir, "ratings")), sweeps=5)
    return labels.select(F.col("item").alias("item_key"), "field", "label", F.round("confidence", 6).alias("confidence"))


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return krippendorff_alpha(latest_answers(table(spark, sf_dir, "ratings")))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "openalex_works").select(
        "id", F.col("display_name").alias("title"), F.col("authorships.author.display_name").alias("authors"), F.col("publication_year").alias("year"), "doi", F.col("fetched_at").alias("at")
    )
    return match_entities(table(spark, sf_dir, "sources").select("id", "title", "authors", "year", "doi", F.col("loaded_at").alias("at")), works, at="at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).where("p > 0.5").select(F.col("left_id").alias("source_id"), F.col("right_id").alias("work_id"))


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with the posterior of a match and the similarities behind it."""
    return _matches(spark, sf_dir).withColumnsRenamed({"left_id": "source_id", "right_id": "work_id", "p": "confidence"})


def p6_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by tenth of their confidence, with the share that carries one DOI among those with two: what the confidence is worth."""
    tenth = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    return _matches(spark, sf_dir).groupBy(tenth.alias("tenth")).agg(
        F.count("*").alias("n_pairs"), F.avg("p").alias("mean_confidence"), F.avg("doi").alias("same_doi"), F.avg("title").alias("mean_title")
    )


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every part of a text longer than a container."""
    return _filling(spark, sf_dir).items.withColumnRenamed("key", "doc_id")


def _filling(spark: SparkSession, sf_dir: str) -> Filling:
    return fill_containers(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the share of space used, and the gap to the least number of containers by the program's bound."""
    filling = _filling(spark, sf_dir)
    filled = filling.items.where("container >= 0")
    out = filled.agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    n = F.nullif(F.col("n_containers"), F.lit(0))
    return out.select("n_containers", "n_tokens", F.lit(filling.bound).alias("n_bound"), (F.col("n_tokens") / (n * CAPACITY)).alias("fill"), (F.col("n_containers") / F.nullif(F.lit(filling.bound), F.lit(0)) - 1).alias("gap"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item the number of documents that hold it."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def p9_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches to remove so that the first document alone keeps each shared one."""
    return shared_spans(table(spark, sf_dir, "documents"), later_only=True).withColumnRenamed("doc", "doc_id")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


_QUERIES = {
    "p1_found": p1_found, "p1_batches": p1_batches,
    "p3_found": p3_found, "p3_lengths": p3_lengths, "p4_found": p4_found, "p4_languages": p4_languages,
    "p6_found": p6_found, "p6_confidence": p6_confidence, "p6_deciles": p6_deciles,
    "p5_found": p5_found, "p5_reliability": p5_reliability, "p5_agreement": p5_agreement, "p5_by_groups": p5_by_groups,
    "p7_containers": p7_containers, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_report": p8_report,
    "p9_found": p9_found, "p9_removals": p9_removals, "p9_share": p9_share,
}
_ORACLES: dict[str, str] = {
    "p5_agreement": """
with a as (
  select field, item_key, rater, arg_max(label, (rated_at, label)) as label
  from (select *, regexp_replace(lower(trim(value)), '[\\s-]+', '_', 'g') as label from ratings where touched and value is not null)
  where label <> '' group by field, item_key, rater),
v as (select field, item_key, label, count(*) as n_c from a group by all),
u as (select field, item_key, sum(n_c) as m, sum(n_c * (n_c - 1)) as pairs from v group by all having sum(n_c) > 1),
o as (select field, count(*) as n_items, sum(m) as n, sum(pairs / (m - 1)) as agree from u group by field),
c as (select v.field, label, sum(n_c) as n_c from v join u using (field, item_key) group by all),
s as (select field, sum(n_c * n_c) as sq from c group by field)
select field, n_items, n::bigint as n_values, round(1 - (n - 1) * (n - agree) / nullif(n * n - sq, 0), 6) as alpha from o join s using (field)
""",
}


_WINDOWS_SQL = """
d as (select doc_id, text from documents where length(text) >= 500),
w as (select doc_id, p, md5(substr(text, p + 1, 500)) as h from (select doc_id, text, unnest(range(0, length(text) - 499)) as p from d)),
t as (select h, min(doc_id) as first_doc from w group by h having min(doc_id) < max(doc_id)),
x as (select doc_id, p, first_doc from w join t using (h))
"""


def _merged(where: str) -> str:
    return f"""m as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 500 or lag(p) over (partition by doc_id order by p) is null then 1 else 0 end as new from (select distinct doc_id, p from x where {where})),
r as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from m),
f as (select doc_id, min(p)::int as start_pos, (max(p) + 500)::int as end_pos from r group by doc_id, run)"""


_ORACLES |= {
    "p9_found": f"with {_WINDOWS_SQL}, {_merged('true')} select doc_id, start_pos, end_pos from f",
    "p9_removals": f"with {_WINDOWS_SQL}, {_merged('first_doc < doc_id')} select doc_id, start_pos, end_pos from f",
    "p9_share": f"""with {_WINDOWS_SQL}, {_merged('true')}, s as (select doc_id, sum(end_pos - start_pos)::bigint as n_shared from f group by doc_id)
select doc_id, length(text) as n_chars, coalesce(n_shared, 0) as n_shared, coalesce(n_shared, 0) / nullif(length(text), 0) as shared_share from documents left join s using (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
