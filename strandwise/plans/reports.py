"""Reports over the catalogue: details, orphans, shares, field metrics, cross-validation, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import agreement as A
from strandwise.operators import vectors as V
from strandwise.operators.texts import stratified_folds
from strandwise.plans.core import _ANSWERS_SQL, _CENTRE_SQL, _CLAIMS_SQL, _NORM, _SKILLS_SQL, _answers, _claims, _skills
from strandwise.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {_SKILLS_SQL} select skill_id, evidence_score from sk where status <> 'deprecated' order by coalesce(evidence_score, 0) desc, skill_id limit 12")
def q_top_skills(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve best skills (the limit is the feature)."""
    s = _skills(spark, sf).where("status <> 'deprecated'")
    return s.orderBy(F.coalesce("evidence_score", F.lit(0.0)).desc(), "skill_id").select("skill_id", "evidence_score").limit(12)


@query(
    f"""with {_SKILLS_SQL}, {_CLAIMS_SQL}, l as (select skill_id, 'support' as role, unnest(s) as claim_id from sk union all select skill_id, 'contra', unnest(k) from sk),
m as (select skill_id, count(*) as n_mappings from frameworks where skill_id is not null group by skill_id)
select sk.skill_id, coalesce(n_mappings, 0) as n_mappings, count(c.claim_id) filter (role = 'support') as n_support, count(c.claim_id) filter (role = 'contra') as n_contra
from sk left join l using (skill_id) left join c using (claim_id) left join m using (skill_id) group by all"""
)
def q_skill_detail(spark: SparkSession, sf: str) -> DataFrame:
    s = _skills(spark, sf)
    none = F.array().cast("array<string>")
    links = s.select("skill_id", F.explode(F.array(
        F.struct(F.lit("support").alias("role"), F.coalesce("supporting_claim_ids", none).alias("ids")), F.struct(F.lit("contra").alias("role"), F.coalesce("contradicting_claim_ids", none).alias("ids")))).alias("l"))
    known = links.select("skill_id", "l.role", F.explode("l.ids").alias("claim_id")).join(_claims(spark, sf).select("claim_id"), "claim_id", "left_semi")
    counts = known.groupBy("skill_id").agg(F.count_if(F.col("role") == "support").alias("n_support"), F.count_if(F.col("role") == "contra").alias("n_contra"))
    maps = table(spark, sf, "frameworks").where("skill_id is not null").groupBy("skill_id").agg(F.count("*").alias("n_mappings"))
    zero = F.lit(0).cast("long")
    return s.select("skill_id").join(maps, "skill_id", "left").join(counts, "skill_id", "left").select("skill_id", *[F.coalesce(c, zero).alias(c) for c in ("n_mappings", "n_support", "n_contra")])


@query(
    f"""with {_SKILLS_SQL}, {_CLAIMS_SQL}, st2 as (select id as source_id, max(title) as title from sources group by id),
l as (select skill_id, unnest(s) as claim_id, unnest(range(len(s))) as p from sk where status = 'active'),
w as (select skill_id, p, unnest(source_ids) as source_id, unnest(range(len(source_ids))) as q from l join c using (claim_id))
select skill_id, md5(string_agg(coalesce(title, ''), ' ' order by p, q)) as text_digest from w join st2 using (source_id) group by skill_id"""
)
def q_search_text(spark: SparkSession, sf: str) -> DataFrame:
    """Search text of a skill: the titles behind its claims in order of citation (as a digest)."""
    links = _skills(spark, sf).where("status = 'active'").select("skill_id", F.posexplode("supporting_claim_ids").alias("p", "claim_id"))
    walk = links.join(_claims(spark, sf), "claim_id").select("skill_id", "p", F.posexplode("source_ids").alias("q", "source_id"))
    titles = table(spark, sf, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max("title").alias("title"))
    parts = walk.join(titles, "source_id").groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("p", "q", F.coalesce("title", F.lit("")).alias("t")))).alias("x"))
    return parts.select("skill_id", F.md5(F.array_join(F.transform("x", lambda x: x["t"]), " ")).alias("text_digest"))


@query(
    f"""with {_CLAIMS_SQL} select id as source_id from (select id, max(status) as status from sources group by id) where status = 'candidate'
  and id not in (select unnest(source_ids) from c where status in ('candidate', 'reviewed') and source_ids is not null)"""
)
def q_orphan_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max("status").alias("status")).where("status = 'candidate'")
    used = _claims(spark, sf).where("status in ('candidate', 'reviewed')").select(F.explode("source_ids").alias("source_id")).distinct()
    return s.join(used, "source_id", "left_anti").select("source_id")


@query(
    """with c as (select date_trunc('month', loaded_at)::date as month, count(*) as n from claims group by 1)
select month, n, lag(n) over (order by month) as n_before, round(n / lag(n) over (order by month), 4) as ratio from c"""
)
def q_monthly_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Loads per month against the month before; the window runs over months, not rows."""
    c = table(spark, sf, "claims").groupBy(F.trunc("loaded_at", "month").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return c.select("month", "n", before.alias("n_before"), F.round(F.col("n") / before, 4).alias("ratio"))


@query(
    """with t as (select id, unnest([{'field': 'outcome', 'gold': outcome, 'said': context}, {'field': 'strength', 'gold': evidence_strength, 'said': appraisal.evidence_certainty}], recursive := true) from claims),
c as (select field, count(*) filter (said is not null) as predicted, count(*) filter (gold is not null) as gold_n, count(*) filter (said = gold) as hits, count(*) filter (said is null and gold is null) as abstained from t group by field)
select field, predicted, gold_n, hits, abstained, round(coalesce(hits / nullif(predicted, 0), 1), 6) as precision, round(coalesce(hits / nullif(gold_n, 0), 1), 6) as recall from c"""
)
def q_field_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-field metrics of stored readings; precision and recall are 1 where nothing was said or known."""
    t = table(spark, sf, "claims").select(F.explode(F.array(
        F.struct(F.lit("outcome").alias("field"), F.col("outcome").alias("gold"), F.col("context").alias("said")),
        F.struct(F.lit("strength").alias("field"), F.col("evidence_strength").alias("gold"), F.col("appraisal.evidence_certainty").alias("said")))).alias("x")).select("x.*")
    said, gold = F.col("said"), F.col("gold")
    c = t.groupBy("field").agg(F.count("said").alias("predicted"), F.count("gold").alias("gold_n"), F.count_if(said == gold).alias("hits"), F.count_if(said.isNull() & gold.isNull()).alias("abstained"))
    one = F.lit(1.0)
    return c.select("*", F.round(F.coalesce(F.col("hits") / F.nullif(F.col("predicted"), F.lit(0)), one), 6).alias("precision"), F.round(F.coalesce(F.col("hits") / F.nullif(F.col("gold_n"), F.lit(0)), one), 6).alias("recall"))


@query(
    f"""with {_ANSWERS_SQL}, w as (select a, b, count(*) as n, sum((l = r)::int) as same from pr group by all),
e as (select a as rater, n, same from w union all select b, n, same from w)
select rater, sum(n)::bigint as n_pairs, round(sum(same) / sum(n), 6) as mean_agreement from e group by rater"""
)
def q_rater_agreement(spark: SparkSession, sf: str) -> DataFrame:
    p = A.rater_pairs(_answers(spark, sf)).select(F.explode(F.array("a", "b")).alias("rater"), (F.col("left") == F.col("right")).cast("int").alias("same"))
    return p.groupBy("rater").agg(F.count("*").alias("n_pairs"), F.round(F.sum("same") / F.count("*"), 6).alias("mean_agreement"))


@query("select item_key, 'case-' || substr(sha256('ratings' || chr(0) || item_key), 1, 10) as alias from (select distinct item_key from ratings where item_key is not null)")
def q_alias_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Blind keys of rated items."""
    r = table(spark, sf, "ratings").select("item_key").where("item_key is not null").distinct()
    return r.select("item_key", F.concat(F.lit("case-"), F.substring(F.sha2(F.concat(F.lit("ratings\0"), "item_key"), 256), 1, 10)).alias("alias"))


@query(
    f"""with {_SKILLS_SQL}, q as (select distinct {_NORM.format(c='name')} || case when audience = 'educator' then ' teachers' else ' students' end as query from sk where status = 'active' and name is not null)
select query from q order by query limit 24"""
)
def q_derived_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Harvest queries from active skills; the cap of 24 is the feature."""
    s = _skills(spark, sf).where("status = 'active' and name is not null")
    suffix = F.when(F.col("audience") == "educator", " teachers").otherwise(" students")
    return s.select(F.concat(T.normalize_title(F.col("name")), suffix).alias("query")).distinct().orderBy("query").limit(24)


@query(
    """select framework, count(*) as n, count(distinct skill_id) as n_skills, count(*) filter (coverage_score < 1.5) as n_gaps, count(*) filter (mapping_strength = 'strong') as n_strong, min(created_at) as first_created
from frameworks group by framework"""
)
def q_framework_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frameworks").groupBy("framework").agg(
        F.count("*").alias("n"), F.countDistinct("skill_id").alias("n_skills"), F.count_if(F.col("coverage_score") < 1.5).alias("n_gaps"),
        F.count_if(F.col("mapping_strength") == "strong").alias("n_strong"), F.min("created_at").alias("first_created"))


@query(
    f"""with {_CENTRE_SQL}, v as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as dim from embeddings)
select v.vec_id, round(sum(x * value) filter (ce.label = 0) / sqrt(sum(x * x) filter (ce.label = 0)) - sum(x * value) filter (ce.label = 1) / sqrt(sum(x * x) filter (ce.label = 1)), 5) as difference
from v join ce using (dim) where ce.label in (0, 1) group by v.vec_id"""
)
def q_anchor_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine to a positive less cosine to a negative anchor (the centroids of two labels)."""
    e = table(spark, sf, "embeddings")
    c = V.centroids(e.where("label in (0, 1)"), "label", "embedding")
    anchors = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("anchor")).groupBy().pivot("label", [0, 1]).agg(F.first("anchor")).toDF("pos", "neg")
    both = e.crossJoin(F.broadcast(anchors))  # one row: the two anchors
    return both.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("pos")) - V.cosine(F.col("embedding"), F.col("neg")), 5).alias("difference"))


@query(
    """with s as (select id, max(status) as status, max(relevance_score) as r from sources group by id),
f as (select *, ((row_number() over (partition by status order by md5(id), id) - 1) % 5)::int as fold from s),
m as (select a.fold, avg(round(b.r * 100)::int) filter (b.status = 'reviewed') as yes, avg(round(b.r * 100)::int) filter (b.status <> 'reviewed') as no from (select distinct fold from f) a join f b on b.fold <> a.fold group by a.fold),
p as (select f.*, abs(round(r * 100) - yes) < abs(round(r * 100) - no) as said from f join m using (fold) where r is not null)
select count(*) filter (status = 'reviewed' and said) as tp, count(*) filter (status <> 'reviewed' and said) as fp, count(*) filter (status = 'reviewed' and not said) as fn, count(*) filter (status <> 'reviewed' and not said) as tn from p"""
)
def q_cv_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Five-fold cross-validation of a nearest-mean rule on the relevance score, pooled before the counts.

    The means without a fold come from sums per fold, so no fold is joined with the others.
    """
    s = table(spark, sf, "sources").groupBy("id").agg(F.max("status").alias("status"), F.max("relevance_score").alias("r"))
    f = stratified_folds(s, "id", "status", 5).withColumn("x", F.round(F.col("r") * 100).cast("int")).withColumn("y", F.col("status") == "reviewed")
    sums = f.groupBy("fold").agg(F.sum(F.when(F.col("y"), F.col("x"))).alias("sy"), F.count_if(F.col("y") & F.col("x").isNotNull()).alias("ny"), F.sum(F.when(~F.col("y"), F.col("x"))).alias("sn"), F.count_if(~F.col("y") & F.col("x").isNotNull()).alias("nn"))
    w = Window.partitionBy(F.lit(1))  # five rows
    means = sums.select("fold", *[((F.sum(a).over(w) - F.coalesce(F.col(a), F.lit(0))) / (F.sum(b).over(w) - F.col(b))).alias(m) for a, b, m in (("sy", "ny", "yes"), ("sn", "nn", "no"))])
    p = f.join(F.broadcast(means), "fold").where("x is not null").withColumn("said", F.abs(F.col("x") - F.col("yes")) < F.abs(F.col("x") - F.col("no")))
    return p.agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("y") & F.col("said")), ("fp", ~F.col("y") & F.col("said")), ("fn", F.col("y") & ~F.col("said")), ("tn", ~F.col("y") & ~F.col("said")))])


#: Cosine at which the catalogue links two embeddings.
LINKED = 0.5


_COSINE_SQL = f"""cp as (select a.vec_id as id_a, b.vec_id as id_b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
  from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= {LINKED})"""


@query(f"with {_COSINE_SQL} select id_a, id_b, similarity from cp")
def q_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of embeddings at the cosine cut."""
    return V.cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", LINKED).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""with recursive {_COSINE_SQL}, bo as (select id_a as a, id_b as b from cp union select id_b, id_a from cp),
r(node, c) as (select vec_id, vec_id from embeddings union select bo.b, r.c from r join bo on r.node = bo.a)
select node, min(c) as component from r group by node"""
)
def q_cosine_components(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage at the cosine cut: the component of every embedding, named by its smallest member."""
    edges = q_cosine_pairs(spark, sf).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return V.components(edges, table(spark, sf, "embeddings").select(F.col("vec_id").alias("node")))
