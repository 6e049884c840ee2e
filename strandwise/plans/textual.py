"""Queries of the text operators: sentence ranking, term scores, host tiers, folds, fuzzy duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import keys as K
from strandwise.operators import texts as X
from strandwise.operators.fuzzy import keep_new, record_pairs
from strandwise.session import cut
from strandwise.sources.tables import table

#: Abbreviations whose full stop ends no sentence, English and German.
ABBREVIATIONS = (
    "e.g.", "i.e.", "et al.", "cf.", "vs.", "approx.", "ca.", "resp.", "no.", "vol.", "fig.", "figs.", "ed.", "eds.", "pp.", "p.", "st.", "dr.", "prof.", "u.s.", "u.k.",
    "z. b.", "z.b.", "u. a.", "u.a.", "d. h.", "d.h.", "bzw.", "bspw.", "inkl.", "evtl.", "ggf.", "sog.", "usw.", "etc.",
)
#: Phrases of the test corpus; the operators take any.
FINDINGS, METHODS = ["strengthened", "improved", "developed"], ["questioned", "rehearsed"]
TOPICS = (["critical thinking"], ["media literacy"], ["resilience", "resilienz"], ["systems thinking"], ["self regulation"], ["peer feedback"])
AUDIENCE = ["pupils", "children", "schools"]
TIERS = (("trusted", 1, "grove-reports.example"), ("trusted", 1, "nordhaven-press.example"), ("watch", 2, "casa-aula.example"))
_NORM = "trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").where("abstract is not null")
    return s.groupBy("id").agg(F.max("abstract").alias("abstract"))


def q_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", F.posexplode(X.masked_sentences(F.col("abstract"), ABBREVIATIONS)).alias("pos", "sentence"))


def q_top_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_sentences(_texts(spark, sf), "id", "abstract", FINDINGS, METHODS, TOPICS, AUDIENCE, ABBREVIATIONS)


def q_sentence_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate claims made of the best sentences (statements as digests)."""
    kinds = table(spark, sf, "sources").groupBy("id").agg(F.max("source_type").alias("source_type"))
    c = X.sentence_claims(q_top_sentences(spark, sf), "id", kinds)
    return c.select("id", F.md5("statement").alias("digest"), F.array_join("source_ids", ",").alias("source_ids"), "text_anchor", "evidence_type")


def q_host_tiers(spark: SparkSession, sf: str) -> DataFrame:
    tiers = spark.createDataFrame(TIERS, "tier string, tier_order int, domain string")
    s = table(spark, sf, "sources").select("id", T.host(F.col("url")).alias("host")).distinct()
    return X.host_tiers(s, "host", tiers).groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("host").alias("n_hosts"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").where("title is not null").groupBy("id").agg(F.max("title").alias("title"))
    return s.select(F.col("id").alias("doc"), F.explode(T.words(F.col("title"))).alias("term"))


def q_term_idf(spark: SparkSession, sf: str) -> DataFrame:
    return X.term_statistics(_tokens(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def q_linear_scores(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _tokens(spark, sf)
    model = X.term_statistics(tokens).select("term", "idf", F.when(F.length("term") > 8, 0.5).otherwise(-0.25).alias("weight"))
    return X.linear_scores(tokens, model, 0.1).select("doc", F.round("score", 6).alias("score"))


def q_folds(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").groupBy("id").agg(F.max("status").alias("status"))
    return X.stratified_folds(s, "id", "status", 5).select("id", "status", "fold")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """History and batches as `(id, ord, new, title, url, identity, title_key, key, year)`, in order of load, then of harvest."""
    fields = ["doi", "eric_id", "url"]
    old = table(spark, sf, "sources").groupBy("id", "title", "year", *fields).agg(F.min("loaded_at").alias("at")).withColumn("new", F.lit(False))
    new = table(spark, sf, "source_batch").select("id", "title", "year", "doi", F.lit(None).cast("string").alias("eric_id"), "url", F.col("harvested_at").alias("at"), F.lit(True).alias("new"))
    # titles are normalised once a row and query: the keys take most of the time of a large history
    keyed = cut(old.unionByName(new).withColumn("key", T.normalize_title(F.col("title"))))
    identity, title_key = K.identity_key(fields, normalized="key"), K.title_year_key(normalized="key")
    return keyed.select("id", F.struct("new", "at", "id").alias("ord"), "new", "title", "url", identity.alias("identity"), title_key.alias("title_key"), "key", "year")


def q_fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Title pairs of history and batches at a matching-block ratio of 0.92 or more, those without a common exact key being the
    extra ones; tested against brute force, as SQL has no such ratio."""
    return record_pairs(_records(spark, sf)).withColumn("ratio", F.round("ratio", 6))


def q_greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the batches kept in order of harvest: valid, and none the same by a key or fuzzily as one of the history or a kept one."""
    r = _records(spark, sf)
    b = r.where("new")
    valid = b.where((F.col("title") != "") & (F.col("url") != "") & F.coalesce(F.col("year").between(1900, 2100), F.lit(True)))
    found = keep_new(r.where("not new"), valid).where("kept")
    return b.select(F.col("id").alias("node")).join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))


QUERIES = {f.__name__: f for f in (q_sentences, q_top_sentences, q_sentence_claims, q_host_tiers, q_term_idf, q_linear_scores, q_folds, q_fuzzy_pairs, q_greedy_dedup)}

_MASK = "coalesce(abstract, '')"
for _a in [x for x in ABBREVIATIONS if x.count(".") > 1]:
    _p = [f"({re.escape(y)})" for y in _a.split(".")]
    _MASK = f"regexp_replace({_MASK}, '(?i)(^|[^a-zA-Z]){'[.]'.join(_p)}', '\\1{'§'.join(chr(92) + str(i + 2) for i in range(len(_p)))}', 'g')"
_S = "|".join(re.escape(x[:-1]) for x in sorted((x for x in ABBREVIATIONS if x.count(".") == 1), key=len, reverse=True))
_MASK = f"regexp_replace({_MASK}, '(?i)(^|[^a-zA-Z])({_S})[.]', '\\1\\2§', 'g')"
_TEXTS = "x as (select id, max(abstract) as abstract from sources where abstract is not null group by id)"
_SENTENCES = f"""{_TEXTS}, p as (select id, list_filter(list_transform(string_split(regexp_replace({_MASK}, '([.!?])\\s+', '\\1¶', 'g'), '¶'), lambda s: trim(replace(s, '§', '.'))), lambda s: s <> '') as parts from x),
s as (select id, unnest(parts) as sentence, unnest(range(len(parts)))::int as pos from p)"""


def _has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(' ' || {_NORM.format(c='sentence')} || ' ', ' {w} ')" for w in words) + ")"


_TOP = f"""{_SENTENCES}, t0 as (select id, pos, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) as sentence from s),
t as (select *, case when {_has(FINDINGS)} and not {_has(METHODS)} then 1 when {_has(METHODS)} and not {_has(FINDINGS)} then -1 else 0 end as tier, {" + ".join(f"{_has(list(x))}::int" for x in TOPICS)} as named,
  (least(70, 30 * ({" + ".join(f"{_has(list(x))}::int" for x in TOPICS)})) + case when {_has(AUDIENCE)} then 30 else 0 end) / 100.0 as score from t0 where length(sentence) >= 40),
r as (select id, pos, sentence, tier, score, rank from (select *, row_number() over (partition by id order by tier desc, score desc, pos)::int as rank from t where tier >= 0 and named > 0) where rank <= 3)"""
_TOKENS = f"""d as (select id as doc, max(title) as title from sources where title is not null group by id),
tk as (select doc, unnest(list_filter(string_split({_NORM.format(c='title')}, ' '), lambda w: w <> '')) as term from d),
nd as (select count(distinct doc) as n from tk), ti as (select term, count(distinct doc) as df from tk group by term), im as (select term, df, ln((1 + n) / (1 + df)) + 1 as idf from ti, nd)"""
_IN = " or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 1)
_WATCH = " or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 2)
ORACLES = {
    "q_sentences": f"with {_SENTENCES} select id, pos, sentence from s",
    "q_top_sentences": f"""with {_TOP} select id, rank, pos, sentence, tier, score from r""",
    "q_sentence_claims": f"""with {_TOP}, k as (select id, max(source_type) as source_type from sources group by id)
select 'claim-' || regexp_replace(r.id, '^src-', '') || '-' || (pos + 1) as id, md5(sentence) as digest, r.id as source_ids, 'abstract, sentence ' || (pos + 1) as text_anchor,
  coalesce(case source_type {" ".join(f"when '{a}' then '{b}'" for a, b in X.EVIDENCE_OF.items())} end, 'empirical_study') as evidence_type from r left join k using (id)""",
    "q_host_tiers": f"""with h as (select distinct id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www\\.', '') as host from sources)
select case when {_IN} then 'trusted' when {_WATCH} then 'watch' else 'open' end as tier, count(*) as n, count(distinct host) as n_hosts from h group by 1""",
    "q_term_idf": f"with {_TOKENS} select term, df, round(idf, 6) as idf from im",
    "q_linear_scores": f"""with {_TOKENS}, f as (select doc, term, count(*) as tf from tk group by all),
v as (select doc, sum(tf * idf * case when length(term) > 8 then 0.5 else -0.25 end) as dot, sqrt(sum(tf * idf * tf * idf)) as norm from f join im using (term) group by doc)
select doc, round(1 / (1 + exp(-(dot / norm + 0.1))), 6) as score from v""",
    "q_folds": """with s as (select id, max(status) as status from sources group by id)
select id, status, ((row_number() over (partition by status order by md5(id), id) - 1) % 5)::int as fold from s""",
}
