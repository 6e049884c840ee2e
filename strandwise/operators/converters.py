"""Payloads of catalogue services to one flat record each: `(id, title, authors, year, doi, url, publisher, source_type, abstract, ...)`.

Payloads are landed as JSON or XML and read with a schema; every level may be null or absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import text as T

#: What the converters read of each service; other fields may be left out.
CROSSREF = (
    "title array<string>, DOI string, URL string, type string, publisher string, author array<struct<given: string, family: string>>, "
    "`published-print` struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, issued struct<`date-parts`: array<array<int>>>"
)
SEMANTIC = "paperId string, title string, abstract string, year int, url string, venue string, publicationTypes array<string>, externalIds struct<DOI: string, ERIC: string>, authors array<struct<name: string>>"
ERIC = "id string, title string, author array<string>, description string, publicationdateyear string, publicationtype array<string>, peerreviewed string, source string, url string"
ATOM = "id string, title string, published string, summary string, doi string, author array<struct<name: string>>, link array<struct<_rel: string, _type: string, _href: string>>"


#: Titles and publishers of records without one.
UNTITLED = {
    "crossref": "Untitled Crossref work", "semantic_scholar": "Untitled Semantic Scholar paper", "eric": "Untitled ERIC record", "arxiv": "Untitled arXiv work", "web": "Untitled web result", "openalex": "Untitled",
}
PUBLISHERS = {"crossref": "Crossref", "semantic_scholar": "Semantic Scholar", "eric": "ERIC", "arxiv": "arXiv", "web": "web", "openalex": "OpenAlex", "report": "report"}


def _blank(c: Column) -> Column:
    """White space squeezed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def _names(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, _blank), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def _record(df: DataFrame, **fields: Column) -> DataFrame:
    none = {"doi": None, "eric_id": None, "semantic_scholar_id": None, "openalex_id": None, "license": None, "abstract": None}
    columns = {n: F.lit(v).cast("string") for n, v in none.items()} | fields
    doi_url = F.concat(F.lit("https://doi.org/"), columns["doi"])
    columns["url"] = F.coalesce(F.nullif(columns.get("url", F.lit(None).cast("string")), F.lit("")), doi_url, F.lit(""))
    return df.select(F.concat(F.lit("src-"), T.slug(columns["title"])).alias("id"), *[c.alias(n) for n, c in columns.items()], F.lit("candidate").alias("status"))


def from_crossref(items: DataFrame) -> DataFrame:
    """The first title; the year of print, else of the online version, else of issue; no abstract. A title in its place where none is given."""
    year = F.coalesce(*[F.when(F.col(f"`{p}`").isNotNull(), F.struct(F.try_element_at(F.try_element_at(F.col(f"`{p}`.`date-parts`"), F.lit(1)), F.lit(1)).alias("y"))) for p in ("published-print", "published-online", "issued")])["y"]
    people = F.transform("author", lambda a: F.concat_ws(" ", _blank(a["given"]), _blank(a["family"])))
    return _record(
        items, title=F.coalesce(F.try_element_at("title", F.lit(1)), F.lit(UNTITLED["crossref"])), authors=_names(people), year=F.nullif(year, F.lit(0)), doi=F.col("DOI"), url=F.col("URL"),
        publisher=F.coalesce(F.nullif("publisher", F.lit("")), F.lit(PUBLISHERS["crossref"])), source_type=F.when(F.col("type").isin("book", "book-chapter", "monograph"), "book").otherwise("peer_reviewed_article"),
    )


def from_semantic_scholar(papers: DataFrame) -> DataFrame:
    """A paper with the publication type `review` in any case is a systematic review."""
    review = F.coalesce(F.exists("publicationTypes", lambda k: F.lower(k) == "review"), F.lit(False))
    return _record(
        papers, title=F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED["semantic_scholar"])), authors=_names(F.col("authors.name")), year=F.nullif("year", F.lit(0)), doi=F.col("externalIds.DOI"), url=F.col("url"),
        semantic_scholar_id=F.col("paperId"), eric_id=F.col("externalIds.ERIC"), publisher=F.coalesce(F.nullif("venue", F.lit("")), F.lit(PUBLISHERS["semantic_scholar"])),
        source_type=F.when(review, "systematic_review").otherwise("peer_reviewed_article"), abstract=F.col("abstract"),
    )


def from_eric(docs: DataFrame) -> DataFrame:
    """The kind of document decides the type before its descriptors do; the peer review flag only where neither says anything."""
    kind = lambda word: F.coalesce(F.exists("publicationtype", lambda k: F.contains(F.lower(k), F.lit(word))), F.lit(False))
    source_type = (
        F.when(kind("book"), "book").when(kind("journal articles"), "peer_reviewed_article").when(kind("information analyses"), "conceptual_review")
        .when(kind("report"), "policy_report").when(F.col("peerreviewed") == "T", "peer_reviewed_article").otherwise("conceptual_review")
    )
    page = F.concat(F.lit("https://eric.ed.gov/?id="), F.nullif("id", F.lit("")))
    return _record(
        docs, title=F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED["eric"])), authors=_names(F.col("author")), year=F.when(F.col("publicationdateyear").rlike(r"^\d+$"), F.col("publicationdateyear")).try_cast("int"),
        url=F.coalesce(F.nullif("url", F.lit("")), page), eric_id=F.col("id"), publisher=F.coalesce(F.nullif("source", F.lit("")), F.lit(PUBLISHERS["eric"])), source_type=source_type, abstract=F.nullif("description", F.lit("")),
    )


def from_atom(entries: DataFrame) -> DataFrame:
    """Preprints: the year is that of the date's beginning, the address that of the page, else the identifier."""
    page = F.try_element_at(F.filter("link", lambda x: (x["_rel"] == "alternate") & (x["_type"] == "text/html")), F.lit(1))["_href"]
    return _record(
        entries, title=F.coalesce(_blank(F.col("title")), F.lit(UNTITLED["arxiv"])), authors=_names(F.col("author.name")), year=F.regexp_extract(F.coalesce("published", F.lit("")), r"^\s*(\d{4})", 1).try_cast("int"),
        doi=_blank(F.col("doi")), url=F.coalesce(page, _blank(F.col("id"))), publisher=F.lit(PUBLISHERS["arxiv"]), source_type=F.lit("working_paper"), abstract=_blank(F.col("summary")),
    )


def from_openalex(works: DataFrame) -> DataFrame:
    """Nested works with their abstract put together from its inverted index; the DOI without its resolver."""
    kind = F.col("type")
    source_type = (
        F.when(kind == "review", "systematic_review").when(kind.isin("article", "preprint"), "peer_reviewed_article").when(kind == "report", "policy_report")
        .when(kind == "book", "book").when(kind == "dataset", "dataset").otherwise("web_resource")
    )
    doi = F.regexp_replace(F.col("doi"), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return _record(
        works.withColumn("_id", F.col("id")), title=F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.lit(UNTITLED["openalex"])), authors=_names(F.col("authorships.author.display_name")), year=F.nullif("publication_year", F.lit(0)),
        doi=doi, url=F.coalesce(F.col("doi"), F.col("_id")), openalex_id=F.col("_id"), publisher=F.coalesce(F.col("primary_location.source.display_name"), F.lit(PUBLISHERS["openalex"])), license=F.col("primary_location.license"),
        source_type=source_type, abstract=T.inverted_text(F.col("abstract_inverted_index")),
    )


def from_web(hits: DataFrame, current_year: int) -> DataFrame:
    """`hits(title, snippet, link, tier)`: the year is the latest plausible one named anywhere, else the current one marked provisional."""
    y = T.plausible_year([F.col("title"), F.col("snippet"), F.col("link")], current_year)
    return _record(
        hits, title=F.coalesce(_blank(F.col("title")), F.lit(UNTITLED["web"])), authors=F.array().cast("array<string>"), year=y["year"], url=F.col("link"), publisher=F.coalesce(F.nullif(T.host(F.col("link")), F.lit("")), F.lit(PUBLISHERS["web"])),
        source_type=F.lit("web_resource"), abstract=F.col("snippet"), tier=F.coalesce("tier", F.lit("open")), provisional_year=y["provisional"],
    )


def from_reports(proposals: DataFrame, source_types: tuple[str, ...] = ("policy_report", "framework", "working_paper", "systematic_review")) -> DataFrame:
    """`proposals(title, year, source_type, authors, summary, url, publisher)`: those without a title or a year of 1900 to 2100 are dropped."""
    named = proposals.where(_blank(F.col("title")).isNotNull() & F.col("year").between(1900, 2100))
    return _record(
        named, title=_blank(F.col("title")), authors=_names(F.col("authors")), year=F.col("year"), url=F.col("url"), publisher=F.coalesce(F.nullif("publisher", F.lit("")), F.lit(PUBLISHERS["report"])),
        source_type=F.when(F.col("source_type").isin(*source_types), F.col("source_type")).otherwise(F.lit("policy_report")), abstract=F.nullif("summary", F.lit("")),
    )


def report_claims(reports: DataFrame, shortest: int = 40) -> DataFrame:
    """`(source_id, n, statement)` of `reports(source_id, text, findings array<string>)`: verbatim findings, each passage once, numbered by source."""
    f = reports.select("source_id", "text", F.posexplode("findings").alias("pos", "finding"))
    f = f.select("source_id", "pos", T.verbatim(F.col("finding"), F.col("text"), shortest).alias("statement")).where("statement is not null")
    once = f.groupBy("source_id", "statement").agg(F.min("pos").alias("pos"))
    ranked = once.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "statement"))).alias("x"))  # the findings of one report
    return ranked.select("source_id", F.posexplode("x").alias("n", "f")).select("source_id", (F.col("n") + 1).alias("n"), "f.statement")
