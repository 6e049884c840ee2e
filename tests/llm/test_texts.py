"""Sentences, languages, consensus and containers."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import consensus as C
from strandwise.llm.containers import fill_containers, fullest, knapsack, solve_configurations, token_counts
from strandwise.llm.language import UNKNOWN, LanguageModel, features, fit_from, fit_model, language_code
from strandwise.llm.runs import abstract_runs, join_runs, title_runs
from strandwise.llm.sentences import Boundaries, LanguageFacts, sentences
from strandwise.sources.tables import table

EN = ["The teachers of the school compared the results with those of the other groups.", "About the half of the children liked the new books that they had been given."]
DE = ["Die Lehrpersonen der Schule verglichen die Ergebnisse mit denen der anderen Gruppen.", "Rund die Hälfte der Kinder mochte die neuen Bücher, die sie bekommen hatten."]
FR = ["Les enseignants de l’école ont comparé les résultats avec ceux des autres groupes.", "Environ la moitié des enfants a aimé les nouveaux livres qui leur ont été donnés."]
JA = ["学校の教師は結果を他の班のものと比較した。", "およそ半分の子どもたちは新しい本を気に入った。"]


@pytest.fixture(scope="module")
def model():
    texts, labels = [], []
    for code, own in (("en", EN), ("de", DE), ("fr", FR), ("ja", JA)):
        for i in range(12):
            texts.append(" ".join(own) if i % 2 else own[0])
            labels.append(code if i else "de")
    return fit_model(texts, labels)


def test_languages_despite_wrong_labels(model):
    lang, conf = model.classify([EN[1], DE[1], FR[1], JA[1], "", "123 — 456"])
    assert lang == ["en", "de", "fr", "ja", UNKNOWN, UNKNOWN]
    assert all(c > 0.5 for c in conf[:4]) and conf[4] == conf[5] == 0


def test_features_of_blank_texts():
    row, f, n = features(["", "a", "ab ab"])
    assert set(row) == {1, 2} and len(row) == len(f) == len(n)


def test_language_code(spark):
    rows = [("en-GB",), ("ENG",), ("Deutsch",), (" FR ",), ("xx",), ("und",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(language_code(F.col("x"))).collect()]
    assert got == ["en", "en", "de", "fr", None, None, None, None]


def test_fit_from_a_table_with_nulls(spark):
    df = spark.createDataFrame([(t * 2, c) for c, own in (("en", EN), ("german", DE)) for t in own * 6] + [(None, "en"), ("x", None)], "text string, lang string").withColumn("code", F.lit(1))
    m = fit_from(df.drop("code"), "text", "lang")
    assert m.languages in ([], ["de", "en"])


FACTS = Boundaries({
    "en": LanguageFacts({"dr": False, "etc": True, "e.g": False, "u.s": True}, {"the", "about", "learners"}, {"about"}, set()),
    "de": LanguageFacts({"z": False, "dr": False}, {"die"}, set(), {"mai", "klasse"}), "ar": LanguageFacts({"د": False, "نقطة": True}), "th": LanguageFacts()})


@pytest.mark.parametrize(("text", "langs", "parts"), [
    ("Dr. Smith came. He left.", ["en"], ["Dr. Smith came.", "He left."]),
    ("We used books, etc. The end.", ["en"], ["We used books, etc.", "The end."]),
    ("It was in the U.S. About 3.14 of it.", ["en"], ["It was in the U.S.", "About 3.14 of it."]),
    ("“Why? Tell us.” asked one. Then “No.” Done.", ["en"], ["“Why? Tell us.” asked one.", "Then “No.”", "Done."]),
    ("(See the list.) The next one.", ["en"], ["(See the list.)", "The next one."]),
    ("Heading without mark\nMethods: we did. ", ["en"], ["Heading without mark", "Methods: we did."]),
    ("The errors.About half", ["en"], ["The errors.", "About half"]),
    ("We waited … and then left.", ["en"], ["We waited … and then left."]),
    ("Am 5. Mai kam die 3. Klasse. Die andere nicht.", ["de"], ["Am 5. Mai kam die 3. Klasse.", "Die andere nicht."]),
    ("«Warum?», fragte er. „Es ging. Gut.“, sagte sie.", ["de"], ["«Warum?», fragte er.", "„Es ging. Gut.“, sagte sie."]),
    ("結果だ。「なぜか。」と彼は言った。次だ！", ["ja"], ["結果だ。", "「なぜか。」と彼は言った。", "次だ！"]),
    ("قال د. علي: «لماذا؟» ارتفع إلى 3 نقطة. هل نعم؟", ["ar"], ["قال د. علي: «لماذا؟»", "ارتفع إلى 3 نقطة.", "هل نعم؟"]),
    ("เด็กร้อยละ 41 ของครู ครูเล็ก", ["th"], ["เด็กร้อยละ 41 ของครู", "ครูเล็ก"]),
    ("", ["en"], []), ("  \n ", ["en"], []), ("no end", [], ["no end"])])
def test_sentence_boundaries(text, langs, parts):
    got = FACTS.split(text, tuple(langs))
    assert [text[s:e] for s, e in got] == parts


def test_sentences_cover_the_text_and_take_dirty_rows(spark, model):
    rows = [("source", "a", " ".join(EN + DE)), ("claim", "b", None), ("claim", "c", ""), ("claim", "d", " \n"), ("claim", "e", (EN[0] + " ") * 2000), ("source", "a", " ".join(EN + DE))]
    df = spark.createDataFrame(rows, "kind string, rec_id string, text string").withColumn("langs", F.lit("clash"))
    got = sentences(df, model).collect()
    text = {("source", "a"): rows[0][2], ("claim", "e"): rows[4][2]}
    cover = {}
    for r in got:
        cover.setdefault((r.kind, r.rec_id), set()).update(range(r.start_pos, r.end_pos))
    assert set(cover) == set(text)
    for k, t in text.items():
        assert all(i in cover[k] or c.isspace() for i, c in enumerate(t))
    assert sum(r.rec_id == "e" for r in got) == 2000
    assert sentences(df.limit(0), model).count() == 0


def test_runs(spark, model):
    text = " ".join([EN[0], EN[1], DE[0], "Ja.", EN[0]])
    df = spark.createDataFrame([("source", "a", text), ("source", "n", None)], "kind string, rec_id string, text string")
    got = [(r.start_pos, r.end_pos, r.lang) for r in abstract_runs(df, model).orderBy("start_pos").collect()]
    a, b = len(EN[0]) + 1 + len(EN[1]), len(EN[0]) + 1 + len(EN[1]) + 1
    assert got == [(0, a, "en"), (b, b + len(DE[0]) + 4, "de"), (b + len(DE[0]) + 5, len(text), "en")]


def test_title_runs(spark, model):
    rows = [("t1", f"{EN[0]} = {DE[0]}"), ("t2", f"{EN[0]} / {EN[1]}"), ("t3", f"{JA[0]} | {EN[0]}"), ("t4", None), ("t5", "")]
    got = {(r.rec_id, r.start_pos, r.lang) for r in title_runs(spark.createDataFrame(rows, "rec_id string, text string"), model).collect()}
    assert got == {("t1", 0, "en"), ("t1", len(EN[0]) + 3, "de"), ("t2", 0, "en"), ("t3", 0, "ja"), ("t3", len(JA[0]) + 3, "en")}


def test_join_runs_fills_short_parts_and_keeps_rejected_ones():
    parts = [(0, 2), (3, 5), (6, 8)]
    assert [r[:3] for r in join_runs(parts, [None, "en", None], [0, 1, 0])] == [(0, 8, "en")]
    assert [r[:3] for r in join_runs(parts[:1], [None], [0])] == [(0, 2, UNKNOWN)]
    assert [r[:3] for r in join_runs(parts, ["en", UNKNOWN, "en"], [1, 0, 1])] == [(0, 2, "en"), (3, 5, UNKNOWN), (6, 8, "en")]


def test_rejection_reaches_the_rows(spark, model):
    strange = "qxzj wvkk zzqp xxjw kkvq pzzx jqwx vvkz qqxj zwpk"
    far = LanguageModel(model.idf, model.centroids, model.owner, model.languages, np.full(len(model.languages), 0.2))
    df = spark.createDataFrame([("source", "a", f"{EN[0]} {strange.capitalize()}.")], "kind string, rec_id string, text string")
    assert [r.lang for r in abstract_runs(df, far).orderBy("start_pos").collect()] == ["en", UNKNOWN]


@pytest.mark.parametrize("n", [30, 400, 4_000])
def test_quotations_of_any_length_end_no_sentence(n):
    text = "He said “" + "It works. " * n + "Really” and left. Then came another one."
    got = [text[s:e] for s, e in Boundaries({"en": LanguageFacts()}).split(text, ("en",))]
    assert len(got) == 2 and got[1] == "Then came another one."


# --- consensus -----------------------------------------------------------------------------------------------------


def simulated(n=300, seed=1):
    rnd = random.Random(seed)
    labels = ["a", "b", "c"]
    truth = [rnd.choice(labels) for _ in range(n)]
    rows = []
    for i, t in enumerate(truth):
        bad = rnd.choice(labels)
        for r, acc in (("good1", 0.95), ("good2", 0.9), ("good3", 0.85), ("weak", 0.6)):
            rows.append(("f", f"i{i}", r, t if rnd.random() < acc else rnd.choice(labels)))
        for r in ("copy1", "copy2"):
            rows.append(("f", f"i{i}", r, t if i % 2 else bad))
    return truth, rows


def test_dependent_raters_are_found_and_do_not_outvote(spark):
    truth, rows = simulated()
    m = C.ConfusionModel(spark.createDataFrame(rows, "field string, item string, rater string, label string"))
    assert {x for p in m.dependent for x in p} >= {"copy1", "copy2"}
    got = {r.item: r.label for r in m.labels(3).collect()}
    assert np.mean([got[f"i{i}"] == t for i, t in enumerate(truth)]) > 0.9
    rel = {r.rater: r for r in m.reliability().collect()}
    assert rel["good1"].reliability > rel["weak"].reliability and rel["good1"].low < rel["good1"].reliability < rel["good1"].high


def test_joins_give_the_labels_of_the_packed_model(spark):
    _, rows = simulated(80, 3)
    df = spark.createDataFrame([r for r in rows if not r[2].startswith("copy")], "field string, item string, rater string, label string")
    a = {r.item: r.label for r in C.ConfusionModel(df).labels().collect()}
    b = {r.item: r.label for r in C.consensus_by_groups(df, 4).collect()}
    assert np.mean([a[k] == b[k] for k in a]) > 0.95


def test_latest_answers(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("i", "r", "f", "Very Low ", True, t), ("i", "r", "f", "strong", True, t + dt.timedelta(1)), ("i", "r", "f", None, True, t + dt.timedelta(2)), ("i", "r", "f", "low", False, t + dt.timedelta(3)),
            ("i", "r2", "f", " very-low", True, t), ("i", "r3", "f", "  ", True, t), (None, "r", "f", "low", True, t), ("i", "r2", "f", " very-low", True, t)]
    df = spark.createDataFrame(rows, "item_key string, rater string, field string, value string, touched boolean, rated_at timestamp").withColumn("label", F.lit("clash"))
    assert {tuple(r) for r in C.latest_answers(df).collect()} == {("f", "i", "r", "strong"), ("f", "i", "r2", "very_low")}


def test_consensus_of_nothing(spark):
    none = spark.createDataFrame([], "field string, item string, rater string, label string")
    m = C.ConfusionModel(none)
    assert m.labels().count() == 0 and m.reliability().count() == 0 and C.krippendorff_alpha(none).count() == 0


def test_alpha_of_full_agreement(spark):
    rows = [("f", f"i{i}", r, "ab"[i % 2]) for i in range(6) for r in ("x", "y")]
    assert C.krippendorff_alpha(spark.createDataFrame(rows, "field string, item string, rater string, label string")).first().alpha == 1.0


# --- containers ----------------------------------------------------------------------------------------------------


def check_fill(lengths, rows, capacity):
    held, got = {}, {}
    for r in rows:
        got.setdefault(r.key, []).append(r)
        if r.container >= 0:
            held[r.container] = held.get(r.container, 0) + r.n_tokens
    assert all(0 < n <= capacity for n in held.values())
    assert sorted(held) == list(range(len(held)))
    for key, n in lengths:
        own = sorted(got[key], key=lambda r: r.part)
        assert sum(r.n_tokens for r in own) == (n or 0)
        assert len(own) == 1 or n > capacity
        assert [r.start_token for r in own] == [r.part * capacity for r in own]
    return len(held)


def test_containers(spark):
    rnd = random.Random(2)
    lengths = [(i, rnd.choice([5, 5, 5, 30, 61, 64, 99, 100, 101, 250, 0, None, rnd.randrange(1, 100)])) for i in range(700)]
    df = spark.createDataFrame(lengths, "key int, n_tokens long").withColumn("pid", F.lit("clash"))
    filling = fill_containers(df, 100)
    used = check_fill(lengths, filling.items.collect(), 100)
    assert filling.bound <= used == filling.containers <= 1.01 * filling.bound
    assert fill_containers(df.limit(0), 100).items.count() == 0


def test_one_length_only(spark):
    lengths = [(i, 40) for i in range(31)]
    assert check_fill(lengths, fill_containers(spark.createDataFrame(lengths, "key int, n_tokens long"), 100).items.collect(), 100) == 16


def n_containers(counts, capacity):
    sizes = np.array(sorted(counts))
    n = np.array([counts[x] for x in sizes])
    plan = solve_configurations(sizes, n, capacity)
    assert (sum(c * k for c, k in plan.contents) == n).all() and all((c * sizes).sum() <= capacity for c, _ in plan.contents)
    used = sum(k for _, k in plan.contents)
    assert plan.bound <= used + 1e-6
    return used, plan.bound


def test_configurations_cover_exactly():
    n_containers(dict(zip(range(1, 65), range(1, 65), strict=True)), 64)


def test_planted_containers_are_found():
    assert n_containers({682: 1000, 683: 2000}, 2048) == (1000, pytest.approx(1000))
    rnd, planted = random.Random(5), {}
    for _ in range(3000):
        a, b = sorted(rnd.sample(range(1, 2048), 2))
        for x in (a, b - a, 2048 - b):
            planted[x] = planted.get(x, 0) + 1
    used, bound = n_containers(planted, 2048)
    assert used <= 1.02 * 3000 and bound == pytest.approx(3000)


def test_bound_of_large_items():
    used, bound = n_containers({x: 5 for x in range(700, 1500)}, 2048)
    assert used <= 1.01 * bound


def test_knapsack_equals_brute_force():
    sizes, prices = np.array([3, 5, 7]), np.array([4.0, 7.1, 9.9])
    for most in ((9, 9, 9), (2, 1, 9), (1, 4, 0)):
        best = max((a * 4.0 + b * 7.1 + c * 9.9) for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) if 3 * a + 5 * b + 7 * c <= 22)
        copies = knapsack(sizes, prices, np.array(most), 22)
        assert (copies <= most).all() and (copies * sizes).sum() <= 22 and abs((copies * prices).sum() - best) < 1e-9
    for most in ((3, 3, 3), (9, 0, 1), (1, 1, 1)):
        copies = fullest(sizes, np.array(most), 22)
        large = max(k for k in range(3) if most[k] or k == 0)
        best = max(3 * a + 5 * b + 7 * c for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) if 3 * a + 5 * b + 7 * c <= 22 and (a, b, c)[large])
        assert (copies <= most).all() and (copies * sizes).sum() == best or not most[1]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "id int, t string")
    got = {r.key: r.n_tokens for r in token_counts(df, "id", "t").collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0


def test_dependence_is_found_beyond_the_bound_of_the_matrix(spark):
    _, rows = simulated()
    df = spark.createDataFrame(rows, "field string, item string, rater string, label string")
    dense, sparse = C.ConfusionModel(df), C.ConfusionModel(df, paired_raters=0)
    assert dense.dependent == sparse.dependent and dense.dependent
    assert sorted(map(tuple, dense.labels().collect())) == sorted(map(tuple, sparse.labels().collect()))


def test_beta_quantiles():
    assert C.beta_share(1, 1, 0.3) == pytest.approx(0.3) and C.beta_share(2, 2, 0.5) == pytest.approx(0.5)
    assert C.beta_share(2, 1, 0.6) == pytest.approx(0.36)
    q = C.beta_quantile(0.5, (1 / 12) ** 0.5, 0.975)  # the uniform law
    assert q == pytest.approx(0.975, abs=1e-6) and C.beta_quantile(1.0, 0.1, 0.5) == 1.0


def test_sentences_are_the_same_beyond_the_bound_of_sent_facts(spark, sf, model):
    t = table(spark, sf, "sources").where("abstract is not null").groupBy("id").agg(F.max("abstract").alias("text")).select(F.lit("source").alias("kind"), F.col("id").alias("rec_id"), "text")
    near = {tuple(r) for r in sentences(t, model).collect()}
    wide = {tuple(r) for r in sentences(t, model, sent_words=0).collect()}
    assert near == wide and len(near) > 200
    runs = [{tuple(r) for r in abstract_runs(t, model, n).drop("confidence").collect()} for n in (10**6, 0)]
    assert runs[0] == runs[1] and runs[0]
