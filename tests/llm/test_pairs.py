"""Leakage, shared spans, history deduplication and entity matching."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm.entities import match_entities
from strandwise.llm.fingerprints import BITS, WORDS as PRINT_WORDS, Signer, packed
from strandwise.llm.history import accept_batch, new_store, repeated_records
from strandwise.llm.leakage import MASKS, MIN_WORDS, hashes_of, leaked_items, words_of
from strandwise.llm.leakage import holds as holds_hashes
from strandwise.llm.records import author_key, doi_key, finding, record, residue, same_publication, slip
from strandwise.llm.spans import shared_share, shared_spans

WORDS = [f"w{i}x{chr(97 + i % 26)}" for i in range(400)]


# --- leakage -------------------------------------------------------------------------------------------------------


def test_masks_hit_every_allowed_pattern_of_changes():
    rnd = random.Random(0)
    for _ in range(3000):
        n = rnd.choice([18, 19, 20, 21, 25, 29, 30, 31, 39, 40, 55, 90])
        wrong = set(rnd.sample(range(n), n // 10))
        ok = [i not in wrong for i in range(n)]
        assert any(all(ok[p + k] for k, c in enumerate(m) if c == "1") for m in MASKS for p in range(n - len(m) + 1)), sorted(wrong)


def holds(doc, item, offset):
    return holds_hashes(hashes_of(' '.join(doc)), hashes_of(' '.join(item)), offset)


def test_holds_counts_changes_against_length():
    item = WORDS[:40]
    doc = WORDS[300:310] + item[:18] + WORDS[310:320]
    assert holds(doc, item, 10)
    doc[15] = "other"
    assert holds(doc, item, 10)
    doc[20] = "other"
    assert not holds(doc, item, 10)
    assert not holds(item[:17], item, 0)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item long")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, passage string, text string")


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_in_all_renderings(spark, sent):
    passage = " ".join(WORDS[:30])
    k = WORDS[:30]
    changed = " ".join(["zz" if i in (5, 15, 25) else w for i, w in enumerate(k)])
    broken = passage.replace("w7x", "w7-\nx").replace("w9xj", "w9\nxj")
    corpus = docs(spark, [
        (1, "intro " + passage.upper(), 0), (2, f"> **{changed}**", 0), (3, " ".join(k[3:21]), 0), (4, " ".join(k[3:20]), 0), (5, None, 0), (6, "", 0),
        (12, "<p style='" + "x: y; " * 40 + f"'>{passage}", 0), (7, broken, 0), (8, " ".join(["zz" if i % 6 == 2 else w for i, w in enumerate(k)]), 0), (9, "filler " * 30_000 + passage, 0), (1, "intro " + passage.upper(), 0)])
    tests = items(spark, [(10, passage, "x"), (10, passage, "x"), (11, None, "x"), (12, "too short", "x")])
    got = {tuple(r) for r in leaked_items(corpus, tests, sent_seeds=sent).collect()}
    assert got == {(d, 10) for d in (1, 2, 3, 7, 9, 12)}


def test_leaks_of_empty_tables(spark):
    assert leaked_items(docs(spark, []), items(spark, [(1, " ".join(WORDS[:20]), "")])).count() == 0
    assert leaked_items(docs(spark, [(1, "a", 0)]), items(spark, [])).count() == 0


def test_words_fold_accents_and_spelling_out():
    assert words_of("Köln Koeln Koln <b>straße</b> &amp; 東京") == ["koln", "koln", "koln", "strasse", "東", "京"]
    assert MIN_WORDS == 18


# --- shared spans --------------------------------------------------------------------------------------------------


def brute_spans(rows, length):
    holders = {}
    for d, t in rows:
        for p in range(len(t or "") - length + 1):
            holders.setdefault(t[p : p + length], set()).add(d)
    out = set()
    for d, t in rows:
        cur = None
        for p in range(len(t or "") - length + 1):
            if len(holders[t[p : p + length]]) > 1:
                if cur and p <= cur[1]:
                    cur[1] = p + length
                else:
                    if cur:
                        out.add((d, *cur))
                    cur = [p, p + length]
        if cur:
            out.add((d, *cur))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_spans_equal_brute_force(spark, seed):
    rnd = random.Random(seed)

    def sentence():
        return "".join(rnd.choice("abcdé 日") for _ in range(rnd.randrange(1, 18))) + rnd.choice([". ", "! ", "。", "\n", "", "? "])

    stock = ["".join(sentence() for _ in range(rnd.randrange(3, 9))) for _ in range(6)]
    rows = []
    for d in range(24):
        text = "".join(rnd.choice([sentence(), rnd.choice(stock), rnd.choice(stock)[rnd.randrange(9) :]]) for _ in range(rnd.randrange(1, 7)))
        rows.append((d, text))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "x" * 200), (104, "x" * 190)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start_pos", F.lit(7)).withColumn("doc", F.lit("clash"))
    assert {tuple(r) for r in shared_spans(df, length=40).collect()} == brute_spans(rows, 40)


def test_spans_kept_once_and_shares(spark):
    t = "Some sentence that repeats. " * 3 + "And ends here."
    df = spark.createDataFrame([(1, t), (2, t), (3, "other"), (4, None), (5, "")], "doc_id int, text string")
    assert {tuple(r) for r in shared_spans(df, length=50, later_only=True).collect()} == {(2, 0, len(t))}
    got = {r.doc: (r.n_shared, r.shared_share) for r in shared_share(df, length=50).collect()}
    assert got[1] == (len(t), 1.0) and got[3] == (0, 0.0) and got[5] == (0, None) and got[4][0] == 0


def test_spans_of_an_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id int, text string")).count() == 0


# --- records -------------------------------------------------------------------------------------------------------


def rec(title, authors=("Ada Lovelace",), year=2020, doi=None):
    return record(title, authors, year, doi)


LONG = "Assessing critical thinking in rural classrooms: findings of the Lund project"


def test_same_publication_rules():
    same = [
        rec(LONG.upper()), rec("findings of the Lund project – Assessing critical thinking in rural classrooms"), rec("Assessing critical thinking in rural classrooms"),
        rec("Assessing critical thinking in rural classrooms: find…"), rec("Asessing critical thinkng in rural classrooms: findings of the Lund project"), rec(LONG, year=2021),
        rec(LONG, ("LOVELACE Ada",)), rec(LONG, ("Lovelace, A.", "et al.")), rec(f"[{LONG}] &mdash; full text"), rec(LONG + " = Ein anderer Titel in deutscher Sprache"), rec(LONG, year=None)]
    other = [
        rec(LONG + ", part 2"), rec("Assessing critical thinking in rural classrooms: findings of the Umea project"), rec(LONG, year=2017), rec(LONG, ("Grace Hopper",)), rec(None), rec("", ())]
    assert all(same_publication(x, rec(LONG)) for x in same)
    assert not any(same_publication(x, rec(LONG)) for x in other)
    assert not same_publication(rec("Quite another thing in many more words", doi="10.1234/a"), rec(LONG, doi="10.1234/a"))
    assert same_publication(rec(None, doi="doi:10.1234/A."), rec(LONG, doi="https://doi.example/10.1234%2Fa"))
    assert not same_publication(rec("Book reviews", ("A B",)), rec("Book reviews", ("C D",)))


def test_identifiers_and_names():
    assert doi_key(" DOI 10.1234/ AB.1. ") == "10.1234/ab.1" and doi_key(None) is None and doi_key("none") is None
    assert author_key("Núñez, Ana") == author_key("A. Nunez") == author_key("NÚÑEZ Ana") == author_key("Ana Núñez") == ("nunez", "a")
    assert author_key("et al.") is None and author_key("  ") is None


def test_remarks_of_any_length_and_mark_up_drop_out():
    assert same_publication(rec(f"<i>{LONG}</i>"), rec(LONG))
    assert same_publication(rec(LONG + " " + "– " * 60 + "(accepted manuscript)"), rec(LONG))


def test_whole_statements_are_read():
    base = "Older pupils in Lund improved reading (81%, n = 292). The effect vanished after a year."
    f, g = finding(base), finding(base.replace("vanished", "doubled"))
    assert f.figures == ("292", "81") and "vanished" in f.words and residue(f.words, g.words).left == ("vanished",)
    assert finding("In Lund: n=292, 81 Prozent") == finding("in lund n = 292; 81 %")


def test_residues():
    a = "at the end pupils in lund improved reading".split()
    assert not residue(tuple(a), tuple(a[3:] + a[:3]))
    r = residue(tuple(["the", "study", "finds", *a]), tuple(a))
    assert r.lead == ("the", "study", "finds") and not r.left and not r.right and not r.tail
    r = residue(tuple([*a, "they", "say"]), tuple(a))
    assert r.tail == ("they", "say")
    r = residue(("in", "lund", "zeigten", "teams"), ("teams", "aus", "lund", "zeigten"))
    assert (r.lead, r.left, r.right) == ((), ("in",), ("aus",))


def test_slips_of_the_pen():
    assert slip("hte", "the") and slip("ed", "end") and slip("workirg", "working") and slip("custion", "cuestion")
    assert not slip("low", "high") and not slip("京都", "東京") and not slip("up", "off")


PLACES = [f"{a}{b}" for a in ("Lund", "Oslo", "Visby", "Turku", "Bergen") for b in ("mark", "vik", "dorp", "ford", "ona", "eux", "sted", "holm")]


def claims(n, word="pupils", act="improved", place=0, frame=""):
    return [f"{frame}Older {word} in {PLACES[(i + place) % 40]} {act} critical thinking at the end of the unit ({i % 90}%, n = {100 + i})." for i in range(n)]


def as_claims(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, at) for i, t, at in rows], "id string, title string, authors array<string>, year int, doi string, at timestamp")


def test_wordings_are_learned_and_details_are_not(spark):
    old = [(f"c{i}", t, None) for i, t in enumerate(claims(300))]
    new = [(f"w{i}", t, None) for i, t in enumerate(claims(4, "students"))]  # a word the history never uses, in place of one
    new += [(f"f{i}", t, None) for i, t in enumerate(claims(4, frame="Surveys suggest: "))]
    new += [(f"d{i}", t, None) for i, t in enumerate(claims(12, place=7))]  # another place each time
    new += [("neg", claims(1)[0].replace("improved", "did not improve"), None), ("typo", claims(2)[1].replace("thinking", "thniking"), None), ("rare", claims(6, "novices")[5], None)]
    old += [(f"n{i}", f"Teachers did not use tools in {p} (n = {900 + i}).", None) for i, p in enumerate(PLACES)]
    batch = [(i, t, day(k)) for k, (i, t, _) in enumerate(new)]
    got = {tuple(r) for r in repeated_records(as_claims(spark, old).drop("at"), as_claims(spark, batch), "claim").collect()}
    assert got == {(f"{x}{i}", f"c{i}") for x in "wf" for i in range(4)} | {("typo", "c1")}


def test_stored_history_is_not_read_again(spark, tmp_path):
    """The second batch is served by the store alone: the tables of the history are gone by then."""
    import shutil

    rows = [(f"c{i}", t, None) for i, t in enumerate(claims(50))]
    as_claims(spark, rows + rows[:5]).write.parquet(str(tmp_path / "old"))
    store = new_store(spark, "claim")
    store.append(spark.read.parquet(str(tmp_path / "old")))
    shutil.rmtree(tmp_path / "old")
    first = [("a1", claims(1)[0].upper(), day(1)), ("a2", claims(60)[59], day(2)), ("a3", None, day(3))]
    assert {tuple(r) for r in accept_batch(store, as_claims(spark, first)).collect()} == {("a1", "c0")}
    second = [("b1", claims(60)[59] + " ", day(4)), ("b2", claims(3)[2], day(5)), ("b3", claims(61)[60], day(6)), ("b4", claims(61)[60], day(7))]
    assert {tuple(r) for r in accept_batch(store, as_claims(spark, second)).collect()} == {("b1", "a2"), ("b2", "c2"), ("b4", "b3")}
    assert accept_batch(store, as_claims(spark, [])).count() == 0
    store.drop()


def test_a_hot_statement_and_a_hot_doi(spark):
    a = ["Ada Lovelace"]
    old = [(f"h{i:03}", LONG, a, 2020, "10.1234/hot") for i in range(200)] + [(f"o{i:03}", f"Quite another work on {p} and its many schools", [f"Bo {p}"], 2019, "10.1234/hot") for i, p in enumerate(PLACES)]
    new = [("b1", LONG.upper(), a, 2020, None, day(1)), ("b2", "Quite another work on Lundmark and its many schools", ["Lundmark, B."], None, "10.1234/HOT", day(2)), ("b3", None, ["B. Oslovik"], None, "10.1234/hot", day(3))]
    assert history(spark, old, new) == {("b1", "h000"), ("b2", "o000"), ("b3", "o009")}


def test_records_with_a_doi_alone_meet_all_others(spark):
    a = ["Ada Lovelace"]
    rich, poor = (LONG, a, 2020, "10.1234/x"), (None, None, None, "https://doi.example/10.1234/X")
    assert history(spark, [("s1", *rich)], [("b1", *poor, day(1))]) == {("b1", "s1")} == history(spark, [("s1", *poor)], [("b1", *rich, day(1))])
    other = ("Quite another work on media and its many schools", ["Bo Lund"], 2020, "10.1234/x")
    assert history(spark, [("s1", *rich)], [("b1", *other, day(1)), ("b2", *rich, day(2))]) == {("b2", "s1")}


def test_more_than_eight_authors_sign(spark):
    who = [f"Ann {p}" for p in PLACES[:12]]
    assert history(spark, [("s1", LONG, who, 2020, None)], [("b1", LONG[:50] + "…", who[::-1], 2020, None, day(1))]) == {("b1", "s1")}


def history(spark, old, new, kind="source"):
    s = "id string, title string, authors array<string>, year int, doi string, score string"
    a = spark.createDataFrame([(*x, "clash") for x in old], s)
    b = spark.createDataFrame([(*x[:-1], "clash", x[-1]) for x in new], s + ", at timestamp")
    return {tuple(r) for r in repeated_records(a, b, kind).collect()}


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_batches_against_history_and_each_other(spark):
    a = ["Ada Lovelace"]
    new_title = "Teaching systems thinking beyond the classroom: lessons from the Oslo schools"
    old = [("s1", LONG, a, 2020, None), ("s1", LONG, a, 2020, None), ("s2", None, None, None, "10.1234/x"), ("s3", None, None, None, None)]
    new = [
        ("b1", LONG.lower(), a, 2020, None, day(1)), ("b2", new_title, a, 2021, None, day(2)), ("b3", new_title.upper(), a, 2021, None, day(3)), ("b4", new_title.upper(), a, 2021, None, day(4)),
        ("b5", None, None, None, "doi:10.1234/X", day(5)), ("b6", None, None, None, None, day(6)), ("b7", LONG + ", part 3", a, 2020, None, day(7)), ("b8", "", [], None, None, day(8))]
    assert history(spark, old, new) == {("b1", "s1"), ("b3", "b2"), ("b4", "b2"), ("b5", "s2")}


def test_history_of_claims_and_empty_tables(spark):
    f = "Older pupils in Lund improved critical thinking at the end of the unit (81%, n = 292)."
    row = lambda i, t: (i, t, None, None, None)
    assert history(spark, [row("c1", f), row("c2", None)], [(*row("n1", f"“{f}”"), day(1)), (*row("n2", None), day(2))], "claim") == {("n1", "c1")}
    assert history(spark, [], [], "claim") == set()
    assert history(spark, [], [(*row("n1", f), day(1)), (*row("n2", f), day(2))], "claim") == {("n2", "n1")}


def test_fingerprints_are_close_for_close_texts():
    words = [(w, 1.0) for w in LONG.lower().split()]
    bits = Signer().sign([words, words[:-1] + [("projct", 1.0)], [("entirely", 1.0), ("different", 1.0)], []])
    assert bits.shape == (4, BITS) and (bits[0] ^ bits[1]).sum() < 0.15 * BITS < 0.3 * BITS < (bits[0] ^ bits[2]).sum()
    assert packed(bits).shape == (4, PRINT_WORDS)


def test_entities_one_left_record_for_each_right(spark):
    rnd = random.Random(4)
    names = [f"{a} {b}" for a in ("Ada", "Bo", "Cy") for b in ("Lund", "Berg", "Holm", "Dahl", "Strand")]
    topics = ["critical thinking", "media literacy", "resilience", "data literacy", "collaboration"]
    left, right = [], []
    for i in range(60):
        title = f"Assessing {topics[i % 5]} in school number{i}ville: findings of the Place{i % 7}burg project"
        who = rnd.sample(names, 2)
        left.append((f"s{i}", title, who, 2000 + i % 20, f"10.1234/x{i}" if i % 2 else None))
        if i % 3 == 0:
            right.append((f"w{i}", title.upper(), [f"{n.split()[1]}, {n[0]}." for n in who], 2000 + i % 20, None))
        if i % 3 == 1:
            right.append((f"w{i}", title + ", part 2", who, 2000 + i % 20, f"10.9999/y{i}"))
    right += [("n1", None, None, None, None), ("n1", None, None, None, None)]
    schema = "id string, title string, authors array<string>, year int, doi string"
    a, b = spark.createDataFrame(left, schema).withColumn("p", F.lit(1)), spark.createDataFrame(right, schema).withColumn("odds", F.lit(1))
    found = match_entities(a, b).collect()
    assert {(r.left_id, r.right_id) for r in found if r.p > 0.5} == {(f"s{i}", f"w{i}") for i in range(0, 60, 3)}
    assert match_entities(a.limit(0), b).count() == 0


def test_a_look_up_keeps_no_buckets_and_blocks_are_stored_without_dictionaries(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from strandwise.llm import history as module

    kept, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: kept.append(set(df.columns)) or real(df))
    store = new_store(spark, "claim")
    store.append(as_claims(spark, [(f"c{i}", t, None) for i, t in enumerate(claims(40))]))
    assert {tuple(r) for r in accept_batch(store, as_claims(spark, [("a1", claims(3)[2].upper(), day(1))])).collect()} == {("a1", "c2")}
    # neither the block table of the batch nor the records that were hit are written again
    assert kept and not any("key" in c for c in kept) and sum("views" in c for c in kept) == 1
    files = glob.glob(f"{store.path.removeprefix('file:')}/blocks/n=0/part=*/*.parquet")
    columns = pq.ParquetFile(files[0]).metadata.row_group(0)
    assert files and not any("DICTIONARY" in e for n in range(columns.num_columns) for e in columns.column(n).encodings)
    store.drop()


def test_records_of_many_views_meet(spark):
    title = " = ".join(f"{w} of teaching in the schools of {p}" for w, p in zip("Notes Forms Roots Hopes Signs Tales Costs Gains Turns Links".split(), PLACES, strict=False))
    assert history(spark, [("s1", title, ["Ada Lovelace"], 2020, None)], [("b1", title.split(" = ")[-1], ["Lovelace, A."], 2020, None, day(1))]) == {("b1", "s1")}
