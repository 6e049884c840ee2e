"""Block tables against exhaustive search over the whole small tables, and leaks against a search at every place."""

from pyspark.sql import functions as F

from strandwise.llm.entities import candidate_pairs
from strandwise.llm.history import one_of_each, repeated_records, signed_records
from strandwise.llm.leakage import CHANGED_SHARE, MIN_WORDS, leaked_items, words_of
from strandwise.llm.records import record, same_publication
from strandwise.session import cut
from strandwise.sources.tables import table

FIELDS = ["id", "title", "authors", "year", "doi"]


def parsed(df):
    return [(r.id, record(r.title, r.authors, r.year, r.doi)) for r in df.collect()]


def test_repeated_publications_equal_an_exhaustive_search(spark, sf):
    old = table(spark, sf, "sources").select(*FIELDS)
    new = table(spark, sf, "source_batch").select(*FIELDS, F.col("harvested_at").alias("at"))
    known = parsed(old.distinct())
    want = set()
    for i, r in parsed(new.orderBy("at")):
        if any(same_publication(r, k) for _, k in known):
            want.add(i)
        known.append((i, r))
    got = {r.id for r in repeated_records(old, new, "source").collect()}
    assert want and len(got & want) >= 0.98 * len(want) and got <= want


def test_candidates_of_two_catalogues_hold_what_an_exhaustive_search_finds(spark, sf):
    never = F.lit(None).cast("timestamp").alias("at")
    a = table(spark, sf, "sources").select(*FIELDS).where("id is not null")
    b = table(spark, sf, "openalex_works").select("id", F.col("display_name").alias("title"), F.col("authorships.author.display_name").alias("authors"), F.col("publication_year").alias("year"), "doi")
    left, right = (cut(signed_records(one_of_each(x.select(*FIELDS, never)), "source", n)) for n, x in enumerate((a, b)))
    pairs = candidate_pairs(right, left).select("rid", "old_rid")
    ids = pairs.join(left.select(F.col("rid").alias("old_rid"), F.col("id").alias("l")), "old_rid").join(right.select("rid", F.col("id").alias("r")), "rid")
    got = {(r.l, r.r) for r in ids.select("l", "r").collect()}
    one, two = parsed(left.select(*FIELDS)), parsed(right.select(*FIELDS))
    want = {(i, j) for i, x in one for j, y in two if same_publication(x, y)}
    assert want and len(want & got) >= 0.98 * len(want)


def holds(doc, item):
    """The item at every place of the document, every stretch of it."""
    for offset in range(-len(item) + MIN_WORDS, len(doc) - MIN_WORDS + 1):
        lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
        wrong = [doc[offset + x] != item[x] for x in range(lo, hi)]
        for a in range(len(wrong) - MIN_WORDS + 1):
            changed = sum(wrong[a : a + MIN_WORDS])
            for b in range(a + MIN_WORDS, len(wrong) + 1):
                if changed * CHANGED_SHARE <= b - a:
                    return True
                changed += b < len(wrong) and wrong[b]
    return False


def test_leaks_equal_a_search_at_every_place(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    got = {tuple(r) for r in leaked_items(docs, items).collect()}
    tests = [(r.item_id, words_of(r.passage or "")) for r in items.collect()]
    want = set()
    for r in docs.collect():
        for v in (0, 1):
            words = words_of(r.text or "", v)
            here = set(words)
            for item, passage in tests:
                # nine tenths of some 18 words must be there
                if (r.doc_id, item) not in want and sum(w in here for w in passage) >= 16 and holds(words, passage):
                    want.add((r.doc_id, item))
    assert got == want
