import random

from strandwise.operators.fuzzy import keep_new, record_pairs, similarity


def _catalogue(seed=11):
    rnd = random.Random(seed)
    stock = ["assessing critical thinking in rural classrooms findings of the lund project", "media literacy through games in upper schools", "short title"]
    rows = []
    for i in range(70):
        t = list(rnd.choice(stock))
        for _ in range(rnd.randrange(0, 7)):
            p = rnd.randrange(len(t))
            t[p : p + rnd.randrange(2)] = rnd.choice(["", "a", "b ", "c"])
        key, year = " ".join("".join(t).split()) if i % 17 else "", rnd.choice([2000, 2001, 2004, None])
        rows.append((i, i, f"doi:{rnd.randrange(60)}" if rnd.random() < 0.7 else f"url:{i}", f"{key}::{year}", key, year))
    return rows


def _same(a, b):  # b is the earlier one
    return (a[4] and b[4] and similarity(a[4], b[4]) >= 0.92) and (a[5] is None or b[5] is None or abs(a[5] - b[5]) <= 1)


_SCHEMA = "id int, ord int, identity string, title_key string, key string, year int"


def test_new_records_are_held_against_history_and_keys(spark):
    rows = _catalogue()
    old, new = rows[:25], rows[25:]
    known, keys, kept = list(old), {k for r in old for k in (r[2], r[3])}, set()
    for r in new:
        if not (r[2] in keys or r[3] in keys or any(_same(r, o) for o in known)):
            kept.add(r[0])
            known.append(r)
            keys |= {r[2], r[3]}
    assert 0 < len(kept) < len(new)
    got = {r.id for r in keep_new(spark.createDataFrame(old, _SCHEMA), spark.createDataFrame(new, _SCHEMA)).collect() if r.kept}
    assert got == kept


def test_record_pairs_are_those_of_all_records(spark):
    rows = _catalogue(12)
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if _same(a, b) and not {a[2], a[3]} & {b[2], b[3]}}
    got = record_pairs(spark.createDataFrame(rows, _SCHEMA)).collect()
    assert want and {(r.id_a, r.id_b) for r in got if not r.exact_key} == want


def test_batches_are_compared_with_sources(spark, sf):
    from strandwise.plans.textual import q_fuzzy_pairs, q_greedy_dedup

    old = {r.id for r in spark.read.parquet(f"{sf}/sources.parquet").select("id").collect()}
    assert any((r.id_a in old) != (r.id_b in old) for r in q_fuzzy_pairs(spark, sf).collect())
    urls = {r.url.lower() for r in spark.read.parquet(f"{sf}/sources.parquet").where("doi is null and eric_id is null and url is not null").collect()}
    kept = {r.node for r in q_greedy_dedup(spark, sf).collect() if r.kept}
    assert not [r for r in spark.read.parquet(f"{sf}/source_batch.parquet").where("doi is null and url is not null").collect() if r.id in kept and r.url.lower() in urls]
