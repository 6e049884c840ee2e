import random

import pandas as pd

from strandwise.operators.fuzzy import fuzzy_pairs, greedy_keep, similarity


def test_fuzzy_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    stock = ["assessing critical thinking in rural classrooms findings of the lund project", "short title", "ab", "media literacy through games"]
    rows = []
    for i in range(90):
        t = list(rnd.choice(stock))
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.randrange(len(t) + 1)
            if rnd.random() < 0.5 and t:
                del t[min(p, len(t) - 1)]
            else:
                t.insert(p, rnd.choice("abc "))
        rows.append((i, "".join(t), rnd.choice([2000, 2001, 2004, None])))
    rows += [(100, None, 2000), (101, "", 2000)]
    heads = {}
    for i, t, y in rows:
        heads.setdefault((t, y), i)
    want = set()
    for (t, y), i in heads.items():
        for (u, z), j in heads.items():
            if i < j and t and u and (y is None or z is None or abs(y - z) <= 1) and similarity(u, t) >= 0.92:
                want.add((i, j))
    want |= {(heads[t, y], i) for i, t, y in rows if t and heads[t, y] != i}
    got = {(r.id_a, r.id_b) for r in fuzzy_pairs(spark.createDataFrame(rows, "id int, key string, year int")).collect()}
    assert got == want


def test_greedy_keeps_what_the_sequence_keeps(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)]
    order = list(range(40))
    rnd.shuffle(order)
    rank = {n: i for i, n in enumerate(order)}
    kept = set()
    for n in order:
        if not any((n == a and b in kept) or (n == b and a in kept) for a, b in edges if a != b):
            kept.add(n)
    nodes = spark.createDataFrame([(n, rank[n]) for n in order], "node int, ord int")
    got = {r.node for r in greedy_keep(nodes, spark.createDataFrame(edges, "a int, b int")).collect() if r.kept}
    assert got == kept
    assert greedy_keep(nodes, spark.createDataFrame([], "a int, b int")).where("not kept").count() == 0


def test_blocks_of_a_cell_meet_once_and_nothing_else_is_shuffled(spark, monkeypatch):
    from strandwise.operators import fuzzy

    monkeypatch.setattr(fuzzy, "_BLOCK", 7)
    rnd = random.Random(9)
    rows = []
    for i in range(80):
        t = list("teaching media literacy in the schools of the north")
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice("abc ")
        low = rnd.choice([2000, 2001, 2003, -100_000_000])
        rows.append((i, "".join(t), low, 100_000_000 if low < 0 else low + rnd.randrange(2)))
    df = spark.createDataFrame(rows, "id long, key string, low int, high int")
    fit = [(x, y) for x in rows for y in rows if x[0] != y[0] and x[2] <= y[3] + 1 and y[2] <= x[3] + 1]
    want = {(x[0], y[0]) for x, y in fit if similarity(x[1], y[1]) >= 0.92}
    got = [(r.x, r.y) for r in fuzzy._near(df, df, 0.92, 1).collect()]
    assert want and want <= set(got) and len(got) == len(set(got))
    # far fewer than all pairs, and each of them once in one order
    one = [(r.x, r.y) for r in fuzzy._near(df, df, 0.92, 1, shorter=True).collect()]
    assert {frozenset(p) for p in got} == {frozenset(p) for p in one} and len(one) == len({frozenset(p) for p in one})


def test_asked_titles_meet_all_known_ones(spark, monkeypatch):
    from strandwise.operators import fuzzy

    monkeypatch.setattr(fuzzy, "_BLOCK", 5)
    known = spark.createDataFrame([(i, f"reading aloud in school number {i:02d} of the north", 2000 + i % 3, 2000 + i % 3) for i in range(40)], "id long, key string, low int, high int")
    asked = known.where("id % 8 = 0")
    got = [(r.x, r.y) for r in fuzzy._near(asked, known, 0.92, 1).collect()]
    assert sorted(got) == sorted((x, y) for x in range(0, 40, 8) for y in range(40) if x != y and abs(x % 3 - y % 3) <= 1)


def test_one_known_title_decides(monkeypatch):
    from strandwise.operators import fuzzy

    known = [f"teaching media literacy across the curriculum evidence from the schools of north town {i:03d}" for i in range(300)]
    asked = ["teaching media literacy across the curriculum evidence from the schools of north town 4x5", "something else"]
    calls = []
    monkeypatch.setattr(fuzzy, "similarity", lambda a, b: calls.append(a) or similarity(a, b))

    def side(keys, new):
        return pd.DataFrame({"id": range(len(keys)), "key": keys, "low": 2000, "high": 2000, "bits": fuzzy._sketch(keys), "new": new})

    left, right = side(asked, True), side(known, False)
    assert fuzzy._any(0.92, 1)((0, 2000, 0, 0), left, right)["id"].tolist() == [0] and len(calls) == 1
    both = pd.concat([left, right.assign(id=right["id"] + 10)]).sort_values("key", ignore_index=True)
    assert [x for out in fuzzy._beside(0.92, 1)(iter([both])) for x in out["id"]] == [0] and len(calls) == 2


def test_known_titles_repeat_as_by_brute_force(spark, monkeypatch):
    from strandwise.operators import fuzzy

    monkeypatch.setattr(fuzzy, "_BLOCK", 7)
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        t = list(rnd.choice(["assessing critical thinking in rural classrooms findings of the lund project", "media literacy through games in upper schools"]))
        for _ in range(rnd.randrange(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice("abc ")
        key, year = "".join(t), rnd.choice([2000, 2001, 2003, None])
        rows.append((f"{key}::{year}", key, year))
    rows += [("::2000", "", 2000), ("::None", None, None)]
    old, new = rows[:40] + rows[-2:], rows[40:]
    fit = lambda a, b: a is None or b is None or abs(a - b) <= 1
    want = {k for k, t, y in new if t and any(u and fit(y, z) and similarity(t, u) >= 0.92 for _, u, z in old)}
    known, fresh = [spark.createDataFrame(x, "title_key string, key string, year int") for x in (old, new)]
    got = [r.title_key for r in fuzzy._repeated(known, fresh, 0.92, 1).collect()]
    assert 0 < len(want) < len(new) and sorted(got) == sorted(want)


def test_titles_are_normalised_once(spark, sf):
    from strandwise.plans.textual import _records

    # the keys are read, not made again in each of the steps that look at them
    assert "regexp" not in _records(spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
