import datetime as dt
import random

from ruamesh.operators.orphans import orphans

REFS, PARENTS = "ref bigint, id bigint, at timestamp", "key bigint, a timestamp, b timestamp"


def found(spark, refs, parents, deleted="b"):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    return {(x["row_key"], x["at"]) for x in orphans(r, "ref", "id", "at", p, "key", "a", deleted).collect()}


def test_against_brute_force(spark):
    rng, day = random.Random(3), lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(days=n)
    parents = [(rng.randrange(60), day(a := rng.randrange(100)), day(a + rng.randrange(1, 60)) if rng.random() < 0.5 else None) for _ in range(150)]
    # A third of all references have one key.
    refs = [(7 if rng.random() < 0.33 else rng.randrange(90) if rng.random() < 0.95 else None, i, day(rng.randrange(150))) for i in range(3000)]
    want = {(i, t) for k, i, t in refs if k is not None and not any(q == k and a <= t and (b is None or b > t) for q, a, b in parents)}
    assert found(spark, refs, parents) == want
    want = {(i, t) for k, i, t in refs if k is not None and not any(q == k and a <= t for q, a, b in parents)}
    assert found(spark, refs, parents, None) == want


def test_edges_of_time(spark):
    t = dt.datetime(2023, 5, 5, 12)
    late = t + dt.timedelta(seconds=1)
    assert found(spark, [(1, 1, t), (2, 2, t), (3, 3, t), (4, 4, None), (5, 5, None)], [(1, t, None), (2, late, None), (3, dt.datetime(2020, 1, 1), t), (4, t, None)]) == {(2, t), (3, t), (5, None)}


def test_empty_sides_and_repeats(spark):
    t = dt.datetime(2023, 5, 5)
    assert found(spark, [(1, 1, t), (1, 1, t)], []) == {(1, t)}
    assert found(spark, [], [(1, t, None)]) == set()


def test_filters_beyond_one_broadcast(spark):
    from ruamesh.operators import orphans as O

    keys, refs = spark.range(20_000).selectExpr("id * 3 AS key"), spark.range(60_000).selectExpr("id AS ref")
    one, many = (O.probe(refs, "ref", keys, "key", 20_000, most).filter("_rm_maybe").select("ref").collect() for most in (O.MAX_WORDS, 1024))
    for got in (one, many):
        got = {r["ref"] for r in got}
        assert {k * 3 for k in range(20_000)} <= got and len(got) < 22_000


def test_more_keys_get_more_words():
    from ruamesh.operators.orphans import filter_words

    assert [filter_words(n) for n in (0, 64, 65, 10**7)] == [16, 16, 32, 1 << 22]
