import random

from ruamesh.llm import leakage as K
from ruamesh.llm import tokens as T

BIG = 2**53 + 1


def test_encode_keeps_null_keys(spark):
    enc, rng = T.encoding(f"{T.FOLDER}/{T.VOCABULARY}"), random.Random(4)
    long = " ".join(rng.choice(["rua", "don't", "1999", "ação"]) for _ in range(3000))
    rows = [(None, long), (None, long), (None, long + "x"), (None, "Rua"), (BIG, long), (BIG, "a"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    order = lambda r: (r[0] or 0, r[1])
    got = sorted(((r["doc_id"], list(r["ids"])) for r in T.encode(docs).collect()), key=order)
    assert got == sorted(((k, enc.encode_ordinary(t) if t else []) for k, t in rows), key=order)


def test_leaks_keep_null_keys(spark):
    text = " ".join(f"palavra{k}" for k in range(20))
    docs = spark.createDataFrame([(None, f"antes {text} depois"), (BIG, text), (2, "nada")], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(None, text), (BIG, text + " fim")], "item_id bigint, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"], r["longest"]) for r in K.leaks(docs, items).collect()}
    assert got == {(None, None, 20), (None, BIG, 20), (BIG, None, 20), (BIG, BIG, 20)}
