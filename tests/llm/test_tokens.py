import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ruamesh.llm import tokens as T

ENC = T.encoding(f"{T.FOLDER}/{T.VOCABULARY}")


def by_tree(text, most, window=2):
    nodes = [(p, *T.encode_part(ENC, p)) for p in T.halves(text, most)]
    while len(nodes) > 1:
        nodes = [T.merge(ENC, *nodes[k : k + 2], window) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '’\n\t .,1ç日'rtvelm<|>", min_size=1, max_size=60), st.integers(1, 20))
def test_tree_equals_whole(text, most):
    got, whole = by_tree(text, most), T.encode_part(ENC, text)
    assert got[1] == ENC.encode_ordinary(text) and got[2:] == (whole[1], whole[2])


def test_long_runs_without_a_break():
    for text in ("a" * 3000, " " * 999 + "b", "'re" * 500, "\n \n" * 400, "x y" * 1000):
        assert by_tree(text, 64)[1] == ENC.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="etaoinbcé日", min_size=1, max_size=300), st.integers(1, 20), st.integers(1, 4))
def test_one_unbroken_run(text, most, first):
    ids = [ENC.encode_ordinary(p) for p in T.halves(text, most)]
    got = ids[0]
    for more in ids[1:]:
        got = T.join_ids(ENC, got, more, first)
    assert by_tree(text, most)[1] == got == ENC.encode_ordinary(text)


def test_a_million_letters_cost_hardly_more_than_their_length():
    class Counted:
        cost = 0

        def __getattr__(self, name):
            return getattr(ENC, name)

        def _encode_single_piece(self, piece):
            Counted.cost += len(piece)
            return ENC._encode_single_piece(piece)

        def encode_ordinary(self, text):
            Counted.cost += len(text)
            return ENC.encode_ordinary(text)

    rng, enc = random.Random(8), Counted()
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    nodes = [(p, *T.encode_part(enc, p)) for p in T.halves(text, T.SPLIT_CHARS)]
    while len(nodes) > 1:
        nodes = [T.merge(enc, *nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    assert nodes[0][1] == ENC.encode_ordinary(text) and Counted.cost < 1.5 * len(text)


def test_operator(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["rua", "don't", "1999", "ação", "\n\n", "<|endoftext|>"]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, "Rua<|endoftext|>"), (4, long), (4, long), (5, long[:300]), (6, long + "x"), (3, "Rua<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in T.encode(docs, split_chars=500).collect())
    assert got == sorted((k, ENC.encode_ordinary(t) if t else []) for k, t in rows)


def test_empty(spark):
    assert T.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
