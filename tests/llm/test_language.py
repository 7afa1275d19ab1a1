import os

import pytest

from ruamesh.llm import language as L

DATA = "/root/testdata/sf0.001/lang_samples.parquet"
PT = "A rua ficou interditada ontem e os ônibus tiveram de subir pela avenida."
EN = "The street was closed yesterday and the buses had to go up the avenue."
ES = "La calle quedó cortada ayer y los autobuses tuvieron que subir por la avenida."
FR = "La rue a été fermée hier et les autobus ont dû monter par l'avenue."
SAMPLES = [
    ("pt", PT), ("pt", "Moradores pedem que a equipe reveja o nome da rua porque a calçada acaba."), ("pt", "Foram contados muitos pedestres na manhã de domingo, quase o dobro do esperado."),
    ("en", EN), ("en", "Residents want the board to review the name of the road because the pavement ends."), ("en", "We counted many pedestrians on the morning, almost twice what was expected."),
    ("es", ES), ("es", "Los vecinos piden que el consejo corrija el nombre de la calle porque la acera termina."), ("es", "Se contaron muchos peatones por la mañana, casi el doble de lo previsto."),
    ("fr", FR), ("fr", "Les habitants demandent que le conseil corrige le nom de la rue car le trottoir finit."), ("fr", "On a compté beaucoup de piétons le matin, presque le double de ce qui était prévu."),
]


def test_labels():
    assert [L.label_language(x) for x in ("PT", "pt-BR", "pt_br", "Português", "por", "EN", "en_GB", "inglês", "Fre", "español", "es_UY")] == ["pt"] * 5 + ["en"] * 3 + ["fr", "es", "es"]
    assert [L.label_language(x) for x in (None, "", " ", "??", "xx", "und", "unknown")] == [None] * 7


def test_sentences():
    assert L.sentences("A Av. Luísa caiu. R. José abriu!\n\nFim") == ["A Av. Luísa caiu.", " R. José abriu!\n\n", "Fim"]
    assert L.sentences("") == L.sentences(" ...! 12 ") == L.sentences("<|endoftext|>") == L.sentences('{"u": 1}') == []
    assert "".join(L.sentences("Um. 123. Dois.")) == "Um. 123. Dois."


def test_quotations_and_names_are_no_evidence():
    assert "feira" not in L.evidence('Locals call it "a esquina da feira" and Rua Tristeza although they go.')
    assert "tristeza" not in L.evidence("They walk along Rua Tristeza every day.")


def run(spark, docs, samples=SAMPLES):
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id bigint, text string, lang string, seg int")
    s = spark.createDataFrame(samples, "lang string, text string")
    return [r.asDict() for r in L.languages(d, s).collect()]


def test_documents_and_segments(spark):
    docs = [(1, PT, "en"), (2, f"{PT} {PT}\n\n{EN} {FR}", "pt-BR"), (3, None, "pt"), (4, "", None), (5, " 12 ½ !", None), (6, ES, None), (7, (EN + " ") * 400, "English"), (8, FR.upper(), "??")]
    rows = run(spark, docs)
    main = {r["doc_id"]: (r["lang"], r["named"], r["n_runs"]) for r in rows if r["seg"] == 0}
    assert main == {1: ("pt", "en", 1), 2: ("pt", "pt", 3), 6: ("es", None, 1), 7: ("en", "en", 1), 8: ("fr", None, 1)}
    assert [r["lang"] for r in sorted(rows, key=lambda r: r["seg"]) if r["doc_id"] == 2 and r["seg"]] == ["pt", "en", "fr"]
    assert all(0 < r["confidence"] <= 1.000001 for r in rows)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, PT, None)], []) == [] and run(spark, [(1, PT, None)], [("??", "x")]) == []


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = [tuple(r) for r in spark.read.parquet(DATA).select("lang", "text").orderBy("sample_id").collect()]
    model = L.train(rows[::2])
    right = sum(L.LANGS[int(model.logits(L.evidence(t)).argmax())] == L.label_language(k) for k, t in rows[1::2])
    assert right / len(rows[1::2]) > 0.97


def test_data_is_no_sentence():
    assert L.sentences("LINESTRING (421084.6 6582270.9, 419445.8 6519988.5") == L.sentences("Ab3/" * 40) == []
    assert L.sentences('Fim.\n{"u": 1, "name": "x"}') == ['Fim.\n{"u": 1, "name": "x"}']
    assert L.evidence("<|endoftext|>Poste caído, desde ontem.") == ["poste", "caído", "desde", "ontem"]


def test_quotations_of_any_length_are_no_evidence():
    assert "street" not in L.evidence('Usei o comando "' + "street network " * 50 + '" e sobraram trechos.')


def test_votes_of_labels_find_a_sentence_s_own_language():
    rows = [("pt", PT)] * 6 + [("en", PT)] * 2 + [("xx", PT), (None, EN), ("en", None)]
    (sentence, votes), *rest = L.tally(rows).values()
    assert sentence == PT and votes.tolist() == [6, 2, 0, 0] and not rest


def test_a_document_of_rejected_sentences_has_no_language(spark, monkeypatch):
    monkeypatch.setattr(L, "REJECT", 1.1)
    import numpy as np

    assert list(L._rows("1", "pt", ["a b."], np.array([[0.4, 0.3, 0.2, 0.1]]), -2.0)) == [("1", 0, None, 0.4, 4, "pt", 1)]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_planted_segments_are_found(spark):
    """Texts mixed from labelled sentences that were not learned: label swaps, single foreign sentences, clipped notes."""
    import numpy as np

    rows = [tuple(r) for r in spark.read.parquet(DATA).select("lang", "text").orderBy("sample_id").collect()]
    docs = [tuple(r) for r in spark.read.parquet(DATA.replace("lang_samples", "documents")).select("lang", "text").collect()]
    model, rng = L.train(rows[::2], L.tally(docs)), np.random.default_rng(3)
    by = {k: [t.strip() for lang, t in rows[1::2] if lang == k] for k in L.LANGS}
    right, n = 0, 400
    for _ in range(n):
        main, other = rng.choice(L.LANGS, 2, replace=False)
        length, run = int(rng.integers(3, 10)), int(rng.integers(0, 3))
        at = int(rng.integers(0, length))
        truth = [main] * at + [other] * run + [main] * (length - at)
        path, _ = L.decode(model, [" " + str(rng.choice(by[k])) for k in truth])
        right += [L.LANGS[j] for j in path] == truth
    assert right / n > 0.95
