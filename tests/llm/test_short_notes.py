import numpy as np
import pytest

from ruamesh.llm import language as L


class Fixed:
    """A model that knows English words with an e and Spanish words with an s, each at given odds."""

    def __init__(self, odds):
        self.odds = odds

    def logits(self, words):
        z = np.zeros(len(L.LANGS))
        z[L.LANGS.index("es" if words[0][0] == "s" else "en")] = np.log(self.odds * 3)
        return z


@pytest.mark.parametrize("note", ["sa sb sc sd.", "sa sb sc.", "sa sb.", "sa."])
def test_a_note_with_clear_odds_stands_alone(note):
    long = "ea eb ec ed ee."
    path, _ = L.decode(Fixed(300_000), [long, note, long])
    assert [L.LANGS[k] for k in path] == ["en", "es", "en"]
    assert [L.LANGS[k] for k in L.decode(Fixed(300_000), [long, long, note])[0]] == ["en", "en", "es"]


def test_unclear_or_rejected_notes_follow_their_neighbours():
    long = "ea eb ec ed ee."
    assert len(set(L.decode(Fixed(20), [long, "sa sb.", long])[0])) == 1
    assert len(set(L.decode(Fixed(2), [long, "sa sb.", long])[0])) == 1
    assert len(set(L.decode(Fixed(0.4), [long, "sa sb sc sd se.", long])[0])) == 1
