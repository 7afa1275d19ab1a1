"""Languages of documents and of their segments: averaged hashed subword embeddings under a linear softmax.

The classifier is trained here, by stochastic gradient descent in numpy, on labelled sentences (at most
``MAX_SAMPLES``) and on the sentences of at most ``MAX_LABELLED`` labelled documents; those are the bounded samples
taken to the driver, and all else covers all rows. Documents' labels are noisy, so a sentence's own language is
hidden: its copies in differently labelled documents vote, the classifier has its say, and only sentences whose
language both make clear are learned, in ``ROUNDS`` rounds. Each sentence is seen as written, without accents and in
lower case with its names, so that such texts are recognised too. The temperature and the price of a change of
language are fitted last, on sentences that the fitting models have not seen (``FOLDS`` folds): the one by log loss,
the other on texts mixed from those sentences. A sentence below ``REJECT`` has no language of its own, and a document
of such sentences alone has none (null).

A document is cut into sentences in one pass; a Viterbi path over its sentences gives each its language; rejected
ones follow their neighbours. Names (capitalised words inside a sentence), numbers and quotations are no evidence.
Data records, markup and unbroken runs of more than ``LONGEST_WORD`` characters are no words.

Defined results: null, empty and wordless texts give no row; a label is compared after normalising its notation, and
null, blank or meaningless ones name no language; ties in characters go to the language that comes first in the
text; without any labelled sentence there is no row; repeated rows come each time. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("pt", "en", "es", "fr")
#: Names and codes of the languages, lower case without accents.
NAMES = {
    "pt": "pt por portugues portuguesa portuguese portugais",
    "en": "en eng ingles english anglais inglesa",
    "es": "es spa espanol spanish espanhol espagnol castellano",
    "fr": "fr fra fre frances french francais francesa",
}
_CODES = {w: k for k, v in NAMES.items() for w in v.split()}
MAX_SAMPLES = 20_000
BUCKETS, DIM, EPOCHS, RATE, BATCH = 1 << 16, 16, 15, 0.5, 8
#: Least calibrated confidence of a sentence; log price of a change of language where none can be fitted.
REJECT, CHANGE = 0.5, -4.0
#: Most labelled documents whose sentences are learned too, most different sentences of them, and most characters of
#: such a sentence.
MAX_LABELLED, MAX_LEARNED, MAX_CHARS = 2000, 40_000, 2000
#: Epochs and rounds of that; share of the documents' labels taken to be right; least probability of a sentence's language.
MORE_EPOCHS, ROUNDS, RIGHT, CLEAR = 2, 2, 0.85, 0.9
#: Parts that the labelled sentences are divided into for calibration; log prices tried for a change of language;
#: texts mixed to choose among them.
FOLDS, PRICES, MIXES = 3, (-6.0, -5.0, -4.0, -3.0, -2.5, -2.0, -1.5, -1.0), 2000
_GRAMS = (1, 4)
#: Abbreviations that end no sentence.
ABBREVIATIONS = "av avda r tv trav tr estr al alam pca pça dr dra sr sra srs prof profa eng enga gen mal cel cap ten ver vera pe d n nº no num pag p ex etc st mr mrs ms vs m mme mlle bd bld apto"
_ABBR = frozenset(ABBREVIATIONS.split())
_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|$))|(?:\n\s*\n)")
_LAST_WORD = re.compile(r"([^\W\d_]+|nº)$")
_TOKEN = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*(?:['’]\p{Latin}[\p{Latin}\p{M}]*)?")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»")
_RECORD = re.compile(r"\{[^{}]*\}|\[[^\[\]]*\d[^\[\]]*\]|<\|[^|<>]*\|>|</?[A-Za-z][^<>]*>|\b[A-Z]{4,} ?\([-+\d.,;\s()]*(?:\)|$)")
LONGEST_WORD = 40
_UNBROKEN = re.compile(r"\S{%d,}" % (LONGEST_WORD + 1))
_DRESS = re.compile("[*_>#​‌‍﻿­]+")


def label_language(label: str | None) -> str | None:
    """The language that a label names, whatever its notation; None where it names none."""
    if not label:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", label.strip().lower()) if not unicodedata.combining(c))
    for part in [plain, *re.split(r"[^a-z]+", plain)[:1]]:
        if part in _CODES:
            return _CODES[part]
    return None


def _bare(text: str) -> str:
    if "{" in text or "[" in text or "<" in text or "(" in text:
        text = _RECORD.sub(" ", text)
    return _UNBROKEN.sub(" ", text) if len(text) > LONGEST_WORD and _UNBROKEN.search(text) else text


def _worded(piece: str) -> bool:
    """Whether a piece holds a word outside data records such as JSON and outside markup."""
    return bool(_TOKEN.search(piece)) and bool(_TOKEN.search(_bare(piece)))


def sentences(text: str) -> list[str]:
    """Whole sentences; what holds no word goes with the sentence before (or after, at the beginning)."""
    cuts, out, worded = [], [], []
    for m in _END.finditer(text):
        if text[m.start()] == ".":
            before = _LAST_WORD.search(text, max(0, m.start() - 8), m.start())
            if before and before.group().lower() in _ABBR and m.group() == ".":
                continue
            if before and len(before.group()) == 1 and before.group().isupper():
                continue
        cuts.append(m.end())
    start = 0
    for c in [*cuts, len(text)]:
        piece = text[start:c]
        start = c
        if not piece:
            continue
        has = _worded(piece)
        if out and not (has and worded[-1]):
            out[-1] += piece
            worded[-1] = worded[-1] or has
        else:
            out.append(piece)
            worded.append(has)
    return [s for s, w in zip(out, worded) if w]


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def evidence(sentence: str) -> list[str]:
    """Words that speak for a language: no quotations, and no capitalised words inside a mixed-case sentence."""
    s = _bare(_DRESS.sub("", _bare(sentence)))
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    tokens = _TOKEN.findall(_QUOTED.sub(" ", s) if '"' in s or "“" in s or "«" in s else s)
    if len(tokens) < 2:
        tokens = _TOKEN.findall(s)
    if any(t.islower() for t in tokens):
        kept = [t for k, t in enumerate(tokens) if k == 0 or not t[0].isupper()]
        tokens = kept if len(kept) >= 2 else tokens
    return [t.lower() for t in tokens] if "’" not in s else [t.lower().replace("’", "'") for t in tokens]


def grams(w: str) -> list[int]:
    """Bucket ids of a word and of its subwords of ``_GRAMS`` characters."""
    padded = f"<{w}>"
    parts = {padded} | {padded[k : k + n] for n in range(_GRAMS[0] + 1, _GRAMS[1] + 1) for k in range(len(padded) - n + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(parts)]


def sentence_ids(words: list[str]) -> np.ndarray:
    return np.array([b for w in words for b in grams(w)], dtype=np.int64)


class Model:
    """Embeddings averaged over a sentence's subwords, then a linear softmax with a fitted temperature; the price of a
    change of language belongs to it."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, temperature: float = 1.0, price: float = CHANGE) -> None:
        # The product is what a sentence needs of each bucket.
        self.table, self.temperature, self.price = (emb @ out).astype(np.float32), temperature, price
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS) + 1), np.float32)

    def word(self, w: str) -> int:
        """Where ``rows`` has the sum of a word's rows of the table, and behind it their number."""
        got = self.words.get(w)
        if got is None:
            got, ids = len(self.words), grams(w)
            if got == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[got, :-1], self.rows[got, -1] = self.table[ids].sum(axis=0), len(ids)
            self.words[w] = got
        return got

    def logits_many(self, many: list[list[str]]) -> np.ndarray:
        """One row for each list of words; zeros for an empty one. At most some 200,000 words stay cached."""
        if len(self.words) > 200_000:
            self.words.clear()
        out, filled = np.zeros((len(many), len(LANGS))), [k for k, ws in enumerate(many) if ws]
        if filled:
            at = np.array([self.word(w) for k in filled for w in many[k]])
            sizes = np.array([len(many[k]) for k in filled])
            total = np.add.reduceat(self.rows[at], np.cumsum(sizes) - sizes)
            out[filled] = total[:, :-1] / total[:, -1:] / self.temperature
        return out

    def logits(self, words: list[str]) -> np.ndarray:
        return self.logits_many([words])[0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _dressed(text: str) -> list[list[str]]:
    """A sentence as training sees it: as evidence, without accents, in lower case with its names, halved."""
    ws, low = evidence(text), evidence(text.lower())
    half = len(ws) // 2
    out = [ws, [_plain(w) for w in ws], low, [_plain(w) for w in low]]
    return out + ([ws[:half], ws[half:]] if half >= 3 else [])


Weights = tuple[np.ndarray, np.ndarray]
Data = list[tuple[int, np.ndarray]]
Votes = dict[str, tuple[str, np.ndarray]]


def _fit(data: Data, weights: Weights, epochs: int, rate: float, rng: np.random.Generator) -> Weights:
    """Stochastic gradient descent on the log loss in batches of ``BATCH``, with a rate that falls to 0."""
    emb, out = weights[0].copy(), weights[1].copy()
    flat, lanes = emb.reshape(-1), np.arange(emb.shape[1])
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(data))
        for b in range(0, len(data), BATCH):
            rows = [data[k] for k in order[b : b + BATCH]]
            sizes = np.array([len(ids) for _, ids in rows])
            ids = np.concatenate([ids for _, ids in rows])
            h = np.add.reduceat(emb[ids], np.cumsum(sizes) - sizes) / sizes[:, None]
            g = _softmax(h @ out)
            g[np.arange(len(rows)), [y for y, _ in rows]] -= 1
            back = (g @ out.T) * (step * 4 / sizes)[:, None]
            out -= step * (h.T @ g)
            np.subtract.at(flat, (ids[:, None] * emb.shape[1] + lanes).ravel(), np.repeat(back, sizes, axis=0).ravel())
    return emb, out


def _start(rng: np.random.Generator) -> Weights:
    return rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(LANGS)))


def _features(rows: list[tuple[int, str]]) -> Data:
    return [(y, ids) for y, t in rows for ws in _dressed(t) if len(ids := sentence_ids(ws))]


def learn(samples: Data, votes: Votes, rng: np.random.Generator) -> tuple[Weights, Data]:
    """Fit on samples, then in ``ROUNDS`` rounds on sentences of documents too, given as the votes of the labels for
    each evidence: those whose language the votes and the classifier together make clear. Gives the latter as well."""
    weights = _fit(samples, _start(rng), EPOCHS, RATE, rng)
    odds = np.log(RIGHT / ((1 - RIGHT) / (len(LANGS) - 1)))
    keys, more = list(votes), []
    dressed = [[ids for ws in _dressed(votes[k][0])[:2] if len(ids := sentence_ids(ws))] for k in keys]
    for _ in range(ROUNDS if keys else 0):
        model = Model(*weights)
        p = _softmax(model.logits_many([k.split() for k in keys]) + odds * np.array([votes[k][1] for k in keys]))
        more = [(int(y), ids) for y, c, many in zip(p.argmax(axis=1), p.max(axis=1), dressed) if c >= CLEAR for ids in many]
        weights = _fit(samples + more, weights, MORE_EPOCHS, RATE / 2, rng)
    return weights, more


def tally(labelled: Iterable[tuple[str, str]]) -> Votes:
    """For each evidence of two words or more in the (label, document) rows: one such sentence, and the labels' votes."""
    out: Votes = {}
    for label, text in labelled:
        if (k := label_language(label)) in LANGS:
            for p in sentences(text or ""):
                ws = evidence(p) if len(p) <= MAX_CHARS else []
                if len(ws) >= 2:
                    out.setdefault(" ".join(ws), (p, np.zeros(len(LANGS))))[1][LANGS.index(k)] += 1
    return out


def price_of_change(logits: np.ndarray, right: np.ndarray, temperature: float, rng: np.random.Generator) -> float:
    """The price under which most texts mixed of these sentences come out wholly right: half of them in one language,
    half with a run of one to three sentences of another."""
    by = [np.flatnonzero(right == y) for y in range(len(LANGS))]
    present = [y for y, ks in enumerate(by) if len(ks)]
    if len(present) < 2:
        return PRICES[len(PRICES) // 2]
    logs, texts = _emissions(_softmax(logits / temperature)), []
    for n in range(MIXES):
        main, other = rng.choice(present, 2, replace=False)
        length, run = int(rng.integers(3, 13)), int(rng.integers(1, 4)) if n % 2 else 0
        at = int(rng.integers(0, length + 1))
        texts.append(np.concatenate([rng.choice(by[y], m) for y, m in ((main, at), (other, run), (main, length - at))]).astype(int))
    won = [sum(np.array_equal(best_path(logs[t], price), right[t]) for t in texts) for price in PRICES]
    best = [k for k, w in enumerate(won) if w == max(won)]
    return PRICES[best[len(best) // 2]]


def train(samples: list[tuple[str, str]], votes: Votes | None = None, seed: int = 7) -> Model:
    """The classifier from (language, sentence) rows and the documents' votes, calibrated."""
    rng = np.random.default_rng(seed)
    rows = [(LANGS.index(k), t) for lang, t in samples if t and (k := label_language(lang)) in LANGS]
    weights, more = learn(_features(rows), votes or {}, rng)
    final = Model(*weights)
    # The folds start from the documents' sentences alone, then learn the samples of the other folds.
    base = _fit(more, _start(rng), MORE_EPOCHS, RATE, rng)
    fold = rng.permutation(len(rows)) % FOLDS
    unseen, right = [], []
    for f in range(FOLDS if len(rows) >= 10 * FOLDS else 0):
        part = Model(*_fit(_features([r for r, k in zip(rows, fold) if k != f]), base, EPOCHS if not more else MORE_EPOCHS, RATE, rng))
        for (y, t), k in zip(rows, fold):
            for ws in _dressed(t) if k == f else ():
                if ws:
                    unseen.append(part.logits(ws))
                    right.append(y)
    if unseen:
        z, y = np.array(unseen, dtype=float), np.array(right)
        temps = np.geomspace(0.25, 4, 17)
        losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-9).sum() for t in temps]
        final.temperature = float(temps[int(np.argmin(losses))])
        final.price = price_of_change(z, y, final.temperature, rng)
    return final


def _emissions(probs: np.ndarray) -> np.ndarray:
    """What each sentence adds to a path: its log probabilities, or nothing when it is rejected."""
    return np.where(probs.max(axis=1)[:, None] >= REJECT, np.log(probs + 1e-6), 0.0)


def best_path(emit: np.ndarray, price: float) -> np.ndarray:
    """The languages along the best path, a change costing ``price``."""
    score, back = emit[0], []
    for row in emit[1:]:
        back.append(np.where(score >= score.max() + price, np.arange(len(LANGS)), score.argmax()))
        score = np.maximum(score, score.max() + price) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def path_of(probs: np.ndarray, price: float) -> np.ndarray | None:
    """Language of each sentence along the best path; None when every sentence is rejected."""
    sure = probs.max(axis=1) >= REJECT
    if not sure.any():
        return None
    told = probs.argmax(axis=1)[sure]
    return np.full(len(probs), told[0]) if (told == told[0]).all() else best_path(_emissions(probs), price)


def decode(model: Model, parts: list[str]) -> tuple[list[int], list[float]]:
    """Language of each sentence along the best path (the likeliest one where all are rejected), and its confidence."""
    probs = _softmax(np.array([model.logits(evidence(p)) for p in parts], dtype=float))
    path = path_of(probs, getattr(model, "price", CHANGE))
    if path is None:
        path = np.full(len(parts), probs.mean(axis=0).argmax())
    return path.tolist(), probs[np.arange(len(parts)), path].tolist()


_OUT = "doc_id bigint, seg bigint, lang string, confidence double, chars bigint, named string, n_runs bigint"


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(k, p, *n.astype(int).tolist()) for k, (p, n) in tally(zip(pdf["lang"], pdf["text"])).items()]
        yield pd.DataFrame(out, columns=["words", "sentence", *LANGS])


def fitted(docs: DataFrame, samples: DataFrame) -> Model | None:
    """The classifier of these tables, from their bounded samples; None without any labelled sentence."""
    labelled = samples.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").orderBy(F.xxhash64("text"), "lang").limit(MAX_SAMPLES)
    rows = [tuple(r) for r in labelled.collect()]
    if not any(label_language(k) for k, _ in rows):
        return None
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("lang", "text")
    counts = known.mapInPandas(_tallied, "words string, sentence string, " + ", ".join(f"{k} bigint" for k in LANGS))
    counts = counts.groupBy("words").agg(F.min("sentence").alias("sentence"), *[F.sum(k).alias(k) for k in LANGS])
    votes = counts.orderBy(F.xxhash64("words"), "words").limit(MAX_LEARNED).collect()
    return train(rows, {r["words"]: (r["sentence"], np.array([r[k] for k in LANGS], dtype=float)) for r in votes})


def _rows(key: str, label: str | None, parts: list[str], probs: np.ndarray, price: float) -> Iterator[tuple]:
    """Output rows of one document."""
    named, sizes = label_language(label), [len(p.strip()) for p in parts]
    path = path_of(probs, price)
    if path is None:
        yield key, 0, None, float(probs.mean(axis=0).max()), sum(sizes), named, 1
        return
    chars, first, weights, runs = {}, {}, {}, []
    for n, (j, size) in enumerate(zip(path.tolist(), sizes)):
        c = float(probs[n, j])
        chars[j] = chars.get(j, 0) + size
        weights[j] = weights.get(j, 0.0) + c * size
        first.setdefault(j, n)
        if runs and runs[-1][0] == j:
            runs[-1][1] += c * size
            runs[-1][2] += size
        else:
            runs.append([j, c * size, size])
    main = min(chars, key=lambda j: (-chars[j], first[j]))
    yield key, 0, LANGS[main], weights[main] / chars[main], chars[main], named, len(runs)
    for n, (j, c, size) in enumerate(runs, 1):
        yield key, n, LANGS[j], c / size, size, named, len(runs)


def languages(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, seg, lang, confidence, chars, named, n_runs): seg 0 the main language, seg 1... each run of one language.

    named is the language that the document's label names, or null.
    """
    fit = fitted(docs, samples)
    if fit is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).limit(0).selectExpr("doc_id", *[f"CAST(NULL AS {t}) AS {n}" for n, t in (x.split() for x in _OUT.split(", ")[1:])])
    model = docs.sparkSession.sparkContext.broadcast(fit)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [sentences(t) for t in pdf["text"]]
            probs = _softmax(model.value.logits_many([evidence(p) for parts in texts for p in parts]))
            ends = np.cumsum([len(parts) for parts in texts])
            out = [r for k, label, parts, e in zip(pdf["doc_id"], pdf["lang"], texts, ends) if parts for r in _rows(k, label, parts, probs[e - len(parts) : e], model.value.price)]
            yield pd.DataFrame(out, columns=["doc_id", "seg", "lang", "confidence", "chars", "named", "n_runs"])

    # Keys go as text: pandas would turn whole numbers beside a null into floats.
    base = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL")
    return base.mapInPandas(assign, _OUT.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
