"""Several values packed in one text field: expectation-maximisation segmentation with Viterbi lattices.

A text is scanned once for its *atoms*: quoted spans and remarks in parentheses are atomic, brackets around the
whole are dropped, and every delimiter outside an atom is only a *candidate* boundary. The stretches between any two
candidate boundaries are the arcs of a lattice. Expectation-maximisation over all distinct texts of a column,
weighted by how often each occurs, learns how frequent every value and every way of writing a delimiter is; the
Viterbi path through the lattice then is the split. So ``1,5`` comes apart in a column where 1 and 5 are frequent,
and ``11,1`` stays whole where it is frequent itself.

All statistics are Spark aggregates over the whole column. Python sees distinct texts that hold a delimiter only.

Arcs span up to ``INNER`` unquoted delimiters, and beyond that every number of delimiters that some value of the
column is known to hold because it stands quoted and alone in a text: no other longer value could be more frequent
than its parts. So the lattice is linear in the text.

Defined results: null texts and texts of blanks give no value; an empty slot counts as a position but gives no row;
repeated rows are kept under their own key; a text of any length is processed whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup

#: Characters that may part two values.
DELIMITERS = ";|,\t/"
#: Delimiters that an unquoted value may hold itself without being known from elsewhere.
INNER = 16
#: Probability that a value is followed by another, before the ways of writing are weighed.
CONTINUE = 0.1
#: Probability of an empty slot.
EMPTY = 0.01
#: Log probability of each character of a value never seen.
PER_CHAR = -math.log(40)
#: Pseudo-count that all values never seen share.
ALPHA = 1.0
#: Prior mass of a number with decimal comma where the column may hold one.
DECIMAL = 1e-3
#: Log prior of each delimiter that a value never seen holds outside remarks; a bare slash (as in km/h) is free.
SWALLOWED = math.log(1e-15)
#: Expectation-maximisation ends when no field's expected number of values changes by more than this share, or after
#: so many rounds.
TOLERANCE, EM_ROUNDS = 1e-3, 12

_OPEN, _CLOSE, _QUOTES = "[{", "]}", "'\""
_REMARK = re.compile(r"\(.*?\)|@[^;|\t(]*")
_BLANK = " \t\r\n "


def scan(text: str) -> tuple[list[str], list[str]]:
    """Pieces between candidate delimiters, and the delimiters as written (blanks beside them shown as ``_``)."""
    s = text.strip(_BLANK)
    if s[:1] in _OPEN and s[:1]:
        s = s[1:]
        if s[-1:] in _CLOSE and s[-1:]:
            s = s[:-1]
    pieces, forms, start, i, n, at = [], [], 0, 0, len(s), False
    while i < n:
        c = s[i]
        if c in _QUOTES and not s[start:i].strip(_BLANK):
            end = i + 1
            while (end := s.find(c, end)) >= 0:
                after = s[end + 1 :].lstrip("  ")[:1] if end + 1 < n else ""
                if not after or after in DELIMITERS + _CLOSE:
                    break
                end += 1
            if end > 0:
                i = end + 1
                continue
        elif c == "(":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (s[j] == "(") - (s[j] == ")")
                j += 1
            if not depth:
                i, at = j, False  # a remark behind @ ends with its parentheses
                continue
        elif c == "@":
            at = True
        elif c in DELIMITERS and not (at and c in ",/"):
            before, after = s[i - 1 : i] in (" ", " "), s[i + 1 : i + 2] in (" ", " ")
            pieces.append(s[start:i])
            forms.append("_" * before + c + "_" * after)
            start, at = i + 1, False
        i += 1
    return [*pieces, s[start:]], forms


def bare(value: str) -> str:
    """A value without the quotes, brackets and blanks around it."""
    v = value.strip(_BLANK)
    while len(v) >= 2 and ((v[0] in _QUOTES and v[-1] == v[0]) or (v[0] in _OPEN and v[-1] in _CLOSE)):
        v = v[1:-1].strip(_BLANK)
    return v


def _quoted(piece: str) -> bool:
    p = piece.strip(_BLANK)
    return len(p) >= 2 and p[0] in _QUOTES and p[-1] == p[0]


def lattice(pieces: list[str], forms: list[str], longer: tuple[int, ...] = ()) -> list[tuple[int, int, str]]:
    """Arcs (from, to, value): the pieces from..to-1 as one value. A quoted piece is an arc of its own.

    ``longer``: numbers of delimiters beyond ``INNER`` that a value may hold.
    """
    arcs, solid = [], [_quoted(p) for p in pieces]
    most = max(longer, default=INNER)
    for i in range(len(pieces)):
        whole = [pieces[i]]
        arcs.append((i, i + 1, bare(pieces[i])))
        if solid[i] or not pieces[i].strip(_BLANK):
            continue
        for j in range(i + 1, min(len(pieces), i + 1 + most)):
            if solid[j] or not pieces[j].strip(_BLANK):
                break
            whole += [forms[j - 1].strip("_"), pieces[j]]
            if j - i <= INNER or j - i in longer:
                arcs.append((i, j + 1, bare("".join(whole))))
    return arcs


def _base(value: str, decimals: bool) -> float:
    """Log prior of a value never seen."""
    head, comma, tail = value.partition(",")
    if comma and decimals and head.lstrip("+-").isdigit() and tail[:1].isdigit():
        return math.log(DECIMAL)
    loose = _REMARK.sub("", value)
    inside = sum(loose.count(c) for c in ";|\t,") + loose.count(" / ")
    return PER_CHAR * max(1, len(value)) + SWALLOWED * inside


def _log_add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def _log_theta(value: str, count: float | None, total: float, decimals: bool) -> float:
    if not value:
        return math.log(EMPTY)
    return _log_add(math.log(count) if count else -math.inf, math.log(ALPHA) + _base(value, decimals)) - math.log(total + ALPHA)


def _score(arcs: list, forms: list[str], phi: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """Arcs with their log probability, the delimiter before them included."""
    step = math.log(CONTINUE)
    return [(i, j, v, t + (step + phi.get(forms[i - 1], -4.0) if i else 0.0)) for i, j, v, t in arcs]


def expected(arcs: list, forms: list[str], phi: dict[str, float]) -> list[tuple[str, int, float]]:
    """Forward-backward: (value, from, posterior) of every arc."""
    scored, n = _score(arcs, forms, phi), len(forms) + 1
    fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fwd[0] = bwd[n] = 0.0
    for i, j, _, p in sorted(scored):
        fwd[j] = _log_add(fwd[i] + p, fwd[j])
    for i, j, _, p in sorted(scored, reverse=True):
        bwd[i] = _log_add(bwd[j] + p, bwd[i])
    return [(v, i, math.exp(min(0.0, fwd[i] + p + bwd[j] - fwd[n]))) for i, j, v, p in scored]


def viterbi(arcs: list, forms: list[str], phi: dict[str, float]) -> list[str]:
    """The values of the best path, empty slots included. Ties: the path with more values."""
    n = len(forms) + 1
    best: list[tuple[float, int, int, str]] = [(0.0, 0, -1, "")] + [(-math.inf, 0, -1, "")] * n
    for i, j, v, p in sorted(_score(arcs, forms, phi)):
        new = (best[i][0] + p, best[i][1] + 1, i, v)
        if new[:2] > best[j][:2]:
            best[j] = new
    out, at = [], n
    while at > 0:
        out.append(best[at][3])
        at = best[at][2]
    return out[::-1]


_ARCS = "field string, id string, n bigint, i int, j int, form string, value string"
_PATHS = "field string, id string, vals array<string>"


def _weigh(pdf: pd.DataFrame, decimals: dict[str, bool], totals: dict[str, float]) -> Iterator[tuple]:
    """(field, id, n, forms, arcs with their log probability) of each text."""
    for field, key, n, arcs in zip(pdf.field, pdf.id, pdf.n, pdf.arcs):
        forms = [""] * (max(a["j"] for a in arcs) - 1)
        for a in arcs:
            if a["i"]:
                forms[a["i"] - 1] = a["form"]
        scored = []
        for a in arcs:
            # A text is no evidence for its own split: what it may have counted itself is taken off.
            c = max(0.0, (a["c"] or 0.0) - n) if len(arcs) > len(forms) + 1 else a["c"]
            scored.append((a["i"], a["j"], a["value"], _log_theta(a["value"], c, totals.get(field, 0.0), decimals.get(field, False))))
        yield field, key, n, forms, scored


def distinct_texts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, text, n): how often each text stands in each field; nulls left out."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    return df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("text IS NOT NULL").groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"))


def _longer(odd: DataFrame) -> dict[str, tuple[int, ...]]:
    """By field, the numbers of delimiters beyond ``INNER`` that texts in one pair of quotes hold: a few numbers."""
    text = F.trim("text")
    n = F.regexp_count(text, F.lit(r"[;|,\t/]"))
    quoted = odd.filter(text.rlike(r"""(?s)^(['"]).*\1$""")).select("field", n.alias("k")).filter(F.col("k") > INNER).distinct()
    out: dict[str, list[int]] = {}
    for r in quoted.collect():
        out.setdefault(r["field"], []).append(r["k"])
    return {f: tuple(sorted(ks)) for f, ks in out.items()}


def learn_splits(df: DataFrame, fields: list[str], decimals: tuple[str, ...] = (), rounds: int = EM_ROUNDS, texts: DataFrame | None = None) -> DataFrame:
    """(field, text, vals) for every distinct text that holds a delimiter, quote or bracket; checkpointed.

    ``decimals``: the fields whose values may have a decimal comma. ``texts``: ``distinct_texts`` if known already.
    """
    may = {f: f in decimals for f in fields}
    # Texts travel once; what is learned from them goes by their hash.
    texts = cut((distinct_texts(df, fields) if texts is None else texts).withColumn("id", F.md5("text")))
    is_odd = F.col("text").rlike(r"""[;|,\t/\[\]{}'"]""")
    plain = texts.filter(~is_odd).select("field", F.trim("text").alias("value"), F.col("n").cast("double").alias("c"))
    odd = texts.filter(is_odd)
    longer = _longer(odd)

    def all_arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, key, t, n in zip(pdf.field, pdf.id, pdf.text, pdf.n):
                pieces, forms = scan(t)
                out += [(f, key, n, i, j, forms[i - 1] if i else "", v) for i, j, v in lattice(pieces, forms, longer.get(f, ()))]
            yield pd.DataFrame(out, columns=["field", "id", "n", "i", "j", "form", "value"])

    arcs = cut(odd.repartition("field", "id").mapInPandas(all_arcs, _ARCS))
    # Texts with one path only count as they are; the others start from the values that these show.
    width = cut(arcs.groupBy("field", "id").agg((F.count(F.lit(1)) > F.max("j")).alias("open")))
    one_path = arcs.join(width.filter("NOT open"), ["field", "id"], "left_semi").filter("value <> ''")
    sure = cut(one_path.select("field", "value", F.col("n").cast("double").alias("c")).unionByName(plain).groupBy("field", "value").agg(F.sum("c").alias("c")))
    counts, phi, before = sure, {}, {}
    open_arcs = cut(arcs.join(width.filter("open"), ["field", "id"], "left_semi"))

    def with_counts(which: DataFrame) -> DataFrame:
        known = lookup(which, counts, ["field", "value"], "left")
        return known.groupBy("field", "id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "j", "form", "value", "c"))).alias("arcs"))

    def by_field(df: DataFrame) -> dict[str, float]:
        return {r["field"]: r["t"] for r in df.groupBy("field").agg(F.sum("c").alias("t")).collect()}  # one row a field

    for _ in range(rounds):
        totals = by_field(counts)

        def expect(batches: Iterator[pd.DataFrame], totals: dict = totals, phi: dict = phi) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out: dict[tuple[str, str, str], float] = {}
                for field, _, n, forms, scored in _weigh(pdf, may, totals):
                    for value, i, p in expected(scored, forms, phi.get(field, {})):
                        for kind, what in (("v", value), ("d", forms[i - 1] if i else "")):
                            if what:
                                out[field, kind, what] = out.get((field, kind, what), 0.0) + p * n
                yield pd.DataFrame([(*k, c) for k, c in out.items()], columns=["field", "kind", "value", "c"])

        soft = cut(with_counts(open_arcs).mapInPandas(expect, "field string, kind string, value string, c double").groupBy("field", "kind", "value").agg(F.sum("c").alias("c")))
        # At most len(DELIMITERS) * 4 ways of writing a delimiter for each field.
        forms: dict[str, dict[str, float]] = {}
        for r in soft.filter("kind = 'd'").collect():
            forms.setdefault(r["field"], {})[r["value"]] = r["c"]
        phi = {f: {k: math.log((c + 0.5) / (sum(d.values()) + 10)) for k, c in d.items()} for f, d in forms.items()}
        counts = cut(sure.unionByName(soft.filter("kind = 'v'").select("field", "value", "c")).groupBy("field", "value").agg(F.sum("c").alias("c")))
        now = {f: sum(d.values()) for f, d in forms.items()}
        if all(abs(now[f] - before.get(f, 0.0)) <= TOLERANCE * now[f] for f in now):
            break
        before = now
    totals = by_field(counts)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(field, key, viterbi(scored, forms, phi.get(field, {}))) for field, key, _, forms, scored in _weigh(pdf, may, totals)]
            yield pd.DataFrame(out, columns=["field", "id", "vals"])

    paths = with_counts(arcs).mapInPandas(decode, _PATHS)
    return cut(odd.join(paths, ["field", "id"]).select("field", "text", "vals"))


def split_values(df: DataFrame, key: str, fields: list[str], decimals: tuple[str, ...] = (), multi_only: bool = False, keep: tuple[str, ...] = (), splits: DataFrame | None = None) -> DataFrame:
    """(key, *keep, field, pos, val): one row for each value, positions from 1.

    ``multi_only``: only texts with two values or more. ``keep``: further columns to carry along.
    """
    base = df.select(F.col(key).alias("_rm_k"), *[F.col(c).alias(f"_rm_{c}") for c in keep], *[F.col(f).cast("string").alias(f) for f in fields])
    splits = learn_splits(base, fields, decimals) if splits is None else splits
    carry = ["_rm_k", *[f"_rm_{c}" for c in keep]]
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
    rows = base.select(*carry, F.explode(F.array(*parts)).alias("p")).select(*carry, "p.*").filter("text IS NOT NULL")
    odd = F.col("text").rlike(r"""[;|,\t/\[\]{}'"]""")
    if multi_only:
        splits = splits.filter("size(filter(vals, v -> v <> '')) >= 2")
    out = lookup(rows.filter(odd), splits, ["field", "text"]).select(*carry, "field", F.posexplode("vals").alias("pos", "val"))
    if not multi_only:
        out = out.unionByName(rows.filter(~odd).select(*carry, "field", F.lit(0).alias("pos"), F.trim("text").alias("val")))
    return out.filter("val <> ''").select(F.col("_rm_k").alias(key), *[F.col(f"_rm_{c}").alias(c) for c in keep], "field", (F.col("pos") + 1).cast("bigint").alias("pos"), "val")
