"""Quantities recorded in different units: a hidden Markov model for each device, decoded by Viterbi.

The hidden state of a device (a source) on a day is the unit it records in. What is seen of it that day:

* the statement of the source, if it has one for that day (prose with dates, such as "in km until 30/06/2023");
* the mean log likelihood of the day's bare values, taken as jumps of log(value) against a smooth underlying level
  (for lengths the length of the geometry, for speeds the median of its class of road), with a share of outliers so
  that no day weighs more than ``DATA_WEIGHT``.

Days are aggregated in Spark, map-side; each device's days (a few hundred rows, however many values there are)
are decoded in one small group. With the default ``statement_weight`` a statement decides, as the table's contract
wants, so the values are asked only for sources whose statements name several units for one day (``stated_states``);
with 0 the switch days come from the data alone (``switches``). A unit in the value's own text, then one in
the row's remark, stand before the decoded state.

Defined results: null texts, and texts with no number, give no row; an unknown or null source has the common unit,
as a day without a statement has; a null time falls on the
device's last day. Every row counts by itself. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup
from ruamesh.functions.units import FACTORS, WORDS, factor, number, own_unit, stated_unit

STATEMENT_WEIGHT, DATA_WEIGHT, STAY = 100.0, 8.0, 0.98
#: Standard deviation of log(value * factor / level).
SPREAD = {"length": 0.05, "speed": 0.3}
OUTLIER = math.exp(-DATA_WEIGHT)

_DATE = r"(\d{2})/(\d{2})/(\d{4})"


def statements(sources: DataFrame, kind: str) -> DataFrame:
    """(source, unit, first, last): what the prose says of each source's unit, with the days it holds for.

    Prose is read clause by clause; a unit of length speaks of length and one of speed of speed.
    """
    prose = sources.select("source", F.explode(F.split(F.lower("descricao"), r"[;.]\s+|\.$")).alias("clause"))
    out = None
    for unit, words in WORDS[kind].items():
        tail = r"(?![\p{L}\p{N}_/])" if kind == "speed" else r"(?![\p{L}\p{N}_/²³])(?! (?:por|per|/) ?(?:hora|hour|segundo|second))"
        one = prose.filter(F.col("clause").rlike(rf"(?<![\p{{L}}\p{{N}}_/])(?<!\d )(?:{words}){tail}")).withColumn("unit", F.lit(unit))
        out = one if out is None else out.unionByName(one)
    day = lambda lead: F.to_date(F.nullif(F.regexp_extract("clause", rf"(?:{lead})\s+{_DATE}", 0), F.lit("")).substr(-10, 10), "dd/MM/yyyy")
    return out.select("source", "unit", day("a partir de|desde|from|since").alias("first"), day("até|ate|until").alias("last")).distinct()


def _gauss(ratio: Column, kind: str) -> Column:
    """Log likelihood of log(value * factor / level), with outliers."""
    z = F.log(ratio) / F.lit(SPREAD[kind])
    return F.when(ratio > 0, F.log(F.exp(-z * z / 2) + F.lit(OUTLIER)))


def _decode(kind: str, common: str, statement_weight: float):
    units = list(FACTORS[kind])

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        emit = pdf[[f"ll{k}" for k in range(len(units))]].fillna(0.0).to_numpy(dtype=float)
        said = np.zeros(emit.shape)
        for r, names in enumerate(pdf["said"]):
            wanted = [u for u in units if u in list(names if names is not None else [])] or [common]
            said[r] = [0.0 if u in wanted else -statement_weight for u in units]
        emit = emit + said
        move = np.full((len(units), len(units)), math.log((1 - STAY) / (len(units) - 1)))
        np.fill_diagonal(move, math.log(STAY))
        score, back = emit[0].copy(), []
        for row in emit[1:]:
            step = score[:, None] + move
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return pd.DataFrame({"source": pdf["source"], "day": pdf["day"], "decoded": [units[k] for k in path[::-1]]})

    return decode


def likelihoods(num: Column, level: Column, kind: str) -> list[Column]:
    """Log likelihood of a bare value under each unit of its kind."""
    return [_gauss(F.try_divide(F.abs(num) * f, level), kind) for f in FACTORS[kind].values()]


def _said(days: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """(source, day, said, other columns of ``days``): the units that statements name for each day of each source."""
    said, rest = statements(sources, kind), [c for c in days.columns if c not in ("source", "day")]
    on = (days.source == said.source) & F.coalesce(days.day >= said["first"], F.lit(True)) & F.coalesce(days.day <= said["last"], F.lit(True))
    return days.join(said, on, "left").groupBy(days.source, days.day).agg(*[F.first(c).alias(c) for c in rest], F.sort_array(F.collect_set("unit")).alias("said"))


def stated_states(days: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """(source, day, decoded): the unit that statements name for each (source, day), the common one without any; null where they name several."""
    common = next(u for u, f in FACTORS[kind].items() if f == 1.0)
    one = F.when(F.size("said") == 0, F.lit(common)).when(F.size("said") == 1, F.element_at("said", 1))
    return _said(days.select("source", "day"), sources, kind).select("source", "day", one.alias("decoded"))


def unit_states(days: DataFrame, sources: DataFrame, kind: str, statement_weight: float = STATEMENT_WEIGHT) -> DataFrame:
    """(source, day, decoded): the unit of each source on each day, from (source, day, ll0, ll1, ...); checkpointed."""
    common, lls = next(u for u, f in FACTORS[kind].items() if f == 1.0), [f"ll{k}" for k in range(len(FACTORS[kind]))]
    seen = _said(days.select("source", "day", *lls), sources, kind)
    return cut(seen.groupBy("source").applyInPandas(_decode(kind, common, statement_weight), "source string, day date, decoded string"))


def switches(states: DataFrame) -> DataFrame:
    """(source, unit, first, last): the runs of days of one unit. A source has few days, however many values."""
    runs = lambda pdf: pd.DataFrame([(g["source"].iloc[0], g["decoded"].iloc[0], g["day"].iloc[0], g["day"].iloc[-1]) for pdf in [pdf.sort_values("day")] for _, g in pdf.groupby((pdf["decoded"] != pdf["decoded"].shift()).cumsum())], columns=["source", "unit", "first", "last"])
    return states.groupBy("source").applyInPandas(runs, "source string, unit string, first date, last date")


def decode_units(values: DataFrame, sources: DataFrame, kind: str, statement_weight: float = STATEMENT_WEIGHT, numbers_only: bool = True) -> DataFrame:
    """Units of ``values``: (key, val, note, source, at, level) gain num, unit and si.

    Values without a number are left out, or with ``numbers_only=False`` keep null num and si. ``level`` is the underlying level in the common unit, or null. ``si`` is the value in metres or km/h.
    """
    base = values.withColumn("num", number("val", kind)).filter(F.col("num").isNotNull() if numbers_only else F.lit(True)).withColumn("own", F.coalesce(own_unit("val", kind), stated_unit("note", kind))).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("day", F.coalesce(F.to_date("at"), F.lit("9999-12-31").cast("date")))
    lls = [F.avg(F.when(F.col("own").isNull(), ll)).alias(f"ll{k}") for k, ll in enumerate(likelihoods(F.col("num"), F.col("level"), kind))]
    states = unit_states(base.groupBy("source", "day").agg(*lls), sources, kind, statement_weight)
    out = lookup(base, states, ["source", "day"])
    return out.withColumn("unit", F.coalesce("own", "decoded")).withColumn("si", F.col("num") * factor("unit", kind))
