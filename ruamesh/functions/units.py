"""Units of length and speed: what a text says, and factors to metres and km/h. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor to metres (length) and to km/h (speed).
FACTORS = {
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344},
    "speed": {"km/h": 1.0, "m/s": 3.6, "mph": 1.609344, "kn": 1.852},
}
#: How each unit is written, as regular expressions over lower case; for prose and behind numbers alike.
WORDS = {
    "length": {
        "km": r"km|quil[oô]metros?|kil[oó]met(?:er|re|ro)s?",
        "cm": r"cm|cent[ií]metros?|centimet(?:er|re)s?",
        "ft": r"ft|feet|foot|p[eé]s?",
        "yd": r"yds?|yards?|jardas?",
        "mi": r"mi|miles?|milhas?",
        "m": r"m|mts?|metros?|met(?:er|re)s?",
    },
    "speed": {
        "km/h": r"km ?/ ?h|kmh|kph|km/hr|quil[oô]metros (?:por|/) ?hora|kilomet(?:er|re)s per hour",
        "m/s": r"m ?/ ?s|mps|metros (?:por|/) ?segundo|met(?:er|re)s per second",
        "mph": r"mph|mi/h|milhas ?/ ?h|milhas (?:por|/) ?hora|miles per hour",
        "kn": r"kn|kts?|knots?|n[oó]s?",
    },
}
#: Words by which a remark says that it speaks of the field.
FIELD_WORDS = {"length": r"comprimento|extens|(?:^|\W)ext\.|length|medida do trecho|dist[aâ]nci", "speed": r"veloc|(?:^|\W)vel\.|limit|speed"}
NUMBER = r"[+-]?\d+(?:[.,]\d+)?"
_REMARK = r"\s*(?:\(.*\)|@.*)?\s*"


def number(value: Column | str, kind: str | None = None) -> Column:
    """The number of a value that is one alone, or with a unit (of ``kind``) and a remark; else null."""
    v = F.lower(F.col(value) if isinstance(value, str) else value)
    unit = "" if kind is None else r"\s*(?:" + "|".join(WORDS[kind].values()) + ")?"
    return F.replace(F.nullif(F.regexp_extract(v, rf"(?s)^\s*({NUMBER}){unit}{_REMARK}$", 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def own_unit(value: Column | str, kind: str) -> Column:
    """The unit that a value's own text says behind its number; else null."""
    v = F.lower(F.col(value) if isinstance(value, str) else value)
    out = F.lit(None).cast("string")
    for unit, words in reversed(WORDS[kind].items()):
        out = F.when(v.rlike(rf"(?s)^\s*{NUMBER}\s*(?:{words}){_REMARK}$"), F.lit(unit)).otherwise(out)
    return F.when(~v.rlike(rf"^{NUMBER}$"), out)  # most values are a number alone and need no more


def stated_unit(text: Column | str, kind: str) -> Column:
    """The unit that a remark says of the field: it names the field and a unit that stands behind no number."""
    v = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(None).cast("string")
    for unit, words in reversed(WORDS[kind].items()):
        tail = r"(?![\p{L}\p{N}_/])" if kind == "speed" else r"(?![\p{L}\p{N}_/²³])(?! (?:por|per|/) ?(?:hora|hour|segundo|second))"
        out = F.when(v.rlike(rf"(?<![\p{{L}}\p{{N}}_/])(?<!\d )(?:{words}){tail}"), F.lit(unit)).otherwise(out)
    return F.when(v.rlike(FIELD_WORDS[kind]), out)


def factor(unit: Column | str, kind: str) -> Column:
    """Factor from a unit to the common one (metre or km/h); null for an unknown unit."""
    pairs = [F.lit(x) for k, f in FACTORS[kind].items() for x in (k, f)]
    return F.create_map(*pairs)[F.col(unit) if isinstance(unit, str) else unit]
