"""Road type and travel mode of a street segment, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: OSM road class to label, by language, as the configuration file has them.
ROAD_TYPES = {
    "pt": {
        "motorway": "Via Expressa",
        "trunk": "Via Expressa",
        "primary": "Via Arterial",
        "secondary": "Via Coletora",
        "tertiary": "Via Local",
        "residential": "Via Local",
        "living_street": "Via Local",
        "busway": "Corredor de Ônibus",
        "service": "Via de Serviço",
    },
    "en": {
        "motorway": "Motorway",
        "trunk": "Trunk Road",
        "primary": "Arterial Road",
        "secondary": "Collector Road",
        "tertiary": "Local Collector",
        "residential": "Residential Street",
        "living_street": "Living Street",
        "busway": "Bus Corridor",
        "service": "Service Road",
    },
}
#: The Portuguese labels that hold for single classes only, and the English ones with link roads.
LADDER_PT = {
    "busway": "Corredor de onibus",
    "primary": "Via Arterial",
    "secondary": "Via Coletora",
    "secondary_link": "Link Coletor",
    "tertiary": "Via Coletora Local",
    "residential": "Rua Residencial",
}
INLINE_EN = {
    "busway": "Bus Corridor",
    "motorway": "Motorway",
    "trunk": "Trunk Road",
    "primary": "Arterial Road",
    "secondary": "Collector Road",
    "secondary_link": "Collector Link",
    "tertiary": "Local Collector",
    "residential": "Residential Street",
}
#: Road class to travel mode.
MODES = {"busway": "bus", "primary": "car", "secondary": "car", "tertiary": "car", "residential": "car", "cycleway": "bike", "footway": "pedestrian"}


def first_class(highway: Column | str) -> Column:
    """The first road class of a text that may hold a list; null for null."""
    h = F.col(highway) if isinstance(highway, str) else highway
    return F.regexp_extract(h, r"([a-z_]+)", 1)


def lookup_label(key: Column, table: dict[str, str], default: str) -> Column:
    """Label of a key by a small fixed table; the default for null and unknown keys."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def road_type(highway: Column | str, language: str = "en") -> Column:
    """Label of the first class of the list, ``Other`` where there is none."""
    return lookup_label(first_class(highway), ROAD_TYPES[language], "Other")


def road_type_ladder(highway: Column | str) -> Column:
    """Portuguese label of a single class; a list, null and the rest are ``Outro``."""
    return lookup_label(F.col(highway) if isinstance(highway, str) else highway, LADDER_PT, "Outro")


def road_type_inline(highway: Column | str) -> Column:
    return lookup_label(first_class(highway), INLINE_EN, "Other")


def modal(highway: Column | str) -> Column:
    """Travel mode of a single class; a list is ``other``."""
    return lookup_label(F.col(highway) if isinstance(highway, str) else highway, MODES, "other")


def contains(column: str, text: str) -> Column:
    """Whether a text holds another, whatever the case; false for null."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(text.lower())), F.lit(False))


def matches(column: str, pattern: str) -> Column:
    """Whether a text holds a match of a pattern, whatever the case; false for null."""
    return F.coalesce(F.col(column).rlike("(?iu)" + pattern), F.lit(False))
