"""Names: headers, parameters, stations, states, rivers, units."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import schema

# The words left out of station names that are compared.
STOP_TERMS = r"\b(station|monitoring|wq|water quality|cpcb|spcb)\b"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a small fixed map; null if it isn't there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def header_parameter(header: str, strict: bool = True) -> str | None:
    """The canonical parameter of a column header.

    A header matches an alias as a whole or, in order, as a run of its words.
    With ``strict`` off any containment counts, so short aliases match widely.
    """
    name = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", header.lower().strip())).strip("_")
    aliases = {a.strip("_") if strict else a: p for p, names in schema.HEADER_ALIASES.items() for a in names}
    if name in aliases:
        return aliases[name]
    if not name:
        return None
    for alias, parameter in aliases.items():
        whole = f"_{alias}_" in f"_{name}_" or f"_{name}_" in f"_{alias}_"
        if whole if strict else alias in name or name in alias:
            return parameter
    return None


def header_roles(headers: Iterable[str], strict: bool = True) -> dict[str, str]:
    """Headers that name a parameter; of several for one parameter all are kept."""
    return {h: p for h in headers if (p := header_parameter(h, strict))}


def raw_parameter(name: Column) -> Column:
    """The canonical parameter of a raw name by the ordered patterns; a trailing ``(...)`` is dropped."""
    cleaned = F.trim(F.regexp_replace(F.trim(name), r"\s*\(.*?\)\s*$", ""))
    found = [F.when(cleaned.rlike(f"(?i){p}"), parameter) for p, parameter in schema.PARAMETER_PATTERNS]
    return F.coalesce(*found)


def station_name(name: Column) -> Column:
    """White space squeezed, words in title case but upper-case words of up to four letters."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    capital = lambda w: w.rlike(r"\p{L}") & (F.upper(w) == w) & (F.length(w) <= 4)
    return F.array_join(F.transform(words, lambda w: F.when(capital(w), w).otherwise(title(w))), " ")


def title(text: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), ""
    )


def comparable_name(name: Column) -> Column:
    """A station's name as it is compared: no stop terms, letters and digits only."""
    s = F.regexp_replace(F.lower(F.trim(name)), STOP_TERMS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]", ""), r"\s+", " "))


def state_name(state: Column) -> Column:
    return F.coalesce(_lookup(schema.STATES, F.lower(F.trim(state))), title(F.trim(state)))


def word_set(name: Column) -> Column:
    """The distinct words of a name; none if it is empty."""
    return F.filter(F.array_distinct(F.split(F.trim(name), r"\s+")), lambda w: w != "")


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard index of two arrays of distinct words; 0 if either is empty."""
    same = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(same / (F.size(x) + F.size(y) - same))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the words of two names; 0 if either is empty."""
    return set_similarity(word_set(a), word_set(b))


def unit_name(unit: Column) -> Column:
    """The canonical unit; unknown ones are trimmed."""
    return F.coalesce(_lookup(schema.UNIT_ALIASES, F.regexp_replace(F.lower(unit), r"\s+", "")), F.trim(unit))


def station_id(value: Column) -> Column:
    """Numbers without decimals as whole numbers, other ids as trimmed text."""
    return F.coalesce(F.trim(value).try_cast("double").try_cast("long").cast("string"), F.trim(value))


def river_of(name: Column) -> Column:
    """The river of a station's name: the first pattern, else the first place, else the default."""
    s = F.lower(name)
    found = [F.when(s.rlike(p), river) for p, river in schema.RIVER_PATTERNS]
    found += [F.when(F.contains(s, F.lit(place)), river) for place, river in schema.RIVER_PLACES.items()]
    return F.coalesce(*found, F.lit(schema.RIVER_DEFAULT))


def known_river(name: Column, rivers: list[str]) -> Column:
    """The first of the ordered ``rivers`` that a name holds."""
    return F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(r.lower())), r) for r in rivers])


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def default_unit(parameter: Column) -> Column:
    return F.coalesce(_lookup({p: u for p, (_, _, u) in schema.RECORD_PARAMETERS.items()}, parameter), F.lit(""))


def slug(text: Column, most: int = 80) -> Column:
    """A file name: lower case, runs of other characters than letters and digits as one underscore."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of ``keywords`` a text holds."""
    return sum((F.contains(F.lower(text), F.lit(k)).cast("int") for k in keywords), F.lit(0))


def row_similarity(a: Column, b: Column) -> Column:
    """Share of places where one of two cells holds the other, of the shorter row's places."""
    n = F.least(F.size(a), F.size(b))
    same = F.filter(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.contains(F.lower(x), F.lower(y)) | F.contains(F.lower(y), F.lower(x))),
        lambda hit: hit,
    )
    return F.when(n > 0, F.size(same) / n).otherwise(0.0)


def is_number_name(name: Column) -> Column:
    """Whether a name has digits only."""
    return F.coalesce(name.rlike(r"^\d+$"), F.lit(False))


def edge_class(parent: Column, child: Column, groups: dict[str, list[str]]) -> Column:
    """How an edge joins groups of names: ``a→b``, or Other if an end is in none."""
    group = lambda c: F.coalesce(*[F.when(c.isin(names), name) for name, names in groups.items()])
    return F.coalesce(F.concat(group(parent), F.lit("→"), group(child)), F.lit("Other"))
