"""The vocabulary of road tags by dimension, and its codes, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import tags

#: The dimensions, and the tags of each in the order of their codes from 1.
TAXONOMY = {
    "Operational Scenario": ["Intersections", "Roundabouts", "Ramps / Merges", "At-Grade Rail Crossings", "Tolling Stations", "Work Zones", "Managed Lanes", "General Roadway Segments"],
    "Roadway Context & Facility Type": ["Freeway/Expressway", "Arterial Roadway", "Collector Roadway", "Local Street / Road", "Urban", "Rural"],
    "Roadway Surface Type": ["Paved - bituminous / asphalt", "Paved - non-bituminous / concrete", "Unpaved", "Undetermined"],
    "Pavement Marking Type & Configuration": ["Solid Line", "Dashed Line", "Double Line", "Edge Line", "Curved Line", "Gore Markings", "Crosswalks", "Arrows", "Unmarked Pavement"],
    "Observed Marking Visibility": ["Clearly Visible", "Faded / Worn / Not Visible", "Low Contrast", "Partially Missing", "Occluded", "Not Applicable"],
    "Lighting & Weather": ["Daylight", "Nighttime", "Dusk / Dawn", "Shadow", "Glare", "Rain", "Fog", "Snow", "Wet Pavement", "Icy Road"],
}
#: Short names of the dimensions.
KEYS = {
    "Operational Scenario": "op_scenario",
    "Roadway Context & Facility Type": "context",
    "Roadway Surface Type": "surface",
    "Pavement Marking Type & Configuration": "marking",
    "Observed Marking Visibility": "visibility",
    "Lighting & Weather": "lighting_weather",
}
#: The code of a dimension without a tag.
NONE = 0


def _words(names: Sequence[str]) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def every(taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> list[str]:
    """All tags; the place of a tag, from 1, is its number."""
    return [t for names in taxonomy.values() for t in names]


def problems(taxonomy: Mapping[str, Sequence[str]], definitions: Mapping[str, Sequence[str]]) -> list[str]:
    """How ``definitions`` differs from ``taxonomy``, and tags that repeat; empty if it does not."""
    out = [f"missing dimension: {d}" for d in taxonomy if d not in definitions] + [f"extra dimension: {d}" for d in definitions if d not in taxonomy]
    for d, names in taxonomy.items():
        own = set(definitions.get(d, names))
        out += [f"[{d}] tag without a definition: {t}" for t in names if t not in own] + [f"[{d}] definition without a tag: {t}" for t in sorted(own - set(names))]
    words = every(taxonomy)
    return out + [f"repeated tag: {t}" for t in dict.fromkeys(words) if words.count(t) > 1]


def codes(labels: Column, names: Sequence[str]) -> Column:
    """The codes of one dimension's tags that ``labels`` has, ascending; null lists have none."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags(labels), lambda t: F.array_position(_words(names), t).cast("int")), lambda c: c > 0)))


def primary(labels: Column, names: Sequence[str]) -> Column:
    """The first of them, or ``NONE``."""
    return F.coalesce(F.array_min(codes(labels, names)), F.lit(NONE))


def encoded(labels: Column, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY, keys: Mapping[str, str] = KEYS) -> Column:
    """A struct of ``codes`` and ``primary`` by the dimensions' short names, and ``multi_hot``,
    0 or 1 for each tag."""
    own = tags(labels)
    return F.struct(
        F.struct(*[codes(own, names).alias(keys[d]) for d, names in taxonomy.items()]).alias("codes"),
        F.struct(*[primary(own, names).alias(keys[d]) for d, names in taxonomy.items()]).alias("primary"),
        F.transform(_words(every(taxonomy)), lambda t: F.array_contains(own, t).cast("int")).alias("multi_hot"),
    )


def decoded(multi_hot: Column, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> Column:
    """The tags of a ``multi_hot`` vector, in the taxonomy's order; null for a vector of another
    length."""
    words = every(taxonomy)
    kept = F.filter(F.zip_with(multi_hot, _words(words), lambda on, t: F.when(on != 0, t)), lambda t: t.isNotNull())
    return F.when(F.size(multi_hot) == len(words), kept)


def from_codes(found: Column, names: Sequence[str]) -> Column:
    """The tags of a dimension's codes; codes that it does not have give nothing."""
    return F.array_compact(F.transform(found, lambda c: F.get(_words(names), c - 1)))


def unknown(labels: Column, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> Column:
    """The labels that are no tags, each once, in order of appearance."""
    return F.array_except(tags(labels), _words(every(taxonomy)))
