"""Map tags (each a list of values) to canonical edge attributes.

A list is resolved to its worst value; evidence that is absent stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfree.functions.labels import lookup

PRESENT, ABSENT, UNKNOWN = "present", "absent", "unknown"
# fixed values: tiers, worst first
TIERS = ["poor", "fair", "good"]
# fixed values: width classes, narrowest first
WIDTHS = ["under_50cm", "50_to_90cm", "over_90cm"]
WIDTH_CUTS_M = (0.5, 0.9)
# fixed values: surface and smoothness values by tier
SURFACE_TIER = {
    "asphalt": "good", "concrete": "good", "paving_stones": "good", "paved": "good",
    "sett": "fair", "compacted": "fair", "fine_gravel": "fair",
    "cobblestone": "poor", "unpaved": "poor", "dirt": "poor", "ground": "poor", "gravel": "poor", "grass": "poor", "sand": "poor", "earth": "poor",
}
SMOOTHNESS_TIER = {
    "excellent": "good", "good": "good", "intermediate": "fair",
    "bad": "poor", "very_bad": "poor", "horrible": "poor", "very_horrible": "poor", "impassable": "poor",
}
# fixed values: kinds of ways without steps
BENIGN_HIGHWAYS = ["footway", "path", "pedestrian", "residential", "living_street"]
# fixed values: map tags read from ways
WAY_TAGS = ["surface", "smoothness", "width", "kerb", "tactile_paving", "incline", "lit", "handrail", "ramp", "step_count", "wheelchair", "barrier", "footway", "highway"]
# fixed values: map tags read from nodes
NODE_TAGS = ["crossing", "tactile_paving", "kerb", "barrier", "wheelchair", "highway"]


def values(tags: Column, name: str) -> Column:
    """The values of a tag; null if the tag is missing or its list is empty."""
    v = F.try_element_at(tags, F.lit(name))
    return F.when(F.size(v) > 0, v)


def first_tag(name: str, *owners: Column) -> Column:
    """The values at the first owner that has any."""
    return F.coalesce(*[values(o, name) for o in owners])


def _worst(found: Column, table: dict[str, str], order: list[str]) -> Column:
    ranks = F.array_min(F.transform(found, lambda v: lookup(v, {k: order.index(t) for k, t in table.items()})))
    return F.coalesce(*[F.when(ranks == i, t) for i, t in enumerate(order)])


def width_bucket(metres: Column) -> Column:
    low, high = WIDTH_CUTS_M
    return F.when(metres < low, WIDTHS[0]).when(metres < high, WIDTHS[1]).when(metres.isNotNull(), WIDTHS[2])


def _yes_no(found: Column) -> Column:
    return F.when(F.array_contains(found, "no"), ABSENT).when(F.array_contains(found, "yes"), PRESENT)


def canonical(edge: Column, u: Column, v: Column) -> dict[str, Column]:
    """The nine attributes from the tags of an edge and of its two nodes."""
    kerb, highway = first_tag("kerb", edge, u, v), values(edge, "highway")
    number = F.transform(values(edge, "width"), lambda w: w.try_cast("double"))
    return {
        "tactile_paving_present": _yes_no(first_tag("tactile_paving", edge, u, v)),
        "handrail_present": _yes_no(values(edge, "handrail")),
        "ramp_present": F.when(F.array_contains(kerb, "raised"), ABSENT).when(F.arrays_overlap(kerb, F.array(F.lit("lowered"), F.lit("flush"))), PRESENT),
        "marked_crossing_present": F.when(first_tag("crossing", edge, u, v).isNotNull(), PRESENT),
        "steps_present": F.when(F.array_contains(highway, "steps"), PRESENT).when(F.forall(highway, lambda h: h.isin(BENIGN_HIGHWAYS)), ABSENT),
        "fixed_obstacle_present": F.when(first_tag("barrier", edge, u, v).isNotNull(), PRESENT),
        "surface_material_tier": _worst(values(edge, "surface"), SURFACE_TIER, TIERS),
        "smoothness_tier": _worst(values(edge, "smoothness"), SMOOTHNESS_TIER, TIERS),
        "width_bucket": width_bucket(F.array_min(F.filter(number, lambda w: w.isNotNull() & ~F.isnan(w)))),
    }
