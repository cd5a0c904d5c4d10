"""Detection classes: what they are mapped to, and their weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfree.functions.text import class_key

# fixed values: output classes, in their order
CLASSES = ["street", "sidewalk", "curb", "crossing", "steps", "ramp", "handrail", "tactile_paving", "lighting", "surface_obstacle"]
# fixed values: class keys of the segmentation model to output classes
CLASS_OF_KEY = {
    "road": "street",
    "service-lane": "street",
    "bike-lane": "street",
    "lane-marking-general": "street",
    "sidewalk": "sidewalk",
    "pedestrian-area": "sidewalk",
    "curb": "curb",
    "curb-cut": "ramp",
    "crosswalk-plain": "crossing",
    "lane-marking-crosswalk": "crossing",
    "street-light": "lighting",
    "utility-pole": "lighting",
    "bench": "surface_obstacle",
    "bike-rack": "surface_obstacle",
    "fire-hydrant": "surface_obstacle",
    "mailbox": "surface_obstacle",
    "manhole": "surface_obstacle",
    "phone-booth": "surface_obstacle",
    "pothole": "surface_obstacle",
    "trash-can": "surface_obstacle",
    "barrier": "surface_obstacle",
}
# fixed values: weight of a class in the barrier score
BARRIER_WEIGHT = {
    "street": 0.20,
    "sidewalk": -0.15,
    "curb": 0.55,
    "crossing": -0.20,
    "steps": 0.95,
    "ramp": -0.40,
    "handrail": -0.25,
    "tactile_paving": -0.30,
    "lighting": -0.10,
    "surface_obstacle": 0.65,
}
# fixed values: class keys that are evidence for an edge attribute (barrier is not)
EVIDENCE_OF_KEY = {
    "curb-cut": "ramp_present",
    "crosswalk-plain": "marked_crossing_present",
    "lane-marking-crosswalk": "marked_crossing_present",
    "bench": "fixed_obstacle_present",
    "bike-rack": "fixed_obstacle_present",
    "fire-hydrant": "fixed_obstacle_present",
    "mailbox": "fixed_obstacle_present",
    "manhole": "fixed_obstacle_present",
    "phone-booth": "fixed_obstacle_present",
    "pothole": "fixed_obstacle_present",
    "trash-can": "fixed_obstacle_present",
}


def lookup(key: Column, table: dict) -> Column:
    """Value of a literal map, null for unknown and null keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def output_class(label: Column) -> Column:
    return lookup(class_key(label), CLASS_OF_KEY)


def evidence_attribute(label: Column) -> Column:
    return lookup(class_key(label), EVIDENCE_OF_KEY)
