"""What an edge costs to travel, as column expressions over a configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfree.functions.tags import PRESENT


@dataclass(frozen=True)
class CostConfig:
    good: float = 1.0
    fair: float = 1.15
    poor: float = 1.4
    flat_grade: float = 0.03
    steep_grade: float = 0.0833
    steep_factor: float = 1.5
    per_grade: float = 8.0
    cap: float = 2.3
    ramp_discount: float = 0.8
    obstacle_penalty: float = 25.0
    steps_penalty: float = 500.0
    protect_slope: bool = True


def as_number(value: Column, default: float) -> Column:
    """A double; the default for null and unreadable text, NaN stays."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def surface_factor(tier: Column, c: CostConfig = CostConfig()) -> Column:
    return F.when(tier == "good", c.good).when(tier == "poor", c.poor).otherwise(c.fair)


def slope_factor(grade: Column, c: CostConfig = CostConfig()) -> Column:
    ramp = 1 + (grade - c.flat_grade) / (c.steep_grade - c.flat_grade) * (c.steep_factor - 1)
    beyond = F.least(c.steep_factor + c.per_grade * (grade - c.steep_grade), F.lit(c.cap))
    return F.when(grade <= c.flat_grade, 1.0).when(grade <= c.steep_grade, ramp).otherwise(beyond)


def ramp_factor(ramp: Column, imputed: Column, discount: Column) -> Column:
    """The discount only for a ramp that is known: a null flag gives none."""
    return F.when((ramp == PRESENT) & (imputed == False), discount).otherwise(1.0)  # noqa: E712


def edge_cost(discount: Column | None = None, obstacle: Column | None = None, c: CostConfig = CostConfig()) -> Column:
    """Cost of a row with length, grade_abs, surface_material_tier, ramp_present,
    ramp_present_imputed, fixed_obstacle_present and steps_present. Unknown hazards
    cost nothing; missing lengths and grades count as 0."""
    length, grade = as_number(F.col("length"), 0.0), as_number(F.col("grade_abs"), 0.0)
    surface, slope = surface_factor(F.col("surface_material_tier"), c), slope_factor(grade, c)
    ramp = ramp_factor(F.col("ramp_present"), F.col("ramp_present_imputed"), F.lit(c.ramp_discount) if discount is None else discount)
    travel = length * surface * (ramp + slope - 1) if c.protect_slope else ramp * length * surface * slope
    hazard = F.when(F.col("fixed_obstacle_present") == PRESENT, F.lit(c.obstacle_penalty) if obstacle is None else obstacle).otherwise(0.0)
    return travel + hazard + F.when(F.col("steps_present") == PRESENT, c.steps_penalty).otherwise(0.0)
