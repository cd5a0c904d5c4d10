import math

import pytest
from pyspark.sql import functions as F

from stepfree.functions import cost, geo, tags, vision
from stepfree.functions.polygon import shoelace_area, valid_points
from stepfree.functions.stats import fixed, wilcoxon
from stepfree.functions.text import class_key, clean_split
from stepfree.operators import metrics as M


def one(spark, column, **values):
    fields = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], fields)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("grade", "factor"), [(0.0, 1.0), (0.03, 1.0), (0.05, 1 + 0.02 / 0.0533 * 0.5), (0.0833, 1.5), (0.0933, 1.58), (0.1833, 2.3), (0.5, 2.3)]
)
def test_slope_factor(spark, grade, factor):
    assert math.isclose(one(spark, cost.slope_factor(F.col("g")), g=("double", grade)), factor, rel_tol=1e-9)


@pytest.mark.parametrize(("ramp", "imputed", "factor"), [("present", False, 0.8), ("present", True, 1.0), ("present", None, 1.0), ("absent", False, 1.0), (None, False, 1.0)])
def test_ramp_factor_needs_a_known_ramp(spark, ramp, imputed, factor):
    assert one(spark, cost.ramp_factor(F.col("r"), F.col("i"), F.lit(0.8)), r=("string", ramp), i=("boolean", imputed)) == factor


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((100.0, 0.0, "good", "absent", True, "unknown", "unknown"), 100.0),
        ((100.0, 0.0, None, "present", False, "present", "absent"), 100 * 1.15 * 0.8 + 25),
        ((100.0, None, "poor", "absent", True, "absent", "present"), 140.0 + 500),
        ((None, 0.5, "good", "absent", True, "unknown", "unknown"), 0.0),
    ],
)
def test_edge_cost(spark, row, want):
    shape = "length double, grade_abs double, surface_material_tier string, ramp_present string, ramp_present_imputed boolean, fixed_obstacle_present string, steps_present string"
    assert math.isclose(spark.createDataFrame([row], shape).select(cost.edge_cost()).first()[0], want)


def test_an_unprotected_slope_is_discounted_too(spark):
    shape = "length double, grade_abs double, surface_material_tier string, ramp_present string, ramp_present_imputed boolean, fixed_obstacle_present string, steps_present string"
    df = spark.createDataFrame([(10.0, 0.0833, "good", "present", False, "unknown", "unknown")], shape)
    a, b = df.select(cost.edge_cost(), cost.edge_cost(c=cost.CostConfig(protect_slope=False))).first()
    assert math.isclose(a, 10 * (0.8 + 0.5)) and math.isclose(b, 10 * 0.8 * 1.5)


MAP = "map<string,array<string>>"


@pytest.mark.parametrize(
    ("edge", "node", "want"),
    [
        ({"surface": ["asphalt", "gravel"], "width": ["1,5", "0.8", "2"]}, None, {"surface_material_tier": "poor", "width_bucket": "50_to_90cm"}),
        ({"surface": ["lava"], "width": ["narrow"]}, {}, {"surface_material_tier": None, "width_bucket": None}),
        ({"highway": ["footway", "steps"], "kerb": []}, {"kerb": ["raised"]}, {"steps_present": "present", "ramp_present": "absent"}),
        ({"highway": ["path"]}, {"kerb": ["lowered"], "crossing": ["no"]}, {"steps_present": "absent", "ramp_present": "present", "marked_crossing_present": "present"}),
        ({"highway": ["path", "service"], "tactile_paving": ["yes", "no"]}, {"barrier": ["bollard"]}, {"steps_present": None, "tactile_paving_present": "absent", "fixed_obstacle_present": "present"}),
        (None, None, {"surface_material_tier": None, "steps_present": None, "handrail_present": None}),
    ],
)
def test_canonical_tags(spark, edge, node, want):
    df = spark.createDataFrame([(edge, node, None)], f"e {MAP}, n {MAP}, m {MAP}")
    got = df.select(*[c.alias(n) for n, c in tags.canonical(F.col("e"), F.col("m"), F.col("n")).items()]).first().asDict()
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    ("poly", "area"),
    [(None, None), ([], 0.0), ([[0.0, 0.0], [1.0, 1.0]], 0.0), ([[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]], 12.0), ([[0.0, 0.0], [], None, [4.0, 0.0], [1.0, 1.0, 1.0], [0.0, 3.0]], 6.0)],
)
def test_area(spark, poly, area):
    assert one(spark, shoelace_area(valid_points(F.col("p"))), p=("array<array<double>>", poly)) == area


@pytest.mark.parametrize(("label", "key"), [("Crosswalk - Plain", "crosswalk-plain"), (" Traffic Sign (Back) ", "traffic-sign-back"), ("", ""), ("--", ""), (None, None)])
def test_class_key(spark, label, key):
    assert one(spark, class_key(F.col("s")), s=("string", label)) == key


@pytest.mark.parametrize(("split", "want"), [(" Validation ", "val"), ("TRAIN", "train"), ("  ", None), (None, None)])
def test_clean_split(spark, split, want):
    assert one(spark, clean_split(F.col("s")), s=("string", split)) == want


def test_widths(spark):
    h = F.lit(720)
    assert one(spark, vision.ground_distance_m(F.col("y"), h), y=("double", 360.0)) is None
    f = 360 / math.tan(math.radians(32.5))
    assert math.isclose(one(spark, vision.ground_distance_m(F.col("y"), h), y=("double", 700.0)), 1.5 / (340 / f))
    wide = [[0.0, 700.0], [1000.0, 700.0], [500.0, 500.0]]
    assert one(spark, vision.pinhole_width(F.col("p"), h), p=("array<array<double>>", wide)) == "over_90cm"
    assert one(spark, vision.pinhole_width(F.col("p"), h), p=("array<array<double>>", wide[:2])) is None
    kerb = [[0.0, 1.0], [0.0, 2.0]]
    assert one(spark, vision.kerb_width(F.col("p"), F.col("c"), h), p=("array<array<double>>", wide), c=("array<array<double>>", kerb)) is None


def test_projection_goes_there_and_back(spark):
    df = spark.createDataFrame([(-19.93, -43.94), (0.0001, -0.0001), (67.18, -12.04), (-16.4, 180.0), (None, 1.0)], "lat double, lon double")
    at = geo.add_projection(df, "lat", "lon").withColumnsRenamed({"lat": "a", "lon": "b"})
    for r in spark.sql(geo.unprojected("{at}", "east", "north", "zone"), at=at).collect():
        if r.a is None:
            assert r.east is None
        else:
            assert abs(r.lat - r.a) < 1e-9 and abs(r.lon - r.b) < 1e-9
    known = geo.add_projection(spark.createDataFrame([(0.0, -45.0)], "lat double, lon double"), "lat", "lon").first()
    assert known.zone == -45 and abs(known.east - 500_000) < 1e-6 and abs(known.north - 10_000_000) < 1e-6


def test_fixed_rounds_half_up_without_negative_zero(spark):
    got = [one(spark, fixed(F.col("x"), 2), x=("double", v)) for v in (0.125, 2.675, -0.0, -0.001)]
    assert got[0] == 0.13 and str(got[2]) == "0.0" and str(got[3]) == "0.0"


def test_wilcoxon_by_hand(spark):
    rows = [("a", x, y) for x, y in [(1.0, 2.0), (2.0, 2.0), (5.0, 3.0), (9.0, 5.0), (4.0, 5.0)]] + [("b", 1.0, 1.0 + 1e-12)]
    got = {r.g: r for r in wilcoxon(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["a"].n == 4 and got["a"].statistic == 3.0 and 0.4 < got["a"].p < 1
    assert got["b"].statistic is None and got["b"].p is None
    assert wilcoxon(spark.createDataFrame([], "g string, x double, y double"), "x", "y", ["g"]).count() == 0


@pytest.mark.parametrize(
    ("delta", "margin", "want"),
    [((0, 0, 0, -5.0), 5.0, "improvement"), ((0, 0, 0, -4.99), 5.0, "neutral"), ((0, 0, 0, 5.0), 5.0, "regression"), ((0, 0, 0, 0.0), 0.0, "neutral"), ((0, 0, 0, 0.01), 0.0, "regression"),
     ((-1, 1, 0, 0.0), 5.0, "mixed"), ((-1, 0, 0, 4.0), 5.0, "improvement")],
)
def test_verdicts(spark, delta, margin, want):
    df = spark.createDataFrame([(0, 0, 0, 10.0, *delta[:3], 10.0 + delta[3])], "steps_base int, obstacles_base int, curb_barriers_base int, high_grade_len_base double, steps_full int, obstacles_full int, curb_barriers_full int, high_grade_len_full double")
    assert df.select(M.verdict(M.signs(margin))).first()[0] == want
