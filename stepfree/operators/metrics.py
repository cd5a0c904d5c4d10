"""What routes pass, how conditions differ, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfree.functions.stats import fair_draw, fixed, running_totals, units, wilcoxon

GRADE_MARGIN_M = 5.0
STEEP = 0.0833
AXES = ["steps", "obstacles", "curb_barriers", "high_grade_len"]


def hazards(routes: DataFrame, truth: DataFrame, steep: float = STEEP) -> DataFrame:
    """(condition, cfg_id, pair_id, cost, nodes, steps, obstacles, curb_barriers,
    high_grade_len, ramp_access) against validated edges; a route without edges
    has zeros."""
    gt = truth.select(
        "u", "v", "k",
        ((F.col("steps_present") == "present") & (F.col("steps_present_source") == "osm")).cast("int").alias("a"),
        (F.col("fixed_obstacle_present_validated_value") == "present").cast("int").alias("b"),
        (F.col("ramp_present_validated_value") == "absent").cast("int").alias("c"),
        (F.col("ramp_present_validated_value") == "present").cast("int").alias("r"),
        F.when(F.col("grade_abs") > steep, units(F.col("length"))).alias("g"),
    )
    key = ["condition", "cfg_id", "pair_id"]
    steps = routes.select(*key, F.explode("edge_keys").alias("e")).select(*key, "e.*").join(gt, ["u", "v", "k"])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = steps.groupBy(*key).agg(
        zero("a").alias("steps"), zero("b").alias("obstacles"), zero("c").alias("curb_barriers"), (zero("g") / 1e6).alias("high_grade_len"), zero("r").alias("ramp_access")
    )
    out = routes.select(*key, "cost", "nodes").join(sums, key, "left")
    return out.select(*key, "cost", "nodes", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*AXES, "ramp_access")])


def signs(margin: Column | float = GRADE_MARGIN_M) -> list[Column]:
    """Per axis -1 better, 0 tie, 1 worse; differences of steep length below the
    margin tie, a margin of 0 compares exactly."""
    delta = {a: F.col(f"{a}_full") - F.col(f"{a}_base") for a in AXES}
    steep = F.when(F.abs(delta["high_grade_len"]) < margin, 0).otherwise(F.signum(delta["high_grade_len"]))
    return [*[F.signum(delta[a]).cast("int") for a in AXES[:3]], steep.cast("int")]


def verdict(s: list[Column]) -> Column:
    better, worse = F.least(*s) < 0, F.greatest(*s) > 0
    return F.when(better & ~worse, "improvement").when(worse & ~better, "regression").when(worse & better, "mixed").otherwise("neutral")


def paired(hz: DataFrame, base: str = "baseline") -> DataFrame:
    """Pairs solved under both conditions of the same setting's key: <axis>_base, <axis>_full, changed."""
    cols = [*AXES, "ramp_access", "cost", "nodes"]
    left = hz.where(F.col("condition") == base).select("cfg_id", "pair_id", *[F.col(c).alias(f"{c}_base") for c in cols])
    right = hz.where(F.col("condition") != base).select("condition", "cfg_id", "pair_id", *[F.col(c).alias(f"{c}_full") for c in cols])
    both = right.join(left, ["cfg_id", "pair_id"])
    return both.withColumn("changed", F.col("nodes_base") != F.col("nodes_full")).drop("nodes_base", "nodes_full")


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def compare(pairs: DataFrame, by: list[str], margin: Column | float = GRADE_MARGIN_M) -> DataFrame:
    """One row per `by`: counts, rates (0 for nothing), sums per axis, causes of
    regressions, medians and means."""
    s = signs(margin)
    rows = pairs.withColumn("label", F.when(F.col("changed"), verdict(s))).withColumns({f"worse_{a}": (F.col("label") == "regression") & (c > 0) for a, c in zip(AXES, s)})
    hit = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    delta = F.col("obstacles_full") - F.col("obstacles_base")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_solved"), hit(F.col("changed")).alias("n_differ"),
        *[hit(F.col("label") == k).alias(f"n_{k}") for k in ("improvement", "regression", "neutral", "mixed")],
        *[F.sum(f"{a}_{w}").alias(f"{a}_{w}") for a in [*AXES[:3], "ramp_access"] for w in ("base", "full")],
        *[(F.sum(units(F.col(f"high_grade_len_{w}"))) / 1e6).alias(f"high_grade_len_{w}") for w in ("base", "full")],
        *[hit(F.col(f"worse_{a}")).alias(f"regressed_by_{a}") for a in AXES],
        *[F.coalesce(F.median(f"cost_{w}"), F.lit(0.0)).alias(f"median_cost_{w}") for w in ("base", "full")],
        hit(delta < 0).alias("n_fewer_obstacles"), hit(delta > 0).alias("n_more_obstacles"),
    )
    n, d = F.col("n_solved"), F.col("n_differ")
    return out.withColumns({
        "n_unchanged": n - d, "route_diff_rate": _rate(d, n), "improvement_rate_of_differ": _rate(F.col("n_improvement"), d),
        "improvement_rate_of_all": _rate(F.col("n_improvement"), n), "net_improvement": F.col("n_improvement") - F.col("n_regression"),
        "net_improvement_rate_of_all": _rate(F.col("n_improvement") - F.col("n_regression"), n),
        "mean_ramp_access_base": _rate(F.col("ramp_access_base"), n), "mean_ramp_access_full": _rate(F.col("ramp_access_full"), n),
    })


def cost_test(pairs: DataFrame, by: list[str], axis: str = "cost") -> DataFrame:
    return wilcoxon(pairs, f"{axis}_base", f"{axis}_full", by)


def with_tests(compared: DataFrame, pairs: DataFrame, by: list[str], reps: int = 2000) -> DataFrame:
    """`compare`'s rows with bootstrap intervals of the rates of changed routes and of
    improvements among them (0, 0 for nothing), and Wilcoxon tests of the paired
    costs and obstacles (null where no pair differs)."""
    flags = pairs.select(*by, F.col("changed").cast("int").alias("changed"), F.when(F.col("changed"), (verdict(signs()) == "improvement").cast("int")).alias("improved"))
    out = compared
    for flag, rate in (("changed", "route_diff_rate"), ("improved", "improvement_rate_of_differ")):
        ci = bootstrap(flags.select(*by, F.col(flag).alias("flag")), by, reps)
        out = out.join(ci.select(*by, F.col("lo").alias(f"{rate}_lo"), F.col("hi").alias(f"{rate}_hi")), by, "left")
    cost, stops = cost_test(pairs, by), cost_test(pairs, by, "obstacles")
    out = out.join(cost.select(*by, F.col("statistic").cast("double").alias("wilcoxon_stat"), F.col("p").alias("wilcoxon_p")), by, "left")
    return out.join(stops.select(*by, F.col("p").alias("obstacle_wilcoxon_p")), by, "left")


def bootstrap(flags: DataFrame, by: list[str], reps: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(by..., lo, hi): percentile interval of the mean of 0/1 `flag`, from `reps`
    resamples. A resample only needs how many of its draws fall below the number of
    ones, so nothing is joined back. Groups without rows have (0, 0)."""
    known = flags.groupBy(*by).agg(F.count("flag").alias("m"), F.sum("flag").alias("ones"))
    grown = known.where("m > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    draw = fair_draw(F.col("m"), F.lit(str(seed)), F.col("rep").cast("string"), F.col("j").cast("string"))
    means = grown.groupBy(*by, "rep", "m").agg((F.sum((draw < F.col("ones")).cast("int")) / F.col("m")).alias("mean"))
    ranked = means.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("mean", "rep")) - 1)
    low, high = int(alpha / 2 * reps), min(int((1 - alpha / 2) * reps), reps - 1)
    picked = ranked.groupBy(*by).agg(F.max(F.when(F.col("r") == low, F.col("mean"))).alias("lo"), F.max(F.when(F.col("r") == high, F.col("mean"))).alias("hi"))
    return known.select(*by).join(picked, by, "left").select(*by, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, share): the empirical distribution at every different value:
    counted first, so the running total goes over values and not over rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    return running_totals(counts, by, value, "_n", "_upto").join(total, by).select(*by, value, (F.col("_upto") / F.col("_all")).alias("share"))


def element_at_share(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by..., value): the sorted element with index floor(share * (n - 1))."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    at = counts.groupBy(*by).agg(F.floor(share * (F.sum("_n") - 1)).alias("_at"))
    placed = running_totals(counts, by, value, "_n", "_upto").join(at, by)
    return placed.where(F.col("_upto") > F.col("_at")).groupBy(*by).agg(F.min(value).alias(value))


def mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., mean, sd, least, most) with the population deviation."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(*by, *[fixed(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("mean", "sd", "least", "most")])


def impedance_ratio(cost: Column, length: Column) -> Column:
    """cost / length; 1 for no length, and a missing cost counts as the length."""
    return F.when(F.coalesce(length, F.lit(0.0)) == 0, 1.0).otherwise(F.coalesce(cost, length) / length)


def results_json(compared: DataFrame) -> DataFrame:
    """(condition, document): the nested result of a condition as JSON."""
    return compared.select("condition", F.to_json(F.struct(
        "n_solved", "n_unchanged", "n_differ", "route_diff_rate",
        F.struct(*[F.col(f"n_{k}").alias(k) for k in ("improvement", "regression", "neutral", "mixed")]).alias("classification"),
        "net_improvement", "net_improvement_rate_of_all", "improvement_rate_of_differ", "improvement_rate_of_all",
        F.struct(*[F.col(f"regressed_by_{a}").alias(a) for a in AXES]).alias("regression_causes"), "median_cost_base", "median_cost_full",
        F.struct(*[f"{a}_{w}" for a in (*AXES, "ramp_access") for w in ("base", "full")]).alias("aggregate_magnitude"),
        F.array("route_diff_rate_lo", "route_diff_rate_hi").alias("route_diff_ci95"),
        F.array("improvement_rate_of_differ_lo", "improvement_rate_of_differ_hi").alias("improvement_rate_of_differ_ci95"),
        "wilcoxon_stat", "wilcoxon_p", "obstacle_wilcoxon_p",
    ), {"ignoreNullFields": "false"}).alias("document"))
