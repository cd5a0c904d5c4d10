"""Queries over routes, samples, statistics, rasters and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions.cost import CostConfig, slope_factor
from stepfree.functions.geo import add_projection, projected, zone_meridian
from stepfree.functions.stats import erfc_sql, fixed, wilcoxon
from stepfree.operators import metrics as M
from stepfree.operators import network as N
from stepfree.operators import raster as R
from stepfree.operators import routing, sampling, snapshots
from stepfree.operators.audit import ledger
from stepfree.plans import street as S
from stepfree.plans.street import _EDGES, _LABELS, _ONE, _SLOPE, _costed, _fix
from stepfree.session import cut, table

PAIRS, REPS = 1000, 2000
SEEDS = list(range(1, 11))
MARGINS, STEEPS = [0.0, 5.0, 10.0, 20.0], [0.05, 0.0833, 0.12]


def _parallel(rows: DataFrame) -> DataFrame:
    """The cheapest of parallel edges; costs to six digits, so that they add up alike everywhere."""
    return cut(N.parallel_min(rows.withColumn("cost", fixed(F.col("cost")))))


def od_sample(s: SparkSession, d: str) -> DataFrame:
    p = sampling.od_pairs(S.nodes(s, d), PAIRS)
    return p.select("seed", "pair_id", "o", "d", fixed(F.col("dist"), 3).alias("dist"), "band")


def _routed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, routes, validated edges): the edges are fused once, for the costs and as truth."""
    truth = cut(S.validated(s, d))
    pairs = cut(sampling.od_pairs(S.nodes(s, d), PAIRS))
    return pairs, cut(routing.routes(_parallel(N.condition_edges(truth)), pairs.select("pair_id", "o", "d"))), truth


def _paired(s: SparkSession, d: str, steep: float = M.STEEP) -> DataFrame:
    _, r, truth = _routed(s, d)
    return M.paired(M.hazards(r, truth, steep))


def experiment(s: SparkSession, d: str, pairs: int = PAIRS, seed: int = 42, steep: float = M.STEEP) -> DataFrame:
    """(condition, document) of the comparison over `pairs` pairs drawn under `seed`."""
    truth = cut(S.validated(s, d))
    drawn = sampling.od_pairs(S.nodes(s, d), pairs, seeds=[seed]).select("pair_id", "o", "d")
    both = cut(M.paired(M.hazards(cut(routing.routes(_parallel(N.condition_edges(truth)), drawn)), truth, steep)))
    return M.results_json(M.with_tests(M.compare(both, ["condition"]), both, ["condition"]))


def shortest_routes(s: SparkSession, d: str) -> DataFrame:
    _, r, _ = _routed(s, d)
    return r.select("condition", "pair_id", F.size("edge_keys").alias("hops"), fixed(F.col("cost")).alias("cost"), F.array_join("nodes", ">").alias("path"))


def shortest_path_hops(s: SparkSession, d: str) -> DataFrame:
    """Least cost from every node to every node it reaches, under every condition."""
    out = routing.least_costs(_parallel(S.costed(s, d)), S.nodes(s, d).select(F.col("node_id").alias("o")))
    return out.select("condition", "o", "node", fixed(F.col("dist"), 4).alias("dist"))


def route_hazards(s: SparkSession, d: str) -> DataFrame:
    _, r, truth = _routed(s, d)
    return M.hazards(r, truth).drop("nodes").withColumn("cost", fixed(F.col("cost")))


def route_overlap(s: SparkSession, d: str) -> DataFrame:
    _, r, _ = _routed(s, d)
    return routing.overlap(r.where("condition = 'baseline'"), r.where("condition = 'full_validated'"))


def _compared(s: SparkSession, d: str) -> DataFrame:
    return M.compare(_paired(s, d), ["condition"])


def _tested(s: SparkSession, d: str) -> DataFrame:
    pairs = cut(_paired(s, d))
    return M.with_tests(M.compare(pairs, ["condition"]), pairs, ["condition"])


def compare_conditions(s: SparkSession, d: str) -> DataFrame:
    """Counts, rates with intervals, sums, and tests; p values as their logarithm."""
    done, log = _tested(s, d), {}
    for c in ("wilcoxon_p", "obstacle_wilcoxon_p"):
        log[f"{c}_log10"] = fixed(F.log10(c))
    real = [c for c, t in done.dtypes if t == "double"]
    return done.withColumns(log).withColumns({c: fixed(F.col(c)) for c in real}).drop("wilcoxon_p", "obstacle_wilcoxon_p")


def results_json(s: SparkSession, d: str) -> DataFrame:
    return M.results_json(_tested(s, d))


def detection_error_gap(s: SparkSession, d: str) -> DataFrame:
    c = _compared(s, d)
    rate = lambda k: F.max(F.when(F.col("condition") == k, F.col("improvement_rate_of_differ")))
    return c.agg(fixed(rate("full_validated") - rate("full_raw"), 9).alias("gap"))


_BRIEF = ["n_solved", "n_differ", "route_diff_rate", "improvement_rate_of_differ"]


def improvement_by_band(s: SparkSession, d: str) -> DataFrame:
    pairs, r, truth = _routed(s, d)
    both = M.paired(M.hazards(r, truth)).where("condition = 'full_validated'").join(pairs.select("pair_id", "band"), "pair_id")
    return M.compare(both, ["band"]).select("band", *_rounded(_BRIEF))


def _rounded(columns: list[str]) -> list[Column]:
    return [fixed(F.col(c), 9).alias(c) if "rate" in c else F.col(c) for c in columns]


def threshold_sensitivity(s: SparkSession, d: str) -> DataFrame:
    """Every margin and steepness over one set of routes: hazards are scored again, nothing is routed again."""
    _, r, truth = _routed(s, d)
    out = None
    for steep in STEEPS:
        rows = M.paired(M.hazards(r, truth, steep)).where("condition = 'full_validated'")
        rows = rows.withColumns({"steep": F.lit(steep), "margin": F.explode(F.array(*[F.lit(m) for m in MARGINS]))})
        out = rows if out is None else out.unionByName(rows)
    return M.compare(out, ["steep", "margin"], F.col("margin")).select("steep", "margin", *_rounded(_BRIEF))


def weight_sweep(s: SparkSession, d: str) -> DataFrame:
    """Three ramp discounts by three obstacle penalties: the settings are part of the
    routing key. The baseline has neither ramps nor obstacles, so its costs are the
    same under every setting; it is routed under the first and stands for all."""
    pairs = cut(sampling.od_pairs(S.nodes(s, d), PAIRS))
    truth = cut(S.validated(s, d))
    rows = N.condition_edges(truth, S.DISCOUNTS, S.PENALTIES).where("condition = 'full_validated' or condition = 'baseline' and cfg_id = 0")
    hz = cut(M.hazards(cut(routing.routes(_parallel(rows), pairs.select("pair_id", "o", "d"))), truth))
    every = F.explode(F.array(*[F.lit(i) for i in range(len(S.DISCOUNTS) * len(S.PENALTIES))]))
    hz = hz.where("condition <> 'baseline'").unionByName(hz.where("condition = 'baseline'").withColumn("cfg_id", every))
    done = M.compare(M.paired(hz), ["cfg_id"])
    return done.select("cfg_id", *_rounded([*_BRIEF, "improvement_rate_of_all"]))


def seed_stability(s: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the four headline figures over redrawn pairs; the seed is part of the pair."""
    drawn = sampling.od_pairs(S.nodes(s, d), PAIRS, seeds=SEEDS).withColumn("pair_id", F.col("pair_id") * 100 + F.col("seed"))
    pairs = cut(drawn)
    truth = cut(S.validated(s, d))
    parallel = _parallel(N.condition_edges(truth).where("condition in ('baseline', 'full_validated')"))
    r = cut(routing.routes(parallel, pairs.select("pair_id", "o", "d")))
    both = M.paired(M.hazards(r, truth)).join(pairs.select("pair_id", "seed"), "pair_id")
    done = M.compare(both, ["seed"]).withColumn("obstacles_avoided", F.col("obstacles_base") - F.col("obstacles_full"))
    all_seeds = s.range(min(SEEDS), max(SEEDS) + 1).select(F.col("id").cast("int").alias("seed"))
    kinds = ["route_diff_rate", "improvement_rate_of_differ", "net_improvement_rate_of_all", "obstacles_avoided"]
    cells = ", ".join(f"'{k}', cast(coalesce({k}, 0) as double)" for k in kinds)
    rates = all_seeds.join(done, "seed", "left").selectExpr(f"stack({len(kinds)}, {cells}) as (metric, value)")
    return M.mean_sd(rates, ["metric"], "value")


def slope_models(s: SparkSession, d: str) -> DataFrame:
    """The headline comparison when a ramp's discount may and may not offset a slope."""
    pairs = cut(sampling.od_pairs(S.nodes(s, d), PAIRS).select("pair_id", "o", "d"))
    truth, out = cut(S.validated(s, d)), None
    for name, protect in (("naive", False), ("protected", True)):
        rows = N.condition_edges(truth, config=CostConfig(protect_slope=protect)).where("condition in ('baseline', 'full_validated')")
        r = cut(routing.routes(_parallel(rows), pairs))
        part = M.compare(M.paired(M.hazards(r, truth)), ["condition"]).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "n_solved", "n_differ", "n_regression", *_rounded(["improvement_rate_of_differ"]))


def decomposition(s: SparkSession, d: str) -> DataFrame:
    """(condition, outcome, share): what became of all solved pairs, the data of the outcome figures."""
    c = _compared(s, d)
    kinds = ["unchanged", "improvement", "regression", "neutral", "mixed"]
    pairs = ", ".join(f"'{k}', n_{k}" for k in kinds)
    long = c.selectExpr("condition", "n_solved", f"stack({len(kinds)}, {pairs}) as (outcome, n)")
    return long.select("condition", "outcome", fixed(F.when(F.col("n_solved") > 0, F.col("n") / F.col("n_solved")).otherwise(0.0), 9).alias("share"))


def overlay_pair(s: SparkSession, d: str) -> DataFrame:
    """The first pair whose fully informed route meets strictly fewer obstacles."""
    better = _paired(s, d).where("condition = 'full_validated' and obstacles_full < obstacles_base")
    return better.agg(F.min(F.struct("pair_id", "obstacles_base", "obstacles_full")).alias("p")).where("p is not null").select("p.*")


def claims(s: SparkSession, d: str) -> DataFrame:
    """Figures that must hold for any input, as a ledger: parts that sum to their whole."""
    c = _compared(s, d).where("condition = 'full_validated'")
    figures = c.selectExpr(
        "stack(3, 'outcomes', cast(n_improvement + n_regression + n_neutral + n_mixed - n_differ as double), 'solved', cast(n_unchanged + n_differ - n_solved as double),"
        " 'rate', floor((route_diff_rate * n_solved - n_differ) * 1e6 + 0.5) / 1e6 + 0.0) as (claim, value)"
    )
    expected = s.createDataFrame([("outcomes", 0.0), ("solved", 0.0), ("rate", 0.0)], "claim string, expected double")
    return ledger(figures, expected)


def slope_factors(s: SparkSession, d: str) -> DataFrame:
    return S.edges(s, d).select("u", "v", "k", fixed(slope_factor(F.coalesce("grade_abs", F.lit(0.0)))).alias("factor"))


def cost_ratio_cap(s: SparkSession, d: str) -> DataFrame:
    rows = S.costed(s, d).select("condition", fixed(M.impedance_ratio(F.col("cost"), F.col("length"))).alias("ratio"))
    return M.element_at_share(rows, ["condition"], "ratio", 0.95)


def ecdf_cost(s: SparkSession, d: str) -> DataFrame:
    rows = S.costed(s, d).select("condition", fixed(F.col("cost"), 3).alias("cost"))
    return M.ecdf(rows, ["condition"], "cost").select("condition", "cost", fixed(F.col("share"), 9).alias("share"))


def mean_sd_cost(s: SparkSession, d: str) -> DataFrame:
    out = M.mean_sd(S.costed(s, d), ["condition"], "cost")
    return out.select("condition", *[fixed(F.col(c), 3).alias(c) for c in ("mean", "sd", "least", "most")])


def median_cost(s: SparkSession, d: str) -> DataFrame:
    return S.costed(s, d).groupBy("condition").agg(fixed(F.median("cost")).alias("median"))


def bootstrap_labels(s: SparkSession, d: str) -> DataFrame:
    flags = S.labels(s, d).where("verdict in ('present', 'absent')").select("attribute", (F.col("verdict") == "present").cast("int").alias("flag"))
    return M.bootstrap(flags, ["attribute"], REPS)


def wilcoxon_costs(s: SparkSession, d: str) -> DataFrame:
    rows = S.costed(s, d).select("condition", "u", "v", "k", fixed(F.col("cost")).alias("cost"))
    base = rows.where("condition = 'baseline'").select("u", "v", "k", F.col("cost").alias("base"))
    both = rows.where("condition in ('full_validated', 'full_raw')").join(base, ["u", "v", "k"]).withColumn("base", fixed(F.col("base") * 1.0)).withColumn("diff", fixed(F.col("cost") - F.col("base"))).withColumn("zero", F.lit(0.0))
    done = wilcoxon(both, "diff", "zero", ["condition"])
    return done.select("condition", F.col("n").cast("bigint").alias("n"), "statistic", fixed(F.log10("p")).alias("p_log10"))


def label_sample(s: SparkSession, d: str) -> DataFrame:
    quotas = {("ramp_present", "present"): 5, ("ramp_present", "absent"): 3, ("fixed_obstacle_present", "present"): 4, ("fixed_obstacle_present", "absent"): 3}
    return sampling.label_strata(S.labels(s, d), quotas)


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The network, and the network with loops gone, long edges paved and the missing
    way back of one-way edges added."""
    e = S.edges(s, d).select("u", "v", "k", "length", "tags")
    paved = F.map_concat(F.map_filter("tags", lambda k, v: k != "surface"), F.create_map(F.lit("surface"), F.array(F.lit("asphalt"))))
    kept = e.where("u <> v").withColumn("tags", F.when(F.col("length") > 100, paved).otherwise(F.col("tags")))
    back = kept.select(F.col("v").alias("u"), F.col("u").alias("v"), "k", "length", "tags").join(e.select("u", "v", "k"), ["u", "v", "k"], "left_anti")
    columns = ["u", "v", "k", "tags"]
    return e.select(*columns), kept.unionByName(back).select(*columns)


def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    return snapshots.diff(*_old_new(s, d))


def _cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.col("p_retailprice").alias("value"))


def slope_raster(s: SparkSession, d: str) -> DataFrame:
    c = R.clean_cells(_cells(s, d))
    rows = c.agg(F.max("row") + 1).first()[0]
    return R.slope(c, rows, 40, 10.0).select("row", "col", fixed(F.col("slope")).alias("slope"))


def raster_sample(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7919) % 1000).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 1000).cast("double").alias("y"))
    return R.sample(p, _cells(s, d), "value", 0.0, 0.0, 25.0, 20.0).select("s_suppkey", "value")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """One straight line per undirected segment, on the plane of its lesser end's zone."""
    one = S.edges(s, d).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "k").where("u <> v").distinct()
    at = S.nodes(s, d).select("node_id", "x", "y", N.valid_elevation(F.col("elevation")).alias("z"))
    both = N.with_nodes(one, at, "x", "y", "z").where("x_u is not null and x_v is not null").withColumn("zone", F.expr(zone_meridian("x_u")))
    for end, n in (("u", 0), ("v", 1)):
        both = add_projection(both, f"y_{end}", f"x_{end}", "zone").withColumnsRenamed({"east": f"x{n}", "north": f"y{n}"})
    return both.select(*N.KEY, "x0", "y0", "x1", "y1", F.col("z_u").alias("z"))


def densify_lines(s: SparkSession, d: str) -> DataFrame:
    return R.densify(_lines(s, d), N.KEY, 20.0).select(*N.KEY, "i", fixed(F.col("x"), 3).alias("x"), fixed(F.col("y"), 3).alias("y"), "z")


def elevation_grid(s: SparkSession, d: str) -> DataFrame:
    return R.grid(R.densify(_lines(s, d), N.KEY, 20.0), 25.0).select("row", "col", fixed(F.col("value"), 3).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        od_sample, shortest_routes, shortest_path_hops, route_hazards, route_overlap, compare_conditions, results_json, detection_error_gap, improvement_by_band,
        threshold_sensitivity, weight_sweep, seed_stability, slope_models, decomposition, overlay_pair, claims, slope_factors, cost_ratio_cap, ecdf_cost, mean_sd_cost, median_cost, bootstrap_labels, wilcoxon_costs,
        label_sample, snapshot_diff, slope_raster, raster_sample, densify_lines, elevation_grid,
    )
} | {"raster_stats": lambda s, d: R.stats(R.clean_cells(_cells(s, d)))}

# --- the same in SQL ---------------------------------------------------------------


def _draw(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 12))::bigint % {n})"


_NUMBERED = f"""spots as (select node_id, {zone_meridian("x")} as zone, east, north from ({projected("nodes", "y", "x", zone_meridian("x"))})),
  numbered as (select *, row_number() over (order by md5(node_id::varchar)) - 1 as number from spots), size as (select count(*) as n from nodes)"""


_TAGS = [f"array_to_string(case when len(tags['{t}']) > 0 then tags['{t}'] end, ';') as \"{t}\"" for t in S.T.WAY_TAGS]
_LINES = f"""{_EDGES}, one as (select distinct least(u, v) as u, greatest(u, v) as v, k from edges where u <> v),
  ends as (select o.u, o.v, o.k, a.x as xu, a.y as yu, b.x as xv, b.y as yv, {zone_meridian("a.x")} as zone,
    case when not (isnan(a.elevation) or abs(a.elevation + 9999) <= 0.09999 or a.elevation < 0 or a.elevation > 3000) then a.elevation end as z
    from one o join nodes a on a.node_id = o.u join nodes b on b.node_id = o.v),
  eu as (select u, v, k, z, zone, xv, yv, east as x0, north as y0 from ({projected("ends", "yu", "xu", "zone")})),
  lines as (select u, v, k, z, x0, y0, x1, y1, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as len from (select u, v, k, z, x0, y0, east as x1, north as y1 from ({projected("eu", "yv", "xv", "zone")}))),
  dense as (select u, v, k, i, x0 + (x1 - x0) * (i::double / n) as x, y0 + (y1 - y0) * (i::double / n) as y, z
    from (select *, greatest(floor(len / 20), 2)::bigint as n from lines where len > 0), lateral (select unnest(range(0, n + 1)) as i))"""


def _od(seeds: str = "[42]") -> str:
    """The pairs of all seeds: CTE od(seed, pair_id, o, d, dist, band), from the most draws there may be."""

    def drawn(name: str, many: int, tag: str) -> str:
        return f"""{name} as (select seed, i, x.node_id as o, y.node_id as d, sqrt(pow(x.east - y.east, 2) + pow(x.north - y.north, 2)) as dist
          from (select seed, i, {_draw("n", "seed::varchar", f"'{tag}'", "'o'", "i::varchar")} as a, {_draw("n", "seed::varchar", f"'{tag}'", "'d'", "i::varchar")} as b from range({many}) r(i), seeds, size) g
          join numbered x on x.number = g.a join numbered y on y.number = g.b where a <> b and x.zone = y.zone)"""

    return f"""{_NUMBERED}, seeds as (select unnest({seeds}) as seed), {drawn("probe", sampling.PROBES, "probe")}, {drawn("drawn", sampling.ATTEMPTS[-1] * PAIRS, "pair")},
      ordered as (select seed, dist, row_number() over (partition by seed order by dist, i) - 1 as r, count(*) over (partition by seed) as m from probe),
      cuts as (select seed, list(dist order by dist) as cuts from ordered where r in (least(floor(m * 0.25), m - 1), least(floor(m * 0.5), m - 1), least(floor(m * 0.75), m - 1)) group by seed),
      banded as (select drawn.*, least(len(list_filter(cuts, lambda t: dist >= t)), 3) as band from drawn join cuts using (seed)),
      first as (select *, row_number() over (partition by seed, least(o, d), greatest(o, d) order by i) as f from banded),
      kept as (select *, row_number() over (partition by seed, band order by i) as n from first where f = 1),
      od as (select seed::integer as seed, i as pair_id, o, d, dist, band::integer as band from kept where n <= {PAIRS // 4})"""


def _labels_of(which: str, pairs: str) -> str:
    """Least-cost labels under the conditions `which` from the origins of `pairs` until
    nothing improves: CTE best and lab, twos by (condition, cfg_id)."""
    return f"""best as (select condition, cfg_id, u, v, b.cost as cost, b.k as k from (
        select condition, cfg_id, u, v, min(struct_pack(cost := {_fix("cost")}, k := k)) as b from costed where {which} group by condition, cfg_id, u, v)),
      lab using key (condition, cfg_id, o, node) as (
        select condition, cfg_id, o, o as node, 0.0::double as dist, 0::integer as hops from (select distinct condition, cfg_id from best), (select distinct o from {pairs})
        union
        select n.condition, n.cfg_id, n.o, n.node, n.l.dist, n.l.hops from (
          select l.condition, l.cfg_id, l.o, e.v as node, min(struct_pack(dist := l.dist + e.cost, hops := l.hops + 1)) as l
          from lab l join best e on e.condition = l.condition and e.cfg_id = l.cfg_id and e.u = l.node group by 1, 2, 3, 4) n
        left join recurring.lab r on r.condition = n.condition and r.cfg_id = n.cfg_id and r.o = n.o and r.node = n.node
        where r.node is null or n.l.dist < r.dist or n.l.dist = r.dist and n.l.hops < r.hops)"""


def _routes_of(which: str, pairs: str = "od") -> str:
    """CTE routes(condition, cfg_id, pair_id, cost, hops, path, nodes) and steps(condition, cfg_id, pair_id, u, v, k)."""
    return f"""{_labels_of(which, pairs)},
      pred as (select b.condition, b.cfg_id, b.o, b.node, min(struct_pack(u := e.u, k := e.k)) as p from lab b
        join best e on e.condition = b.condition and e.cfg_id = b.cfg_id and e.v = b.node
        join lab a on a.condition = b.condition and a.cfg_id = b.cfg_id and a.o = b.o and a.node = e.u and a.dist + e.cost = b.dist and a.hops + 1 = b.hops
        where b.hops > 0 group by all),
      walk as (select l.condition, l.cfg_id, pair_id, x.o, x.d as node, null::bigint as ahead, null::integer as k, 0 as back from {pairs} x join lab l on l.o = x.o and l.node = x.d
        union all select w.condition, w.cfg_id, w.pair_id, w.o, p.p.u, w.node, p.p.k, back + 1 from walk w
        join pred p on p.condition = w.condition and p.cfg_id = w.cfg_id and p.o = w.o and p.node = w.node where w.node <> w.o),
      steps as (select condition, cfg_id, pair_id, node as u, ahead as v, k from walk where back > 0),
      whole as (select condition, cfg_id, pair_id, list(node order by back desc) as nodes from walk group by all),
      routes as (select l.condition, l.cfg_id, x.pair_id, l.dist as cost, l.hops, nodes from {pairs} x join lab l on l.o = x.o and l.node = x.d join whole using (condition, cfg_id, pair_id))"""


_TRUTH = f"""truth as (select u, v, k, length, grade_abs, (steps_present = 'present' and steps_present_source = 'osm')::integer as a, (stop_v = 'present')::integer as b,
    (ramp_v = 'absent')::integer as c, (ramp_v = 'present')::integer as r from fused left join wide on wide.segment_id = {S._SEG.format(u="u", v="v", k="k")})"""


def _hazards(steep: str = repr(M.STEEP), steeps: str = "") -> str:
    """CTE hz: what each route meets; `steeps` names one more key that every row is taken under."""
    key = f"condition, cfg_id, pair_id{', steep' if steeps else ''}"
    over = f", ({steeps})" if steeps else ""
    return f"""{_TRUTH}, sums as (select {key}, coalesce(sum(a), 0) as steps, coalesce(sum(b), 0) as obstacles, coalesce(sum(c), 0) as curb_barriers,
        coalesce(sum(case when grade_abs > {steep} then floor(length * 1e6 + 0.5)::bigint end), 0)::bigint / 1e6 as high_grade_len, coalesce(sum(r), 0) as ramp_access
        from steps join truth using (u, v, k){over} group by all),
      hz as (select {key}, cost, nodes, coalesce(steps, 0)::bigint as steps, coalesce(obstacles, 0)::bigint as obstacles, coalesce(curb_barriers, 0)::bigint as curb_barriers,
        coalesce(high_grade_len, 0)::double as high_grade_len, coalesce(ramp_access, 0)::bigint as ramp_access from (select * from routes{over}) left join sums using ({key}))"""


_SIX = ("steps", "obstacles", "curb_barriers", "high_grade_len", "ramp_access", "cost")


def _paired_sql(key: str = "cfg_id, pair_id", base: str = "condition = 'baseline'", full: str = "condition <> 'baseline'") -> str:
    cells = ", ".join(f"b.{c} as {c}_base, f.{c} as {c}_full" for c in _SIX)
    same = " and ".join(f"b.{k.strip()} = f.{k.strip()}" for k in key.split(","))
    return f"twos as (select f.*exclude({', '.join(_SIX)}, nodes), {cells}, b.nodes <> f.nodes as changed from hz f join hz b on {same} where b.{base} and f.{full})"


def _compared_sql(by: str, margin: str = "5.0") -> str:
    """CTE scored (one row a pair) and done (one row per `by`)."""
    signs = [f"sign({a}_full - {a}_base)" for a in M.AXES[:3]] + [f"case when abs(high_grade_len_full - high_grade_len_base) < {margin} then 0 else sign(high_grade_len_full - high_grade_len_base) end"]
    rate = lambda a, b: f"(case when {b} > 0 then ({a})::double / {b} else 0.0 end)"
    sums = ", ".join(f"sum({a}_{w})::bigint as {a}_{w}" for a in [*M.AXES[:3], "ramp_access"] for w in ("base", "full"))
    grades = ", ".join(f"sum(floor(high_grade_len_{w} * 1e6 + 0.5)::bigint)::bigint / 1e6 as high_grade_len_{w}" for w in ("base", "full"))
    causes = ", ".join(f"count(*) filter (where label = 'regression' and s{i} > 0) as regressed_by_{a}" for i, a in enumerate(M.AXES))
    return f"""signed as (select *, {", ".join(f"{x} as s{i}" for i, x in enumerate(signs))} from twos),
      scored as (select *, case when changed then case when least(s0, s1, s2, s3) < 0 and greatest(s0, s1, s2, s3) <= 0 then 'improvement' when greatest(s0, s1, s2, s3) > 0 and least(s0, s1, s2, s3) >= 0 then 'regression'
        when greatest(s0, s1, s2, s3) > 0 then 'mixed' else 'neutral' end end as label from signed),
      counted as (select {by}, count(*) as n_solved, count(*) filter (where changed) as n_differ, {", ".join(f"count(*) filter (where label = '{k}') as n_{k}" for k in ("improvement", "regression", "neutral", "mixed"))},
        {sums}, {grades}, {causes}, median(cost_base) as median_cost_base, median(cost_full) as median_cost_full,
        count(*) filter (where obstacles_full < obstacles_base) as n_fewer_obstacles, count(*) filter (where obstacles_full > obstacles_base) as n_more_obstacles from scored group by {by}),
      done as (select *, n_solved - n_differ as n_unchanged, {rate("n_differ", "n_solved")} as route_diff_rate, {rate("n_improvement", "n_differ")} as improvement_rate_of_differ,
        {rate("n_improvement", "n_solved")} as improvement_rate_of_all, n_improvement - n_regression as net_improvement, {rate("n_improvement - n_regression", "n_solved")} as net_improvement_rate_of_all,
        {rate("ramp_access_base", "n_solved")} as mean_ramp_access_base, {rate("ramp_access_full", "n_solved")} as mean_ramp_access_full from counted)"""


def _signed_ranks(name: str, rows: str) -> str:
    """CTE `name`(condition, n, statistic, p) of rows(condition, d)."""
    return f"""{name}_r as (select *, rank() over (partition by condition order by abs(d)) + (count(*) over (partition by condition, abs(d)) - 1) / 2 as rk, count(*) over (partition by condition, abs(d)) as t from ({rows}) where d <> 0),
      {name}_s as (select condition, count(*) as n, sum(case when d > 0 then rk else 0 end) as plus, sum(case when d < 0 then rk else 0 end) as minus, sum(t * t - 1)::double as ties, max(abs(d)) as most from {name}_r group by condition),
      {name}_z as (select *, least(plus, minus) as w, abs(least(plus, minus) - n * (n + 1) / 4.0::double) / sqrt((n * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48) * 2) as z from {name}_s),
      {name} as (select condition, n, case when most >= 1e-9 then w end::double as statistic, case when most >= 1e-9 then {erfc_sql("z")} end as p from {name}_z)"""


def _interval(name: str, flags: str) -> str:
    """CTE `name`(condition, lo, hi) of flags(condition, flag), nulls left out."""
    return f"""{name}_f as (select condition, count(flag) as m, coalesce(sum(flag), 0) as ones from ({flags}) group by condition),
      {name}_g as (select condition, rep, m, sum(case when {_draw("m", "'42'", "rep::varchar", "j::varchar")} < ones then 1 else 0 end) as hits from {name}_f, range({REPS}) a(rep), range(100000) b(j) where j < m group by condition, rep, m),
      {name}_o as (select condition, hits::double / m as mean, row_number() over (partition by condition order by hits::double / m, rep) - 1 as r from {name}_g),
      {name} as (select f.condition, coalesce(max(case when r = {int(0.025 * REPS)} then mean end), 0.0) as lo, coalesce(max(case when r = {min(int(0.975 * REPS), REPS - 1)} then mean end), 0.0) as hi
        from {name}_f f left join {name}_o o on o.condition = f.condition group by f.condition)"""


def _rates(*columns: str) -> str:
    return ", ".join(f"{_fix(c, 9)} as {c}" if "rate" in c else c for c in columns)


_RUN = f"with recursive {_costed(_ONE)}, {_od()}, {_routes_of('true')}"
_SCORED = f"{_RUN}, {_hazards()}, {_paired_sql()}"
_PLAIN_COLUMNS = ["condition", "n_solved", "n_differ", "n_improvement", "n_regression", "n_neutral", "n_mixed", *[f"{a}_{w}" for a in [*M.AXES[:3], "ramp_access"] for w in ("base", "full")]]
_PLAIN_COLUMNS += [*[f"regressed_by_{a}" for a in M.AXES], "n_fewer_obstacles", "n_more_obstacles", "n_unchanged", "net_improvement"]
_REAL_COLUMNS = ["high_grade_len_base", "high_grade_len_full", "median_cost_base", "median_cost_full", "route_diff_rate", "improvement_rate_of_differ", "improvement_rate_of_all", "net_improvement_rate_of_all"]
_REAL_COLUMNS += ["mean_ramp_access_base", "mean_ramp_access_full"]


_OLD_COLUMNS = ", ".join(_TAGS)
_CHANGES = " union all ".join(f"select 'changed', u, v, k, '{t}', a.\"{t}\", b.\"{t}\" from old a join new b using (u, v, k) where a.\"{t}\" is distinct from b.\"{t}\"" for t in S.T.WAY_TAGS)

ORACLE = {
    "od_sample": f"""with {_od()} select seed, pair_id, o, d, {_fix("dist", 3)} as dist, band from od""",
    "shortest_path_hops": f"""with recursive {_costed(_ONE)}, origins as (select node_id as o from nodes), {_labels_of("true", "origins")} select condition, o, node, {_fix("dist", 4)} as dist from lab""",
    "shortest_routes": f"""{_RUN} select condition, pair_id, hops::integer as hops, {_fix("cost")} as cost, array_to_string(nodes, '>') as path from routes""",
    "route_hazards": f"""{_RUN}, {_hazards()} select condition, cfg_id, pair_id, {_fix("cost")} as cost, steps, obstacles, curb_barriers, high_grade_len, ramp_access from hz""",
    "route_overlap": f"""{_RUN}, a as (select pair_id, u, v, k from steps where condition = 'baseline'), b as (select pair_id, u, v, k from steps where condition = 'full_validated'),
        solved as (select pair_id from routes where condition in ('baseline', 'full_validated') group by pair_id having count(*) = 2),
        twos as (select pair_id, u, v, k, count(*) as n from (select * from a union all select * from b) group by all)
        select pair_id, coalesce(count(*) filter (where n = 2), 0)::integer as shared, count(n)::integer as total from solved left join twos using (pair_id) group by pair_id""",
    "compare_conditions": f"""{_SCORED}, {_compared_sql("condition")}, {_interval("ci", "select condition, changed::integer as flag from scored")},
        {_interval("better", "select condition, case when changed then (label = 'improvement')::integer end as flag from scored")},
        {_signed_ranks("paid", "select condition, cost_base - cost_full as d from twos")}, {_signed_ranks("met", "select condition, (obstacles_base - obstacles_full)::double as d from twos")}
        select {", ".join(_PLAIN_COLUMNS)}, {", ".join(f"{_fix(c)} as {c}" for c in _REAL_COLUMNS)},
          {_fix("ci.lo")} as route_diff_rate_lo, {_fix("ci.hi")} as route_diff_rate_hi, {_fix("better.lo")} as improvement_rate_of_differ_lo, {_fix("better.hi")} as improvement_rate_of_differ_hi,
          {_fix("paid.statistic")} as wilcoxon_stat, {_fix("log10(paid.p)")} as wilcoxon_p_log10, {_fix("log10(met.p)")} as obstacle_wilcoxon_p_log10
        from done join ci using (condition) join better using (condition) left join paid using (condition) left join met using (condition)""",
    "detection_error_gap": f"""{_SCORED}, {_compared_sql("condition")} select {_fix("max(case when condition = 'full_validated' then improvement_rate_of_differ end) - max(case when condition = 'full_raw' then improvement_rate_of_differ end)", 9)} as gap from done""",
    "improvement_by_band": f"""{_SCORED.replace("twos as (select f.*exclude", "twos0 as (select f.*exclude")}, twos as (select twos0.*, od.band from twos0 join od using (pair_id) where condition = 'full_validated'), {_compared_sql("band")}
        select band, {_rates(*_BRIEF)} from done""",
    "threshold_sensitivity": f"""{_RUN}, {_hazards("steep", f"select unnest({STEEPS!r})::double as steep")}, {_paired_sql("cfg_id, pair_id, steep", full="condition = 'full_validated'").replace("twos as", "twos0 as")},
        twos as (select twos0.*, margin from twos0, (select unnest({MARGINS!r})::double as margin)), {_compared_sql("steep, margin", "margin")} select steep, margin, {_rates(*_BRIEF)} from done""",
    "weight_sweep": f"""with recursive {_costed(S._NINE)}, {_od()}, {_routes_of("condition = 'full_validated' or condition = 'baseline' and cfg_id = 0")}, {_hazards()}, {_paired_sql("pair_id", full="condition = 'full_validated'")},
        {_compared_sql("cfg_id")} select cfg_id, {_rates(*_BRIEF, "improvement_rate_of_all")} from done""",
    "seed_stability": f"""with recursive {_costed(_ONE)}, {_od(repr(SEEDS)).replace("od as (select seed::integer as seed, i as pair_id", "od as (select seed::integer as seed, i * 100 + seed as pair_id")},
        {_routes_of("condition in ('baseline', 'full_validated')")}, {_hazards()}, {_paired_sql().replace("twos as", "twos0 as")}, twos as (select twos0.*, od.seed from twos0 join od using (pair_id)), {_compared_sql("seed")},
        rates as (select unnest(['route_diff_rate', 'improvement_rate_of_differ', 'net_improvement_rate_of_all', 'obstacles_avoided']) as metric,
          unnest([route_diff_rate, improvement_rate_of_differ, net_improvement_rate_of_all, (obstacles_base - obstacles_full)::double]) as value from done)
        select metric, {_fix("avg(value)")} as mean, {_fix("stddev_pop(value)")} as sd, {_fix("min(value)")} as least, {_fix("max(value)")} as most from rates group by metric""",
    "slope_models": " union all ".join(
        f"""(with recursive {_costed(_ONE, protect)}, {_od()}, {_routes_of("condition in ('baseline', 'full_validated')")}, {_hazards()}, {_paired_sql()}, {_compared_sql("condition")}
        select '{name}' as model, n_solved, n_differ, n_regression, {_rates("improvement_rate_of_differ")} from done)"""
        for name, protect in (("naive", False), ("protected", True))
    ),
    "decomposition": f"""{_SCORED}, {_compared_sql("condition")} select condition, unnest(['unchanged', 'improvement', 'regression', 'neutral', 'mixed']) as outcome,
        unnest([{", ".join(_fix(f"n_{k}::double / n_solved", 9) for k in ("unchanged", "improvement", "regression", "neutral", "mixed"))}]) as share from done""",
    "overlay_pair": f"""{_SCORED} select pair_id, obstacles_base, obstacles_full from twos where condition = 'full_validated' and obstacles_full < obstacles_base order by pair_id limit 1""",
    "claims": f"""{_SCORED}, {_compared_sql("condition")} select unnest(['outcomes', 'solved', 'rate']) as claim, 0.0::double as expected,
        unnest([n_improvement + n_regression + n_neutral + n_mixed - n_differ, n_unchanged + n_differ - n_solved, {_fix("route_diff_rate * n_solved - n_differ")}])::double as value, value = 0 as holds
        from done where condition = 'full_validated'""",
    "slope_factors": f"with {_EDGES}, e as (select *, coalesce(grade_abs, 0) as g from edges) select u, v, k, {_fix('(' + _SLOPE + ')::double')} as factor from e",
    "cost_ratio_cap": f"""with {_costed(_ONE)}, r as (select condition, {_fix("case when coalesce(length, 0) = 0 then 1.0 else cost / length end")} as ratio from costed),
        n as (select *, row_number() over (partition by condition order by ratio) - 1 as spot, count(*) over (partition by condition) as n from r)
        select condition, ratio from n where spot = floor(0.95 * (n - 1))""",
    "ecdf_cost": f"""with {_costed(_ONE)}, r as (select condition, {_fix("cost", 3)} as cost from costed),
        n as (select condition, cost, row_number() over (partition by condition order by cost) as spot, count(*) over (partition by condition) as n from r)
        select condition, cost, {_fix("max(spot)::double / max(n)", 9)} as share from n group by condition, cost""",
    "mean_sd_cost": f"""with {_costed(_ONE)} select condition, {_fix(_fix("avg(cost)"), 3)} as mean, {_fix(_fix("stddev_pop(cost)"), 3)} as sd,
        {_fix(_fix("min(cost)"), 3)} as least, {_fix(_fix("max(cost)"), 3)} as most from costed group by condition""",
    "median_cost": f"with {_costed(_ONE)} select condition, {_fix('median(cost)')} as median from costed group by condition",
    "bootstrap_labels": f"""with {_LABELS}, f as (select attribute, count(*) as m, count(*) filter (where verdict = 'present') as ones from labels where verdict in ('present', 'absent') group by attribute),
        g as (select attribute, rep, m, sum(case when {_draw("m", "'42'", "rep::varchar", "j::varchar")} < ones then 1 else 0 end) as hits
              from f, range({REPS}) a(rep), range(100000) b(j) where j < m group by attribute, rep, m),
        o as (select attribute, hits::double / m as mean, row_number() over (partition by attribute order by hits::double / m, rep) - 1 as r from g)
        select attribute, max(case when r = {int(0.025 * REPS)} then mean end) as lo, max(case when r = {min(int(0.975 * REPS), REPS - 1)} then mean end) as hi from o group by attribute""",
    "wilcoxon_costs": f"""with {_costed(_ONE)}, c as (select condition, u, v, k, {_fix("cost")} as cost from costed),
        {_signed_ranks("w", f"select x.condition, {_fix('x.cost - b.cost')} as d from c x join c b using (u, v, k) where b.condition = 'baseline' and x.condition in ('full_validated', 'full_raw')")}
        select condition, n, statistic, {_fix("log10(p)")} as p_log10 from w""",
    "label_sample": f"""with {_LABELS}, r as (select *, row_number() over (partition by attribute, verdict order by md5('7|' || segment_id || '|' || attribute), segment_id) as n from labels)
        select segment_id, attribute, verdict from r where n <= case when attribute = 'ramp_present' and verdict = 'present' then 5 when attribute = 'ramp_present' and verdict = 'absent' then 3
          when attribute = 'fixed_obstacle_present' and verdict = 'present' then 4 when attribute = 'fixed_obstacle_present' and verdict = 'absent' then 3 else 0 end""",
    "snapshot_diff": f"""with {_EDGES}, old as (select u, v, k, {_OLD_COLUMNS} from edges),
        new0 as (select u, v, k, {_OLD_COLUMNS} from (select * from edges where u <> v union all
          select * replace (v as u, u as v) from edges a where u <> v and not exists (select 1 from edges b where b.u = a.v and b.v = a.u and b.k = a.k))),
        far as (select least(u, v) as a, greatest(u, v) as b, u, v, k from edges where length > 100 and u <> v),
        new as (select n.* replace (case when f.u is not null then 'asphalt' else surface end as surface) from new0 n left join (
          select u, v, k from far union select v, u, k from far where not exists (select 1 from edges e where e.u = far.v and e.v = far.u and e.k = far.k)) f using (u, v, k))
        select 'added' as change, u, v, k, null::varchar as tag, null::varchar as before, null::varchar as after from new anti join old using (u, v, k)
        union all select 'removed', u, v, k, null, null, null from old anti join new using (u, v, k) union all {_CHANGES}""",
    "slope_raster": f"""with c as (select floor(p_partkey / 40)::bigint as r, p_partkey % 40 as c, p_retailprice as z from part), m as (select max(r) as mr from c),
        n as (select c.r, c.c, c.z, w.z as w, e.z as e, s.z as s, n.z as n, mr from c left join c w on w.r = c.r and w.c = c.c - 1 left join c e on e.r = c.r and e.c = c.c + 1
              left join c s on s.r = c.r - 1 and s.c = c.c left join c n on n.r = c.r + 1 and n.c = c.c, m),
        g as (select r, c, z, case when c = 0 then (e - z) / 10 when c = 39 then (z - w) / 10 else (e - w) / 20 end as gx,
                     case when r = 0 then (n - z) / 10 when r = mr then (z - s) / 10 else (n - s) / 20 end as gy from n),
        p as (select *, 100 * sqrt(gx * gx + gy * gy) as pct from g)
        select r::integer as row, c::integer as col, case when pct <= 150 then {_fix("pct")} end as slope from p""",
    "raster_sample": """select s_suppkey, p_retailprice as value from supplier left join part
        on floor(p_partkey / 40) = floor(((s_suppkey * 104729) % 1000) / 20) and p_partkey % 40 = floor(((s_suppkey * 7919) % 1000) / 25)""",
    "raster_stats": """select count(*) as n, count(p_retailprice) as n_valid, floor(count(p_retailprice) * 10000.0::double / count(*) + 0.5) / 100 as pct_valid, min(p_retailprice) as least,
        floor(sum(floor(p_retailprice * 1e6 + 0.5)::bigint)::bigint / 1e6 / count(p_retailprice) * 1e6 + 0.5) / 1e6 as mean, max(p_retailprice) as most from part""",
    "densify_lines": f"with {_LINES} select u, v, k, i, {_fix('x', 3)} as x, {_fix('y', 3)} as y, z from dense",
    "elevation_grid": f"""with {_LINES}, o as (select a.r, b.c from range(-3, 4) a(r), range(-3, 4) b(c)),
        p as (select floor(y / 25)::bigint + r as row, floor(x / 25)::bigint + c as col, x, y, z from dense, o where z is not null),
        w as (select *, 1.0::double / (pow(x - (col + 0.5::double) * 25, 2) + pow(y - (row + 0.5::double) * 25, 2) + 1e-6) as w from p)
        select row, col, {_fix("sum(w * z) / sum(w)", 3)} as value from w group by row, col""",
}
