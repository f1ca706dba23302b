"""Fitted models, sampling designs, lookups and small graph steps beside the score and vote plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.functions import expr as X
from pavewise.operators import blocks as clusters
from pavewise.operators import design, forest, geo, stats
from pavewise.plans import scores as C
from pavewise.plans import segments as S
from pavewise.plans.scores import CRASH_SQL, F_VIEWS, FEAT_SQL, LOG_SQL, SCORED_SQL
from pavewise.plans.segments import MID_SQL, TRAFFIC_SQL, WALK_SQL, r6
from pavewise.session import checkpointed
from pavewise.sources.fixtures import ctes, view

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("global_bounds_grid", ctes("segments") + f", {WALK_SQL}, {MID_SQL}, b AS (SELECT min(mx) x0, max(mx) x1, min(my) y0, max(my) y1 FROM mid) SELECT CAST(least(greatest(floor((mx-x0)/((x1-x0)/5)),0),4)*5 + least(greatest(floor((my-y0)/((y1-y0)/5)),0),4) AS BIGINT) cell, count(*) n, round(avg(mx), 6) mean_x FROM mid, b GROUP BY 1")
def bounds_grid(spark, sf):
    mid = geo.midpoints(S.walk(spark, sf), "seg_id")
    return mid.join(C.grid_cell(spark, sf), "seg_id").groupBy("cell").agg(F.count("*").alias("n"), r6(F.avg("mx"), "mean_x"))


@query("group_sum", ctes("segments") + f", {WALK_SQL} SELECT highway, round(sum(length_m), 6) metres, count(*) n FROM walk GROUP BY highway")
def group_sum(spark, sf):
    return S.walk(spark, sf).groupBy("highway").agg(r6(F.sum("length_m"), "metres"), F.count("*").alias("n"))


@query("share_positive", ctes(*F_VIEWS) + f", {FEAT_SQL} SELECT round(avg(CASE WHEN light > 0 THEN 1.0 ELSE 0.0 END), 6) lit, round(avg(CASE WHEN poi_density > 0 THEN 1.0 ELSE 0.0 END), 6) busy FROM feat")
def share_positive(spark, sf):
    return C.features(spark, sf).agg(*[r6(F.avg((F.col(c) > 0).cast("double")), n) for c, n in (("light", "lit"), ("poi_density", "busy"))])


@query("poi_night_density", ctes(*F_VIEWS) + f", {FEAT_SQL} SELECT seg_id, CAST(poi_night_density AS BIGINT) poi_night_density FROM feat")
def poi_night(spark, sf):
    return S.poi_counts(spark, sf, "envelope").select("seg_id", F.col("poi_night_density").cast("long").alias("poi_night_density"))


@query("join_inner_multi", ctes(*F_VIEWS) + f", {FEAT_SQL}, {TRAFFIC_SQL[len(WALK_SQL) + 2:]} SELECT f.seg_id, round(f.light, 4) light, CAST(d.day_safety AS DOUBLE) day_safety, round(m.mx, 6) mx FROM feat f JOIN day d USING (seg_id) JOIN (SELECT seg_id, x1 + length_m/2*ux mx FROM walk) m USING (seg_id) WHERE f.light > 0")
def join_inner_multi(spark, sf):
    d, m = S.day(spark, sf).select("seg_id", "day_safety"), geo.midpoints(S.walk(spark, sf), "seg_id").select("seg_id", r6(F.col("mx"), "mx"))
    return C.features(spark, sf).filter("light > 0").join(d, "seg_id").join(m, "seg_id").select("seg_id", F.round("light", 4).alias("light"), "day_safety", "mx")


@query("lookup_join", ctes("segments") + f" SELECT seg_id, {S._case('highway', X.TRAFFIC_CLASS, 'NULL')} AS traffic_class FROM segments")
def lookup_join(spark, sf):
    """Classes by the lookup table, null for what it lacks."""
    table = spark.createDataFrame(list(X.TRAFFIC_CLASS.items()), "highway string, traffic_class int")
    return view(spark, sf, "segments").join(F.broadcast(table), "highway", "left").select("seg_id", "traffic_class")  # the table's own entries


@query("scalar_broadcast", ctes("segments") + f", {WALK_SQL} SELECT seg_id, round(length_m / (SELECT max(length_m) FROM walk), 6) share_of_longest FROM walk")
def scalar_broadcast(spark, sf):
    w = S.walk(spark, sf)
    return stats.with_scalar(w, w.agg(F.max("length_m").alias("m"))).select("seg_id", r6(F.col("length_m") / F.col("m"), "share_of_longest"))


REPORTS = {0: "ROBBERY", 1: "BATTERY - SIMPLE ASSAULT", 2: "BURGLARY", 3: "VANDALISM"}
REPORT_SQL = S._case("event_id % 4", {k: repr(v) for k, v in REPORTS.items()}, "NULL")


@query("lapd_predicate", ctes("incidents") + f", r AS (SELECT event_id, lpad(CAST(CAST(hr AS BIGINT) AS VARCHAR), 2, '0') || '30' time_occ, {REPORT_SQL} AS crime FROM incidents) SELECT event_id, time_occ, crime FROM r WHERE (time_occ >= '2000' OR time_occ <= '0559') AND (crime LIKE '%ROBBERY%' OR crime LIKE '%ASSAULT%')")
def night_reports(spark, sf):
    """Clock strings compare as text; kinds match any of the words."""
    crime = X.lookup((F.col("event_id") % 4).cast("int"), REPORTS, None)
    clock = F.concat(F.lpad(F.col("hr").cast("string"), 2, "0"), F.lit("30"))
    r = view(spark, sf, "incidents").select("event_id", clock.alias("time_occ"), crime.alias("crime"))
    return r.filter(X.night_clock(F.col("time_occ")) & X.any_of(F.col("crime"), ("ROBBERY", "ASSAULT")))


@query("undirected_edges", ctes("graph_edges") + ", d AS (SELECT u, v, edge_id, length_m FROM graph_edges UNION ALL SELECT v, u, edge_id, length_m FROM graph_edges) SELECT least(u, v) a, greatest(u, v) b, count(DISTINCT edge_id) n_edges, min(length_m) shortest FROM d GROUP BY ALL")
def undirected(spark, sf):
    e = view(spark, sf, "graph_edges").select("u", "v", "edge_id", "length_m")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "edge_id", "length_m"))
    return both.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.countDistinct("edge_id").alias("n_edges"), F.min("length_m").alias("shortest"))


@query("nearest_graph_node", ctes("segments", "graph_edges") + f", {WALK_SQL}, {MID_SQL}, nodes AS (SELECT DISTINCT n AS node, CAST(n % side AS DOUBLE) * 2000 / side nx, CAST(CAST(floor(n / CAST(side AS DOUBLE)) AS BIGINT) AS DOUBLE) * 2000 / side ny FROM (SELECT u n, side FROM graph_edges UNION SELECT v, side FROM graph_edges)), c AS (SELECT seg_id, node, round(sqrt((mx-nx)*(mx-nx)+(my-ny)*(my-ny)), 9) d FROM mid, nodes) SELECT seg_id, node, round(d, 6) dist FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY d, node) r FROM c) WHERE r = 1")
def nearest_node(spark, sf):
    e = view(spark, sf, "graph_edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node"), "side").distinct()
    nodes = nodes.select("node", ((F.col("node") % F.col("side")).cast("double") * 2000 / F.col("side")).alias("rx"), (F.floor(F.col("node") / F.col("side").cast("double")).cast("double") * 2000 / F.col("side")).alias("ry"))
    mid = geo.midpoints(S.walk(spark, sf), "seg_id").withColumnsRenamed({"mx": "lx", "my": "ly"})
    return geo.nearest_point(mid, nodes, "seg_id", "node", 100.0).select("seg_id", "node", r6(F.col("d"), "dist"))


OLS_SQL = f"{TRAFFIC_SQL}, {CRASH_SQL}, o AS (SELECT per.length_m x1, CAST(day_safety AS DOUBLE) x2, ln(1 + crashes) y FROM day JOIN per USING (seg_id)), m AS (SELECT corr(x1, x2) r12, corr(x1, y) r1, corr(x2, y) r2, stddev_samp(y) sy FROM o), ols AS (SELECT 'length_m' AS feature, sy * (r1 - r12 * r2) / (1 - r12 * r12) coef FROM m UNION ALL SELECT 'day_safety', sy * (r2 - r12 * r1) / (1 - r12 * r12) FROM m)"


def fitted(spark, sf) -> DataFrame:
    rows = C.crashes(spark, sf).select("length_m", F.log1p(F.col("crashes").cast("double")).alias("y"), F.col("day_safety").cast("double").alias("day_safety"))
    rows = checkpointed(rows)  # the scores' long expressions once, not in each of the filter's terms
    return spark.createDataFrame(stats.least_squares(rows, "y", ["length_m", "day_safety"]), "feature string, coef double")


@query("ols_standardized", ctes("segments", "incidents") + f", {OLS_SQL} SELECT feature, round(coef, 6) coef FROM ols")
def ols(spark, sf):
    return fitted(spark, sf).select("feature", r6(F.col("coef"), "coef"))


@query("abs_weight_share", ctes("segments", "incidents") + f", {OLS_SQL} SELECT feature, round(abs(coef) / (sum(abs(coef)) OVER () + 1e-9), 4) weight FROM ols")
def weight_share(spark, sf):
    f = fitted(spark, sf)
    return stats.with_scalar(f, f.agg(F.sum(F.abs("coef")).alias("t"))).select("feature", F.round(F.abs("coef") / (F.col("t") + 1e-9), 4).alias("weight"))


@query("verdict_labels", ctes("segments", "incidents") + f", {OLS_SQL} SELECT feature, CASE WHEN coef < -0.03 THEN 'tracks fewer' WHEN coef > 0.03 THEN 'tracks more' ELSE 'flat' END verdict FROM ols")
def verdicts(spark, sf):
    return fitted(spark, sf).select("feature", X.verdict(F.col("coef")).alias("verdict"))


CRASH_RANKS = f"cr AS (SELECT {C._ranks(('day_safety', 'crashes', 'length_m'), 'cd')} FROM cd), cc AS (SELECT corr(r0, r1) xy, corr(r0, r2) xz, corr(r1, r2) yz FROM cr)"


@query("verdict_sets", ctes("segments", "incidents") + f", {OLS_SQL}, cd AS (SELECT day_safety, crashes, length_m FROM day JOIN (SELECT seg_id, crashes FROM per) USING (seg_id)), {CRASH_RANKS}, p AS (SELECT (xy - xz*yz) / sqrt((1-xz*xz)*(1-yz*yz)) rho, xy FROM cc), k AS (SELECT coef FROM ols WHERE feature = 'day_safety') SELECT 'exposure' AS kind, round(rho, 6) rho, CASE WHEN rho < -0.03 AND coef < 0 THEN 'tracks fewer' WHEN rho > 0.03 THEN 'tracks more' ELSE 'flat' END verdict FROM p, k UNION ALL SELECT 'order', round(xy, 6), CASE WHEN xy < -0.10 THEN 'supported' ELSE 'weak' END FROM p")
def verdict_sets(spark, sf):
    """Crashes by day safety: with exposure (length) taken out, and the plain ordering."""
    rows = checkpointed(C.crashes(spark, sf).select(F.col("day_safety").cast("double").alias("day_safety"), F.col("crashes").cast("double").alias("n"), F.col("length_m").cast("double").alias("length_m")))
    coef = fitted(spark, sf).filter("feature = 'day_safety'").select("coef")
    part = stats.with_scalar(stats.partial_spearman(rows, "day_safety", "n", ["length_m"]).select("rho"), coef)
    plain = stats.spearman(rows, [("day_safety", "n")]).select("rho")
    first = part.select(F.lit("exposure").alias("kind"), r6(F.col("rho"), "rho"), X.exposure_verdict(F.col("rho"), F.col("coef")).alias("verdict"))
    return first.unionByName(plain.select(F.lit("order").alias("kind"), r6(F.col("rho"), "rho"), X.order_verdict(F.col("rho")).alias("verdict")))


ARTIFACT = ("light", "poi_density", "poi_night_density")


@query("model_artifact_stats", ctes(*F_VIEWS) + f", {LOG_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) mean, round(stddev_pop({c}) + 1e-9, 6) std, round(quantile_cont({c}, 0.025), 6) low, round(quantile_cont({c}, 0.5), 6) mid, round(quantile_cont({c}, 0.975), 6) high FROM lg" for c in ARTIFACT))
def artifact(spark, sf):
    rows = checkpointed(C.logged(spark, sf).select(*ARTIFACT))
    one, q = rows.agg(*[x for c in ARTIFACT for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first(), stats.percentiles_of(rows, {c: [0.025, 0.5, 0.975] for c in ARTIFACT})
    g = spark.createDataFrame([(c, one[f"m_{c}"], one[f"s_{c}"], q[c]) for c in ARTIFACT], "feature string, m double, s double, q array<double>")
    return g.select("feature", r6(F.col("m"), "mean"), r6(F.col("s") + 1e-9, "std"), *[r6(F.col("q")[i], n) for i, n in enumerate(("low", "mid", "high"))])


@query("sign_transfer_score", ctes(*F_VIEWS) + f", {FEAT_SQL} SELECT seg_id, round(" + " + ".join(f"({C._z(c, 'stddev_samp')})" for c in ARTIFACT) + ", 5) score FROM feat")
def sign_transfer(spark, sf):
    """Sum of z-scores with another city's signs (all three are positive)."""
    z = stats.zscore(C.features(spark, sf), list(ARTIFACT), 1)
    return z.select("seg_id", F.round(sum((F.col(f"z_{c}") * (1 if C.WEIGHTS[c] > 0 else -1) for c in ARTIFACT), F.lit(0.0)), 5).alias("score"))


STRATA_SQL = f"{FEAT_SQL}, lr AS (SELECT seg_id, round(light, 9) a, poi_density b FROM feat), st AS (SELECT seg_id, (a > a1)::INT * 3 + (a > a2)::INT * 3 + (b > b1)::INT + (b > b2)::INT AS stratum FROM lr, (SELECT quantile_cont(a, 0.33) a1, quantile_cont(a, 0.67) a2, quantile_cont(b, 0.33) b1, quantile_cont(b, 0.67) b2 FROM lr)), sr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY seg_id) turn FROM st)"


@query("strata_round_robin", ctes(*F_VIEWS) + f", {STRATA_SQL} SELECT seg_id, stratum, CAST(turn AS BIGINT) turn FROM sr WHERE turn <= 12 ORDER BY turn, stratum LIMIT 60")
def strata(spark, sf):
    f = C.features(spark, sf).select("seg_id", F.round("light", 9).alias("a"), F.col("poi_density").alias("b"))
    f = checkpointed(f)
    cut = stats.with_scalar(stats.percentiles(f, "a", [0.33, 0.67]).toDF("qa"), stats.percentiles(f, "b", [0.33, 0.67]).toDF("qb"))
    over = lambda c: sum((F.col(c) > F.col(f"q{c}")[i]).cast("int") for i in range(2))
    rows = stats.with_scalar(f, cut).select("seg_id", (over("a") * 3 + over("b")).alias("stratum"))
    return design.round_robin(rows, "stratum", "seg_id", 12, 60).select("seg_id", "stratum", F.col("turn").cast("long").alias("turn"))


@query("seeded_order", ctes("votes") + ", p AS (SELECT DISTINCT pair_id FROM votes) " + f"SELECT pair_id, CAST(row_number() OVER (ORDER BY {design.draw_sql(13, 'pair_id')}, pair_id) AS BIGINT) place FROM p")
def seeded_order(spark, sf):
    """A queue in an order of its own: by keyed draws, which keep nothing of the ids' order."""
    rows = view(spark, sf, "votes").select("pair_id").distinct()
    return stats.positions(rows, [design.draw(13, "pair_id"), "pair_id"], "at").select("pair_id", (F.col("at") + 1).alias("place"))


def seed_sql(source: str) -> str:
    """Pairs to judge from a table ``source`` (seg_id, a, b), by the two columns' z-scores."""
    return f"""zp AS (SELECT seg_id, round({C._z('a', 'stddev_samp')}, 6) za, round({C._z('b', 'stddev_samp')}, 6) zb, row_number() OVER (ORDER BY seg_id) - 1 i, count(*) OVER () n FROM {source}), offered AS (SELECT DISTINCT least(p.seg_id, q.seg_id) a, greatest(p.seg_id, q.seg_id) b, round(sqrt((p.za-q.za)*(p.za-q.za) + (p.zb-q.zb)*(p.zb-q.zb)), 6) d FROM zp p, range(1, 7) t(k), zp q WHERE q.i = (p.i + 1 + {design.draw_sql(8, 'p.i', 'k')} % (p.n - 1)) % p.n),
 kinds AS (SELECT a, b, d, CASE WHEN d > p80 THEN 'strong' WHEN d > p50 THEN 'mild' ELSE 'near' END kind, {design.draw_sql(7, 'a', 'b')} h FROM offered, (SELECT quantile_cont(d, 0.5) p50, quantile_cont(d, 0.8) p80 FROM offered)),
 ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, a, b) p FROM kinds), loop AS (WITH RECURSIVE g(p, a, b, kind, ok, ends, got) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, []::BIGINT[], []::VARCHAR[]
 UNION ALL SELECT p, a, b, kind, ok, CASE WHEN ok THEN list_concat(ends, [a, b]) ELSE ends END, CASE WHEN ok THEN list_concat(got, [kind]) ELSE got END FROM (SELECT e.p, e.a, e.b, e.kind, g.ends, g.got, len(list_filter(g.ends, lambda x: x = e.a)) < 4 AND len(list_filter(g.ends, lambda x: x = e.b)) < 4 AND len(list_filter(g.got, lambda x: x = e.kind)) < CASE e.kind WHEN 'strong' THEN 60 ELSE 45 END AS ok FROM g JOIN ord e ON e.p = g.p + 1 WHERE len(g.got) < 150)) SELECT p, a, b, kind FROM g WHERE ok)
 SELECT a, b, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY p) AS BIGINT) place FROM loop"""


def seeded(space: DataFrame) -> DataFrame:
    """Pairs to judge by the z-scores of a and b: quotas of the reference's designs, each with a plane of its own."""
    z = stats.zscore(checkpointed(space), ["a", "b"], 1).select("seg_id", F.round("z_a", 6).alias("za"), F.round("z_b", 6).alias("zb"))
    return design.seed_pairs(z, "seg_id", ("za", "zb"), 6, 4, {"strong": 60, "mild": 45, "near": 45}).select("a", "b", "kind", F.col("place").cast("long").alias("place"))


@query("pair_seeding", ctes(*F_VIEWS) + f", {FEAT_SQL}, sp AS (SELECT seg_id, light a, ln(1 + poi_density) b FROM feat), {seed_sql('sp')}")
def pair_seeding(spark, sf):
    """By night: light and businesses."""
    return seeded(C.features(spark, sf).select("seg_id", F.col("light").alias("a"), stats.log_scaled(F.col("poi_density")).alias("b")))


LIT_SQL = f"{WALK_SQL}, {S.LAMPS_SQL}, {S.points_sql(18)}, lf AS (SELECT seg_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM act WHERE sqrt((px-x)*(px-x)+(py-y)*(py-y)) <= 25) THEN 1.0 ELSE 0.0 END), 6) lit_frac FROM pts GROUP BY seg_id)"


@query("pair_seeding_lit", ctes(*F_VIEWS) + f", {LIT_SQL}, {S.BOX_SQL}, {S.POI_SQL}, pc AS (SELECT seg_id, count(place_id) poi_density FROM box LEFT JOIN poin ON x >= minx-50 AND x <= maxx+50 AND y >= miny-50 AND y <= maxy+50 GROUP BY seg_id), sp AS (SELECT seg_id, lit_frac a, ln(1 + poi_density) b FROM lf JOIN pc USING (seg_id)), {seed_sql('sp')}")
def pair_seeding_lit(spark, sf):
    """Where lamps have no wattage: the lit share and businesses."""
    both = S.lit_fraction(spark, sf).join(S.poi_counts(spark, sf, "envelope"), "seg_id")
    return seeded(both.select("seg_id", F.col("lit_frac").alias("a"), stats.log_scaled(F.col("poi_density")).alias("b")))


@query("pair_seeding_day", ctes("segments", "crossings") + f", {TRAFFIC_SQL}, {S.BOX_SQL}, cr AS (SELECT seg_id, count(crossing_id) crossing_near FROM box LEFT JOIN crossings ON x >= minx-40 AND x <= maxx+40 AND y >= miny-40 AND y <= maxy+40 GROUP BY seg_id), sp AS (SELECT seg_id, round(CAST(least(greatest(raw / coalesce(p, 1.0), 0), 1) AS DOUBLE), 3) a, CAST(crossing_near AS DOUBLE) b FROM traffic JOIN cr USING (seg_id), (SELECT quantile_cont(CAST(raw AS DOUBLE), 0.95) p FROM traffic WHERE raw > 0)), {seed_sql('sp')}")
def pair_seeding_day(spark, sf):
    """By day: traffic and crossings."""
    both = S.traffic_exposure(spark, sf).join(S.crossing_near(spark, sf), "seg_id")
    return seeded(both.select("seg_id", F.col("traffic_exposure").alias("a"), F.col("crossing_near").cast("double").alias("b")))


@query("strata_covered", ctes(*F_VIEWS, "images") + f", {FEAT_SQL}, {S.IMG_SQL[len(WALK_SQL) + 2:]}, cv AS (SELECT seg_id, round(light, 9) a FROM feat WHERE seg_id IN (SELECT seg_id FROM near)), st AS (SELECT seg_id, (a > a1)::INT + (a > a2)::INT AS stratum FROM cv, (SELECT quantile_cont(a, 0.33) a1, quantile_cont(a, 0.67) a2 FROM cv)), sr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY seg_id) turn FROM st) SELECT seg_id, stratum, CAST(turn AS BIGINT) turn FROM sr WHERE turn <= 25 ORDER BY turn, stratum LIMIT 50")
def strata_covered(spark, sf):
    """Photographed segments alone, by terciles of light, in turn until the budget of 50 queries is used up."""
    f = C.features(spark, sf).join(S.image_links(spark, sf)[0].select("seg_id").distinct(), "seg_id", "left_semi")
    f = checkpointed(f.select("seg_id", F.round("light", 9).alias("a")))
    rows = stats.with_scalar(f, stats.percentiles(f, "a", [0.33, 0.67])).select("seg_id", sum((F.col("a") > F.col("q")[i]).cast("int") for i in range(2)).alias("stratum"))
    return design.round_robin(rows, "stratum", "seg_id", 25, 50).select("seg_id", "stratum", F.col("turn").cast("long").alias("turn"))


BUDGET = {"keep": 60, "cap": 11, "budget": 150}


@query("strata_budget", ctes(*F_VIEWS, "images") + f", {FEAT_SQL}, {S.IMG_SQL[len(WALK_SQL) + 2:]}, rk AS (SELECT seg_id, row_number() OVER (ORDER BY round(light, 9), seg_id) - 1 ra, row_number() OVER (ORDER BY poi_density, seg_id) - 1 rb, greatest(count(*) OVER () - 1, 1) m, seg_id IN (SELECT seg_id FROM near) good FROM feat), st AS (SELECT seg_id, good::INT good, CAST(greatest(ceil(ra * 3 / m), 1) * 3 + greatest(ceil(rb * 3 / m), 1) - 4 AS INTEGER) AS stratum, {design.draw_sql(31, 'seg_id')} h FROM rk), tr AS (SELECT *, row_number() OVER w turn, coalesce(sum(good) OVER (PARTITION BY stratum ORDER BY h, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) own FROM st WINDOW w AS (PARTITION BY stratum ORDER BY h, seg_id)), pl AS (SELECT *, row_number() OVER (ORDER BY turn, stratum) tries, coalesce(sum(good) OVER (ORDER BY turn, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) kept FROM tr WHERE own < {BUDGET['cap']}), bg AS (SELECT *, min(tries) OVER (PARTITION BY turn) - 1 begun FROM pl) SELECT seg_id, stratum, CAST(turn AS BIGINT) turn, CAST(tries AS BIGINT) tries, CASE WHEN good = 1 THEN CAST(kept + 1 AS BIGINT) END kept FROM bg WHERE kept < {BUDGET['keep']} AND begun < {BUDGET['budget']}")
def strata_budget(spark, sf):
    """Nine strata (terciles of ranks of light by those of businesses) tried in turn for photographed segments, in drawn order, until
    enough are found or the budget of queries, failed ones too, is used up."""
    f = checkpointed(C.features(spark, sf).select("seg_id", F.round("light", 9).alias("a"), F.col("poi_density").alias("b")))
    ranked = stats.rank_bins(stats.rank_bins(f, "a", "seg_id", 3, "lt"), "b", "seg_id", 3, "bt")
    photo = S.image_links(spark, sf)[0].select("seg_id").distinct().withColumn("good", F.lit(True))
    rows = ranked.join(photo, "seg_id", "left").select("seg_id", (F.col("lt") * 3 + F.col("bt") - 4).alias("stratum"), F.coalesce("good", F.lit(False)).alias("good"), design.draw(31, "seg_id").alias("h"))
    out = design.budgeted(rows, "stratum", ["h", "seg_id"], "good", **BUDGET)
    return out.select("seg_id", "stratum", *[F.col(c).cast("long").alias(c) for c in ("turn", "tries", "kept")])


@query("synthetic_pairs", ctes(*C.E_VIEWS) + f", {SCORED_SQL}, pr AS (SELECT DISTINCT pair_id, seg_left a, seg_right b FROM votes), j AS (SELECT pair_id, a, b, 1 / (1 + exp(-(round(x.latent, 6) - round(y.latent, 6)))) p FROM pr JOIN scored x ON x.seg_id = a JOIN scored y ON y.seg_id = b) SELECT pair_id, CASE WHEN {design.draw_sql(5, 'pair_id', 'a')} < round(p, 6) * {design.DRAWS} THEN a ELSE b END AS winner_seg FROM j")
def synthetic_pairs(spark, sf):
    s = C.scored(spark, sf).select("seg_id", F.round("latent", 6).alias("latent"))
    pr = view(spark, sf, "votes").select("pair_id", F.col("seg_left").alias("a"), F.col("seg_right").alias("b")).distinct()
    j = pr.join(s.toDF("a", "la"), "a").join(s.toDF("b", "lb"), "b")
    p = F.round(1 / (1 + F.exp(-(F.col("la") - F.col("lb")))), 6)
    return j.select("pair_id", F.when(design.draw(5, "pair_id", "a") < p * design.DRAWS, F.col("a")).otherwise(F.col("b")).alias("winner_seg"))


@query("class_fractions", ctes("images") + ", c AS (SELECT image_id, unnest(range(0, 64)) i FROM images) SELECT image_id, " + ", ".join(f"round(avg(CASE WHEN (image_id * 7 + i * i) % 6 = {k} THEN 1.0 ELSE 0.0 END), 4) {n}" for k, n in enumerate(("road", "sidewalk", "building", "pole", "vegetation", "sky"))) + " FROM c GROUP BY image_id")
def class_fractions(spark, sf):
    """Shares of pixels by class from label masks (the segmentation model itself is not here)."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("image_id") * 7 + i * i) % 6).cast("int"))
    return view(spark, sf, "images").select("image_id", mask.alias("mask")).select("image_id", *[F.round(X.class_share(F.col("mask"), k), 4).alias(n) for k, n in enumerate(X.MASK_CLASSES)])


@query("forest_incremental_gain")
def forest_gain(spark, sf):
    """Held-out quality of forests over grid cells: traffic alone, traffic and light, and the gain."""
    cell = C.grid_cell(spark, sf)
    t = S.day(spark, sf).select("seg_id", F.col("day_safety").cast("double").alias("y"), F.col("mph").cast("double").alias("mph"), F.col("length_m").cast("double").alias("length_m"))
    rows = checkpointed(t.join(S.light(spark, sf).select("seg_id", "light"), "seg_id").join(cell, "seg_id"))
    out = []
    for name, cols in (("base", ["length_m", "light"]), ("base and speed", ["length_m", "light", "mph"])):
        r = stats.fit_quality(forest.grouped_forest(rows, "y", cols, "cell"), "y", "out").first()
        out.append((name, r["n"], r["r2"], r["mae"], r["rho"], r["r2"] - (out[0][2] if out else r["r2"])))
    return spark.createDataFrame(out, "model string, n long, r2 double, mae double, rho double, gain double")


def blocks(spark, sf, ks: tuple[int, ...] = (4,)) -> DataFrame:
    """(seg_id, k, block): for each k, k spatial blocks of midpoints by k-means (the best of ten starts), numbered from west to east."""
    mid = checkpointed(geo.midpoints(S.walk(spark, sf), "seg_id"))
    centres = clusters.lloyd(mid, "seg_id", ["mx", "my"], list(ks))
    each = F.array(*[F.struct(F.lit(k).alias("k"), clusters.nearest(["mx", "my"], c).alias("block")) for k, c in centres.items()])
    return mid.select("seg_id", F.explode(each).alias("b")).select("seg_id", "b.k", "b.block")


@query("kmeans_blocks")
def kmeans_blocks(spark, sf):
    return blocks(spark, sf).select("seg_id", "block")


@query("kmeans_blocks_by_k")
def kmeans_blocks_by_k(spark, sf):
    return blocks(spark, sf, (2, 3, 4, 5))


TOUR_SQL = f"""{C.O["pilot_selection"].rsplit(" SELECT seg_id, lev AS level", 1)[0]}, sites AS (SELECT g.seg_id, g.mx, g.my FROM g WHERE place <= 10), westmost AS (SELECT * FROM sites ORDER BY mx, seg_id LIMIT 1)
 SELECT seg_id, stop FROM (WITH RECURSIVE t(seg_id, mx, my, stop, seen) AS (SELECT seg_id, mx, my, 1, [seg_id] FROM westmost UNION ALL SELECT * FROM (SELECT s.seg_id, s.mx, s.my, t.stop + 1, list_append(t.seen, s.seg_id) FROM t, sites s WHERE NOT list_contains(t.seen, s.seg_id) ORDER BY round(sqrt((s.mx-t.mx)*(s.mx-t.mx)+(s.my-t.my)*(s.my-t.my)), 9), s.seg_id LIMIT 1)) SELECT seg_id, stop FROM t)"""


@query("greedy_tour", TOUR_SQL)
def greedy_tour(spark, sf):
    """(seg_id, stop): the pilot's sites (40 at most) from the westmost on, each next the nearest one left."""
    sites = checkpointed(C.pilot(spark, sf).select("seg_id").join(geo.midpoints(S.walk(spark, sf), "seg_id"), "seg_id"))
    return design.tour(sites)
