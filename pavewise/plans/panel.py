"""Votes: tallies, consensus, agreement, resume, and models of preference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pavewise.functions import expr as X
from pavewise.operators import blocks, design, geo, stats, votes
from pavewise.plans import models as M
from pavewise.plans import scores as C
from pavewise.plans import segments as S
from pavewise.plans.scores import F_VIEWS, FEAT_SQL, LOG_SQL
from pavewise.plans.segments import IMG_SQL, WALK_SQL, r6
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


LAST_SQL = "lastv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rater, pair_id ORDER BY ts_iso DESC, event_id DESC) rn FROM votes) WHERE rn = 1)"
DEC_SQL = f"{LAST_SQL}, dec AS (SELECT *, CASE choice WHEN 'L' THEN seg_left ELSE seg_right END winner_seg, CASE choice WHEN 'L' THEN seg_right ELSE seg_left END loser_seg FROM lastv WHERE choice IN ('L', 'R'))"
PANEL_SQL = f"{DEC_SQL}, panel AS (SELECT * FROM dec WHERE rater LIKE 'ai:panel-%'), cnt AS (SELECT pair_id, winner_seg, count(*) n, min(rater) f FROM panel GROUP BY ALL), cons AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY pair_id) tot, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, f) r FROM cnt) WHERE r = 1 AND tot >= 2)"


def decided(spark, sf):
    return votes.decisive(view(spark, sf, "votes"))


def panel(spark, sf):
    return decided(spark, sf).filter(F.col("rater").startswith("ai:panel-"))


def agreed(spark, sf):
    return votes.consensus(panel(spark, sf))


@query("vote_winner_loser", ctes("votes") + f", {DEC_SQL} SELECT rater, pair_id, winner_seg, loser_seg FROM dec")
def vote_winner_loser(spark, sf):
    return decided(spark, sf).select("rater", "pair_id", "winner_seg", "loser_seg")


@query("vote_tallies", ctes("votes") + f", {LAST_SQL} SELECT rater, count(*) FILTER (WHERE choice='L') n_l, count(*) FILTER (WHERE choice='R') n_r, count(*) FILTER (WHERE choice='tie') n_tie, count(*) FILTER (WHERE choice NOT IN ('L','R','tie')) n_skip FROM lastv GROUP BY rater")
def vote_tallies(spark, sf):
    c = F.col("choice")
    return votes.latest(view(spark, sf, "votes")).groupBy("rater").agg(F.count_if(c == "L").alias("n_l"), F.count_if(c == "R").alias("n_r"), F.count_if(c == "tie").alias("n_tie"), F.count_if(~c.isin("L", "R", "tie")).alias("n_skip"))


@query("position_bias", ctes("votes") + f", {LAST_SQL} SELECT rater, round(avg(CASE choice WHEN 'L' THEN 1.0 WHEN 'R' THEN 0.0 END), 6) left_share FROM lastv GROUP BY rater")
def position_bias(spark, sf):
    left = F.when(F.col("choice") == "L", 1.0).when(F.col("choice") == "R", 0.0)
    return votes.latest(view(spark, sf, "votes")).groupBy("rater").agg(r6(F.avg(left), "left_share"))


@query("decisive_pairs", ctes("votes") + f", {DEC_SQL} SELECT rater, count(*) n_pairs FROM dec GROUP BY rater")
def decisive_pairs(spark, sf):
    return decided(spark, sf).groupBy("rater").agg(F.count("*").alias("n_pairs"))


@query("panel_consensus", ctes("votes") + f", {PANEL_SQL} SELECT pair_id, winner_seg consensus_winner_seg, CAST(tot AS BIGINT) n_raters, n top_votes, round(n / CAST(tot AS DOUBLE), 6) agreement_frac FROM cons")
def panel_consensus(spark, sf):
    return agreed(spark, sf).select("pair_id", "consensus_winner_seg", "n_raters", "top_votes", r6(F.col("agreement_frac"), "agreement_frac"))


TIER_SQL = "CASE WHEN n = tot THEN 'unanimous' WHEN n / CAST(tot AS DOUBLE) >= 0.7 THEN 'strong' ELSE 'split' END"


@query("consensus_tiers", ctes("votes") + f", {PANEL_SQL} SELECT {TIER_SQL} tier, count(*) n FROM cons GROUP BY 1")
def consensus_tiers(spark, sf):
    return agreed(spark, sf).groupBy(F.col("confidence_tier").alias("tier")).agg(F.count("*").alias("n"))


@query("low_confidence_pairs", ctes("votes") + f", {PANEL_SQL} SELECT pair_id FROM cons WHERE n / CAST(tot AS DOUBLE) < 0.7")
def low_confidence(spark, sf):
    return agreed(spark, sf).filter("agreement_frac < 0.7").select("pair_id")


@query("confidence_breakdown", ctes("votes") + f", {PANEL_SQL} SELECT CAST(n AS VARCHAR) || '/' || CAST(CAST(tot AS BIGINT) AS VARCHAR) AS label, count(*) n_pairs FROM cons GROUP BY 1")
def confidence_breakdown(spark, sf):
    return agreed(spark, sf).groupBy(F.concat_ws("/", F.col("top_votes").cast("string"), F.col("n_raters").cast("string")).alias("label")).agg(F.count("*").alias("n_pairs"))


@query("unanimity_rate", ctes("votes") + f", {PANEL_SQL}, b AS (SELECT rater FROM (SELECT DISTINCT rater FROM panel) ORDER BY rater LIMIT 3), p AS (SELECT pair_id, count(*) n, count(DISTINCT winner_seg) w FROM panel WHERE rater IN (SELECT rater FROM b) GROUP BY 1) SELECT count(*) three, count(*) FILTER (WHERE w = 1) unanimous, round(avg(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END), 6) rate FROM p WHERE n = 3")
def unanimity(spark, sf):
    p = panel(spark, sf)
    base = p.select("rater").distinct().orderBy("rater").limit(3)
    per = p.join(base, "rater", "left_semi").groupBy("pair_id").agg(F.count("*").alias("n"), F.countDistinct("winner_seg").alias("w")).filter("n = 3")
    return per.agg(F.count("*").alias("three"), F.count_if(F.col("w") == 1).alias("unanimous"), r6(F.avg((F.col("w") == 1).cast("double")), "rate"))


@query("rater_agreement_matrix", ctes("votes") + f", {DEC_SQL} SELECT a.rater a, b.rater b, count(*) n, round(avg(CASE WHEN a.winner_seg = b.winner_seg THEN 1.0 ELSE 0.0 END), 6) agreement, round((avg(CASE WHEN a.winner_seg = b.winner_seg THEN 1.0 ELSE 0.0 END) - 0.5) / 0.5, 6) kappa, count(*) < 10 underpowered FROM dec a JOIN dec b ON a.pair_id = b.pair_id AND a.rater < b.rater GROUP BY ALL")
def rater_matrix(spark, sf):
    return votes.rater_agreement(decided(spark, sf)).select("a", "b", "n", r6(F.col("agreement"), "agreement"), r6(F.col("kappa"), "kappa"), "underpowered")


@query("consensus_vs_human", ctes("votes") + f", {PANEL_SQL}, h AS (SELECT pair_id, rater, winner_seg hw FROM dec WHERE rater LIKE 'human%') SELECT rater, {TIER_SQL} tier, count(*) n, round(avg(CASE WHEN hw = winner_seg THEN 1.0 ELSE 0.0 END), 6) agree FROM cons JOIN h USING (pair_id) GROUP BY ALL")
def consensus_vs_human(spark, sf):
    h = decided(spark, sf).filter(F.col("rater").startswith("human")).select("pair_id", "rater", F.col("winner_seg").alias("hw"))
    same = (F.col("hw") == F.col("consensus_winner_seg")).cast("double")
    return agreed(spark, sf).join(h, "pair_id").groupBy("rater", F.col("confidence_tier").alias("tier")).agg(F.count("*").alias("n"), r6(F.avg(same), "agree"))


#: Pairs have no type in the fixture: a third is of each of the three difficulties.
TYPE_SQL = "CASE pair_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'mild' ELSE 'near' END"


@query("agree_by_pair_type", ctes("votes") + f", {PANEL_SQL}, h AS (SELECT pair_id, {TYPE_SQL} pair_type, winner_seg hw FROM dec WHERE rater = 'human1') SELECT pair_type, count(*) n, round(avg(CASE WHEN hw = winner_seg THEN 1.0 ELSE 0.0 END), 6) agree FROM cons JOIN h USING (pair_id) GROUP BY 1")
def agree_by_type(spark, sf):
    h = decided(spark, sf).filter("rater = 'human1'").select("pair_id", F.expr(TYPE_SQL).alias("pair_type"), F.col("winner_seg").alias("hw"))
    return agreed(spark, sf).join(h, "pair_id").groupBy("pair_type").agg(F.count("*").alias("n"), r6(F.avg((F.col("hw") == F.col("consensus_winner_seg")).cast("double")), "agree"))


@query("weighted_mean_agreement", ctes("votes") + f", {PANEL_SQL}, h AS (SELECT pair_id, city_id, winner_seg hw FROM dec WHERE rater = 'human1'), c AS (SELECT city_id, count(*) n, avg(CASE WHEN hw = winner_seg THEN 1.0 ELSE 0.0 END) agree FROM cons JOIN h USING (pair_id) GROUP BY 1) SELECT round(sum(n * agree) / sum(n), 6) mean_agree, count(*) FILTER (WHERE agree >= 0.6) passed, CAST(sum(n) AS BIGINT) n FROM c")
def weighted_mean(spark, sf):
    h = decided(spark, sf).filter("rater = 'human1'").select("pair_id", "city_id", F.col("winner_seg").alias("hw"))
    c = agreed(spark, sf).join(h, "pair_id").groupBy("city_id").agg(F.count("*").alias("n"), F.avg((F.col("hw") == F.col("consensus_winner_seg")).cast("double")).alias("agree"))
    return c.agg(r6(F.sum(F.col("n") * F.col("agree")) / F.sum("n"), "mean_agree"), F.count_if(F.col("agree") >= 0.6).alias("passed"), F.sum("n").alias("n"))


def compared(spark, sf):
    f = C.features(spark, sf).withColumn("light", F.round("light", 9))
    return votes.differences(decided(spark, sf), f, ["light", "poi_density", "poi_night_density"])


CMP_SQL = f"{FEAT_SQL}, {DEC_SQL}, ft AS (SELECT seg_id, round(light, 9) light, poi_density, poi_night_density FROM feat), cm AS (SELECT dec.*, w.light wl, l.light ll, w.poi_density wp, l.poi_density lp, w.poi_night_density wn, l.poi_night_density ln FROM dec JOIN ft w ON w.seg_id = winner_seg JOIN ft l ON l.seg_id = loser_seg)"
COLS = (("light", "wl", "ll"), ("poi_density", "wp", "lp"), ("poi_night_density", "wn", "ln"))


@query("score_convergence", ctes(*F_VIEWS, "votes") + f", {CMP_SQL}, nl AS (SELECT CASE WHEN winner_seg % 9 = 0 THEN NULL ELSE wl END a, CASE WHEN loser_seg % 9 = 0 THEN NULL ELSE ll END b FROM cm) SELECT count(*) n, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 6) picks_higher FROM nl WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b")
def score_convergence(spark, sf):
    """How often votes pick the side of the higher score; unknown (here every ninth segment's) and equal scores don't count."""
    f = C.features(spark, sf).select("seg_id", F.when(F.col("seg_id") % 9 != 0, F.round("light", 9)).alias("light"))
    d = votes.differences(decided(spark, sf), f, ["light"]).filter("d_light is not null and d_light <> 0")
    return d.agg(F.count("*").alias("n"), r6(F.avg((F.col("d_light") > 0).cast("double")), "picks_higher"))


@query("panel_sides", ctes("votes") + ", q AS (SELECT DISTINCT pair_id, rater FROM votes) " + f"SELECT pair_id, rater, {design.draw_sql(17, 'pair_id', 'rater')} % 2 = 0 AS a_is_left FROM q")
def panel_sides(spark, sf):
    """Which side the first picture of a pair is shown on: a keyed draw for pair and rater, so a rerun shows the same, and a
    pair is shown either way across raters."""
    q = view(spark, sf, "votes").select("pair_id", "rater").distinct()
    return q.select("pair_id", "rater", (design.draw(17, "pair_id", "rater") % 2 == 0).alias("a_is_left"))


@query("single_feature_agreement", ctes(*F_VIEWS, "votes") + f", {CMP_SQL} " + " UNION ALL ".join(f"SELECT '{n}' feature, count(*) n, round(avg(CASE WHEN {w} > {l} THEN 1.0 ELSE 0.0 END), 6) agreement FROM cm WHERE {w} <> {l}" for n, w, l in COLS))
def single_feature(spark, sf):
    c = compared(spark, sf)
    long = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"d_{n}").alias("d")) for n, _, _ in COLS])).alias("s")).select("s.*")
    return long.filter("d <> 0").groupBy("feature").agg(F.count("*").alias("n"), r6(F.avg((F.col("d") > 0).cast("double")), "agreement"))


@query("naive_agreement", ctes(*F_VIEWS, "votes") + f", {CMP_SQL} SELECT count(*) n, round(avg(CASE WHEN wl > ll THEN 1.0 ELSE 0.0 END), 6) agreement FROM cm")
def naive(spark, sf):
    return compared(spark, sf).agg(F.count("*").alias("n"), r6(F.avg((F.col("d_light") > 0).cast("double")), "agreement"))


@query("win_rate", ctes("votes") + f", {DEC_SQL}, s AS (SELECT winner_seg seg_id, 1 won FROM dec UNION ALL SELECT loser_seg, 0 FROM dec) SELECT seg_id, CAST(sum(won) AS BIGINT) wins, count(*) shown, round(avg(won), 6) rate FROM s GROUP BY 1")
def win_rate(spark, sf):
    return votes.win_rate(decided(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("distinct_segments_in_pairs", ctes("votes") + " SELECT count(DISTINCT s) n_segments, count(DISTINCT p) n_pairs FROM (SELECT seg_left s, pair_id p FROM votes UNION ALL SELECT seg_right, pair_id FROM votes)")
def distinct_segments(spark, sf):
    v = view(spark, sf, "votes").select(F.explode(F.array("seg_left", "seg_right")).alias("s"), "pair_id")
    return v.agg(F.countDistinct("s").alias("n_segments"), F.countDistinct("pair_id").alias("n_pairs"))


@query("consensus_union_cities", ctes("votes") + f", {PANEL_SQL}, u AS (SELECT city_id, pair_id, min(winner_seg) w FROM panel GROUP BY ALL) SELECT 'city-' || CAST(city_id AS VARCHAR) AS city, 'panel' AS rater_model, cons.pair_id, cons.winner_seg consensus_winner_seg FROM cons JOIN u USING (pair_id)")
def consensus_union(spark, sf):
    """One consensus table of all cities, each row under its city's name."""
    p, c = panel(spark, sf), agreed(spark, sf)
    city = p.groupBy("pair_id").agg(F.min("city_id").alias("city_id"))
    name = F.concat(F.lit("city-"), F.col("city_id").cast("string"))
    return c.join(city, "pair_id").select(name.alias("city"), F.lit("panel").alias("rater_model"), "pair_id", "consensus_winner_seg")


@query("pair_exclusion", ctes("votes") + " SELECT DISTINCT least(seg_left, seg_right) a, greatest(seg_left, seg_right) b FROM votes WHERE (least(seg_left, seg_right), greatest(seg_left, seg_right)) NOT IN (SELECT (least(seg_left, seg_right), greatest(seg_left, seg_right)) FROM votes WHERE rater = 'human1' AND choice = 'skip')")
def pair_exclusion(spark, sf):
    v = view(spark, sf, "votes")
    a, b = votes.unordered(F.col("seg_left"), F.col("seg_right"))
    used = v.filter("rater = 'human1' and choice = 'skip'").select(a.alias("a"), b.alias("b")).distinct()
    return v.select(a.alias("a"), b.alias("b")).distinct().join(used, ["a", "b"], "left_anti")


@query("resume_todo", ctes("votes") + " SELECT DISTINCT pair_id FROM votes WHERE pair_id NOT IN (SELECT pair_id FROM votes WHERE rater = 'human2')")
def resume_todo(spark, sf):
    v = view(spark, sf, "votes")
    return v.select("pair_id").distinct().join(v.filter("rater = 'human2'").select("pair_id").distinct(), "pair_id", "left_anti")


@query("pair_ids_union_intersect", ctes("votes") + f", {DEC_SQL} SELECT pair_id, 'both' AS kind FROM (SELECT pair_id FROM dec WHERE rater = 'human1' INTERSECT SELECT pair_id FROM dec WHERE rater = 'human2') UNION ALL SELECT pair_id, 'any' FROM (SELECT pair_id FROM dec WHERE rater = 'human1' UNION SELECT pair_id FROM dec WHERE rater = 'human2') UNION ALL SELECT pair_id, 'only1' FROM (SELECT pair_id FROM dec WHERE rater = 'human1' EXCEPT SELECT pair_id FROM dec WHERE rater = 'human2')")
def pair_sets(spark, sf):
    d = decided(spark, sf)
    a, b = (d.filter(F.col("rater") == r).select("pair_id") for r in ("human1", "human2"))
    sets = (("both", a.intersect(b)), ("any", a.union(b).distinct()), ("only1", a.subtract(b)))
    return reduce(lambda x, y: x.unionByName(y), [s.withColumn("kind", F.lit(k)) for k, s in sets])


@query("next_unrated", ctes("votes") + " , q AS (SELECT DISTINCT pair_id FROM votes), r AS (SELECT DISTINCT rater FROM votes), t AS (SELECT rater, pair_id FROM r, q EXCEPT SELECT rater, pair_id FROM votes) SELECT r.rater, min(t.pair_id) next_pair, (SELECT count(DISTINCT pair_id) FROM votes v WHERE v.rater = r.rater) done FROM r LEFT JOIN t ON r.rater = t.rater GROUP BY r.rater")
def next_unrated(spark, sf):
    """The first pair of the queue that a rater hasn't answered, without laying out raters x queue.

    Pairs have their place in the queue, and a rater's answered places are numbered in order: the first gap is at the first
    number that differs from its place, or after the last.
    """
    v = view(spark, sf, "votes").select("rater", "pair_id").distinct()
    queue = stats.positions(v.select("pair_id").distinct(), ["pair_id"], "at")
    done = stats.positions(v.join(queue, "pair_id").select("rater", "at"), ["rater", "at"], "k")
    per = done.groupBy("rater").agg(F.min("k").alias("first"), F.count("*").alias("done"))
    gap = done.join(per, "rater").groupBy("rater", "done").agg(F.coalesce(F.min(F.when(F.col("at") > F.col("k") - F.col("first"), F.col("k") - F.col("first"))), F.col("done")).alias("at"))
    return gap.join(queue.withColumnRenamed("pair_id", "next_pair"), "at", "left").select("rater", "next_pair", "done")


@query("panel_manifest", ctes("segments", "images", "votes") + f", {IMG_SQL}, q AS (SELECT pair_id, min(seg_left) a, min(seg_right) b FROM votes GROUP BY 1), pic AS (SELECT seg_id, arg_min(image_id, d + image_id / 1e12) image_id FROM near GROUP BY seg_id), m AS (SELECT rater, pair_id, a, b, ia.image_id img_a, ib.image_id img_b, {design.draw_sql(17, 'pair_id', 'rater')} % 2 = 0 a_left FROM q JOIN pic ia ON ia.seg_id = a JOIN pic ib ON ib.seg_id = b, (SELECT DISTINCT rater FROM votes WHERE rater LIKE 'ai:%')) SELECT rater, pair_id, CASE WHEN a_left THEN a ELSE b END seg_left, CASE WHEN a_left THEN b ELSE a END seg_right, CASE WHEN a_left THEN img_a ELSE img_b END img_left, CASE WHEN a_left THEN img_b ELSE img_a END img_right FROM m")
def manifest(spark, sf):
    """Each model rater's pairs with pictures and sides: pairs without a picture of both segments go, sides are a keyed draw."""
    q = view(spark, sf, "votes").groupBy("pair_id").agg(F.min("seg_left").alias("a"), F.min("seg_right").alias("b"))
    pic = S.imaged(spark, sf).groupBy("seg_id").agg(F.min(F.struct("d", "image_id")).alias("p")).select("seg_id", "p.image_id")
    both = q.join(pic.toDF("a", "img_a"), "a").join(pic.toDF("b", "img_b"), "b")
    raters = view(spark, sf, "votes").filter("rater like 'ai:%'").agg(F.collect_set("rater").alias("raters"))  # a panel's names
    m = stats.with_scalar(both, raters).select("*", F.explode("raters").alias("rater"))
    left = design.draw(17, "pair_id", "rater") % 2 == 0
    side = lambda one, two, name: F.when(left, F.col(one)).otherwise(F.col(two)).alias(name)
    return m.select("rater", "pair_id", side("a", "b", "seg_left"), side("b", "a", "seg_right"), side("img_a", "img_b", "img_left"), side("img_b", "img_a", "img_right"))


@query("panel_manifest_dropped", ctes("segments", "images", "votes") + f", {IMG_SQL}, q AS (SELECT pair_id, min(seg_left) a, min(seg_right) b FROM votes GROUP BY 1) SELECT count(*) pairs, count(*) FILTER (WHERE a NOT IN (SELECT seg_id FROM near) OR b NOT IN (SELECT seg_id FROM near)) dropped FROM q")
def manifest_dropped(spark, sf):
    """How many pairs of the queue a manifest leaves out for want of a picture."""
    q = view(spark, sf, "votes").groupBy("pair_id").agg(F.min("seg_left").alias("a"), F.min("seg_right").alias("b"))
    pic = S.image_links(spark, sf)[0].select("seg_id").distinct()
    both = q.join(pic.toDF("a").withColumn("_a", F.lit(True)), "a", "left").join(pic.toDF("b").withColumn("_b", F.lit(True)), "b", "left")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("dropped"))


@query("panel_sides_twister")
def panel_sides_twister(spark, sf):
    """As panel_sides, by the generator that earlier panels were placed with; raters by the number at the end of their name."""
    q = view(spark, sf, "votes").filter("rater like 'ai:%'").select("pair_id", F.regexp_extract("rater", r"(\d+)$", 1).cast("int").alias("rater")).distinct()
    return q.select("pair_id", "rater", design.twister_side(F.col("pair_id"), F.col("rater"), 8800089).alias("a_is_left"))


@query("order_swap_judging", ctes("votes") + ", x AS (SELECT pair_id, min(choice) FILTER (WHERE rater='ai:panel-r1') c1, min(choice) FILTER (WHERE rater='ai:panel-r2') c2 FROM votes GROUP BY 1) SELECT pair_id, CASE WHEN c1 = 'L' AND c2 = 'R' THEN 'first' WHEN c1 = 'R' AND c2 = 'L' THEN 'second' WHEN c1 = 'tie' AND c2 = 'tie' THEN 'tie' ELSE 'incons' END verdict FROM x WHERE c1 IS NOT NULL AND c2 IS NOT NULL")
def order_swap(spark, sf):
    """Two answers with the sides swapped: only a pick that moves with the picture counts."""
    pick = lambda r: F.min(F.when(F.col("rater") == r, F.col("choice")))
    x = view(spark, sf, "votes").groupBy("pair_id").agg(pick("ai:panel-r1").alias("c1"), pick("ai:panel-r2").alias("c2")).filter("c1 is not null and c2 is not null")
    a, b = F.col("c1"), F.col("c2")
    return x.select("pair_id", F.when((a == "L") & (b == "R"), "first").when((a == "R") & (b == "L"), "second").when((a == "tie") & (b == "tie"), "tie").otherwise("incons").alias("verdict"))


@query("segment_class_counts", ctes("segments") + f", {WALK_SQL} SELECT highway, count(*) n, CAST(sum(length_m) AS DOUBLE) metres, round(avg(CASE WHEN length_m > 60 THEN 1.0 ELSE 0.0 END), 6) long_share FROM walk GROUP BY highway")
def class_counts(spark, sf):
    return S.walk(spark, sf).groupBy("highway").agg(F.count("*").alias("n"), F.sum("length_m").alias("metres"), r6(F.avg((F.col("length_m") > 60).cast("double")), "long_share"))


@query("multi_key_sort", ctes("segments", "images") + f", {IMG_SQL} SELECT seg_id, image_id, CAST(row_number() OVER (ORDER BY seg_id, d, image_id) AS BIGINT) place FROM near")
def multi_key_sort(spark, sf):
    """Links in (segment, distance, image) order with their place.

    What lies before a segment's distance is summed up over places and their counts. Most distances are those of one place, whose
    images are numbered once for all segments; links alone that share segment and distance with another place's are ordered.
    """
    links, few = S.image_links(spark, sf)
    own = S.photos(spark, sf).select("image_id", "px", "py")
    n = links.join(own.groupBy("px", "py").agg(F.count("*").alias("n")), ["px", "py"])
    groups = stats.running(n.groupBy("seg_id", "d").agg(F.sum("n").alias("n"), F.count("*").alias("places")), ["seg_id", "d"], {"before": F.col("n")})
    at = checkpointed(links.join(geo.hinted(groups.select("seg_id", "d", "places", "before"), few), ["seg_id", "d"]))
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("image_id"))
    one = own.withColumn("r", order("px", "py")).join(geo.hinted(at.filter("places = 1"), few), ["px", "py"])
    more = own.join(geo.hinted(at.filter("places > 1"), few), ["px", "py"]).withColumn("r", order("seg_id", "d"))
    return one.unionByName(more.select(one.columns)).select("seg_id", "image_id", (F.col("before") + F.col("r")).alias("place"))


@query("limit_n", ctes("images") + " SELECT image_id FROM images ORDER BY captured_at, image_id LIMIT 25")
def limit_n(spark, sf):
    return view(spark, sf, "images").orderBy("captured_at", "image_id").select("image_id").limit(25)


@query("every_kth", ctes("images") + ", r AS (SELECT image_id, CAST(floor(compass_angle % 360 / 45) AS INT) o, row_number() OVER (PARTITION BY CAST(floor(compass_angle % 360 / 45) AS INT) ORDER BY image_id) - 1 r FROM images) SELECT o AS octant, image_id FROM r WHERE r % 10 = 0 AND r / 10 < 4")
def every_kth(spark, sf):
    """Every tenth image of an octant, four at most: places in (octant, image) order less the octant's first."""
    rows = stats.positions(view(spark, sf, "images").select(X.octant(F.col("compass_angle")).alias("octant"), "image_id"), ["octant", "image_id"], "at")
    first = rows.groupBy("octant").agg(F.min("at").alias("first"))  # eight rows
    r = F.col("at") - F.col("first")
    return rows.join(F.broadcast(first), "octant").filter((r % 10 == 0) & (r < 40)).select("octant", "image_id")


@query("attribute_merge", ctes("tracts", "acs_rows") + " SELECT tract_id, geoid FROM tracts LEFT JOIN acs_rows ON lpad(CAST(tract_id AS VARCHAR), 6, '0') = substr(geoid, 6, 6)")
def attribute_merge(spark, sf):
    a = view(spark, sf, "acs_rows").select("geoid", F.substring("geoid", 6, 6).alias("k"))
    return view(spark, sf, "tracts").withColumn("k", F.lpad(F.col("tract_id").cast("string"), 6, "0")).join(a, "k", "left").select("tract_id", "geoid")


@query("release_join", ctes(*F_VIEWS) + f", {FEAT_SQL}, {S.TRAFFIC_SQL[len(WALK_SQL) + 2:]} SELECT f.seg_id, round(f.light, 4) light, CAST(f.poi_density AS DOUBLE) poi_density, CAST(d.day_safety AS DOUBLE) day_safety FROM feat f LEFT JOIN day d ON f.seg_id = d.seg_id AND d.car_free = 0")
def release_join(spark, sf):
    d = S.day(spark, sf).filter("car_free = 0").select("seg_id", "day_safety")
    return C.features(spark, sf).join(d, "seg_id", "left").select("seg_id", F.round("light", 4).alias("light"), F.col("poi_density").cast("double").alias("poi_density"), "day_safety")


FITTED = ["d_light", "d_poi_density", "d_poi_night_density"]


def standard_pairs(spark, sf):
    z = stats.zscore(C.logged(spark, sf), list(C.WEIGHTS), 1)
    z = z.select("seg_id", *[F.col(f"z_{c}").alias(c) for c in C.WEIGHTS])
    return votes.differences(panel(spark, sf), z, ["light", "poi_density", "poi_night_density"]).select("event_id", "pair_id", "city_id", "winner_seg", "loser_seg", *FITTED)


PAIRS_SQL = f"{LOG_SQL}, {PANEL_SQL}, zs AS (SELECT seg_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-9) {c}" for c in C.WEIGHTS) + f""" FROM lg),
 sp AS (SELECT event_id, pair_id, city_id, winner_seg, loser_seg, w.light - l.light d0, w.poi_density - l.poi_density d1, w.poi_night_density - l.poi_night_density d2 FROM panel JOIN zs w ON w.seg_id = winner_seg JOIN zs l ON l.seg_id = loser_seg)"""


def newton_sql(rows: str, out: str, steps: int = 12) -> str:
    """Newton's method for three weights as a recursive query over rows (d0, d1, d2), each pair in both directions."""
    h = {(i, j): f"h{i}{j}" for i in range(3) for j in range(3) if i <= j}
    at = lambda i, j: h[min(i, j), max(i, j)]
    minor = lambda i, j: "({0} * {1} - {2} * {3})".format(*[at(a, b) for a, b in (((i + 1) % 3, (j + 1) % 3), ((i + 2) % 3, (j + 2) % 3), ((i + 1) % 3, (j + 2) % 3), ((i + 2) % 3, (j + 1) % 3))])
    det = " + ".join(f"{at(0, j)} * {minor(0, j)}" for j in range(3))
    p = "(1 / (1 + exp(-(w0 * d0 + w1 * d1 + w2 * d2))))"
    sums = ", ".join([f"2 * sum((1 - {p}) * d{i}) - any_value(w{i}) g{i}" for i in range(3)] + [f"2 * sum({p} * (1 - {p}) * d{i} * d{j})" + (" + 1" if i == j else "") + f" {n}" for (i, j), n in h.items()])
    moved = ", ".join(f"w{i} + (" + " + ".join(f"{minor(i, j)} * g{j}" for j in range(3)) + f") / ({det}) w{i}" for i in range(3))
    return f"""{out} AS (WITH RECURSIVE nt(step, w0, w1, w2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
 SELECT step + 1, {moved} FROM (SELECT step, w0, w1, w2, {sums} FROM nt, {rows} GROUP BY step, w0, w1, w2) WHERE step < {steps}) SELECT w0, w1, w2 FROM nt WHERE step = {steps})"""


NAMED = "(VALUES ('light', 0), ('poi_density', 1), ('poi_night_density', 2)) n(feature, k)"
COEF = "CASE k WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END"


@query("bt_weights", ctes(*F_VIEWS, "votes") + f", {PAIRS_SQL}, {newton_sql('sp', 'bt')}, c AS (SELECT feature, {COEF} coef FROM bt, {NAMED}) SELECT feature, round(coef, 5) coef, round(abs(coef) / (sum(abs(coef)) OVER () + 1e-9), 5) abs_weight FROM c")
def bt_weights(spark, sf):
    w = stats.bradley_terry(standard_pairs(spark, sf), FITTED)
    total = sum(map(abs, w.values())) + 1e-9
    return spark.createDataFrame([(k[2:], round(v, 5), round(abs(v) / total, 5)) for k, v in w.items()], "feature string, coef double, abs_weight double")


@query("bt_bootstrap_ci")
def bt_bootstrap(spark, sf):
    return stats.bootstrap_interval(standard_pairs(spark, sf), FITTED, "event_id")


#: Models compared on the same pairs, by the differences they use.
MODELS = {"A": FITTED, "B": ["d_light"], "C": ["d_poi_density", "d_poi_night_density"]}
#: Pairs that a fit needs.
LEAST = 20


def by_block(spark, sf, ks: tuple[int, ...]):
    """For each k: leave one spatial block out. Pairs inside it test, pairs wholly outside train, straddling pairs go; for each
    model the agreement over all blocks together with the 2.5 and 97.5 percentiles of its resampled means (1000 draws).

    The fits of all blocks of all k share each Newton step: a pair counts in fit (k, block) unless one of its sides is there.
    """
    block = M.blocks(spark, sf, ks)
    p = standard_pairs(spark, sf)
    p = checkpointed(p.join(block.toDF("winner_seg", "k", "bw"), "winner_seg").join(block.toDF("loser_seg", "_k", "bl"), "loser_seg").filter("k = _k").drop("_k"))
    sizes = {(r["k"], r["bw"], r["bl"]): r["count"] for r in p.groupBy("k", "bw", "bl").count().collect()}  # k * k rows for each k
    out = []
    for k in ks:
        own = p.filter(F.col("k") == k)
        total = lambda g, inside: sum(n for (kk, a, b), n in sizes.items() if kk == k and ((a == g and b == g) if inside else (a != g and b != g)))  # noqa: E731,B023
        groups = [g for g in range(k) if total(g, True) and total(g, False) >= LEAST]
        if not groups:
            continue
        place, right = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))]), []
        for m, cols in MODELS.items():
            w = blocks.held_out_fits(own, cols, "bw", "bl", groups)
            at = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
            margin = reduce(lambda x, y: x + y, [F.col(c) * F.get(F.get(at, F.col("_g")), F.lit(i)) for i, c in enumerate(cols)])
            right.append((margin > 0).cast("double").alias(m))
        test = own.filter((F.col("bw") == F.col("bl")) & F.col("bw").isin(groups)).withColumn("_g", place[F.col("bw")])
        out.append(stats.mean_intervals(checkpointed(test.select("event_id", *right)), list(MODELS), "event_id").select(F.lit(k).alias("k"), "*"))
    if not out:
        return spark.createDataFrame([], "k int, model string, n long, agreement double, low double, high double")
    return reduce(lambda a, b: a.unionByName(b), out)


@query("spatial_block_cv")
def block_cv(spark, sf):
    return by_block(spark, sf, (4,)).drop("k")


@query("spatial_block_cv_by_k")
def block_cv_by_k(spark, sf):
    """From two to five blocks."""
    return by_block(spark, sf, (2, 3, 4, 5))


@query("loco")
def loco(spark, sf):
    """For each city held out: agreement, agreement of the pooled model, and the gap between them; all fits at once."""
    p = checkpointed(standard_pairs(spark, sf))
    sizes = dict(p.groupBy("city_id").count().collect())  # one row for each city
    cities = sorted(k for k, n in sizes.items() if sum(sizes.values()) - n >= LEAST)
    schema = "city_id int, n long, agreement double, in_sample double, gap double"
    if not cities:
        return spark.createDataFrame([], schema)
    pooled, held = stats.bradley_terry(p, FITTED), blocks.held_out_fits(p, FITTED, "city_id", "city_id", cities)
    own = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in zip(cities, held, strict=True)], p.select("city_id").schema.add("w", ArrayType(DoubleType())))
    with_w = p.join(F.broadcast(own), "city_id")  # one row for each city
    margin = reduce(lambda x, y: x + y, [F.col(c) * F.get("w", F.lit(i)) for i, c in enumerate(FITTED)])
    whole = reduce(lambda x, y: x + y, [F.col(c) * w for c, w in pooled.items()])
    got = with_w.groupBy("city_id").agg(F.count("*").alias("n"), F.avg((margin > 0).cast("double")).alias("agreement"), F.avg((whole > 0).cast("double")).alias("in_sample"))
    return got.select(F.col("city_id").cast("int").alias("city_id"), "n", "agreement", "in_sample", (F.col("in_sample") - F.col("agreement")).alias("gap"))


@query("transfer_verdict")
def transfer_verdict(spark, sf):
    """The held-out cities' lowest agreement, the largest gap to the pooled fit, and what they say together."""
    one = loco(spark, sf).agg(F.count("*").alias("cities"), F.min("agreement").alias("lowest"), F.max("gap").alias("gap"))
    return one.select("*", X.transfer_verdict(F.col("gap"), F.col("lowest")).alias("verdict"))


@query("cross_group_test", ctes(*F_VIEWS, "votes") + f", {PAIRS_SQL}, half AS (SELECT * FROM sp WHERE city_id < 3), {newton_sql('half', 'bt')} SELECT city_id, count(*) n, round(avg(CASE WHEN w0 * d0 + w1 * d1 + w2 * d2 > 0 THEN 1.0 ELSE 0.0 END), 4) agreement FROM sp, bt WHERE city_id >= 3 GROUP BY city_id")
def cross_group(spark, sf):
    """Weights of one set of cities on each city of another."""
    p = checkpointed(standard_pairs(spark, sf))
    w = stats.bradley_terry(p.filter("city_id < 3"), FITTED)
    right = (sum((F.col(c) * v for c, v in w.items()), F.lit(0.0)) > 0).cast("double")
    return p.filter("city_id >= 3").groupBy("city_id").agg(F.count("*").alias("n"), F.round(F.avg(right), 4).alias("agreement"))
