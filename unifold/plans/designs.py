"""Registered queries: designs, phases, spectra, grids, label permutations, set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import corr, design, groups, linear, ranking, signal
from .queries import EVENTS_SQL, events, query, rounded, table

DAILY_SQL = f"{EVENTS_SQL}, sr AS (SELECT event_type, day, avg(value) y FROM ev GROUP BY 1,2)"
HOURLY_SQL = f"{EVENTS_SQL}, sr AS (SELECT event_type, hr, avg(value) y FROM ev GROUP BY 1,2)"


def daily(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", "day").agg(F.avg("value").alias("y"))


def hourly(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", "hr").agg(F.avg("value").alias("y"))


# -- designs ------------------------------------------------------------------------


@query("WITH x AS (SELECT range t, -1+2.0*range/239 x FROM range(240)) SELECT t, 1.0::DOUBLE p0, round(x,8) p1, round((3*x*x-1)/2,8) p2, round((5*x*x*x-3*x)/2,8) p3 FROM x")
def legendre_polynomials(spark, sf_dir):
    return rounded(design.drift(spark, 240, 3), 8)


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice,1) decimals, round(round_even(l_extendedprice/1.5,0)*1.5,6) multiple FROM lineitem")
def round_event_time(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", design.round_time(x, 1, 1.5).alias("decimals"), F.round(design.round_time(x, "TR", 1.5), 6).alias("multiple"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, sec-86400 AS sec, value FROM ev WHERE NOT (sec-86400+value<=0 OR sec-86400>=20*86400)")
def shift_onsets_for_trim(spark, sf_dir):
    return design.shift_onsets(events(spark, sf_dir).select("event_id", "sec", "value"), "sec", "value", 86400.0, 20 * 86400.0)


@query(f"WITH {HOURLY_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hr)-1 k, count(*) OVER (PARTITION BY event_type) n FROM sr) SELECT event_type, hr, round(y,6) y, (k-5)::INT place FROM p WHERE k>=5 AND k<n-3")
def trim_run_series(spark, sf_dir):
    return rounded(design.trim(hourly(spark, sf_dir), ["event_type"], "hr", 5, 3))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT day, avg(value) m FROM ev GROUP BY 1), b AS (SELECT avg(m) c FROM d) SELECT day, (row_number() OVER (ORDER BY day)-1)::INT spike FROM d, b WHERE m>c")
def censor_to_spikes(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("day").agg(F.avg("value").alias("m"))
    keep = d.crossJoin(d.agg(F.avg("m").alias("c"))).withColumn("keep", F.when(F.col("m") > F.col("c"), 0).otherwise(1))
    return design.spikes(keep, "day", "keep")


@query(
    f"WITH {EVENTS_SQL}, c AS (SELECT event_type, f.frame::BIGINT frame, k.knot::INT knot, 1-abs(f.frame*3600.0-sec-k.knot*7200.0)/7200.0 x FROM ev, range(0,800) f(frame), range(0,4) k(knot) WHERE f.frame*3600.0>=sec AND f.frame*3600.0<=sec+21600) SELECT event_type, frame, knot, round(sum(x),6) x FROM c WHERE x>1e-12 GROUP BY 1,2,3"
)
def make_tent_design(spark, sf_dir):
    return rounded(design.tent(events(spark, sf_dir), ["event_type"], "sec", 0.0, 21600.0, 4, 3600.0))


@query(
    f"WITH {EVENTS_SQL}, n AS (SELECT event_type, hr, count(*)::DOUBLE x FROM ev GROUP BY 1,2), k(lag, w) AS (VALUES (0,0.1),(1,0.5),(2,1.0),(3,0.6),(4,0.2),(5,-0.1)) SELECT event_type, (hr+lag)::INT hr, round(sum(w*x),6) y FROM n, k WHERE hr+lag>=0 AND hr+lag<720 GROUP BY 1,2"
)
def convolve_hrf(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("event_type", "hr").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return rounded(design.convolved(n, ["event_type"], "hr", "x", [0.1, 0.5, 1.0, 0.6, 0.2, -0.1], 720))


@query("WITH r AS (SELECT range::BIGINT r FROM range(6)), f AS (SELECT a.r a, b.r b, (row_number() OVER (ORDER BY a.r,b.r)-1)::INT fold FROM r a, r b WHERE a.r<b.r) SELECT fold, r AS run, (r=a OR r=b) test FROM f, r")
def generate_cv_splits(spark, sf_dir):
    return design.folds(spark, list(range(6)), 2)


@query(
    f"WITH {EVENTS_SQL}, t AS (SELECT event_type, (day//5)::BIGINT run, count(*) c FROM ev WHERE day<30 GROUP BY 1,2), f AS (SELECT range fold FROM range(6)), p AS (SELECT fold, event_type, max(CASE WHEN run=fold THEN 1 ELSE 0 END) t, sum(CASE WHEN run<>fold THEN c ELSE 0 END) n FROM t, f GROUP BY 1,2) SELECT round(avg(n),6) repeats FROM p WHERE t=1 AND n>0"
)
def mean_train_repeats(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("run", F.floor(F.col("day") / 5)).where("day < 30")
    return rounded(design.train_repeats(d, "event_type", "run", design.folds(spark, list(range(6)))))


RESIDUAL_SQL = f"{HOURLY_SQL}, g AS (SELECT event_type, hr//120 run, regr_slope(y,hr) b, avg(y) my, avg(hr) mx FROM sr GROUP BY 1,2), rs AS (SELECT sr.event_type, sr.hr, hr//120 run, y-my-b*(hr-mx) residual FROM sr JOIN g ON g.event_type=sr.event_type AND g.run=sr.hr//120)"


def run_residuals(spark, sf_dir):
    d = hourly(spark, sf_dir).withColumn("run", F.floor(F.col("hr") / 120))
    return design.residuals(d, ["event_type", "run"], "hr", "y")


@query(f"WITH {RESIDUAL_SQL} SELECT event_type, hr, round(residual,6) residual FROM rs")
def project_out_nuisance_per_run(spark, sf_dir):
    return rounded(run_residuals(spark, sf_dir).select("event_type", "hr", "residual"))


@query(f"WITH {RESIDUAL_SQL}, l AS (SELECT *, lag(residual) OVER (PARTITION BY event_type, run ORDER BY hr) l FROM rs) SELECT event_type, run::BIGINT run, count(*) n, round(stddev_samp(residual),6) sd, round(sum(residual*l)/sum(residual*residual),6) ar1, round(max(abs(residual)),6) largest FROM l GROUP BY 1,2")
def residual_stats(spark, sf_dir):
    return rounded(design.residual_summary(run_residuals(spark, sf_dir), ["event_type", "run"], "hr", "residual"))


@query("WITH r AS (SELECT l_returnflag, count(*) n, corr(l_quantity,l_extendedprice) a, corr(l_quantity,l_tax) b, corr(l_extendedprice,l_tax) c FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round((a-b*c)/sqrt((1-b*b)*(1-c*c)),6) r FROM r")
def task_coupling(spark, sf_dir):
    return rounded(design.partial_correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_tax"))


@query("SELECT l_suppkey, round(covar_pop(l_quantity,l_extendedprice)*count(*)/(var_pop(l_quantity)*count(*)+50),4) slope FROM lineitem GROUP BY 1")
def ridge_slope(spark, sf_dir):
    return rounded(design.ridge_slope(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 50.0), 4)


@query("SELECT l_returnflag, round(100*regr_slope(l_extendedprice,l_quantity)/abs(avg(l_extendedprice)),6) pct FROM lineitem GROUP BY 1")
def percent_bold_change(spark, sf_dir):
    m = linear.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    beta = F.col("s_l_quantity_l_extendedprice") / F.col("s_l_quantity_l_quantity")
    return rounded(m.select("l_returnflag", design.percent_change(beta, F.col("m_l_extendedprice")).alias("pct")))


# -- phases, peaks, spectra -----------------------------------------------------------


@query("WITH m AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part) SELECT p_partkey, round((p_retailprice-lo)/(hi-lo)*2*pi()-pi(),8) radians FROM part, m")
def scale_phase_to_radians(spark, sf_dir):
    return rounded(signal.scaled_phase(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "radians"), 8)


@query("SELECT p_partkey, round((p_size*0.1)/(2*pi()*0.025),6) hz FROM part")
def phase_to_hz(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(signal.phase_to_hz(F.col("p_size") * 0.1, 25.0, "rad"), 6).alias("hz"))


@query(f"WITH {HOURLY_SQL}, p AS (SELECT event_type, hr, atan2(sin(0.01*hr*hr),cos(0.01*hr*hr)) ph FROM sr), j AS (SELECT *, coalesce(round_even((ph-lag(ph) OVER w)/(2*pi()),0),0) j FROM p WINDOW w AS (PARTITION BY event_type ORDER BY hr)) SELECT event_type, hr, round(ph-2*pi()*sum(j) OVER (PARTITION BY event_type ORDER BY hr ROWS UNBOUNDED PRECEDING),6) unwrapped FROM j")
def unwrap_timeseries(spark, sf_dir):
    a = 0.01 * F.col("hr") * F.col("hr")
    d = hourly(spark, sf_dir).withColumn("ph", F.atan2(F.sin(a), F.cos(a)))
    return rounded(signal.unwrapped(d, ["event_type"], "hr", "ph").select("event_type", "hr", "unwrapped"))


@query(
    f"""WITH {DAILY_SQL}, n AS (SELECT *, lag(y,2) OVER w a, lag(y) OVER w b, lead(y) OVER w e, lead(y,2) OVER w g, row_number() OVER (PARTITION BY event_type ORDER BY y DESC, day) k FROM sr WINDOW w AS (PARTITION BY event_type ORDER BY day)),
q AS (SELECT *, (5*(4*a+b+e+4*g)-10*(a+b+y+e+g))/70 curve, b-2*y+e bend FROM n WHERE k=1)
SELECT event_type, day, round(CASE WHEN a IS NOT NULL AND g IS NOT NULL THEN greatest(-1,least(1,CASE WHEN abs(curve)>1e-9 THEN -((-2*a-b+e+2*g)/10)/(2*curve) ELSE 0 END)) WHEN b IS NOT NULL AND e IS NOT NULL THEN greatest(-1,least(1,CASE WHEN abs(bend)>1e-6 THEN (b-e)/bend/2 ELSE 0 END)) ELSE 0 END,6) AS "offset" FROM q"""
)
def parabolic_peak_offset(spark, sf_dir):
    return rounded(signal.peak(daily(spark, sf_dir), ["event_type"], "day", "y"))


@query(f"WITH {HOURLY_SQL} SELECT event_type, hr, round((-3*lag(y,2) OVER w+12*lag(y) OVER w+17*y+12*lead(y) OVER w-3*lead(y,2) OVER w)/35,6) smooth FROM sr WINDOW w AS (PARTITION BY event_type ORDER BY hr)")
def savgol_filter_1d(spark, sf_dir):
    return rounded(signal.savgol(hourly(spark, sf_dir), ["event_type"], "hr", "y", 5, 2).select("event_type", "hr", "smooth"))


@query(
    f"WITH {EVENTS_SQL}, h AS (SELECT hr//6 place, avg(value) y FROM ev WHERE hr<720 GROUP BY 1), c AS (SELECT place, y-avg(y) OVER () y FROM h), s AS (SELECT k, sum(y*cos(2*pi()*(k*place%120)/120)) c, sum(y*sin(2*pi()*(k*place%120)/120)) s FROM c, range(1,61) r(k) GROUP BY 1) SELECT k::INT k, round(k/(120*21600.0),9) hz, round((CASE WHEN k=60 THEN 1 ELSE 2 END)*21600.0/120*(c*c+s*s),3) power FROM s"
)
def psd(spark, sf_dir):
    d = events(spark, sf_dir).where("hr < 720").groupBy(F.floor(F.col("hr") / 6).cast("int").alias("place")).agg(F.avg("value").alias("y")).withColumn("all", F.lit(1))
    p = signal.periodogram(d, ["all"], "place", "y", 120, 21600.0)
    return p.select("k", F.round("hz", 9).alias("hz"), F.round("power", 3).alias("power"))


@query("SELECT l_orderkey, l_linenumber, round(((1.2*l_tax*l_discount-0.0001)/(1.44*l_tax*l_tax+l_discount*l_discount+0.0002)),8) uni FROM lineitem")
def uni_from_inversions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(signal.uniform_image(F.col("l_tax"), F.col("l_discount"), 1.2, 0.0001), 8).alias("uni"))


@query("WITH p AS (SELECT l_suppkey, l_orderkey, sqrt(avg(power(l_extendedprice-60000*exp(-l_linenumber/4.0),2))) e FROM lineitem GROUP BY 1,2) SELECT l_suppkey, round(avg(e),4) rmse FROM p GROUP BY 1")
def rmse_of_fit(spark, sf_dir):
    return rounded(signal.decay_rmse(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", F.col("l_linenumber"), F.col("l_extendedprice"), F.lit(60000.0), F.lit(4.0)), 4)


# -- grids and meshes -----------------------------------------------------------------

GRID_SQL = f"{EVENTS_SQL}, g AS (SELECT day, (hr%24)::INT AS hour, avg(value) y FROM ev GROUP BY 1,2)"


def grid(spark, sf_dir):
    return events(spark, sf_dir).groupBy("day", (F.col("hr") % 24).cast("int").alias("hour")).agg(F.avg("value").alias("y"))


@query("SELECT DISTINCT least(x,y) a, greatest(x,y) b FROM (SELECT l_orderkey x, l_partkey y FROM lineitem UNION ALL SELECT l_partkey, l_suppkey FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem)")
def mesh_edges(spark, sf_dir):
    return signal.mesh_edges(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query(f"WITH {GRID_SQL} SELECT a.day, a.hour, count(b.y) n, round(avg(b.y),6) mean FROM g a JOIN g b ON power(a.day-b.day,2)+power((a.hour-b.hour)*0.5,2)<=1.0000001 GROUP BY 1,2")
def neighbourhood_mean(spark, sf_dir):
    return rounded(signal.neighbour_mean(grid(spark, sf_dir), ["day", "hour"], "y", signal.offsets(1.0, [1.0, 0.5])))


@query(
    f"WITH {GRID_SQL}, v AS (SELECT var_pop(y) v FROM g), d AS (SELECT var_pop(b.y-a.y) d FROM g a JOIN g b ON b.day=a.day+1 AND b.hour=a.hour), h AS (SELECT var_pop(b.y-a.y) d FROM g a JOIN g b ON b.day=a.day AND b.hour=a.hour+1), w AS (SELECT 1-d.d/v/2 x, 1-h.d/v/2 z FROM v, d, h) SELECT round(CASE WHEN x>0 AND x<1 THEN sqrt(8*ln(2))*sqrt(-1/(4*ln(x)))*2 END,6) day_fwhm, round(CASE WHEN z>0 AND z<1 THEN sqrt(8*ln(2))*sqrt(-1/(4*ln(z)))*3 END,6) hour_fwhm FROM w"
)
def axis_fwhm(spark, sf_dir):
    return rounded(signal.grid_fwhm(grid(spark, sf_dir), {"day": 2.0, "hour": 3.0}, "y"))


@query(
    f"""WITH RECURSIVE {GRID_SQL}, m AS (SELECT avg(y) c FROM g), l AS (SELECT day, hour FROM g, m WHERE y>c), r(day, hour, d0, h0) AS (SELECT day, hour, day, hour FROM l UNION SELECT b.day, b.hour, r.d0, r.h0 FROM r JOIN l b ON abs(r.day-b.day)+abs(r.hour-b.hour)=1),
c AS (SELECT day, hour, min(d0*100+h0) k FROM r GROUP BY 1,2), s AS (SELECT k, count(*) size FROM c GROUP BY 1 HAVING count(*)>=4) SELECT day, hour, (k//100)::INT cluster_day, (k%100)::INT cluster_hour, size FROM c JOIN s USING (k)"""
)
def cluster_labels(spark, sf_dir):
    d = grid(spark, sf_dir)
    over = d.crossJoin(F.broadcast(d.agg(F.avg("y").alias("c")))).select("day", "hour", F.when(F.col("y") > F.col("c"), 1).otherwise(0).alias("on"))
    return signal.clusters(over, ["day", "hour"], "on", 0.5, 4).select("day", "hour", F.col("cluster.day").alias("cluster_day"), F.col("cluster.hour").alias("cluster_hour"), "size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 30 AND p_partkey BETWEEN 5 AND 1500")
def crop_to_bounds(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").between(10, 30) & F.col("p_partkey").between(5, 1500)).select("p_partkey", "p_size")


# -- reliability and groups -------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT event_id, round((value-avg(value) OVER w)/greatest(stddev_samp(value) OVER w,1e-10),6) z FROM ev WINDOW w AS (PARTITION BY event_type, day)")
def zscore_betas_by_run(spark, sf_dir):
    return rounded(groups.standard_scores(events(spark, sf_dir), ["event_type", "day"], "value").select("event_id", "z"))


@query(f"WITH {DAILY_SQL}, p AS (SELECT a.event_type a, b.event_type b, abs(corr(a.y,b.y)) r FROM sr a JOIN sr b ON a.day=b.day AND a.event_type<>b.event_type GROUP BY 1,2) SELECT a AS event_type, round(avg(r),6) strength FROM p GROUP BY 1")
def voxel_corr_strength(spark, sf_dir):
    pairs = corr.pairwise(daily(spark, sf_dir), "event_type", "day", "y")
    both = pairs.select(F.explode(F.array("a", "b")).alias("event_type"), "r")
    return rounded(both.groupBy("event_type").agg(F.avg(F.abs("r")).alias("strength")))


@query(f"WITH {EVENTS_SQL}, a AS (SELECT event_type, day%15 k, avg(value) x FROM ev WHERE day<15 GROUP BY 1,2), b AS (SELECT event_type, day%15 k, avg(value) y FROM ev WHERE day>=15 AND day<30 GROUP BY 1,2), r AS (SELECT event_type, corr(x,y) r, count(*) n FROM a JOIN b USING (event_type,k) GROUP BY 1) SELECT event_type, n, round(r,6) r, round(atanh(r),6) z FROM r")
def paired_voxel_correlation(spark, sf_dir):
    half = lambda lo, v: events(spark, sf_dir).where((F.col("day") >= lo) & (F.col("day") < lo + 15)).groupBy("event_type", (F.col("day") % 15).alias("k")).agg(F.avg("value").alias(v))
    r = half(0, "x").join(half(15, "y"), ["event_type", "k"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return rounded(r.withColumn("z", F.atanh("r")))


@query(f"WITH {EVENTS_SQL}, p AS (SELECT user_id, (day//10)::BIGINT run, avg(value) m FROM ev GROUP BY 1,2) SELECT user_id, round(avg(m),6) mean FROM p GROUP BY 1 HAVING bool_and(m>5) AND avg(m)>=10")
def combine_run_masks(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("day") / 10).alias("run")).agg(F.avg("value").alias("m"))
    return rounded(groups.run_mask(d, ["user_id"], F.col("m") > 5, F.col("m"), 10.0))


@query("WITH s AS (SELECT o_orderkey, o_totalprice/450000 r2 FROM orders), n AS (SELECT count(*) n, sum((r2<0.9)::INT) low FROM s), c AS (SELECT CASE WHEN low>floor(n*0.5) THEN (SELECT r2 FROM (SELECT r2, row_number() OVER (ORDER BY r2, o_orderkey) k FROM s) WHERE k=floor(n*0.5)+1) ELSE 0.9 END c FROM n) SELECT o_orderkey, r2<c noise_pool, r2>=0.9 criteria FROM s, c")
def select_noise_pool_voxels(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 450000).alias("r2"))
    return groups.noise_pool(d, "r2", "o_orderkey", 0.9, 100, 0.5).select("o_orderkey", "noise_pool", "criteria")


@query(
    "WITH g AS (SELECT l_returnflag f, avg(l_quantity) mx, avg(l_extendedprice) my, var_samp(l_quantity) xx, covar_samp(l_quantity,l_extendedprice) xy, var_samp(l_extendedprice) yy FROM lineitem GROUP BY 1), p AS (SELECT p.f a, q.f b, p.mx-q.mx dx, p.my-q.my dy, p.xx axx, p.xy axy, p.yy ayy, q.xx bxx, q.xy bxy, q.yy byy FROM g p JOIN g q ON p.f<q.f) SELECT a, b, round(((byy*axx-2*bxy*axy+bxx*ayy+byy*dx*dx-2*bxy*dx*dy+bxx*dy*dy)/(bxx*byy-bxy*bxy)-2)/2+((ayy*bxx-2*axy*bxy+axx*byy+ayy*dx*dx-2*axy*dx*dy+axx*dy*dy)/(axx*ayy-axy*axy)-2)/2,6) kl FROM p"
)
def gaussian_symmetric_kl(spark, sf_dir):
    return rounded(groups.symmetric_kl(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"))


# -- permutations ---------------------------------------------------------------------

SWAPS_SQL = "sw AS (SELECT (row_number() OVER (ORDER BY w<>7, x, y, z)-1)::INT perm, x, y, z FROM (SELECT a.range x, b.range y, c.range z, CASE WHEN a.range=0 AND b.range=1 AND c.range=2 THEN 7 ELSE 0 END w FROM range(6) a, range(6) b, range(6) c WHERE a.range<b.range AND b.range<c.range))"
SWAP_T_SQL = f"{EVENTS_SQL}, {SWAPS_SQL}, u AS (SELECT event_type, (day//5)::INT unit, avg(value) y FROM ev WHERE day<30 GROUP BY 1,2), st AS (SELECT perm, event_type, avg(y) FILTER (unit NOT IN (x,y_,z)) m0, avg(y) FILTER (unit IN (x,y_,z)) m1, var_samp(y) FILTER (unit NOT IN (x,y_,z)) v0, var_samp(y) FILTER (unit IN (x,y_,z)) v1 FROM u, (SELECT perm, x, y y_, z FROM sw) GROUP BY 1,2), ts AS (SELECT perm, event_type, (m0-m1)/sqrt((2*v0+2*v1)/4*(2/3.0)) t FROM st)"


def swap_t(spark, sf_dir):
    """Thirty days as six units of five days; the first three against the last three."""
    u = events(spark, sf_dir).where("day < 30").groupBy("event_type", F.floor(F.col("day") / 5).cast("int").alias("unit")).agg(F.avg("value").alias("y"))
    return ranking.two_sample_swap_t(u, ranking.label_swaps(spark, [1, 1, 1, 0, 0, 0]), "event_type", "unit", "y")


@query(f"WITH {SWAPS_SQL} SELECT perm, u.range::INT unit, (u.range IN (x,y,z))::INT b FROM sw, range(6) u")
def generate_label_swaps(spark, sf_dir):
    return ranking.label_swaps(spark, [1, 1, 1, 0, 0, 0])


@query(f"WITH {SWAP_T_SQL}, s AS (SELECT event_type, t t0 FROM ts WHERE perm=0), x AS (SELECT perm, max(abs(t)) top FROM ts WHERE perm>0 GROUP BY 1), f AS (SELECT event_type, (1+sum((top>=abs(t0)-1e-9)::INT))/(count(*)+1) p_fwe FROM s, x GROUP BY 1) SELECT s.event_type, round(t0,6) t, round(avg((abs(t)>=abs(t0)-1e-9)::INT),6) p_unc, round(any_value(p_fwe),6) p_fwe FROM s JOIN ts USING (event_type) JOIN f USING (event_type) GROUP BY 1, t0")
def two_sample_t_perm(spark, sf_dir):
    return rounded(ranking.permutation_p(swap_t(spark, sf_dir), "event_type"))


@query(f"WITH {SWAP_T_SQL}, q(level) AS (VALUES (0.1::DOUBLE),(0.05),(0.01)) SELECT level, round(CASE level WHEN 0.1 THEN quantile_cont(abs(t),0.9) WHEN 0.05 THEN quantile_cont(abs(t),0.95) ELSE quantile_cont(abs(t),0.99) END,6) cutoff FROM ts, q WHERE perm>0 GROUP BY level")
def empirical_tcrits(spark, sf_dir):
    return rounded(ranking.empirical_cutoffs(swap_t(spark, sf_dir), [0.1, 0.05, 0.01]))


@query("WITH p AS (SELECT l_orderkey*10+l_linenumber id, power(l_extendedprice/110000.0,3) p FROM lineitem), r AS (SELECT p, row_number() OVER (ORDER BY p, id) k, count(*) OVER () n FROM p) SELECT round(coalesce(max(p) FILTER (p<=k/n*0.2),0),9) threshold FROM r")
def fdr_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.pow(F.col("l_extendedprice") / 110000.0, F.lit(3.0)).alias("p"))
    return rounded(ranking.fdr_threshold(d, "p", "id", 0.2), 9)


# -- sets, maps, pivots -----------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice>300000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("(SELECT l_orderkey k FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag='A') EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag='N'")
def intersect_except(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    of = lambda f: d.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"))
    return of("R").intersect(of("A")).subtract(of("N"))


@query(f"WITH {EVENTS_SQL} SELECT day, " + ", ".join(f"round(avg(value) FILTER (event_type='{k}'),6) \"{k}\"" for k in ("click", "purchase", "signup", "view")) + " FROM ev GROUP BY 1")
def gather(spark, sf_dir):
    kinds = ["click", "purchase", "signup", "view"]
    return rounded(events(spark, sf_dir).groupBy("day").pivot("event_type", kinds).agg(F.avg("value")))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END side, value FROM ev WHERE event_type IN ('click','view')")
def select_two_sample(spark, sf_dir):
    side = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
    return events(spark, sf_dir).withColumn("side", side).where("side is not null").select("event_id", "side", "value")


@query(f"WITH {EVENTS_SQL}, a AS (SELECT day, row_number() OVER (ORDER BY day) k FROM (SELECT DISTINCT day FROM ev WHERE event_type='click')), b AS (SELECT day, row_number() OVER (ORDER BY day) k FROM (SELECT DISTINCT day FROM ev WHERE event_type='view' AND value>50)) SELECT coalesce(a.k,b.k) AS place, a.day input_day, b.day event_day, coalesce(a.day=b.day,false) paired FROM a FULL JOIN b USING (k)")
def check_events_pairing(spark, sf_dir):
    d = events(spark, sf_dir)
    place = lambda x, n: ranking.global_rank(x.select(F.col("day").alias(n)).distinct(), [n], "place")
    a, b = place(d.where("event_type = 'click'"), "input_day"), place(d.where("event_type = 'view' and value > 50"), "event_day")
    return a.join(b, "place", "full").select("place", "input_day", "event_day", F.coalesce(F.col("input_day") == F.col("event_day"), F.lit(False)).alias("paired"))


@query(f"SELECT {math.comb(6, 3)}::BIGINT n")
def count_unique_label_perms(spark, sf_dir):
    return ranking.label_swaps(spark, [1, 1, 1, 0, 0, 0]).agg(F.countDistinct("perm").alias("n"))


@query("SELECT event_type, count(*) n, sum((props->>'$.k')::INT)::BIGINT total, count(DISTINCT (props->>'$.k')) n_values FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k.cast("int")).alias("total"), F.countDistinct(k).alias("n_values"))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT event_id, sec a, sec+value*120 b FROM ev WHERE value>0), f AS (SELECT event_id, a, b, unnest(range(floor(a/1800)::BIGINT, ceil(b/1800)::BIGINT)) frame FROM t) SELECT event_id, frame, round((least(b,(frame+1)*1800.0)-greatest(a,frame*1800.0))/1800,6) x FROM f WHERE (least(b,(frame+1)*1800.0)-greatest(a,frame*1800.0))/1800>1e-12")
def make_singletrialdesign(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("length", F.col("value") * 120)
    return rounded(design.single_trials(d, "event_id", "sec", "length", 1800.0))


@query(f"WITH {EVENTS_SQL} SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id)-1)::INT by_time, (row_number() OVER (PARTITION BY user_id ORDER BY event_type, sec, event_id)-1)::INT by_condition FROM ev")
def order_trials(spark, sf_dir):
    return design.order_trials(events(spark, sf_dir), ["user_id"], "sec", "event_type", "event_id").select("event_id", "by_time", "by_condition")


@query("SELECT s_suppkey, CASE WHEN s_nationkey%2=0 THEN 1.0 ELSE 0.0 END::DOUBLE a_0, CASE WHEN s_nationkey%2=0 THEN s_acctbal ELSE 0.0 END a_1, CASE WHEN s_nationkey%2=0 THEN 0.0 ELSE 1.0 END::DOUBLE b_0, CASE WHEN s_nationkey%2=0 THEN 0.0 ELSE s_acctbal END b_1 FROM supplier")
def two_sample_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "supplier")
    return design.two_sample_columns(d, F.col("s_nationkey") % 2 == 0, ["s_acctbal"]).select("s_suppkey", "a_0", "a_1", "b_0", "b_1")


@query(
    "WITH p AS (SELECT l_suppkey, l_linenumber, count(*) n, sum(l_quantity) x, sum(ln(l_extendedprice)) y, sum(l_quantity*l_quantity) xx, sum(l_quantity*ln(l_extendedprice)) xy FROM lineitem GROUP BY 1,2), t AS (SELECT l_suppkey, sum(n) n, sum(x) x, sum(y) y, sum(xx) xx, sum(xy) xy FROM p GROUP BY 1) SELECT p.l_suppkey, l_linenumber, round(((t.n-p.n)*(t.xy-p.xy)-(t.x-p.x)*(t.y-p.y))/((t.n-p.n)*(t.xx-p.xx)-power(t.x-p.x,2)),6) slope FROM p JOIN t USING (l_suppkey)"
)
def leave_one_echo_out(spark, sf_dir):
    return rounded(design.leave_one_out_slopes(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", F.col("l_quantity"), F.ln("l_extendedprice")))


@query(f"WITH {EVENTS_SQL} SELECT user_id, round(count(DISTINCT day)/30.0,6) AS share FROM ev WHERE day<30 GROUP BY 1 HAVING count(DISTINCT day)/30.0>=0.5")
def data_coverage_mask(spark, sf_dir):
    return rounded(design.coverage(events(spark, sf_dir).where("day < 30"), ["user_id"], "day", 30, 0.5))


@query(f"WITH {HOURLY_SQL}, c AS (SELECT hr, count(*)::DOUBLE x FROM ev GROUP BY 1) SELECT event_type, round(corr(y,x),6) r, count(*) n FROM sr JOIN c USING (hr) GROUP BY 1")
def component_condition_correlations(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("hr").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return rounded(hourly(spark, sf_dir).join(counts, "hr").groupBy("event_type").agg(F.corr("y", "x").alias("r"), F.count(F.lit(1)).alias("n")))
