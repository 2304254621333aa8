"""Registered queries: each applies an operator to the tables, with the DuckDB SQL that must give the same rows.

Results are rounded on both sides, so that the order of floating-point sums
doesn't show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions
from ..operators import corr, groups, linear, ranking, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


DAY_SQL = "date_diff('day', DATE '2024-01-01', ts::DATE)"
HOUR_SQL = f"({DAY_SQL}*24+hour(ts))"


def events(spark, sf_dir):
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    hour = day * 24 + F.hour("ts")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", day.cast("int").alias("day"), hour.cast("int").alias("hr"), (hour * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("sec"))


EVENTS_SQL = f"ev AS (SELECT event_id, ts, user_id, event_type, value, {DAY_SQL}::INT AS day, {HOUR_SQL}::INT AS hr, ({HOUR_SQL}*3600+minute(ts)*60+second(ts))::DOUBLE AS sec FROM events)"

# -- linear models ------------------------------------------------------------------

OLS = """s AS (SELECT {k}, count(*) n, avg({x}) mx, avg({y}) my, var_pop({x})*count(*) sxx, var_pop({y})*count(*) syy, covar_pop({x},{y})*count(*) sxy FROM lineitem GROUP BY {k}),
f AS (SELECT *, sxy/sxx b, greatest(syy-sxy/sxx*sxy,0) ssr, greatest(n-2,1) dof FROM s),
g AS (SELECT *, sqrt(ssr/dof/sxx) se, b/(sqrt(ssr/dof/sxx)+1e-10) t FROM f)"""


@query("WITH " + OLS.format(k="l_returnflag", x="l_quantity", y="l_extendedprice") + " SELECT l_returnflag, n, round(my-b*mx,4) intercept, round(b,6) slope, round(se,6) se, round(t,6) t, round(1-ssr/syy,6) r2, round(t*t,3) f, dof::BIGINT dof FROM g")
def ols_simple(spark, sf_dir):
    r = linear.ols_simple(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "n", F.round("intercept", 4).alias("intercept"), *(F.round(c, 6).alias(c) for c in ("slope", "se", "t", "r2")), F.round("f", 3).alias("f"), "dof")


TWO = """s AS (SELECT l_linestatus, count(*) n, var_pop(l_quantity)*count(*) a, covar_pop(l_quantity,l_discount)*count(*) b, var_pop(l_discount)*count(*) c, covar_pop(l_quantity,l_extendedprice)*count(*) p, covar_pop(l_discount,l_extendedprice)*count(*) q, var_pop(l_extendedprice)*count(*) yy FROM lineitem GROUP BY 1),
f AS (SELECT *, a*c-b*b det, (c*p-b*q)/(a*c-b*b) b1, (a*q-b*p)/(a*c-b*b) b2, greatest(n-3,1) dof FROM s),
g AS (SELECT *, greatest(yy-b1*p-b2*q,0) ssr FROM f),
h AS (SELECT *, b1/(sqrt(ssr/dof*c/det)+1e-10) t1, b2/(sqrt(ssr/dof*a/det)+1e-10) t2 FROM g)"""


@query(f"WITH {TWO} SELECT l_linestatus, n, round(b1,5) b1, round(b2,4) b2, round(t1,5) t1, round(t2,5) t2, round(1-ssr/yy,7) r2 FROM h")
def ols_two_regressor(spark, sf_dir):
    r = linear.ols_two(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_discount", "l_extendedprice")
    return r.select("l_linestatus", "n", F.round("b1", 5).alias("b1"), F.round("b2", 4).alias("b2"), F.round("t1", 5).alias("t1"), F.round("t2", 5).alias("t2"), F.round("r2", 7).alias("r2"))


@query(f"WITH {TWO} SELECT l_linestatus, round(t1*t1/(t1*t1+dof),8) partial_r2_1, round(t2*t2/(t2*t2+dof),8) partial_r2_2 FROM h")
def partial_r2(spark, sf_dir):
    r = linear.ols_two(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_discount", "l_extendedprice")
    return rounded(r.select("l_linestatus", "partial_r2_1", "partial_r2_2"), 8)


@query(f"WITH {TWO} SELECT l_linestatus, round(CASE WHEN least(t1,t2)>0 THEN least(t1,t2) WHEN greatest(t1,t2)<0 THEN greatest(t1,t2) ELSE 0 END,5) conj FROM h")
def conjunction_min_t(spark, sf_dir):
    r = linear.ols_two(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_discount", "l_extendedprice")
    return rounded(r.select("l_linestatus", linear.conjunction(F.col("t1"), F.col("t2")).alias("conj")), 5)


@query("SELECT l_returnflag, count(*) n, round(regr_slope(l_extendedprice,l_quantity),5) slope_1, round(regr_r2(l_extendedprice,l_quantity),7) r2 FROM lineitem GROUP BY 1")
def ols_many(spark, sf_dir):
    r = linear.ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    return r.select("l_returnflag", "n", F.round(F.col("beta")[0], 5).alias("slope_1"), F.round("r2", 7).alias("r2"))


@query("""WITH s AS (SELECT l_returnflag, var_samp(l_tax) sxx, var_samp(l_discount) syy, covar_samp(l_tax,l_discount) sxy, avg(l_tax) mx, avg(l_discount) my FROM lineitem GROUP BY 1),
d AS (SELECT *, syy-sxx d, sqrt((syy-sxx)*(syy-sxx)+4*sxy*sxy) r FROM s), b AS (SELECT *, CASE WHEN d>=0 THEN (d+r)/(2*sxy) ELSE 2*sxy/(r-d) END slope FROM d)
SELECT l_returnflag, round(slope,6) slope, round(my-slope*mx,6) intercept FROM b""")
def deming(spark, sf_dir):
    return rounded(linear.deming(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount"))


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) w, sum(l_quantity*l_linenumber) wx, sum(l_quantity*ln(l_extendedprice+1)) wy, sum(l_quantity*l_linenumber*l_linenumber) wxx, sum(l_quantity*l_linenumber*ln(l_extendedprice+1)) wxy FROM lineitem GROUP BY 1),
b AS (SELECT *, (w*wxy-wx*wy)/(w*wxx-wx*wx) slope FROM s) SELECT l_returnflag, round(slope,7) slope, round((wy-slope*wx)/w,6) intercept FROM b""")
def t2_loglinear(spark, sf_dir):
    r = linear.weighted_line(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_linenumber").cast("double"), F.ln(F.abs("l_extendedprice") + 1), F.col("l_quantity"))
    return r.select("l_returnflag", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH p AS (SELECT l_orderkey, sum(l_linenumber*exp(-l_linenumber/4.0)*l_extendedprice)/sum(l_linenumber*exp(-l_linenumber/4.0)) v, count(*) n FROM lineitem GROUP BY 1) SELECT l_orderkey, round(v,4) combined, n FROM p""")
def optcom(spark, sf_dir):
    w = F.col("l_linenumber") * F.exp(-F.col("l_linenumber") / 4.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.sum(w), 4).alias("combined"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT l_returnflag, month(l_shipdate)%4 fold, l_quantity x, l_extendedprice y FROM lineitem),
f AS (SELECT l_returnflag, fold, count(*)::DOUBLE n, sum(x) x, sum(y) y, sum(x*x) xx, sum(x*y) xy, sum(y*y) yy FROM d GROUP BY 1,2),
t AS (SELECT l_returnflag, sum(n) n, sum(x) x, sum(y) y, sum(xx) xx, sum(xy) xy FROM f GROUP BY 1),
j AS (SELECT f.*, t.n-f.n tn, t.x-f.x tx, t.y-f.y ty, t.xx-f.xx txx, t.xy-f.xy txy FROM f JOIN t USING (l_returnflag)),
b AS (SELECT *, (tn*txy-tx*ty)/(tn*txx-tx*tx) b FROM j), c AS (SELECT *, (ty-b*tx)/tn a FROM b)
SELECT l_returnflag, round(1-sum(yy-2*a*y-2*b*xy+n*a*a+2*a*b*x+b*b*xx)/sum(yy-y*y/n),6) xval_r2, count(*) n_folds FROM c GROUP BY 1""")
def loro_xval_r2(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("fold", F.month("l_shipdate") % 4)
    return rounded(linear.leave_one_out_r2(d, ["l_returnflag"], "fold", "l_quantity", "l_extendedprice"))


# -- group tests ----------------------------------------------------------------------


@query("SELECT event_type, count(value) n, round(avg(value),6) mean, round(avg(value)/(stddev_samp(value)/sqrt(count(value))),6) t, count(value)-1 dof FROM events GROUP BY 1")
def one_sample_t(spark, sf_dir):
    return rounded(groups.one_sample_t(table(spark, sf_dir, "events"), ["event_type"], "value"))


TWO_SAMPLE = "s AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment='BUILDING') na, count(*) FILTER (c_mktsegment='MACHINERY') nb, avg(c_acctbal) FILTER (c_mktsegment='BUILDING') ma, avg(c_acctbal) FILTER (c_mktsegment='MACHINERY') mb, var_samp(c_acctbal) FILTER (c_mktsegment='BUILDING') va, var_samp(c_acctbal) FILTER (c_mktsegment='MACHINERY') vb FROM customer GROUP BY 1)"


@query(f"WITH {TWO_SAMPLE} SELECT c_nationkey, na, nb, round(ma-mb,4) diff, round((ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)*(1.0/na+1.0/nb)),6) t, (na+nb-2)::DOUBLE dof FROM s WHERE na>=2 AND nb>=2")
def two_sample_t(spark, sf_dir):
    r = groups.two_sample_t(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal")
    return r.select("c_nationkey", "na", "nb", F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), "dof")


@query(f"WITH {TWO_SAMPLE} SELECT c_nationkey, na, nb, round(ma-mb,4) diff, round((ma-mb)/sqrt(va/na+vb/nb),6) t, round((va/na+vb/nb)*(va/na+vb/nb)/((va/na)*(va/na)/(na-1)+(vb/nb)*(vb/nb)/(nb-1)),4) dof FROM s WHERE na>=2 AND nb>=2")
def welch_t(spark, sf_dir):
    r = groups.two_sample_t(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", True)
    return r.select("c_nationkey", "na", "nb", F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"))


@query("SELECT l_partkey, count(*) n, round(avg(l_discount-l_tax),6) mean, round(CASE WHEN stddev_samp(l_discount-l_tax)>0 THEN avg(l_discount-l_tax)/(stddev_samp(l_discount-l_tax)/sqrt(count(*))) ELSE 0 END,5) t, count(*)-1 dof FROM lineitem GROUP BY 1 HAVING count(*)>=2 AND stddev_samp(l_discount-l_tax)>1e-9")
def paired_t(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("_d", F.col("l_discount") - F.col("l_tax"))
    some = d.groupBy("l_partkey").agg(F.stddev_samp("_d").alias("_s")).where("_s > 1e-9").select("l_partkey")
    r = groups.paired_t(d.join(some, "l_partkey", "left_semi"), ["l_partkey"], "l_discount", "l_tax")
    return r.select("l_partkey", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"), "dof")


@query("""WITH s AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1),
p AS (SELECT sum((n-1)*v)/sum(n-1) s2 FROM s) SELECT a.o_orderpriority pa, b.o_orderpriority pb, round((a.m-b.m)/sqrt(s2*(1.0/a.n+1.0/b.n)),6) t FROM s a, s b, p WHERE a.o_orderpriority<b.o_orderpriority""")
def contrast_t(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.var_samp("o_totalprice").alias("v"))
    p = s.agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("s2"))
    a, b = s.select(F.col("o_orderpriority").alias("pa"), F.col("n").alias("na"), F.col("m").alias("ma")), s.select(F.col("o_orderpriority").alias("pb"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    # Cells of a factor: few rows, whatever the facts.
    return a.join(F.broadcast(b), F.col("pa") < F.col("pb")).crossJoin(F.broadcast(p)).select("pa", "pb", F.round((F.col("ma") - F.col("mb")) / F.sqrt(F.col("s2") * (1 / F.col("na") + 1 / F.col("nb"))), 6).alias("t"))


@query("""WITH c AS (SELECT c_nationkey k, c_mktsegment, avg(c_acctbal) b, var_samp(c_acctbal)/count(*) v FROM customer GROUP BY 1,2 HAVING count(*)>=2 AND var_samp(c_acctbal)>0),
s AS (SELECT k, count(*) n, sum(1/v) sw, sum(1/v/v) sww, sum(b/v) swb, sum(b*b/v) swbb FROM c GROUP BY 1 HAVING count(*)>=2),
q AS (SELECT k, n, greatest(swbb-swb*swb/sw,0) q, sw-sww/sw den FROM s), t AS (SELECT k, n, greatest((q-(n-1))/den,0) tau2, CASE WHEN q>0 THEN greatest((q-(n-1))/q,0) ELSE 0 END i2 FROM q)
SELECT k nation, n, round(tau2,2) tau2, round(i2,6) i2, round(sum(b/(v+tau2))/sum(1/(v+tau2)),3) mean FROM t JOIN c USING (k) GROUP BY k, n, tau2, i2""")
def random_effects_meta(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.avg("c_acctbal").alias("b"), (F.var_samp("c_acctbal") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("m")).where("m >= 2")
    r = groups.random_effects(c, ["nation"], "b", "v")
    return r.select("nation", "n", F.round("tau2", 2).alias("tau2"), F.round("i2", 6).alias("i2"), F.round("mean", 3).alias("mean"))


@query("""WITH m AS (SELECT o_orderpriority p, median(o_totalprice) m, count(*) n FROM orders GROUP BY 1), d AS (SELECT o.*, m.m, m.n FROM orders o JOIN m ON o_orderpriority=p),
a AS (SELECT o_orderpriority p, median(abs(o_totalprice-m)) mad FROM d GROUP BY 1) SELECT o_orderkey, o_orderpriority, round((o_totalprice-m)/(1.4826*mad),6) robust_z FROM d JOIN a ON o_orderpriority=p WHERE n>=5 AND mad>0 AND abs((o_totalprice-m)/(1.4826*mad))>1""")
def robust_z_flags(spark, sf_dir):
    r = groups.robust_z(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return r.where(F.abs("robust_z") > 1).select("o_orderkey", "o_orderpriority", F.round("robust_z", 6).alias("robust_z"))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT day, median(value) m FROM ev GROUP BY 1), d AS (SELECT ev.day, abs(value-m) d FROM ev JOIN m USING (day)), a AS (SELECT day, median(d) mad FROM d GROUP BY 1)
SELECT day, round(avg(CASE WHEN mad>0 AND d>1.5*mad THEN 1.0 ELSE 0.0 END),6) fraction, count(*) n FROM d JOIN a USING (day) GROUP BY 1""")
def outlier_fraction(spark, sf_dir):
    return rounded(groups.outlier_fraction(events(spark, sf_dir), ["day"], "value", 1.5))


@query("SELECT user_id, round(avg(value),6) mean, round(stddev_samp(value),6) std, round(CASE WHEN stddev_samp(value)>0 THEN avg(value)/stddev_samp(value) ELSE 0 END,6) tsnr FROM events GROUP BY 1")
def tsnr(spark, sf_dir):
    return rounded(groups.tsnr(table(spark, sf_dir, "events"), ["user_id"], "value"))


@query("SELECT n_regionkey, round(avg(c_acctbal),4) roi_mean, count(*) n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def roi_mean(spark, sf_dir):
    atlas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return rounded(groups.roi_mean(table(spark, sf_dir, "customer"), atlas, ["c_nationkey"], ["n_regionkey"], "c_acctbal"), 4)


@query("WITH r AS (SELECT c_nationkey k, avg(c_acctbal) v FROM customer WHERE c_mktsegment='BUILDING' GROUP BY 1) SELECT s_suppkey, round(coalesce(v,0),4) v FROM supplier LEFT JOIN r ON s_nationkey=k")
def roi_paint(spark, sf_dir):
    r = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("v"))
    return rounded(groups.roi_paint(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", r, "v").select("s_suppkey", "v"), 4)


@query("SELECT p_brand, round(sum(l_quantity*l_extendedprice)/sum(l_quantity),3) roi_mean, count(*) n FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1")
def weighted_roi_mean(spark, sf_dir):
    atlas = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rounded(groups.roi_mean(table(spark, sf_dir, "lineitem"), atlas, ["l_partkey"], ["p_brand"], "l_extendedprice", "l_quantity"), 3)


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) n, var_samp(l_quantity) v FROM lineitem GROUP BY 1,2), z AS (SELECT l_partkey, sum((n-1)*v)/sum(n-1) noise FROM c WHERE n>=2 GROUP BY 1),
t AS (SELECT l_partkey, var_samp(l_quantity) total FROM lineitem GROUP BY 1) SELECT l_partkey, round(noise,5) noise, round(greatest(total-noise,0),5) signal, round(sqrt(greatest(total-noise,0)/noise),5) ncsnr, round(greatest(total-noise,0)/(greatest(total-noise,0)+noise),5) ceiling FROM t JOIN z USING (l_partkey) WHERE noise>0""")
def ncsnr(spark, sf_dir):
    return rounded(groups.noise_ceiling(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity").where("noise > 0"), 5)


@query("WITH p AS (SELECT l_returnflag, l_partkey, avg(l_quantity) FILTER (l_orderkey%2=0) a, avg(l_quantity) FILTER (l_orderkey%2=1) b FROM lineitem GROUP BY 1,2), q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT l_returnflag, count(*) n_items, round(corr(a,b),6) r, round(2*corr(a,b)/(1+corr(a,b)),6) spearman_brown FROM q GROUP BY 1")
def split_half(spark, sf_dir):
    return rounded(groups.split_half(table(spark, sf_dir, "lineitem").withColumn("half", F.col("l_orderkey") % 2), ["l_returnflag"], "l_partkey", "half", "l_quantity"))


@query("WITH a AS (SELECT 1 label, count(*) FILTER (quality=1) qa, count(*) FILTER (toxic=1) qb, count(*) FILTER (quality=1 AND toxic=1) both_ FROM labels) SELECT label::INT label, round(2.0*both_/(qa+qb),6) dice FROM a")
def dice(spark, sf_dir):
    return rounded(groups.dice(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("WITH s AS (SELECT l_returnflag, l_extendedprice x, sum(l_quantity) w FROM lineitem GROUP BY 1,2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) c, sum(w) OVER (PARTITION BY l_returnflag) t FROM s) SELECT l_returnflag, min(x) percentile FROM c WHERE c>=0.75*t GROUP BY 1")
def weighted_percentile(spark, sf_dir):
    return groups.weighted_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 75)


@query("SELECT grouping_id(l_returnflag,l_linestatus)::BIGINT AS level, l_returnflag, l_linestatus, count(l_quantity) n, round(avg(l_quantity),6) m, round(var_pop(l_quantity)*count(l_quantity),3) ss FROM lineitem GROUP BY CUBE(l_returnflag,l_linestatus)")
def anova_two_way(spark, sf_dir):
    return groups.anova_two_way(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity").withColumns({"m": F.round("m", 6), "ss": F.round("ss", 3)})


@query("""WITH d AS (SELECT p_size//10 a, floor(p_retailprice/250)::INT b FROM part), n AS (SELECT count(*) n FROM d), x AS (SELECT a, count(*) c FROM d GROUP BY 1), y AS (SELECT b, count(*) c FROM d GROUP BY 1), z AS (SELECT a, b, count(*) c FROM d GROUP BY 1,2),
h AS (SELECT (SELECT ln(max(n))-sum(c*ln(c))/max(n) FROM x, n) ha, (SELECT ln(max(n))-sum(c*ln(c))/max(n) FROM y, n) hb, (SELECT ln(max(n))-sum(c*ln(c))/max(n) FROM z, n) hab)
SELECT round(ha,6) h_a, round(hb,6) h_b, round(hab,6) h_ab, round(ha+hb-hab,6) mi FROM h""")
def joint_hist_mi(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.floor(F.col("p_size") / 10).alias("a"), F.floor(F.col("p_retailprice") / 250).alias("b"))
    return rounded(groups.joint_information(d, "a", "b"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size<=a.p_size AND b.p_retailprice<=a.p_retailprice AND (b.p_size<a.p_size OR b.p_retailprice<a.p_retailprice))")
def pareto_front(spark, sf_dir):
    return groups.pareto_front(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("WITH s AS (SELECT c_mktsegment, -var_pop(c_acctbal)/1e7*count(*)/1000 f FROM customer GROUP BY 1), m AS (SELECT max(f) m FROM s) SELECT c_mktsegment, round(exp(f-m)/sum(exp(f-m)) OVER (),6) posterior FROM s, m")
def model_posterior(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg((-F.var_pop("c_acctbal") / 1e7 * F.count(F.lit(1)) / 1000).alias("f"))
    e = s.crossJoin(F.broadcast(s.agg(F.max("f").alias("m")))).withColumn("e", F.exp(F.col("f") - F.col("m")))
    return e.select("c_mktsegment", F.round(F.col("e") / F.sum("e").over(Window.partitionBy()), 6).alias("posterior"))


# -- ranks and permutation -----------------------------------------------------------

Q = "WITH p AS (SELECT o_orderkey, ((o_orderkey*7919)%10007)/10007.0 pv FROM orders), d AS (SELECT o_orderkey, greatest(pv,1e-15) pv FROM p WHERE pv<0.9999), r AS (SELECT *, row_number() OVER (ORDER BY pv,o_orderkey) k, count(*) OVER () n, 2.0*sum(CASE WHEN pv>0.5 THEN 1 ELSE 0 END) OVER () / count(*) OVER () pi0 FROM d)"


def _p_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (((F.col("o_orderkey") * 7919) % 10007) / F.lit(10007.0)).alias("pv"))


@query(Q + ", q AS (SELECT o_orderkey, least(1, min(pv*n/k) OVER (ORDER BY k DESC)) q FROM r) SELECT p.o_orderkey, round(q,8) q FROM p LEFT JOIN q USING (o_orderkey)")
def fdr_bh(spark, sf_dir):
    return ranking.fdr(_p_values(spark, sf_dir), "pv", "o_orderkey").select("o_orderkey", F.round("q", 8).alias("q"))


@query(Q + ", q AS (SELECT o_orderkey, least(1, min(pv*n/k*least(pi0,1)) OVER (ORDER BY k DESC)) q FROM r) SELECT p.o_orderkey, round(q,8) q FROM p LEFT JOIN q USING (o_orderkey)")
def fdr_pi0(spark, sf_dir):
    return ranking.fdr(_p_values(spark, sf_dir), "pv", "o_orderkey", "pi0").select("o_orderkey", F.round("q", 8).alias("q"))


PERM = f"""WITH {EVENTS_SQL}, d AS (SELECT event_type, day%6 u, avg(value)-50 y FROM ev GROUP BY 1,2), p AS (SELECT unnest(range(64)) perm),
s AS (SELECT perm, event_type, sum(CASE WHEN (perm//(2**u)::BIGINT)%2=0 THEN y ELSE -y END) s, sum(y*y) ss, count(*) n FROM d, p GROUP BY 1,2),
t AS (SELECT perm, event_type, (s/n)/sqrt(greatest((ss-n*(s/n)*(s/n))/(n-1),1e-30)/n) t FROM s)"""


def _flips(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("event_type", (F.col("day") % 6).alias("unit")).agg((F.avg("value") - 50).alias("y"))
    return ranking.sign_flip_t(d, ranking.sign_flips(spark, 6), "event_type", "unit", "y")


@query(PERM + " SELECT perm, event_type, round(t,6) t FROM t")
def perm_sign_flip(spark, sf_dir):
    return rounded(_flips(spark, sf_dir))


@query(PERM + """, o AS (SELECT event_type, t t0 FROM t WHERE perm=0), mx AS (SELECT perm, max(abs(t)) top FROM t WHERE perm>0 GROUP BY 1), u AS (SELECT event_type, t0, avg(CASE WHEN abs(t)>=abs(t0)-1e-9 THEN 1.0 ELSE 0.0 END) p_unc FROM t JOIN o USING (event_type) GROUP BY 1,2),
f AS (SELECT event_type, (1+sum(CASE WHEN top>=abs(t0)-1e-9 THEN 1 ELSE 0 END))/(count(*)+1) p_fwe FROM o, mx GROUP BY 1) SELECT event_type, round(t0,6) t, round(p_unc,6) p_unc, round(p_fwe,6) p_fwe FROM u JOIN f USING (event_type)""")
def perm_max_fwe(spark, sf_dir):
    return rounded(ranking.permutation_p(_flips(spark, sf_dir), "event_type"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT place FROM orders) WHERE place<=3")
def joint_topk(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "place")


# -- correlations ----------------------------------------------------------------------


@query("""WITH m AS (SELECT label, t, avg(v::DOUBLE) v FROM (SELECT label, unnest(embedding) v, unnest(range(len(embedding))) t FROM embeddings) GROUP BY 1,2)
SELECT x.label a, y.label b, round(corr(x.v,y.v),6) r, count(*) n FROM m x JOIN m y USING (t) WHERE x.label<y.label GROUP BY 1,2""")
def pairwise_corr(spark, sf_dir):
    m = corr.unpacked(table(spark, sf_dir, "embeddings"), "label", "embedding").groupBy("label", "t").agg(F.avg("v").alias("v"))
    return rounded(corr.pairwise(m, "label", "t", "v"))


@query("""WITH m AS (SELECT label, t, avg(v::DOUBLE) v FROM (SELECT label, unnest(embedding) v, unnest(range(len(embedding))) t FROM embeddings) GROUP BY 1,2),
p AS (SELECT x.label a, y.label b, corr(x.v,y.v) r FROM m x JOIN m y USING (t) WHERE x.label<y.label GROUP BY 1,2) SELECT least(floor((r+1)/2*20),19)::INT bin, count(*) n, round(avg(r),6) mean_r FROM p GROUP BY 1""")
def corr_distance_hist(spark, sf_dir):
    m = corr.unpacked(table(spark, sf_dir, "embeddings"), "label", "embedding").groupBy("label", "t").agg(F.avg("v").alias("v"))
    return rounded(corr.distance_histogram(corr.pairwise(m, "label", "t", "v"), "r", 20))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) t FROM embeddings), s AS (SELECT t, v sv FROM e WHERE vec_id=0) SELECT vec_id, round(corr(v,sv),6) r FROM e JOIN s USING (t) GROUP BY 1""")
def seed_corr(spark, sf_dir):
    return rounded(corr.seed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0))


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size)+(count(*) OVER (PARTITION BY p_brand,p_size)-1)/2.0 rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice)+(count(*) OVER (PARTITION BY p_brand,p_retailprice)-1)/2.0 ry FROM part)
SELECT p_brand, round(corr(rx,ry),6) rho, count(*) n FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    return rounded(corr.spearman(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT event_type, 2*pi()*hour(ts)/24 x, 2*pi()*minute(ts)/60 y FROM ev), m AS (SELECT event_type, atan2(avg(sin(x)),avg(cos(x))) mx, atan2(avg(sin(y)),avg(cos(y))) my FROM a GROUP BY 1)
SELECT event_type, round(sum(sin(x-mx)*sin(y-my))/sqrt(sum(sin(x-mx)**2)*sum(sin(y-my)**2)),6) r FROM a JOIN m USING (event_type) GROUP BY 1""")
def circular_corr(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", (2 * math.pi * F.hour("ts") / 24).alias("x"), (2 * math.pi * F.minute("ts") / 60).alias("y"))
    return rounded(corr.circular(d, ["event_type"], "x", "y"))


@query("WITH b AS (SELECT l_orderkey//64 block, corr(l_quantity,l_extendedprice) r, count(*) n FROM lineitem GROUP BY 1 HAVING count(*)>=3) SELECT block, round(r,6) r, n, round(ln((1+greatest(least(r,0.9999),-0.9999))/(1-greatest(least(r,0.9999),-0.9999))),5) z FROM b WHERE r IS NOT NULL AND NOT isnan(r)")
def local_pearson(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("block", F.floor(F.col("l_orderkey") / 64))
    r = corr.local_pearson(d, ["block"], "l_quantity", "l_extendedprice")
    return r.select("block", F.round("r", 6).alias("r"), "n", F.round("z", 5).alias("z"))


# -- series --------------------------------------------------------------------------------

W = "OVER (PARTITION BY user_id ORDER BY sec,event_id)"
ORDER = ["sec", "event_id"]


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(coalesce(value-lag(value) {W},0),6) AS diff FROM ev")
def temporal_diff(spark, sf_dir):
    return rounded(series.backward_diff(events(spark, sf_dir), ["user_id"], ORDER, "value").select("event_id", "diff"))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT event_id, coalesce(value-lag(value) {W},0) a, coalesce(sec-lag(sec) {W},0)/3600 b FROM ev) SELECT event_id, round(sqrt(a*a+b*b),6) enorm FROM d")
def enorm(spark, sf_dir):
    return rounded(series.enorm(events(spark, sf_dir).withColumn("h", F.col("sec") / 3600), ["user_id"], ORDER, ["value", "h"]).select("event_id", "enorm"))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT event_id, abs(coalesce(value-lag(value) {W},0))+50*radians(abs(coalesce(sec-lag(sec) {W},0)/36000)) fd FROM ev) SELECT event_id, round(fd,6) fd FROM d")
def framewise_displacement(spark, sf_dir):
    return rounded(series.framewise_displacement(events(spark, sf_dir).withColumn("deg", F.col("sec") / 36000), ["user_id"], ORDER, ["value"], ["deg"]).select("event_id", "fd"))


@query(f"WITH {EVENTS_SQL}, b AS (SELECT *, CASE WHEN abs(value)>90 THEN 1 ELSE 0 END b, row_number() {W} k FROM ev) SELECT event_id, (1-CASE WHEN k<=2 THEN 1 ELSE greatest(b, coalesce(lead(b) {W},0)) END)::INT keep FROM b")
def censor_mask(spark, sf_dir):
    return series.censor(events(spark, sf_dir), ["user_id"], ORDER, "value", 90, first=2).select("event_id", "keep")


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT event_type, day, avg(value) v FROM ev GROUP BY 1,2), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) k, count(*) OVER (PARTITION BY event_type) m, first(v) OVER (PARTITION BY event_type ORDER BY day) f, last(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) l, sum(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) s FROM d)
SELECT event_type, day, round((s+greatest(3-k,0)*f+greatest(k+2-m,0)*l)/5,6) smooth FROM n""")
def moving_average(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("event_type", "day").agg(F.avg("value").alias("v"))
    return rounded(series.moving_average(d, ["event_type"], ["day"], "v", 2).select("event_type", "day", "smooth"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(least(200, value*100.0/nullif(avg(value) OVER (PARTITION BY user_id,day//7),0)),5) scaled FROM ev")
def psc_scale(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("week", F.floor(F.col("day") / 7))
    return rounded(series.percent_scale(d, ["user_id", "week"], "value").select("event_id", "scaled"), 5)


@query(f"WITH {EVENTS_SQL}, h AS (SELECT event_type, hr, count(*) n FROM ev GROUP BY 1,2) SELECT event_type, hr, n lag_0, coalesce(lag(n,1) OVER (PARTITION BY event_type ORDER BY hr),0) lag_1, coalesce(lag(n,2) OVER (PARTITION BY event_type ORDER BY hr),0) lag_2 FROM h")
def fir_design(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", "hr").agg(F.count(F.lit(1)).alias("n"))
    return series.lags(h, ["event_type"], ["hr"], "n", 3).select("event_type", "hr", *(F.col(f"lag_{k}").cast("long").alias(f"lag_{k}") for k in range(3)))


@query("SELECT user_id, event_type, count(*) n, round(count(*)/sum(count(*)) OVER (PARTITION BY user_id),6) occupancy FROM events GROUP BY 1,2")
def occupancy(spark, sf_dir):
    return rounded(series.occupancy(table(spark, sf_dir, "events"), ["user_id"], "event_type"))


@query("WITH o AS (SELECT user_id, event_type, count(*)/sum(count(*)) OVER (PARTITION BY user_id) p FROM events GROUP BY 1,2) SELECT user_id, round(exp(-sum(p*ln(p))),6) effective FROM o GROUP BY 1")
def effective_states(spark, sf_dir):
    return rounded(series.effective_states(table(spark, sf_dir, "events"), ["user_id"], "event_type"))


RUNS = f"{EVENTS_SQL}, c AS (SELECT *, CASE WHEN lag(event_type) {W}=event_type THEN 0 ELSE 1 END c FROM ev), v AS (SELECT *, sum(c) {W} visit FROM c), r AS (SELECT user_id, visit, event_type, count(*) frames FROM v GROUP BY 1,2,3)"


@query(f"WITH {RUNS} SELECT event_type, count(*) visits, sum(frames)::BIGINT frames, round(sum(frames)/count(*),6) lifetime FROM r GROUP BY 1")
def mean_lifetime(spark, sf_dir):
    return rounded(series.mean_lifetime(events(spark, sf_dir), ["user_id"], ORDER, "event_type"))


@query(f"WITH {RUNS} SELECT user_id, visit::BIGINT visit, event_type, frames FROM r")
def dwell_segments(spark, sf_dir):
    return series.visits(events(spark, sf_dir), ["user_id"], ORDER, "event_type").select("user_id", "visit", "event_type", "frames")


@query(f"WITH {EVENTS_SQL}, t AS (SELECT event_type source, lead(event_type) {W} target FROM ev) SELECT source, target, count(*) n, round(count(*)/sum(count(*)) OVER (PARTITION BY source),6) p FROM t WHERE target IS NOT NULL GROUP BY 1,2")
def transition_matrix(spark, sf_dir):
    return rounded(series.transitions(events(spark, sf_dir), ["user_id"], ORDER, "event_type"))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT user_id, event_type, lag(event_type) {W} l FROM ev) SELECT user_id, round(avg(CASE WHEN l<>event_type THEN 1.0 ELSE 0.0 END),6) rate, count(*) n FROM t WHERE l IS NOT NULL GROUP BY 1")
def switch_rate(spark, sf_dir):
    return rounded(series.switch_rate(events(spark, sf_dir), ["user_id"], ORDER, "event_type"))


@query(f"WITH {RUNS}, s AS (SELECT event_type s0, lead(event_type,1) OVER (PARTITION BY user_id ORDER BY visit) s1, lead(event_type,2) OVER (PARTITION BY user_id ORDER BY visit) s2 FROM r) SELECT s0,s1,s2,count(*) n FROM s WHERE s2 IS NOT NULL GROUP BY 1,2,3")
def switch_paths(spark, sf_dir):
    return series.switch_paths(events(spark, sf_dir), ["user_id"], ORDER, "event_type")


@query(f"WITH {EVENTS_SQL}, g AS (SELECT lag(event_type) {W} c, event_type nxt FROM ev), n AS (SELECT c, nxt, count(*) n FROM g WHERE c IS NOT NULL GROUP BY 1,2), m AS (SELECT *, sum(n) OVER (PARTITION BY c) m FROM n) SELECT round(-sum(n*log2(n/m))/sum(n),6) bits, sum(n)::BIGINT n FROM m")
def conditional_entropy(spark, sf_dir):
    return rounded(series.conditional_entropy(events(spark, sf_dir), ["user_id"], ORDER, "event_type"))


# -- events -------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click','view') AND try_cast(user_id AS DOUBLE) NOT IN (1,2,3)")
def event_filter_in_out(spark, sf_dir):
    d = series.filter_events(table(spark, sf_dir, "events"), "event_type", ["click", "view"])
    return series.filter_events(d, "user_id", ["1.0", 2, "3"], keep=False).select("event_id", "event_type")


@query(f"WITH {EVENTS_SQL}, d AS (SELECT event_type, day, sec, (event_id%3)::DOUBLE dur FROM ev), u AS (SELECT event_type, median(dur) duration FROM (SELECT DISTINCT event_type, dur FROM d) GROUP BY 1) SELECT event_type, day, count(*) n, round(sum(sec),2) total, min(sec) first_onset, duration FROM d JOIN u USING (event_type) GROUP BY event_type, day, duration")
def events_parse(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("dur", (F.col("event_id") % 3).cast("double"))
    p = series.parse_events(d, "day", "event_type", "sec", "dur")
    return p.select("event_type", "day", F.size("onsets").cast("long").alias("n"), F.round(F.aggregate("onsets", F.lit(0.0), lambda s, x: s + x), 2).alias("total"), F.col("onsets")[0].alias("first_onset"), "duration")


@query(f"WITH {EVENTS_SQL} SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY sec,event_id)::INT trial, row_number() OVER (PARTITION BY day,event_type ORDER BY sec,event_id)::INT repetition FROM ev")
def trial_table(spark, sf_dir):
    return series.trial_table(events(spark, sf_dir), "day", "sec", "event_id", "event_type").select("event_id", "trial", "repetition")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT user_id, sec, event_type, round_even((sec+5)/600,0)::INT s, round_even((sec+5)/600,0)::INT+round_even((600+event_id%5*300)/600.0,0)::INT e FROM ev), f AS (SELECT user_id, sec, event_type, unnest(range(s, least(e,5000))) frame FROM e)
SELECT user_id, frame::INT frame, arg_max(event_type, (sec, event_type)) AS label FROM f GROUP BY 1,2""")
def event_interval_label(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("dur", (600 + F.col("event_id") % 5 * 300).cast("double"))
    return series.interval_labels(d, "user_id", "sec", "dur", "event_type", 600.0, 5000, 5.0)


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, (h*3600)::DOUBLE sec FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0,720)) h)), j AS (SELECT f.user_id, f.sec, arg_max(e.event_type, (e.sec, e.event_id)) AS label FROM f LEFT JOIN ev e ON e.user_id=f.user_id AND e.sec<=f.sec GROUP BY 1,2) SELECT user_id, sec, label FROM j""")
def event_asof_label(spark, sf_dir):
    e = events(spark, sf_dir)
    frames = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("h")).select("user_id", (F.col("h") * 3600).cast("double").alias("sec"))
    return series.asof_labels(frames, e, ["user_id"], "sec", "event_type", "event_id")


@query(f"WITH {EVENTS_SQL} SELECT day, (hr%24)::INT AS hour, count(*) n, round(sum(value),4) total, max(value) top FROM ev GROUP BY 1,2")
def excitation_groups(spark, sf_dir):
    return events(spark, sf_dir).groupBy("day", (F.col("hr") % 24).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"))


# -- calculator ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice*(1-l_discount)+sqrt(greatest(l_tax,0))-CASE WHEN l_quantity-25>0 THEN 1 ELSE 0 END,5) v, round(greatest(l_discount,l_tax)**2,6) w FROM lineitem")
def expr_3dmath(spark, sf_dir):
    names = {"a": F.col("l_extendedprice"), "b": F.col("l_discount"), "c": F.col("l_tax"), "d": F.col("l_quantity")}
    v, w = (expressions.compiled(t, names) for t in ("a*(1-b)+sqrt(c)-step(d-25)", "max(b,c)**2"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 5).alias("v"), F.round(w, 6).alias("w"))


@query("SELECT l_orderkey, round(avg(l_quantity),6) mean, sum(l_quantity) total, max(l_quantity) top, min(l_quantity) low, round(coalesce(stddev_samp(l_quantity),0),6) std, quantile_disc(l_quantity,0.5) median FROM lineitem GROUP BY 1")
def reduce_3dmath(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(q), 6).alias("mean"), F.sum(q).alias("total"), F.max(q).alias("top"), F.min(q).alias("low"), F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("std"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("median"))


@query("SELECT 0 AS brick, l_orderkey, l_linenumber, l_discount AS value FROM lineitem UNION ALL SELECT 1, l_orderkey, l_linenumber, l_tax FROM lineitem")
def tcat(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.expr("stack(2, 0, l_discount, 1, l_tax) as (brick, value)"))


@query("""WITH r AS (SELECT user_id, avg(value) ref FROM events GROUP BY 1), m AS (SELECT user_id FROM r WHERE ref>=(SELECT quantile_cont(ref,0.6) FROM r))
SELECT event_type, round(avg(value),6) mean, count(*) n FROM events JOIN m USING (user_id) GROUP BY 1""")
def volume_means(spark, sf_dir):
    return rounded(groups.volume_means(table(spark, sf_dir, "events"), "user_id", "event_type", "value"))
