"""More registered queries: frames, masks, checks and series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, series
from .queries import EVENTS_SQL, ORDER, W, events, query, rounded, table


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber=3 THEN 0 ELSE l_quantity END,4) v FROM lineitem")
def zero_non_finite(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(frames.finite(x), 4).alias("v"))


@query(f"WITH {EVENTS_SQL}, p AS (SELECT user_id, day//7 wk, max(CASE WHEN value>20 THEN value ELSE 0 END) top FROM ev GROUP BY 1,2) SELECT DISTINCT user_id FROM p WHERE top=0")
def invalid_mask(spark, sf_dir):
    d = events(spark, sf_dir).select("user_id", F.floor(F.col("day") / 7).alias("wk"), F.when(F.col("value") > 20, F.col("value")).otherwise(0.0).alias("v"))
    return frames.invalid_entities(d, "user_id", "wk", "v")


@query("WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)-1 k, count(*) OVER (PARTITION BY o_orderpriority) n FROM orders) SELECT o_orderpriority, o_totalprice quantile FROM r WHERE k=round_even(0.9*(n-1),0)::INT")
def quantile_nearest(spark, sf_dir):
    return frames.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.9, "o_orderkey")


@query("SELECT min(p_size) low_p_size, max(p_size) high_p_size, min(p_partkey) low_p_partkey, max(p_partkey) high_p_partkey FROM part WHERE greatest(p_retailprice-1200,0)<>0")
def autobox(spark, sf_dir):
    return frames.bounds(table(spark, sf_dir, "part"), ["p_size", "p_partkey"], F.greatest(F.col("p_retailprice") - 1200, F.lit(0.0)))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity*cos(l_discount),6) re, round(l_quantity*sin(l_discount),6) im FROM lineitem")
def polar_to_cartesian(spark, sf_dir):
    re, im = frames.polar(F.col("l_quantity"), F.col("l_discount"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", re.alias("re"), im.alias("im")))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_discount*l_discount+l_tax*l_tax),6) magnitude, round(atan2(l_tax,l_discount),6) phase FROM lineitem")
def cartesian_to_polar(spark, sf_dir):
    m, p = frames.cartesian(F.col("l_discount"), F.col("l_tax"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.alias("magnitude"), p.alias("phase")))


@query("WITH f AS (SELECT p_partkey, p_size/10.0 f FROM part), m AS (SELECT p_partkey, f-floor(f/0.5)*0.5 m FROM f) SELECT p_partkey, round(least(m,0.5-m),6) aliased FROM m")
def alias_frequency(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(frames.alias(F.col("p_size") / 10.0, 2.0), 6).alias("aliased"))


@query("SELECT p_partkey, round(exp(-((p_size-25)*(p_size-25)+(p_retailprice/50-25)*(p_retailprice/50-25))/(2*16.0))/(2*pi()*16.0),9) w FROM part")
def receptive_field(spark, sf_dir):
    w = frames.receptive_field(F.col("p_size").cast("double"), F.col("p_retailprice") / 50, 25.0, 25.0, 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(w, 9).alias("w"))


@query("SELECT DISTINCT p_size, round(0.6*exp(-p_size*p_size/(2*9.0))+0.4*exp(-p_size/5.0),8) acf FROM part")
def acf_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", F.round(frames.acf(F.col("p_size").cast("double"), 0.6, 3.0, 5.0), 8).alias("acf")).distinct()


LATE = f"{EVENTS_SQL}, n AS (SELECT user_id, 0.8*max(sec) len FROM ev GROUP BY 1)"


def _lengths(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg((0.8 * F.max("sec")).alias("len"))


@query(f"WITH {LATE} SELECT event_id, sec FROM ev JOIN n USING (user_id) WHERE sec>=len")
def find_late_events(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "sec")
    return frames.late_events(e, _lengths(spark, sf_dir), "user_id", "sec", "len", False).select("event_id", "sec")


@query(f"WITH {LATE} SELECT event_id, sec FROM ev JOIN n USING (user_id) WHERE sec<len")
def drop_late_events(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "sec")
    return frames.late_events(e, _lengths(spark, sf_dir), "user_id", "sec", "len", True).select("event_id", "sec")


@query("SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1 HAVING count(*)>1")
def find_duplicate_inputs(spark, sf_dir):
    return frames.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority='1-URGENT' THEN 'A' ELSE 'B' END side FROM orders WHERE o_orderpriority='1-URGENT' OR o_orderpriority NOT IN ('5-LOW')")
def select_one_vs_all(spark, sf_dir):
    return frames.one_vs_all(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", ["5-LOW"]).select("o_orderkey", "side")


@query("SELECT event_id, trim(regexp_replace(concat('  ', event_type, '   x '), '\\s+', ' ', 'g')) AS label FROM events")
def canonicalize_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.canonical(F.concat(F.lit("  "), F.col("event_type"), F.lit("   x "))).alias("label"))


@query(f"WITH {EVENTS_SQL} SELECT event_type, greatest(least(round_even(sec/7200,0)::INT,299),0)::INT frame, count(*) n FROM ev GROUP BY 1,2")
def onsets_to_tr_matrix(spark, sf_dir):
    return frames.onset_counts(events(spark, sf_dir), ["event_type"], "sec", 7200.0, 300)


@query(f"WITH {EVENTS_SQL}, e AS (SELECT event_id, sec, (event_id%4*10)::DOUBLE d, event_type FROM ev) SELECT event_id, sec onset, 0.0::DOUBLE duration, event_type||'_on' AS label FROM e UNION ALL SELECT event_id, sec+d, 0.0::DOUBLE, event_type||'_off' FROM e UNION ALL SELECT event_id, sec, d, event_type||'_sustained' FROM e")
def expand_events(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "sec", (F.col("event_id") % 4 * 10).cast("double").alias("d"), "event_type")
    return frames.expanded(e, "sec", "d", "event_type")


@query("SELECT event_id, least(CASE WHEN value<=80 THEN 1 ELSE 0 END, CASE WHEN user_id%5<>0 THEN 1 ELSE 0 END)::INT keep FROM events")
def combine_censor(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    a = d.select("event_id", F.when(F.col("value") <= 80, 1).otherwise(0).alias("keep"))
    b = d.select("event_id", F.when(F.col("user_id") % 5 != 0, 1).otherwise(0).alias("keep"))
    return frames.combined_keep([a, b], "event_id")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT *, lag(event_type) {W} l FROM ev), t AS (SELECT event_id, user_id, sec, CASE WHEN l<>event_type THEN 1.0 ELSE 0.0 END s FROM s WHERE l IS NOT NULL) SELECT event_id, round(avg(s) OVER (PARTITION BY user_id ORDER BY sec,event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) rate FROM t")
def windowed_switch_rate(spark, sf_dir):
    return rounded(frames.windowed_switch_rate(events(spark, sf_dir), ["user_id"], ORDER, "event_type", 5).select("event_id", "rate"))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT row_number() {W} step, lag(event_type) {W} l, event_type s FROM ev) SELECT step::INT step, round(avg(CASE WHEN l<>s THEN 1.0 ELSE 0.0 END),6) p, count(*) n FROM s WHERE l IS NOT NULL GROUP BY 1")
def switching_probability(spark, sf_dir):
    return rounded(frames.switching_over_time(events(spark, sf_dir), "user_id", ORDER, "event_type"))


@query("""WITH b AS (SELECT l_orderkey%16 b, count(*)::DOUBLE n, sum(l_quantity) x, sum(l_extendedprice) y, sum(l_quantity*l_quantity) xx, sum(l_quantity*l_extendedprice) xy FROM lineitem GROUP BY 1), t AS (SELECT sum(n) n, sum(x) x, sum(y) y, sum(xx) xx, sum(xy) xy FROM b),
v AS (SELECT ((t.n-b.n)*(t.xy-b.xy)-(t.x-b.x)*(t.y-b.y))/((t.n-b.n)*(t.xx-b.xx)-(t.x-b.x)*(t.x-b.x)) v, (t.n*t.xy-t.x*t.y)/(t.n*t.xx-t.x*t.x) s FROM b, t) SELECT round(max(s),5) slope, count(*) blocks, round(var_pop(v)*(count(*)-1),3) variance FROM v""")
def jackknife_variance(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_orderkey") % 16)
    r = frames.jackknife(d, "b", "l_quantity", "l_extendedprice")
    return r.select(F.round("slope", 5).alias("slope"), "blocks", F.round("variance", 3).alias("variance"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, row_number() {W} i, count(*) OVER (PARTITION BY user_id) n, value-avg(value) OVER (PARTITION BY user_id) c FROM ev), h AS (SELECT *, least(2+least(n//8, round(3*ln(n))::BIGINT), n//2) h FROM c),
s AS (SELECT user_id, n, h, sum(c*c) s0 FROM h GROUP BY 1,2,3), k AS (SELECT x.user_id, y.i-x.i k, sum(x.c*y.c) p FROM h x JOIN h y ON x.user_id=y.user_id AND y.i>x.i AND y.i-x.i<=x.h GROUP BY 1,2)
SELECT user_id, n, h lags, greatest(h-2,1) dof, CASE WHEN n>=10 AND s0>=1e-10 THEN round(n*(n+2)*sum((p/s0)*(p/s0)/(n-k)),5) ELSE 0 END ljung_box FROM s LEFT JOIN k USING (user_id) GROUP BY user_id, n, h, s0""")
def ljung_box(spark, sf_dir):
    return rounded(frames.ljung_box(events(spark, sf_dir), ["user_id"], ORDER, "value"), 5)


# No bin of these tables has under 4 rows, so that nothing is merged and SQL can tell the states.
@query("""WITH e AS (SELECT min(l_discount::DOUBLE) la, max(l_discount::DOUBLE)-min(l_discount::DOUBLE) wa, min(l_tax::DOUBLE) lb, max(l_tax::DOUBLE)-min(l_tax::DOUBLE) wb FROM lineitem),
g AS (SELECT least(floor((l_discount::DOUBLE-la)/wa*8),7)::INT bin_a, least(floor((l_tax::DOUBLE-lb)/wb*8),7)::INT bin_b, count(*) n FROM lineitem, e GROUP BY 1,2)
SELECT bin_a, bin_b, n, (row_number() OVER (ORDER BY bin_a, bin_b)-1)::INT state, n state_n FROM g""")
def design_state_bins(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return frames.state_bins(d, ["a", "b"], 8, 4)


@query("WITH s AS (SELECT DISTINCT c_nationkey%10 e, c_mktsegment g FROM customer WHERE c_acctbal>9000), p AS (SELECT e, string_agg(g, ',' ORDER BY g) pattern FROM s WHERE g IN ('BUILDING','MACHINERY','HOUSEHOLD') GROUP BY 1), a AS (SELECT DISTINCT c_nationkey%10 e FROM customer) SELECT coalesce(pattern,'') AS pattern, count(*) n FROM a LEFT JOIN p USING (e) GROUP BY 1")
def validity_families(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 10).alias("e"), "c_mktsegment", F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).alias("v"))
    return frames.patterns(d, "e", "c_mktsegment", "v", ["BUILDING", "MACHINERY", "HOUSEHOLD"])


@query("SELECT event_type, (hour(ts)//6)::INT part, count(*) n, round(count(*)/sum(count(*)) OVER (PARTITION BY event_type),6) share FROM events GROUP BY 1,2")
def align_states_to_task(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", F.floor(F.hour("ts") / 6).cast("int").alias("part"))
    return rounded(frames.factor_alignment(d, "event_type", "part"))


@query("SELECT count(l_discount) n, round(avg(l_discount),6) mean, round(median(l_discount),6) median, round(avg(CASE WHEN l_discount>=0.03 THEN 1.0 ELSE 0.0 END),6) over_3, round(avg(CASE WHEN l_discount>=0.08 THEN 1.0 ELSE 0.0 END),6) over_8 FROM lineitem")
def consistency_report(spark, sf_dir):
    return rounded(frames.consistency(table(spark, sf_dir, "lineitem"), "l_discount", [0.03, 0.08]))
