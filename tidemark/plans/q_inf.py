"""Queries over resampling and asymptotic inference, and strategy economics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.columns import qlike
from ..operators import economics as EC
from ..operators import inference as I
from ..operators.series import session_series
from ..sources.results import materialise
from . import standin as X
from .q_agg import long_losses, ncdf_sql
from .q_sca import LEGS, SNAP, hedged
from .registry import query
from .standin import SERIES_SQL, sql

REPS, BLOCK, SEED = 2000, 5, 650


def h(*parts, at=1):
    return f"('0x'||substr(md5(concat_ws('-',{','.join(str(p) for p in parts)})),{at},8))::BIGINT"


def boot_sql(src="series", key="series", value="value", block=BLOCK, name="boot", reps=REPS):
    """Circular block bootstrap means; every possible block is summed once, as a repetition needs blocks, not sessions."""
    return f"""{name}_n AS (SELECT {key}, count(*) AS n, (count(*)+{block - 1})//{block} AS blocks FROM {src} GROUP BY 1),
 {name}_s AS (SELECT {key}, start, sum({value}) AS whole, sum({value}) FILTER (o<n-(blocks-1)*{block}) AS cut FROM (SELECT s.{key}, s.{value}, n, blocks, o, ((s.idx-o)%n+n)%n AS start FROM {src} s JOIN {name}_n USING ({key}), (SELECT unnest(range({block})) AS o)) GROUP BY 1,2),
 {name}_d AS (SELECT {key}, n, blocks, rep, b, {h(SEED,'rep','b')} % n AS start FROM {name}_n, (SELECT unnest(generate_series(1,{reps})) AS rep), LATERAL (SELECT unnest(range(blocks)) AS b)),
 {name} AS (SELECT {key}, rep, sum(CASE WHEN b=blocks-1 THEN cut ELSE whole END)/max(n) AS m FROM {name}_d JOIN {name}_s USING ({key}, start) GROUP BY 1,2)"""


CI = """round(quantile_cont(m,0.025),6) AS ci_low, round(quantile_cont(m,0.975),6) AS ci_high, round(least(1.0::DOUBLE, 2*least((count(*) FILTER (m<=0)+1.0::DOUBLE)/(count(*)+1), (count(*) FILTER (m>=0)+1.0::DOUBLE)/(count(*)+1))),6) AS p_value"""
EST = "(SELECT series, round(avg(value),6) AS estimate, count(*) AS sessions FROM series GROUP BY 1)"


@query("inf2_block_bootstrap", sql(f"SELECT e.*, ci_low, ci_high, p_value FROM {EST} e JOIN (SELECT series, {CI} FROM boot GROUP BY 1) USING (series)", SERIES_SQL, boot_sql()))
def _(spark, d):
    return I.block_bootstrap(X.loss_series(spark, d), ["series"], BLOCK, REPS, SEED)


DAYS_SQL = f"""dayt AS (SELECT series, idx, value*origins AS total, origins AS rows FROM series),
 dayb AS (SELECT series, rep, sum(total)/sum(rows) AS m FROM (SELECT d.series, d.rep, s.total, s.rows FROM (SELECT series, rep, {h(SEED,'rep','pos')} % n AS idx FROM (SELECT series, count(*) AS n FROM dayt GROUP BY 1), (SELECT unnest(generate_series(1,{REPS})) AS rep), LATERAL (SELECT unnest(generate_series(0, n-1)) AS pos)) d
   JOIN dayt s ON s.series=d.series AND s.idx=d.idx) GROUP BY 1,2)"""


@query("inf3_paired_day_bootstrap", sql(f"""
SELECT e.*, ci_low, ci_high, p_value FROM (SELECT series, round(sum(total)/sum(rows),6) AS estimate, count(*) AS clusters, sum(rows)::BIGINT AS observations FROM dayt GROUP BY 1) e JOIN (SELECT series, {CI} FROM dayb GROUP BY 1) USING (series)""", SERIES_SQL, DAYS_SQL))
def _(spark, d):
    s = X.loss_series(spark, d).select("series", "idx", (F.col("value") * F.col("origins")).alias("total"), F.col("origins").alias("rows"))
    return I.paired_day_bootstrap(s, ["series"], REPS, SEED)


def wild_sql(weight, name):
    return f"""{name} AS (SELECT series, round((count(*) FILTER (st>=ob)+1.0::DOUBLE)/(count(st)+1),6) AS wild_p FROM (SELECT series, rep, abs(avg(w*c)/(stddev_samp(w*c)/sqrt(count(*)))) AS st, max(ob) AS ob FROM
   (SELECT series, rep, c, ob, {weight} AS w FROM (SELECT series, idx, value-avg(value) OVER p AS c, abs(avg(value) OVER p/(stddev_samp(value) OVER p/sqrt(count(*) OVER p))) AS ob FROM series WINDOW p AS (PARTITION BY series)), (SELECT unnest(generate_series(1,{REPS})) AS rep)) GROUP BY 1,2) GROUP BY 1)"""


RADEMACHER = f"CASE WHEN {h(SEED,'rep','idx')}%2=0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


@query("inf4_wild_rademacher", sql("SELECT * FROM wild", SERIES_SQL, wild_sql(RADEMACHER, "wild")))
def _(spark, d):
    return I.wild_bootstrap(X.loss_series(spark, d), ["series"], REPS, SEED)


@query("inf4_wild_webb", sql("SELECT * FROM wild", SERIES_SQL, wild_sql(
    f"[-sqrt(1.5::DOUBLE),-1.0::DOUBLE,-sqrt(0.5::DOUBLE),sqrt(0.5::DOUBLE),1.0::DOUBLE,sqrt(1.5::DOUBLE)][{h(SEED,'rep','idx')}%6+1]", "wild")))
def _(spark, d):
    return I.wild_bootstrap(X.loss_series(spark, d), ["series"], REPS, SEED, True)


SIDX = f"""sidx AS (SELECT rep, pos, n, (max_by_s + pos - lastp) % n AS idx FROM (SELECT rep, pos, n, last_value(CASE WHEN rs THEN pos END IGNORE NULLS) OVER w AS lastp, last_value(CASE WHEN rs THEN st END IGNORE NULLS) OVER w AS max_by_s FROM
  (SELECT rep, pos, n, pos=0 OR {h(SEED,'rep','pos')} < 858993459 AS rs, {h(SEED,'rep','pos',at=9)} % n AS st FROM (SELECT max(idx)+1 AS n FROM cand), (SELECT unnest(generate_series(1,{REPS})) AS rep), LATERAL (SELECT unnest(generate_series(0,n-1)) AS pos)) WINDOW w AS (PARTITION BY rep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def candidates(spark, d):
    """Session benchmark-minus-candidate means of three candidate forecasts."""
    p = X.orders_series(spark, d)
    a, b, w = F.col("actual"), F.col("f_base"), F.col("f_wide")
    c = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), v.alias("v")) for n, v in (
        ("log_ols|wide", qlike(a, b) - qlike(a, w)), ("log_ols|mean", qlike(a, b) - qlike(a, (b + w) / 2.0)), ("log_ols|low", qlike(a, b) - qlike(a, w * 0.99)))]))
    long = p.select("session_date", c.alias("_c")).select("session_date", "_c.*").withColumn(
        "family", F.split("model", "\\|")[0])
    return session_series(long, ["family", "model"], "v")


CAND = """cand AS (SELECT model, session_date, avg(v) AS value, row_number() OVER (PARTITION BY model ORDER BY session_date)-1 AS idx FROM (SELECT session_date, unnest(['log_ols|wide','log_ols|mean','log_ols|low']) AS model,
  unnest([q0-(actual/f_wide-ln(actual/f_wide)-1), q0-(actual/((f_base+f_wide)/2)-ln(actual/((f_base+f_wide)/2))-1), q0-(actual/(f_wide*0.99::DOUBLE)-ln(actual/(f_wide*0.99::DOUBLE))-1)]) AS v FROM (SELECT *, actual/f_base-ln(actual/f_base)-1 AS q0 FROM panel)) GROUP BY 1,2),
 nwc AS (SELECT model, avg(value) AS mu, count(*) AS n, greatest((sum(c*c)+2*(1-1/6.0::DOUBLE)*sum(c*l1)+2*(1-2/6.0::DOUBLE)*sum(c*l2)+2*(1-3/6.0::DOUBLE)*sum(c*l3)+2*(1-4/6.0::DOUBLE)*sum(c*l4)+2*(1-5/6.0::DOUBLE)*sum(c*l5))/count(*), 1e-18) AS v FROM
   (SELECT *, lag(c,1) OVER w AS l1, lag(c,2) OVER w AS l2, lag(c,3) OVER w AS l3, lag(c,4) OVER w AS l4, lag(c,5) OVER w AS l5 FROM (SELECT *, value-avg(value) OVER (PARTITION BY model) AS c FROM cand) WINDOW w AS (PARTITION BY model ORDER BY idx)) GROUP BY 1)"""


@query("inf5_superior_ability", sql("""
SELECT 'log_ols' AS family, arg_max(model, mu) AS best_model, round(max(mu),6) AS best_mean, count(*) AS candidates, max(n) AS sessions, max(spa) AS spa_p, max(rc) AS reality_check_p FROM nwc,
 (SELECT round((count(*) FILTER (s>=s0)+1.0::DOUBLE)/(count(*)+1),6) AS spa, round((count(*) FILTER (r>=r0)+1.0::DOUBLE)/(count(*)+1),6) AS rc FROM
  (SELECT rep, max(greatest(sqrt(n)*(m-re)/sqrt(v),0)) AS s, max(sqrt(n)*(m-mu)) AS r FROM (SELECT i.rep, c.model, avg(c.value) AS m FROM sidx i JOIN cand c USING (idx) GROUP BY 1,2)
    JOIN (SELECT *, CASE WHEN mu>=-sqrt(v/n)*sqrt(2*ln(ln(n))) THEN mu ELSE 0 END AS re FROM nwc) USING (model) GROUP BY 1), (SELECT max(greatest(sqrt(n)*mu/sqrt(v),0)) AS s0, max(sqrt(n)*mu) AS r0 FROM nwc))""", CAND, SIDX))
def _(spark, d):
    return I.superior_ability(candidates(spark, d), ["family"], "model", 5.0, REPS, SEED)


NW_SQL = """nw AS (SELECT series, avg(value) AS estimate, count(*) AS clusters, greatest((sum(c*c)+2*(2/3.0::DOUBLE)*sum(c*l1)+2*(1/3.0::DOUBLE)*sum(c*l2))/count(*),0) AS lrv, stddev_samp(value) AS sd FROM
  (SELECT *, lag(c,1) OVER w AS l1, lag(c,2) OVER w AS l2 FROM (SELECT *, value-avg(value) OVER (PARTITION BY series) AS c FROM series) WINDOW w AS (PARTITION BY series ORDER BY idx)) GROUP BY 1)"""


@query("inf6_newey_west", sql(f"""
SELECT series, clusters, round(estimate,6) AS estimate, round(lrv,8) AS long_run_variance, round(estimate/sqrt(lrv/clusters),6) AS hac_t, round(estimate/(sd/sqrt(clusters)),6) AS cluster_t, round(2*(1-{ncdf_sql('abs(estimate/sqrt(lrv/clusters))')}),6) AS nw_p FROM nw""", SERIES_SQL, NW_SQL), 8)
def _(spark, d):
    n = I.newey_west(X.loss_series(spark, d), ["series"], 2)
    return n.select("series", "clusters", *[F.round(c, 6).alias(c) for c in ("estimate", "hac_t", "cluster_t", "nw_p")], "long_run_variance")


@query("inf6_cluster_t_tails")
def _(spark, d):
    return I.newey_west(X.loss_series(spark, d), ["series"], 2).select("series", "clusters", "cluster_t", "cluster_p", "hac_t_p")


def tq_sql(p, nu):
    from statistics import NormalDist
    z = NormalDist().inv_cdf(p)
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z!r}::DOUBLE" + "".join(f"+({x!r}::DOUBLE)/pow({nu},{i + 1})" for i, x in enumerate(g)) + ")"


@query("inf7_detectable_effect", sql(f"""
SELECT series, round(({tq_sql(0.975,'(clusters-1)')}+{tq_sql(0.8,'(clusters-1)')})*sqrt(lrv/clusters),6) AS mde, round(CASE WHEN estimate>0 THEN pow((1.6448536269514715::DOUBLE+0.8416212335729143::DOUBLE)*sd/estimate,2) END,1) AS required FROM nw""", SERIES_SQL, NW_SQL))
def _(spark, d):
    n = I.detectable_effect(I.newey_west(X.loss_series(spark, d), ["series"], 2))
    sd = F.col("cluster_se") * F.sqrt(F.col("clusters").cast("double"))
    return n.select("series", "mde", F.round(I.required_sessions(sd, F.col("estimate"), 0.05), 1).alias("required"))


CENT = f"""cent AS (SELECT series, idx, value-avg(value) OVER (PARTITION BY series) AS value FROM series)"""


@query("inf7_bootstrap_mde", sql("SELECT series, round(quantile_cont(m,0.9875)-quantile_cont(m,0.2),6) AS mde FROM bc GROUP BY 1", SERIES_SQL, CENT, boot_sql("cent", block=1, name="bc")))
def _(spark, d):
    return I.bootstrap_mde(X.loss_series(spark, d), ["series"], REPS, SEED)


@query("inf8_clark_west", sql("""
SELECT asset, count(*) AS n, round(avg(pow(actual-f_base,2)-(pow(actual-f_wide,2)-pow(f_base-f_wide,2))),6) AS mean_adjusted FROM panel GROUP BY 1"""))
def _(spark, d):
    t = I.clark_west(F.col("actual"), F.col("f_base"), F.col("f_wide"), True)
    return X.orders_series(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean_adjusted"))


GW_SQL = """gws AS (SELECT asset AS series, session_date AS w, avg(actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide))) AS d, avg(ln(f_base)) AS z FROM panel GROUP BY 1,2),
 gwc AS (SELECT series, count(*) AS n, regr_intercept(d,z) AS b0, regr_slope(d,z) AS b1, sum(z) AS sz, sum(z*z) AS szz FROM gws GROUP BY 1),
 gwm AS (SELECT series, max(n) AS n, max(b0) AS b0, max(b1) AS b1, max(sz) AS sz, max(szz) AS szz, sum(e*e) AS m00, sum(z*e*e) AS m01, sum(z*z*e*e) AS m11 FROM (SELECT g.series, n, b0, b1, sz, szz, z, d-b0-b1*z AS e FROM gws g JOIN gwc USING (series)) GROUP BY 1)"""


def gw_sessions(spark, d):
    p = X.orders_series(spark, d)
    diff = qlike(F.col("actual"), F.col("f_base")) - qlike(F.col("actual"), F.col("f_wide"))
    return p.groupBy(F.col("asset").alias("series"), "session_date").agg(
        F.avg(diff).alias("value"), F.avg(F.log("f_base")).alias("z"), F.avg(F.log(F.col("actual") / F.col("f_base"))).alias("log_bias"))


@query("inf9_giacomini_white", sql("""
SELECT series, n AS clusters, round(b0,6) AS b0, round(b1,6) AS b1, round(wald,4) AS wald, round(exp(-wald/2),5) AS p_value FROM (SELECT *, (u*u*m11-2*u*v*m01+v*v*m00)/(m00*m11-m01*m01) AS wald FROM (SELECT *, n*b0+sz*b1 AS u, sz*b0+szz*b1 AS v FROM gwm))""", GW_SQL))
def _(spark, d):
    g = I.giacomini_white(gw_sessions(spark, d), ["series"], "value", "z")
    return g.withColumn("wald", F.round("wald", 4)).withColumn("p_value", F.round("p_value", 5))


MCS_REPS = 9999


def confidence_sql(rounds: int, alpha: float = 0.1) -> str:
    """CTEs s0 .. s<rounds>: the state of every model after each round of elimination."""
    out = ["mm AS (SELECT split_part(series,'#',1) AS asset, split_part(series,'#',2) AS model, rep, m FROM (FROM boot UNION ALL SELECT series, 0, avg(value) FROM series GROUP BY 1))",
           "s0 AS (SELECT DISTINCT asset, model, 0.0::DOUBLE AS p, true AS survives, true AS open FROM mm)"]
    for r in range(rounds):
        out += [
            f"x{r} AS (SELECT mm.*, m-avg(m) OVER (PARTITION BY asset, rep) AS d FROM mm JOIN s{r} USING (asset, model) WHERE open)",
            f"e{r} AS (SELECT asset, model, max(d) FILTER (rep=0) AS d0, stddev_samp(d) FILTER (rep>0) AS s FROM x{r} GROUP BY 1,2)",
            f"w{r} AS (SELECT asset, max(t) AS stat, arg_min(model, (-t, model)) AS worst, count(*) AS n FROM (SELECT *, CASE WHEN s>0 THEN d0/s ELSE 0 END AS t FROM e{r}) GROUP BY 1)",
            f"n{r} AS (SELECT asset, rep, max(CASE WHEN s>0 THEN abs(d-d0)/s ELSE 0 END) AS z FROM x{r} JOIN e{r} USING (asset, model) WHERE rep>0 GROUP BY 1,2)",
            f"q{r} AS (SELECT asset, worst, n, (count(*) FILTER (z>=stat)+1.0::DOUBLE)/(count(*)+1) AS q FROM n{r} JOIN w{r} USING (asset) GROUP BY 1,2,3)",
            f"""s{r + 1} AS (SELECT asset, model, CASE WHEN NOT open THEN p WHEN n=1 THEN 1.0::DOUBLE ELSE greatest(p, q) END AS p,
   CASE WHEN NOT open THEN survives ELSE n=1 OR q>={alpha} OR model<>worst END AS survives, open AND NOT (n=1 OR q>={alpha} OR model=worst) AS open FROM s{r} LEFT JOIN q{r} USING (asset))""",
        ]
    return ",\n ".join(out)


LOSSES_SQL = """series AS (SELECT asset||'#'||model AS series, w AS session_date, avg(loss) AS value, row_number() OVER (PARTITION BY asset, model ORDER BY w)-1 AS idx FROM
 (SELECT asset, session_date AS w, unnest(['base','wide']) AS model, unnest([actual/f_base-ln(actual/f_base)-1, actual/f_wide-ln(actual/f_wide)-1]) AS loss FROM panel) GROUP BY asset, model, w)"""


@query("inf10_model_confidence_set", sql("SELECT asset, model, round(p,6) AS mcs_p, survives FROM s2", LOSSES_SQL, boot_sql(reps=MCS_REPS), confidence_sql(2)))
def _(spark, d):
    c = long_losses(spark, d).select("asset", "model", "session_date", "loss")
    return I.model_confidence_set(session_series(c, ["asset", "model"], "loss"), ["asset"], "model", BLOCK, MCS_REPS, SEED)


POW_SQL = f"""cent AS (SELECT series, idx, value-avg(value) OVER (PARTITION BY series) AS c, stddev_samp(value) OVER (PARTITION BY series)/4 AS e, count(*) OVER (PARTITION BY series) AS n FROM series),
 pdraw AS (SELECT series, sessions, rep, n, ({h(SEED,'rep','b')} % n + pos - b*5) % n AS idx FROM (SELECT series, n, sessions, rep, pos, pos//5 AS b FROM (SELECT DISTINCT series, n FROM cent), (VALUES (30::BIGINT),(90::BIGINT),(400::BIGINT)) s(sessions), (SELECT unnest(generate_series(1,{REPS})) AS rep), LATERAL (SELECT unnest(generate_series(0, sessions-1)) AS pos))),
 pst AS (SELECT d.series, d.sessions, d.rep, max(c.n) AS n, max(e) AS e, avg(c) AS m, stddev_samp(c)/sqrt(max(d.sessions)) AS se FROM pdraw d JOIN cent c ON c.series=d.series AND c.idx=d.idx GROUP BY 1,2,3)"""


@query("inf11_resampled_power", sql("""
SELECT series, sessions, round(avg(((m+e)/se>1.6448536269514715::DOUBLE)::INT),6) AS power, round(avg((m/se>1.6448536269514715::DOUBLE)::INT),6) AS null_rejection, max(n) AS observed_sessions FROM pst GROUP BY 1,2""", SERIES_SQL, POW_SQL))
def _(spark, d):
    s = X.loss_series(spark, d)
    e = s.groupBy("series").agg((F.stddev_samp("value") / 4.0).alias("effect"))
    return I.resampled_power(s.join(e, "series"), ["series"], [30, 90, 400], "effect", 0.05, BLOCK, REPS, SEED)


TREND_SQL = f"""tr AS (SELECT series, idx, value, date_diff('day', DATE '1995-01-01', session_date)/365.25::DOUBLE AS t FROM series),
 tf AS (SELECT series, count(*) AS days, regr_slope(value,t) AS slope, regr_intercept(value,t) AS intercept, regr_sxx(value,t) AS sxx, sqrt(greatest(regr_syy(value,t)-pow(regr_sxy(value,t),2)/regr_sxx(value,t),0)/(count(*)-2)/regr_sxx(value,t)) AS slope_se, avg(t) AS mt FROM tr GROUP BY 1),
 tb AS (SELECT t.series, rep, sum(({RADEMACHER})*(value-intercept-slope*t)*(t-mt))/max(sxx) AS b, max(abs(slope)) AS s FROM tr t JOIN tf USING (series), (SELECT unnest(generate_series(1,{REPS})) AS rep) GROUP BY 1,2)"""


@query("inf13_trend", sql("""
SELECT f.series, days, round(slope,6) AS slope, round(slope_se,6) AS slope_se, round(intercept,6) AS intercept, p AS slope_wild_p FROM tf f JOIN (SELECT series, round((count(*) FILTER (abs(b)>=s)+1.0::DOUBLE)/(count(*)+1),6) AS p FROM tb GROUP BY 1) USING (series)""", SERIES_SQL, TREND_SQL))
def _(spark, d):
    years = F.datediff("session_date", F.lit("1995-01-01").cast("date")) / 365.25
    return I.trend(X.loss_series(spark, d), ["series"], years, REPS, SEED)


@query("inf13_meta_regression", sql("""
SELECT campaigns, round(fe,6) AS fixed_effect, round(q,5) AS q, round(tau2,8) AS tau2, round(i2,5) AS i_squared, round(sum(rw*e)/sum(rw),6) AS random_effect, round(sqrt(1/sum(rw)),6) AS random_effect_se FROM (SELECT *, 1/(v+tau2) AS rw FROM mc,
 (SELECT count(*) AS campaigns, sum(e/v)/sum(1/v) AS fe, sum(e*e/v)-pow(sum(e/v),2)/sum(1/v) AS q, greatest(0, (sum(e*e/v)-pow(sum(e/v),2)/sum(1/v)-(count(*)-1))/(sum(1/v)-sum(1/(v*v))/sum(1/v))) AS tau2, greatest(0, (sum(e*e/v)-pow(sum(e/v),2)/sum(1/v)-(count(*)-1))/(sum(e*e/v)-pow(sum(e/v),2)/sum(1/v))) AS i2 FROM mc)) GROUP BY ALL""",
                                      SERIES_SQL, "mc AS (SELECT series, avg(value) AS e, var_samp(value)/count(*) AS v FROM series GROUP BY 1)"), 8)
def _(spark, d):
    m = I.meta_regression(X.loss_series(spark, d), [], "series")
    r6 = {c: F.round(c, 6) for c in ("fixed_effect", "random_effect", "random_effect_se")}
    return m.withColumns({**r6, "q": F.round("q", 5), "i_squared": F.round("i_squared", 5)})


@query("inf14_bias_regression", sql("""
SELECT series, count(*) AS days, round(regr_slope(d,b),6) AS slope, round(regr_slope(d,b)/sqrt((regr_syy(d,b)-pow(regr_sxy(d,b),2)/regr_sxx(d,b))/(count(*)-2)/regr_sxx(d,b)),4) AS slope_t, round(regr_r2(d,b),6) AS r_squared FROM
 (SELECT asset AS series, session_date AS w, avg(actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide))) AS d, avg(ln(actual/f_base)) AS b FROM panel GROUP BY 1,2) GROUP BY 1"""))
def _(spark, d):
    return I.bias_regression(gw_sessions(spark, d), ["series"], "value", "log_bias").withColumn("slope_t", F.round("slope_t", 4))


@query("inf1_session_contrast", sql(f"""
SELECT e.series, e.estimate, e.sessions, ci_low, ci_high, p_value, round(({tq_sql(0.975,'(clusters-1)')}+{tq_sql(0.8,'(clusters-1)')})*sqrt(lrv/clusters),6) AS mde, round(2*(1-{ncdf_sql('abs(nw.estimate/sqrt(lrv/clusters))')}),6) AS nw_p, wild_p,
 round(bd,6) AS equivalence_bound, ci_low>-bd AND ci_high<bd AS equivalent, 5::BIGINT AS block_length FROM {EST} e JOIN (SELECT series, {CI} FROM boot GROUP BY 1) USING (series) JOIN nw USING (series) JOIN wild USING (series) JOIN
 (SELECT asset AS series, 0.02::DOUBLE*avg(actual/f_base-ln(actual/f_base)-1) AS bd FROM panel GROUP BY 1) USING (series)""", SERIES_SQL, boot_sql(), NW_SQL, wild_sql(RADEMACHER, "wild")))
def _(spark, d):
    p = X.orders_series(spark, d)
    ls = p.select(F.col("asset").alias("series"), "session_date",
                  qlike(F.col("actual"), F.col("f_base")).alias("lb"), qlike(F.col("actual"), F.col("f_wide")).alias("lw"))
    return I.session_contrast(ls, ["series"], "lb", "lw", BLOCK, REPS, SEED, 2).drop("hac_se")


VIEW_SQL = f"""vd AS (SELECT dimension, vw, session_date, row_number() OVER (PARTITION BY dimension, vw ORDER BY session_date)-1 AS idx, dimension||'#'||vw AS series, total, rows FROM (SELECT dimension, vw, session_date, sum(d) AS total, count(d) AS rows FROM
   (SELECT unnest(['global','asset','quarter']) AS dimension, unnest(['all', asset, quarter(session_date)::VARCHAR]) AS vw, session_date, actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide)) AS d FROM panel) GROUP BY 1,2,3)),
 vb AS (SELECT series, rep, sum(total)/sum(rows) AS m FROM (SELECT d.series, d.rep, s.total, s.rows FROM (SELECT series, rep, {h(SEED,'rep','pos')} % n AS idx FROM (SELECT series, count(*) AS n FROM vd GROUP BY 1), (SELECT unnest(generate_series(1,{REPS})) AS rep), LATERAL (SELECT unnest(generate_series(0, n-1)) AS pos)) d
   JOIN vd s ON s.series=d.series AND s.idx=d.idx) GROUP BY 1,2),
 vc AS (SELECT series, {CI.replace("round(least(","(least(").replace(",6) AS p_value",") AS p_value")} FROM vb GROUP BY 1),
 ve AS (SELECT series, max(dimension) AS dimension, max(vw) AS vw, sum(total)/sum(rows) AS estimate, count(*) AS clusters, sum(rows)::BIGINT AS observations FROM vd GROUP BY 1)"""


@query("inf15_evaluation_views", sql("""
SELECT dimension, vw AS "view", round(estimate,6) AS estimate, clusters, observations, ci_low, ci_high, round(p_value,6) AS p_value, round(adjusted,6) AS adjusted, CASE WHEN estimate>0 AND ci_low>0 AND adjusted<0.05 THEN 'CONFIRMED' WHEN estimate<0 AND ci_high<0 THEN 'REVERSED' ELSE 'NOT_CONFIRMED' END AS claim FROM
 (SELECT *, max(raw) OVER (PARTITION BY dimension ORDER BY p_value, vw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY dimension)-row_number() OVER (PARTITION BY dimension ORDER BY p_value, vw)+1)*p_value) AS raw FROM ve JOIN vc USING (series)))""", VIEW_SQL))
def _(spark, d):
    p = X.orders_series(spark, d)
    diff = qlike(F.col("actual"), F.col("f_base")) - qlike(F.col("actual"), F.col("f_wide"))
    ls = p.select("asset", F.quarter("session_date").alias("q"), "session_date", diff.alias("difference"))
    out = I.evaluation_views(ls, {"global": F.lit("all"), "asset": F.col("asset"), "quarter": F.col("q")}, REPS, SEED)
    return out


@query("inf16_chronological_deltas", sql("""
SELECT year(session_date) AS fold, asset, count(*) AS n, round(avg(actual/f_base-ln(actual/f_base)-1),6) AS base_qlike, round(avg(actual/f_wide-ln(actual/f_wide)-1),6) AS wide_qlike, round(avg(actual/f_base-ln(actual/f_base)-(actual/f_wide-ln(actual/f_wide))),6) AS delta FROM panel GROUP BY 1,2"""))
def _(spark, d):
    p = X.orders_series(spark, d)
    b, w = qlike(F.col("actual"), F.col("f_base")), qlike(F.col("actual"), F.col("f_wide"))
    return p.groupBy(F.year("session_date").cast("bigint").alias("fold"), "asset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(b).alias("base_qlike"), F.avg(w).alias("wide_qlike"), F.avg(b - w).alias("delta"))


PERF = """perf AS (SELECT key, count(*) AS periods, avg(x) AS mean, stddev_samp(x) AS vol, avg((x>0)::INT) AS hit, stddev_samp(x) FILTER (x<0) AS dn, stddev_pop(x) AS sp, avg(x*x*x) AS x3, avg(x*x) AS x2, kurtosis_pop(x)+3 AS kurt, quantile_cont(x,0.05) AS q FROM pnl GROUP BY 1),
 dd AS (SELECT key, min(eq-mx) AS max_drawdown FROM (SELECT key, eq, max(eq) OVER (PARTITION BY key ORDER BY o) AS mx FROM (SELECT key, o, sum(x) OVER (PARTITION BY key ORDER BY o) AS eq FROM pnl)) GROUP BY 1),
 es AS (SELECT key, avg(x) FILTER (x<=q) AS shortfall FROM pnl JOIN perf USING (key) GROUP BY 1)"""
PERF_OUT = """key, periods, round(mean,6) AS mean, round(vol,6) AS volatility, round(hit,6) AS hit_rate, round((x3-3*mean*x2+2*mean*mean*mean)/(sp*sp*sp),4) AS skewness, round(kurt,4) AS kurtosis, round(max_drawdown,5) AS max_drawdown, round(shortfall,6) AS shortfall_5pct,
 round(sqrt(252.0::DOUBLE)*mean/vol,5) AS sharpe, round(sqrt(252.0::DOUBLE)*mean/dn,5) AS sortino"""
VPNL = """pnl AS (SELECT asset AS key, origin_id AS o, position*(actual-f_base)-abs(position)*0.5 AS x, position*(actual-f_base) AS gross, position FROM (SELECT *, CASE WHEN f_base-f_wide>0.6 THEN -1.0::DOUBLE WHEN f_base-f_wide<-0.6 THEN 1.0 ELSE 0.0 END AS position FROM panel))"""


def variance_pnl(spark, d):
    p = X.orders_series(spark, d)
    p = p.withColumn("position", EC.variance_position(F.col("f_base"), F.col("f_wide"), F.lit(0.5), 0.1))
    gross, net = EC.variance_pnl(F.col("position"), F.col("f_base"), F.col("actual"), F.lit(0.5))
    return p.select(F.col("asset").alias("key"), F.col("origin_id").alias("o"), "position", gross.alias("gross"), net.alias("x"))


def _perf(df):
    m = EC.performance(df, ["key"], "o", "x", 252.0)
    return m.withColumns({**{c: F.round(c, 4) for c in ("skewness", "kurtosis")}, **{c: F.round(c, 5) for c in ("max_drawdown", "sharpe", "sortino")}})


@query("eco1_performance", sql(f"SELECT {PERF_OUT} FROM perf JOIN dd USING (key) JOIN es USING (key)", VPNL, PERF))
def _(spark, d):
    return _perf(variance_pnl(spark, d))


@query("eco2_deflated_sharpe", sql(f"""
SELECT key, round({ncdf_sql('z')},5) AS deflated, round(be,6) AS break_even FROM (SELECT key, (mean/vol-best)*sqrt(periods-1.0::DOUBLE)/sqrt(greatest(1-sk*mean/vol+(kurt-1)/4*pow(mean/vol,2),1e-12)) AS z, be FROM (SELECT *, (x3-3*mean*x2+2*mean*mean*mean)/(sp*sp*sp) AS sk, {{best}}::DOUBLE AS best FROM perf)
 JOIN (SELECT key, sum(gross)/sum(abs(position)) AS be FROM pnl GROUP BY 1) USING (key))""".replace("{best}", repr(
     (1 - EC.EULER) * NormalDist().inv_cdf(1 - 1 / 12) + EC.EULER * NormalDist().inv_cdf(1 - 1 / (12 * 2.718281828459045)))), VPNL, PERF))
def _(spark, d):
    v = variance_pnl(spark, d)
    m = v.groupBy("key").agg(F.count("x").alias("n"), (F.avg("x") / F.stddev_samp("x")).alias("s"), F.skewness("x").alias("sk"), (F.kurtosis("x") + 3.0).alias("ku"),
                             EC.break_even_cost("gross", "position").alias("break_even"))
    return m.select("key", F.round(EC.deflated_sharpe(F.col("s"), 12, F.col("n"), F.col("sk"), F.col("ku")), 5).alias("deflated"), "break_even")


@query("eco3_risk_utility", sql("""
SELECT asset, round(sqrt(avg(pow(w*w*actual/30-1,2))),5) AS tracking_error, round(avg((ret<q*sqrt(f_base))::INT),6) AS breach_rate, round(abs(avg(ret) FILTER (ret<q*sqrt(f_base))-avg(-sqrt(f_base)*pdf/0.05) FILTER (ret<q*sqrt(f_base))),5) AS shortfall_error,
 round(avg(w*ret)-0.5*2.0*var_pop(w*ret),5) AS certainty_equivalent FROM (SELECT *, sqrt(30/f_base) AS w, ln(actual/f_wide)*20 AS ret, -1.6448536269514729::DOUBLE AS q, exp(-0.5*pow(1.6448536269514729::DOUBLE,2))/sqrt(2*pi()) AS pdf FROM panel) GROUP BY 1"""))
def _(spark, d):
    p = X.orders_series(spark, d).withColumn("ret", F.log(F.col("actual") / F.col("f_wide")) * 20.0)
    r = EC.risk_utility(p, ["asset"], "f_base", "actual", "ret", 30.0)
    return r.withColumns({c: F.round(c, 5) for c in ("tracking_error", "shortfall_error", "certainty_equivalent")})


HPNL = f"""hd AS (SELECT *, {ncdf_sql('d1')} AS delta FROM (SELECT *, (ln(entry_spot/strike)+0.5*iv*iv*dte/365.0::DOUBLE)/(iv*sqrt(dte/365.0::DOUBLE)) AS d1 FROM legs)),
 hsig AS (SELECT *, greatest(least((iv-0.4::DOUBLE)*10,2.0),-2.0) AS c, ((exit_mid-entry_mid)-delta*(exit_spot-entry_spot))*100-(entry_half+exit_half)*1.5*100-1.3::DOUBLE AS unit FROM hd),
 pnl AS (SELECT asset AS key, k AS o, unit*c*kn*least(1.0::DOUBLE, 3.0/greatest(sum(abs(c)*kn) OVER (PARTITION BY k),1e-12)) AS x FROM (SELECT *, CASE WHEN sum(abs(c)) OVER w>1.5 THEN 1.5/sum(abs(c)) OVER w ELSE 1.0::DOUBLE END AS kn FROM hsig WINDOW w AS (PARTITION BY k, asset)))"""


@query("eco4_forward_economics", sql(f"SELECT {PERF_OUT.replace('round(mean,6)','round(mean,4)').replace('round(vol,6)','round(vol,4)').replace('round(shortfall,6)','round(shortfall,3)').replace('round(max_drawdown,5)','round(max_drawdown,2)')} FROM perf JOIN dd USING (key) JOIN es USING (key)",
                                     SNAP, LEGS, HPNL, PERF))
def _(spark, d):
    t = materialise(hedged(spark, d)).withColumn("signal", (F.col("iv") - 0.4) * 10.0)
    c = EC.portfolio_caps(t, ["k"], "asset", "signal", 3.0, 1.5).withColumn("cap", F.when(F.abs("signal") > 2, 2 * F.signum("signal")).otherwise(F.col("signal")))
    return _perf4(c.select(F.col("asset").alias("key"), F.col("k").alias("o"), (F.col("net_pnl") * F.col("position")).alias("x")))


def _perf4(df):
    m = _perf(df)
    return m.withColumns({"mean": F.round("mean", 4), "volatility": F.round("volatility", 4), "shortfall_5pct": F.round("shortfall_5pct", 3), "max_drawdown": F.round("max_drawdown", 2)})


@query("eco5_variance_economics", sql("""
SELECT key, round(sum(gross),4) AS gross, round(sum(x),4) AS net, round(sum(abs(position)),1) AS turnover, round(avg(abs(position)),6) AS traded_share, round(sum(gross)/sum(abs(position)),6) AS break_even FROM pnl GROUP BY 1""", VPNL))
def _(spark, d):
    return variance_pnl(spark, d).groupBy("key").agg(
        F.round(F.sum("gross"), 4).alias("gross"), F.round(F.sum("x"), 4).alias("net"), F.round(F.sum(F.abs("position")), 1).alias("turnover"),
        F.avg(F.abs("position")).alias("traded_share"), EC.break_even_cost("gross", "position").alias("break_even"))


