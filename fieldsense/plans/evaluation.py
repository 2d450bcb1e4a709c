"""Queries: ranking metrics, resampling, comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldsense.operators import evaluation, metrics
from fieldsense.plans.registry import query, read
from fieldsense.plans.stand_ins import UNITS, units


def ap_sql(source: str, keys: str, score: str = "score_a", y: str = "y", name: str = "ap") -> str:
    """Average precision of a relation by keys, as a subquery with columns keys, ap."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    cols = f"{keys}," if keys else ""
    return f"""(SELECT {cols} CASE WHEN sum(d_tp) > 0 THEN round(sum(d_tp * tp / n) / sum(d_tp), 9) END AS {name} FROM (
      SELECT {cols} d_tp, CAST(sum(d_tp) OVER ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp, CAST(sum(d_n) OVER ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS n
      FROM (SELECT {cols} {score} AS s, CAST(count(*) FILTER ({y}) AS DOUBLE) AS d_tp, count(*) AS d_n FROM {source} GROUP BY ALL)) {group})"""


def _ap(df, keys, score="score_a", y="y", name="ap"):
    return metrics.average_precision(df, keys, score, y).select(*keys, F.round("ap", 9).alias(name))


@query(f"WITH {UNITS} SELECT * FROM {ap_sql('units', 'domain')}")
def q_ap(spark, sf_dir):
    return _ap(units(spark, sf_dir), ["domain"])


@query(f"WITH {UNITS} SELECT * FROM {ap_sql('units', 'class')}")
def q_ap_by_class(spark, sf_dir):
    return _ap(units(spark, sf_dir), ["class"])


@query(f"WITH {UNITS} SELECT * FROM {ap_sql('(SELECT * FROM units WHERE NOT list_contains(masked, class))', 'class')}")
def q_masked_ap(spark, sf_dir):
    return _ap(units(spark, sf_dir).filter(~F.array_contains("masked", F.col("class"))), ["class"])


@query(f"WITH {UNITS}, k AS (SELECT class FROM units GROUP BY 1 HAVING bool_or(toxic) AND NOT bool_and(toxic)) SELECT * FROM {ap_sql('(SELECT * FROM units SEMI JOIN k USING (class))', 'class', 'score_a', 'toxic')}")
def q_ap_guarded(spark, sf_dir):
    u = units(spark, sf_dir)
    return _ap(u.join(u.groupBy("class").agg(F.bool_or("toxic").alias("some"), F.bool_and("toxic").alias("all")).filter("some and not all"), "class", "left_semi"), ["class"], y="toxic")


def recall_sql(source: str, keys: str, precision: float, score: str = "score_a", y: str = "y") -> str:
    return f"""(SELECT {keys}, round(coalesce(max(tp) FILTER (good) / max(tp), 0), 9) AS recall, coalesce(max(s) FILTER (good AND tp = best), 'infinity'::DOUBLE) AS threshold FROM (
      SELECT *, max(CASE WHEN good THEN tp END) OVER (PARTITION BY {keys}) AS best FROM (SELECT *, tp / n >= {precision} AND tp > 0 AS good FROM (
      SELECT {keys}, s, CAST(sum(d_tp) OVER w AS DOUBLE) AS tp, CAST(sum(d_n) OVER w AS DOUBLE) AS n FROM (SELECT {keys}, {score} AS s, count(*) FILTER ({y}) AS d_tp, count(*) AS d_n FROM {source} GROUP BY ALL)
      WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)))) GROUP BY {keys})"""


@query(f"WITH {UNITS} SELECT * FROM {recall_sql('units', 'class', 0.8)}")
def q_recall_at_p(spark, sf_dir):
    return metrics.recall_at_precision(units(spark, sf_dir), ["class"], 0.8, "score_a").withColumn("recall", F.round("recall", 9))


@query(f"""WITH {UNITS}, r AS (SELECT class, row_number() OVER o AS rank, sum(CAST(y AS INTEGER)) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER (PARTITION BY class) AS n, sum(CAST(y AS INTEGER)) OVER (PARTITION BY class) AS p
  FROM units WINDOW o AS (PARTITION BY class ORDER BY score_a DESC, unit_id)) SELECT class, round(min(rank) FILTER (hits >= ceil(0.9 * p) AND p > 0) / CAST(max(n) AS DOUBLE), 9) AS effort FROM r GROUP BY class""")
def q_review_effort(spark, sf_dir):
    return metrics.review_effort(units(spark, sf_dir), ["class"], 0.9, score="score_a").withColumn("effort", F.round("effort", 9))


SUBSETS = "(SELECT *, unnest(list_filter(['all', CASE WHEN leakage_safe THEN 'leakage_safe' END, CASE WHEN medium = 'air' THEN 'air' END], lambda x: x IS NOT NULL)) AS subset FROM units)"


@query(f"WITH {UNITS} SELECT subset, class, ap, n FROM {ap_sql(SUBSETS, 'subset, class')} a JOIN (SELECT subset, class, count(*) AS n FROM {SUBSETS} GROUP BY ALL) USING (subset, class)")
def q_subset_ap(spark, sf_dir):
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("leakage_safe"), "leakage_safe"), F.when(F.col("medium") == "air", "air")))
    u = units(spark, sf_dir).withColumn("subset", F.explode(names))
    return _ap(u, ["subset", "class"]).join(u.groupBy("subset", "class").agg(F.count("*").alias("n")), ["subset", "class"])


@query(f"WITH {UNITS}, c AS (SELECT * FROM {ap_sql('units', 'class')}) SELECT round(avg(ap), 9) AS macro_ap, count(ap) AS classes FROM c")
def q_macro_ap(spark, sf_dir):
    return _ap(units(spark, sf_dir), ["class"]).agg(F.round(F.avg("ap"), 9).alias("macro_ap"), F.count("ap").alias("classes"))


LONG = "long AS (SELECT unit_id, class AS own, c AS class, ((unit_id * 37 + ascii(c) * 11 + ascii(substr(c, 2)) * 5) % 29) / 29.0e0 AS score FROM units, (SELECT DISTINCT class AS c FROM units))"


def _long(spark, sf_dir):
    u = units(spark, sf_dir).select("unit_id", F.col("class").alias("own"))
    classes = u.select(F.col("own").alias("class")).distinct()
    score = (F.col("unit_id") * 37 + F.ascii("class") * 11 + F.ascii(F.substring("class", 2, 9)) * 5) % 29 / F.lit(29.0)
    return u.crossJoin(F.broadcast(classes)).withColumn("score", score)  # every class is scored for every unit


@query(f"WITH {UNITS}, {LONG}, t AS (SELECT unit_id, own, class, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, class) AS k FROM long) SELECT round(avg(CAST(own = class AS INTEGER)), 9) AS top1 FROM t WHERE k = 1")
def q_top1(spark, sf_dir):
    scores = _long(spark, sf_dir)
    top = metrics.top_class(scores, "unit_id").join(scores.select("unit_id", "own").distinct(), "unit_id")
    return top.agg(F.round(F.avg((F.col("own") == F.col("top_class")).cast("double")), 9).alias("top1"))


@query(f"WITH {UNITS}, {LONG}, t AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, class) AS k, max(score) FILTER (own = class) OVER (PARTITION BY unit_id) AS score_own FROM long) SELECT unit_id, score_own, class AS top_class, score AS top_score FROM t WHERE k = 1")
def q_oof_top(spark, sf_dir):
    scores = _long(spark, sf_dir)
    own = scores.filter("own = class").select("unit_id", F.col("score").alias("score_own"))
    return own.join(metrics.top_class(scores, "unit_id"), "unit_id")


@query(f"WITH {UNITS}, d AS (SELECT class, split_group, round(avg(score_b) - avg(score_a), 9) AS delta FROM units GROUP BY 1, 2) SELECT * FROM d ORDER BY delta, class, split_group LIMIT 10")
def q_topk_drops(spark, sf_dir):
    d = units(spark, sf_dir).groupBy("class", "split_group").agg(F.round(F.avg("score_b") - F.avg("score_a"), 9).alias("delta"))
    return d.orderBy("delta", "class", "split_group").limit(10)


#: Resamples of a run and of a comparison, as many as the reference draws.
N_BOOT_RUN, N_BOOT_COMPARE = 500, 1000


def boot(n: int) -> str:
    return f"""g AS (SELECT split_group, row_number() OVER (ORDER BY split_group) - 1 AS place, count(*) OVER () AS g FROM (SELECT DISTINCT split_group FROM units)),
  draws AS (SELECT b AS boot_id, ('0x' || substr(md5(CAST(b AS VARCHAR) || '-' || CAST(j AS VARCHAR)), 1, 8))::BIGINT % (SELECT max(g) FROM g) AS place FROM range({n}) x(b), range((SELECT max(g) FROM g)) y(j)),
  w AS (SELECT boot_id, split_group, count(*) AS weight FROM draws JOIN g USING (place) GROUP BY 1, 2)"""


def boot_sql(score: str) -> str:
    return f"""(SELECT boot_id, class, CASE WHEN sum(d_tp) > 0 THEN sum(d_tp * tp / n) / sum(d_tp) END AS ap FROM (
      SELECT boot_id, class, d_tp, sum(d_tp) OVER o AS tp, sum(d_n) OVER o AS n FROM (SELECT boot_id, class, {score} AS s, CAST(sum(weight) FILTER (y) AS DOUBLE) AS d_tp0, coalesce(CAST(sum(weight) FILTER (y) AS DOUBLE), 0) AS d_tp, CAST(sum(weight) AS DOUBLE) AS d_n
      FROM units JOIN w USING (split_group) GROUP BY 1, 2, 3) WINDOW o AS (PARTITION BY boot_id, class ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2)"""


WEIGHTS_SQL = f"WITH {UNITS}, {boot(N_BOOT_RUN)} SELECT boot_id, split_group, weight FROM w"
BOOT_AP_SQL = f"WITH {UNITS}, {boot(N_BOOT_RUN)} SELECT boot_id, class, round(ap, 9) AS ap FROM {boot_sql('score_a')}"


@query(WEIGHTS_SQL)
def q_boot_weights(spark, sf_dir):
    return metrics.boot_weights(units(spark, sf_dir), "split_group", N_BOOT_RUN)


@query(BOOT_AP_SQL)
def q_boot_ap(spark, sf_dir):
    return metrics.boot_average_precision(units(spark, sf_dir), ["class"], "split_group", N_BOOT_RUN, "score_a").withColumn("ap", F.round("ap", 9))


DELTA = f"""{UNITS}, {boot(N_BOOT_COMPARE)}, dd AS (SELECT class, b.ap - a.ap AS d FROM {boot_sql('score_a')} a JOIN {boot_sql('score_b')} b USING (boot_id, class)),
  delta AS (SELECT class, round(b.ap - a.ap, 8) AS delta, round(quantile_cont(d, 0.025), 8) AS ci_lo, round(quantile_cont(d, 0.975), 8) AS ci_hi FROM {ap_sql('units', 'class')} a JOIN {ap_sql('units', 'class', 'score_b')} b USING (class) JOIN dd USING (class) GROUP BY ALL)"""
DELTA_SQL = f"WITH {DELTA} SELECT *, ci_lo > 0 OR ci_hi < 0 AS significant FROM delta"
DECIDE_SQL = f"WITH {DELTA} SELECT round(avg(delta), 7) AS delta, coalesce(min(ci_lo) > 0 AND min(delta) >= -0.05e0, false) AS adopt FROM delta"


@query(DELTA_SQL)
def q_paired_delta(spark, sf_dir):
    d = metrics.paired_delta(units(spark, sf_dir), ["class"], "split_group", N_BOOT_COMPARE, "score_a", "score_b")
    return d.select("class", *[F.round(c, 8).alias(c) for c in ("delta", "ci_lo", "ci_hi")], "significant")


@query(DECIDE_SQL)
def q_decide(spark, sf_dir):
    d = q_paired_delta(spark, sf_dir).agg(F.avg("delta").alias("delta"), F.min("ci_lo").alias("lo"), F.min("delta").alias("worst"))
    return d.select(F.round("delta", 7).alias("delta"), metrics.decide(F.col("delta"), F.col("lo"), F.col("worst")).alias("adopt"))


@query(WEIGHTS_SQL)
def q_boot_weights_run(spark, sf_dir):
    """Another name of q_boot_weights, which now draws as many."""
    return q_boot_weights(spark, sf_dir)


@query(BOOT_AP_SQL)
def q_boot_ap_run(spark, sf_dir):
    """Another name of q_boot_ap, which now draws as many."""
    return q_boot_ap(spark, sf_dir)


@query(DELTA_SQL)
def q_paired_delta_compare(spark, sf_dir):
    """Another name of q_paired_delta, which now draws as many."""
    return q_paired_delta(spark, sf_dir)


@query(DECIDE_SQL)
def q_decide_compare(spark, sf_dir):
    """Another name of q_decide, which now draws as many."""
    return q_decide(spark, sf_dir)


#: Units as evaluation takes them (recorder clips without a call are background) and the judged rows.
JUDGED = f"""{UNITS}, {LONG}, eu AS (SELECT unit_id, CASE WHEN domain = 'focal' OR y THEN class END AS own, CASE WHEN domain = 'focal' OR y THEN 'frog' ELSE 'background' END AS kind, domain, locked, fold, masked, leakage_safe, medium, split_group FROM units),
  j AS (SELECT e.*, l.class, l.score, coalesce(e.own = l.class, false) AS y, list_contains(masked, l.class) AS masked_out, CASE WHEN domain = 'focal' THEN 'A' ELSE 'B' END AS tier FROM long l JOIN eu e USING (unit_id) WHERE NOT locked),
  ev AS (SELECT own AS class, count(*) AS n FROM eu WHERE domain = 'focal' AND NOT locked AND own IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fold) >= 2),
  heard AS (SELECT DISTINCT own AS class FROM eu WHERE domain = 'aru' AND NOT locked AND kind = 'frog')"""


def _eval_units(spark, sf_dir):
    frog = (F.col("domain") == "focal") | F.col("y")
    u = units(spark, sf_dir).withColumn("own", F.when(frog, F.col("class"))).withColumn("kind", F.when(frog, "frog").otherwise("background"))
    return u.select("unit_id", "own", "kind", "domain", "locked", "fold", "masked", "leakage_safe", "medium", "split_group")


def _judged(spark, sf_dir):
    u = _eval_units(spark, sf_dir)
    return evaluation.judged(_long(spark, sf_dir), u), u


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 7) for n in names})


@query(f"WITH {JUDGED} SELECT class, n FROM ev")
def q_evaluable(spark, sf_dir):
    return evaluation.evaluable(_eval_units(spark, sf_dir))


KNOWN = "(SELECT j.* FROM j JOIN ev USING (class) WHERE tier = 'A' AND NOT masked_out)"


@query(f"""WITH {JUDGED}, k AS (SELECT * FROM {KNOWN}) SELECT c.class, CAST(coalesce(r.recordings, 0) AS BIGINT) AS recordings, ev.class IS NOT NULL AS evaluable, round(a.ap, 7) AS ap, round(s.ap_leakage_safe, 7) AS ap_leakage_safe, round(w.ap_air, 7) AS ap_air, round(p.recall, 7) AS recall_p90
  FROM (SELECT DISTINCT own AS class FROM eu WHERE domain = 'focal' AND NOT locked) c LEFT JOIN (SELECT class, count(*) FILTER (y) AS recordings FROM j WHERE tier = 'A' AND NOT masked_out GROUP BY 1) r USING (class) LEFT JOIN ev USING (class)
  LEFT JOIN {ap_sql('k', 'class', 'score')} a USING (class) LEFT JOIN {ap_sql('(SELECT * FROM k WHERE leakage_safe)', 'class', 'score', name='ap_leakage_safe')} s USING (class)
  LEFT JOIN {ap_sql("(SELECT * FROM k WHERE medium = 'air')", 'class', 'score', name='ap_air')} w USING (class) LEFT JOIN {recall_sql('k', 'class', 0.9, 'score')} p USING (class)""")
def q_per_class_a(spark, sf_dir):
    return _rounded(evaluation.per_class_a(*_judged(spark, sf_dir)), "ap", "ap_leakage_safe", "ap_air", "recall_p90")


@query(f"""WITH {JUDGED}, b AS (SELECT *, kind = 'background' AS bg FROM j WHERE tier = 'B'), c AS (SELECT class, count(*) FILTER (y) AS clips, round(count(*) FILTER (bg AND score >= 0.5) / nullif(count(*) FILTER (bg) * 3 / 3600.0e0, 0), 7) AS fp_per_hour,
    round(avg(CAST(score >= 0.5 AS INTEGER)) FILTER (NOT bg AND NOT y), 7) AS fires_on_others, round(avg(CAST(score >= 0.5 AS INTEGER)) FILTER (y), 7) AS recall_at_half FROM b GROUP BY 1),
  h AS (SELECT b.* FROM b JOIN c USING (class) WHERE clips > 0), k AS (SELECT class, split_group, max(score) AS score, bool_or(y) AS y FROM h GROUP BY 1, 2),
  r AS (SELECT class, row_number() OVER o AS rank, sum(CAST(y AS INTEGER)) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER (PARTITION BY class) AS n, sum(CAST(y AS INTEGER)) OVER (PARTITION BY class) AS p FROM h WINDOW o AS (PARTITION BY class ORDER BY score DESC, unit_id)),
  e AS (SELECT class, round(min(rank) FILTER (hits >= ceil(0.9 * p) AND p > 0) / CAST(max(n) AS DOUBLE), 7) AS effort FROM r GROUP BY class)
  SELECT c.*, round(a.ap, 7) AS ap, round(p9.recall, 7) AS recall_p90, round(p95.recall, 7) AS recall_p95, e.effort, round(kb.ap_block, 7) AS ap_block FROM c LEFT JOIN {ap_sql('h', 'class', 'score')} a USING (class) LEFT JOIN {recall_sql('h', 'class', 0.9, 'score')} p9 USING (class)
  LEFT JOIN {recall_sql('h', 'class', 0.95, 'score')} p95 USING (class) LEFT JOIN e USING (class) LEFT JOIN {ap_sql('k', 'class', 'score', name='ap_block')} kb USING (class)""")
def q_per_class_b(spark, sf_dir):
    out = evaluation.per_class_b(_judged(spark, sf_dir)[0])
    return _rounded(out, "fp_per_hour", "fires_on_others", "recall_at_half", "ap", "recall_p90", "recall_p95", "effort", "ap_block")


@query(f"""WITH {JUDGED}, p AS (SELECT j.*, CASE WHEN heard.class IS NULL THEN 'focal' ELSE 'aru' END AS pool FROM j LEFT JOIN heard USING (class) WHERE NOT masked_out), q AS (SELECT * FROM p WHERE domain = pool)
  SELECT class, threshold, round(recall, 7) AS recall, pool FROM {recall_sql('q', 'class', 0.5, 'score')} JOIN (SELECT DISTINCT class, pool FROM q) USING (class) WHERE class IN (SELECT class FROM q WHERE y)""")
def q_thresholds(spark, sf_dir):
    return _rounded(evaluation.thresholds(*_judged(spark, sf_dir), 0.5), "recall")


@query(f"""WITH {JUDGED}, w AS (SELECT unit_id, kind = 'frog' AS y, unit_id % 4 > 0 AS pos, score FROM j WHERE tier = 'B'), b AS (SELECT 'window' AS level, y, score FROM w WHERE NOT y OR pos UNION ALL SELECT 'clip', bool_or(y), max(score) FROM w GROUP BY unit_id)
  SELECT level, round(ap, 7) AS ap, round(fp_share, 7) AS fp_share FROM {ap_sql('b', 'level', 'score')} JOIN (SELECT level, avg(CAST(score >= 0.5 AS INTEGER)) FILTER (NOT y) AS fp_share FROM b GROUP BY 1) USING (level)""")
def q_detection_ap(spark, sf_dir):
    windows = _judged(spark, sf_dir)[0].filter("tier = 'B'").withColumn("state", F.when(F.col("kind") == "background", "neg").when(F.col("unit_id") % 4 > 0, "pos").otherwise("uncertain"))
    return _rounded(evaluation.detection(windows), "ap", "fp_share")


@query(f"""WITH {JUDGED}, ja AS (SELECT k.*, unnest(list_filter(['all', CASE WHEN leakage_safe THEN 'leakage_safe' END, CASE WHEN medium = 'air' THEN 'air' END], lambda x: x IS NOT NULL)) AS part FROM {KNOWN} k),
  pa AS (SELECT a.*, n FROM {ap_sql('ja', 'class, part', 'score')} a JOIN ev USING (class)), pb AS (SELECT * FROM {ap_sql("(SELECT j.* FROM j JOIN heard USING (class) WHERE tier = 'B' AND NOT masked_out)", 'class', 'score')}),
  det AS (SELECT unit_id, max(score) AS score, bool_or(kind = 'frog') AS y FROM j WHERE tier = 'B' GROUP BY 1),
  m AS (SELECT 'A_macro_ap' AS metric, avg(ap) FILTER (part = 'all') AS value FROM pa UNION ALL SELECT 'A_macro_ap_rare', avg(ap) FROM pa WHERE part = 'all' AND n < 30 HAVING count(*) > 0 UNION ALL SELECT 'A_macro_ap_common', avg(ap) FROM pa WHERE part = 'all' AND n >= 30 HAVING count(*) > 0
  UNION ALL SELECT 'A_macro_ap_leakage_safe', avg(ap) FILTER (part = 'leakage_safe') FROM pa UNION ALL SELECT 'A_macro_ap_air', avg(ap) FILTER (part = 'air') FROM pa UNION ALL SELECT 'A_ap:' || class, ap FROM pa WHERE part = 'all'
  UNION ALL SELECT 'B_macro_ap', avg(ap) FROM pb UNION ALL SELECT 'B_ap:' || class, ap FROM pb UNION ALL SELECT 'B_detection_ap', ap FROM {ap_sql('det', '', 'score')}) SELECT metric, round(value, 7) AS value FROM m""")
def q_headline(spark, sf_dir):
    return _rounded(evaluation.headline(*_judged(spark, sf_dir)), "value")


def tier_draws(n: int) -> str:
    """Draws of each tier's groups, by tier, boot_id and split_group."""
    return f"""tg AS (SELECT tier, split_group, row_number() OVER (PARTITION BY tier ORDER BY split_group) - 1 AS place, count(*) OVER (PARTITION BY tier) AS g
    FROM (SELECT DISTINCT CASE WHEN domain = 'focal' THEN 'A' ELSE 'B' END AS tier, split_group FROM eu WHERE NOT locked)),
  td AS (SELECT tier, b AS boot_id, ('0x' || substr(md5(CAST(b AS VARCHAR) || '-' || CAST(j AS VARCHAR)), 1, 8))::BIGINT % g AS place FROM (SELECT tier, g, unnest(range(g)) AS j FROM (SELECT DISTINCT tier, g FROM tg)), range({n}) x(b)),
  tw AS (SELECT tier, boot_id, split_group, count(*) AS weight FROM td JOIN tg USING (tier, place) GROUP BY ALL)"""


def drawn_ap_sql(source: str, keys: str) -> str:
    by = f"boot_id, {keys}" if keys else "boot_id"
    own = f"{keys}," if keys else ""
    return f"""(SELECT {by}, CASE WHEN sum(d_tp) > 0 THEN sum(d_tp * tp / n) / sum(d_tp) END AS ap FROM (SELECT {by}, d_tp, CAST(sum(d_tp) OVER o AS DOUBLE) AS tp, CAST(sum(d_n) OVER o AS DOUBLE) AS n FROM (
      SELECT {by}, score, CAST(sum(weight * p) AS DOUBLE) AS d_tp, CAST(sum(weight * c) AS DOUBLE) AS d_n FROM (SELECT {own} tier, split_group, score, count(*) FILTER (y) AS p, count(*) AS c FROM {source} GROUP BY ALL) JOIN tw USING (tier, split_group) GROUP BY ALL)
      WINDOW o AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {by})"""


def headline_sql(j: str, name: str, drawn: bool) -> str:
    """Common table expressions that end in `name`: headline metrics of judged rows j, by boot_id if drawn."""
    ap = (lambda source, keys: drawn_ap_sql(source, keys)) if drawn else (lambda source, keys: ap_sql(source, keys, "score"))
    by, group = ("boot_id,", "GROUP BY boot_id") if drawn else ("", "")
    part = lambda metric, value, source, more="": f"SELECT {by} {metric} AS metric, {value} AS value FROM {source} {more}"
    whole = f"{name}_a WHERE part = 'all'"
    parts = [part("'A_macro_ap'", "avg(ap) FILTER (part = 'all')", f"{name}_a", group), part("'A_macro_ap_leakage_safe'", "avg(ap) FILTER (part = 'leakage_safe')", f"{name}_a", group), part("'A_macro_ap_air'", "avg(ap) FILTER (part = 'air')", f"{name}_a", group)]
    parts += [part("'A_macro_ap_rare'", "avg(ap)", f"{whole} AND n < 30", f"{group} HAVING count(*) > 0"), part("'A_macro_ap_common'", "avg(ap)", f"{whole} AND n >= 30", f"{group} HAVING count(*) > 0"), part("'A_ap:' || class", "ap", whole)]
    parts += [part("'B_macro_ap'", "avg(ap)", f"{name}_b", group), part("'B_ap:' || class", "ap", f"{name}_b"), part("'B_detection_ap'", "ap", ap(f"{name}_d", ""))]
    return f"""{name}_j AS (SELECT k.*, unnest(list_filter(['all', CASE WHEN leakage_safe THEN 'leakage_safe' END, CASE WHEN medium = 'air' THEN 'air' END], lambda x: x IS NOT NULL)) AS part FROM (SELECT x.* FROM {j} x JOIN ev USING (class) WHERE tier = 'A' AND NOT masked_out) k),
  {name}_a AS (SELECT a.*, n FROM {ap(f"{name}_j", "class, part")} a JOIN ev USING (class)), {name}_b AS (SELECT * FROM {ap(f"(SELECT x.* FROM {j} x JOIN heard USING (class) WHERE tier = 'B' AND NOT masked_out)", "class")}),
  {name}_d AS (SELECT unit_id, tier, split_group, max(score) AS score, bool_or(kind = 'frog') AS y FROM {j} WHERE tier = 'B' GROUP BY ALL), {name} AS ({" UNION ALL ".join(parts)})"""


@query(f"""WITH {JUDGED}, {tier_draws(N_BOOT_RUN)}, {headline_sql("j", "point", False)}, {headline_sql("j", "drawn", True)},
  ci AS (SELECT metric, quantile_cont(value, 0.025) AS ci_lo, quantile_cont(value, 0.975) AS ci_hi FROM drawn GROUP BY 1)
  SELECT metric, round(value, 7) AS value, round(ci_lo, 7) AS ci_lo, round(ci_hi, 7) AS ci_hi FROM point LEFT JOIN ci USING (metric)""")
def q_run_summary(spark, sf_dir):
    """Headline metrics of a run with intervals over its 500 resamples."""
    return _rounded(evaluation.summarize(*_judged(spark, sf_dir), N_BOOT_RUN), "value", "ci_lo", "ci_hi")


COMPARED = f"""WITH {JUDGED}, j2 AS (SELECT * REPLACE (CASE WHEN y AND unit_id % 3 > 0 THEN (score + 1) / 2 ELSE score END AS score) FROM j), {tier_draws(N_BOOT_COMPARE)}, {headline_sql("j", "one", False)}, {headline_sql("j2", "two", False)},
  {headline_sql("j", "drawn1", True)}, {headline_sql("j2", "drawn2", True)}, ci AS (SELECT metric, quantile_cont(b.value - a.value, 0.025) AS ci_lo, quantile_cont(b.value - a.value, 0.975) AS ci_hi FROM drawn1 a JOIN drawn2 b USING (boot_id, metric) GROUP BY 1),
  out AS (SELECT metric, round(two.value - one.value, 7) AS delta, round(ci_lo, 7) AS ci_lo, round(ci_hi, 7) AS ci_hi FROM one JOIN two USING (metric) LEFT JOIN ci USING (metric))"""


def _compared(spark, sf_dir):
    rows, u = _judged(spark, sf_dir)
    better = rows.withColumn("score", F.when(F.col("y") & (F.col("unit_id") % 3 > 0), (F.col("score") + 1) / 2).otherwise(F.col("score")))
    return _rounded(evaluation.delta_headline(rows, better, u, N_BOOT_COMPARE), "delta", "ci_lo", "ci_hi")


@query(f"{COMPARED} SELECT *, coalesce(ci_lo > 0 OR ci_hi < 0, false) AS significant FROM out")
def q_compare_runs(spark, sf_dir):
    """Headline deltas of two runs over 1000 resamples."""
    return _compared(spark, sf_dir)


@query(f"""{COMPARED}, worst AS (SELECT min(delta) FILTER (contains(metric, ':')) AS w FROM out), best AS (SELECT * FROM out WHERE metric IN ('B_macro_ap', 'A_macro_ap_rare') ORDER BY metric DESC LIMIT 1)
  SELECT metric AS "primary", delta, coalesce(ci_lo > 0 AND coalesce(w, 0) >= -0.05, false) AS adopt FROM best, worst""")
def q_adopt(spark, sf_dir):
    """Whether the second of two runs is adopted, by its primary metric and its worst class."""
    return evaluation.adopt(_compared(spark, sf_dir))


@query(f"WITH {UNITS}, f AS (SELECT * FROM {ap_sql('units', 'fold, class')}), c AS (SELECT class, avg(ap) AS m, stddev_samp(ap) AS sd FROM f GROUP BY 1) SELECT round(avg(m), 8) AS ap, round(avg(sd), 8) AS sd FROM c")
def q_learning_curve(spark, sf_dir):
    by_class = _ap(units(spark, sf_dir), ["fold", "class"]).groupBy("class").agg(F.avg("ap").alias("m"), F.stddev_samp("ap").alias("sd"))
    return by_class.agg(F.round(F.avg("m"), 8).alias("ap"), F.round(F.avg("sd"), 8).alias("sd"))


@query()
def q_cross_validate(spark, sf_dir):
    """Leave-fold-out multinomial logistic regression on the vectors: (vec_id, fold, label, prediction)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = read(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    rows = rows.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    fitted = [LogisticRegression(maxIter=10, regParam=0.01).fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)) for k in range(3)]
    return reduce(lambda a, b: a.union(b), fitted).select("vec_id", "fold", "label", "prediction")


@query()
def q_head(spark, sf_dir):
    """A one-layer network on the vectors, for each held-out fold: (vec_id, fold, label, prediction)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = read(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    rows = rows.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("vec_id") % 2).cast("int").alias("fold"))
    net = MultilayerPerceptronClassifier(layers=[64, 32, 10], maxIter=10, seed=1)
    fitted = [net.fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)) for k in range(2)]
    return fitted[0].union(fitted[1]).select("vec_id", "fold", "label", "prediction")
