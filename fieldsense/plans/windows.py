"""Queries: framing, labels, folds, samples, order-dependent splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldsense.operators import splits, windows
from fieldsense.plans.registry import query, read
from fieldsense.plans.stand_ins import REC, UNITS, recordings, units

WIDTH, HOP = 3.0, 1.5
#: Needs WITH RECURSIVE: dealt (split_group, acoustic_class) -> folds (split_group, fold).
FOLD_SQL = """sizes AS (SELECT split_group, acoustic_class AS c, count(*) AS m FROM dealt GROUP BY 1, 2), totals AS (SELECT c, CAST(sum(m) AS DOUBLE) AS n FROM sizes GROUP BY 1),
  vectors AS (SELECT g.split_group, list(coalesce(m, 0) / n ORDER BY t.c) AS own
    FROM (SELECT DISTINCT split_group FROM sizes) g CROSS JOIN totals t LEFT JOIN sizes s ON s.split_group = g.split_group AND s.c = t.c GROUP BY 1),
  queue AS (SELECT *, row_number() OVER (ORDER BY list_sum(list_transform(own, lambda x: x * x)) DESC, split_group) AS k FROM vectors),
  walk AS (SELECT CAST(0 AS BIGINT) AS k, [z, z, z, z, z] AS loads, CAST(NULL AS VARCHAR) AS split_group, CAST(NULL AS BIGINT) AS fold FROM (SELECT list(0e0) AS z FROM totals)
    UNION ALL SELECT k, list_transform(range(1, 6), lambda f: CASE WHEN f = best THEN list_transform(range(1, len(own) + 1), lambda i: loads[f][i] + own[i]) ELSE loads[f] END), split_group, best - 1
    FROM (SELECT q.*, loads, list_sort(list_transform(range(1, 6), lambda f: {'p': list_max(list_transform(range(1, len(own) + 1), lambda i: loads[f][i] + own[i])), 'n': list_sum(loads[f]), 'f': f}))[1].f AS best FROM walk w JOIN queue q ON q.k = w.k + 1)),
  folds AS (SELECT split_group, CAST(fold AS INTEGER) AS fold FROM walk WHERE k > 0)"""
FRAMES = f"""frames AS (SELECT recording_id, source, label, duration_s, unnest(CASE WHEN duration_s <= 3 THEN [0.0e0] ELSE
  list_transform(range(0, CAST(greatest(1, ceil((duration_s - 3 + 1e-9) / 1.5e0)) AS BIGINT)), lambda k: round(k * 1.5e0, 3)) ||
  CASE WHEN greatest(0, ceil((duration_s - 3 + 1e-9) / 1.5e0) - 1) * 1.5e0 + 3 < duration_s - 1e-6 THEN [round(duration_s - 3, 3)] ELSE [] END END) AS start_s FROM rec),
  win AS (SELECT *, round(start_s + 3, 3) AS end_s, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_s) - 1 AS INTEGER) AS window_idx,
  CAST((recording_id * 31 + CAST(round(start_s * 1000) AS BIGINT)) % 23 AS DOUBLE) AS activity_db,
  CASE WHEN recording_id % 3 > 0 THEN CAST((recording_id * 17 + CAST(round(start_s * 1000) AS BIGINT)) % 13 AS DOUBLE) END AS zs_own FROM frames)"""


def _windows(spark, sf_dir):
    w = windows.frame(recordings(spark, sf_dir).select("recording_id", "source", "label", "duration_s"), WIDTH, HOP)
    ms = F.round(F.col("start_s") * 1000).cast("long")
    return w.withColumn("activity_db", ((F.col("recording_id") * 31 + ms) % 23).cast("double")).withColumn("zs_own", F.when(F.col("recording_id") % 3 > 0, ((F.col("recording_id") * 17 + ms) % 13).cast("double")))


@query(f"WITH {REC}, {FRAMES} SELECT recording_id, window_idx, start_s, end_s FROM win")
def q_frame(spark, sf_dir):
    return _windows(spark, sf_dir).select("recording_id", "window_idx", "start_s", "end_s")


@query(f"WITH {REC}, {FRAMES} SELECT recording_id, max(activity_db) AS score FROM win GROUP BY 1")
def q_unit_max(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("recording_id").agg(F.max("activity_db").alias("score"))


@query(f"""WITH {REC}, {FRAMES}, seeds AS (SELECT recording_id, window_idx, avg(((recording_id + window_idx * 7 + seed * 5) % 19) / 19.0e0) AS p FROM win, (VALUES (0), (1), (2)) s(seed) GROUP BY 1, 2)
  SELECT recording_id, round(max(p), 9) AS score FROM seeds GROUP BY 1""")
def q_seed_mean_then_max(spark, sf_dir):
    p = (F.col("recording_id") + F.col("window_idx") * 7 + F.col("seed") * 5) % 19 / F.lit(19.0)
    runs = _windows(spark, sf_dir).withColumn("seed", F.explode(F.array(*map(F.lit, (0, 1, 2))))).groupBy("recording_id", "window_idx").agg(F.avg(p).alias("p"))
    return runs.groupBy("recording_id").agg(F.round(F.max("p"), 9).alias("score"))


@query(f"""WITH {REC}, {FRAMES} SELECT recording_id, window_idx, CASE WHEN count(*) OVER r = 1 OR (activity_db >= 10 AND (zs_own IS NULL OR zs_own >= max(zs_own) OVER r - 4))
  OR row_number() OVER (PARTITION BY recording_id ORDER BY coalesce(zs_own, activity_db) DESC NULLS LAST, window_idx) = 1 THEN 'pos' ELSE 'uncertain' END AS state
  FROM win WINDOW r AS (PARTITION BY recording_id)""")
def q_weak_labels(spark, sf_dir):
    return windows.weak_states(_windows(spark, sf_dir), "recording_id", "activity_db", "zs_own").select("recording_id", "window_idx", "state")


BOXES = "boxes AS (SELECT recording_id, (recording_id % 7) * 1.3e0 AS box_start, (recording_id % 7) * 1.3e0 + 0.1e0 + (recording_id % 5) * 0.4e0 AS box_end, label AS class FROM rec WHERE recording_id % 4 > 0)"


@query(f"""WITH {REC}, {FRAMES}, {BOXES}, o AS (SELECT w.recording_id, window_idx, class, least(end_s, box_end) - greatest(start_s, box_start) AS overlap, box_end - box_start AS size
  FROM win w JOIN boxes USING (recording_id)) SELECT DISTINCT recording_id, window_idx, class FROM o WHERE overlap > 0 AND (overlap >= 0.2e0 OR overlap > 0.5e0 * size)""")
def q_box_windows(spark, sf_dir):
    start = F.col("recording_id") % 7 * F.lit(1.3)
    boxes = recordings(spark, sf_dir).filter("recording_id % 4 > 0").select("recording_id", start.alias("box_start"), (start + 0.1 + F.col("recording_id") % 5 * F.lit(0.4)).alias("box_end"), F.col("label").alias("class"))
    return windows.box_hits(_windows(spark, sf_dir), boxes, "recording_id", bucket=30.0)


@query(f"""WITH {REC} SELECT recording_id, list_filter(list_sort(list_distinct([label, CASE WHEN n_chars % 2 = 0 THEN 'fr' ELSE 'de' END, 'en'])), lambda x: x <> label) AS masked FROM rec""")
def q_masked_classes(spark, sf_dir):
    other = F.when(F.col("n_chars") % 2 == 0, "fr").otherwise("de")
    every = F.array_distinct(F.array("label", other, F.lit("en")))
    return recordings(spark, sf_dir).select("recording_id", F.array_sort(F.array_except(every, F.array("label"))).alias("masked"))


@query("""SELECT vec_id, list_resize(embedding[1:40], 48, 0) AS cut FROM embeddings""")
def q_slice_pad(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.slice("embedding", 1, 40), F.array_repeat(F.lit(0).cast("float"), 8)).alias("cut"))


@query(f"""WITH {REC} SELECT recording_id, CAST((row_number() OVER (PARTITION BY label ORDER BY recording_id) - 1) // 50 AS BIGINT) AS block FROM rec""")
def q_proxy_blocks(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("label").orderBy("recording_id")) - 1
    return recordings(spark, sf_dir).select("recording_id", F.floor(place / 50).alias("block"))


@query(f"""WITH {UNITS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY class ORDER BY split_group) AS rk FROM units), n AS (SELECT *, max(rk) OVER (PARTITION BY class) AS n FROM r),
  k AS (SELECT *, greatest(1, CAST(round_even(0.2e0 * n, 0) AS INTEGER)) AS n_lock FROM n)
  SELECT unit_id, rk > n - n_lock AS is_locked, CAST(CASE WHEN rk > n - n_lock THEN -1 ELSE ((rk - 1) * 5) // greatest(1, n - n_lock) END AS INTEGER) AS new_fold FROM k""")
def q_contiguous_folds(spark, sf_dir):
    out = splits.contiguous_folds(units(spark, sf_dir).drop("fold", "locked"), "class", "split_group")
    return out.select("unit_id", F.col("locked").alias("is_locked"), F.col("fold").alias("new_fold"))


@query(f"""WITH {UNITS} SELECT unit_id, row_number() OVER (PARTITION BY class ORDER BY md5('3|' || CAST(unit_id AS VARCHAR)), unit_id) <= round_even(0.2e0 * count(*) OVER (PARTITION BY class), 0) AS is_locked FROM units""")
def q_strat_lock(spark, sf_dir):
    return splits.stratified_lock(units(spark, sf_dir).drop("locked"), "class", "unit_id", 0.2, 3).select("unit_id", F.col("locked").alias("is_locked"))


@query(f"""WITH {UNITS} SELECT unit_id, CAST((row_number() OVER (PARTITION BY class ORDER BY md5('4|' || CAST(unit_id AS VARCHAR)), unit_id) - 1) % 5 AS INTEGER) AS new_fold FROM units""")
def q_strat_kfold(spark, sf_dir):
    return splits.stratified_folds(units(spark, sf_dir).drop("fold"), "class", "unit_id", 5, 4).select("unit_id", F.col("fold").alias("new_fold"))


@query(f"""WITH {UNITS}, g AS (SELECT class, split_group, row_number() OVER (PARTITION BY class ORDER BY md5('6|' || class || '|' || split_group), split_group) AS k FROM (SELECT DISTINCT class, split_group FROM units)),
  c AS (SELECT u.class, unit_id, row_number() OVER (PARTITION BY u.class ORDER BY md5('7|' || CAST(unit_id AS VARCHAR)), unit_id) AS k FROM units u JOIN g ON g.class = u.class AND g.split_group = u.split_group AND g.k <= 3)
  SELECT class, unit_id FROM c WHERE k <= 10""")
def q_group_sample(spark, sf_dir):
    return splits.group_sample(units(spark, sf_dir), "class", "split_group", "unit_id", 3, 10, 6).select("class", "unit_id")


@query(f"""WITH RECURSIVE {UNITS}, c AS (SELECT class, split_group, count(*) AS n, md5('1|' || split_group) AS o FROM units GROUP BY 1, 2), cand AS (SELECT *, sum(n) OVER (PARTITION BY class) AS total, row_number() OVER (PARTITION BY class ORDER BY o, split_group) AS place FROM c),
  walk AS (SELECT DISTINCT class, CAST(0 AS BIGINT) AS place, 0e0 AS used, CAST(NULL AS VARCHAR) AS split_group, false AS locked FROM cand UNION ALL
    SELECT c.class, c.place, CASE WHEN used + n <= total * 0.15e0 THEN used + n ELSE used END, c.split_group, used + n <= total * 0.15e0 FROM walk w JOIN cand c ON c.class = w.class AND c.place = w.place + 1)
  SELECT class, split_group, locked FROM walk WHERE place > 0""")
def q_greedy_lock(spark, sf_dir):
    groups = units(spark, sf_dir).groupBy("class", "split_group").agg(F.count("*").alias("n")).withColumn("order", splits.draw(1, "split_group"))
    return splits.greedy_lock(groups, "class", "split_group", "n", "order")


@query(f"""WITH RECURSIVE {UNITS}, dealt AS (SELECT split_group, class AS acoustic_class FROM units), {FOLD_SQL} SELECT unit_id, split_group, folds.fold FROM units JOIN folds USING (split_group)""")
def q_group_kfold(spark, sf_dir):
    return splits.group_folds(units(spark, sf_dir).drop("fold"), "split_group", "class").select("unit_id", "split_group", "fold")


@query("""WITH g AS (SELECT * FROM (VALUES (1), (3), (-1)) g(groups), (VALUES (5), (10), (25), (50), (100), (200), (-1)) c(clips))
  SELECT 0 AS groups, 0 AS clips UNION ALL SELECT groups, clips FROM g WHERE NOT (groups > 0 AND clips > 50 * groups) AND NOT (groups = 1 AND clips = -1)""")
def q_lc_grid(spark, sf_dir):
    return splits.learning_curve_points(spark)


@query()
def q_activity_udf(spark, sf_dir):
    """Loudness of two windows of a second, each vector repeated 40 times as a recording of 1,024 samples a second."""
    e = read(spark, sf_dir, "embeddings")
    levels = windows.frame_levels(e.select("vec_id", F.lit(1024).alias("rate"), F.flatten(F.array_repeat("embedding", 40)).alias("samples")), "vec_id")
    spans = e.select("vec_id", F.posexplode(F.array(F.lit(0.0), F.lit(1.0))).alias("window_idx", "start_s")).withColumn("end_s", F.col("start_s") + 1)
    found = windows.activity(spans, levels, "vec_id", 1.0).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("window_idx", "activity_db"))).alias("w"))  # two a vector
    return found.select("vec_id", F.transform("w", lambda w: w["activity_db"]).alias("db"))


@query("""WITH v AS (SELECT vec_id, embedding, unnest(range(3)) AS f FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT vec_id, f, unnest(range(32)) AS k, embedding FROM v),
  w AS (SELECT vec_id, f, k, CAST(embedding[f * 16 + k + 1] AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * k / 31)) AS a FROM x),
  p AS (SELECT vec_id, f, b, sum(a * cos(2 * pi() * b * k / 32)) ** 2 + sum(a * sin(2 * pi() * b * k / 32)) ** 2 AS e FROM w, range(2, 11) t(b) GROUP BY 1, 2, 3),
  levels AS (SELECT vec_id, f * 0.25e0 AS at_s, 10 * log10(sum(e) + 1e-10) AS db FROM p GROUP BY 1, 2),
  spans AS (SELECT vec_id, i AS window_idx, i * 0.25e0 AS start_s, i * 0.25e0 + 0.5 AS end_s FROM embeddings, range(3) t(i)),
  tops AS (SELECT s.vec_id, window_idx, quantile_cont(db, 0.95) AS top FROM spans s JOIN levels l ON l.vec_id = s.vec_id AND at_s >= start_s AND at_s < end_s GROUP BY 1, 2)
  SELECT s.vec_id, CAST(window_idx AS INTEGER) AS window_idx, round(coalesce(top - floor, 0), 5) AS activity_db FROM spans s LEFT JOIN tops USING (vec_id, window_idx) LEFT JOIN (SELECT vec_id, quantile_cont(db, 0.2) AS floor FROM levels GROUP BY 1) USING (vec_id)""")
def q_activity(spark, sf_dir):
    """Vectors as sounds of one second: loudness of half-second windows between 4 and 20 Hz."""
    e = read(spark, sf_dir, "embeddings")
    levels = windows.frame_levels(e.select("vec_id", F.lit(64).alias("rate"), F.col("embedding").alias("samples")), "vec_id", 32, 16, 4.0, 20.0)
    spans = windows.frame(e.select("vec_id", F.lit(1.0).alias("duration_s")), 0.5, 0.25)
    out = windows.activity(spans, levels, "vec_id", 0.5)
    return out.select("vec_id", F.col("window_idx").cast("int").alias("window_idx"), F.round("activity_db", 5).alias("activity_db"))
