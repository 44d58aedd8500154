"""Metric, bootstrap and holdout queries over the scored event sets (binding S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import cohort_of
from cohortlens.catalog.registry import query
from cohortlens.functions.ranking import budget_flags
from cohortlens.functions.session import stage
from cohortlens.operators import bootstrap as bs
from cohortlens.operators import scoring as sc
from cohortlens.operators.ordering import rank_map
from cohortlens.plans import holdout as ho
from cohortlens.sources import bindings as b

BY = ["split", "rung"]
CUT = ["cutoff", "rung"]

# Oracle side: brute force over rows and thresholds.
_TABLE = """conf AS (SELECT split, rung, threshold, CAST(sum(CASE WHEN y = 1 AND p < threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp, count(*) AS n
  FROM scored, grid GROUP BY split, rung, threshold)"""
_CUT_TABLE = """conf AS (SELECT cutoff, split, rung, threshold, CAST(sum(CASE WHEN y = 1 AND p < threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp, count(*) AS n
  FROM scored_cut, grid GROUP BY cutoff, split, rung, threshold)"""
_POLICY = """policy AS (SELECT cutoff, rung, arg_min(threshold, ((10 * fn + fp) / n, threshold)) AS threshold, min((10 * fn + fp) / n) AS validate_cost
  FROM conf WHERE split = 'validate' GROUP BY cutoff, rung)"""


def _rank_sql(source: str, by: str, name: str = "metrics") -> str:
    """Average precision, AUC and Brier from row-level windows over every row of a group."""
    return f"""ranked_rows AS (SELECT {by}, y, p, count(*) OVER g AS n, sum(y) OVER g AS np,
      count(*) OVER (PARTITION BY {by} ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS shown,
      sum(y) OVER (PARTITION BY {by} ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS caught,
      rank() OVER (PARTITION BY {by} ORDER BY p) AS lo, count(*) OVER (PARTITION BY {by}, p) AS same
      FROM {source} WINDOW g AS (PARTITION BY {by})),
    {name} AS (SELECT {by}, max(n) AS n, CAST(max(np) AS BIGINT) AS positives, max(np)::DOUBLE / max(n) AS base_rate,
      CASE WHEN max(np) > 0 AND max(np) < max(n) THEN sum(y * caught::DOUBLE / shown) / max(np) END AS auc_pr,
      CASE WHEN max(np) > 0 AND max(np) < max(n) THEN (sum(y * (lo + (same - 1) / 2.0::DOUBLE)) - max(np)::DOUBLE * (max(np) + 1) / 2.0::DOUBLE)
           / (max(np)::DOUBLE * (max(n) - max(np))) END AS auc_roc,
      avg((p - y) * (p - y)) AS brier FROM ranked_rows GROUP BY {by})"""


def _budget_sql(source: str, by: str, budgets: str, key: str = "event_id") -> str:
    return f"""ordered AS (SELECT {by}, y, count(*) OVER (PARTITION BY {by}) AS n, sum(y) OVER (PARTITION BY {by}) AS np,
      row_number() OVER (PARTITION BY {by} ORDER BY p DESC, md5('42:' || {key}), {key}) AS place FROM {source}),
    budget_recall AS (SELECT {by}, budget, max(greatest(1, CAST(round_even(budget * n, 0) AS BIGINT))) AS k,
      CASE WHEN max(np) > 0 THEN sum(y) FILTER (place <= greatest(1, CAST(round_even(budget * n, 0) AS BIGINT)))::DOUBLE / max(np) END AS recall,
      least(1.0::DOUBLE, budget / (max(np)::DOUBLE / max(n))) AS ceiling
      FROM ordered, (VALUES {budgets}) v(budget) GROUP BY {by}, budget)"""


_BUDGETS = "(0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)"


def scored(spark, d):
    return b.scored_events(spark, d)


def grid_table(spark, d):
    return sc.confusion_by_threshold(scored(spark, d), BY)


def cut_policy(spark, d):
    rows = b.scored_by_cutoff(spark, d).where(F.col("split") == "validate")
    return stage(ho.freeze_policy(rows, CUT), "policy")


def cut_test(spark, d):
    return b.scored_by_cutoff(spark, d).where(F.col("split") == "test").drop("split")


def cut_cells(spark, d):
    """Score cells of validation and holdout rows, read by the frozen policy and by every metric."""
    return sc.score_cells(b.scored_by_cutoff(spark, d), [*CUT, "split"])


@query(
    "confusion_at_threshold",
    """SELECT split, rung, count(*) FILTER (y = 1 AND p < 0.3::DOUBLE) AS fn, count(*) FILTER (y = 0 AND p >= 0.3::DOUBLE) AS fp,
              count(*) AS n FROM scored GROUP BY ALL""",
)
def _confusion(spark, d):
    return sc.confusion(scored(spark, d), BY, 0.3)


@query(
    "expected_cost",
    """SELECT split, rung, r((10 * count(*) FILTER (y = 1 AND p < 0.3::DOUBLE) + count(*) FILTER (y = 0 AND p >= 0.3::DOUBLE)) / count(*)) AS expected_cost
       FROM scored GROUP BY ALL""",
)
def _cost(spark, d):
    return sc.with_cost(sc.confusion(scored(spark, d), BY, 0.3)).select(*BY, "expected_cost")


@query(
    "threshold_sweep",
    f"""WITH {_TABLE} SELECT c.split, c.rung, r(c.threshold) AS threshold, fn, fp, n, r((10 * fn + fp) / n) AS expected_cost,
          c.threshold = best AS is_best FROM conf c JOIN (SELECT split, rung,
          arg_min(threshold, ((10 * fn + fp) / n, threshold)) AS best FROM conf GROUP BY ALL) USING (split, rung)""",
)
def _sweep(spark, d):
    table = stage(grid_table(spark, d), "grid")
    best = sc.best_threshold(table, BY).select(*BY, F.col("threshold").alias("best"))
    return (
        sc.with_cost(table).join(best, BY).withColumn("is_best", F.col("threshold") == F.col("best")).drop("best")
    )


@query(
    "cost_ratio_curve",
    f"""WITH {_TABLE} SELECT split, rung, CAST(ratio AS INTEGER) AS ratio, r(arg_min(threshold, ((ratio * fn + fp) / n, threshold))) AS threshold,
          r(min((ratio * fn + fp) / n)) AS expected_cost FROM conf, range(2, 21) q(ratio) GROUP BY ALL""",
)
def _curve(spark, d):
    return sc.cost_ratio_curve(grid_table(spark, d), BY)


@query(
    "threshold_sensitivity",
    f"""WITH {_TABLE}, best AS (SELECT split, rung, arg_min(threshold, ((10 * fn + fp) / n, threshold)) AS t,
          min((10 * fn + fp) / n) AS c FROM conf GROUP BY ALL)
        SELECT split, rung, r(t) AS threshold, r(c) AS expected_cost, r(lo.cost) AS cost_minus, r(hi.cost) AS cost_plus FROM best
        JOIN (SELECT split, rung, threshold AS tl, (10 * fn + fp) / n AS cost FROM conf) lo USING (split, rung)
        JOIN (SELECT split, rung, threshold AS th, (10 * fn + fp) / n AS cost FROM conf) hi USING (split, rung)
        WHERE tl = round(greatest(0.01, t - 0.05), 2) AND th = round(least(0.99, t + 0.05), 2)""",
)
def _sensitivity(spark, d):
    return sc.threshold_sensitivity(stage(grid_table(spark, d), "grid"), BY)


@query(
    "average_precision",
    f"WITH {_rank_sql('scored', 'split, rung')} SELECT split, rung, r(auc_pr) AS auc_pr, r(base_rate) AS base_rate FROM metrics",
)
def _ap(spark, d):
    return sc.ranking_metrics(sc.score_ladder(scored(spark, d), BY), BY).select(*BY, "auc_pr", "base_rate")


@query("roc_auc", f"WITH {_rank_sql('scored', 'split, rung')} SELECT split, rung, r(auc_roc) AS auc_roc FROM metrics")
def _auc(spark, d):
    return sc.ranking_metrics(sc.score_ladder(scored(spark, d), BY), BY).select(*BY, "auc_roc")


@query("brier", "SELECT split, rung, r(avg((p - y) * (p - y))) AS brier FROM scored GROUP BY ALL")
def _brier(spark, d):
    err = F.col("p") - F.col("y")
    return scored(spark, d).groupBy(*BY).agg(F.avg(err * err).alias("brier"))


@query(
    "recall_at_budget",
    f"WITH {_budget_sql('scored', 'split, rung', _BUDGETS)} SELECT split, rung, r(budget) AS budget, k, r(recall) AS recall, r(ceiling) AS ceiling FROM budget_recall",
)
def _recall(spark, d):
    return sc.recall_at_budgets(scored(spark, d), BY, ["event_id"])


@query(
    "evaluation_report",
    f"""WITH {_TABLE}, {_rank_sql('scored', 'split, rung')}, {_budget_sql('scored', 'split, rung', _BUDGETS)},
         best AS (SELECT split, rung, unnest(min({{'expected_cost': (10 * fn + fp) / n, 'threshold': threshold, 'fn': fn, 'fp': fp}})) FROM conf GROUP BY split, rung),
         cell AS (SELECT split, rung, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM scored GROUP BY ALL),
         cal AS (SELECT split, rung, sum(n * abs(mean_p - observed)) / sum(n) AS ece FROM cell GROUP BY ALL),
         recalls AS (SELECT split, rung, max(recall) FILTER (budget = 0.05::DOUBLE) AS a, max(recall) FILTER (budget = 0.1::DOUBLE) AS b,
                     max(recall) FILTER (budget = 0.2::DOUBLE) AS c FROM budget_recall GROUP BY ALL)
       SELECT split, rung, n, positives, r(base_rate) AS base_rate, r(auc_pr) AS auc_pr, r(auc_roc) AS auc_roc, r(brier) AS brier, r(threshold) AS threshold,
         r(expected_cost) AS expected_cost, fn, fp, r(ece) AS ece, r(a) AS recall_at_5pct, r(b) AS recall_at_10pct, r(c) AS recall_at_20pct
       FROM metrics JOIN best USING (split, rung) JOIN cal USING (split, rung) JOIN recalls USING (split, rung)""",
)
def _report(spark, d):
    return ho.evaluation_report(scored(spark, d), BY, ["event_id"], sc.BUDGETS)


@query(
    "recall_ceiling",
    """SELECT split, rung, r(budget) AS budget, r(least(1.0::DOUBLE, budget / avg(y))) AS ceiling
       FROM scored, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(budget) GROUP BY split, rung, budget""",
)
def _ceiling(spark, d):
    rates = ho.split_base_rates(scored(spark, d), BY)
    rows = rates.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in sc.BUDGETS])))
    return rows.select(*BY, "budget", sc.recall_ceiling(F.col("budget"), F.col("base_rate")).alias("ceiling"))


@query(
    "alert_budget_topk",
    """SELECT split, rung, event_id, CAST(row_number() OVER (PARTITION BY split, rung ORDER BY p DESC, md5('42:' || event_id), event_id)
              <= greatest(1, CAST(round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY split, rung), 0) AS BIGINT)) AS INTEGER) AS flagged
       FROM scored""",
)
def _topk(spark, d):
    flags = budget_flags(scored(spark, d), BY, ["event_id"], "p", 0.10, 42)
    return flags.select(*BY, "event_id", "flagged")


@query(
    "calibration_ece",
    """WITH edges AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.1::DOUBLE AS lo, CASE i WHEN 9 THEN 'inf'::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(0, 10) e(i)),
         cells AS (SELECT g.split, g.rung, bin, count(p) AS n, avg(p) AS mean_p, avg(y) AS observed
                   FROM (SELECT DISTINCT split, rung FROM scored) g CROSS JOIN edges
                   LEFT JOIN scored s ON s.split = g.split AND s.rung = g.rung AND s.p >= lo AND s.p < hi GROUP BY ALL)
       SELECT split, rung, bin, n, r(mean_p) AS mean_p, r(observed) AS observed,
              r(coalesce(n / sum(n) OVER (PARTITION BY split, rung) * abs(mean_p - observed), 0)) AS ece_part FROM cells""",
)
def _calibration(spark, d):
    return sc.calibration(scored(spark, d), BY)


@query(
    "calibration_ece_total",
    """WITH edges AS (SELECT i AS bin, i * 0.1::DOUBLE AS lo, CASE i WHEN 9 THEN 'inf'::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(0, 10) e(i)),
         cells AS (SELECT g.split, g.rung, bin, count(p) AS n, avg(p) AS mean_p, avg(y) AS observed
                   FROM (SELECT DISTINCT split, rung FROM scored) g CROSS JOIN edges
                   LEFT JOIN scored s ON s.split = g.split AND s.rung = g.rung AND s.p >= lo AND s.p < hi GROUP BY ALL),
         parts AS (SELECT *, n / sum(n) OVER (PARTITION BY split, rung) * abs(mean_p - observed) AS part FROM cells)
       SELECT split, rung, r(sum(part)) AS ece, count(*) FILTER (n = 0) AS empty_bins FROM parts GROUP BY ALL""",
)
def _ece(spark, d):
    return sc.ece(sc.calibration(scored(spark, d), BY), BY)


# --- bootstrap ---------------------------------------------------------------------------------

SEED, T_FIRST, T_SECOND = 42, 0.2, 0.1
_EVENTS = """rows AS (SELECT event_id, user_id, CAST(kind = 'error' AS INTEGER) AS y, amount / (amount + 50.0::DOUBLE) AS p1,
           (event_id % 101)::DOUBLE / 101.0::DOUBLE AS p2 FROM ev)"""


def _mix_sql(x: str) -> str:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & 4294967295)" if factor > 1 else f"xor({x}, {x} >> {shift})"
    return x


def _keys_sql(name: str, step: int, source: str) -> str:
    """Keys of the two digests of (seed, step, label, block, resample); ``source`` has label and block."""
    parts = [f"{name}_0 AS (SELECT label, block, b, half, 0::UBIGINT AS k FROM ({source}), range(1, 1001) q(b), (SELECT unnest([0, 1]) AS half))"]
    for i, x in enumerate((str(SEED), "half", str(step), "label", "block", "b", "0")):
        mixed = _mix_sql("k")
        parts.append(f"{name}_{i + 1} AS (SELECT * REPLACE ({mixed} AS k) FROM (SELECT * REPLACE (xor(k, ({x})::UBIGINT) AS k) FROM {name}_{i}))")
    parts.append(f"{name} AS (SELECT label, block, b, max(k) FILTER (half = 0) AS k0, max(k) FILTER (half = 1) AS k1 FROM {name}_7 GROUP BY ALL)")
    return ", ".join(parts)


def _digest_sql(source: str, size: str) -> str:
    """Rows of ``source`` (with k0, k1, slot) and the position that each draws among ``size``."""
    return f"""SELECT * EXCLUDE (h0, h1), CAST((({_mix_sql("h0")} << 21) + ({_mix_sql("h1")} >> 11)) % {size} AS BIGINT) AS pos
      FROM (SELECT *, xor(k0, slot::UBIGINT) AS h0, xor(k1, slot::UBIGINT) AS h1 FROM {source})"""


def _boot_sql(base: str) -> str:
    """CTE sample (b, y, score), every copy a row; ``base`` selects y and score of every row."""
    return f"""base AS MATERIALIZED ({base}),
     ladder AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below, greatest(4096, ceil(sum(n) OVER () / 1024)) AS size
                FROM (SELECT score, count(*) AS n FROM base GROUP BY score)),
     placed AS MATERIALIZED (SELECT y AS label, score, CAST(2 * floor(below / size) + CAST(n >= size AS INTEGER) AS BIGINT) AS block,
                row_number() OVER (PARTITION BY y ORDER BY score) - 1 AS place FROM base JOIN ladder USING (score)),
     held AS (SELECT label, block, min(place) AS start, count(*) AS k FROM placed GROUP BY ALL),
     totals AS (SELECT label, sum(k)::BIGINT AS total FROM held GROUP BY ALL),
     {_keys_sql("key1", 0, "SELECT label, 0 AS block FROM totals")},
     slots AS (SELECT label, b, total, k0, k1, unnest(range(total)) AS slot FROM totals JOIN key1 USING (label)),
     first_draw AS ({_digest_sql("slots", "total::UBIGINT")}),
     taken AS MATERIALIZED (SELECT label, b, h.block, h.start, h.k, count(*) AS t FROM first_draw f JOIN held h USING (label)
                WHERE pos >= start AND pos < start + k GROUP BY ALL),
     {_keys_sql("key2", 1, "SELECT label, block + 1 AS block FROM held")},
     again AS (SELECT label, b, t.block, start, k, k0, k1, unnest(range(t)) AS slot FROM taken t JOIN key2 q USING (label, b) WHERE q.block = t.block + 1),
     second_draw AS ({_digest_sql("again", "k::UBIGINT")}),
     sample AS MATERIALIZED (SELECT b, d.label AS y, p.score FROM second_draw d JOIN placed p ON p.label = d.label AND p.place = d.start + d.pos)"""


def _base(spark, d):
    e = b.event_log(spark, d)
    return e.select(
        "event_id",
        "user_id",
        F.when(F.col("kind") == "error", 1).otherwise(0).alias("y"),
        (F.col("amount") / (F.col("amount") + 50.0)).alias("p1"),
        ((F.col("event_id") % 101).cast("double") / 101.0).alias("p2"),
    )


_KEY_NUMBER = "CAST('0x' || substr(md5('0:' || user_id || ':' || event_id), 1, 13) AS BIGINT)"


@query(
    "stratified_bootstrap",
    f"""WITH {_EVENTS}, {_boot_sql(f"SELECT y, {_KEY_NUMBER} AS score FROM rows")},
       per AS (SELECT score, b, count(*) AS c FROM sample GROUP BY ALL)
       SELECT user_id, event_id, y, CAST(coalesce(sum(c), 0) AS BIGINT) AS copies, count(c) AS present
       FROM rows LEFT JOIN per ON per.score = {_KEY_NUMBER} GROUP BY ALL""",
)
def _stratified(spark, d):
    return bs.row_draws(_base(spark, d), [], ["user_id", "event_id"], seed=SEED)


_BOOT = f"""WITH {_EVENTS}, {_boot_sql("SELECT y, p1 AS score FROM rows")},
     cells AS (SELECT b, score AS p, count(*) AS n, count(*) FILTER (y = 1) AS pos FROM sample GROUP BY ALL),
     run AS (SELECT *, sum(n) OVER w AS shown, sum(pos) OVER w AS caught, sum(n) OVER (PARTITION BY b) AS all_n, sum(pos) OVER (PARTITION BY b) AS all_pos
             FROM cells WINDOW w AS (PARTITION BY b ORDER BY p DESC)),
     per AS (SELECT b, (10 * sum(pos) FILTER (p < {T_FIRST}::DOUBLE) + coalesce(sum(n - pos) FILTER (p >= {T_FIRST}::DOUBLE), 0)) / any_value(all_n) AS expected_cost,
             sum(pos * caught / shown) / any_value(all_pos) AS auc_pr,
             sum(pos * ((all_n - all_pos) - (shown - caught) + (n - pos) / 2)) / any_value(all_pos * (all_n - all_pos)) AS auc_roc,
             sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / any_value(all_n) AS brier, """ + ", ".join(
    f"""sum(CASE WHEN shown - n < {k} AND {k} <= shown THEN caught - pos + ({k} - shown + n) * pos / n ELSE 0 END) / any_value(all_pos) AS recall_at_{x}pct"""
    for x in (5, 10, 20)
    for k in [f"greatest(1, round_even({x / 100}::DOUBLE * all_n, 0))"]
) + " FROM run GROUP BY b)"
_SEVEN = ["expected_cost", "auc_pr", "auc_roc", "brier", "recall_at_5pct", "recall_at_10pct", "recall_at_20pct"]


def _resampled(spark, d):
    return bs.bootstrap_metrics(_base(spark, d), [], "p1", T_FIRST, seed=SEED)


@query("bootstrap_metrics", f"{_BOOT} SELECT b, {', '.join(f'r({m}) AS {m}' for m in _SEVEN)} FROM per")
def _boot_metrics(spark, d):
    return _resampled(spark, d)


@query(
    "bootstrap_interval",
    f"""{_BOOT} SELECT metric, r(quantile_cont(value, 0.025)) AS lo, r(quantile_cont(value, 0.975)) AS hi
        FROM (UNPIVOT per ON {', '.join(_SEVEN)} INTO NAME metric VALUE value) GROUP BY metric""",
)
def _boot_interval(spark, d):
    return bs.intervals(stage(_resampled(spark, d), "resampled"), [])


@query(
    "paired_bootstrap_diff",
    f"""WITH {_EVENTS}, {_boot_sql(f"SELECT y, 2 * CAST(p1 >= {T_FIRST}::DOUBLE AS INTEGER) + CAST(p2 >= {T_SECOND}::DOUBLE AS INTEGER) AS score FROM rows")},
        per AS (SELECT b, sum(CASE WHEN y = 1 AND score < 2 THEN 10 WHEN y = 0 AND score >= 2 THEN 1 ELSE 0 END) / count(*)
             - sum(CASE WHEN y = 1 AND score % 2 = 0 THEN 10 WHEN y = 0 AND score % 2 = 1 THEN 1 ELSE 0 END) / count(*) AS diff
             FROM sample GROUP BY b),
        q AS (SELECT quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM per)
        SELECT r(lo) AS lo, r(hi) AS hi, CASE WHEN hi < 0 THEN 'first cheaper' WHEN lo > 0 THEN 'second cheaper' ELSE 'not separated' END AS verdict FROM q""",
)
def _paired(spark, d):
    per = stage(bs.paired_costs(_base(spark, d), [], "p1", "p2", F.lit(T_FIRST), F.lit(T_SECOND), seed=SEED), "paired")
    found = bs.intervals(per, [], ["difference"])
    return found.select("lo", "hi", bs.interval_verdict(F.col("lo"), F.col("hi")).alias("verdict"))


# --- holdout -----------------------------------------------------------------------------------

_SLICED = """sliced AS (SELECT event_id, y, p, 'band' AS slice, coalesce(band, '__NULL__') AS value FROM scored WHERE split = 'test' AND rung = 'R1'
       UNION ALL SELECT event_id, y, p, 'week', week FROM scored WHERE split = 'test' AND rung = 'R1')"""
_SLICE_SQL = f"""{_SLICED}, {_rank_sql("sliced", "slice, value")}, {_budget_sql("sliced", "slice, value", "(0.1::DOUBLE)")},
      costs AS (SELECT slice, value, (10 * count(*) FILTER (y = 1 AND p < 0.2::DOUBLE) + count(*) FILTER (y = 0 AND p >= 0.2::DOUBLE)) / count(*) AS c
                FROM sliced GROUP BY ALL),
      overall AS (SELECT (10 * count(*) FILTER (y = 1 AND p < 0.2::DOUBLE) + count(*) FILTER (y = 0 AND p >= 0.2::DOUBLE)) / count(*) AS o
                FROM scored WHERE split = 'test' AND rung = 'R1')"""


def _slices(spark, d):
    rows = scored(spark, d).where((F.col("split") == "test") & (F.col("rung") == "R1"))
    return ho.slice_metrics(rows, 0.2, ["band", "week"], ["event_id"])


@query(
    "slice_metrics",
    f"""WITH {_SLICE_SQL} SELECT slice, value, n, n < 100 AS underpowered, r(base_rate) AS base_rate, r(c) AS expected_cost,
          r((c - o) / o * 100) AS gap_pct, r(auc_pr) AS auc_pr, r(auc_roc) AS auc_roc, r(brier) AS brier, r(recall) AS recall_at_10pct
        FROM metrics JOIN costs USING (slice, value) JOIN budget_recall USING (slice, value), overall""",
)
def _slice_metrics(spark, d):
    return _slices(spark, d)


@query(
    "slice_gap_rank",
    f"""WITH {_SLICE_SQL} SELECT slice, value, r((c - o) / o * 100) AS gap_pct,
          CAST(row_number() OVER (ORDER BY (c - o) / o DESC, slice, value) AS BIGINT) AS place FROM costs, overall""",
)
def _slice_rank(spark, d):
    gaps = stage(_slices(spark, d).select("slice", "value", "gap_pct"), "gaps")
    named = gaps.withColumn("_key", F.concat_ws("/", "slice", "value"))
    return rank_map(named, "gap_pct", "_key", "place").drop("_key").orderBy("place")


@query(
    "trivial_policy",
    f"""WITH {_CUT_TABLE}, {_POLICY}, f AS (SELECT c.cutoff, c.rung, c.fn, c.fp, c.n, rate FROM conf c JOIN policy USING (cutoff, rung, threshold)
          JOIN (SELECT cutoff, rung, avg(y) AS rate FROM scored_cut WHERE split = 'test' GROUP BY ALL) USING (cutoff, rung) WHERE c.split = 'test')
        SELECT cutoff, rung, CAST(ratio AS INTEGER) AS ratio, r(1 - rate) AS cost_flag_all, r(ratio * rate) AS cost_flag_none, r((ratio * fn + fp) / n) AS cost_model,
          r(1 - rate - (ratio * fn + fp) / n) AS improvement, r((1 - rate - (ratio * fn + fp) / n) / (1 - rate) * 100) AS improvement_pct
        FROM f, range(2, 21) q(ratio)""",
)
def _trivial(spark, d):
    policy, test = cut_policy(spark, d), cut_test(spark, d)
    return ho.trivial_policies(ho.at_policy(test, policy, CUT), ho.split_base_rates(test, CUT), CUT)


@query(
    "counterfactual_threshold",
    f"""WITH {_CUT_TABLE}, {_POLICY}, cf AS (SELECT cutoff, rung, ratio, arg_min(threshold, ((ratio * fn + fp) / n, threshold)) AS t, min((ratio * fn + fp) / n) AS c
          FROM conf, range(2, 21) q(ratio) WHERE split = 'test' GROUP BY cutoff, rung, ratio)
        SELECT cutoff, rung, CAST(ratio AS INTEGER) AS ratio, r(cf.t) AS cf_threshold, r(cf.c) AS cost_cf, r(policy.threshold) AS frozen_threshold,
          r((ratio * fn + fp) / n) AS cost_frozen
        FROM cf JOIN policy USING (cutoff, rung) JOIN conf USING (cutoff, rung, threshold) WHERE conf.split = 'test'""",
)
def _counterfactual(spark, d):
    return ho.counterfactual_thresholds(cut_test(spark, d), cut_policy(spark, d), CUT)


@query(
    "threshold_stability",
    f"""WITH {_CUT_TABLE}, {_POLICY}, own AS (SELECT cutoff, rung, arg_min(threshold, ((10 * fn + fp) / n, threshold)) AS t FROM conf WHERE split = 'test' GROUP BY ALL)
        SELECT cutoff, rung, r(threshold) AS frozen, r(t) AS test_optimal, r(threshold - t) AS gap FROM policy JOIN own USING (cutoff, rung)""",
)
def _stability(spark, d):
    return ho.threshold_stability(cut_test(spark, d), cut_policy(spark, d), CUT)


@query(
    "model_selection",
    f"""WITH {_CUT_TABLE}, {_POLICY} SELECT cutoff, arg_min(rung, (validate_cost, rung)) AS rung, r(min(validate_cost)) AS validate_cost FROM policy GROUP BY cutoff""",
)
def _selection(spark, d):
    return ho.select_rung(cut_policy(spark, d), ["cutoff"])


_METRICS_CUT = f"""{_CUT_TABLE}, {_POLICY}, {_rank_sql("scored_cut", "cutoff, split, rung")}, {_budget_sql("scored_cut", "cutoff, split, rung", "(0.1::DOUBLE)")},
    points AS (SELECT m.*, (10 * fn + fp) / c.n AS expected_cost, recall AS recall_at_10pct
       FROM metrics m JOIN policy p ON m.cutoff = p.cutoff AND m.rung = p.rung
       JOIN conf c ON c.cutoff = m.cutoff AND c.rung = m.rung AND c.split = m.split AND c.threshold = p.threshold
       JOIN budget_recall b ON b.cutoff = m.cutoff AND b.rung = m.rung AND b.split = m.split)"""


@query(
    "cutoff_comparison",
    f"""WITH {_METRICS_CUT}, long AS (UNPIVOT (SELECT cutoff, split, rung, expected_cost, auc_pr, brier, recall_at_10pct FROM points)
          ON expected_cost, auc_pr, brier, recall_at_10pct INTO NAME metric VALUE value),
        chosen AS (SELECT cutoff, arg_min(rung, (validate_cost, rung)) AS rung FROM policy GROUP BY cutoff),
        bases AS (SELECT rung AS basis, cutoff, metric, value FROM long WHERE split = 'test'
          UNION ALL SELECT 'selected', cutoff, metric, value FROM long JOIN chosen USING (cutoff, rung) WHERE split = 'test')
        SELECT e.basis, e.metric, r(e.value) AS early_value, r(l.value) AS late_value, r((e.value - l.value) / l.value * 100) AS change_pct
        FROM bases e JOIN bases l ON e.basis = l.basis AND e.metric = l.metric WHERE e.cutoff = 14 AND l.cutoff = 28""",
)
def _cutoffs(spark, d):
    cells = cut_cells(spark, d)
    policy = stage(ho.frozen_from_cells(cells.where("split = 'validate'"), CUT), "policy")
    metrics = stage(ho.holdout_metrics(cut_test(spark, d), policy, CUT, ["event_id"], cells.where("split = 'test'")), "points")
    return ho.cutoff_comparison(metrics, ho.select_rung(policy, ["cutoff"]), 14, 28)


@query(
    "validate_test_change",
    f"""WITH {_METRICS_CUT}, wide AS (SELECT cutoff, rung, split, base_rate, 1 - base_rate AS flag_all_cost, expected_cost, auc_pr, brier FROM points),
        long AS (UNPIVOT wide ON base_rate, flag_all_cost, expected_cost, auc_pr, brier INTO NAME metric VALUE value)
        SELECT v.cutoff, v.rung, v.metric, r(v.value) AS validate_value, r(t.value) AS test_value, r(t.value - v.value) AS change,
          r((t.value - v.value) / v.value * 100) AS change_pct
        FROM long v JOIN long t ON v.cutoff = t.cutoff AND v.rung = t.rung AND v.metric = t.metric WHERE v.split = 'validate' AND t.split = 'test'""",
)
def _change(spark, d):
    cells, by = cut_cells(spark, d), [*CUT, "split"]
    policy = ho.frozen_from_cells(cells.where("split = 'validate'"), CUT)
    both = policy.withColumn("split", F.explode(F.array(F.lit("validate"), F.lit("test"))))
    metrics = stage(ho.holdout_metrics(b.scored_by_cutoff(spark, d), both, by, ["event_id"], cells), "points")
    return ho.validate_test_change(metrics, CUT)


@query(
    "rung_cost_comparison",
    f"""WITH {_CUT_TABLE}, {_POLICY} SELECT a.cutoff, r(a.validate_cost) AS cost_first, r(z.validate_cost) AS cost_second, r(a.validate_cost - z.validate_cost) AS difference,
          CASE WHEN a.validate_cost < z.validate_cost THEN 'win' WHEN a.validate_cost > z.validate_cost THEN 'lose' ELSE 'tie' END AS verdict
        FROM policy a JOIN policy z USING (cutoff) WHERE a.rung = 'R1' AND z.rung = 'R2'""",
)
def _rung_comparison(spark, d):
    return ho.rung_cost_comparison(cut_policy(spark, d), "R1", "R2")


@query(
    "split_base_rates",
    "SELECT cutoff, split, count(*) AS n, r(avg(not_completed)) AS base_rate FROM cohort GROUP BY ALL",
)
def _split_rates(spark, d):
    return ho.split_base_rates(cohort_of(spark, d), ["cutoff", "split"], "not_completed")
