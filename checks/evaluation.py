"""Sequence continuation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.tables import metrics_sql
from encore.operators import lookups, metrics, transitions
from encore.plans import continuation

EPS = 1e-6


def fitted(s):
    return s.stored("transitions", lambda: transitions.fit_transitions(s.train))


def full_recs(s):
    return s.stored("full_recs", lambda: transitions.continue_full(s.seeds, fitted(s)))


def semi_recs(s):
    return s.stored("semi_recs", lambda: transitions.continue_semi(s.seeds, fitted(s)))


def both_recs(s):
    return full_recs(s).withColumn("method", F.lit("full")).unionByName(
        semi_recs(s).withColumn("method", F.lit("semi"))
    )


def both_metrics(s):
    rows = metrics.per_playlist_metrics(both_recs(s), s.truth, ["method"])
    return rows.join(s.lists.select("pid", "k"), "pid")


_BOTH = "(SELECT *, 'full' AS method FROM full_recs UNION ALL SELECT *, 'semi' AS method FROM semi_recs)"
_FULL_METRICS = metrics_sql("full_recs", "truth")
_BOTH_METRICS = f"(SELECT * FROM ({metrics_sql(_BOTH, 'truth', 'method,')}) JOIN (SELECT pid, k FROM lists) USING (pid))"
_MEANS = ", ".join(f"avg({m}) AS {m}" for m in metrics.METRICS)
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)


@query("k1_fit_transitions", "SELECT prev, next, n, total, round(p, 6) AS p FROM transitions")
def _(s):
    return rounded(transitions.fit_transitions(s.train), "p")


@query(
    "k1_fit_transitions_gap",
    """SELECT prev, next, count(*) AS n FROM (SELECT a.track_uri AS prev, b.track_uri AS next FROM train_tracks a
       JOIN train_tracks b ON a.pid = b.pid AND b.pos - a.pos BETWEEN 1 AND 3) GROUP BY ALL""",
)
def _(s):
    return transitions.fit_transitions(s.train, max_gap=3).select("prev", "next", "n")


@query("k2_prune_transitions", "SELECT prev, next, n, rank FROM (SELECT prev, next, n, row_number() OVER (PARTITION BY prev "
       "ORDER BY n DESC, next) AS rank FROM transitions) WHERE rank <= 5")
def _(s):
    return transitions.prune_transitions(fitted(s), 5).select("prev", "next", "n", "rank")


_REC_COLUMNS = "pid, rank, track_uri, round(score, 6) AS score"


@query("k3_continue_full", f"SELECT {_REC_COLUMNS} FROM full_recs")
def _(s):
    return rounded(transitions.continue_full(s.seeds, fitted(s)), "score")


@query("k4_continue_semi", f"SELECT {_REC_COLUMNS} FROM semi_recs")
def _(s):
    return rounded(transitions.continue_semi(s.seeds, fitted(s)), "score")


@query("k4_one_hop", f"SELECT {_REC_COLUMNS} FROM full_recs")
def _(s):
    return rounded(transitions.continue_semi(s.seeds, fitted(s), hops=1), "score")


@query("k4_three_hops", f"SELECT {_REC_COLUMNS} FROM three_hop_recs")
def _(s):
    return rounded(transitions.continue_semi(s.seeds, fitted(s), hops=3), "score")


@query(
    "k5_next_item",
    """SELECT pid, prev, next, round(p, 6) AS p FROM (SELECT pid, arg_max(track_uri, pos) AS prev FROM seeds GROUP BY pid)
       JOIN best_next USING (prev)""",
)
def _(s):
    return rounded(transitions.next_item(s.seeds, fitted(s)), "p")


_DEV_PAIRS = """(SELECT prev, y FROM (SELECT track_uri AS prev, lead(track_uri) OVER (PARTITION BY pid ORDER BY pos) AS y
    FROM part_tracks WHERE part = 'dev') WHERE y IS NOT NULL)"""


@query(
    "k6_sequence_accuracy",
    f"""SELECT count(*) AS positions, count(*) FILTER (WHERE next = y) AS hits,
          round(count(*) FILTER (WHERE next = y) / count(*), 6) AS accuracy
        FROM {_DEV_PAIRS} LEFT JOIN best_next USING (prev)""",
)
def _(s):
    dev = s.part_tracks.where("part = 'dev'")
    return rounded(transitions.sequence_accuracy(dev, fitted(s)), "accuracy")


@query(
    "k7_sequence_loss",
    f"""SELECT count(*) AS positions, round(avg(-ln(greatest(coalesce(p, 0), {EPS}))), 6) AS loss
        FROM {_DEV_PAIRS} d LEFT JOIN transitions t ON d.prev = t.prev AND d.y = t.next""",
)
def _(s):
    dev = s.part_tracks.where("part = 'dev'")
    return rounded(transitions.sequence_loss(dev, fitted(s), EPS), "loss")


@query(
    "k8_recommend_all",
    f"SELECT method, {_REC_COLUMNS} FROM {_BOTH} WHERE pid NOT IN (SELECT pid FROM lists WHERE k = 1)",
)
def _(s):
    done = s.lists.where("k = 1").select("pid")
    recs = continuation.recommend_all({"full": full_recs(s), "semi": semi_recs(s)}, done)
    return rounded(recs, "score").select("method", "pid", "rank", "track_uri", "score")


@query(
    "j10_score_accumulate",
    """SELECT pid, rank, track_uri, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (
         PARTITION BY pid ORDER BY score DESC, track_uri) AS rank FROM (
         SELECT pid, track_uri, sum(CAST(1 / (pos + 1) AS DECIMAL(26, 12))) AS score FROM part_tracks p WHERE part = 'test' AND NOT EXISTS (
           SELECT 1 FROM seeds s WHERE s.pid = p.pid AND s.track_uri = p.track_uri) GROUP BY ALL)) WHERE rank <= 20""",
)
def _(s):
    steps = s.part_tracks.where("part = 'test'").select("pid", "track_uri", (1 / (F.col("pos") + 1)).alias("score"))
    return rounded(transitions.score_accumulate(steps, s.seeds, 20), "score")


@query(
    "a7_pending",
    "SELECT pid, k FROM test_lists WHERE pid NOT IN (SELECT pid FROM full_recs)",
)
def _(s):
    return lookups.drop_rows(s.test_lists.select("pid", "k"), full_recs(s).select("pid").distinct(), "pid")


def _metric_query(name, column):
    @query(name, f"SELECT pid, round({column}, 6) AS {column} FROM ({_FULL_METRICS})")
    def _(s):
        rows = metrics.per_playlist_metrics(full_recs(s), s.truth)
        return rounded(rows.select("pid", column), column)


for _name, _column in {
    "l1_r_precision": "r_prec", "l3_dcg": "dcg", "l4_ndcg": "ndcg", "l5_clicks": "clicks", "l6_recall": "recall",
}.items():
    _metric_query(_name, _column)


@query(
    "l2_relevance",
    """SELECT pid, rank, track_uri, CAST(EXISTS (SELECT 1 FROM truth t WHERE t.pid = r.pid AND t.track_uri = r.track_uri)
       AS INTEGER) AS hit FROM full_recs r""",
)
def _(s):
    return metrics.relevance(full_recs(s), s.truth).select("pid", "rank", "track_uri", "hit")


@query(
    "c8_predictions_with_truth",
    "SELECT pid, count(*) AS n FROM full_recs JOIN (SELECT DISTINCT pid FROM truth) USING (pid) GROUP BY pid",
)
def _(s):
    recs = lookups.keep_rows(full_recs(s), s.truth.select("pid"), "pid")
    return recs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c9_pairing_by_pid",
    "SELECT pid, k, count(*) AS n FROM test_lists JOIN full_recs USING (pid) GROUP BY ALL",
)
def _(s):
    sizes = full_recs(s).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return s.test_lists.select("pid", "k").join(sizes, "pid")


_WITH_K = f"(SELECT * FROM ({_FULL_METRICS}) JOIN (SELECT pid, k FROM lists) USING (pid))"


def _evaluated(where="true"):
    means = f"SELECT CAST(k AS VARCHAR) AS k, {_MEANS}, count(*) AS n FROM {_WITH_K} WHERE {where} GROUP BY ALL"
    return (
        f"SELECT k, {_ROUND}, n FROM ({means}) UNION ALL "
        f"SELECT 'avg', {', '.join(f'round(avg({m}), 6)' for m in metrics.METRICS)}, CAST(sum(n) AS BIGINT) FROM ({means})"
    )


def full_metrics(s):
    rows = metrics.per_playlist_metrics(full_recs(s), s.truth)
    return rows.join(s.lists.select("pid", "k"), "pid")


@query("l7_evaluate", _evaluated())
def _(s):
    return rounded(metrics.evaluate(full_metrics(s)), *metrics.METRICS)


@query("l8_evaluate_micro", f"SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics.METRICS)}, count(*) AS n FROM ({_FULL_METRICS})")
def _(s):
    return rounded(metrics.evaluate_micro(metrics.per_playlist_metrics(full_recs(s), s.truth)), *metrics.METRICS)


@query("l9_per_playlist_metrics", f"SELECT method, k, pid, {_ROUND} FROM {_BOTH_METRICS}")
def _(s):
    return rounded(both_metrics(s), *metrics.METRICS).select("method", "k", "pid", *metrics.METRICS)


@query(
    "l10_paired_difference",
    f"""SELECT metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean / nullif(std / sqrt(n), 0), 4) AS t FROM (
        SELECT metric, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS std FROM (
          SELECT unnest(['r_prec', 'ndcg', 'clicks', 'recall']) AS metric, unnest([a.r_prec - b.r_prec, a.ndcg - b.ndcg,
            a.clicks - b.clicks, a.recall - b.recall]) AS d
          FROM {_BOTH_METRICS} a JOIN {_BOTH_METRICS} b USING (pid) WHERE a.method = 'full' AND b.method = 'semi')
        GROUP BY metric)""",
)
def _(s):
    rows = metrics.paired_difference(both_metrics(s), "full", "semi")
    return rounded(rounded(rows, "mean", "std"), "t", digits=4)


@query(
    "l11_leaderboard",
    f"""SELECT method, {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics.METRICS)} FROM (
        SELECT method, k, {_MEANS} FROM {_BOTH_METRICS} GROUP BY ALL) GROUP BY method""",
)
def _(s):
    return rounded(metrics.leaderboard(both_metrics(s)), *metrics.METRICS)


@query("l12_exclude_cold", _evaluated("k > 0"))
def _(s):
    return rounded(metrics.evaluate(full_metrics(s), exclude_cold=True), *metrics.METRICS)


@query(
    "l7_continuation_report",
    _evaluated(),
)
def _(s):
    return rounded(continuation.evaluate_transitions(s.train, s.part_tracks.where("part = 'test'")), *metrics.METRICS)
