"""DuckDB SQL for the registered queries."""

from __future__ import annotations

CLIPS = """WITH kk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
st AS (SELECT *, CAST(1704067200 + 86400 * label + 4 * k + 40 * (k // 17) AS BIGINT) AS t FROM kk),
clips AS (SELECT vec_id AS "row", 'run-' || label AS run_uuid, t AS chunk_start_unix,
  CASE WHEN vec_id % 13 <> 0 THEN t + 8 END AS chunk_end_unix,
  CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 29 = 0 THEN '' ELSE 'run-' || label || '-s' || (k // 4) END AS segment_id,
  CASE WHEN label <> 9 THEN 'v' || (label % 3) END AS vehicle, CAST(t + 3600 AS DOUBLE) AS created_at_unix_s,
  CAST(embedding AS DOUBLE[]) AS vec FROM st)"""
SCALE = CLIPS + """,
dims AS (SELECT "row", unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM clips),
sm AS (SELECT d, max(abs(x)) AS m FROM dims GROUP BY d),
sc AS (SELECT list(m ORDER BY d) AS scale FROM sm)"""


def screened(rows: str) -> str:
    """score: largest screened product with the rows' vectors; eps."""
    return SCALE + f""",
q AS (SELECT "row" AS qrow, list_transform(range(1, len(vec) + 1), lambda i: vec[i] * scale[i] / CAST(127 AS DOUBLE)) AS w FROM clips, sc WHERE "row" IN ({rows})),
i8 AS (SELECT clips.*, list_transform(range(1, len(vec) + 1), lambda i: greatest(CAST(-127 AS DOUBLE), least(CAST(127 AS DOUBLE), round_even(vec[i] * CAST(127 AS DOUBLE) / scale[i], 0)))) AS c FROM clips, sc),
scored AS (SELECT i8."row", any_value(run_uuid) AS run_uuid, any_value(vec) AS vec, round(max(list_dot_product(c, w)), 9) AS score FROM i8, q GROUP BY i8."row"),
e AS (SELECT sqrt(list_sum(list_transform(scale, lambda x: x * x))) / 254 AS eps FROM sc)"""


EXACT = CLIPS + """,
q0 AS (SELECT vec AS q FROM clips WHERE "row" = 0),
s AS (SELECT clips.*, round(list_dot_product(vec, q), 9) AS score FROM clips, q0)"""
_CELLS = """,
g AS (SELECT run_uuid, "row", chunk_start_unix AS t, score, chunk_start_unix - lag(chunk_start_unix) OVER (PARTITION BY run_uuid ORDER BY chunk_start_unix) AS gap FROM s),
b AS (SELECT *, coalesce(min(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY run_uuid), 4) AS stride, min(t) OVER (PARTITION BY run_uuid) AS base FROM g),
p AS (SELECT *, CAST(round_even((t - base) / stride, 0) AS BIGINT) AS p FROM b),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run_uuid, p ORDER BY t DESC, score ASC, "row" DESC) = 1),
m AS (SELECT *, p AS m, 0 AS is_left FROM o UNION ALL SELECT *, p + 1, 1 FROM o),
cells AS (SELECT run_uuid, m, avg(score) AS cell, arg_max("row", {'a': score, 'b': is_left, 'c': "row"}) AS peak_row, any_value(base) + (m + 0.5::DOUBLE) * any_value(stride) AS centre, any_value(stride) AS stride FROM m GROUP BY run_uuid, m)"""
CELLS = EXACT + _CELLS
LABELLED = """WITH l AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id)),
g AS (SELECT score AS tau, sum(label) AS p, sum(1 - label) AS q FROM l GROUP BY score),
w AS (SELECT tau, CAST(sum(p) OVER d AS BIGINT) AS tp, CAST(sum(q) OVER d AS BIGINT) AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq FROM g WINDOW d AS (ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT tau, tp, fp, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN ap > 0 THEN CAST(tp AS DOUBLE) / ap ELSE 1.0 END AS recall, CASE WHEN aq > 0 THEN CAST(fp AS DOUBLE) / aq ELSE 1.0 END AS fpr FROM w)"""
STATS = EXACT + """,
a AS (SELECT avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, [0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE, 0.999::DOUBLE]) AS p, max(score) AS mx, count(*) AS n FROM s),
st2 AS (SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(p[1], 6) AS p50, round(p[2], 6) AS p90, round(p[3], 6) AS p99, round(p[4], 6) AS p999, round(mx, 6) AS max, round(CASE WHEN std > 1e-9 THEN (p[4] - mean) / std ELSE 0 END, 6) AS top_gap, n FROM a)"""
POINTS = CLIPS + """,
p0 AS (SELECT "row", vec[1] - avg(vec[1]) OVER () AS x, vec[2] - avg(vec[2]) OVER () AS y FROM clips),
pts AS (SELECT "row", x / max(greatest(abs(x), abs(y))) OVER () AS x, y / max(greatest(abs(x), abs(y))) OVER () AS y FROM p0)"""
TAGS = """WITH v AS (SELECT 'u' || user_id AS tag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, value / 1000 AS threshold, event_type AS project, ts AS created_at FROM events),
now AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY version DESC) = 1)"""


def pooled(source: str, digits: str = "") -> str:
    """Top 15 by the product with the unit mean of `source` rows (d, x)."""
    return f""",
mv AS (SELECT d, avg(x) AS m FROM {source} GROUP BY d),
u AS (SELECT list_transform(list(m ORDER BY d), lambda x: x) AS v FROM mv),
uq AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS q FROM u)
SELECT "row", round(score, 6) AS score FROM (SELECT "row", round(list_dot_product(vec, q), 9) AS score FROM clips, uq) ORDER BY score DESC, "row" LIMIT 15"""


#: First start of run 2.
_T2 = 1704067200 + 2 * 86400
_WINDOW = f"run_uuid = 'run-2' AND coalesce(chunk_end_unix, chunk_start_unix + 8) > {_T2 + 30} AND chunk_start_unix < {_T2 + 90}"
_UNIT = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
_PICK = "SELECT tau, {met} AS met FROM c ORDER BY {order} LIMIT 1"
_IN = " + ".join(
    f"CAST(((({ay} > y) <> ({by} > y)) AND x < {ax} + (y - ({ay})) * CAST({(bx - ax) / (by - ay)!r} AS DOUBLE)) AS INT)"
    for (ax, ay), (bx, by) in zip([(-0.5, -0.5), (0.6, -0.4), (0.5, 0.6), (-0.4, 0.5)], [(0.6, -0.4), (0.5, 0.6), (-0.4, 0.5), (-0.5, -0.5)], strict=True)
)


def _islands(tau: float) -> str:
    """Islands of cells over tau."""
    return f""",
n AS (SELECT *, lag(m) OVER r AS pm, lag(cell) OVER r AS pc, lead(m) OVER r AS nm, lead(cell) OVER r AS nc FROM cells WINDOW r AS (PARTITION BY run_uuid ORDER BY m)),
h AS (SELECT *, m - row_number() OVER (PARTITION BY run_uuid ORDER BY m) AS island,
  centre - stride * CASE WHEN pm = m - 1 AND pc < {tau} THEN (cell - {tau}::DOUBLE) / (cell - pc) ELSE 0.5::DOUBLE END AS up,
  centre + stride * CASE WHEN nm = m + 1 AND nc < {tau} THEN (cell - {tau}::DOUBLE) / (cell - nc) ELSE 0.5::DOUBLE END AS down FROM n WHERE cell >= {tau})
SELECT run_uuid, round(arg_min(up, m), 4) AS start_s, round(arg_max(down, m), 4) AS end_s, round(max(cell), 4) AS peak, round(avg(cell), 4) AS mean, count(*) AS num_cells, arg_max(peak_row, {{'a': cell, 'b': -m}}) AS peak_row FROM h GROUP BY run_uuid, island"""


ORACLES: dict[str, str] = {
    "screen_topk": screened("0") + ' SELECT row_number() OVER (ORDER BY score DESC, "row") AS rank, "row", run_uuid, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, "row" LIMIT 25)',
    "screen_threshold": screened("0") + """ SELECT "row", round(score, 6) AS score, CASE WHEN score >= 0.15 + eps THEN 'above' ELSE 'band' END AS class FROM scored, e WHERE score >= 0.15""",
    "classify_counts": screened("0") + " SELECT CASE WHEN score >= 0.15 + eps THEN 'above' WHEN score < 0.15 - eps THEN 'below' ELSE 'band' END AS class, count(*) AS n FROM scored, e GROUP BY 1",
    "eps_bounds": SCALE + ' SELECT round(sqrt(list_sum(list_transform(scale, lambda x: x * x))) / 254, 9) AS cauchy, round(list_dot_product(list_transform(vec, lambda x: abs(x)), scale) / 254, 9) AS hoelder FROM sc, clips WHERE "row" = 0',
    "cascade_topk_refined": screened("0") + ', q0 AS (SELECT vec AS qv FROM clips WHERE "row" = 0), cut AS (SELECT min(score) AS cut FROM (SELECT score FROM scored ORDER BY score DESC LIMIT 50)) SELECT "row", round(exact, 6) AS exact FROM (SELECT "row", round(list_dot_product(vec, qv), 9) AS exact FROM scored, q0, cut, e WHERE score >= cut - 2 * eps) ORDER BY exact DESC, "row" LIMIT 50',
    "cascade_tau_refined": screened("0") + """, q0 AS (SELECT vec AS qv FROM clips WHERE "row" = 0) SELECT "row", round(score, 6) AS score, CASE WHEN score >= 0.15 + eps THEN 'above' ELSE 'band' END AS class FROM scored, e, q0 WHERE score >= 0.15 + eps OR (score >= 0.15 - eps AND round(list_dot_product(vec, qv), 9) >= 0.15)""",
    "maxsim_topk": screened("0, 3, 7") + ' SELECT "row", round(score, 6) AS score FROM scored ORDER BY scored.score DESC, "row" LIMIT 20',
    "exact_cosine_topk": EXACT + ' SELECT "row", round(score, 6) AS score FROM s ORDER BY s.score DESC, "row" LIMIT 20',
    "arrow_exact_scores": EXACT + ' SELECT "row", round(score, 6) AS score FROM s',
    "filter_vehicle_date": CLIPS + f""" SELECT "row", vehicle, chunk_start_unix FROM clips WHERE vehicle IN ('v0', 'v2') AND chunk_start_unix >= {1704067200 + 86400} AND chunk_start_unix < {1704067200 + 5 * 86400}""",
    "filter_run_segment": CLIPS + """ SELECT "row", run_uuid, segment_id FROM clips WHERE run_uuid IN ('run-1', 'run-2', 'run-3') AND segment_id IN (SELECT segment_id FROM clips WHERE "row" % 5 = 0 AND segment_id <> '')""",
    "filter_exclude": CLIPS + ' SELECT "row" FROM clips WHERE "row" NOT IN (0, 1, 2, 3, 10000000)',
    "window_rows_overlap": CLIPS + f' SELECT "row", chunk_start_unix, chunk_end_unix FROM clips WHERE {_WINDOW}',
    "window_meanpool_topk": CLIPS + f", win AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM clips WHERE {_WINDOW})" + pooled("win"),
    "resolve_chunk_ids": CLIPS + """ SELECT run_uuid || '#t' || chunk_start_unix AS chunk_id, min("row") AS "row" FROM clips WHERE run_uuid || '#t' || chunk_start_unix IN (SELECT run_uuid || '#t' || chunk_start_unix FROM clips WHERE "row" % 7 = 0) GROUP BY 1""",
    "first_per_segment": EXACT + """ SELECT "row", segment_id, round(score, 6) AS score FROM s QUALIFY segment_id IS NULL OR row_number() OVER (PARTITION BY segment_id ORDER BY s.score DESC, "row") = 1""",
    "dedupe_export_rerank": EXACT + """, f AS (SELECT * FROM s QUALIFY segment_id IS NULL OR segment_id = '' OR row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, "row") = 1) SELECT row_number() OVER (ORDER BY f.score DESC, "row") AS rank, "row", segment_id, round(score, 6) AS score FROM f""",
    "export_projection": EXACT + """ SELECT row_number() OVER (ORDER BY s.score DESC, "row") AS rank, round(score, 6) AS score, segment_id, run_uuid || '#t' || chunk_start_unix AS chunk_id, run_uuid, chunk_start_unix * 1000000000 AS start_timestamp_ns, coalesce(chunk_end_unix * 1000000000, -1) AS end_timestamp_ns, 'clips/dt=' || strftime(make_timestamp(chunk_start_unix * 1000000), '%Y-%m-%d') || '/' || run_uuid || '_t' || chunk_start_unix || '.mp4' AS source_media_uri, vehicle, 'tag_a' AS tag, "row" AS corpus_row FROM s""",
    "confidence_margin": EXACT + ', f AS (SELECT * FROM s WHERE score >= 0.05) SELECT "row", round(score, 6) AS score, round(greatest(0.0, least(1.0, (f.score - 0.05::DOUBLE) / (greatest(max(f.score) OVER (), 0.05::DOUBLE + 1e-6) - 0.05::DOUBLE))), 6) AS confidence FROM f',
    "passthrough_join": EXACT + ', n AS (SELECT segment_id, count(*) AS clips_in_segment FROM s WHERE segment_id IS NOT NULL GROUP BY 1) SELECT "row", s.segment_id, round(score, 6) AS score, clips_in_segment FROM s LEFT JOIN n ON s.segment_id = n.segment_id',
    "since_version": CLIPS + f' SELECT "row", created_at_unix_s FROM clips WHERE created_at_unix_s >= {1704067200 + 4 * 86400}',
    "result_page": EXACT + ', r AS (SELECT row_number() OVER (ORDER BY score DESC, "row") AS rank, * FROM s) SELECT rank, "row", round(score, 6) AS score FROM r WHERE rank BETWEEN 41 AND 60',
    "drive_cells": CELLS + " SELECT run_uuid, m, round(cell, 6) AS cell, peak_row, round(centre, 6) AS centre FROM cells",
    "intervals": CELLS + _islands(0.05),
    "interval_tau_pooled_k": CELLS + " SELECT round(min(cell), 6) AS tau FROM (SELECT cell FROM cells ORDER BY cell DESC LIMIT 30)",
    "score_stats": STATS + " SELECT * FROM st2",
    "heuristic_tau": STATS + " SELECT round(least(greatest(mean + 3 * std, 0.05::DOUBLE), 0.9::DOUBLE), 6) AS tau FROM st2",
    "score_histogram": EXACT + ", r AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT CAST(least(49, floor((score - lo) / (hi - lo) * 50)) AS BIGINT) AS bin FROM s, r), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT i.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 50)) AS bin) i LEFT JOIN n ON i.bin = n.bin",
    "pr_sweep": LABELLED + " SELECT tau, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM c",
    "average_precision": LABELLED + ", d AS (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY tau DESC), 0)) * precision AS a FROM c) SELECT round(sum(a), 6) AS ap FROM d",
    "pick_tau_f1": LABELLED + " " + _PICK.format(met="true", order="round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 12) DESC, tau DESC"),
    "pick_tau_youden": LABELLED + " " + _PICK.format(met="true", order="round(recall - fpr, 12) DESC, tau DESC"),
    "pick_tau_precision": LABELLED + " " + _PICK.format(met="precision >= 0.9", order="(precision >= 0.9) DESC, round(CASE WHEN precision >= 0.9 THEN recall ELSE precision END, 12) DESC, tau DESC"),
    "rocchio_topk": SCALE.split(",\nsm AS")[0] + f""",
pm AS (SELECT list(m ORDER BY d) AS v FROM (SELECT d, avg(x) AS m FROM dims WHERE "row" IN (0, 5, 9) GROUP BY d)), pu AS (SELECT {_UNIT('v')} AS p FROM pm),
nm AS (SELECT list(m ORDER BY d) AS v FROM (SELECT d, avg(x) AS m FROM dims WHERE "row" IN (2, 4) GROUP BY d)), nu AS (SELECT {_UNIT('v')} AS n FROM nm),
d1 AS (SELECT list_transform(range(1, len(p) + 1), lambda i: p[i] - 0.5::DOUBLE * n[i]) AS v FROM pu, nu), u1 AS (SELECT {_UNIT('v')} AS w FROM d1),
t AS (SELECT vec AS v FROM clips WHERE "row" = 1), tu AS (SELECT {_UNIT('v')} AS t FROM t),
d2 AS (SELECT list_transform(range(1, len(w) + 1), lambda i: 0.7::DOUBLE * w[i] + 0.3::DOUBLE * t[i]) AS v FROM u1, tu), u2 AS (SELECT {_UNIT('v')} AS q FROM d2)
SELECT "row", round(score, 6) AS score FROM (SELECT "row", round(list_dot_product(vec, q), 9) AS score FROM clips, u2) ORDER BY score DESC, "row" LIMIT 15""",
    "boundary_sample": EXACT + """, f AS (SELECT "row", score, ("row" * 7919) % 10007 AS o FROM s WHERE "row" NOT IN (0, 1, 2)), near AS (SELECT * FROM f WHERE abs(score - 0.1) <= 0.02 ORDER BY o, "row" LIMIT 6),
rest AS (SELECT *, ntile(6) OVER (ORDER BY score, "row") AS g FROM f WHERE "row" NOT IN (SELECT "row" FROM near)), one AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY g ORDER BY o, "row") = 1)
SELECT "row", round(score, 6) AS score FROM near UNION ALL SELECT "row", round(score, 6) FROM one""",
    "latest_tag_versions": TAGS + " SELECT tag, version, round(threshold, 6) AS threshold, project FROM now",
    "list_tags_page": TAGS + " SELECT tag, version, project FROM (SELECT * FROM now WHERE tag LIKE '%u1%' ORDER BY created_at DESC, tag LIMIT 10 OFFSET 10)",
    "marks_latest": """SELECT user_id, CAST(props ->> '$.k' AS BIGINT) AS chunk, CASE WHEN event_type = 'click' THEN 'up' ELSE 'down' END AS mark FROM events WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, CAST(props ->> '$.k' AS BIGINT) ORDER BY ts DESC, event_id DESC) = 1""",
    "export_reclaim": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pending' ELSE 'running' END AS status FROM events WHERE event_type = 'purchase' AND event_id % 4 < 2 AND ts < (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 3 HOUR""",
    "feedback_totals": "SELECT count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down, count(DISTINCT user_id) AS users FROM events",
    "top_queries": "SELECT event_type || ' ' || (props ->> '$.k') AS query, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, query LIMIT 40",
    "visits_per_user": "SELECT user_id, count(*) AS visits, max(event_id) AS last_event FROM events WHERE event_type = 'view' GROUP BY 1",
    "cap_per_run": CLIPS + ' SELECT "row", run_uuid FROM clips QUALIFY row_number() OVER (PARTITION BY run_uuid ORDER BY "row") <= 20',
    "uniform_sample": CLIPS + ' SELECT "row" FROM clips ORDER BY ("row" * 7919) % 10007, "row" LIMIT 100',
    "seeded_sample": CLIPS + """, o AS (SELECT "row", run_uuid, vec, md5('7:' || "row") AS h FROM clips), t AS (SELECT * FROM o ORDER BY h, "row" LIMIT 200),
c AS (SELECT "row", h FROM t WHERE vec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(run_uuid, '') ORDER BY h, "row") <= 12) SELECT "row" FROM c ORDER BY h, "row" LIMIT 100""",
    "knn_cosine": CLIPS + ', q AS (SELECT vec AS q FROM clips WHERE "row" = 11), n AS (SELECT "row", round(list_dot_product(vec, q) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM clips, q WHERE "row" <> 11) SELECT * FROM n ORDER BY similarity DESC, "row" LIMIT 24',
    "minmax_box": POINTS + ' SELECT "row", round(x, 6) AS x, round(y, 6) AS y FROM pts',
    "lasso_polygon": POINTS + f', i AS (SELECT *, round((x - 0.05::DOUBLE) * (x - 0.05::DOUBLE) + (y - 0.05::DOUBLE) * (y - 0.05::DOUBLE), 9) AS d2 FROM pts WHERE ({_IN}) % 2 = 1) SELECT "row", round(d2, 6) AS d2 FROM i ORDER BY i.d2, "row" LIMIT 48',
    "density_buckets": POINTS + """, g AS (SELECT "row", CAST(least(15, floor((x + 1) / 2 * 16)) AS BIGINT) AS cx, CAST(least(15, floor((y + 1) / 2 * 16)) AS BIGINT) AS cy FROM pts),
n AS (SELECT "row", count(*) OVER (PARTITION BY cx, cy) AS cell_count FROM g), e AS (SELECT quantile_cont(cell_count, [0.125::DOUBLE, 0.25::DOUBLE, 0.375::DOUBLE, 0.5::DOUBLE, 0.625::DOUBLE, 0.75::DOUBLE, 0.875::DOUBLE]) AS e FROM n)
SELECT "row", cell_count, 'q' || (1 + len(list_filter(e, lambda x: x <= cell_count))) AS bucket FROM n, e""",
    "category_coloring": CLIPS + """, c AS (SELECT "row", coalesce(segment_id, '(none)') AS c FROM clips), t AS (SELECT c, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, c LIMIT 5) SELECT "row", coalesce(t.c, 'other') AS label FROM c LEFT JOIN t ON c.c = t.c""",
    "coverage_report": CLIPS + " SELECT count(segment_id) AS n, count(*) AS total, round(100.0::DOUBLE * count(segment_id) / count(*), 4) AS pct FROM clips",
    "vehicle_from_segment": "SELECT event_id, 'truck' || user_id AS vehicle FROM events",
    "slugify": "SELECT doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 40) AS slug FROM documents",
    "utc_format": CLIPS + """ SELECT "row", strftime(make_timestamp(chunk_start_unix * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM clips""",
}

_INTERVAL = ORACLES["intervals"].rpartition("\nSELECT")[0]
_ROCCHIO = ORACLES["rocchio_topk"].rpartition("\nSELECT")[0]
_NAME = "run_uuid || '#t' || chunk_start_unix"
_WANTED = f"""SELECT {_NAME} AS chunk_id FROM clips WHERE "row" % 7 = 0 UNION SELECT unnest(['no-run#t5', 'bad', 'run-1#tx'])"""
_LOG = """WITH log AS (SELECT event_id AS id, 'q ' || lower(event_type) AS query, 'u' || (user_id % 20) AS user_email, CAST(props ->> '$.k' AS INT) AS k FROM events),
x AS (SELECT id, query, user_email, 's' || unnest([k, k + 1]) AS segment_id FROM log)"""
_HELD = """WITH a AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id)),
g AS (SELECT score AS tau, sum(label) AS p, sum(1 - label) AS q FROM a WHERE doc_id % 5 <> 0 GROUP BY score),
w AS (SELECT tau, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER () AS ap FROM g WINDOW d AS (ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT tau, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / ap AS recall FROM w),
t AS (SELECT tau FROM c ORDER BY round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 12) DESC, tau DESC LIMIT 1),
ap AS (SELECT round(sum(s), 6) AS ap FROM (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY tau DESC), 0)) * precision AS s FROM c))"""


def measured(rows: str, tau: str) -> str:
    """captured, excluded, precision, recall, f of rows (score, label) at tau."""
    return f"""(SELECT tp AS captured, tn AS excluded, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM
(SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM
(SELECT count(*) FILTER (score >= {tau} AND label = 1) AS tp, count(*) FILTER (score >= {tau} AND label <> 1) AS fp, count(*) FILTER (score < {tau} AND label = 1) AS fn, count(*) FILTER (score < {tau} AND label <> 1) AS tn FROM {rows})))"""


ORACLES |= {
    "window_individual_topk": CLIPS + f""", q AS (SELECT {_UNIT('vec')} AS q FROM clips WHERE {_WINDOW}), m AS (SELECT "row", round(max(list_dot_product(vec, q)), 9) AS score FROM clips, q GROUP BY "row") SELECT "row", round(score, 6) AS score FROM m ORDER BY m.score DESC, "row" LIMIT 15""",
    "unresolved_chunk_ids": CLIPS + f" SELECT chunk_id FROM ({_WANTED}) WHERE chunk_id NOT IN (SELECT {_NAME} FROM clips)",
    "include_below_threshold": EXACT + """ SELECT row_number() OVER (ORDER BY s.score DESC, "row") AS rank, "row", round(score, 6) AS score, CAST(s.score AS FLOAT) >= CAST(0.1 AS FLOAT) AS above, round((s.score - min(s.score) OVER ()) / (greatest(max(s.score) OVER (), min(s.score) OVER () + 1e-6) - min(s.score) OVER ()), 6) AS confidence FROM s""",
    "export_build": EXACT + f""", f AS (SELECT * FROM s WHERE created_at_unix_s >= {1704067200 + 3 * 86400} AND CAST(score AS FLOAT) >= CAST(0.02 AS FLOAT)), b AS (SELECT * FROM f QUALIFY segment_id IS NULL OR segment_id = '' OR row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, "row") = 1)
SELECT row_number() OVER (ORDER BY b.score DESC, "row") AS rank, "row", segment_id, round(score, 6) AS score, round(greatest(0.0, least(1.0, (b.score - 0.02::DOUBLE) / (greatest(max(b.score) OVER (), 0.02::DOUBLE + 1e-6) - 0.02::DOUBLE))), 6) AS confidence FROM b""",
    "interval_rows": _INTERVAL + f""", i AS (SELECT run_uuid, arg_min(up, m) AS a, arg_max(down, m) AS b, max(cell) AS peak, avg(cell) AS mean, count(*) AS num_cells, arg_max(peak_row, {{'a': cell, 'b': -m}}) AS peak_row FROM h GROUP BY run_uuid, island)
SELECT i.run_uuid, round(peak, 6) AS peak, round(mean, 6) AS mean, round(b - a, 3) AS seconds, CAST(round(a * 1000000000) AS BIGINT) AS start_ns, CAST(round(b * 1000000000) AS BIGINT) AS end_ns, num_cells, coalesce(clips.run_uuid || '#t' || chunk_start_unix, '') AS peak_chunk_id, coalesce(segment_id, '') AS segment_id FROM i LEFT JOIN clips ON clips."row" = peak_row""",
    "score_page": EXACT + ', r AS (SELECT row_number() OVER (ORDER BY score DESC, "row") AS rank, score FROM s) SELECT (min(rank) - 1) // 20 + 1 AS page FROM r WHERE score <= 0.05',
    "hist_fraction_above": ORACLES["score_histogram"].replace("SELECT i.bin, coalesce(n, 0) AS n FROM", ", h AS (SELECT i.bin, coalesce(n, 0) AS n FROM").replace(" , h AS", ", h AS") + """), e AS (SELECT *, (hi - lo) / 50 AS w FROM h, r)
SELECT round(sum(n * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (lo + bin * w + w - 0.1::DOUBLE) / w))) / sum(n), 6) AS fraction FROM e""",
    "threshold_of_k": EXACT + ", t AS (SELECT min(score) AS t FROM (SELECT score FROM s ORDER BY score DESC LIMIT 40)) SELECT round(any_value(t), 4) AS tau, count(*) AS selected FROM s, t WHERE CAST(score AS FLOAT) >= CAST(t AS FLOAT)",
    "separation_note": screened("0") + """, q1 AS (SELECT vec AS qv FROM clips WHERE "row" = 0), x AS (SELECT round(list_dot_product(vec, qv), 9) AS score FROM clips, q1), a AS (SELECT max(score) AS hi, min(score) AS lo FROM x) SELECT round(hi, 6) AS top, round(lo, 6) AS low, round(hi - lo, 6) AS spread, round((hi - lo) / eps, 6) AS times_eps FROM a, e""",
    "sweep_counts": "WITH l AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id)) SELECT * FROM " + measured("l", "2000"),
    "fit_held_out": _HELD + " SELECT tau, true AS met, ap.ap, m.* FROM t, ap, " + measured("(SELECT a.score, a.label, t.tau AS u FROM a, t WHERE doc_id % 5 = 0)", "u") + " m",
    "rocchio_vector": _ROCCHIO + " SELECT CAST(generate_subscripts(q, 1) - 1 AS INT) AS d, round(unnest(q), 6) AS x FROM u2",
    "stale_thresholds": TAGS.split(",\nnow AS")[0] + ", m AS (SELECT *, max(version) OVER (PARTITION BY tag) AS top FROM v) SELECT tag, project, round(threshold, 6) AS threshold, version, version < top AS stale FROM m QUALIFY row_number() OVER (PARTITION BY tag, project ORDER BY version DESC) = 1",
    "segment_set_usage": "SELECT props ->> '$.k' AS uuid, max('set ' || user_id) AS name, count(*) AS uses, max(ts) AS last, CAST(sum(event_id) AS BIGINT) AS n_rows FROM events WHERE event_type = 'view' GROUP BY 1",
    "dedupe_tags": "SELECT event_type || '_' || (user_id % 10) AS tag, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY event_id % 3 = 0 DESC, ts DESC, event_id DESC) = 1",
    "segment_set": EXACT + " SELECT DISTINCT segment_id FROM s WHERE score >= 0.05 AND segment_id <> ''",
    "list_segment_sets": "SELECT 'Set ' || event_type || ' ' || user_id AS name, event_id % 4 AS version, CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_id % 7 <> 0 AND event_id % 4 <> 0 AND event_type LIKE '%click%' AND ('Set ' || event_type || ' ' || user_id) LIKE '%11%'",
    "internal_id_lookup": CLIPS + ' SELECT "row", CASE WHEN "row" % 3 = 0 THEN "row" * 7 + 1000 END AS internal_id FROM clips',
    "zipped_internal_ids": CLIPS + ", i AS (SELECT DISTINCT segment_id FROM clips WHERE segment_id <> '') SELECT segment_id, (row_number() OVER (ORDER BY segment_id) - 1) * 3 + 7 AS internal_id FROM i",
    "null_fraction": CLIPS + " SELECT round(avg(CAST(segment_id IS NULL AS INT)), 6) AS fraction FROM clips",
    "corpus_health": CLIPS + """ SELECT count(*) AS rows, count(vec) AS embedded, min(chunk_start_unix) AS first, max(chunk_start_unix) AS last, count(DISTINCT vehicle) AS vehicles, bool_or(segment_id <> '') AS has_segments FROM clips""",
    "take_rows": CLIPS + ', w AS (SELECT CAST(generate_subscripts(r, 1) - 1 AS INT) AS place, unnest(r) AS n FROM (SELECT [30, 2, 11, 2, 10000000] AS r)) SELECT "row", run_uuid, place FROM clips JOIN w ON "row" = n',
    "rescored_rows": EXACT + f""" SELECT "row", {_NAME} AS chunk_id, round(score, 6) AS score FROM s WHERE "row" % 10 = 3""",
    "chunk_id_parse": CLIPS + """ SELECT "row", CASE WHEN "row" % 9 = 0 THEN '' ELSE run_uuid END AS run, CASE WHEN "row" % 9 <> 0 THEN chunk_start_unix END AS start_s FROM clips""",
    "address_parts": """WITH a AS (SELECT page_id, 'bucket-' || (page_id % 4) AS bucket, 'a/b c/' || page_id || ' x.parquet' AS path, CASE WHEN page_id % 3 = 0 THEN 's3a://' ELSE 's3://' END AS scheme FROM pages)
SELECT page_id, bucket, path, left(page_id || '_x.parquet', 40) || '-' || left(sha256(scheme || bucket || '/' || path), 16) AS cache_key FROM a""",
    "score_classes": EXACT + " SELECT CASE WHEN score > 0.32 THEN 'high' WHEN score > 0.24 THEN 'good' WHEN score > 0.16 THEN 'fair' ELSE 'low' END AS class, count(*) AS n FROM s GROUP BY 1",
    "real_projection": SCALE + """, u AS (SELECT * FROM clips ORDER BY ("row" * 7919) % 10007, "row" LIMIT 64),
x AS (SELECT max(list_max(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - greatest(CAST(-127 AS DOUBLE), least(CAST(127 AS DOUBLE), round_even(vec[i] * CAST(127 AS DOUBLE) / scale[i], 0))) * scale[i] / 127)))) AS off, max(list_max(scale)) / 127 AS step FROM u, sc)
SELECT off >= 0.001 * step AS usable FROM x""",
    "stream_upsert_clips": CLIPS + f""" SELECT {_NAME} AS chunk_id, CASE WHEN "row" % 4 = 0 THEN "row" + 1000000 ELSE "row" END AS "row" FROM clips""",
}

_REFINED = _ROCCHIO.replace('"row" IN (0, 5, 9)', '"row" % 40 = 0').replace('"row" IN (2, 4)', '"row" % 40 = 20')
ORACLES |= {
    "refine_feedback": _REFINED + """, s AS (SELECT "row", round(list_dot_product(vec, q), 9) AS score FROM clips, u2), l AS (SELECT score, CAST("row" % 40 = 0 AS INT) AS label FROM s WHERE "row" % 20 = 0),
g AS (SELECT score AS tau, sum(label) AS p, sum(1 - label) AS q FROM l GROUP BY score), w AS (SELECT tau, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER () AS ap FROM g WINDOW d AS (ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT tau, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / ap AS r FROM w), best AS (SELECT round(tau, 4) AS tau FROM c ORDER BY round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 12) DESC, c.tau DESC LIMIT 1)
SELECT any_value(tau) AS tau, true AS fitted, count(*) FILTER (score >= tau) AS selected, (SELECT count(*) FROM l) AS marked, CAST(1 AS BIGINT) AS unresolved FROM s, best""",
    "calibrate_filtered": STATS + ", f AS (SELECT count(*) FILTER (score >= 0.05) AS selected, count(*) AS candidates FROM s WHERE vehicle IN ('v0', 'v2')) SELECT st2.*, f.*, CAST(0.05 AS DOUBLE) AS tau FROM st2, f",
    "tag_record": TAGS + " SELECT tag, string_agg(version, ',' ORDER BY version DESC) AS versions, count(*) AS n FROM v GROUP BY tag",
    "export_backfill": """WITH log AS (SELECT event_id AS id, CASE WHEN event_id % 6 <> 0 THEN 'u' || user_id END AS tag, event_id % 4 <> 0 AS has_vector, CAST(event_id % 10 - 2 AS DOUBLE) / 10 AS threshold, CASE WHEN event_id % 3 = 0 THEN 'x/' || event_id ELSE '' END AS uri FROM events)
SELECT tag, round(CASE WHEN threshold > 0 THEN threshold END, 6) AS threshold, uri, CASE WHEN uri <> '' THEN 'ready' END AS status FROM log WHERE tag IS NOT NULL AND has_vector AND tag NOT IN (SELECT tag FROM log WHERE id % 500 = 0 AND tag IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY id) = 1""",
}

_URI = "'clips/dt=' || strftime(make_timestamp(t * 1000000), '%Y-%m-%d') || '/' || run_uuid || '_t' || t || '.mp4'"
_TAU = screened("0").replace("FROM i8, q GROUP BY", "FROM i8, q WHERE vehicle IN ('v0', 'v2') GROUP BY")
ORACLES |= {
    "bitmap_members": CLIPS + """ SELECT "row", coalesce(segment_id <> '', false) AS member FROM clips""",
    "export_marks": _LOG + """, top AS (SELECT max(id) // 5 AS top FROM log)
SELECT id, query, user_email, segment_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y, top WHERE y.id <= top AND y.query = x.query AND y.user_email = x.user_email AND y.segment_id = x.segment_id) QUALIFY row_number() OVER (PARTITION BY query, user_email, segment_id ORDER BY id) = 1""",
    "newest_exports": _LOG + " SELECT id, query, CAST(2 AS INT) AS n_segments FROM log ORDER BY id DESC LIMIT 50",
    "stored_screen_topk": screened("0") + ' SELECT "row", run_uuid, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, "row" LIMIT 25',
    "candidate_counts": _TAU + " SELECT 'k' AS mode, count(*) AS n FROM scored UNION ALL SELECT 'tau', count(*) FILTER (score >= 0.1 - eps) FROM scored, e",
    "cut_selection": screened("0") + """, a AS (SELECT "row", score, count(*) OVER () > 30 AS truncated FROM scored WHERE score >= 0.05) SELECT "row", round(score, 6) AS score, truncated FROM a ORDER BY a.score DESC, "row" LIMIT 30""",
    "refine_falls_back": screened("0") + ' SELECT "row", round(score, 6) AS score FROM scored ORDER BY scored.score DESC, "row" LIMIT 20',
    "alignment_check": CLIPS + " SELECT least(32, count(*)) AS checked, CAST(1 AS BIGINT) AS mismatches FROM clips",
    "tags_by_creator": TAGS.replace("event_type AS project, ts AS created_at", "event_type AS project, ts AS created_at, 'c' || (event_id % 7) AS created_by, 'About ' || event_type AS description") + " SELECT tag, version, created_by, description FROM now WHERE (lower(tag) LIKE '%click%' OR lower(description) LIKE '%click%') AND created_by = 'c3' ORDER BY created_at DESC, tag LIMIT 50",
    "tag_exports": TAGS + """, x AS (SELECT 'u' || user_id AS tag, string_agg(event_id, ',' ORDER BY event_id DESC) AS exports FROM events WHERE event_type = 'purchase' GROUP BY user_id),
n AS (SELECT tag, string_agg(version, ',' ORDER BY version DESC) AS versions FROM v GROUP BY tag) SELECT n.tag, versions, exports FROM n LEFT JOIN x ON n.tag = x.tag""",
    "version_marks": """WITH g AS (SELECT 'u' || user_id AS tag, event_id % 3 AS version, props ->> '$.k' AS chunk, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS mark, ts, event_id, count(*) OVER () AS processed FROM events)
SELECT tag, version, chunk, mark, processed FROM g QUALIFY row_number() OVER (PARTITION BY tag, version, chunk ORDER BY ts DESC, event_id DESC) = 1""",
    "refresh_decisions": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'skip: loading' WHEN event_id % 11 = 0 THEN 'skip: none resident' WHEN event_id % 4 <> 0 AND event_id % 6 <> 0 AND event_id % 7 = event_id % 3 THEN 'skip: unchanged' ELSE 'reload' END AS decision FROM events""",
    "project_lists": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'view' WHEN event_type IN ('view', 'purchase') THEN event_type || ',click' ELSE 'click' END AS projects FROM events""",
    "since_corpus_version": CLIPS + ' SELECT "row", created_at_unix_s FROM clips WHERE created_at_unix_s >= 1704067200 + 3 * 86400',
    "segment_set_rows": CLIPS + """ SELECT "row", segment_id FROM clips WHERE segment_id IN (SELECT segment_id FROM clips WHERE vehicle = 'v1' AND segment_id <> '')""",
    "vector_text": CLIPS + """ SELECT "row", '[' || array_to_string(list_transform(vec, lambda x: CAST(round(x, 3) + 0.0::DOUBLE AS VARCHAR)), ',') || ']' AS json FROM clips""",
    "comma_segments": "SELECT event_id, unnest([event_type, 's ' || user_id, 'x y']) AS segment FROM events",
    "comma_members": "SELECT event_id FROM events WHERE user_id = 1 OR event_type = 'view'",
    "checkpoint_names": "SELECT event_id, 'step_' || event_id AS checkpoint FROM events",
    "dictionary_decode": CLIPS + """ SELECT "row", CASE WHEN segment_id IS NOT NULL THEN dense_rank() OVER (ORDER BY segment_id NULLS LAST) - 1 END AS code, segment_id AS value FROM clips""",
    "first_occurrences": "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type IS NOT NULL GROUP BY user_id",
    "point_detail": POINTS + f""" SELECT "row", run_uuid || '#t' || t AS chunk_id, run_uuid, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS dt, t AS chunk_start_unix, {_URI} AS source_media_uri, round(x, 6) AS x, round(y, 6) AS y FROM pts JOIN (SELECT "row", run_uuid, chunk_start_unix AS t FROM clips) USING ("row") WHERE "row" = 11""",
    "interval_export": f"""SELECT peak AS peak_score, mean AS mean_score, run_uuid, start_ns AS start_timestamp_ns, end_ns AS end_timestamp_ns, seconds AS duration_s, num_cells AS num_chunks, segment_id, peak_chunk_id AS chunk_id, {_URI} AS source_media_uri, 'tag_a' AS tag
FROM (SELECT *, CAST(regexp_extract(peak_chunk_id, '#t([0-9]+)$', 1) AS BIGINT) AS t FROM ({ORACLES["interval_rows"]}))""",
    "histogram_summary": EXACT + " SELECT count(*) AS total, round(min(score), 4) AS min, round(max(score), 4) AS max, round(avg(score), 4) AS mean, count(*) FILTER (score >= 0.1) AS above_tau FROM s",
    "unique_users": "SELECT count(*) AS visits, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'view'",
    "curve_points": LABELLED + """, o AS (SELECT *, row_number() OVER (ORDER BY tau DESC) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT round(tau, 6) AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall FROM o WHERE n <= 50 OR i IN (SELECT CAST(round_even(CAST(k AS DOUBLE) * (n - 1) / 49, 0) AS BIGINT) FROM (SELECT unnest(range(50)) AS k), (SELECT count(*) AS n FROM c))""",
    "topped_up_sample": EXACT + """, f AS (SELECT "row", score, md5('0:' || "row") AS o FROM s WHERE "row" NOT IN (0, 1, 2)), near AS (SELECT * FROM f WHERE abs(score - 0.1) <= 0.00001 ORDER BY o, "row" LIMIT 6),
left_ AS (SELECT * FROM f WHERE "row" NOT IN (SELECT "row" FROM near)), m AS (SELECT 12 - count(*) AS m FROM near), p AS (SELECT l.*, row_number() OVER (ORDER BY score DESC, "row") - 1 AS i, count(*) OVER () AS n, m FROM left_ l, m),
g AS (SELECT *, CASE WHEN i < (n % m) * (n // m + 1) THEN i // (n // m + 1) ELSE (i - n % m) // (n // m) END AS g FROM p), one AS (SELECT "row", score FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY o, "row") = 1)
SELECT "row", round(score, 6) AS score FROM (SELECT "row", score FROM near UNION ALL SELECT * FROM one)""",
    "packed_points": CLIPS + " SELECT count(vec) AS n, 8 * count(vec) AS xy_bytes, count(vec) AS code_bytes FROM clips",
    "written_topk": screened("0") + ', q0 AS (SELECT vec AS qv FROM clips WHERE "row" = 0), cut AS (SELECT min(score) AS cut FROM (SELECT score FROM scored ORDER BY score DESC LIMIT 50)) SELECT "row", run_uuid, round(exact, 6) AS exact FROM (SELECT "row", run_uuid, round(list_dot_product(vec, qv), 9) AS exact FROM scored, q0, cut, e WHERE score >= cut - 2 * eps) ORDER BY exact DESC, "row" LIMIT 50',
    "written_tau": screened("0") + """, q0 AS (SELECT vec AS qv FROM clips WHERE "row" = 0) SELECT scored."row", segment_id, round(score, 6) AS score, CASE WHEN score >= 0.15 + eps THEN 'above' ELSE 'band' END AS class FROM scored JOIN (SELECT "row", segment_id FROM clips) n ON scored."row" = n."row", e, q0 WHERE score >= 0.15 + eps OR (score >= 0.15 - eps AND round(list_dot_product(vec, qv), 9) >= 0.15)""",
    "written_large_k": EXACT + ' SELECT "row", round(score, 6) AS exact FROM (SELECT * FROM s ORDER BY score DESC, "row" LIMIT 300)',
    "large_topk": 'SELECT l_orderkey * 10 + l_linenumber AS "row", l_quantity FROM lineitem ORDER BY l_quantity DESC, "row" LIMIT 300',
    "exact_quantiles": "SELECT round(p[1], 4) AS p0, round(p[2], 4) AS p25, round(p[3], 4) AS p50, round(p[4], 4) AS p999, round(p[5], 4) AS p100 FROM (SELECT quantile_cont(l_extendedprice, [0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.999::DOUBLE, 1.0::DOUBLE]) AS p FROM lineitem)",
    "event_intervals": "WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run_uuid, event_id AS \"row\", CAST(floor(epoch(ts)) AS BIGINT) AS chunk_start_unix, round(value / 97, 9) AS score FROM events)" + _CELLS + _islands(0.3),
    "stream_hit_runs": EXACT + """, h AS (SELECT run_uuid, chunk_start_unix AS t, score, CASE WHEN chunk_start_unix - lag(chunk_start_unix) OVER (PARTITION BY run_uuid ORDER BY chunk_start_unix) <= 5 THEN 0 ELSE 1 END AS b FROM s WHERE score >= 0.05),
g AS (SELECT *, sum(b) OVER (PARTITION BY run_uuid ORDER BY t) AS g FROM h) SELECT run_uuid, min(t) AS start, max(t) AS last, count(*) AS n, round(max(score), 6) AS peak FROM g GROUP BY run_uuid, g""",
    "claimed_exports": "SELECT 'u' || (user_id % 10) AS export_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2",
    "window_overlaps": CLIPS + """, w AS (SELECT event_id AS window_id, 'run-' || (event_id % 10) AS run_uuid, 1704067200 + 86400 * (event_id % 10) + (event_id * 7) % 600 AS b, 20 + (event_id % 5) * 30 AS len FROM events)
SELECT window_id, count(*) AS n, min("row") AS first, max("row") AS last FROM w JOIN clips ON clips.run_uuid = w.run_uuid AND chunk_start_unix < b + len AND coalesce(chunk_end_unix, chunk_start_unix + 8) > b GROUP BY window_id""",
    "npy_matrices": CLIPS + ' SELECT "row", run_uuid, round(list_sum(list_transform(vec, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS total FROM clips WHERE vec IS NOT NULL',
}
ORACLES |= {name: ORACLES["event_intervals"] for name in ("interval_function", "interval_arrow")}
ORACLES["neighbour_graph"] = CLIPS + """, v AS (SELECT "row", CAST(vec AS DOUBLE[]) AS v FROM clips WHERE vec IS NOT NULL),
drawn AS (SELECT "row", vec FROM clips ORDER BY md5('0:' || "row"), "row" LIMIT 4000), sample AS (SELECT "row" AS other, CAST(vec AS DOUBLE[]) AS o FROM drawn WHERE vec IS NOT NULL ORDER BY md5('0:' || "row"), "row" LIMIT 2000),
g AS (SELECT "row", list_inner_product(v, o) / (greatest(sqrt(list_inner_product(v, v)), 1e-12) * greatest(sqrt(list_inner_product(o, o)), 1e-12)) AS similarity FROM v JOIN sample ON v."row" <> other)
SELECT "row", CAST(row_number() OVER w - 1 AS INT) AS place, round(similarity, 4) AS similarity FROM g WINDOW w AS (PARTITION BY "row" ORDER BY g.similarity DESC) QUALIFY row_number() OVER w <= 10"""
_CLIP_ROW = f"""round(score, 6) AS score, segment_id, run_uuid || '#t' || t AS chunk_id, run_uuid, t * 1000000000 AS start_timestamp_ns, coalesce(chunk_end_unix * 1000000000, -1) AS end_timestamp_ns, {_URI} AS source_media_uri, vehicle, 'tag_a' AS tag, "row" AS corpus_row"""
_MADE = "'road' AS project, CAST(2 AS INT) AS tag_version, '7' AS corpus_version"
ORACLES |= {
    "build_clips": EXACT + f""", f AS (SELECT *, chunk_start_unix AS t FROM s WHERE vehicle IN ('v0', 'v2') AND created_at_unix_s >= {1704067200 + 3 * 86400} AND score >= 0.02), b AS (SELECT * FROM f QUALIFY segment_id IS NULL OR segment_id = '' OR row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, "row") = 1),
r AS (SELECT row_number() OVER (ORDER BY score DESC, "row") AS rank, round(greatest(0.0, least(1.0, (score - 0.02::DOUBLE) / (greatest(max(score) OVER (), 0.02::DOUBLE + 1e-6) - 0.02::DOUBLE))), 6) AS confidence, * FROM b),
n AS (SELECT segment_id AS sid, count(*) AS clips_in_segment FROM s WHERE segment_id IS NOT NULL GROUP BY 1)
SELECT rank, {_CLIP_ROW}, confidence, {_MADE}, clips_in_segment FROM r LEFT JOIN n ON segment_id = sid""",
    "build_all": screened("0") + f""", q0 AS (SELECT vec AS qv FROM clips WHERE "row" = 0), cut AS (SELECT score AS cut FROM scored ORDER BY score DESC LIMIT 1 OFFSET 39), x AS (SELECT *, chunk_start_unix AS t, round(list_dot_product(vec, qv), 9) AS score FROM clips, q0, cut)
SELECT row_number() OVER (ORDER BY x.score DESC, "row") AS rank, {_CLIP_ROW.replace("round(score", "round(x.score")}, x.score >= cut AS above_threshold, {_MADE} FROM x""",
    "build_best": EXACT + """, b AS (SELECT * FROM s ORDER BY score DESC, "row" LIMIT 60), e AS (SELECT min(score) AS lo, greatest(max(score), min(score) + 1e-6) AS hi FROM b)
SELECT row_number() OVER (ORDER BY b.score DESC, "row") AS rank, round(b.score, 6) AS score, "row" AS corpus_row, round((b.score - lo) / (hi - lo), 6) AS confidence FROM b, e""",
    "build_intervals": f"SELECT *, {_MADE} FROM ({ORACLES['interval_export']})",
    "build_figures": EXACT + """, f AS (SELECT * FROM s WHERE vehicle = 'v1' AND score >= 0.05), n AS (SELECT count(*) AS n, count(DISTINCT segment_id) FILTER (segment_id <> '') AS g FROM f)
SELECT n AS num_rows, n AS read_rows, 0.05::DOUBLE AS cutoff, CAST(0 AS BIGINT) AS rows_unscorable, g AS set_segments, g AS num_segments, 'v1' AS vehicles, false AS since FROM n""",
    "probed_selection": EXACT + ' SELECT "row", round(score, 6) AS exact, true AS refined FROM (SELECT * FROM s ORDER BY score DESC, "row" LIMIT 30)',
    "refine_sample": _REFINED + """, s AS (SELECT "row", run_uuid || '#t' || chunk_start_unix AS chunk_id, round(list_dot_product(vec, q), 9) AS score FROM clips, u2) SELECT chunk_id, round(score, 4) AS score FROM (SELECT * FROM s ORDER BY score DESC, "row" LIMIT 3)""",
    "downsampled_clips": CLIPS + """ SELECT "row", 'scenario' AS by FROM clips WHERE segment_id IN (SELECT segment_id FROM clips WHERE vehicle = 'v1' AND segment_id <> '') UNION ALL SELECT "row", 'run' FROM clips WHERE run_uuid IN (SELECT run_uuid FROM clips WHERE vehicle = 'v2')""",
    "clip_bounds": CLIPS + ' SELECT "row" AS corpus_row, chunk_start_unix AS "start", chunk_end_unix AS "end", chunk_start_unix AS named FROM clips',
    "living_marks": """WITH m AS (SELECT 'u' || user_id AS tag, event_id AS seq, json_extract_string(props, '$.k') AS chunk_id, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS mark FROM events WHERE event_type IN ('click', 'error')),
g AS (SELECT 'u' || user_id AS tag, max(event_id) AS born FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT m.tag, CAST(1 AS BIGINT) AS version, chunk_id, seq, mark FROM m LEFT JOIN g ON m.tag = g.tag WHERE seq > coalesce(born, -1) QUALIFY row_number() OVER (PARTITION BY m.tag, chunk_id ORDER BY seq DESC) = 1""",
}
