"""Synthetic-data planning and quality control, drift, gate, registry and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.lineage import cut
from sightline.operators import average_precision as ap
from sightline.operators import decisions, drift, match, synthesis
from sightline.plans import resampling
from sightline.plans.evaluation import SQL_AP, WEIGHTS, _ap, _ap_of_models, _matches_of_models, sql_match, sql_slices
from sightline.plans.oracle import IOU, views
from sightline.plans.resampling import TARGETS
from sightline.schema import CLASSES, CONDITIONS, FALLBACK_CONDITIONS, PROMPT_END, PROMPT_RECIPES, PROMPT_SCENES, PROMPT_START, PROMPT_UNWANTED, PROMPT_UNWANTED_IN, THRESHOLDS
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}
COUNT, OVERSAMPLE = 101, 2.0
ALLOC = [(0, "night", 30.0, [0, 2, 3]), (1, "rain", 10.0, [1, 4]), (2, "dusk", 7.5, [2])]


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def _sql_pick(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {x!r}" for k, x in values.items()) + " END"


def _targets(v: Views):
    rows = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("condition"), F.lit(e).alias("excess_errors"), F.array(*map(F.lit, k)).alias("classes")) for t, c, e, k in ALLOC]
    return v.spark.range(1).select(F.inline(F.array(*rows)))


SQL_TARGETS = "targets(target, condition, excess_errors, classes) AS (VALUES " + ", ".join(f"({t}, '{c}', {e!r}::DOUBLE, {k})" for t, c, e, k in ALLOC) + ")"
SQL_ALLOC = f"""{SQL_TARGETS}, raw AS (SELECT *, greatest(excess_errors, 1e-6) / sum(greatest(excess_errors, 1e-6)) OVER () * {COUNT} AS raw FROM targets),
alloc AS (SELECT *, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, target) <= {COUNT} - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM raw)"""
SQL_RANK = views("gt") + f""", {SQL_ALLOC},
scored AS (SELECT target, image_id, count(*) FILTER (WHERE list_contains(classes, cls)) + CAST(('0x' || substr(sha256('1234:' || target || ':' || image_id), 1, 8)) AS BIGINT) / 4294967296.0e0 AS score FROM gt, targets GROUP BY target, image_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, image_id) - 1 AS rank FROM scored) WHERE rank < 50)"""


def _qc(v: Views):
    part = lambda k: (F.col("doc_id") * k % 10007) / 10007.0
    rows = v.table("documents").select("doc_id", (F.col("doc_id") % 3).alias("target"), F.floor(F.col("doc_id") / 3).alias("k"), (part(7919) * 0.5).alias("clip_score"), part(6101).alias("p_target"), part(4337).alias("box_pass"))
    return rows.withColumn("reasons", synthesis.reasons()).withColumn("accepted", F.size("reasons") == 0)


SQL_QC = """qc AS (SELECT doc_id, doc_id % 3 AS target, doc_id // 3 AS k, (doc_id * 7919 % 10007) / 10007.0e0 * 0.5e0 AS clip_score, (doc_id * 6101 % 10007) / 10007.0e0 AS p_target, (doc_id * 4337 % 10007) / 10007.0e0 AS box_pass FROM documents),
judged AS (SELECT *, concat_ws(',', CASE WHEN clip_score < 0.22e0 THEN 'prompt' END, CASE WHEN p_target < 0.6e0 THEN 'condition' END, CASE WHEN box_pass < 0.5e0 THEN 'structure' END) AS reasons FROM qc)"""
SQL_TRIED = f"WITH {SQL_ALLOC}, {SQL_QC}, b AS (SELECT j.*, reasons = '' AS accepted, coalesce(sum(CASE WHEN reasons = '' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged j), tried AS (SELECT b.* FROM b JOIN alloc USING (target) WHERE before < quota)"


@plan("allocate", f"WITH {SQL_ALLOC} SELECT target, condition, quota FROM alloc WHERE quota > 0")
def allocate(v: Views):
    return synthesis.allocate(_targets(v), COUNT).select("target", "condition", "quota")


@plan("rank_sources", SQL_RANK + " SELECT target, image_id, rank FROM ranked")
def rank_sources(v: Views):
    return synthesis.rank_sources(v.gt(), _targets(v), 50).select("target", "image_id", F.col("rank").cast("long").alias("rank"))


@plan("candidate_plan", SQL_RANK + f""", k AS (SELECT target, unnest(range(0, CAST(ceil(quota * {OVERSAMPLE}e0) AS BIGINT))) AS k FROM alloc WHERE quota > 0)
SELECT k.target, k.k, image_id, CAST(1234 + 100003 * k.target + k.k AS BIGINT) AS seed FROM k JOIN ranked r ON r.target = k.target AND r.rank = k.k % 50""")
def candidate_plan(v: Views):
    found = synthesis.plan_candidates(synthesis.allocate(_targets(v), COUNT), synthesis.rank_sources(v.gt(), _targets(v), 50), OVERSAMPLE)
    return found.withColumn("k", F.col("k").cast("long"))


@plan("qc_rules", f"WITH {SQL_QC} SELECT doc_id, reasons, reasons = '' AS accepted FROM judged")
def qc_rules(v: Views):
    return _qc(v).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@plan("quota_accept", SQL_TRIED + " SELECT doc_id, target, accepted FROM tried")
def quota_accept(v: Views):
    return synthesis.accept_until_quota(_qc(v), synthesis.allocate(_targets(v), COUNT)).select("doc_id", "target", "accepted")


@plan("synthesis_summary", SQL_TRIED + " SELECT count(*) AS candidates, count(*) FILTER (WHERE accepted) AS accepted, round(avg(CASE WHEN accepted THEN 1.0e0 ELSE 0.0e0 END), 9) AS acceptance_rate, round(avg(clip_score) FILTER (WHERE accepted), 9) AS mean_clip_score, round(avg(p_target) FILTER (WHERE accepted), 9) AS mean_p_target, round(avg(box_pass) FILTER (WHERE accepted), 9) AS mean_box_pass, round(avg(p_target) FILTER (WHERE NOT accepted), 9) AS mean_p_target_rejected FROM tried")
def synthesis_summary(v: Views):
    s = synthesis.summary(synthesis.accept_until_quota(_qc(v), synthesis.allocate(_targets(v), COUNT)))
    return s.select("candidates", "accepted", *[F.round(c, 9).alias(c) for c in s.columns[2:]])


@plan("box_survival", views("gt", "det_baseline", "det_candidate") + f""", big AS (SELECT * FROM gt WHERE least(x2 - x1, y2 - y1) >= 24),
s AS (SELECT g.image_id, g.box_id, max({IOU}) AS iou FROM big g JOIN det_baseline d USING (image_id) GROUP BY 1, 2), t AS (SELECT g.image_id, g.box_id, max({IOU}) AS iou FROM big g JOIN det_candidate d USING (image_id) GROUP BY 1, 2)
SELECT g.image_id, round(coalesce(avg(CASE WHEN coalesce(t.iou, 0) >= 0.4e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE s.iou >= 0.5e0), 1.0e0), 9) AS survival, count(*) FILTER (WHERE s.iou >= 0.5e0) AS judged
FROM gt g LEFT JOIN s USING (image_id, box_id) LEFT JOIN t USING (image_id, box_id) GROUP BY g.image_id""")
def box_survival(v: Views):
    return synthesis.box_survival(v.gt(), v.det("baseline"), v.det("candidate")).withColumn("survival", F.round("survival", 9))


@plan("select_real", views("samples") + """, a AS (SELECT image_id FROM samples WHERE timeofday = 'night' ORDER BY image_id LIMIT 30), b AS (SELECT image_id FROM samples WHERE weather = 'rainy' AND image_id NOT IN (FROM a) ORDER BY image_id LIMIT 10),
r AS (SELECT image_id FROM samples WHERE image_id NOT IN (FROM a) AND image_id NOT IN (FROM b) ORDER BY image_id LIMIT 20)
SELECT image_id, 'night' AS why FROM a UNION ALL SELECT image_id, 'rain' FROM b UNION ALL SELECT image_id, 'top-up' FROM r""")
def select_real(v: Views):
    return synthesis.select_real(v.samples().withColumn("pos", F.col("image_id")), [{"condition": "night", "quota": 30}, {"condition": "rain", "quota": 10}], 60)


@plan("psi", """WITH r AS (SELECT o_totalprice / 500000 AS x FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), c AS (SELECT (o_totalprice / 500000) * (o_totalprice / 500000) AS x FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
q AS (SELECT list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM r), e AS (SELECT list_sort(e)[2:len(e) - 1] AS inner_e, len(e) AS n FROM q),
b AS (SELECT 0 AS cur, len(list_filter(inner_e, lambda y: y <= x)) AS bin FROM r, e UNION ALL SELECT 1, len(list_filter(inner_e, lambda y: y <= x)) FROM c, e),
k AS (SELECT i AS bin, count(*) FILTER (WHERE cur = 0) AS r, count(*) FILTER (WHERE cur = 1) AS c FROM (SELECT unnest(range(0, n - 1)) AS i FROM e) LEFT JOIN b ON b.bin = i GROUP BY i),
s AS (SELECT r / sum(r) OVER () + 1e-4 AS r, c / sum(c) OVER () + 1e-4 AS c FROM k) SELECT round(sum((c - r) * ln(c / r)), 9) AS psi FROM s""")
def psi(v: Views):
    price, early = F.col("o_totalprice") / 500000, F.col("o_orderdate") < "1998-01-01"
    orders = v.table("orders").select(price.alias("x"), early.alias("early"))
    return decisions.psi(orders.filter("early"), orders.filter("not early").select((F.col("x") * F.col("x")).alias("x")), "x").select(F.round("psi", 9).alias("psi"))


_D2 = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))"
_HASH = "CAST(('0x' || substr(sha256('0:' || vec_id), 1, 8)) AS BIGINT) / 4294967296.0e0"
SQL_MMD = f"""WITH k AS (SELECT greatest(ceil(max(n) / {drift.BLOCK}.0e0), 1) AS k FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id % 5 < 3)),
z AS (SELECT vec_id, embedding, vec_id % 5 >= 3 AS cur, floor({_HASH} * k) AS block FROM embeddings, k),
p AS (SELECT block, a.cur AS ca, b.cur AS cb, {_D2} AS d2 FROM z a JOIN z b USING (block) WHERE a.vec_id < b.vec_id),
g AS (SELECT 1 / greatest(median(m), 1e-12) AS gamma FROM (SELECT median(d2) AS m FROM p GROUP BY block)),
s AS (SELECT ca::INT AS i, cb::INT AS j, exp(-gamma * d2) AS v FROM p, g)
SELECT round(avg(v) FILTER (WHERE i + j = 0) + avg(v) FILTER (WHERE i + j = 2) - 2 * avg(v) FILTER (WHERE i + j = 1), 9) AS mmd2 FROM s"""
_DOT = "SELECT avg(pow(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) / 64 + 1, 3)) AS m"
SQL_KID = f"""WITH x AS (SELECT * FROM embeddings WHERE vec_id % 5 < 3), y AS (SELECT * FROM embeddings WHERE vec_id % 5 >= 3)
SELECT round(p.m + q.m - 2 * r.m, 9) AS kid
FROM ({_DOT} FROM x a, x b WHERE a.vec_id <> b.vec_id) p, ({_DOT} FROM y a, y b WHERE a.vec_id <> b.vec_id) q, ({_DOT} FROM x a, y b) r"""


def _windows(v: Views):
    """Reference and current vectors: three and two fifths of the whole table."""
    e = v.table("embeddings").select("vec_id", "embedding")
    return e.filter("vec_id % 5 < 3"), e.filter("vec_id % 5 >= 3")


@plan("mmd2_observed", SQL_MMD)
def mmd2_observed(v: Views):
    return drift.mmd2(*_windows(v)).select(F.round("mmd2", 9).alias("mmd2"))


def _sql_xor(x: str, shift: int) -> str:
    return f"xor({x}, {x} >> {shift}::UBIGINT)"


def _sql_round(x: str, shift: int, factor: int) -> str:
    return f"({_sql_xor(x, shift)} * {factor}::UBIGINT) & 4294967295::UBIGINT"


PERMUTATIONS = 500
SQL_MMD_TEST = SQL_MMD[: SQL_MMD.index("p AS (")] + f"""
p AS MATERIALIZED (SELECT block, a.vec_id AS va, b.vec_id AS vb, {_D2} AS d2 FROM z a JOIN z b USING (block) WHERE a.vec_id < b.vec_id),
g AS (SELECT 1 / greatest(median(m), 1e-12) AS gamma FROM (SELECT median(d2) AS m FROM p GROUP BY block)),
k2 AS MATERIALIZED (SELECT va, vb, exp(-gamma * d2) AS v FROM p, g),
n AS (SELECT block, count(*) FILTER (WHERE NOT cur) AS nx FROM z GROUP BY block),
m0 AS (SELECT r, block, vec_id, cur, xor(CAST(('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 8)) AS UBIGINT), CAST((r * {drift.REPLICATE_STEP}) % 4294967296 AS UBIGINT)) AS x0
    FROM z, range(0, {PERMUTATIONS + 1}) t(r)),
m1 AS (SELECT *, {_sql_round("x0", *drift.MIX[0])} AS x1 FROM m0), m2 AS (SELECT *, {_sql_round("x1", *drift.MIX[1])} AS x2 FROM m1),
lab AS MATERIALIZED (SELECT r, vec_id, CASE WHEN r = 0 THEN cur::INT
    ELSE (row_number() OVER (PARTITION BY r, block ORDER BY {_sql_xor("x2", 16)}, vec_id) > nx)::INT END AS c
    FROM m2 JOIN n USING (block)),
s AS (SELECT r, a.c + b.c AS kind, avg(v) AS m FROM k2 JOIN lab a ON a.vec_id = va JOIN lab b USING (r) WHERE b.vec_id = vb GROUP BY r, a.c + b.c),
t AS (SELECT r, sum(CASE WHEN kind = 1 THEN -2 * m ELSE m END) AS v FROM s GROUP BY r),
o AS (SELECT v AS obs FROM t WHERE r = 0)
SELECT round(max(obs), 9) AS mmd2, round((1 + count(*) FILTER (WHERE r > 0 AND v >= obs)) / {PERMUTATIONS + 1}.0e0, 9) AS p_value,
    round(avg(v) FILTER (WHERE r > 0), 9) AS null_mean, round(quantile_cont(v, 0.95) FILTER (WHERE r > 0), 9) AS null_p95 FROM t, o"""


@plan("mmd_test", SQL_MMD_TEST)
def mmd_test(v: Views):
    out = drift.mmd_test(*_windows(v), PERMUTATIONS)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@plan("kid", SQL_KID)
def kid(v: Views):
    return drift.kid(*_windows(v), 64).select(F.round("kid", 9).alias("kid"))


def _sql_maps(model: str) -> str:
    return f"({views('samples', 'gt', f'det_{model}', recursive=True)}, {sql_slices()}, {sql_match(model, THRESHOLDS)}, {WEIGHTS}, {SQL_AP} SELECT scope AS slice, avg(ap) AS map FROM ap GROUP BY scope)"


SLOS = {"night": 0.5, "overall": 0.4, "dawn": 0.6}


@plan("slo_violations", f"SELECT slice, round(map, 9) AS map, threshold FROM {_sql_maps('baseline')} JOIN (VALUES " + ", ".join(f"('{k}', {x!r}::DOUBLE)" for k, x in SLOS.items()) + ") t(slice, threshold) USING (slice) WHERE map < threshold")
def slo_violations(v: Views):
    return decisions.slo_violations(ap.mean_ap(_ap(v, "baseline", THRESHOLDS)), SLOS).withColumn("map", F.round("map", 9))


@plan("fallback_targets", f"""SELECT {_sql_pick("slice", FALLBACK_CONDITIONS)} AS condition, '{CLASSES.index("car")},{CLASSES.index("pedestrian")}' AS classes, 1.0e0 AS excess_errors,
    'SLO slice ' || slice || ' (fallback)' AS name FROM ({SQL["slo_violations"]}) WHERE slice IN {tuple(FALLBACK_CONDITIONS)}""")
def fallback_targets(v: Views):
    none = v.spark.createDataFrame([], "cluster int, condition string, classes array<int>, excess_errors double, name string")
    found = synthesis.targets_or_fallback(none, decisions.slo_violations(ap.mean_ap(_ap(v, "baseline", THRESHOLDS)), SLOS))
    return found.select("condition", F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").alias("classes"), "excess_errors", "name")


@plan("prompts", views("samples") + f""", r AS (SELECT image_id, scene, {CONDITIONS}[image_id % {len(CONDITIONS)} + 1] AS condition, CAST(('0x' || substr(sha256('1234:' || image_id), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM samples),
w AS (SELECT *, {_sql_pick("condition", PROMPT_RECIPES)} AS recipes FROM r)
SELECT image_id, condition, '{PROMPT_START} ' || coalesce({_sql_pick("scene", PROMPT_SCENES)}, 'city street') || ' ' || recipes[CAST(floor(u * len(recipes)) AS INTEGER) + 1] || ', {PROMPT_END}' AS prompt,
    '{PROMPT_UNWANTED}, ' || {_sql_pick("condition", PROMPT_UNWANTED_IN)} AS negative_prompt FROM w""")
def prompts(v: Views):
    condition = F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("image_id") % len(CONDITIONS) + 1).cast("int"))
    return synthesis.prompts(v.samples().withColumn("condition", condition), F.col("image_id")).select("image_id", "condition", "prompt", "negative_prompt")


def _gate(v: Views):
    counts = ap.slice_membership(v.samples()).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    weights = ap.slice_membership(v.dealt_samples())
    matches = _matches_of_models(v, weights, ("baseline", "candidate"), TARGETS)  # maps and bootstrap read them
    intervals = resampling.deltas(v, *(ap.by_mark(m, TARGETS) for m in matches.values())).select("slice", "ci_low")
    maps = cut(ap.mean_ap(_ap_of_models(v, weights, matches), "arm", "slice"))  # a row a model and slice; several checks read it
    before, after = (maps.filter(F.col("arm") == arm).select("slice", "map") for arm in ("baseline", "candidate"))
    deltas = after.join(before.withColumnRenamed("map", "before"), "slice").select("slice", (F.col("map") - F.col("before")).alias("delta"))
    deltas = cut(deltas.join(intervals, "slice", "left"))
    gated = after.join(counts, "slice").withColumn("gated", F.col("n") >= 25)
    return decisions.gate_checks(deltas, before, gated, TARGETS)


@plan("gate_checks")
def gate_checks(v: Views):
    return _gate(v).withColumn("value", F.round(F.coalesce("value", F.lit(-9.0)), 9))


@plan("gate_decision")
def gate_decision(v: Views):
    return decisions.decide(_gate(v))


@plan("registry_champion", "WITH h AS (SELECT event_id AS version, ts, CASE event_type WHEN 'purchase' THEN 'promoted' WHEN 'signup' THEN 'registered' WHEN 'error' THEN 'rejected' END AS event FROM events) SELECT (SELECT version FROM h WHERE event = 'promoted' ORDER BY ts DESC, version DESC LIMIT 1) AS champion, max(version) AS latest FROM h WHERE event IS NOT NULL")
def registry_champion(v: Views):
    names = F.create_map(*map(F.lit, ("purchase", "promoted", "signup", "registered", "error", "rejected")))
    history = v.table("events").select(F.col("event_id").alias("version"), "ts", F.try_element_at(names, "event_type").alias("event")).filter("event is not null")
    return decisions.champion(history)


@plan("latency_stats", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99, round(avg(value), 6) AS mean, round(1000.0e0 / avg(value), 6) AS throughput, count(*) AS runs FROM events GROUP BY event_type")
def latency_stats(v: Views):
    s = decisions.latency(v.table("events"), "event_type", "value")
    return s.select("event_type", *[F.round(c, 9).alias(c) for c in ("p50", "p90", "p99")], F.round("mean", 6).alias("mean"), F.round("throughput", 6).alias("throughput"), "runs")


@plan("monitor_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def monitor_windows(v: Views):
    from sightline.streaming.monitor import windowed

    return windowed(v.table("events")).select(F.col("window.start").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))
