"""Components, density clusters, the domain classifier, the drift report and subset distances over the embeddings table; synthesis that resumes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.lineage import shared_folder, stored
from sightline.operators import density, domain, drift, journal, reduction, synthesis
from sightline.plans.release import COUNT, SQL_TRIED, _qc, _targets, _windows
from sightline.sources.tables import Views

QUERIES, SQL = {}, {}
#: Components kept before clustering; the smallest cluster and the rows that make a core, as the reference sets them.
COMPONENTS, MIN_CLUSTER, MIN_SAMPLES = 10, 40, 10


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


@plan("pca")
def pca(v: Views) -> DataFrame:
    z = reduction.pca(v.table("embeddings"), COMPONENTS)
    return z.select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@plan("hdbscan_labels")
def hdbscan_labels(v: Views) -> DataFrame:
    return density.hdbscan(stored(reduction.pca(v.table("embeddings"), COMPONENTS)), MIN_CLUSTER, MIN_SAMPLES, column="z")


@plan("domain_auc")
def domain_auc(v: Views) -> DataFrame:
    return domain.domain_auc(*_windows(v)).select(F.round("domain_auc", 9).alias("domain_auc"))


@plan("drift_report")
def drift_report(v: Views) -> DataFrame:
    orders = v.table("orders").select((F.col("o_totalprice") / 500000).alias("bright"), (F.col("o_orderdate") < "1998-01-01").alias("early"))
    out = domain.drift_report(*_windows(v), (orders.filter("early"), orders.filter("not early")), "bright")
    return out.select(*[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in out.dtypes])


_ORDERS = ", ".join(f"({r}, {a}, {b})" for r, (a, b) in enumerate(drift.subset_orders(50)))
_MEAN = "(SELECT r, avg(pow(list_dot_product(a.e, b.e) / len(a.e) + 1, 3)) AS v FROM s a JOIN s b USING (r) WHERE a.cur = {0} AND b.cur = {1} AND (a.cur <> b.cur OR a.vec_id <> b.vec_id) GROUP BY r)"


@plan("kid_subsets", f"""WITH m AS (SELECT least(200, count(*) FILTER (WHERE vec_id % 5 < 3), count(*) FILTER (WHERE vec_id % 5 >= 3)) AS m FROM embeddings),
o(r, a, b) AS (VALUES {_ORDERS}),
u AS (SELECT r, vec_id, (vec_id % 5 >= 3)::INT AS cur, CAST(embedding AS DOUBLE[]) AS e,
    (CAST(('0x' || substr(sha256(vec_id::VARCHAR), 1, 8)) AS BIGINT) % {drift.PRIME} * a::BIGINT + b) % {drift.PRIME} AS u FROM embeddings, o),
s AS MATERIALIZED (SELECT u.* FROM u, m QUALIFY row_number() OVER (PARTITION BY r, cur ORDER BY u, vec_id) <= m),
k AS (SELECT x.v + y.v - 2 * z.v AS v FROM {_MEAN.format(0, 0)} x JOIN {_MEAN.format(1, 1)} y USING (r) JOIN {_MEAN.format(0, 1)} z USING (r))
SELECT round(avg(v), 9) AS kid, round(stddev_pop(v), 9) AS kid_std FROM k""")
def kid_subsets(v: Views) -> DataFrame:
    out = drift.kid_subsets(*_windows(v))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@plan("resumed_accept", SQL_TRIED + " SELECT doc_id, target, accepted FROM tried")
def resumed_accept(v: Views) -> DataFrame:
    """The candidates of quota_accept, judged in batches of a log, as two runs."""
    path = f"{shared_folder(v.spark)}/log_{uuid.uuid4().hex}"
    judged = _qc(v)
    candidates, judge = judged.select("doc_id", "target", "k"), lambda some: some.join(judged.drop("target", "k"), "doc_id")
    allocation = synthesis.allocate(_targets(v), COUNT)
    journal.synthesize(candidates, allocation, judge, path, 40, most=1)
    return journal.synthesize(candidates, allocation, judge, path, 200).select("doc_id", "target", "accepted")
