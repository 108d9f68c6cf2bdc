"""DuckDB text of the domain views, put together for each oracle as it needs them."""

from __future__ import annotations

from sightline.sources.tables import MODELS, SCENES, TIMES, WEATHER


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _det(model: str) -> str:
    if model == "noisy":
        return f"""{_det("baseline")},
det_noisy AS (SELECT * FROM det_baseline UNION ALL
    SELECT d.image_id, d.det_id + 500, d.cls, d.x1 + 1, d.y1, d.x2, d.y2, d.score * 0.9e0
    FROM det_baseline d JOIN li ON li.image_id = d.image_id AND li.box_id = d.det_id WHERE li.cents % 23 = 0)"""
    (day, night, dawn), (step, shift), times = MODELS[model]
    return f"""det_{model} AS (
    SELECT li.image_id, box_id AS det_id, CAST(CASE WHEN cents % 17 = 0 THEN (cls + 1) % 8 ELSE cls END AS INTEGER) AS cls,
        CAST(x + (cents % {step} - {shift}) AS DOUBLE) AS x1, CAST(y + (cents % 11 - 5) AS DOUBLE) AS y1,
        CAST(x + w + (cents % 7 - 3) AS DOUBLE) AS x2, CAST(y + h + (cents % 5 - 2) AS DOUBLE) AS y2,
        ((cents * {times}) % 10007) / 10007.0e0 AS score
    FROM li JOIN orders ON o_orderkey = li.image_id
    WHERE cents % 10 < CASE o_orderstatus WHEN 'F' THEN {day} WHEN 'O' THEN {night} ELSE {dawn} END
    UNION ALL
    SELECT o_orderkey, 1000, CAST(o_custkey % 8 AS INTEGER), CAST(o_custkey % 1000 AS DOUBLE), CAST((o_custkey * 13) % 500 AS DOUBLE),
        CAST(o_custkey % 1000 + 60 AS DOUBLE), CAST((o_custkey * 13) % 500 + 40 AS DOUBLE), ((o_orderkey * 6101) % 10007) / 10007.0e0
    FROM orders WHERE o_orderkey % 3 = 0)"""


VIEWS = {
    "samples": f"""samples AS (
    SELECT o_orderkey AS image_id, o_custkey AS group_id, 1280 AS width, 720 AS height, {_case("o_orderstatus", TIMES)} AS timeofday,
        {_case("o_orderpriority", WEATHER)} AS weather, {SCENES!r}[o_custkey % 3 + 1] AS scene
    FROM orders)""",
    "li": """li AS (
    SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id,
        CAST(l_partkey % 8 AS INTEGER) AS cls, (l_partkey * 37) % 1100 AS x, (l_suppkey * 53 + l_linenumber * 17) % 590 AS y,
        CAST(l_quantity AS BIGINT) * 3 + 8 AS w, (l_partkey * 7 + l_suppkey * 3) % 110 + 8 AS h, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
    FROM lineitem)""",
    "gt": """gt AS (
    SELECT image_id, box_id, cls, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + w AS DOUBLE) AS x2, CAST(y + h AS DOUBLE) AS y2 FROM li)""",
    "det_baseline": _det("baseline"),
    "det_candidate": _det("candidate"),
    "det_noisy": _det("noisy"),
}
NEEDS = {"gt": ["li"], "det_baseline": ["li"], "det_candidate": ["li"], "det_noisy": ["li"]}
IOU = """CASE WHEN (d.x2-d.x1)*(d.y2-d.y1) + (g.x2-g.x1)*(g.y2-g.y1) - greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))*greatest(0, least(d.y2,g.y2)-greatest(d.y1,g.y1)) <= 0 THEN 0.0e0
    ELSE greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))*greatest(0, least(d.y2,g.y2)-greatest(d.y1,g.y1)) /
    greatest(1e-12, (d.x2-d.x1)*(d.y2-d.y1) + (g.x2-g.x1)*(g.y2-g.y1) - greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))*greatest(0, least(d.y2,g.y2)-greatest(d.y1,g.y1))) END"""


def views(*names: str, recursive: bool = False) -> str:
    """The start of a WITH clause that defines the views and what they need."""
    wanted: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, []), name):
            if n not in wanted:
                wanted.append(n)
    if "det_noisy" in wanted and "det_baseline" in wanted:
        wanted.remove("det_baseline")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(VIEWS[n] for n in wanted)
