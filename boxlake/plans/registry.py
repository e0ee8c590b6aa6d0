"""Query registry and the derived views the queries read.

Each view is one SQL text over the given tables; Spark and DuckDB run the same text, apart from
the spelling of "three copies per row". No view drops rows of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, tuple[str, list[str]]] = {
    # 75 annotated boxes per sheet on a 1400 x 990 canvas
    "v_gt": ("""SELECT CAST(floor(o_orderkey / 75) AS BIGINT) AS sheet_id, o_orderkey AS gt_id,
       o_orderkey * 7919 % 1400 AS x, o_orderkey * 104729 % 990 AS y,
       18 + o_orderkey % 14 AS w, 18 + o_custkey % 14 AS h, o_orderpriority AS name FROM {orders}""", ["orders"]),
    "v_shot": ("SELECT event_id, user_id, event_type, {three} AS k FROM {events}", ["events"]),
    # three detections per event around the box it points at; errors land off target
    "v_pred": ("""SELECT g.sheet_id, e.event_id * 3 + e.k AS pred_id,
       g.x + (e.event_id * 7 + e.k * 5) % 13 - 6 + CASE WHEN e.event_type = 'error' THEN 300 ELSE 0 END AS x,
       g.y + (e.user_id + e.k * 3) % 11 - 5 AS y,
       g.w + (e.event_id + e.k) % 5 - 2 AS w, g.h + (e.user_id + e.k) % 5 - 2 AS h,
       CAST(2500 + (e.event_id * 7919 + e.k * 2711) % 7501 AS DOUBLE) / 10000 AS score,
       g.name, e.event_type AS model,
       CASE WHEN (e.event_id + e.k) % 2 = 0 THEN 'none' ELSE 'median' END AS filt
       FROM {v_shot} e JOIN {v_gt} g ON g.gt_id = e.event_id + CAST(floor(e.event_id / 2) AS BIGINT)""", ["v_shot", "v_gt"]),
    "v_point": ("""SELECT sheet_id, gt_id AS pt_idx, x + CAST(floor(w / 2) AS BIGINT) AS x,
       y + CAST(floor(h / 2) AS BIGINT) AS y, name FROM {v_gt}""", ["v_gt"]),
    "v_sheet": ("""SELECT sheet_id, 1740 AS width, 1040 AS height, count(*) AS n_gt FROM {v_gt} GROUP BY sheet_id""", ["v_gt"]),
    "v_crop": ("""SELECT doc_id AS crop_id, source AS rid, concat(source, '-w', CAST(doc_id % 7 AS STRING)) AS wid,
       concat(lang, '/', CAST(doc_id AS STRING), '.png') AS path,
       concat('bbox_', lang, ' type ', CAST(n_chars % 6 AS STRING)) AS layer,
       concat(lang, ' type ', CAST(n_chars % 6 AS STRING)) AS name, 4.0e0 AS zoom,
       CASE WHEN source IN ('src3', 'src7') THEN 'val' ELSE 'train' END AS split FROM {documents}""", ["documents"]),
    "v_rid": ("SELECT DISTINCT rid, split FROM {v_crop}", ["v_crop"]),
    "v_emb": ("""SELECT vec_id AS id, embedding AS vec, label,
       CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM {embeddings}""", ["embeddings"]),
    "v_scored": ("""SELECT l.doc_id AS id, l.quality AS y, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score,
       CAST(l.doc_id % 97 AS DOUBLE) / 97 AS conf FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
                 ["labels", "documents"]),
    "v_feature": ("""SELECT c.c_nationkey AS rid, o.o_custkey AS wid, o.o_orderkey AS feat_id,
       concat(o.o_orderpriority, '/', o.o_orderstatus) AS name, 1 + o.o_orderkey % 3 AS geometry_type
       FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""", ["orders", "customer"]),
    "v_pixel": ("""SELECT l_suppkey % 5 AS img, l_orderkey % 120 AS y, l_partkey % 160 AS x,
       max(CAST(l_quantity * 5 AS INT)) AS v FROM {lineitem}
       GROUP BY l_suppkey % 5, l_orderkey % 120, l_partkey % 160""", ["lineitem"]),
    "v_path": ("""SELECT event_id AS path_id, CASE WHEN event_type = 'error' THEN 'f' ELSE 's' END AS type,
       CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS gray, CAST(50 + user_id % 51 AS DOUBLE) / 100 AS opacity,
       CAST(user_id % 140 AS DOUBLE) AS rect_w, CAST(event_id % 120 AS DOUBLE) AS rect_h,
       event_id % 3 AS line_cap, event_type AS dashes,
       CASE event_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 're' ELSE 'l' END AS kind FROM {events}""", ["events"]),
    "v_history": ("""SELECT event_type AS arm, event_id % 20 + 1 AS epoch, avg(value) AS ari
       FROM {events} GROUP BY event_type, event_id % 20 + 1""", ["events"]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# tables that feed costly expressions (spatial covers, JSON, text scans)
HEAVY = {"events", "orders", "documents"}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is a single small file; a lake table with at least as
    many splits as cores is left alone, so this never shuffles large data."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Views:
    """Lazy access to tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")) if name in HEAVY else (
                self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        sql, deps = VIEWS[name]
        return self.spark.sql(sql.replace("{three}", "explode(sequence(0, 2))"), **{d: self(d) for d in deps})


def with_views(body: str, *views: str) -> str:
    """DuckDB text: the views (and what they build on) as CTEs before ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for v in views:
        visit(v)
    ctes = []
    for n in order:
        sql, deps = VIEWS[n]
        sql = sql.replace("{three}", "unnest(range(0, 3))")
        for d in deps:
            sql = sql.replace("{" + d + "}", d)
        ctes.append(f"{n} AS ({sql})")
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes + [body[len("WITH RECURSIVE"):].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes + [body[5:].strip()])
    return (("WITH " + ", ".join(ctes) + " ") if ctes else "") + body


def query(name: str, oracle: str | None = None, *views: str):
    """Register ``fn(views) -> DataFrame`` and, where SQL can say the same, its DuckDB text."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views)
        return fn

    return wrap
