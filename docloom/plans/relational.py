"""Queries over boxes, usage and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators import items as I
from docloom.operators import resources, spatial, tasks, usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2001-09-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _boxes(spark, sf_dir) -> DataFrame:
    """Distinct boxes, the page's lines numbered anew."""
    b = I.boxes(I.read(spark, sf_dir, "lineitem")).drop("n").distinct()
    return b.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(*spatial.RECT, "kind")).cast("long"))


_BOXES = f"""{I.BOXES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, y0, x1, y1, kind) AS n FROM (SELECT DISTINCT page, x0, y0, x1, y1, kind FROM boxes))"""
_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "(greatest({0}.x1 - {0}.x0, 0) * greatest({0}.y1 - {0}.y0, 0))"


@query(f"""WITH {_BOXES}, p AS (SELECT a.page, a.n, b.n AS media_n, sqrt(((a.x0 + a.x1 - b.x0 - b.x1) / 2) ** 2 + ((a.y0 + a.y1 - b.y0 - b.y1) / 2) ** 2) AS d FROM b a JOIN b ON a.page = b.page AND a.kind = 0 AND b.kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY round(d, 6), media_n) AS rank FROM p) SELECT page, n, media_n, rank, round(d, 6) AS distance FROM r WHERE rank <= 3""")
def nearest_media_top3(spark, sf_dir):
    """J10."""
    b = _boxes(spark, sf_dir)
    m = b.where("kind <> 0").select("page", F.col("n").alias("media_n"), *(F.col(c).alias(f"o_{c}") for c in spatial.RECT))
    d = b.where("kind = 0").join(m, "page").withColumn("distance", F.round(G.centre_distance(spatial.rect(), spatial.rect("o_")), 6))
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy("page", "n").orderBy("distance", "media_n")))
    return r.where("rank <= 3").select("page", "n", "media_n", F.col("rank").cast("long").alias("rank"), "distance")


@query(f"""WITH {_BOXES} SELECT DISTINCT a.page, a.n FROM b a JOIN b ON a.page = b.page WHERE a.kind = 0 AND b.kind = 1 AND coalesce({_INTER} / nullif({_AREA.format('a')}, 0), 0) >= 0.8""")
def texts_in_pictures(spark, sf_dir):
    """J9."""
    b = _boxes(spark, sf_dir)
    return spatial.inside_any(b.where("kind = 0"), b.where("kind = 1"), ["page"]).select("page", "n")


@query(f"""WITH {_BOXES} SELECT a.page, a.n AS n1, b.n AS n2, round({_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER}), 6) AS iou FROM b a JOIN b ON a.page = b.page AND a.n < b.n WHERE {_INTER} > 0""")
def iou_pairs(spark, sf_dir):
    """M4: overlapping boxes of a page."""
    b = _boxes(spark, sf_dir)
    o = b.select("page", F.col("n").alias("n2"), *(F.col(c).alias(f"o_{c}") for c in spatial.RECT))
    hit = b.join(o, "page").where((F.col("n") < F.col("n2")) & (G.intersection(spatial.rect(), spatial.rect("o_")) > 0))
    return hit.select("page", F.col("n").alias("n1"), "n2", F.round(G.iou(spatial.rect(), spatial.rect("o_")), 6).alias("iou"))


@query(f"WITH {_BOXES} SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY y0, x0, n) AS place FROM b")
def visual_order(spark, sf_dir):
    """L5."""
    return spatial.visual_order(_boxes(spark, sf_dir)).select("page", "n", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_BOXES} SELECT page, n, CASE WHEN x0 >= x1 OR y0 >= y1 THEN 'invalid_order' WHEN x0 < 0 OR y0 < 0 OR x1 > 500 OR y1 > 500 THEN 'outside_page' WHEN (x1 - x0) * (y1 - y0) < 0.005 * 250000 THEN 'too_small' END AS warning FROM b""")
def bbox_warnings(spark, sf_dir):
    """M1, M6."""
    box = F.struct(F.col("x0").alias("l"), F.col("y0").alias("t"), F.col("x1").alias("r"), F.col("y1").alias("b"), F.lit("TOPLEFT").alias("coord_origin"))
    return _boxes(spark, sf_dir).select("page", "n", G.bbox_warning(box, F.lit(500.0), F.lit(500.0)).alias("warning"))


_CELLS = """cells AS (SELECT l_orderkey AS table_id, l_linenumber % 4 AS row, l_partkey % 5 AS col, CASE WHEN l_suppkey % 6 = 0 THEN greatest(l_linenumber % 4 - 1, 0) ELSE l_linenumber % 4 END AS start_row,
  l_partkey % 5 - l_partkey % 2 AS start_col, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_returnflag || l_suppkey END AS text FROM lineitem)"""


def _cells(spark, sf_dir) -> DataFrame:
    n, p, s = F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    return I.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("table_id"), (n % 4).alias("row"), (p % 5).alias("col"), F.when(s % 6 == 0, F.greatest(n % 4 - 1, F.lit(0))).otherwise(n % 4).alias("start_row"),
        (p % 5 - p % 2).alias("start_col"), F.when(s % 4 == 0, "").otherwise(F.concat("l_returnflag", s.cast("string"))).alias("text"),
    ).distinct()


@query(f"""WITH {_CELLS}, o AS (SELECT DISTINCT table_id, row, col, start_col FROM cells WHERE start_row = row), f AS (SELECT table_id, row, start_col AS anchor_col, min(col) AS col FROM o GROUP BY ALL)
SELECT table_id::BIGINT AS table_id, row::BIGINT AS row, anchor_col::BIGINT AS anchor_col, col::BIGINT AS col, row_number() OVER (PARTITION BY table_id, row ORDER BY anchor_col) AS place FROM f""")
def table_grid_anchor(spark, sf_dir):
    """T10."""
    g = resources.anchored_grid(_cells(spark, sf_dir).drop("text").distinct())
    return g.select("table_id", "row", "anchor_col", "col", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_CELLS} SELECT table_id::BIGINT AS table_id, round(count(*) FILTER (trim(text) = '') / count(*)::DOUBLE, 6) AS empty_ratio FROM (SELECT DISTINCT * FROM cells) GROUP BY table_id""")
def empty_cell_ratio(spark, sf_dir):
    """A7."""
    return resources.empty_ratio(_cells(spark, sf_dir)).withColumn("empty_ratio", F.round("empty_ratio", 6))


@query(f"""WITH {_CELLS}, c AS (SELECT DISTINCT table_id, row, col, l.x AS text FROM cells, LATERAL (SELECT CASE WHEN start_col % 2 = 0 THEN (row * 7 + col)::VARCHAR ELSE text END AS x) l),
s AS (SELECT table_id, max(row) + 1 AS rows, max(col) + 1 AS cols FROM c GROUP BY ALL),
d AS (SELECT c.table_id, count(*) AS n, count(*) FILTER (regexp_matches(trim(text), '^[0-9]+$')) AS d FROM c JOIN s USING (table_id) WHERE col = cols - 1 AND row > 0 GROUP BY ALL)
SELECT s.table_id::BIGINT AS table_id, rows >= 3 AND cols >= 2 AND coalesce(d, 0) > coalesce(n, 0) / 2.0 AS contents_like FROM s LEFT JOIN d USING (table_id)""")
def toc_like_tables(spark, sf_dir):
    """T13."""
    c = _cells(spark, sf_dir).withColumn("text", F.when(F.col("start_col") % 2 == 0, (F.col("row") * 7 + F.col("col")).cast("string")).otherwise(F.col("text")))
    return resources.looks_like_contents(c.select("table_id", "row", "col", "text").distinct())


@query(f"""WITH {_CELLS}, c AS (SELECT DISTINCT table_id, row, col, 1 + start_col % 3 AS col_span FROM cells), w AS (SELECT table_id, row, sum(greatest(1, col_span)) AS w FROM c GROUP BY ALL)
SELECT table_id::BIGINT AS table_id, (max(row) + 1)::BIGINT AS num_rows, max(w)::BIGINT AS num_cols FROM w GROUP BY table_id""")
def table_size(spark, sf_dir):
    """A8, T12."""
    return resources.grid_size(_cells(spark, sf_dir).select("table_id", "row", "col", (1 + F.col("start_col") % 3).alias("col_span")).distinct())


@query(f"""WITH {_CELLS}, c AS (SELECT DISTINCT table_id, row, col, 1 + col % 2 AS row_span, 1 + row % 3 AS col_span FROM cells),
x AS (SELECT table_id, row, col, unnest(range(row, row + row_span)) AS r, col_span FROM c WHERE row_span > 1 OR col_span > 1), y AS (SELECT table_id, row, col, r, unnest(range(col, col + col_span)) AS k FROM x)
SELECT table_id::BIGINT AS table_id, r::BIGINT AS row, k::BIGINT AS col, count(*) AS covers FROM y WHERE r <> row OR k <> col GROUP BY ALL""")
def span_shadows(spark, sf_dir):
    """T18."""
    c = _cells(spark, sf_dir).select("table_id", "row", "col", (1 + F.col("col") % 2).alias("row_span"), (1 + F.col("row") % 3).alias("col_span")).distinct()
    return resources.shadows(c).groupBy("table_id", "row", "col").agg(F.count("*").alias("covers"))


@query(f"""WITH {I.USAGE_SQL} SELECT CASE WHEN grouping(component) = 1 THEN 'all' WHEN grouping(phase) = 1 THEN 'component' WHEN grouping(model) = 1 THEN 'phase' ELSE 'model' END AS level, component, phase, role, model,
sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(tokens_in + tokens_out)::BIGINT AS total, count(*) AS calls FROM usage GROUP BY GROUPING SETS ((component, phase, role, model), (component, phase), (component), ())""")
def usage_rollup(spark, sf_dir):
    """A1."""
    return usage.rollup(I.usage(I.read(spark, sf_dir, "events")))


@query(f"""WITH {I.USAGE_SQL}, f AS (SELECT component, phase, role, model, min(seq) AS seq, sum(tokens_in + tokens_out)::BIGINT AS total FROM usage GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY component, phase, role ORDER BY seq) AS n FROM f),
p AS (SELECT * FROM r WHERE role = 'primary'), b AS (SELECT * FROM r WHERE role = 'fallback')
SELECT coalesce(p.component, b.component) AS component, coalesce(p.phase, b.phase) AS phase, coalesce(p.n, b.n) AS n, p.model AS "primary", p.total AS primary_total, b.model AS fallback, b.total AS fallback_total
FROM p FULL JOIN b ON p.component = b.component AND p.phase = b.phase AND p.n = b.n""")
def usage_positional_zip(spark, sf_dir):
    """J22."""
    return usage.positional_zip(I.usage(I.read(spark, sf_dir, "events"))).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {I.USAGE_SQL}, prices(model, i, o) AS (VALUES ('model-0', 0.25::DOUBLE, 2.0::DOUBLE), ('model-1', 1.25, 10.0), ('model-2', 0.1, 0.4)),
c AS (SELECT component, phase, sum(tokens_in / 1e6 * coalesce(i, 0) + tokens_out / 1e6 * coalesce(o, 0)) AS c FROM usage LEFT JOIN prices USING (model) GROUP BY ALL)
SELECT component, phase, floor(c * 1000000 + 0.5) / 1000000 AS usd, floor(c * 1450 + 0.5)::BIGINT AS krw FROM c""")
def cost_report(spark, sf_dir):
    """A4, J18."""
    prices = spark.sql("SELECT * FROM VALUES ('model-0', 0.25D, 2.0D), ('model-1', 1.25D, 10.0D), ('model-2', 0.1D, 0.4D) AS t(model, price_in, price_out)")
    return usage.costs(I.usage(I.read(spark, sf_dir, "events")), prices)


@query(f"""WITH {I.USAGE_SQL}, r AS (SELECT component, phase, role, model, min(seq) AS first_seq, sum(tokens_in)::BIGINT AS tokens_in FROM usage GROUP BY ALL), s AS (SELECT component, phase, count(*) AS n FROM usage GROUP BY ALL)
SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY component, phase ORDER BY first_seq) = 1 THEN n END AS metadata_calls FROM r JOIN s USING (component, phase)""")
def usage_metadata(spark, sf_dir):
    """A2."""
    return usage.with_metadata(I.usage(I.read(spark, sf_dir, "events")))


@query(f"""WITH {I.USAGE_SQL}, c AS (SELECT 0 AS source, * FROM usage WHERE phase = 0 UNION ALL SELECT 1, * FROM usage WHERE phase = 1)
SELECT source, component, count(*) AS n, max(total_all)::BIGINT AS total_all FROM (SELECT *, sum(tokens_in + tokens_out) OVER () AS total_all FROM c) GROUP BY ALL""")
def usage_merged(spark, sf_dir):
    """A3: two reports one behind the other, with the total of both."""
    u = I.usage(I.read(spark, sf_dir, "events"))
    both = u.where("phase = 0").withColumn("source", F.lit(0)).unionByName(u.where("phase = 1").withColumn("source", F.lit(1)))
    sums = both.groupBy("source", "component").agg(F.count("*").alias("n"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("t"))
    return sums.withColumn("total_all", F.sum("t").over(Window.partitionBy())).drop("t")


def _tasks(spark, sf_dir) -> DataFrame:
    return I.tasks(I.read(spark, sf_dir, "orders"))


@query(f"WITH {I.TASKS_SQL} SELECT task_id, status, session_id FROM tasks WHERE status = 'completed' ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 40")
def task_page(spark, sf_dir):
    """L1: the third page of completed tasks."""
    return tasks.listed(_tasks(spark, sf_dir), 3, 20, "completed").select("task_id", "status", "session_id")


@query(f"WITH {I.TASKS_SQL} SELECT task_id, CASE status WHEN 'queued' THEN row_number() OVER (PARTITION BY session_id, status ORDER BY created_at, task_id) WHEN 'running' THEN 0 ELSE -1 END AS position FROM tasks")
def queue_positions(spark, sf_dir):
    """L2, W17."""
    return tasks.queue_positions(_tasks(spark, sf_dir))


@query(f"""WITH {I.TASKS_SQL}, c AS (SELECT session_id, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'completed' AND created_at::DATE = DATE '1998-06-15') AS today FROM tasks GROUP BY session_id) SELECT *, greatest(0, 2 - today) AS remaining, today < 2 AS allowed FROM c""")
def quota_status(spark, sf_dir):
    """A17, V16, M16."""
    return tasks.quota(_tasks(spark, sf_dir), "1998-06-15", 2)


@query(f"""WITH {I.TASKS_SQL} SELECT session_id, max(created_at)::VARCHAR AS last_success, (max(created_at) + INTERVAL 7 DAY)::VARCHAR AS free_at FROM tasks
WHERE status = 'completed' AND created_at > TIMESTAMP '1998-06-15' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '1998-06-15' GROUP BY session_id""")
def weekly_lockout(spark, sf_dir):
    """A18, R7."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tasks.weekly_lockout(_tasks(spark, sf_dir), "1998-06-15 00:00:00").select("session_id", stamp("last_success"), stamp("free_at"))


@query(f"WITH {I.TASKS_SQL} SELECT task_id, session_id FROM tasks WHERE NOT is_sample AND status IN ('completed', 'failed') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1500 DAY")
def retention(spark, sf_dir):
    """R8."""
    return tasks.expired(_tasks(spark, sf_dir), NOW, 1500).select("task_id", "session_id")


@query(f"""WITH {I.TASKS_SQL}, x AS (SELECT task_id FROM tasks WHERE NOT is_sample AND status IN ('completed', 'failed') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1500 DAY)
SELECT l_orderkey AS task_id, count(*) AS n_logs FROM lineitem ANTI JOIN x ON x.task_id = l_orderkey GROUP BY ALL""")
def log_cascade(spark, sf_dir):
    """J23."""
    logs = I.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"))
    return tasks.without_expired(logs, tasks.expired(_tasks(spark, sf_dir), NOW, 1500)).groupBy("task_id").agg(F.count("*").alias("n_logs"))


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, event_id % 4 = 0 AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY key ORDER BY seq) AS island FROM e),
f AS (SELECT key, island, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY ALL) SELECT key, arg_max(failures, island) AS failures, max(failures) >= 5 AS locked FROM f GROUP BY key""")
def failed_attempts(spark, sf_dir):
    """In batch form, by islands between successes."""
    e = I.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("ok"))
    return tasks.failed_attempts(e, 5)


@query("""WITH s AS (SELECT l_orderkey AS task_id, l_linenumber AS ord, max(l_suppkey % 9 + 1) AS weight FROM lineitem GROUP BY ALL)
SELECT task_id, ord::BIGINT AS ord, floor(100 * coalesce(sum(weight) OVER (PARTITION BY task_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER (PARTITION BY task_id) + 0.5)::BIGINT AS percent FROM s""")
def weighted_progress(spark, sf_dir):
    """M17."""
    s = I.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("ord")).agg(F.max(F.col("l_suppkey") % 9 + 1).alias("weight"))
    return tasks.progress(s).select("task_id", F.col("ord").cast("long").alias("ord"), "percent")


@query("""SELECT event_id, ['google', 'togetherai', 'openai', 'unknown', 'anthropic', 'openai'][1 + user_id % 6] AS provider FROM events""")
def provider_names(spark, sf_dir):
    """F34."""
    names = F.array(*map(F.lit, ("google.generative-ai", "together.chat-ollama", "openai.responses", "local", "anthropic.messages", "openai-google")))
    return I.read(spark, sf_dir, "events").select("event_id", T.provider_of(F.get(names, (F.col("user_id") % 6).cast("int"))).alias("provider"))
