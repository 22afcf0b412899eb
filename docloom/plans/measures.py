"""Boxes measured and carried between coordinate systems; page numbers extrapolated and put right in all steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators import items as I, pages
from docloom.plans.documents import _PAGES_SQL, _page_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def boxes(spark, sf_dir):
    """Boxes of pages 1000 high, every other one measured from below; kind 0 has no normalised box."""
    b = I.boxes(I.read(spark, sf_dir, "lineitem"))
    up = F.col("kind") == 1
    box = F.struct(F.col("x0").alias("l"), F.when(up, 1000 - F.col("y0")).otherwise(F.col("y0")).alias("t"), F.col("x1").alias("r"), F.when(up, 1000 - F.col("y1")).otherwise(F.col("y1")).alias("b"), F.when(up, "BOTTOMLEFT").otherwise("TOPLEFT").alias("coord_origin"))
    unit = F.struct((F.col("x0") / 1000).alias("x0"), (F.col("y0") / 1000).alias("y0"), (F.col("x1") / 1000).alias("x1"), (F.col("y1") / 1000).alias("y1"))
    return b.select("page", "n", "kind", box.alias("box"), unit.alias("unit"))


@query(f"""WITH {I.BOXES_SQL}, m AS (SELECT page, n, kind, x0, x1, CASE WHEN kind = 1 THEN 1000 - (1000 - y0) ELSE y0 END AS y0, CASE WHEN kind = 1 THEN 1000 - (1000 - y1) ELSE y1 END AS y1, CASE WHEN kind = 1 THEN 1000 - y0 ELSE y0 END AS t, CASE WHEN kind = 1 THEN 1000 - y1 ELSE y1 END AS b, y0 AS q0, y1 AS q1 FROM boxes),
k AS (SELECT *, greatest(0, least(x1, 600) - greatest(x0, 100)) * greatest(0, least(y1, 400) - greatest(y0, 50)) / ((x1 - x0) * (y1 - y0)) AS inside, sqrt(((x0 + x1 - 700) / 2 / 500) ** 2 + ((y0 + y1 - 450) / 2 / 350) ** 2) AS dist,
 greatest(floor((x0 / 1000 - 0.03) * 800), 0) AS cx, greatest(floor((q0 / 1000 - 0.03) * 600), 0) AS cy, least(ceil((x1 / 1000 + 0.03) * 800), 800) AS dx, least(ceil((q1 / 1000 + 0.03) * 600), 600) AS dy FROM m)
SELECT page, n, round(t, 6) AS back_t, round(b, 6) AS back_b, round((x1 - x0) * (y1 - y0), 4) AS area, round(inside, 6) AS inside, round(dist, 6) AS distance, round(CASE WHEN kind = 0 THEN 0 ELSE (1 - q0 / 1000) * 600 END, 6) AS unit_t, round(CASE WHEN kind = 0 THEN 0 ELSE x1 / 1000 * 800 END, 6) AS unit_r,
 cx::BIGINT AS crop_x, cy::BIGINT AS crop_y, (dx - cx)::BIGINT AS crop_w, (dy - cy)::BIGINT AS crop_h, CASE WHEN dx - cx < 20 OR dy - cy < 20 THEN 'too_small' WHEN (dx - cx) * (dy - cy) > 0.9 * 800 * 600 THEN 'nearly_full_page' END AS crop_warning,
 round(CASE WHEN inside < 0.2 THEN 0.6 ELSE least(1, 0.8 + 0.2 * inside) END, 6) AS confidence, round(least(1, 0.55 + greatest(0, 1 - 2 * dist) * 0.25 + 0.15 * (kind = 1)::INT + 0.15 * (n % 2 = 0)::INT), 6) AS caption_score FROM k""")
def box_measures(spark, sf_dir):
    """There and back, areas, shares, distances, crops."""
    b = boxes(spark, sf_dir)
    r = G.top_left(F.col("box"), F.lit(1000.0))
    fixed = F.struct(F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(400.0).alias("y1"))
    b = b.select("page", "n", "kind", "box", "unit", r.alias("r"), fixed.alias("f"))
    b = b.withColumn("inside", G.containment(F.col("r"), F.col("f"))).withColumn("dist", G.centre_distance(F.col("r"), F.col("f"), 500.0, 350.0))
    back = G.from_top_left(F.col("r"), F.col("box.coord_origin"), F.lit(1000.0))
    unit = G.from_unit_box(F.when(F.col("kind") != 0, F.col("unit")), F.lit(800.0), F.lit(600.0))
    crop = G.crop_region(F.col("unit"), F.lit(800.0), F.lit(600.0))
    six = lambda c, name: F.round(c, 6).alias(name)
    return b.select(
        "page", "n", six(back["t"], "back_t"), six(back["b"], "back_b"), F.round(G.area(F.col("r")), 4).alias("area"), six(F.col("inside"), "inside"), six(F.col("dist"), "distance"), six(unit["t"], "unit_t"), six(unit["r"], "unit_r"), crop["x"].alias("crop_x"), crop["y"].alias("crop_y"), crop["w"].cast("long").alias("crop_w"), crop["h"].cast("long").alias("crop_h"),
        crop["warning"].alias("crop_warning"), six(G.snap_confidence(F.col("inside")), "confidence"), six(G.orphan_caption_score(F.col("dist"), F.col("kind") == 1, F.col("n") % 2 == 0), "caption_score"),
    )


@query(f"""WITH {_PAGES_SQL}, a AS (SELECT doc_id, page, number, lead(number) OVER d - number AS a, lead(number, 2) OVER d - lead(number) OVER d AS b FROM pages_ WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
r AS (SELECT doc_id, arg_min({{'page': page, 'number': number, 'step': a}}, page) AS r FROM a WHERE number > 0 AND a = b AND a IN (1, 2) GROUP BY doc_id),
p1 AS (SELECT p.doc_id, p.page, CASE WHEN p.page < r.page AND p.number > r.number - (r.page - p.page) * r.step + 10 THEN 0 ELSE p.number END AS number FROM pages_ p LEFT JOIN (SELECT doc_id, r.page AS page, r.number AS number, r.step AS step FROM r) r ON p.doc_id = r.doc_id),
f AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY page) AS prev FROM p1), d AS (SELECT doc_id, page, number, CASE WHEN number > 0 AND prev > 0 AND prev - number > 1 THEN page END AS fp, CASE WHEN number > 0 AND prev > 0 AND prev - number > 1 THEN number END AS fn FROM f),
l AS (SELECT doc_id, page, number, last_value(fp IGNORE NULLS) OVER w AS lp, last_value(fn IGNORE NULLS) OVER w AS ln FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p3 AS (SELECT doc_id, page, greatest(CASE WHEN lp IS NOT NULL THEN ln - (lp - page) ELSE number END, 0) AS number FROM l),
s AS (SELECT doc_id, count(*) FILTER (number > 0) AS n, floor(avg(number - page) FILTER (number > 0) + 0.5)::BIGINT AS mean FROM p3 GROUP BY doc_id)
SELECT doc_id, page, CASE WHEN number = 0 AND n >= 2 AND page + mean >= 1 THEN page + mean ELSE number END AS number FROM p3 JOIN s USING (doc_id)""")
def page_post_processed(spark, sf_dir):
    """All repairs in their order."""
    return pages.post_processed(_page_rows(spark, sf_dir).select("doc_id", "page", "number"))


@query(f"""WITH {_PAGES_SQL}, v AS (SELECT doc_id, page, number, page - lag(page) OVER d AS dp, number - lag(number) OVER d AS dn, number - page AS o FROM pages_ WHERE number > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
s AS (SELECT doc_id, count(*) AS n, bool_and(dn = dp) AS same, bool_and(dn = 2 * dp) AS dbl, max(o) AS hi, min(o) AS lo, floor(avg(o) + 0.5)::BIGINT AS mean, min(page) AS p0, arg_min(number, page) AS n0 FROM v GROUP BY doc_id),
e AS (SELECT p.doc_id, p.page, CASE WHEN n < 2 OR n IS NULL THEN 0 WHEN same THEN n0 + p.page - p0 WHEN dbl THEN n0 + 2 * (p.page - p0) WHEN hi - mean <= 1 AND mean - lo <= 1 THEN p.page + mean ELSE 0 END AS start_page, n >= 2 AND NOT same AND dbl AS two FROM pages_ p LEFT JOIN s USING (doc_id))
SELECT doc_id, page, start_page, start_page + CASE WHEN two THEN 1 ELSE 0 END AS end_page FROM e""")
def page_extrapolation(spark, sf_dir):
    """W3, W4."""
    p = _page_rows(spark, sf_dir)
    return pages.extrapolated(p, pages.pattern(p), p).select("doc_id", "page", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))
