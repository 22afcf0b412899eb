"""Page contexts of a review and what surrounds them: neighbours, previews, chunks, samples, contents areas, command rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions import text as T

PREVIEW, FULL_GRID, CAPTION_CHARS, SEARCHED_PAGES = 8, 600, 240, 10


def page_texts(texts: DataFrame) -> DataFrame:
    """P5: texts (doc_id, ordinal, label, prov: array of struct<page_no>) on every page that any of their places names; the ordinal stays."""
    seen = texts.where(F.col("label").isin(*fixed.PAGE_LABELS))
    return seen.select("doc_id", "ordinal", "label", F.explode(F.array_distinct(F.transform("prov", lambda p: p["page_no"]))).alias("page_no"))


def unused(blocks: DataFrame, used: DataFrame) -> DataFrame:
    """Blocks that no match has taken, in their own order."""
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("pos"))
    return blocks.join(used, ["doc_id", "pos"], "left_anti").withColumn("place", place)


def adjacent(tables: DataFrame) -> DataFrame:
    """For each table the tables of the page before and after, if there are such pages."""
    near = tables.select(F.col("doc_id").alias("__d"), F.col("self_ref").alias("near_ref"), F.explode(F.array(F.struct((F.col("page_no") + 1).alias("page"), F.lit("before").alias("side")), F.struct((F.col("page_no") - 1).alias("page"), F.lit("after").alias("side")))).alias("at"))
    return tables.join(near, (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("at.page"))).select("doc_id", "self_ref", "near_ref", F.col("at.side").alias("side"))


def nearby_texts(items: DataFrame, is_text: Column, radius: int) -> DataFrame:
    """Of each other item the ``radius`` nearest text references on either side, in reading order; items between don't count."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ranked = items.withColumn("__text", is_text).withColumn("__n", F.sum(F.col("__text").cast("long")).over(order))
    texts = ranked.where("__text").select(F.col("doc_id").alias("__d"), F.col("__n").alias("__k"), F.col("self_ref").alias("near"))
    wanted = ranked.where("not __text").select("doc_id", "self_ref", "__n", F.explode(F.sequence(F.col("__n") - radius + 1, F.col("__n") + radius)).alias("__k"))
    met = wanted.join(texts.withColumnRenamed("__k", "__k2"), (F.col("doc_id") == F.col("__d")) & (F.col("__k") == F.col("__k2")))
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("__k", "near")))), lambda x: x["near"]), ",")
    return met.groupBy("doc_id", "self_ref").agg(side(F.col("__k") <= F.col("__n")).alias("before"), side(F.col("__k") > F.col("__n")).alias("after"))


def recovered(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed numbers by the full text they were read from, where a batch's answers don't count up; of equal texts the last counts."""
    by_text = parsed.groupBy("doc_id", F.col("full_text").alias("__text")).agg(F.max_by("number", "seq").alias("number"))
    return wanted.join(by_text.withColumnRenamed("doc_id", "__d"), (F.col("doc_id") == F.col("__d")) & (F.col("full_text") == F.col("__text")), "left").drop("__d", "__text")


def by_ids(owners: DataFrame, resources: DataFrame) -> DataFrame:
    """The resources of ordered id lists; ids without a resource are dropped, the order stays."""
    each = owners.select("doc_id", "owner", F.posexplode("ids").alias("__at", "id"))
    return each.join(resources, ["doc_id", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "owner").orderBy("__at"))).drop("__at")


def listed_by_page(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The values of each page in order."""
    return rows.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias(name))


def header_offsets(cells: DataFrame) -> DataFrame:
    """The distinct rows and columns of header cells, ascending."""
    pick = lambda flag, at: F.array_sort(F.collect_set(F.when(F.col(flag), F.col(at))))
    return cells.groupBy("table_id").agg(pick("column_header", "row").alias("header_rows"), pick("row_header", "col").alias("header_cols"))


def first_by_id(issues: DataFrame) -> DataFrame:
    """Of issues with one id the first."""
    return issues.withColumn("__n", F.row_number().over(Window.partitionBy("page", "id").orderBy("seq"))).where("__n = 1").drop("__n")


def correction_totals(pages: DataFrame) -> DataFrame:
    """Corrections of a run; a page without a result has failed."""
    return pages.groupBy("run").agg(F.coalesce(F.sum("texts"), F.lit(0)).cast("long").alias("texts"), F.coalesce(F.sum("cells"), F.lit(0)).cast("long").alias("cells"), F.count_if(F.col("texts").isNull()).alias("failed_pages"), F.count("*").alias("pages"))


def order_mismatch(actual: Column, expected: Column) -> Column:
    """In how many places two lists differ; places that only the longer has count."""
    n = F.greatest(F.size(actual), F.size(expected))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: s + F.when(F.get(actual, i).eqNullSafe(F.get(expected, i)), 0).otherwise(1))


def moved(refs: Column, source: Column, target: Column, after: Column) -> Column:
    """V5: a list with one reference moved beside another; null if either is missing or they are the same."""
    rest = F.filter(refs, lambda r: r != source)
    at = F.array_position(rest, target) - F.when(after, 0).otherwise(1)
    there = (source != target) & F.array_contains(refs, source) & F.array_contains(refs, target)
    return F.when(there, F.concat(F.slice(rest, F.lit(1), F.greatest(at, F.lit(0)).cast("int")), F.array(source), F.slice(rest, (at + 1).cast("int"), F.size(rest) + 1)))


def contents_like_groups(groups: DataFrame) -> DataFrame:
    """Groups (doc_id, group_ref, name, texts): a list or group with three texts that end in page numbers, or more than half of them."""
    known = F.filter("texts", lambda t: t.isNotNull())
    hits = F.size(F.filter(known, T.ends_in_page_number))
    right = F.col("name").isin("list", "group") & ((hits >= 3) | ((F.size(known) > 0) & (hits > 0.5 * F.size(known))))
    return groups.withColumn("page_numbers", hits.cast("long")).withColumn("contents_like", right)


def resource_index_tables(cells: DataFrame) -> DataFrame:
    """Tables where more than half of the first column's cells begin as entries of a list of figures or tables do."""
    first = cells.where("col = 0").groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(T.is_resource_index(T.trimmed(F.col("text")))).alias("hits"))
    return first.select("table_id", (F.col("hits") > 0.5 * F.col("n")).alias("resource_index"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """L4: of a document's candidates the one with the highest score, the first of equal ones."""
    best = F.max_by(F.struct(*(c for c in candidates.columns if c != "doc_id")), F.struct("score", -F.col("ord"))).alias("b")
    return candidates.groupBy("doc_id").agg(best).select("doc_id", "b.*")


def contents_area(start: DataFrame, continued: DataFrame, most: int = SEARCHED_PAGES) -> DataFrame:
    """The first and last page of contents that begin on ``start`` (doc_id, page_no) and go on over neighbouring pages of ``continued``.

    Backwards as far as pages go on without a gap, forwards no further than page ``most``. Pages in a row share the
    difference of page and rank, so the two ends are the ends of the runs that touch the start page.
    """
    begin = start.select("doc_id", F.col("page_no").alias("first_page"))
    pages = continued.select("doc_id", "page_no").distinct().join(begin, "doc_id")
    back, on = pages.where("page_no >= 1 and page_no < first_page"), pages.where(F.col("page_no").between(F.col("first_page") + 1, F.lit(most)))
    down, up = Window.partitionBy("doc_id").orderBy(F.desc("page_no")), Window.partitionBy("doc_id").orderBy("page_no")
    back = back.withColumn("n", F.row_number().over(down)).where("first_page - page_no = n").groupBy("doc_id").agg(F.min("page_no").alias("lo"))
    on = on.withColumn("n", F.row_number().over(up)).where("page_no - first_page = n").groupBy("doc_id").agg(F.max("page_no").alias("hi"))
    return begin.join(back, "doc_id", "left").join(on, "doc_id", "left").select("doc_id", F.coalesce("lo", "first_page").alias("start_page"), F.coalesce("hi", "first_page").alias("end_page"))


def sampled(pages: DataFrame, seed: str, most: int = 3) -> DataFrame:
    """``most`` unused pages of a document by lot, the same for the same seed; if all are used, of all."""
    lot = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), F.col("page_no").cast("string")))
    spare = F.count_if(~F.col("used")).over(Window.partitionBy("doc_id"))
    pool = pages.withColumn("__lot", lot).withColumn("__spare", spare).where((F.col("__spare") == 0) | ~F.col("used"))
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("__lot"))).where(F.col("place") <= most).drop("__lot", "__spare")


def edge_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """The first pages, and the last ones of documents that have more than twice as many."""
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    return pages.withColumn("__last", last).where((F.col("page_no") <= most) | ((F.col("__last") > 2 * most) & (F.col("page_no") > F.col("__last") - most))).drop("__last")


def page_chunks(total: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk, first_page, last_page) of documents with total_pages, ``size`` pages each."""
    if size <= 0:
        raise ValueError("a chunk has one page at least")
    chunk = total.where("total_pages > 0").select("doc_id", "total_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("total_pages") - 1) / size).cast("int"))).alias("chunk"))
    return chunk.select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * size + 1).cast("long").alias("first_page"), F.least((F.col("chunk") + 1) * size, F.col("total_pages")).cast("long").alias("last_page"))


def previewed(grid: Column, cells: Column) -> Column:
    """The first rows and columns of a grid of texts; the whole of one of ``FULL_GRID`` cells at most is given beside it."""
    rows = F.transform(F.slice(grid, 1, PREVIEW), lambda r: F.slice(r, 1, PREVIEW))
    return F.struct(rows.alias("preview"), F.when(cells <= FULL_GRID, grid).alias("full"))


def head_pages(pages: DataFrame, found: DataFrame, size: int = 10) -> DataFrame:
    """The first ``size`` pages, and the next ``size`` of documents whose contents went on to the first batch's last page."""
    goes_on = found.where(F.col("end_page") >= size).select("doc_id", F.lit(True).alias("__on"))
    batch = F.floor((F.col("page_no") - 1) / size).cast("long")
    return pages.join(goes_on, "doc_id", "left").withColumn("batch", batch).where((F.col("batch") == 0) | ((F.col("batch") == 1) & F.coalesce("__on", F.lit(False)))).drop("__on")


def distinct_union(*lists: Column) -> Column:
    """O2: all lists' entries, each once, in the order they first come."""
    return F.array_distinct(F.concat(*lists))


def asked_again(reasons: Column) -> Column:
    """V8: the distinct reasons that another answer could mend; what only waits for a person isn't asked again."""

    def mendable(r: Column) -> Column:
        found = r.startswith("invalid_") | r.endswith("_not_found") | r.startswith("table_correction_") | r.startswith("task_op_not_allowed:")
        for part in fixed.MENDABLE_PARTS:
            found = found | r.contains(part)
        return found & ~r.contains("requires_manual_review")

    return F.array_distinct(F.filter(reasons, mendable))


def page_verdict(text: Column, language: str) -> Column:
    """What speaks against a page's text; an empty list for none, and for a page without text."""
    found = [F.when(T.placeholder(text), F.lit("placeholder_text"))]
    if language.startswith("ko"):
        found.append(F.when(T.script_anomaly(text, "ko"), F.lit("script_anomaly")))
    found += [F.when(T.meta_description(text), F.lit("meta_description")), F.when(T.repetition_ratio(text) >= 0.3, F.lit("repetitive_pattern"))]
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


def packed(blocks: DataFrame, wanted: DataFrame, task: str) -> DataFrame:
    """The columns and rows of a page's texts that a task's model sees.

    Texts within pictures go but for the picture task; tasks on wording see no boxes, tasks on layout no suspect
    reasons; only wanted references and what stands beside them on their page stay.
    """
    rows = blocks if task == "pictures_captions" else blocks.where(~F.array_contains("suspect", "picture_internal_text"))
    kept = rows.join(wanted.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    columns = {"layout_bbox_order": ["doc_id", "self_ref", "page_no", "bbox"], "pictures_captions": ["doc_id", "self_ref", "page_no", "text", "bbox"]}.get(task, ["doc_id", "self_ref", "page_no", "text", "suspect"])
    return kept.select(*columns)


def clamped(value: float | None, low: float, high: float, fallback: float) -> float:
    """An option within its range, or its fallback."""
    ok = isinstance(value, (int, float)) and value == value and abs(value) != float("inf")
    return min(high, max(low, value if ok else fallback))
