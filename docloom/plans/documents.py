"""Queries over lines of documents: text rules, chapters, pages, contents, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions import text as T
from docloom.operators import chapters, items as I, nodes, pages, toc

WS_SQL = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WSZ_SQL = WS_SQL[:-1] + r"\x{200B}]"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(I.read(spark, sf_dir, "documents"))


@query(f"""WITH {I.ITEMS_SQL}, {I.TOC_SQL},
ranges AS (SELECT doc_id, k, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, k) - 1, 9007199254740991) AS end_page FROM toc),
hit AS (SELECT i.doc_id, i.pos, i.label, i.self_ref, r.k FROM items i JOIN ranges r ON i.doc_id = r.doc_id AND i.page_no BETWEEN r.start_page AND r.end_page)
SELECT doc_id, k, 'ch-' || printf('%03d', k + 1) AS chapter_id, count(*) AS n_items, coalesce(string_agg(self_ref, ',' ORDER BY pos) FILTER (label = 'text'), '') AS texts,
  coalesce(string_agg(self_ref, ',' ORDER BY pos) FILTER (label = 'list_item'), '') AS list_items FROM hit GROUP BY doc_id, k""")
def chapter_assembly(spark, sf_dir):
    """Items assigned to chapters by page, with ordered lists a kind."""
    rows = lines(spark, sf_dir)
    hit = chapters.assign(rows, chapters.chapter_ranges(I.toc(rows)))
    pick = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("pos", "self_ref")))), lambda x: x["self_ref"]), ",")
    return hit.groupBy("doc_id", "k").agg(F.count("*").alias("n_items"), pick("text").alias("texts"), pick("list_item").alias("list_items")).withColumn("chapter_id", chapters.padded_id("ch-", F.col("k") + 1))


@query(f"WITH {I.ITEMS_SQL} SELECT doc_id, pos, page_no, label, length(text)::BIGINT AS n FROM items")
def explode_items(spark, sf_dir):
    """S1, P1."""
    return lines(spark, sf_dir).select("doc_id", "pos", "page_no", "label", F.length("text").cast("long").alias("n"))


@query(f"""WITH {I.ITEMS_SQL}, t AS (SELECT *, regexp_replace(text, '{WS_SQL}+', '', 'g') AS norm FROM items),
g AS (SELECT doc_id, norm FROM t WHERE length(norm) >= 2 GROUP BY ALL HAVING count(DISTINCT page_no) >= 2)
SELECT t.doc_id, t.self_ref, t.page_no FROM t SEMI JOIN g ON t.doc_id = g.doc_id AND t.norm = g.norm""")
def repeated_across_pages(spark, sf_dir):
    """Texts that stand on two pages or more of a document."""
    # texts meet as hashes, summed where they are; only what may recur is compared as it stands
    t = lines(spark, sf_dir).withColumn("norm", T.spaceless(F.col("text"))).where(F.length("norm") >= 2).withColumn("h", F.xxhash64("norm"))
    often = t.groupBy("doc_id", "h").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi")).where("lo <> hi").select("doc_id", "h")
    maybe = t.join(often, ["doc_id", "h"], "left_semi")
    same = Window.partitionBy("doc_id", "norm")
    return maybe.select("doc_id", "self_ref", "page_no", (F.min("page_no").over(same) != F.max("page_no").over(same)).alias("again")).where("again").drop("again")


@query(f"""WITH {I.ITEMS_SQL}, p AS (SELECT doc_id, pos, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM items),
c AS (SELECT doc_id, pos, ch, sum(x)::BIGINT AS na, sum(y)::BIGINT AS nb FROM (
  SELECT doc_id, pos, unnest(string_split(a, '')) AS ch, 1 AS x, 0 AS y FROM p WHERE b IS NOT NULL UNION ALL SELECT doc_id, pos, unnest(string_split(b, '')), 0, 1 FROM p WHERE b IS NOT NULL) WHERE ch <> '' GROUP BY ALL),
s AS (SELECT doc_id, pos, sum(least(na, nb)) AS shared FROM c GROUP BY ALL)
SELECT p.doc_id, p.pos, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE coalesce(shared, 0) / greatest(length(a), length(b))::DOUBLE END, 6) AS overlap
FROM p LEFT JOIN s USING (doc_id, pos) WHERE b IS NOT NULL""")
def char_overlap_adjacent(spark, sf_dir):
    """Character overlap of each line with the next."""
    p = lines(spark, sf_dir).withColumn("b", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).where("b is not null")
    return p.select("doc_id", "pos", F.round(T.char_overlap(F.col("text"), F.col("b")), 6).alias("overlap"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '{WSZ_SQL}+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    """F1."""
    return I.read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("digest"))


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(trim(regexp_replace(text, '{WSZ_SQL}+', ' ', 'g')), '^[0-9 ]*$')) AS n_valid FROM items GROUP BY doc_id""")
def valid_text(spark, sf_dir):
    """F3, F4."""
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_valid(F.col("text"))).alias("n_valid"))


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, pos, md5(regexp_replace(regexp_replace(text, '^[,.:;!?]+{WS_SQL}*', ''), '{WS_SQL}+[,.:;!?]*$', '')) AS cleaned FROM items""")
def clean_punctuation(spark, sf_dir):
    """F2."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.md5(T.clean_punctuation(F.col("text"))).alias("cleaned"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}]')) AS ko, len(regexp_extract_all(text, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]')) AS ja, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents)
SELECT doc_id, ko::BIGINT AS ko, ja::BIGINT AS ja, en::BIGINT AS en, array_to_string([x.l FOR x IN list_sort([{'n': -ko, 'o': 0, 'l': 'ko'}, {'n': -ja, 'o': 1, 'l': 'ja'}, {'n': -en, 'o': 2, 'l': 'en'}]) IF x.n < 0], ',') AS languages FROM c""")
def script_histogram(spark, sf_dir):
    """A10: characters by script, languages by falling count."""
    count = lambda c: F.regexp_count("text", F.lit(f"[{c}]")).cast("long")
    d = I.read(spark, sf_dir, "documents").select("doc_id", count(T.HANGUL).alias("ko"), count(T.KANA).alias("ja"), count(T.LATIN).alias("en"))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(x)).alias("n"), F.lit(o).alias("o"), F.lit(x).alias("l")) for o, x in enumerate(("ko", "ja", "en")))))
    return d.withColumn("languages", F.array_join(F.transform(F.filter(ranked, lambda x: x["n"] < 0), lambda x: x["l"]), ","))


@query(f"""WITH {I.ITEMS_SQL}, w AS (SELECT doc_id, pos, string_split(trim(regexp_replace(text, '{WSZ_SQL}+', ' ', 'g')), ' ') AS w FROM items)
SELECT doc_id, pos, len(w) >= 4 AND len([x FOR x IN w IF length(x) <= 1]) >= 0.7 * len(w) AS noise FROM w""")
def ocr_noise(spark, sf_dir):
    """F13."""
    return lines(spark, sf_dir).select("doc_id", "pos", T.is_ocr_noise(F.col("text")).alias("noise"))


def _re2(pattern: str) -> str:
    """A fixed pattern for the oracle's engine."""
    return T.spaced(pattern).replace(r"\z", "$").replace("'", "''")


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, count(*) FILTER (regexp_matches(text, '{_re2(fixed.CAPTION)}')) AS captions, count(*) FILTER (regexp_matches(text, '{_re2(fixed.ORPHAN_CAPTION)}')) AS orphan_captions,
count(*) FILTER (regexp_matches(text, '{_re2(fixed.FOOTNOTE)}')) AS footnotes, count(*) FILTER (regexp_matches(text, '(?i){"|".join(map(_re2, fixed.PLACEHOLDERS))}')) AS placeholders,
count(*) FILTER (regexp_matches(text, '{_re2(fixed.PAGE_NUMBER)}')) AS page_numbers, count(*) FILTER ({" OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in fixed.RESOURCE_INDEX)}) AS resource_entries,
count(*) FILTER ({" OR ".join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(w.lower() for w in fixed.TOC_KEYWORDS))}) AS toc_keywords,
count(*) FILTER ({" OR ".join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(w.lower() for w in fixed.CONTINUATION_MARKERS))}) AS continuations FROM items GROUP BY doc_id""")
def line_kinds(spark, sf_dir):
    """F5-F8, F11, F12, F22."""
    t = F.col("text")
    rules = {"captions": T.looks_like_caption, "orphan_captions": T.looks_like_orphan_caption, "footnotes": T.looks_like_footnote, "placeholders": T.placeholder, "page_numbers": T.ends_in_page_number, "resource_entries": T.is_resource_index, "toc_keywords": T.is_toc_keyword, "continuations": T.is_continuation}
    return lines(spark, sf_dir).groupBy("doc_id").agg(*(F.count_if(f(t)).alias(n) for n, f in rules.items()))


@query("SELECT doc_id, " + ", ".join(f"array_to_string(list_slice(regexp_extract_all(text, '{_re2(p)}'), 1, 5), ';') AS {n}" for n, p in fixed.DOMAIN_PATTERNS.items()) + " FROM documents")
def domain_patterns(spark, sf_dir):
    """The first five hits of each pattern."""
    return I.read(spark, sf_dir, "documents").select("doc_id", *(F.array_join(T.domain_hits(F.col("text"), n), ";").alias(n) for n in fixed.DOMAIN_PATTERNS))


@query("""WITH c AS (SELECT doc_id, ['fr', 'EN', 'zh-Hant', 'xx', 'Ko', 'vi'][1 + doc_id % 6] AS code FROM documents)
SELECT doc_id, CASE WHEN code = 'fr' THEN 'fr-FR' WHEN code = 'EN' THEN 'en-US' WHEN code = 'zh-Hant' THEN 'zh-Hant' WHEN code = 'Ko' THEN 'ko-KR' WHEN code = 'vi' THEN 'vi-VT' END AS tag FROM c""")
def language_tags(spark, sf_dir):
    """F25."""
    codes = F.array(*map(F.lit, ("fr", "EN", "zh-Hant", "xx", "Ko", "vi")))
    return I.read(spark, sf_dir, "documents").select("doc_id", T.language_tag(F.get(codes, (F.col("doc_id") % 6).cast("int"))).alias("tag"))


@query("SELECT doc_id, lang, source, regexp_replace('log /srv/' || source || '/a.txt of ' || lang, '(?:/[A-Za-z0-9_.-]+){2,}', '[path]', 'g') AS masked, regexp_replace(source || ' ' || lang || '?', '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM documents")
def masked_names(spark, sf_dir):
    """F27, F30."""
    d = I.read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", T.masked_paths(F.concat(F.lit("log /srv/"), "source", F.lit("/a.txt of "), "lang")).alias("masked"), T.safe_name(F.concat("source", F.lit(" "), "lang", F.lit("?"))).alias("safe"))


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, pos, md5(replace(CASE WHEN instr(text, 'the') > 0 THEN substring(text, 1, instr(text, 'the') - 1) || 'THE' || substring(text, instr(text, 'the') + 3) ELSE text END, 'X', 'X')) AS fixed FROM items""")
def text_substitution(spark, sf_dir):
    """The first occurrence of each correction is replaced, literally and in turn."""
    subs = F.array(F.struct(F.lit("the").alias("f"), F.lit("THE").alias("r")), F.struct(F.lit("no such (text").alias("f"), F.lit("x").alias("r")))
    return lines(spark, sf_dir).select("doc_id", "pos", F.md5(T.substituted(F.col("text"), subs)).alias("fixed"))


@query()
def repetition_ratio(spark, sf_dir):
    """back-references, which the oracle's engine lacks."""
    return I.read(spark, sf_dir, "documents").select("doc_id", F.round(T.repetition_ratio(F.col("text")), 6).alias("ratio"))


@query(rf"""WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n(?:{WS_SQL}*\n)+')) AS b FROM documents)
SELECT doc_id, count(*) FILTER (t <> '') AS paragraphs, sum(length(t))::BIGINT AS chars FROM (SELECT doc_id, array_to_string([y FOR y IN [regexp_replace(regexp_replace(x, '^{WS_SQL}+', ''), '{WS_SQL}+$', '') FOR x IN string_split(b, chr(10))] IF y <> ''], ' ') AS t FROM b) GROUP BY doc_id""")
def paragraph_blocks(spark, sf_dir):
    """F18."""
    p = I.read(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


def _page_rows(spark, sf_dir) -> DataFrame:
    """Scanned pages with sizes and read page numbers: 50 orders a document."""
    c, page = F.col("o_custkey"), F.col("o_orderkey") % 50 + 1
    return I.read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 50).cast("long").alias("doc_id"), page.cast("long").alias("page"), (c % 50).cast("double").alias("w"), (c % 7).cast("double").alias("h"),
        F.when(c % 5 == 0, F.lit(0)).otherwise(page + c % 11 - 4).cast("long").alias("number"),
    )


_PAGES_SQL = """pages_ AS (SELECT o_orderkey // 50 AS doc_id, (o_orderkey % 50 + 1)::BIGINT AS page, (o_custkey % 50)::DOUBLE AS w, (o_custkey % 7)::DOUBLE AS h,
  (CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 + 1 + o_custkey % 11 - 4 END)::BIGINT AS number FROM orders)"""


@query(f"""WITH {_PAGES_SQL}, k AS (SELECT doc_id, page, floor(w / 5 + 0.5)::BIGINT || 'x' || floor(h / 5 + 0.5)::BIGINT AS size_key FROM pages_),
m AS (SELECT *, CASE WHEN lag(size_key) OVER d IS DISTINCT FROM size_key THEN 1 ELSE 0 END AS new FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM m)
SELECT doc_id, island::BIGINT AS island, size_key, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM i GROUP BY ALL""")
def page_size_islands(spark, sf_dir):
    """W2."""
    return pages.size_islands(_page_rows(spark, sf_dir).select("doc_id", "page", pages.size_key(F.col("w"), F.col("h")).alias("size_key"))).withColumn("island", F.col("island").cast("long"))


@query(f"""WITH {_PAGES_SQL}, v AS (SELECT doc_id, page, number, page - lag(page) OVER d AS dp, number - lag(number) OVER d AS dn, number - page AS o FROM pages_ WHERE number > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
s AS (SELECT doc_id, count(*) AS n, bool_and(dn = dp) AS same, bool_and(dn = 2 * dp) AS dbl, max(o) AS hi, min(o) AS lo, floor(avg(o) + 0.5)::BIGINT AS mean FROM v GROUP BY doc_id)
SELECT doc_id, n AS n_valid, CASE WHEN n < 2 THEN 'unknown' WHEN same THEN 'simple_increment' WHEN dbl THEN 'double_sided' WHEN hi - mean <= 1 AND mean - lo <= 1 THEN 'offset' ELSE 'unknown' END AS pattern, mean AS mean_offset FROM s""")
def page_pattern(spark, sf_dir):
    """W3, A13."""
    return pages.pattern(_page_rows(spark, sf_dir))


@query(f"""WITH {_PAGES_SQL}, f AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY page) AS prev FROM pages_),
d AS (SELECT doc_id, page, number, CASE WHEN number > 0 AND prev > 0 AND prev - number > 1 THEN page END AS fp, CASE WHEN number > 0 AND prev > 0 AND prev - number > 1 THEN number END AS fn FROM f),
l AS (SELECT doc_id, page, number, last_value(fp IGNORE NULLS) OVER w AS lp, last_value(fn IGNORE NULLS) OVER w AS ln FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, page, CASE WHEN lp IS NOT NULL THEN ln - (lp - page) ELSE number END AS number FROM l""")
def page_drop_repair(spark, sf_dir):
    """W7."""
    return pages.repair_drops(_page_rows(spark, sf_dir).select("doc_id", "page", "number"))


@query(f"""WITH {_PAGES_SQL}, s AS (SELECT doc_id, count(*) FILTER (number > 0) AS n, floor(avg(number - page) FILTER (number > 0) + 0.5)::BIGINT AS mean FROM pages_ GROUP BY doc_id)
SELECT doc_id, page, CASE WHEN number = 0 AND n >= 2 AND page + mean >= 1 THEN page + mean ELSE number END AS number FROM pages_ JOIN s USING (doc_id)""")
def page_backfill(spark, sf_dir):
    """W9."""
    return pages.backfill(_page_rows(spark, sf_dir).select("doc_id", "page", "number"))


@query(f"""WITH {_PAGES_SQL}, a AS (SELECT doc_id, page, number, lead(number) OVER d - number AS a, lead(number, 2) OVER d - lead(number) OVER d AS b FROM pages_ WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
r AS (SELECT doc_id, arg_min({{'page': page, 'number': number, 'step': a}}, page) AS r FROM a WHERE number > 0 AND a = b AND a IN (1, 2) GROUP BY doc_id)
SELECT p.doc_id, p.page, CASE WHEN p.page < r.page AND p.number > r.number - (r.page - p.page) * r.step + 10 THEN 0 ELSE p.number END AS number FROM pages_ p LEFT JOIN r ON p.doc_id = r.doc_id""")
def page_outliers(spark, sf_dir):
    """W5, W6."""
    return pages.drop_outliers(_page_rows(spark, sf_dir).select("doc_id", "page", "number"))


@query(f"""WITH {_PAGES_SQL}, n AS (SELECT doc_id, max(page) AS n FROM pages_ GROUP BY doc_id), c AS (SELECT doc_id, n, greatest(ceil(n * 0.1), 1)::BIGINT AS cut FROM n),
r AS (SELECT doc_id, n, cut + 1 AS lo, n - cut AS hi, n - 2 * cut AS size FROM c)
SELECT doc_id, unnest(CASE WHEN size <= 0 THEN [ceil(n / 2.0)::BIGINT] ELSE [(lo + floor(i * size / least(size, 15)))::BIGINT FOR i IN range(0, least(size, 15))] END) AS page FROM r""")
def page_samples(spark, sf_dir):
    """L8."""
    return pages.sample_pages(_page_rows(spark, sf_dir))


def _entries(spark, sf_dir) -> DataFrame:
    """Contents entries with parents: every third entry is the parent of the two after it; some pages are shifted."""
    t = I.toc(lines(spark, sf_dir))
    return t.select("doc_id", "k", F.when(F.col("k") % 3 != 0, F.col("k") - F.col("k") % 3).alias("parent"), F.substring("title", 1, 220).alias("title"), (F.col("start_page") + F.when(F.col("k") % 7 == 5, -9).otherwise(0)).cast("long").alias("page"))


_ENTRIES_SQL = f"""{I.ITEMS_SQL}, {I.TOC_SQL}, e AS (SELECT doc_id, k, CASE WHEN k % 3 <> 0 THEN k - k % 3 END AS parent, substring(title, 1, 220) AS title, start_page + CASE WHEN k % 7 = 5 THEN -9 ELSE 0 END AS page FROM toc),
tp AS (SELECT doc_id, max(page_no) AS total_pages FROM items GROUP BY doc_id)"""


@query(f"""WITH {_ENTRIES_SQL}, j AS (SELECT e.*, total_pages, p.page AS parent_page, coalesce(lag(e.page) OVER (PARTITION BY e.doc_id, e.parent ORDER BY e.k), p.page) AS prev,
  row_number() OVER (PARTITION BY e.doc_id, e.title, e.page ORDER BY e.k) AS copy, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.k) AS first FROM e JOIN tp USING (doc_id) LEFT JOIN e p ON p.doc_id = e.doc_id AND p.k = e.parent)
SELECT doc_id, k, 'V001' AS code FROM j WHERE page < prev UNION ALL SELECT doc_id, k, 'V002' FROM j WHERE page < 1 OR page > total_pages UNION ALL SELECT doc_id, k, 'V003' FROM j WHERE trim(title) = ''
UNION ALL SELECT doc_id, k, 'V004' FROM j WHERE length(trim(title)) > 200 UNION ALL SELECT doc_id, k, 'V005' FROM j WHERE page < parent_page UNION ALL SELECT doc_id, k, 'V006' FROM j WHERE copy > 1
UNION ALL SELECT doc_id, k, 'V007' FROM j WHERE first = 1 AND page > greatest(50, floor(total_pages * 0.3))""")
def toc_validate(spark, sf_dir):
    """V1, W13, W14."""
    total = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))
    return toc.issues(_entries(spark, sf_dir), total)


@query(f"""WITH {_ENTRIES_SQL}, t AS (SELECT e.doc_id, e.k, CASE WHEN e.parent IS NULL THEN printf('%06d', e.k) ELSE printf('%06d', e.parent) || '/' || printf('%06d', e.k) END AS path, CASE WHEN e.parent IS NULL THEN 1 ELSE 2 END AS level FROM e)
SELECT doc_id, k, level::BIGINT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS preorder FROM t""")
def toc_tree(spark, sf_dir):
    """Preorder and levels of the contents tree."""
    e = _entries(spark, sf_dir).select("doc_id", F.col("k").alias("id"), "parent", F.col("k").alias("ordinal"))
    return chapters.subtree(e).select("doc_id", F.col("id").alias("k"), F.col("level").cast("long").alias("level"), F.col("preorder").cast("long").alias("preorder"))


@query(f"""WITH {_ENTRIES_SQL}, m AS (SELECT doc_id, string_agg(substring(title, 1, 20) || ' .... ' || start_page, chr(10) ORDER BY k) AS md FROM toc GROUP BY doc_id)
SELECT doc_id, coalesce(list_max([x::INT FOR x IN regexp_extract_all(md, '\\.{{2,}}[ \\t]*(\\d+)', 1)]), 0)::BIGINT AS max_page FROM m""")
def toc_max_page(spark, sf_dir):
    """A21."""
    t = I.toc(lines(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.substring("title", 1, 20), F.lit(" .... "), F.col("start_page").cast("string")).alias("x")))).alias("r"))
    return t.select("doc_id", toc.max_page(F.array_join(F.transform("r", lambda r: r["x"]), "\n")).cast("long").alias("max_page"))


@query(f"""WITH {I.ITEMS_SQL}, r AS (SELECT doc_id, pos, '#/texts/' || (pos + CASE WHEN pos % 5 = 0 THEN 3 ELSE 0 END) AS ref FROM items)
SELECT r.doc_id, r.pos, r.ref FROM r ANTI JOIN items i ON i.doc_id = r.doc_id AND i.self_ref = r.ref""")
def ref_integrity(spark, sf_dir):
    """References that point nowhere."""
    i = lines(spark, sf_dir)
    r = i.select("doc_id", "pos", F.concat(F.lit("#/texts/"), (F.col("pos") + F.when(F.col("pos") % 5 == 0, 3).otherwise(0)).cast("string")).alias("ref"))
    return nodes.unresolved(r, i)


@query(f"""WITH RECURSIVE {I.ITEMS_SQL}, n AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN NULL ELSE pos - pos % 4 END AS parent FROM items),
w AS (SELECT doc_id, pos, printf('%06d', pos) AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.pos, w.path || '/' || printf('%06d', n.pos) FROM n JOIN w ON n.doc_id = w.doc_id AND n.parent = w.pos)
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS reading_order FROM w""")
def reading_order(spark, sf_dir):
    """Depth-first order of containers and their children."""
    n = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("id"), F.when(F.col("pos") % 4 != 0, F.col("pos") - F.col("pos") % 4).alias("parent"), F.col("pos").alias("ordinal"))
    return nodes.reading_order(n).select("doc_id", F.col("id").alias("pos"), F.col("reading_order").cast("long").alias("reading_order"))


@query(f"""WITH {I.ITEMS_SQL}, c AS (SELECT doc_id, page_no // 10 AS chunk, count(*) FILTER (label = 'text') AS texts, count(*) FILTER (label = 'list_item') AS lists FROM items GROUP BY ALL)
SELECT doc_id, chunk, coalesce(sum(texts) OVER w, 0)::BIGINT AS text_offset, coalesce(sum(lists) OVER w, 0)::BIGINT AS list_offset FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chunk_merge_offsets(spark, sf_dir):
    """W11."""
    c = lines(spark, sf_dir).groupBy("doc_id", F.floor(F.col("page_no") / 10).cast("long").alias("chunk")).agg(F.count_if(F.col("label") == "text").alias("texts"), F.count_if(F.col("label") == "list_item").alias("lists"))
    return nodes.chunk_offsets(c, {"texts": "text_offset", "lists": "list_offset"})


@query(f"""WITH {I.ITEMS_SQL}, c AS (SELECT doc_id, pos, page_no // 10 AS chunk, label, row_number() OVER (PARTITION BY doc_id, page_no // 10 ORDER BY pos) - 1 AS n FROM items),
o AS (SELECT doc_id, chunk, coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT doc_id, chunk, count(*) AS m FROM c GROUP BY ALL))
SELECT doc_id, pos, '#/texts/' || (n + off) AS ref FROM c JOIN o USING (doc_id, chunk)""")
def chunk_merge_refs(spark, sf_dir):
    """References of merged chunks."""
    c = lines(spark, sf_dir).withColumn("chunk", F.floor(F.col("page_no") / 10).cast("long"))
    c = c.withColumn("ref", F.concat(F.lit("#/texts/"), (F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("pos")) - 1).cast("string")))
    o = nodes.chunk_offsets(c.groupBy("doc_id", "chunk").agg(F.count("*").alias("texts")), {"texts": "off"})
    return c.join(o, ["doc_id", "chunk"]).select("doc_id", "pos", nodes.shifted_ref(F.col("ref"), "texts", F.col("off")).alias("ref"))


@query(f"""WITH {I.ITEMS_SQL}, c AS (SELECT doc_id, pos, page_no, CASE WHEN label = 'list_item' THEN self_ref END AS media, label FROM items)
SELECT doc_id, pos, last_value(media IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM c""")
def caption_asof_preceding(spark, sf_dir):
    """The nearest medium before each line on its page."""
    i = lines(spark, sf_dir).withColumn("media", F.when(F.col("label") == "list_item", F.col("self_ref")))
    return nodes.preceding_on_page(i, "media", "target").select("doc_id", "pos", "target")


@query(f"""WITH {I.ITEMS_SQL}, t AS (SELECT doc_id, page_no, string_agg(lower(regexp_replace(text, '{WS_SQL}+', '', 'g')), '' ORDER BY pos) AS body FROM items WHERE label = 'list_item' GROUP BY ALL),
w AS (SELECT doc_id, pos, page_no, lower(regexp_replace(split_part(text, ' ', 1), '{WS_SQL}+', '', 'g')) AS word FROM items WHERE label = 'text')
SELECT w.doc_id, w.pos FROM w LEFT JOIN t USING (doc_id, page_no) WHERE t.body IS NULL OR NOT contains(t.body, w.word)""")
def containment_filter(spark, sf_dir):
    """Lines whose first word isn't in the page's table text."""
    i = lines(spark, sf_dir)
    squeeze = lambda c: T.spaceless(c, lower=True)
    tables = i.where("label = 'list_item'").select("doc_id", "page_no", "pos", squeeze(F.col("text")).alias("text"))
    blocks = i.where("label = 'text'").select("doc_id", "pos", "page_no", squeeze(F.split("text", " ")[0]).alias("text"))
    return nodes.not_contained(blocks, tables).select("doc_id", "pos")


@query(f"""WITH {I.ITEMS_SQL}, c AS (SELECT doc_id, pos, x - 1 AS col, trim(cells[x]) AS cell FROM (SELECT doc_id, pos, string_split(text, ' | ') AS cells, unnest(range(1, len(string_split(text, ' | ')) + 1)) AS x FROM items WHERE label = 'list_item'))
SELECT doc_id, count(DISTINCT pos) AS n_rows, max(col) + 1 AS n_cols, round(count(*) FILTER (cell = '') / count(*)::DOUBLE, 6) AS empty_ratio, count(DISTINCT pos) >= 3 AND max(col) >= 1 AS grid_like FROM c GROUP BY doc_id""")
def table_shape(spark, sf_dir):
    """Rows, columns and empty cells of the lines that are table rows."""
    c = lines(spark, sf_dir).where("label = 'list_item'").select("doc_id", "pos", F.posexplode(F.split("text", r" \| ")).alias("col", "cell"))
    return c.groupBy("doc_id").agg(F.countDistinct("pos").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"), F.round(F.count_if(F.trim("cell") == "") / F.count("*"), 6).alias("empty_ratio"), ((F.countDistinct("pos") >= 3) & (F.max("col") >= 1)).alias("grid_like"))


@query(f"""WITH {I.ITEMS_SQL}, {I.TOC_SQL}, r AS (SELECT doc_id, k, start_page, start_page + k % 4 + 1 AS end_page FROM toc), p AS (SELECT DISTINCT doc_id, page_no FROM items)
SELECT p.doc_id, p.page_no, arg_min(r.k, (r.end_page - r.start_page) * 1000000 + r.k) AS k FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.start_page AND r.end_page GROUP BY ALL""")
def nav_page_to_chapter(spark, sf_dir):
    """J21."""
    i = lines(spark, sf_dir)
    r = I.toc(i).select("doc_id", "k", "start_page", (F.col("start_page") + F.col("k") % 4 + 1).alias("end_page"))
    return chapters.smallest_containing(i.select("doc_id", "page_no").distinct(), r)


@query(f"""WITH {I.ITEMS_SQL}, r AS (SELECT doc_id, page_no AS pdf_page, 2 * page_no - 1 AS s, 2 * page_no + page_no % 2 AS e FROM (SELECT DISTINCT doc_id, page_no FROM items))
SELECT doc_id, page, min(pdf_page) AS first_pdf_page, count(*) AS n_pdf_pages FROM (SELECT doc_id, pdf_page, unnest(range(s, e + 1)) AS page FROM r) GROUP BY ALL""")
def doc_page_inverse(spark, sf_dir):
    """J20."""
    p = lines(spark, sf_dir).select("doc_id", F.col("page_no").alias("pdf_page")).distinct()
    return chapters.inverse_pages(p.select("doc_id", "pdf_page", (2 * F.col("pdf_page") - 1).alias("start_page"), (2 * F.col("pdf_page") + F.col("pdf_page") % 2).alias("end_page")))


@query(f"""WITH {I.ITEMS_SQL}, {I.TOC_SQL}, ranges AS (SELECT doc_id, k, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, k) - 1, 9007199254740991) AS end_page FROM toc)
SELECT i.doc_id, r.k, min(page_no) AS first_page, max(page_no) AS last_page, array_to_string(list_sort(list_distinct(list(page_no))), ',') AS pages FROM items i JOIN ranges r ON i.doc_id = r.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY ALL""")
def chapter_pages(spark, sf_dir):
    """A19, A20."""
    i = lines(spark, sf_dir)
    hit = chapters.assign(i, chapters.chapter_ranges(I.toc(i)))
    return hit.groupBy("doc_id", "k").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.array_join(F.array_sort(F.collect_set("page_no")), ",").alias("pages"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1) AS h, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)
SELECT page_id, len(h)::BIGINT AS n_headings, len(l)::BIGINT AS n_items, coalesce(length(h[1]), 0)::BIGINT AS heading_chars FROM x""")
def pages_html_extract(spark, sf_dir):
    """What stands in chosen elements of raw pages."""
    x = I.read(spark, sf_dir, "pages").select("page_id", *(F.regexp_extract_all("html", F.lit(f"<{t}>(.*?)</{t}>"), F.lit(1)).alias(n) for t, n in (("h1", "h"), ("li", "l"))))
    return x.select("page_id", F.size("h").cast("long").alias("n_headings"), F.size("l").cast("long").alias("n_items"), F.coalesce(F.length(F.get("h", F.lit(0))), F.lit(0)).cast("long").alias("heading_chars"))
