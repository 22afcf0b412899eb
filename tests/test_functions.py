from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()[0]


def test_normalize(spark):
    t = lambda s: one(spark, T.normalize(F.col("t")), t=s)
    assert t("  é a\t\tb\r\n\nc​d　﻿ ") == "é a b c d"
    assert t(None) == "" and t("") == ""
    assert t(t("  a \n b ")) == "a b"


def test_clean_punctuation(spark):
    t = lambda s: one(spark, T.clean_punctuation(F.col("t")), t=s)
    assert t(",. a b.") == "a b."  # only punctuation after white space goes at the end
    assert t("a b ,.") == "a b"


def test_valid(spark):
    t = lambda s: one(spark, T.is_valid(F.col("t")), t=s)
    assert not t("12 3\n") and not t("") and not t(None) and t("12a")


def test_lines(spark):
    c = lambda f, s: one(spark, f(F.col("t")), t=s)
    assert c(T.ends_in_page_number, "Intro ..... 12") and c(T.ends_in_page_number, "a 3 ") and not c(T.ends_in_page_number, "a3x")
    assert c(T.looks_like_caption, "Fig. 3 A pit") and c(T.looks_like_caption, "도면 12") and not c(T.looks_like_caption, "Figures of speech")
    assert c(T.looks_like_footnote, "1) see") and not c(T.looks_like_footnote, "1985 was")
    assert c(T.is_ocr_noise, "a b c de") and not c(T.is_ocr_noise, "ab cd ef g")
    assert c(T.footnote_marker, " † note") == "†"
    assert c(T.hanja_candidates, "산성(LL|)과") == ["(LL|)", "LL|)"] or c(T.hanja_candidates, "산성(LL|)과") == ["(LL|)", "(LL|)"[1:]]
    assert c(T.hanja_candidates, "plain (LL|) text") == []


def test_overlap_counts_repeats(spark):
    t = lambda a, b: one(spark, T.char_overlap(F.col("a"), F.col("b")), a=a, b=b)
    assert t("aab", "abb") == 2 / 3 and t("", "a") == 0 and t("abc", "abc") == 1


def test_repetition(spark):
    assert one(spark, T.repetition_ratio(F.col("t")), t="a a a a a b") == 9 / 11
    assert one(spark, T.repetition_ratio(F.col("t")), t="") == 0


def test_paragraphs(spark):
    assert one(spark, T.paragraphs(F.col("t")), t="a \n b\n \nc\n\n\n d") == ["a b", "c", "d"]


def test_half_up(spark):
    assert one(spark, T.half_up(F.col("x")), x=-2.5) == -2 and one(spark, T.half_up(F.col("x")), x=2.5) == 3


def test_languages(spark):
    t = lambda s: one(spark, T.language_tag(F.col("t")), t=s)
    assert t("zh-Hant") == "zh-Hant" and t("KO") == "ko-KR" and t("xx") is None


def test_substitution_is_literal_and_in_turn(spark):
    subs = F.array(F.struct(F.lit("a.b").alias("f"), F.lit("x").alias("r")), F.struct(F.lit("x").alias("f"), F.lit("$1").alias("r")))
    assert one(spark, T.substituted(F.col("t"), subs), t="aab a.b a.b") == "aab $1 a.b"


def test_markers(spark):
    assert one(spark, T.markdown_cell(F.col("t")), t=" a|b\nc ") == "a\\|b c"
    assert one(spark, T.list_marker(F.col("m"), F.lit(None).cast("boolean"), F.lit(1)), m=None) == "- "
    assert one(spark, T.work_item_id(F.lit("k"), F.array(F.col("t"))), t="#/" + "a" * 200).endswith("-203")


def boxed(l, t, r, b, origin):
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("ltrb", (l, t, r, b))), F.lit(origin).alias("coord_origin"))


def test_geometry(spark):
    v = lambda e: spark.range(1).select(e.alias("x")).first()[0]
    assert tuple(v(G.top_left(boxed(1, 90, 3, 80, "BOTTOMLEFT"), F.lit(100.0)))) == (1, 10, 3, 20)
    r = lambda *a: F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), a)))
    assert v(G.containment(r(0, 0, 2, 2), r(1, 0, 9, 9))) == 0.5 and v(G.containment(r(1, 1, 1, 1), r(0, 0, 2, 2))) == 0
    assert v(G.iou(r(0, 0, 2, 2), r(1, 0, 3, 2))) == 1 / 3
    warn = lambda *a: v(G.bbox_warning(boxed(*a), F.lit(100.0), F.lit(100.0)))
    assert warn(5, 5, 1, 9, "TOPLEFT") == "invalid_order" and warn(1, 1, 200, 9, "TOPLEFT") == "outside_page"
    assert warn(1, 1, 2, 2, "TOPLEFT") == "too_small" and warn(1, 1, 50, 50, "TOPLEFT") is None
    assert v(G.snap_confidence(F.lit(0.1))) == 0.6 and v(G.snap_confidence(F.lit(0.5))) == 0.9
