"""Text expressions: every function takes and returns columns, so that Catalyst sees through them.

White space is spelled out as a class, because engines disagree on what ``\\s`` holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions import fixed

#: All white space, for use inside a character class.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

HANGUL, KANA, LATIN, CJK = r"\x{AC00}-\x{D7AF}", r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}", "A-Za-z", r"\x{4E00}-\x{9FFF}"


def spaced(pattern: str) -> str:
    """The pattern with its white space spelled out."""
    return pattern.replace(r"[.:)\s]", f"[.:){WS}]").replace(r"[\d\s.,]", f"[\\d{WS}.,]").replace(r"\s", f"[{WS}]")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition. Pure ASCII text, which it can't change, doesn't leave the JVM."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfc(F.when(wide, text))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{WS}]+", ""), f"[{WS}]+\\z", "")


def collapsed(text: Column) -> Column:
    """F1 without composition: odd spaces, line ends and runs of white space become one space; trimmed; null becomes ''."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}\\x{{200B}}]+", " ")
    return F.trim(spaced)


def normalize(text: Column) -> Column:
    """F1."""
    return collapsed(nfc(text))


def clean_punctuation(text: Column) -> Column:
    """leading punctuation with what space follows goes; at the end only white space with the punctuation after it."""
    front = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[,.:;!?]+[{WS}]*", "")
    return F.regexp_replace(front, f"[{WS}]+[,.:;!?]*\\z", "")


def is_valid(text: Column) -> Column:
    """something other than digits and white space is left."""
    return ~collapsed(text).rlike(r"^[0-9 ]*\z")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """a word of the list, none of which begins or ends in white space, stands in the text, both in lower case; one pass over the text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(re.escape(w) for w in dict.fromkeys(w.lower() for w in words)))


def is_toc_keyword(text: Column) -> Column:
    """F5."""
    return contains_any(text, fixed.TOC_KEYWORDS)


def is_continuation(text: Column) -> Column:
    """F6."""
    return contains_any(text, fixed.CONTINUATION_MARKERS)


def is_resource_index(text: Column) -> Column:
    """F8: the text begins as an entry of a list of figures, plates or tables does."""
    found = F.lit(False)
    for p in fixed.RESOURCE_INDEX:
        found = found | text.rlike(spaced(p))
    return found


def ends_in_page_number(text: Column) -> Column:
    """dot leaders, ellipses or white space, then digits at the end."""
    return text.rlike(spaced(fixed.PAGE_NUMBER))


def reanchored_number(full: Column, number: Column) -> Column:
    """the number as it is written in the caption: exact, else ignoring case, else as given."""
    at, low = F.instr(full, number), F.instr(F.lower(full), F.lower(number))
    return F.when(at > 0, number).when(low > 0, F.substring(full, low, F.length(number))).otherwise(number)


def caption_number(full: Column) -> Column:
    """the leading label and number of a caption by rule, null where there is none."""
    found = F.regexp_extract(full, r"^\s*[\[(<〈【]?\s*((?:[A-Za-z]+\.?|[\x{AC00}-\x{D7AF}]+|[圖図表])\s*\d+(?:[-–.]\d+)*)", 1)
    return F.when(found != "", found)


def looks_like_caption(text: Column) -> Column:
    """a label of a figure, table, photo or plate at the start, with a number."""
    return text.rlike(spaced(fixed.CAPTION))


def looks_like_orphan_caption(text: Column) -> Column:
    """F11, in the wording that orphan captions are scored by; the number may be missing."""
    return text.rlike(spaced(fixed.ORPHAN_CAPTION))


def looks_like_footnote(text: Column) -> Column:
    """a number with bracket or full stop, or a reference mark, at the start, and text after it."""
    return text.rlike(spaced(fixed.FOOTNOTE))


def footnote_marker(text: Column) -> Column:
    found = F.regexp_extract(trimmed(text), fixed.FOOTNOTE_MARKER, 1)
    return F.when(found != "", found)


def is_ocr_noise(text: Column) -> Column:
    """four words or more, of which seven in ten are single characters."""
    words = F.split(collapsed(text), " ")
    return (F.size(words) >= 4) & (F.size(F.filter(words, lambda w: F.length(w) <= 1)) >= 0.7 * F.size(words))


def domain_hits(text: Column, name: str, most: int = 5) -> Column:
    """the first matches of a pattern."""
    return F.slice(F.regexp_extract_all(text, F.lit(spaced(fixed.DOMAIN_PATTERNS[name])), F.lit(0)), 1, most)


def hanja_candidates(text: Column, most: int = 5) -> Column:
    """distinct bracketed stretches that look like misread ideographs, in a text where ideographs are likely."""
    likely = text.rlike("[一-龯]") | text.rlike(fixed.HANJA_MARK) | (text.rlike("[가-힣]") & text.rlike(fixed.HANJA_CONTEXT))

    def hits(pattern: str) -> Column:
        whole, inner = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
        pairs = F.filter(F.arrays_zip(whole.alias("whole"), inner.alias("inner")), lambda x: (trimmed(x["inner"]) != "") & ~trimmed(x["inner"]).rlike(spaced(fixed.HANJA_NUMERIC)) & trimmed(x["inner"]).rlike(fixed.HANJA_NOISE))
        return F.transform(pairs, lambda x: x["whole"])

    none = F.array().cast("array<string>")
    mark = F.regexp_extract(text, f"({fixed.HANJA_MARK})", 1)
    found = F.concat(F.when(likely, F.concat(hits(fixed.HANJA_BRACKETED), hits(fixed.HANJA_OPEN))).otherwise(none), F.when(mark != "", F.array(mark)).otherwise(none))
    return F.slice(F.array_distinct(found), 1, most)


def unit_hints(text: Column, most: int = 20) -> Column:
    """F16: distinct units in brackets."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\((?:단위\s*:\s*)?(cm|mm|km|kg|m|g|%)\)"), F.lit(1))), 1, most)


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common characters of pairs of texts; null if either is."""

    def count(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        there = Counter(y)
        return sum(min(n, there[c]) for c, n in Counter(x).items() if c in there)

    return pd.Series([count(x, y) for x, y in zip(a, b)], dtype="Int64")


def char_overlap(a: Column, b: Column) -> Column:
    """common characters counted with repetition, over the longer text's length; 0 if either is empty.

    Characters are counted in one pass over each text, a batch of rows at a time, whatever the number of kinds.
    """
    shared = F.pandas_udf(_shared, "long")(a, b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(shared / F.greatest(F.length(a), F.length(b)).cast("double"))


def paragraphs(text: Column) -> Column:
    """lines trimmed and joined by a space; blank lines part paragraphs."""
    blocks = F.split(F.coalesce(text, F.lit("")), rf"\n(?:[{WS}]*\n)+")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), trimmed), lambda x: x != ""), " "))
    return F.filter(joined, lambda x: x != "")


def spaceless(text: Column, lower: bool = False) -> Column:
    """F19."""
    out = F.regexp_replace(text, f"[{WS}]+", "")
    return F.lower(out) if lower else out


def half_up(x: Column, digits: int = 0) -> Column:
    """rounding to the nearest, halves upwards."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def placeholder(text: Column) -> Column:
    """filler text."""
    return text.rlike("(?i)" + "|".join(map(spaced, fixed.PLACEHOLDERS)))


def meta_description(text: Column) -> Column:
    """text about the image instead of the text in it."""
    return text.rlike("|".join(map(spaced, fixed.META_KOREAN))) | text.rlike("(?i)" + "|".join(fixed.META_ENGLISH))


def script_anomaly(text: Column, language: str) -> Column:
    """a long Korean page with hardly any Hangul or ideographs."""
    if language != "ko":
        return F.lit(False)
    ink = F.length(spaceless(text))
    native = F.regexp_count(text, F.lit(f"[{HANGUL}{CJK}]"))
    return (ink >= 20) & (native < 0.1 * ink)


def repetition_ratio(text: Column) -> Column:
    """the share of the text in runs of five or more equal characters parted by white space."""
    runs = F.regexp_extract_all(text, F.lit(r"(\S)(?:\s+\1){4,}"), F.lit(0))
    total = F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r))
    return F.coalesce(F.try_divide(total.cast("double"), F.length(text)), F.lit(0.0))


LANGUAGE_NAMES = {"ko": "Korean", "en": "English", "ja": "Japanese", "zh": "Chinese", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian"}


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def language_tag(code: Column) -> Column:
    """a known tag stays, a bare code becomes its default tag, anything else null."""
    return F.when(code.isin(*fixed.LANGUAGE_TAGS), code).otherwise(_lookup(F.lower(code), fixed.DEFAULT_TAGS))


def language_name(code: Column) -> Column:
    """F26."""
    return F.coalesce(_lookup(F.lower(F.split(code, "-")[0]), LANGUAGE_NAMES), code)


def masked_paths(text: Column) -> Column:
    """file paths and long base64 stretches are hidden."""
    return F.regexp_replace(F.regexp_replace(text, r"(?:/[\w.-]+){2,}", "[path]"), r"[A-Za-z0-9+/=]{240,}", "[base64]")


@F.pandas_udf(StringType())
def _sorted_json(s: pd.Series) -> pd.Series:
    import json

    return s.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")


def canonical_json(text: Column) -> Column:
    """the same JSON with the keys of all objects, nested ones too, in order."""
    return _sorted_json(text)


def decision_id(op: Column, target: Column, payload: Column) -> Column:
    """a short digest of a command in canonical form; the payload may be a string, a struct or a map."""
    whole = F.to_json(F.struct(op.alias("op"), payload.alias("payload"), target.alias("target")))
    return F.substring(F.sha1(canonical_json(whole)), 1, 12)


def work_item_id(kind: Column, refs: Column) -> Column:
    """kind and refs with unusual characters replaced; beyond 180 characters cut to 160 and the length put behind."""
    joined = F.concat_ws(":", kind, F.array_join(F.transform(refs, lambda r: F.regexp_replace(r, r"[^A-Za-z0-9_-]+", "_")), "+"))
    return F.when(F.length(joined) > 180, F.concat(F.substring(joined, 1, 160), F.lit("-"), F.length(joined).cast("string"))).otherwise(joined)


def safe_name(text: Column) -> Column:
    """F30."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def markdown_cell(text: Column) -> Column:
    """F31."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def list_marker(marker: Column, enumerated: Column, number: Column) -> Column:
    """the marker itself, a number for enumerated items, else a dash."""
    return F.when(F.coalesce(marker, F.lit("")) != "", F.concat(marker, F.lit(" "))).when(F.coalesce(enumerated, F.lit(False)), F.concat(number.cast("string"), F.lit(". "))).otherwise(F.lit("- "))


def is_enumerated(text: Column) -> Column:
    """F32."""
    return text.rlike(r"^\d+[.)]")


def substituted(text: Column, subs: Column) -> Column:
    """each (f, r) of the array replaces the first literal occurrence of f, one after the other."""

    def once(t: Column, s: Column) -> Column:
        at = F.instr(t, s["f"])
        done = F.concat(F.substring(t, F.lit(1), at - 1), s["r"], F.substring(t, at + F.length(s["f"]), F.length(t)))
        return F.when((at > 0) & (F.length(s["f"]) > 0), done).otherwise(t)

    return F.aggregate(subs, text, once)


def provider_of(name: Column) -> Column:
    """the first known provider that a provider's name contains."""
    out = F.lit("unknown")
    for mark, provider in reversed(fixed.PROVIDERS):
        out = F.when(name.contains(mark), F.lit(provider)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))