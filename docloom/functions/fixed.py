"""Word lists, patterns and tables that results must agree on. White space classes are filled in by ``text``."""

# fixed values
TOC_KEYWORDS = ("목차", "차례", "목 차", "目录", "目 录", "内容", "內容", "目次", "目 次", "Contents", "Table of Contents", "TABLE OF CONTENTS", "CONTENTS")

# fixed values
CONTINUATION_MARKERS = (
    "목차(계속)", "목차 (계속)", "(계속)", "目录(续)", "目录 (续)", "(续)", "续表", "目次(続)", "目次 (続)", "(続)",
    "(continued)", "(Continued)", "(CONTINUED)", "continued",
)

# fixed values
PAGE_NUMBER = r"\.{2,}\s*\d+\s*\z|…+\s*\d+\s*\z|\s+\d+\s*\z"

# fixed values
RESOURCE_INDEX = (
    r"^\[도면\s*\d+\]", r"^\[사진\s*\d+\]", r"^\[표\s*\d+\]", r"^\[그림\s*\d+\]", r"^도면\s*\d+[.:)\s]", r"^사진\s*\d+[.:)\s]", r"^표\s*\d+[.:)\s]",
    r"(?i)^Fig\.\s*\d+", r"(?i)^Photo\.?\s*\d+", r"(?i)^Plate\s*\d+", r"(?i)^Map\s*\d+", r"^圖\s*\d+",
)

# fixed values
CAPTION = r"(?i)^(?:도면|도판|사진|삽도|그림|표|Fig\.?|Figure|Plate|Photo|Table)\s*[\dⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ-]"
ORPHAN_CAPTION = r"(?i)^(?:fig(?:ure)?\.?|photo|plate|drawing|table|도면|사진|그림|삽도|표)\s*[\dⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ-]*[.)．:]?"
FOOTNOTE = r"^(?:\d+[).]|[*†‡])\s*\S+"
FOOTNOTE_MARKER = r"^(\d+[).]|[*†‡])"

# fixed values: of each kind at most the first five hits count
DOMAIN_PATTERNS = {
    "roman_numeral": r"[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]",
    "layer_code": r"(?i)(?:layer|stratum|strat(?:igraphic)?\s?unit|SU|locus|context|deposit|층위|토층|[A-Z]-?\d{1,3})",
    "unit": r"(?i)\d+(?:\.\d+)?\s?(?:cm|m|㎝|㎡|m²)",
    "feature_number": r"(?i)(?:feature|pit|ditch|burial|tomb|grave|wall|kiln|hearth|house|structure|trench|locus|context|unit|遺構|住居|墓|窯|溝|土坑|竪穴|주거지|수혈|토광묘|유구|구상유구)\s?(?:no\.?|#)?\s?\d*",
    "hanja_term": r"[一-龯]+",
    "institution_name": r"(?i)(?:institute|university|museum|foundation|archaeolog(?:y|ical)|heritage|research|center|centre|文化財|硏究院|博物館|研究所|財團|財|株|社|문화재연구원|박물관|연구소)",
}

# fixed values: readings of ideographs gone wrong, in brackets or before one, and the words they stand with
HANJA_BRACKETED = r"[（(]([A-Za-z0-9Il|!*_+\-=\\/?:;,. ]{1,16})[）)]"
HANJA_OPEN = r"([A-Za-z0-9Il|!*_+\-=\\/?:;,.]{3,16})[）)]"
HANJA_MARK = r"[（(](?:주|재|사)[）)]"
HANJA_NUMERIC = r"(?i)^[\d\s.,]+(?:cm|m|km|㎝|㎡|㎢|m²)?\z"
HANJA_NOISE = r"[A-ZIl|!*_+\-=\\/?:;]|\d[A-Za-z]"
HANJA_CONTEXT = (
    "산|봉|강|천|교|동|리|면|읍|사|성|묘|요|유적|유물|문화재|연구원|재단|분지|층|토기|구릉|범람|고분|성곽|유구|기관|조사|지역|지형|고도|하천|시대|읍성|사찰|향교|서원|군|시|구|마을"
)

# fixed values
PLACEHOLDERS = (r"lorem\s+ipsum", r"dolor\s+sit\s+amet", r"consectetur\s+adipiscing", r"sed\s+do\s+eiusmod", r"ut\s+labore\s+et\s+dolore")
META_KOREAN = (r"이미지\s*해상도", r"판독하기?\s*어렵", r"해상도가?\s*(매우\s*)?(낮|부족)", r"텍스트를?\s*판독", r"글자를?\s*읽기?\s*어렵", r"정확한?\s*판독이?\s*(불가|어렵)")
META_ENGLISH = (
    "the image contains", "unable to (read|transcribe)", "resolution.*(too low|insufficient)", "cannot (read|make out|decipher)",
    "text is (not |un)?(legible|readable)", "exact transcription is not possible",
)

# fixed values
LANGUAGE_TAGS = (
    "ar-SA", "ars-SA", "cs-CZ", "da-DK", "de-DE", "en-US", "es-ES", "fr-FR", "id-ID", "it-IT", "ja-JP", "ko-KR", "ms-MY", "nb-NO", "nl-NL",
    "nn-NO", "no-NO", "pl-PL", "pt-BR", "ro-RO", "ru-RU", "sv-SE", "th-TH", "tr-TR", "uk-UA", "vi-VT", "yue-Hans", "yue-Hant", "zh-Hans", "zh-Hant",
)
DEFAULT_TAGS = {
    "ar": "ar-SA", "cs": "cs-CZ", "da": "da-DK", "de": "de-DE", "en": "en-US", "es": "es-ES", "fr": "fr-FR", "id": "id-ID", "it": "it-IT",
    "ja": "ja-JP", "ko": "ko-KR", "ms": "ms-MY", "nl": "nl-NL", "no": "no-NO", "pl": "pl-PL", "pt": "pt-BR", "ro": "ro-RO", "ru": "ru-RU",
    "sv": "sv-SE", "th": "th-TH", "tr": "tr-TR", "uk": "uk-UA", "vi": "vi-VT", "zh": "zh-Hans",
}

# fixed values: the first that a provider's name contains
PROVIDERS = (("openai", "openai"), ("google", "google"), ("anthropic", "anthropic"), ("together", "togetherai"), ("ollama", "ollama"), ("lmstudio", "lmstudio"))

# fixed values: what is taken off a command's confidence
RISK_PENALTIES = {
    "removeText": 0.12, "hidePicture": 0.12, "replaceTable": 0.08, "mergeTexts": 0.08, "splitText": 0.08, "splitPicture": 0.08,
    "linkContinuedTable": 0.08, "updateBbox": 0.08, "moveNode": 0.05,
}
PROPOSAL_FROM, AUTO_FROM, TRUSTED_AUTO_FROM = 0.5, 0.85, 0.7

# fixed values: the operations that each review task may use
TASK_OPS = {
    "text_ocr_hanja": ("replaceText",),
    "text_integrity": ("addText", "removeText", "mergeTexts", "splitText"),
    "text_role_footnote": ("updateTextRole", "linkFootnote"),
    "tables": ("updateTableCell", "replaceTable", "linkContinuedTable"),
    "pictures_captions": ("updatePictureCaption", "addPicture", "splitPicture", "hidePicture"),
    "layout_bbox_order": ("updateBbox", "moveNode"),
}

# fixed values: why an operation isn't applied without review, unless its evidence is there
BLOCK_REASONS = {
    "updateTableCell": "table_correction_requires_manual_review",
    "addText": "add_text_requires_missing_text_candidate",
    "updateBbox": "update_bbox_requires_bbox_warning",
    "linkFootnote": "link_footnote_requires_footnote_candidate",
    "moveNode": "move_node_requires_visual_order_improvement",
    **dict.fromkeys(("addPicture", "splitPicture", "hidePicture", "mergeTexts", "splitText", "replaceTable", "linkContinuedTable"), "structural_command_requires_manual_review"),
}
EVIDENCED_OPS = ("addText", "updateBbox", "linkFootnote", "moveNode")

# fixed values: parts of reasons that another answer could mend
MENDABLE_PARTS = (
    "_ref_not_found", "page_number_mismatch", "target_already_modified", "not_in_text_refs", "negative_index", "out_of_preview_range", "not_rectangular",
    "requires_", "without_boundary_candidate", "outside_source", "region_count_mismatch", "boundary_not_supported",
)

# fixed values: labels of what counts as a page's text
PAGE_LABELS = ("section_header", "text", "caption", "footnote", "list_item", "page_header", "page_footer")

# fixed values: suspect reasons for which a text may be removed
REMOVABLE = ("empty_text", "ocr_noise", "orphan_caption", "caption_like_body_text", "picture_internal_text", "repeated_across_pages")

# fixed values: operations whose own reference is a text, a table, a picture; the others take any
TEXT_OPS = ("replaceText", "updateTextRole", "removeText", "mergeTexts", "splitText", "linkFootnote")
TABLE_OPS = ("updateTableCell", "replaceTable", "linkContinuedTable")
PICTURE_OPS = ("updatePictureCaption", "splitPicture", "hidePicture")

# fixed values: the unit within a hint such as a number with its unit
UNIT_TOKEN = r"(?iu)(?:mm|cm|m²|m|㎝|㎜|㎡|kg|g|점|개)"
