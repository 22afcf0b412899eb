"""Secret scans: exact patterns, and weak candidates reported only where complementary parts stand together.

The patterns give the base spans. Weak candidates are access identifiers (``client_id=...``, user names of connection
strings), bare secrets (long mixed words of high entropy) and endpoints (addresses of services). None of them is a
finding alone. A scope is the stretch of ``REACH`` characters around a candidate within its document; an interval join
of the three kinds, by merging their sorted intervals, reports an identifier with a secret in its scope, a secret with
an identifier or endpoint, an endpoint with a secret. Base spans count as parts: ``AKIA`` keys are identifiers, the
others are secrets. The merge is local to a document and linear after sorting, so no key is shuffled.

Defined results: a null text counts as empty; an empty text has zero counts, no spans and the hash of the empty
string; repeated rows are each reported; rows without an id keep a null id; offsets count code points; of candidates
that overlap, base spans win, then the earlier, then the longer. Columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import docs_only, spans_text

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = 3
#: Parts within this many characters of each other are in one scope.
REACH = 300
#: Bits a character that a bare secret has at least.
ENTROPY = 3.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?:client_?id|account_?(?:id|name)|access_?key_?id|user_?name|login|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.A | re.I)
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[^\s\"'<>]{4,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+){2,}:[0-9]{2,5}\b", re.A)


def evidence(text: Column) -> Column:
    """Whether a text can hold a base span or candidate: assignments and addresses have ``:`` or ``=``, bare secrets a digit."""
    return text.rlike("[0-9:=]") | text.contains("AKIA") | text.rlike("[a-f]{24}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def _is_secret(word: str) -> bool:
    kinds = (any(c.islower() for c in word), any(c.isupper() for c in word), any(c.isdigit() for c in word))
    return all(kinds) and entropy(word) >= ENTROPY


def weak_candidates(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _BARE.finditer(text) if _is_secret(m[0])]
    found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(found, key=lambda x: (x[0], -x[2], x[1]))


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates with a complementary part in their scope."""
    taken, weak = sorted((s, e) for s, _, e in base), []
    ends = [e for _, e in taken]
    far = 0
    for i, e in enumerate(ends):  # the furthest end so far, for the search below
        far = ends[i] = max(far, e)
    last = 0
    for s, k, e in weak_candidates(text):
        i = bisect_left(ends, s + 1)
        if s < last or i < len(taken) and any(a < e and b > s for a, b in taken[i : i + 8]):
            continue
        weak.append((s, k, e))
        last = e
    if not weak:
        return []
    parts: dict[int, list[tuple[int, int]]] = {3: [], 4: [], 5: []}
    for s, k, e in [*((s, 3 if k == 1 else 4, e) for s, k, e in base), *weak]:
        parts[k].append((s, e))
    lanes = {}
    for k, spans in parts.items():
        spans.sort()
        far, reached = 0, []
        for _, e in spans:
            reached.append(far := max(far, e))
        lanes[k] = ([s for s, _ in spans], reached)

    def near(kind: int, s: int, e: int) -> bool:
        starts, reached = lanes[kind]
        i = bisect_left(reached, s - reach)  # the first part that, or one before it, ends in the scope or later
        return i < len(starts) and starts[i] <= e + reach

    wants = {3: (4,), 4: (3, 5), 5: (4,)}
    return [(s, k, e) for s, k, e in weak if any(near(o, s, e) for o in wants[k])]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out: list[list] = [[] for _ in range(6)]
        for text in b.column(1).to_pylist():
            base = base_spans(text) if text else []
            more = linked_spans(text, base) if text else []
            for k in range(BASE):
                out[k].append(sum(x[1] == k for x in base))
            out[3].append(hashlib.sha256(spans_text(base, KINDS).encode()).hexdigest())
            out[4].append(spans_text(base + more, KINDS))
            out[5].append(len(more))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts, hash and spans of every whole text."""
    docs = docs_only(docs)
    return docs.select("doc_id", F.when(evidence(F.col("text")), F.col("text")).alias("text")).mapInArrow(_batches, SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; n_chars, where there is one, counts the new text.

    Rows, columns and their order stay; a null text stays null.
    """

    def clean(text: str) -> str:
        base = base_spans(text)
        out, at = [], 0
        for s, _, e in sorted(base + linked_spans(text, base)):
            if e <= at:
                continue
            if s >= at:
                out += [text[at:s], mark]
            at = e
        return "".join([*out, text[at:]])

    def series(texts: "pa.Array") -> "pa.Array":
        return pa.array([None if x is None else clean(x) for x in texts.to_pylist()], pa.string())

    udf = F.arrow_udf(series, "string") if hasattr(F, "arrow_udf") else F.pandas_udf(lambda t: t.map(clean, na_action="ignore"), "string")
    seen = docs.withColumn("__hit", F.coalesce(evidence(F.col("text")), F.lit(False)))
    done = seen.withColumn("text", F.when(F.col("__hit"), udf(F.when(F.col("__hit"), F.col("text")))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
