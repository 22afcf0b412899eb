"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans. The field has a chain of words around every piece of evidence: a digit, an at sign,
the spelt-out signs of disguised addresses (``(at)``, ``[at]``, `` at host.org``, `` dot ``), and every place where a
part of a base span, such as a mailbox or a host, recurs in the document. Skip edges join each of these words to the next later one
of the document that is the same (case and outer punctuation aside), has the same last digits, alone or with the
digits of its neighbours, or is the same part of an address, however far away. Base words are clamped to their label,
and loopy message passing carries labels along the chains and skip edges, so that what was written once in full is
also found where it recurs in a form that no pattern knows. All weights, those of skip edges too, are fitted by
pseudo-likelihood in numpy on the base labels of a bounded sample of whole documents and on copies of these that have the base
spans rewritten (``name (at) host``, numbers without ``+``, other separators).

Words without evidence that neighbour none have the label "none" by definition of the field, so texts without any need
no pass through Python.

Defined results: a null text counts as empty; an empty text has zero counts, no spans and the hash of the empty
string; repeated rows are each reported; rows without an id are reported with a null id; offsets count code points.
Columns other than doc_id and text are ignored, whatever their names. With no labelled word in the table the field
adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import docs_only, spans_text

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none

#: Documents that the field's weights are fitted on, at most; those with the smallest hash of their text.
MAX_SAMPLE = 600
#: A word gets a label that the patterns don't give from this marginal probability on.
SURE = 0.9
BUCKETS, ROUNDS, DAMPING, STEPS = 4096, 10, 0.5, 150
#: The share of words whose features count in a step of the fit.
HEARD = 0.6
#: Digits and at signs, and at signs and dots that are spelt out. Read alike by Java and Python.
EVIDENCE = r"[0-9@]|[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z0-9]|\x20dot\x20"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards, so that long words without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end()))
                last = m.end()
                at = text.find("@", last)
                continue
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, starts, at = m[0].split("."), [], m.start()
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((starts[i], starts[i + 3] + len(four[3])))
            i += 4
    return found


def _numbers(pattern: re.Pattern, text: str, least: int, most: int, checked: bool) -> list[tuple[int, int]]:
    found = []
    for m in pattern.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if least <= len(digits) <= most and (not checked or luhn(digits)):
            found.append(m.span())
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each pattern's leftmost matches that don't overlap, less those that fail its check."""
    by_kind = (emails(text), ips(text), _numbers(_CARD, text, 12, 19, True), _numbers(_PHONE, text, 9, 15, False))
    return sorted((s, k, e) for k, spans in enumerate(by_kind) for s, e in spans)


# ---- the field ----

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'<>|*#$%&"


def _gap(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


_EVIDENT = re.compile(EVIDENCE)
_PART = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*")


def address_parts(word: str) -> list[str]:
    """Mailbox and host of an address, or of what may be a part of one: runs with a dot or of five characters and more."""
    return [x.lower() for x in _PART.findall(word) if "." in x or len(x) >= 5]


def evidence_places(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """Where evidence begins: that of the pattern, and each recurrence of a part of an e-mail's base span."""
    found = [m.start() + (m[0][0] == " ") for m in _EVIDENT.finditer(text)]
    known = {x for s, k, e in base if k == 0 for x in address_parts(text[s:e])}
    if known:
        found += [m.start() for m in _PART.finditer(text) if m[0].lower() in known]
        found.sort()
    return found


def windows(text: str, base: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of word spans: each word with evidence, and its two neighbours on either side."""
    chains: list[list[tuple[int, int]]] = []
    reach, places, next_ = 0, evidence_places(text, base), 0
    while next_ < len(places):
        s = places[next_]
        next_ += 1
        if s < reach:
            continue
        while s > 0 and not _gap(text[s - 1]):
            s -= 1
        chain, at = [_WORD.match(text, s).span()], s
        floor = chains[-1][-1][1] if chains else 0
        for _ in range(2):  # words before, as far as the last chain
            while at > floor and _gap(text[at - 1]):
                at -= 1
            if at <= floor:
                break
            e = at
            while at > floor and not _gap(text[at - 1]):
                at -= 1
            chain.insert(0, (at, e))
        at, after = chain[-1][1], 0
        while after < 2 and (w := _WORD.search(text, at)):
            chain.append(w.span())
            at = w.end()
            while next_ < len(places) and places[next_] < w.start():
                next_ += 1
            after = 0 if next_ < len(places) and places[next_] < at else after + 1
        reach = at
        if chains and not text[chains[-1][-1][1] : chain[0][0]].strip():
            chains[-1].extend(chain)
        else:
            chains.append(chain)
    return chains


def _shape(word: str) -> str:
    w = re.sub(r"[A-Za-zÀ-ɏ]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 19)}", w)


def _bucket(*what: object) -> int:
    return zlib.crc32(repr(what).encode()) % BUCKETS


def _features(words: list[str], i: int) -> list[int]:
    w = words[i].strip(_EDGE)
    digits = "".join(_DIGITS.findall(w))
    near = [words[j].strip(_EDGE) if 0 <= j < len(words) else "" for j in (i - 1, i + 1)]
    return [
        _bucket("bias"), _bucket("shape", _shape(w)), _bucket("digits", min(len(digits), 20)), _bucket("at", "@" in w, w.count(".") >= 1),
        _bucket("luhn", 12 <= len(digits) <= 19, luhn(digits) if 12 <= len(digits) <= 19 else None), _bucket("first", w[:1] if not w[:1].isalnum() else "w"),
        _bucket("word", w.lower() if not digits else ""), _bucket("before", _shape(near[0])), _bucket("after", _shape(near[1])), _bucket("both", _shape(near[0]), _shape(w)),
        _bucket("words", near[0].lower() if len(near[0]) <= 5 else "", near[1].lower() if len(near[1]) <= 5 else ""),
    ]


def _skip_keys(words: list[str], i: int) -> list[tuple[str, str]]:
    """What a word shares with others of its kind: itself, its address parts, its digits with those of the digit words around it."""
    core = words[i].strip(_EDGE).lower()
    keys = [("core", core)] if len(core) >= 5 else []
    keys += [("part", x) for x in address_parts(core) if not x.replace(".", "").isdigit()]
    if _DIGITS.search(core):
        a = b = i
        while a > 0 and _DIGITS.search(words[a - 1]) and not re.search("[A-Za-z@]", words[a - 1]):
            a -= 1
        while b + 1 < len(words) and _DIGITS.search(words[b + 1]) and not re.search("[A-Za-z@]", words[b + 1]):
            b += 1
        digits = "".join("".join(_DIGITS.findall(w)) for w in words[a : b + 1])
        own = "".join(_DIGITS.findall(core))
        keys += [("digits", x[-7:]) for x in dict.fromkeys((own, digits)) if len(x) >= 7]
    return keys


class Graph:
    """The fields of many documents as one set of arrays."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[list[int]] = []
        self.given: list[int] = []  # the base label, 0 for none
        self.edges: list[tuple[int, int, int]] = []  # kind 0: chain, 1: skip

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        seen: dict[tuple[str, str], int] = {}
        at = 0
        for chain in windows(text, base):
            words = [text[s:e] for s, e in chain]
            for i, (s, e) in enumerate(chain):
                while at < len(base) and base[at][2] <= s:
                    at += 1
                node = len(self.spans)
                hit = [b for b in base[at : at + 4] if b[0] < e and b[2] > s]
                self.spans.append((doc, s, e))
                self.given.append(hit[0][1] + 1 if hit else 0)
                self.features.append(_features(words, i))
                if i:
                    self.edges.append((node - 1, node, 0))
                linked = set()
                for key in _skip_keys(words, i):
                    if key in seen and seen[key] != node - 1 and seen[key] not in linked:
                        self.edges.append((seen[key], node, 1))
                        linked.add(seen[key])
                    seen[key] = node


class Field:
    """Weights of words by feature and label, and of label pairs by kind of edge."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair  # (BUCKETS, LABELS), (2, LABELS, LABELS)

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy message passing, all documents at once; base words are clamped."""
        n = len(g.spans)
        unary = self.node[np.array(g.features, np.int64)].sum(1)
        given = np.array(g.given)
        clamp = np.where(given > 0)[0]
        unary[clamp] = -30.0
        unary[clamp, given[clamp]] = 0.0
        if not g.edges:
            belief = unary
        else:
            a, b, kind = np.array(g.edges, np.int64).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            pot = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
            msg = np.zeros((len(src), LABELS))
            for _ in range(ROUNDS + 1):
                belief = unary + np.stack([np.bincount(dst, msg[:, j], n) for j in range(LABELS)], 1)
                x = (belief[src] - msg[back])[:, :, None] + pot
                top = x.max(1, keepdims=True)
                new = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
                msg = DAMPING * msg + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_field(graphs: Graph) -> Field | None:
    """Pseudo-likelihood: each word's label given its features and its neighbours' labels; Adagrad over all words."""
    y = np.array(graphs.given)
    if not len(y) or not y.any():
        return None
    x = np.array(graphs.features, np.int64)
    n, f = x.shape
    onehot = np.eye(LABELS)[y]
    a, b, kind = np.array(graphs.edges, np.int64).reshape(-1, 3).T
    # words without a label that recur as a part of a base span may be what the patterns miss: they and their neighbours teach nothing
    unsure = np.zeros(n, bool)
    skip = kind == 1
    unsure[a[skip & (y[a] == 0) & (y[b] > 0)]] = unsure[b[skip & (y[b] == 0) & (y[a] > 0)]] = True
    beside = unsure.copy()
    beside[a[~skip & unsure[b]]] = beside[b[~skip & unsure[a]]] = True
    unsure = beside & (y == 0)
    sure = ~(unsure[a] | unsure[b])
    a, b, kind = a[sure], b[sure], kind[sure]
    node, pair = np.zeros((BUCKETS, LABELS)), np.zeros((2, LABELS, LABELS))
    sq_node, sq_pair = np.full_like(node, 1e-6), np.full_like(pair, 1e-6)
    to_b, to_a = (kind * LABELS + y[a]) * LABELS, kind * LABELS * LABELS + y[b]  # a pair's first place in the flat form
    labels = np.arange(LABELS)
    chance = np.random.default_rng(13)
    for _ in range(STEPS):
        heard = chance.random(n) < HEARD  # the others' labels have to follow from their neighbours along chains and skip edges
        z = node[x].sum(1) * heard[:, None]
        for j in labels:
            z[:, j] += np.bincount(b, pair.ravel()[to_b + j], n) + np.bincount(a, pair.ravel()[to_a + LABELS * j], n)
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - onehot) * ~unsure[:, None]
        own = d * heard[:, None]
        gn = np.stack([np.bincount(x.ravel(), np.repeat(own[:, j], f), BUCKETS) for j in labels], 1)
        gp = sum(np.bincount(to_b + j, d[b, j], pair.size) + np.bincount(to_a + LABELS * j, d[a, j], pair.size) for j in labels).reshape(pair.shape)
        gn, gp = gn / n + 1e-4 * node, gp / n + 1e-4 * pair
        alike = np.trace(gp[1][1:, 1:]) / (LABELS - 1)  # words alike share one potential, whichever their label
        apart = (gp[1].sum() - np.trace(gp[1])) / (LABELS * (LABELS - 1))
        gp[1] = np.where(np.eye(LABELS) > 0, alike, apart)
        gp[1][0, 0] = 0
        sq_node += gn**2
        sq_pair += gp**2
        node -= 0.2 * gn / np.sqrt(sq_node)
        pair -= 0.2 * gp / np.sqrt(sq_pair)
    return Field(node, pair)


def _rewritten(text: str, base: list[tuple[int, int, int]], how: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its base spans in forms that the patterns miss, and where they stand then."""
    out, spans, at = [], [], 0
    size = 0
    for s, k, e in base:
        if s < at:
            continue
        x = text[s:e]
        if k == 0:
            x = x.replace("@", ("(at)", " (at) ", "[at]", " [at] ", " at ")[how % 5])
        elif k == 3:
            x = ("00" + x[1:], x[1:], *(re.sub("[^0-9]+", sep, x[1:]) for sep in "-./ "))[how % 6]
        elif k == 2:
            d = "".join(_DIGITS.findall(x))
            x = ("." if how % 2 else "/").join(d[i : i + 4] for i in range(0, len(d), 4))
        out.append(text[at:s])
        size += s - at
        spans.append((size, k, size + len(x)))
        out.append(x)
        size += len(x)
        at = e
    return "".join([*out, text[at:]]), spans


def train(docs: DataFrame, most: int = MAX_SAMPLE) -> Field | None:
    """The field fitted on at most ``most`` whole documents with evidence, half of them with an at sign or plus sign if there are as many.

    A document is read as it is, and once more followed by a copy with its base spans rewritten, so that skip edges
    between the forms are seen, too.
    """
    hashed = docs.where(F.col("text").rlike(EVIDENCE)).select("text", F.xxhash64("text").alias("h"), F.col("text").rlike("[@+]").alias("signed"))
    distinct = hashed.select("h", "signed").distinct()
    chosen = [r["h"] for s in (True, False) for r in distinct.where(F.col("signed") == s).orderBy("h").limit(most // 2).collect()]
    rows = hashed.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect()  # ``most`` at most
    g = Graph()
    for n, r in enumerate(sorted(rows, key=lambda r: r["h"])):
        text = r["text"]
        base = base_spans(text)
        g.add(2 * n, text, base)
        if base:
            copy, spans = _rewritten(text, base, n)
            shift = len(text) + 1
            g.add(2 * n + 1, f"{text}\n{copy}", base + [(s + shift, k, e + shift) for s, k, e in spans])
    return fit_field(g)


def _inside(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in _EDGE:
        s += 1
    while e > s and text[e - 1] in _EDGE:
        e -= 1
    return s, e


def added_spans(field: Field | None, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The field's spans outside the base ones: runs of unclamped words of one sure label."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = Graph()
    for n, (text, base) in enumerate(zip(texts, bases)):
        if text:
            g.add(n, text, base)
    if field is None or not g.spans:
        return found
    p = field.marginals(g)
    label = np.where(p[:, 1:].max(1) >= SURE, p[:, 1:].argmax(1) + 1, 0)
    label[np.array(g.given) > 0] = 0
    linked = {(a, b) for a, b, kind in g.edges if kind == 0}
    i = 0
    while i < len(label):
        j = i + 1
        if label[i]:
            while j < len(label) and label[j] == label[i] and (j - 1, j) in linked:
                j += 1
            doc, s = g.spans[i][:2]
            s, e = _inside(texts[doc], s, g.spans[j - 1][2])
            if s < e:
                found[doc].append((s, int(label[i]) - 1, e))
        i = j
    return found


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts, hash and spans of every whole text; fits a field on a sample of ``docs`` if none is given."""
    docs = docs_only(docs)
    field = field or train(docs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                bases = [base_spans(x) if x else [] for x in texts]
                more = added_spans(field, texts, bases)
                count = [np.bincount([k for _, k, _ in x], minlength=len(KINDS)) if x else np.zeros(len(KINDS), int) for x in bases]
                base_text = [spans_text(x, KINDS) for x in bases]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([int(c[k]) for c in count], pa.int64()) for k in range(len(KINDS))),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base_text], pa.string()),
                     pa.array([spans_text(x + y, KINDS) for x, y in zip(bases, more)], pa.string()), pa.array([len(x) for x in more], pa.int64())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    # without evidence there is nothing to find: such texts stay on the JVM's side
    return docs.select("doc_id", F.when(F.col("text").rlike(EVIDENCE), F.col("text")).alias("text")).mapInArrow(batches, SCHEMA)
