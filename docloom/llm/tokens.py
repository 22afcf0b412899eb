"""Token ids of whole texts by the public tokenizers, a batch at a time, with words remembered.

Both vocabularies cut a text at white space before anything is merged, and no piece reaches across a cut that is made
here, so the ids of a text are those of its words, and of the white space between them, in a row. Words recur: they are
hashed all at once, found in a table of those seen, and their ids are copied all at once; a word's 64-bit hash, which
holds its length, stands for it. Words that the table lacks are encoded one by one: plain ones by the vocabulary's
merges, others by the library; texts with unusual white space go to the library as they are.
"""

from __future__ import annotations

import importlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from docloom.llm.words import HashTable, parts, text_bytes, word_hashes, word_places

#: Words that a worker process remembers, at most (some 50 bytes each), in a table of 2**SLOT_BITS.
MOST_KEPT, SLOT_BITS = 1_000_000, 21
LONGEST_KEPT = 40

#: White space beyond ASCII's, and control characters on which libraries disagree.
_ODD_WIDE = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿]")
_ODD_NARROW = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
#: Bytes without which a text holds none of these.
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

#: Symbols that both vocabularies cut off from letters before them.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
#: Bytes that aren't part of letters of the Latin blocks, but for the three characters below.
_FOREIGN = np.ones(256, bool)
_FOREIGN[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = False
_TIMES, _DIVIDED, _DOTTED_I = 0xC397, 0xC3B7, 0xC4B0


def _foreign_before(data: np.ndarray) -> np.ndarray:
    """How many bytes before each aren't part of Latin letters."""
    foreign = _FOREIGN[data]
    if len(data):
        two = data[:-1].astype(np.int64) << 8 | data[1:]
        foreign[:-1] |= (two == _TIMES) | (two == _DIVIDED) | (two == _DOTTED_I)
    return np.concatenate([[0], np.cumsum(foreign)])


def latin(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are letters of the Latin blocks only, where all Unicode versions agree, and that lower-case to letters."""
    before = _foreign_before(data)
    return before[starts] == before[ends]


def stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each word's symbols at its end begin, if before them stand Latin letters only; else the word's end."""
    last = np.maximum.accumulate(np.where(_SYMBOL[data], -1, np.arange(len(data))))
    cut, before = last[ends - 1] + 1, _foreign_before(data)
    return np.where((cut > starts) & (cut < ends) & (before[np.maximum(cut, starts)] == before[starts]), cut, ends)


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file: in the folder that DOCLOOM_TOKENIZERS names, else with the installed package."""
    folder = os.environ.get("DOCLOOM_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return out


_BYTE_TABLE = dict(enumerate(_byte_chars()))


def _as_bytes(text: str) -> str:
    """The text's bytes as their characters; ASCII letters stand for themselves."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_TABLE)


def _odd(text: str) -> bool:
    if any(c in text for c in _ODD_NARROW):
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD_WIDE.search(text) is not None
    return False


class Pieces:
    """Ids of the pieces seen so far, end to end, and a hash table of where each starts."""

    def __init__(self, kind: np.dtype):
        self.table = HashTable(SLOT_BITS)
        self.ids, self.used = np.zeros(1 << 16, kind), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.count = self.kept = 0

    def add(self, ids: list[list[int]]) -> np.ndarray:
        """New pieces and their numbers."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), self.ids.dtype, int(sizes.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(ids) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        made = slice(self.count, self.count + len(ids))
        self.ids[self.used : self.used + len(new)] = new
        self.starts[made], self.sizes[made] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(new)
        self.count += len(ids)
        return np.arange(made.start, made.stop)

    def keep(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """Remembers pieces by their keys, which are new and distinct."""
        self.table.put(keys, pieces)
        self.kept += len(keys)

    def joined(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and where each ends."""
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[pieces] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Little-endian ids of whole texts, ``kind`` each."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(vocabulary_path(name))
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._tokenize = self.whole.model.tokenize
        self.pieces = Pieces(self.kind)

    def _by_library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """Ids of one word in byte characters."""
        return [t.id for t in self._tokenize(word)]

    def word_ids(self, word: str, letters: bool, spaced: bool) -> list[int]:
        """Ids of a word without white space, which may be all Latin letters; ``spaced`` if a single space belongs to it."""
        raise NotImplementedError

    def _spaced(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word whether a space belongs to it, and where the white space before it begins."""
        return np.zeros(len(starts), bool), starts

    def _gaps(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, spaced: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of white space before each word, and after the last word of each text; -1 for none."""
        return np.full(len(starts), -1), np.full(len(offsets) - 1, -1)

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column without nulls end to end, each followed by ``end_id``, and each text's first, their number last."""
        found = [(np.zeros(0, self.kind), np.zeros(1, np.int64))]
        for _, part in parts(column):
            found.append(self._encode_part(part, end_id))
        base = np.cumsum([0] + [len(x) for x, _ in found])
        return np.concatenate([x for x, _ in found]), np.concatenate([[0], *(o[1:] + b for (_, o), b in zip(found, base))])

    def _encode_part(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.pieces
        data, offsets = text_bytes(column)
        odd = [(i, text) for i in np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_ODD[data]), "right") - 1).tolist() if _odd(text := column[i].as_py())]
        starts, ends, first = word_places(data, offsets)
        spaced, before = self._spaced(data, offsets, starts, ends, first)
        cut = stems(data, starts, ends)
        with_end = np.flatnonzero(cut < ends)
        # units: the words up to their symbols, then the symbols
        n, texts = len(starts), len(column)
        from_, to, apart = np.concatenate([starts, cut[with_end]]), np.concatenate([cut, ends[with_end]]), np.concatenate([spaced, np.zeros(len(with_end), bool)])
        salt = np.where(apart, np.uint64(0xA0761D6478BD642F), np.uint64(0))
        keys = np.maximum(np.concatenate([word_hashes(data, starts, cut, self.folds), word_hashes(data, cut[with_end], ends[with_end], self.folds)]) ^ salt, np.uint64(1))
        at = pieces.table.find(keys)
        for i, _ in odd:  # their words aren't looked up
            at[first[i] : first[i + 1]] = 0
        missing = np.flatnonzero(at < 0)
        new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
        where = missing[where]
        kept = np.flatnonzero(to[where] - from_[where] <= LONGEST_KEPT)[: max(0, MOST_KEPT - pieces.kept)]
        others = np.setdiff1d(np.arange(len(new)), kept)
        raw, plain = data.tobytes(), latin(data, from_[where], to[where])

        def ids_of(some: np.ndarray) -> list[list[int]]:
            at = where[some]
            rows = zip(from_[at].tolist(), to[at].tolist(), plain[some].tolist(), apart[at].tolist())
            return [self.word_ids(raw[a:b].decode(), letters, space) for a, b, letters, space in rows]

        made = np.empty(len(new), np.int64)
        made[kept] = pieces.add(ids_of(kept))
        pieces.keep(new[kept], made[kept])
        mark = (pieces.used, pieces.count)  # what comes after is forgotten when this part is done
        made[others] = pieces.add(ids_of(others))
        at[missing] = made[back]
        symbols = np.full(n, -1, np.int64)
        symbols[with_end] = at[n:]
        space, after = self._gaps(data, offsets, starts, ends, first, spaced, before)
        end = pieces.add([[end_id]])[0] if end_id is not None else -1
        # slots in the order of the text: white space, word and symbols of each word, after a text's last word the rest and the end
        line = np.full(3 * n + 2 * texts, -1, np.int64)
        place = 3 * np.arange(n) + 2 * np.repeat(np.arange(texts), np.diff(first))
        line[place], line[place + 1], line[place + 2] = space, at[:n], symbols
        close = 3 * first[1:] + 2 * np.arange(texts)
        line[close], line[close + 1] = after, end
        bounds = np.concatenate([[0], close + 2])
        for i, text in odd:
            line[bounds[i] : bounds[i + 1] - 1] = -1
            line[bounds[i]] = pieces.add([self._by_library(text)])[0]
        keep = line >= 0
        ids, stops = pieces.joined(line[keep])
        counts = np.concatenate([[0], np.cumsum(keep)])[bounds]
        edges = np.concatenate([[0], stops])[counts]
        pieces.used, pieces.count = mark
        return ids, edges


class LowerWords(Encoder):
    """The vocabulary of lower-case words: white space is dropped."""

    folds = True

    def word_ids(self, word: str, letters: bool, spaced: bool) -> list[int]:
        return self._word(_as_bytes(word.lower())) if letters else self._by_library(word)


class ByteLevel(Encoder):
    """The byte-level vocabulary: a single space before a word belongs to it; of longer white space the last character is cut off."""

    folds = False

    def __init__(self, name: str):
        super().__init__(name)
        self.runs: dict[bytes, list[int]] = {}

    def _run(self, run: bytes, last: bool) -> list[int]:
        """Ids of white space, up to the space that belongs to the word after it; at a text's end as it is."""
        key = run + b"$" * last
        if (ids := self.runs.get(key)) is None:
            text = run.decode()
            if last:
                ids = self._by_library(text)
            elif text[-1] == " ":
                ids = self._by_library(text[:-1])
            else:
                ids = (self._by_library(text[:-1]) if len(text) > 1 else []) + self._by_library(text[-1])
            if len(self.runs) < 4096 and len(run) <= LONGEST_KEPT:
                self.runs[key] = ids
        return ids

    def _spaced(self, data, offsets, starts, ends, first):
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        leads = first[:-1][np.diff(first) > 0]
        before[leads] = offsets[:-1][np.diff(first) > 0]
        return (starts > before) & (data[np.maximum(starts - 1, 0)] == 0x20), before

    def _gaps(self, data, offsets, starts, ends, first, spaced, before):
        texts, size, last = len(offsets) - 1, starts - before, data[np.maximum(starts - 1, 0)]
        gap, rest = np.full(len(starts), -1, np.int64), np.full(texts, -1, np.int64)
        seen: dict[bytes, int] = {}

        def piece(run: bytes, at_end: bool) -> int:
            key = run + b"$" * at_end
            if key not in seen:
                seen[key] = self.pieces.add([self._run(run, at_end)])[0]
            return seen[key]

        line = np.flatnonzero((size == 1) & (last == 0x0A))
        if len(line):
            gap[line] = piece(b"\n", False)
        for i in np.flatnonzero((size > 1) | (size == 1) & ~spaced & (last != 0x0A)).tolist():
            gap[i] = piece(data[before[i] : starts[i]].tobytes(), False)
        tail = np.where(np.diff(first) > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        for i in np.flatnonzero(tail < offsets[1:]).tolist():
            rest[i] = piece(data[tail[i] : offsets[i + 1]].tobytes(), True)
        return gap, rest

    def word_ids(self, word: str, letters: bool, spaced: bool) -> list[int]:
        return self._word("\u0120" * spaced + _as_bytes(word)) if letters else self._by_library(" " * spaced + word)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    from tokenizers import Tokenizer

    lower = "Lowercase" in str(Tokenizer.from_file(vocabulary_path(name)).normalizer)
    return (LowerWords if lower else ByteLevel)(name)
