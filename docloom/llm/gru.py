"""A gated recurrent language model in numpy with class-factored output.

Words are numbered by falling frequency and cut into ``CLASSES`` classes of like size; p(word) = p(class | state) *
p(word | class, state). Training backpropagates through the consecutive windows of ``WINDOW`` words of whole documents,
so that every word and every end is a target once; each window's first state is the last one of the window before.
Scoring reads documents side by side in lanes, one after another in each, and carries the state through a whole document.

States lie a row each; what belongs to the update gate, the reset gate and the candidate lies one after another, so that
each is contiguous. Outputs are taken in blocks of ``ROWS`` rows, sorted by class, which stay in a core's cache.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

EMBED, HIDDEN, CLASSES, PER_CLASS = 16, 16, 64, 64
VOCAB = CLASSES * PER_CLASS
END, UNKNOWN = 0, 1
WINDOW, EVERY = 16, 64
BATCH = 512
#: Lanes scored side by side, states that are sorted by class at once, and those whose outputs are taken at once.
SCORED, STATES, ROWS = 512, 1 << 16, 1024

#: The parameters in the order of their flat form.
SHAPES = {
    "embed": (VOCAB, EMBED), "w": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, HIDDEN, PER_CLASS), "word_b": (CLASSES, PER_CLASS),
}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their biases as a last row, for inputs that end with a one."""
    return np.concatenate([w, b[..., None, :]], -2)


def _with_one(x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, 1
    return out


def _by_gate(w: np.ndarray) -> np.ndarray:
    """(3, rows, HIDDEN) from (rows, 3 * HIDDEN), those of the two gates negated as ``_advance`` takes them."""
    out = np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).swapaxes(0, 1))
    out[:2] *= -1
    return out


def _advance(c: np.ndarray, a: np.ndarray, h: np.ndarray, cand: np.ndarray, out: np.ndarray) -> None:
    """A step from the states ``h`` to ``out``, by what the states (``c``) and the words (``a``) add; both gates are left in ``c``."""
    gates = c[:2]
    gates += a[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(c[2], gates[1], out=cand)
    cand += a[2]
    np.tanh(cand, out=cand)
    np.subtract(h, cand, out=out)
    out *= gates[0]
    out += cand


def _segments(kind: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of sorted classes, for each block of ROWS rows: (class, first row, end)."""
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(kind)) + 1, np.arange(0, len(kind), ROWS)])).tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(0, len(kind), ROWS)]
    for lo, hi in zip(cuts, [*cuts[1:], len(kind)]):
        out[lo // ROWS].append((int(kind[lo]), lo, hi))
    return out


def _bounded(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no state, whose entries are within 1, can have a score that exp() can't take as it is."""
    return float(np.abs(w).sum(-2).max() + np.abs(b).max()) < 40


def _take_softmax(x: np.ndarray, at: np.ndarray, bounded: bool) -> float:
    """Turns rows of scores into the gradient of their loss, the softmax less one at the target; the summed log-probabilities."""
    if not bounded:
        x -= x.max(1, keepdims=True)
    flat, place = x.reshape(-1), np.arange(0, x.size, x.shape[1]) + at
    scores = flat[place].sum(dtype=np.float64)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x *= (1 / total)[:, None]
    flat[place] -= 1
    return float(scores - np.log(total).sum(dtype=np.float64))


def _picked(x: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """One entry a row of the logarithm of the softmax; ``x`` is used up."""
    if not bounded:
        x -= x.max(1, keepdims=True)
    score = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at].astype(np.float64)
    np.exp(x, out=x)
    return score - np.log(x @ np.ones(x.shape[1], x.dtype))


class Gru:
    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            if flat is not None:
                self.p[name] = flat[at : at + n].reshape(shape).astype(np.float32).copy()
            else:
                self.p[name] = np.zeros(shape, np.float32) if name.endswith("b") else r.normal(0, 0.1, shape).astype(np.float32)
            at += n
        self.sq = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    def start_from_counts(self, counts: np.ndarray) -> None:
        """Output biases that reproduce the words' frequencies."""
        c = (counts.astype(np.float64) + 0.5).reshape(CLASSES, PER_CLASS)
        self.p["class_b"] = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.p["word_b"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)

    def step(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, k = self.p, HIDDEN
        x = p["embed"][words]
        a, c = x @ p["w"] + p["b"], h @ p["u"]
        gates = _sigmoid(a[:, : 2 * k] + c[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * c[:, 2 * k :])
        return n + z * (h - n), (x, h, z, r, n, c[:, 2 * k :], words)

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, a row a state; only sums and the targets' scores are kept."""
        p = self.p
        order = np.argsort((targets // PER_CLASS).astype(np.uint8), kind="stable")
        y = targets[order]
        kind, inner, hs = y // PER_CLASS, y % PER_CLASS, _with_one(h[order])
        all_bounded, bounded = _bounded(p["class_w"], p["class_b"]), _bounded(p["word_w"], p["word_b"])
        classes, words = _with_bias(p["class_w"], p["class_b"]), _with_bias(p["word_w"], p["word_b"])
        out, e = np.empty(len(h)), np.empty((min(ROWS, len(h)), PER_CLASS), hs.dtype)
        for lo, segments in zip(range(0, len(h), ROWS), _segments(kind)):
            part = slice(lo, lo + ROWS)
            out[part] = _picked(hs[part] @ classes, kind[part], all_bounded)
            for c, i, j in segments:
                np.matmul(hs[i:j], words[c], out=e[i - lo : j - lo])
            out[part] += _picked(e[: len(hs) - lo], inner[part], bounded)
        result = np.empty(len(h))
        result[order] = out
        return result

    def loss_and_grads(self, tokens: np.ndarray, start: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], int, np.ndarray]:
        """Of (batch, time + 1) tokens, -1 after a segment's end: summed loss of the targets, its gradients, their number, the last states.

        ``start`` holds the states that the segments begin in, zeros if not given. Only the recurrence runs step by
        step; all else is done for all steps at once.
        """
        p, k, dtype = self.p, HIDDEN, self.p["u"].dtype
        b, t = tokens.shape[0], tokens.shape[1] - 1
        words = np.maximum(tokens[:, :-1], 0).T.ravel()  # by step, then by segment
        x = _with_one(p["embed"].take(words, 0))
        a = np.matmul(x, _by_gate(_with_bias(p["w"], p["b"]))).reshape(3, t, b, k)
        u = _by_gate(p["u"])
        before, hidden, cand = np.empty((t + 1, b, k), dtype), np.empty((3, t, b, k), dtype), np.empty((t, b, k), dtype)
        before[0] = 0 if start is None else start
        for i in range(t):
            np.matmul(before[i], u, out=hidden[:, i])
            _advance(hidden[:, i], a[:, i], before[i], cand[i], before[i + 1])
        z, r, inner = hidden
        target = tokens[:, 1:].T.ravel()
        rows = np.flatnonzero(target >= 0)
        rows = rows[np.argsort((target[rows] // PER_CLASS).astype(np.uint8), kind="stable")]
        into = np.zeros((t * b, k), dtype)
        loss, grads, into[rows] = self._outputs(before[1:].reshape(-1, k).take(rows, 0), target[rows])
        into = into.reshape(t, b, k)
        # what doesn't depend on the gradient that comes from later steps
        rest = 1 - z
        to_n, to_z, to_r = 1 - cand * cand, before[:-1] - cand, 1 - r
        to_n *= rest
        to_z *= z
        to_z *= rest
        to_r *= r
        to_r *= inner
        dc, dn = np.empty((3, t, b, k), dtype), np.empty((t, b, k), dtype)
        carry, back = np.zeros((b, k), dtype), np.empty((3, b, k), dtype)
        ut = np.ascontiguousarray(p["u"].reshape(k, 3, k).transpose(1, 2, 0))
        for i in range(t - 1, -1, -1):
            dhi = into[i]
            dhi += carry
            np.multiply(dhi, to_n[i], out=dn[i])
            np.multiply(dhi, to_z[i], out=dc[0, i])
            np.multiply(dn[i], to_r[i], out=dc[1, i])
            np.multiply(dn[i], r[i], out=dc[2, i])
            np.matmul(dc[:, i], ut, out=back)
            carry = dhi
            carry *= z[i]
            carry += back[0]
            carry += back[1]
            carry += back[2]
        dc, states = dc.reshape(3, -1, k), before[:-1].reshape(-1, k)
        da = (dc[0], dc[1], dn.reshape(-1, k))
        into_w = np.concatenate([x.T @ d for d in da], 1)
        grads["w"], grads["b"] = into_w[:-1], into_w[-1]
        grads["u"] = np.concatenate([states.T @ d for d in dc], 1)
        dx = sum(p["w"][:, g * k : (g + 1) * k] @ d.T for g, d in enumerate(da))
        grads["embed"] = np.stack([np.bincount(words, d, VOCAB) for d in dx], 1).astype(dtype)
        return float(loss), grads, len(rows), before[t]

    def _outputs(self, h: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss of targets sorted by class, the gradients of the output's weights, and those of the states."""
        p, dtype = self.p, h.dtype
        kind, within, hs = y // PER_CLASS, y % PER_CLASS, _with_one(h)
        all_bounded, bounded = _bounded(p["class_w"], p["class_b"]), _bounded(p["word_w"], p["word_b"])
        classes, words = _with_bias(p["class_w"], p["class_b"]), _with_bias(p["word_w"], p["word_b"])
        class_t, word_t = np.ascontiguousarray(p["class_w"].T), np.ascontiguousarray(p["word_w"].swapaxes(1, 2))
        to_classes, to_words = np.zeros_like(classes), np.zeros_like(words)
        dh, loss, most = np.empty_like(h), 0.0, min(ROWS, len(h))
        scores, dh_words = np.empty((most, PER_CLASS), dtype), np.empty((most, HIDDEN), dtype)
        for lo, segments in zip(range(0, len(h), ROWS), _segments(kind)):
            part, n = slice(lo, lo + ROWS), min(ROWS, len(h) - lo)
            d = hs[part] @ classes
            loss -= _take_softmax(d, kind[part], all_bounded)
            to_classes += hs[part].T @ d
            np.matmul(d, class_t, out=dh[part])
            for c, i, j in segments:
                np.matmul(hs[i:j], words[c], out=scores[i - lo : j - lo])
            loss -= _take_softmax(scores[:n], within[part], bounded)
            for c, i, j in segments:
                e = scores[i - lo : j - lo]
                to_words[c] += hs[i:j].T @ e
                np.matmul(e, word_t[c], out=dh_words[i - lo : j - lo])
            dh[part] += dh_words[:n]
        grads = {"class_w": to_classes[:-1], "class_b": to_classes[-1], "word_w": to_words[:, :-1], "word_b": to_words[:, -1]}
        return loss, grads, dh

    def train(self, segments: np.ndarray, rate: float, start: np.ndarray | None = None) -> np.ndarray:
        """One Adagrad step on (batch, WINDOW + 1) tokens and the states they begin in; the states they end in."""
        _, g, n, last = self.loss_and_grads(segments, start)
        for name, x in g.items():
            x *= 16.0 / max(1, n)
            root = x * x
            self.sq[name] += root
            np.sqrt(self.sq[name], out=root)
            x *= rate
            x /= root
            self.p[name] -= x
        return last

    def train_all(self, documents: Iterator[np.ndarray], rate: float, batch: int = BATCH) -> int:
        """Trains on whole documents (numbered words, the end last), and returns how many windows they had.

        ``batch`` documents are read side by side, a window of each at a time; the state is carried from window to
        window, and where a document ends the next one begins.
        """
        lanes: list[tuple[np.ndarray, int] | None] = [None] * batch  # a document padded to whole windows, and where it stands
        h, windows = np.zeros((batch, HIDDEN), np.float32), 0
        while True:
            for i, lane in enumerate(lanes):
                if lane is None and (d := next(documents, None)) is not None:
                    padded = np.full(max(1, -(-len(d) // WINDOW)) * WINDOW + 1, -1, np.int64)
                    padded[0], padded[1 : len(d) + 1] = END, d
                    lanes[i] = (padded, 0)
                    h[i] = 0
            live = [i for i, lane in enumerate(lanes) if lane is not None]
            if not live:
                return windows
            tokens = np.empty((len(live), WINDOW + 1), np.int64)
            for row, i in enumerate(live):
                d, at = lanes[i]
                tokens[row] = d[at : at + WINDOW + 1]
                at += WINDOW
                lanes[i] = (d, at) if at + 1 < len(d) else None
            h[live] = self.train(tokens, rate * len(live) / batch, h[live])
            windows += len(live)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole documents (numbered words, the end last).

        They are read in SCORED lanes of like length, one after another in a lane, the longest first; a state is carried
        through its document and is zero where the next one begins.
        """
        lens = np.fromiter(map(len, documents), np.int64, len(documents))
        lanes: list[list[int]] = [[] for _ in range(min(SCORED, len(documents)))]
        loads = [(0, i) for i in range(len(lanes))]
        for d in np.argsort(-lens, kind="stable").tolist():
            load, i = loads[0]
            if lens[d]:
                lanes[i].append(d)
                heapq.heapreplace(loads, (load + int(lens[d]), i))
        loads = sorted((x for x in loads if x[0]), reverse=True)
        if not loads:
            return np.zeros(len(documents))
        order = [d for _, i in loads for d in lanes[i]]
        line = np.concatenate([documents[d] for d in order])
        fresh, ends = np.zeros(len(line), bool), np.cumsum(lens[order])
        fresh[ends - lens[order]] = True
        doc = np.repeat(np.array(order, np.int32), lens[order])
        lane_lens = np.array([n for n, _ in loads])
        first = np.cumsum(lane_lens) - lane_lens
        # what each word adds to the gates and the candidate
        inputs, u = np.matmul(_with_one(self.p["embed"]), _by_gate(_with_bias(self.p["w"], self.p["b"]))), _by_gate(self.p["u"])
        out, h = np.zeros(len(documents)), np.zeros((len(first), HIDDEN), np.float32)
        waiting, count = [], 0
        for s in range(0, int(lane_lens[0]), EVERY):
            live = int((lane_lens > s).sum())
            times = np.arange(s, min(s + EVERY, int(lane_lens[0])))[:, None]
            inside = times < lane_lens[:live]
            at = np.where(inside, first[:live] + times, 0)
            starts = fresh[at]
            before = np.where(starts, END, line[at - 1])
            resets = np.flatnonzero(starts.any(1)).tolist()
            states = np.empty((len(times), live, HIDDEN), np.float32)
            a, c, cand = np.empty((3, live, HIDDEN), np.float32), np.empty((3, live, HIDDEN), np.float32), np.empty((live, HIDDEN), np.float32)
            h = h[:live]
            for j in range(len(times)):
                if resets and resets[0] == j:
                    h = np.where(starts[resets.pop(0)][:, None], np.float32(0), h)
                np.take(inputs, before[j], 1, a, "clip")
                np.matmul(h, u, out=c)
                _advance(c, a, h, cand, states[j])
                h = states[j]
            waiting.append((states[inside], at[inside]))
            count += len(waiting[-1][1])
            if count >= STATES or s + EVERY >= lane_lens[0]:
                reached = np.concatenate([x for _, x in waiting])
                out += np.bincount(doc[reached], self.log_probs(np.concatenate([x for x, _ in waiting]), line[reached]), len(out))
                waiting, count = [], 0
        return out
