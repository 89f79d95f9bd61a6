"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Small on purpose: characters are folded into about forty classes, so the input layer is a
table, and a window of text costs a few hundred microseconds.
"""

from __future__ import annotations

import numpy as np

#: Classes of characters: digit, lower, upper, other letter, space, other blank, each ASCII mark, rest, padding.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 6 + len(_MARKS) + 2
PAD = CLASSES - 1
_ASCII = np.full(128, CLASSES - 2, np.int16)
for _i in range(128):
    _c = chr(_i)
    if _c.isdigit():
        _ASCII[_i] = 0
    elif _c.islower():
        _ASCII[_i] = 1
    elif _c.isupper():
        _ASCII[_i] = 2
    elif _c == " ":
        _ASCII[_i] = 4
    elif _c.isspace():
        _ASCII[_i] = 5
    elif _c in _MARKS:
        _ASCII[_i] = 6 + _MARKS.index(_c)


def classes(text: str) -> np.ndarray:
    """The character classes of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 3).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM-CRF over windows of equal length; ``tags`` labels, label 0 meaning none."""

    def __init__(self, tags: int, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        h = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h:2 * h] = 1.0
            self.p["c" + d] = bias
        self.p["o"] = rng.normal(0, 0.2, (2 * h, tags))
        self.p["ob"] = np.zeros(tags)
        self.p["t"] = rng.normal(0, 0.05, (tags, tags))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of one direction; ``x`` is (time, batch)."""
        h_size = self.hidden
        h = np.zeros((x.shape[1], h_size), np.float32)
        c = h
        states, saved = np.empty((*x.shape, h_size), np.float32), []
        weights, table = self.p["h" + d], self.p["x" + d] + self.p["c" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ weights
            gates = _sigmoid(z[:, :3 * h_size])
            new = np.tanh(z[:, 3 * h_size:])
            i, f, o = gates[:, :h_size], gates[:, h_size:2 * h_size], gates[:, 2 * h_size:]
            before = c
            c = f * before + i * new
            squashed = np.tanh(c)
            if keep:
                saved.append((t, h, before, i, f, o, new, squashed))
            h = o * squashed
            states[t] = h
        return states, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores (time, batch, tags) for class windows (batch, time)."""
        x = x.T
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return both @ self.p["o"] + self.p["ob"]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best label paths (batch, time) by Viterbi."""
        steps = len(scores)
        back = np.empty(scores.shape, np.int8)
        v = scores[0]
        for t in range(1, steps):
            via = v[:, :, None] + self.p["t"][None]
            back[t] = via.argmax(axis=1)
            v = via.max(axis=1) + scores[t]
        path = np.empty(scores.shape[:2], np.int8)
        path[-1] = v.argmax(axis=1)
        rows = np.arange(scores.shape[1])
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][rows, path[t]]
        return path.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood per window and its gradients; ``x``, ``y`` are (batch, time)."""
        x, y = x.T, y.T
        steps, batch = x.shape
        hf, sf = self._run(x, "f", True)
        hb, sb = self._run(x, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.p["o"] + self.p["ob"]
        trans = self.p["t"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(batch)
        d_e = marginal.copy()
        d_t = np.zeros_like(trans)
        gold = np.zeros(batch, np.float32)
        for t in range(steps):
            d_e[t, rows, y[t]] -= 1
            gold += e[t, rows, y[t]]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                d_t += pair.sum(axis=0)
                np.add.at(d_t, (y[t - 1], y[t]), -1)
                gold += trans[y[t - 1], y[t]]
        flat = both.reshape(-1, both.shape[2])
        g = {"t": d_t, "o": flat.T @ d_e.reshape(-1, self.tags), "ob": d_e.sum(axis=(0, 1))}
        d_both = d_e @ self.p["o"].T
        h = self.hidden
        for d, saved, part in (("f", sf, d_both[:, :, :h]), ("b", sb, d_both[:, :, h:])):
            gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
            gc = np.zeros_like(self.p["c" + d])
            dh = np.zeros((batch, h), np.float32)
            dc = dh
            for t, was, before, i, f, o, new, squashed in reversed(saved):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed * squashed)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                np.add.at(gx, x[t], dz)
                gh += was.T @ dz
                gc += dz.sum(axis=0)
                dh = dz @ self.p["h" + d].T
                dc = dc * f
            g["x" + d], g["h" + d], g["c" + d] = gx, gh, gc
        return float((z - gold).mean()), {k: v / batch for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.015, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; returns the mean loss per epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                rows = order[a:a + batch]
                loss, g = self.gradients(x[rows], y[rows])
                total += loss * len(rows)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale = min(1.0, 5.0 / max(norm, 1e-9))
                now = rate * (1 - epoch / epochs * 0.8)
                for k, v in g.items():
                    v = v * scale
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(len(x), 1))
        return losses
