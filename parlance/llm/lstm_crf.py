"""A character-level bidirectional LSTM with a CRF over its outputs, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters: printable ASCII, line end, other letters, anything else.
N_CHARS = 98


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.full(len(points), 97, np.int64)
    ascii_ = (points >= 32) & (points < 127)
    out[ascii_] = points[ascii_] - 32
    out[points == 10] = 95
    out[points >= 0xC0] = 96
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    def __init__(self, labels: int, hidden: int = 12, embedding: int = 12, seed: int = 7):
        random = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        make = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"chars": make(N_CHARS, embedding) * np.float32(4), "out": make(2 * hidden, labels), "bias": np.zeros(labels, np.float32), "step": np.zeros((labels, labels), np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": make(embedding, 4 * hidden), f"h{way}": make(hidden, 4 * hidden), f"b{way}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{way}"][hidden : 2 * hidden] = 1  # remember at first

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction; x is (time, batch)."""
        p, n = self.p, self.hidden
        table = p["chars"] @ p[f"x{way}"] + p[f"b{way}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = table[x[t]] + h @ p[f"h{way}"]
            ifo, z = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
            i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
            was, before = c, h
            c = f * c + i * z
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, z, was, before, tc))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, "f", None), self._run(x, "b", None)], axis=2)
        return states @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely labels (time, batch) of windows x (time, batch)."""
        e, step = self.emissions(x), self.p["step"]
        back = np.empty((*x.shape, self.labels), np.int8)
        score = e[0]
        for t in range(1, len(x)):
            reach = score[:, :, None] + step
            back[t] = reach.argmax(1)
            score = reach.max(1) + e[t]
        out = np.empty(x.shape, np.int8)
        out[-1] = score.argmax(1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 1, 0, -1):
            out[t - 1] = back[t][rows, out[t]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood a character, and its gradients."""
        p, n, (time, batch) = self.p, self.hidden, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, "f", kept["f"]), self._run(x, "b", kept["b"])], axis=2)
        e, step = states @ p["out"] + p["bias"], p["step"]
        add = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, time):
            alpha[t] = add(alpha[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(time - 2, -1, -1):
            beta[t] = add((beta[t + 1] + e[t + 1])[:, None, :] + step, 2)
        total = add(alpha[-1], 1)
        rows = np.arange(batch)
        truth = sum(e[t, rows, y[t]] for t in range(time)) + sum(step[y[t - 1], y[t]] for t in range(1, time))
        scale = np.float32(1 / (time * batch))
        de = np.exp(alpha + beta - total[:, None])
        dstep = np.zeros_like(step)
        for t in range(1, time):
            pair = np.exp(alpha[t - 1][:, :, None] + step + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            dstep += pair.sum(0)
            np.subtract.at(dstep, (y[t - 1], y[t]), 1)
        for t in range(time):
            de[t, rows, y[t]] -= 1
        de *= scale
        g = {"step": dstep * scale, "bias": de.sum((0, 1)), "out": states.reshape(-1, 2 * n).T @ de.reshape(-1, self.labels)}
        dstates = de @ p["out"].T
        g["chars"] = np.zeros_like(p["chars"])
        for way, cut in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            dh_next = dc_next = np.zeros((batch, n), np.float32)
            dgates = np.empty((time, batch, 4 * n), np.float32)
            dwh = np.zeros_like(p[f"h{way}"])
            for t, i, f, o, z, was, before, tc in reversed(kept[way]):
                dh = dstates[t][:, cut] + dh_next
                dc = dh * o * (1 - tc * tc) + dc_next
                dg = np.concatenate([dc * z * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], axis=1)
                dgates[t] = dg
                dwh += before.T @ dg
                dh_next, dc_next = dg @ p[f"h{way}"].T, dc * f
            one_hot = np.zeros((time * batch, N_CHARS), np.float32)
            one_hot[np.arange(time * batch), x.ravel()] = 1
            by_char = one_hot.T @ dgates.reshape(-1, 4 * n)
            g |= {f"h{way}": dwh, f"b{way}": dgates.sum((0, 1)), f"x{way}": p["chars"].T @ by_char}
            g["chars"] += by_char @ p[f"x{way}"].T
        return float((total - truth).mean() / time), g

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over windows x, y (time, windows); returns the last losses' mean."""
        random, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for k in range(1, rounds + 1):
            some = random.integers(0, x.shape[1], batch)
            loss, g = self.gradients(x[:, some], y[:, some])
            losses.append(loss)
            norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
            pace = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
            for name, d in g.items():
                d = d * min(1.0, 1.0 / (norm + 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                self.p[name] = (self.p[name] - pace * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))
