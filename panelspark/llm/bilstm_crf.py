"""A small character tagger in numpy: bidirectional LSTM, CRF transitions, Adam.

Arrays are feature-major (features, windows), so that gates are contiguous.  The activation is
x (27 + x^2) / (27 + 9 x^2) on [-3, 3], a close and much cheaper relative of tanh that reaches 1
at 3; gates are (1 + bend(z / 2)) / 2, all gates in one call.
"""

from __future__ import annotations

import numpy as np

SYMBOLS, OTHER, PAD = 131, 128, 130


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point: ASCII by itself, all beyond by one."""
    return np.where(codes < 128, codes, OTHER).astype(np.uint8)


def bend(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    np.minimum(x, 3.0, out=out)
    np.maximum(out, -3.0, out=out)
    np.multiply(out, out, out=spare)
    spare += 27.0
    out *= spare
    spare -= 24.0
    spare *= 9.0
    out /= spare


def bend_and_slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.clip(x, -3.0, 3.0)
    q = x * x
    return x * (27 + q) / (27 + 9 * q), (q - 9) ** 2 / (9 * (q + 3) ** 2)


class Tagger:
    """Tags 0 (outside) to n_tags - 1 for each character of windows of symbols."""

    def __init__(self, n_tags: int, hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.n_tags = n_tags
        small = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"out": small(n_tags, 2 * h), "bias": np.zeros((n_tags, 1), np.float32), "move": np.zeros((n_tags, n_tags), np.float32),
                  "begin": np.zeros(n_tags, np.float32), "end": np.zeros(n_tags, np.float32)}
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = small(4 * h, SYMBOLS), small(4 * h, h)
            self.p["x" + d][h:2 * h] += 1.0  # remember at first

    def _halved(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Input table and recurrent weights with the gates' rows halved, ready for one activation."""
        scale = np.full((4 * self.hidden, 1), 0.5, np.float32)
        scale[3 * self.hidden:] = 1.0
        return np.ascontiguousarray(self.p["x" + d] * scale), np.ascontiguousarray(self.p["h" + d] * scale)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (steps, tags, windows) of symbols (steps, windows)."""
        steps, n = x.shape
        h = self.hidden
        out = np.empty((steps, self.n_tags, n), np.float32)
        for d in "fb":
            table, recur = self._halved(d)
            weight = np.ascontiguousarray(self.p["out"][:, :h] if d == "f" else self.p["out"][:, h:])
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            z, part, keep = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
            spare = np.empty((4 * h, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(table, x[t], axis=1, out=z, mode="clip")
                np.matmul(recur, state, out=part)
                z += part
                bend(z, z, spare)
                gates = z[:3 * h]
                gates += 1.0
                gates *= 0.5
                cell *= z[h:2 * h]
                np.multiply(z[:h], z[3 * h:], out=keep)
                cell += keep
                bend(cell, state, spare[:h])
                state *= z[2 * h:3 * h]
                if d == "f":
                    np.matmul(weight, state, out=out[t])
                else:
                    out[t] += weight @ state
        out += self.p["bias"][None]
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (steps, windows) over the CRF; windows in which no tag can beat all-outside are told by a bound."""
        e = self.emissions(x)
        p = self.p
        tags = np.zeros(x.shape, np.uint8)
        # Leaving the all-outside path gains, at each step off it, at most its emission's lead and two transitions' leads.
        lead = max(0.0, float(max((p["move"] - p["move"][0, 0]).max(), (p["begin"] - p["begin"][0]).max(), (p["end"] - p["end"][0]).max())))
        gain = np.max(e[:, 1:] - e[:, :1], axis=(0, 1)) + 2 * lead
        open_ = np.flatnonzero(gain > 0)
        if len(open_):
            tags[:, open_] = self._viterbi(np.ascontiguousarray(e[:, :, open_]))
        return tags

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        steps, k, n = e.shape
        back = np.empty((steps, k, n), np.uint8)
        score = e[0] + self.p["begin"][:, None]
        for t in range(1, steps):
            every = score[:, None, :] + self.p["move"][:, :, None]
            back[t] = every.argmax(axis=0)
            score = every.max(axis=0) + e[t]
        out = np.empty((steps, n), np.uint8)
        at = (score + self.p["end"][:, None]).argmax(axis=0)
        out[-1] = at
        for t in range(steps - 1, 0, -1):
            at = back[t][at, np.arange(n)]
            out[t - 1] = at
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 3) -> float:
        """Train on symbols and tags (windows, steps); returns the last epoch's mean loss of a character."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                pick = order[at:at + batch]
                value, grad = self._gradient(x[pick].T, y[pick].T)
                total += value * len(pick)
                step += 1
                lr = rate * (1 - epoch / epochs * 0.8)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            loss = total / max(1, len(x))
        return loss

    def _run(self, x: np.ndarray, d: str) -> list[tuple]:
        h, n = self.hidden, x.shape[1]
        state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        kept = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = self.p["x" + d][:, x[t]] + self.p["h" + d] @ state
            gates, slope = bend_and_slope(z[:3 * h] * np.float32(0.5))
            gates, slope = (1 + gates) / 2, slope / 4
            new, new_slope = bend_and_slope(z[3 * h:])
            before, old = state, cell
            cell = gates[h:2 * h] * cell + gates[:h] * new
            bent, bent_slope = bend_and_slope(cell)
            state = gates[2 * h:] * bent
            kept.append((t, gates, new, old, bent, before, state, np.concatenate([slope, new_slope]), bent_slope))
        return kept

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        steps, n = x.shape
        h, p = self.hidden, self.p
        runs = {d: self._run(x, d) for d in "fb"}
        states = np.empty((steps, 2 * h, n), np.float32)
        for d, lo in (("f", 0), ("b", h)):
            for item in runs[d]:
                states[item[0], lo:lo + h] = item[6]
        e = np.einsum("kh,shn->skn", p["out"], states) + p["bias"][None]
        loss, de, grad = self._crf(e, y)
        grad["out"] = np.einsum("skn,shn->kh", de, states)
        grad["bias"] = de.sum(axis=(0, 2))[:, None]
        dstates = np.einsum("kh,skn->shn", p["out"], de)
        eye = np.eye(SYMBOLS, dtype=np.float32)
        for d, lo in (("f", 0), ("b", h)):
            gx, gh = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d])
            dh, dc = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t, gates, new, old, bent, before, _, slope, bent_slope in reversed(runs[d]):
                dh = dh + dstates[t, lo:lo + h]
                i, f, o = gates[:h], gates[h:2 * h], gates[2 * h:]
                dc = dc + dh * o * bent_slope
                dz = np.concatenate([dc * new, dc * old, dh * bent, dc * i]) * slope
                gx += dz @ eye[x[t]]
                gh += dz @ before.T
                dh, dc = p["h" + d].T @ dz, dc * f
            grad["x" + d], grad["h" + d] = gx, gh
        return loss, grad

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a character, and its gradients by emissions, transitions and ends."""
        steps, k, n = e.shape
        p, all_ = self.p, np.arange(n)

        def logsum(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = e[0] + p["begin"][:, None]
        for t in range(1, steps):
            alpha[t] = logsum(alpha[t - 1][:, None] + p["move"][:, :, None], 0) + e[t]
        beta[-1] = p["end"][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(p["move"][:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        log_z = logsum(alpha[-1] + p["end"][:, None], 0)
        score = p["begin"][y[0]] + p["end"][y[-1]] + sum(e[t][y[t], all_] for t in range(steps)) + p["move"][y[:-1], y[1:]].sum(axis=0)
        scale = 1.0 / (n * steps)
        de = np.exp(alpha + beta - log_z) * scale
        move = np.zeros((k, k), np.float32)
        for t in range(1, steps):
            move += np.exp(alpha[t - 1][:, None] + p["move"][:, :, None] + (e[t] + beta[t])[None] - log_z).sum(axis=2) * scale
        grad = {"begin": de[0].sum(axis=1), "end": de[-1].sum(axis=1), "move": move}
        for t in range(steps):
            de[t][y[t], all_] -= scale
        np.add.at(grad["begin"], y[0], -scale)
        np.add.at(grad["end"], y[-1], -scale)
        np.add.at(grad["move"], (y[:-1].ravel(), y[1:].ravel()), -scale)
        return float((log_z - score).sum() * scale), de, grad
