"""A bidirectional LSTM with one output a step, in numpy, with training by back-propagation through time."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Inputs (time, batch, n_in) with a mask (time, batch); outputs probabilities (time, batch).

    Padding keeps the state, so both directions see only the true steps.
    """

    def __init__(self, n_in: int, n_hidden: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        self.h = n_hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"x{side}"] = (r.normal(size=(n_in, 4 * n_hidden)) / np.sqrt(n_in)).astype(np.float32)
            self.p[f"h{side}"] = (r.normal(size=(n_hidden, 4 * n_hidden)) / np.sqrt(n_hidden)).astype(np.float32)
            bias = np.zeros(4 * n_hidden, np.float32)
            bias[n_hidden : 2 * n_hidden] = 1
            self.p[f"c{side}"] = bias
        self.p["o"] = (r.normal(size=2 * n_hidden) / np.sqrt(2 * n_hidden)).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """Outputs, what training needs of each step, and the state after the last; state is that before the first."""
        n, (t, b) = self.h, mask.shape
        gates = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c = state or (np.zeros((b, n), np.float32), np.zeros((b, n), np.float32))
        out, kept = np.zeros((t, b, n), np.float32), []
        for k in range(t):
            a = gates[k] + h @ self.p[f"h{side}"]
            s = _sigmoid(a[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(a[:, 3 * n :])
            m = mask[k][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            kept.append((i, f, o, g, c, squashed, h, m))
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[k] = h
        return out, kept, (h, c)

    def _back(self, x: np.ndarray, kept: list, dout: np.ndarray, side: str, grads: dict) -> None:
        t = len(kept)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        da = np.zeros((*dout.shape[:2], 4 * self.h), np.float32)
        w = self.p[f"h{side}"]
        grads[f"h{side}"] = np.zeros_like(w)
        for k in reversed(range(t)):
            i, f, o, g, c, squashed, h, m = kept[k]
            dh = dh + dout[k]
            own, past = m * dh, (1 - m) * dh
            dnew = m * dc + own * o * (1 - squashed**2)
            da[k] = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * squashed * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            grads[f"h{side}"] += h.T @ da[k]
            dc = dnew * f + (1 - m) * dc
            dh = da[k] @ w.T + past
        flat = da.reshape(-1, da.shape[2])
        grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[f"c{side}"] = flat.sum(0)

    def states(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list, list]:
        f, kept_f, _ = self._pass(x, mask, "f")
        b, kept_b, _ = self._pass(x[::-1], mask[::-1], "b")
        return np.concatenate([f, b[::-1]], axis=2), kept_f, kept_b

    def predict(self, x: np.ndarray, mask: np.ndarray, steps: int = 512) -> np.ndarray:
        """Some steps at a time, so that little is held; each direction goes on with the state that it had."""
        total = np.zeros(mask.shape, np.float32)
        parts = [slice(k, k + steps) for k in range(0, len(mask), steps)]
        state = None
        for part in parts:
            out, _, state = self._pass(x[part], mask[part], "f", state)
            total[part] += out @ self.p["o"][: self.h]
        state = None
        for part in reversed(parts):
            out, _, state = self._pass(x[part][::-1], mask[part][::-1], "b", state)
            total[part] += out[::-1] @ self.p["o"][self.h :]
        return _sigmoid(total + self.p["z"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        both, kept_f, kept_b = self.states(x, mask)
        p = _sigmoid(both @ self.p["o"] + self.p["z"])
        n = mask.sum()
        loss = float(-(mask * np.where(y == 1, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / n)
        d = (mask * (p - y) / n).astype(np.float32)
        grads = {"o": np.einsum("tb,tbh->h", d, both), "z": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * self.p["o"]
        self._back(x, kept_f, dboth[:, :, : self.h], "f", grads)
        self._back(x[::-1], kept_b, dboth[::-1, :, self.h :], "b", grads)
        return loss, grads

    def fit(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.012) -> BiLSTM:
        """Adam over (x, mask, y) batches."""
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            for x, mask, y in batches:
                step += 1
                _, grads = self.gradients(x, mask, y)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * 0.7**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self
