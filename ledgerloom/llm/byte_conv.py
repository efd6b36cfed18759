"""A byte-level convolutional network in numpy: filters of several widths over fixed-length windows, max-pooled, then linear.

A filter of width w is w tables of 256 weights, one for each byte, so a convolution is w table look-ups and additions.
Texts are laid out in one buffer, each followed by zeros up to a whole number of windows; a window reads the first bytes
of the next, so windows overlap by the widest filter less one and cover the whole text. The last window of a text leaves
out the places from which a filter would reach into the next text; they hold nothing but zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices

#: Bytes that are convolved at once: few, so that the responses stay in the processor's cache.
BUFFER_BYTES = 1 << 15


def lay_out(texts: list[bytes], window: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' buffer (with ``widest`` more zeros at its end) and the text of each window. Every text has one at least."""
    counts = np.array([max(1, -(-(len(t) + widest - 1) // window)) for t in texts], np.int64)
    buffer = np.zeros(int(counts.sum()) * window + widest, np.uint8)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * window
    return buffer, np.repeat(np.arange(len(texts)), counts)


class ByteConv:
    """``widths`` maps a filter's width to the number of such filters; ``classes`` outputs."""

    def __init__(self, widths: dict[int, int], classes: int, window: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.window, self.widest = window, max(widths)
        self.tables = {w: (rng.standard_normal((w, 256, f)) * 0.3).astype(np.float32) for w, f in widths.items()}
        total = sum(widths.values())
        self.bias = np.zeros(total, np.float32)
        self.weight = (rng.standard_normal((total, classes)) * 0.1).astype(np.float32)
        self.offset = np.zeros(classes, np.float32)

    def _responses(self, buffer: np.ndarray, n: int, last: np.ndarray) -> Iterator[np.ndarray]:
        for w, table in self.tables.items():
            out = table[0][buffer[:n]]
            for k in range(1, w):
                out += table[k][buffer[k : k + n]]
            out = out.reshape(n // self.window, self.window, -1)
            out[last, self.window - w + 1 :] = -np.inf
            yield out

    def features(self, buffer: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Max-pooled rectified responses of every window; ``owner`` is the text of each."""
        n = len(buffer) - self.widest
        parts, last = [], np.r_[owner[1:] != owner[:-1], True]
        step = max(1, BUFFER_BYTES // self.window) * self.window
        for at in range(0, n, step):
            m = min(step, n - at)
            ends = last[at // self.window : (at + m) // self.window]
            parts.append(np.concatenate([r.max(axis=1) for r in self._responses(buffer[at : at + m + self.widest], m, ends)], axis=1))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def logits(self, buffer: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.features(buffer, owner) @ self.weight + self.offset

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02, seed: int = 11) -> None:
        """Softmax regression through the pooled responses by Adam; ``windows`` are rows of window + widest bytes."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.bias, self.weight, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        chance = weights / weights.sum()
        for step in range(1, steps + 1):
            at = rng.choice(len(windows), batch, p=chance)
            x, y = windows[at], labels[at]
            pooled, peaks = [], []
            for w, table in self.tables.items():
                out = table[0][x[:, : self.window]]
                for k in range(1, w):
                    out += table[k][x[:, k : k + self.window]]
                peak = out.argmax(axis=1)
                peaks.append(peak)
                pooled.append(np.take_along_axis(out, peak[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(pooled, axis=1) + self.bias
            hidden = np.maximum(raw, 0)
            z = hidden @ self.weight + self.offset
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), y] -= 1
            p /= batch
            back = (p @ self.weight.T) * (raw > 0)
            grads, lo = [], 0
            rows = np.arange(batch)[:, None]
            for (w, table), peak in zip(self.tables.items(), peaks, strict=True):
                f = table.shape[2]
                g, part = np.zeros_like(table), back[:, lo : lo + f]
                for k in range(w):
                    np.add.at(g[k], (x[rows, peak + k], np.arange(f)[None, :]), part)
                grads.append(g)
                lo += f
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def batches_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a string column as bytes, about a megabyte at a time, with the number of the first."""
    for lo, hi in slices(offsets):
        yield lo, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(lo, hi)]


def training_windows(texts: list[str], window: int, widest: int, seed: int, crop: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts and the text of each; a share of ``crop`` more are cut short, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    rows, owner = [], []
    for k, t in enumerate(raw):
        for at in range(0, max(1, len(t)), window):
            piece = t[at : at + window + widest]
            pieces = [piece]
            if rng.random() < crop:
                size = int(rng.integers(6, 80))
                start = int(rng.integers(0, max(1, len(piece) - size)))
                pieces.append(piece[start : start + size])
            for p in pieces:
                rows.append(np.frombuffer(p[: window + widest].ljust(window + widest, b"\0"), np.uint8))
                owner.append(k)
    return np.array(rows, np.uint8).reshape(-1, window + widest), np.array(owner, np.int64)
