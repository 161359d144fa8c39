"""A character tagger in numpy: bidirectional LSTM with transitions of a linear-chain CRF."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHARS = 99  # printable ASCII from 2 on, 0 outside of the text, 1 any other, 98 other letters


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ids = np.ones(len(codes), dtype=np.int64)
    ascii_ = (codes >= 32) & (codes < 127)
    ids[ascii_] = codes[ascii_].astype(np.int64) - 30
    ids[(codes >= 0xC0)] = 98
    return ids


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Parameters by name; ``tags`` outputs for every character."""

    weights: dict[str, np.ndarray]
    tags: int
    hidden: int

    @classmethod
    def fresh(cls, tags: int, embed: int = 12, hidden: int = 16, seed: int = 5) -> Tagger:
        dice = np.random.default_rng(seed)
        weights = {"embed": dice.normal(0, 0.3, (CHARS, embed))}
        for way in ("f", "b"):
            weights[f"w{way}"] = dice.normal(0, embed**-0.5, (embed, 4 * hidden))
            weights[f"u{way}"] = dice.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            weights[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        weights["out"] = dice.normal(0, 0.2, (2 * hidden, tags))
        weights["bias"] = np.zeros(tags)
        weights["moves"] = np.zeros((tags, tags))
        return cls(weights, tags, hidden)

    def _run(self, way: str, x: np.ndarray, keep: list | None):
        """States (rows x time x hidden) of one direction."""
        w, size = self.weights, self.hidden
        rows, time = x.shape
        order = range(time) if way == "f" else range(time - 1, -1, -1)
        h, c = np.zeros((rows, size)), np.zeros((rows, size))
        out = np.empty((rows, time, size))
        table = w["embed"] @ w[f"w{way}"] + w[f"c{way}"]
        for t in order:
            z = table[x[:, t]] + h @ w[f"u{way}"]
            gates = sigmoid(z[:, :3 * size])
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            g = np.tanh(z[:, 3 * size:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = np.concatenate([
            self._run(way, x, None if keep is None else keep.setdefault(way, [])) for way in ("f", "b")],
            axis=2)
        if keep is not None:
            keep["states"] = states
        return states @ self.weights["out"] + self.weights["bias"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag lines and its slopes."""
        w, keep = self.weights, {}
        scores = self.scores(x, keep)
        rows, time, _ = scores.shape
        moves = w["moves"]
        ahead = np.empty_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, time):
            ahead[:, t] = scores[:, t] + lse(ahead[:, t - 1, :, None] + moves, 1)
        behind = np.zeros_like(scores)
        for t in range(time - 2, -1, -1):
            behind[:, t] = lse(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = lse(ahead[:, -1], 1)
        at, when = np.arange(rows)[:, None], np.arange(time)
        gold = scores[at, when, y].sum(1) + moves[y[:, :-1], y[:, 1:]].sum(1)
        slopes = np.exp(ahead + behind - total[:, None, None])
        slopes[at, when, y] -= 1
        slopes /= rows
        pairs = np.zeros_like(moves)
        for t in range(1, time):
            pairs += np.exp(ahead[:, t - 1, :, None] + moves + (scores[:, t] + behind[:, t])[:, None, :]
                            - total[:, None, None]).sum(0)
        np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
        out = {"moves": pairs / rows, "bias": slopes.sum((0, 1)), "embed": np.zeros_like(w["embed"]),
               "out": np.einsum("rth,rtk->hk", keep["states"], slopes)}
        back = slopes @ w["out"].T
        for way, part in (("f", back[:, :, :self.hidden]), ("b", back[:, :, self.hidden:])):
            self._back(way, x, part, keep[way], out)
        return float((total - gold).mean()), out

    def _back(self, way: str, x: np.ndarray, slopes: np.ndarray, kept: list, out: dict) -> None:
        w, size = self.weights, self.hidden
        dh, dc = np.zeros((len(x), size)), np.zeros((len(x), size))
        du = np.zeros_like(w[f"u{way}"])
        by_char = np.zeros((CHARS, 4 * size))
        for t, h, before, i, f, o, g, tc in reversed(kept):
            dh = dh + slopes[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                 dc * i * (1 - g**2)], axis=1)
            du += h.T @ dz
            np.add.at(by_char, x[:, t], dz)
            dh, dc = dz @ w[f"u{way}"].T, dc * f
        out[f"u{way}"] = du
        out[f"c{way}"] = by_char.sum(0)
        out[f"w{way}"] = w["embed"].T @ by_char
        out["embed"] += by_char @ w[f"w{way}"].T

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02,
            seed: int = 9) -> list[float]:
        """Adam on random batches; returns the losses."""
        dice = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            some = dice.integers(0, len(x), batch)
            loss, slopes = self.gradient(x[some], y[some])
            losses.append(loss)
            speed = rate * (1 - (step - 1) / steps)
            for k, slope in slopes.items():
                slope = np.clip(slope, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope**2
                self.weights[k] -= speed * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag lines of score lines of any lengths; similar lengths go together."""
        moves = self.weights["moves"]
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        for at in range(0, len(order), 256):
            some = order[at:at + 256]
            lengths = np.array([len(scores[i]) for i in some])
            time = int(lengths.max())
            lines = np.zeros((len(some), time, self.tags))
            for row, i in enumerate(some):
                lines[row, :len(scores[i])] = scores[i]
            best = lines[:, 0].copy()
            came = np.zeros((len(some), time, self.tags), dtype=np.int8)
            stay = np.arange(self.tags, dtype=np.int8)
            for t in range(1, time):
                reach = best[:, :, None] + moves
                source = reach.argmax(1)
                going = (lengths > t)[:, None]
                came[:, t] = np.where(going, source, stay)
                best = np.where(going, np.take_along_axis(reach, source[:, None], 1)[:, 0] + lines[:, t], best)
            tag = best.argmax(1)
            path = np.empty((len(some), time), dtype=np.int8)
            for t in range(time - 1, -1, -1):
                path[:, t] = tag
                tag = came[np.arange(len(some)), t, tag]
            for row, i in enumerate(some):
                out[i] = path[row, :lengths[row]]
        return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
