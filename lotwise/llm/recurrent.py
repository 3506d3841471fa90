"""A bidirectional gated recurrent network with attention pooling, in numpy.

Two levels: characters of a word to a word vector, words of a window to a
probability. Forward and backward passes are written out; training is Adam.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRUAttention:
    """(T, B, D) inputs with a (T, B) mask to (B, 2H): two GRUs in opposite directions, then attention over time.

    Steps beyond the mask copy the state, so a padded sequence gives what the
    unpadded one gives.
    """

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        s = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.hidden = hidden
        self.p = {"av": (rng.standard_normal(hidden) * 0.1).astype(np.float32), "aw": s(2 * hidden, hidden)}
        for d in "fb":
            self.p |= {f"{d}w": s(inputs, 3 * hidden), f"{d}u": s(hidden, 3 * hidden), f"{d}c": np.zeros(3 * hidden, np.float32)}

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        H, (T, B, D) = self.hidden, x.shape
        U = self.p[f"{d}u"]
        pre = (x.reshape(T * B, D) @ self.p[f"{d}w"] + self.p[f"{d}c"]).reshape(T, B, 3 * H)
        h, out, cache = np.zeros((B, H), np.float32), np.empty((T, B, H), np.float32), [None] * T
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            m = mask[t][:, None]
            rz = _sigmoid(pre[t, :, : 2 * H] + h @ U[:, : 2 * H])
            r, z = rz[:, :H], rz[:, H:]
            rh = r * h
            n = np.tanh(pre[t, :, 2 * H :] + rh @ U[:, 2 * H :])
            new = h + m * (1 - z) * (n - h)
            cache[t] = (h, r, z, rh, n)
            out[t] = h = new
        return out, cache

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, cf = self._direction("f", x, mask)
        b, cb = self._direction("b", x, mask)
        h = np.concatenate([f, b], axis=2)
        T, B, K = h.shape
        a = np.tanh(h.reshape(T * B, K) @ self.p["aw"]).reshape(T, B, -1)
        e = np.where(mask > 0, a @ self.p["av"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        return (w[:, :, None] * h).sum(axis=0), (x, mask, h, a, w, cf, cb)

    def backward(self, dv: np.ndarray, cache: tuple, grad: dict) -> np.ndarray:
        """Adds to ``grad`` and returns the gradient of the inputs."""
        x, mask, h, a, w, cf, cb = cache
        T, B, K = h.shape
        H = self.hidden
        dw = (h * dv[None]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        dh = w[:, :, None] * dv[None]
        grad["av"] += np.einsum("tb,tbh->h", de, a)
        da = (de[:, :, None] * self.p["av"] * (1 - a * a)).reshape(T * B, -1)
        grad["aw"] += h.reshape(T * B, K).T @ da
        dh = dh + (da @ self.p["aw"].T).reshape(T, B, K)
        dx = np.zeros_like(x)
        for d, steps, c, part in (("f", range(T - 1, -1, -1), cf, dh[:, :, :H]), ("b", range(T), cb, dh[:, :, H:])):
            U, W = self.p[f"{d}u"], self.p[f"{d}w"]
            dpre, dnext = np.empty((T, B, 3 * H), np.float32), np.zeros((B, H), np.float32)
            for t in steps:
                hp, r, z, rh, n = c[t]
                m = mask[t][:, None]
                dnew = dnext + part[t]
                dn = dnew * m * (1 - z) * (1 - n * n)
                dz = -dnew * m * (n - hp) * z * (1 - z)
                drh = dn @ U[:, 2 * H :].T
                dr = drh * hp * r * (1 - r)
                drz = np.concatenate([dr, dz], axis=1)
                dpre[t, :, : 2 * H], dpre[t, :, 2 * H :] = drz, dn
                dnext = dnew * (1 - m * (1 - z)) + drh * r + drz @ U[:, : 2 * H].T
                grad[f"{d}u"][:, : 2 * H] += hp.T @ drz
                grad[f"{d}u"][:, 2 * H :] += rh.T @ dn
            flat = dpre.reshape(T * B, 3 * H)
            grad[f"{d}w"] += x.reshape(T * B, -1).T @ flat
            grad[f"{d}c"] += flat.sum(axis=0)
            dx += (flat @ W.T).reshape(x.shape)
        return dx


class WindowClassifier:
    """Probability that a window of words is a positive, from word and character inputs.

    Words have at most ``word_chars`` letters; whoever cuts a text into words
    divides longer ones (``abuse.plain_words`` does), so no letter goes unread.
    """

    def __init__(self, vocabulary: list[str], alphabet: str, seed: int = 7, word_dim: int = 24, char_dim: int = 12, char_hidden: int = 12, hidden: int = 24, word_chars: int = 16):
        rng = np.random.default_rng(seed)
        self.word_id = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: a word outside the vocabulary
        self.char_id = {c: i + 2 for i, c in enumerate(alphabet)}  # 0: padding, 1: another character
        self.word_chars = word_chars
        self.words = (rng.standard_normal((len(vocabulary) + 1, word_dim)) * 0.1).astype(np.float32)
        self.words[0] = 0
        self.chars = (rng.standard_normal((len(alphabet) + 2, char_dim)) * 0.3).astype(np.float32)
        self.char_net = BiGRUAttention(rng, char_dim, char_hidden)
        self.word_net = BiGRUAttention(rng, word_dim + 2 * char_hidden, hidden)
        self.out = {"w": (rng.standard_normal(2 * hidden) * 0.1).astype(np.float32), "b": np.zeros(1, np.float32)}

    def parameters(self) -> dict[str, np.ndarray]:
        named = {"words": self.words, "chars": self.chars, "ow": self.out["w"], "ob": self.out["b"]}
        return named | {f"c_{k}": v for k, v in self.char_net.p.items()} | {f"w_{k}": v for k, v in self.word_net.p.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "vectors")}

    def _vectors(self, words: list[str], most: int = 100_000) -> tuple[dict[str, int], np.ndarray]:
        """(row of each word, table of word and character vectors), kept between calls until the next training step or until ``most`` words are known."""
        if len(self.__dict__.get("known", ())) > most or "known" not in self.__dict__:
            self.known, self.vectors = {}, np.zeros((0, self.words.shape[1] + 2 * self.char_net.hidden), np.float32)
        new = [w for w in words if w not in self.known]
        if new:
            self.known |= {w: len(self.vectors) + i for i, w in enumerate(new)}
            rows = np.concatenate([self.words[[self.word_id.get(w, 0) for w in new]], self.encode_words(new)], axis=1)
            self.vectors = np.concatenate([self.vectors, rows])
        return self.known, self.vectors

    def _chars(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros((self.word_chars, len(words)), np.int64)
        for j, w in enumerate(words):
            for i, c in enumerate(w[: self.word_chars]):
                ids[i, j] = self.char_id.get(c, 1)
        longest = max(1, int((ids > 0).sum(axis=0).max(initial=1)))
        return ids[:longest], (ids[:longest] > 0).astype(np.float32)

    def encode_words(self, words: list[str]) -> np.ndarray:
        """Character vectors of distinct words, for scoring: (n, 2 * char_hidden)."""
        parts = []
        for k in range(0, len(words), 4096):
            ids, mask = self._chars(words[k : k + 4096])
            parts.append(self.char_net.forward(self.chars[ids], mask)[0])
        return np.concatenate(parts) if parts else np.zeros((0, 2 * self.char_net.hidden), np.float32)

    def _layout(self, windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        distinct: dict[str, int] = {}
        longest = max(len(w) for w in windows)
        at = np.zeros((longest, len(windows)), np.int64)
        mask = np.zeros((longest, len(windows)), np.float32)
        for b, w in enumerate(windows):
            for t, x in enumerate(w):
                at[t, b] = distinct.setdefault(x, len(distinct))
                mask[t, b] = 1
        return list(distinct), at, mask

    def score(self, windows: list[list[str]], batch: int = 1024) -> np.ndarray:
        """Probability of each (non-empty) window; windows are batched by length."""
        if not windows:
            return np.zeros(0, np.float32)
        index, table = self._vectors(sorted({x for w in windows for x in w}))
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        out = np.zeros(len(windows), np.float32)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            longest = len(windows[part[-1]])
            at = np.zeros((longest, len(part)), np.int64)
            mask = np.zeros((longest, len(part)), np.float32)
            for b, i in enumerate(part):
                n = len(windows[i])
                at[:n, b] = [index[x] for x in windows[i]]
                mask[:n, b] = 1
            v, _ = self.word_net.forward(table[at], mask)
            out[part] = _sigmoid(v @ self.out["w"] + self.out["b"])
        return out

    def loss_and_gradient(self, windows: list[list[str]], labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        distinct, at, mask = self._layout(windows)
        wid = np.array([self.word_id.get(w, 0) for w in distinct])
        cid, cmask = self._chars(distinct)
        cv, ccache = self.char_net.forward(self.chars[cid], cmask)
        table = np.concatenate([self.words[wid], cv], axis=1)
        v, wcache = self.word_net.forward(table[at], mask)
        p = _sigmoid(v @ self.out["w"] + self.out["b"])
        loss = float(-(weights * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / weights.sum())
        g = {k: np.zeros_like(x) for k, x in self.parameters().items()}
        do = (weights * (p - labels) / weights.sum()).astype(np.float32)
        g["ow"] += v.T @ do
        g["ob"] += do.sum()
        gw = {k: g[f"w_{k}"] for k in self.word_net.p}
        dx = self.word_net.backward(do[:, None] * self.out["w"][None], wcache, gw)
        dtable = np.zeros_like(table)
        np.add.at(dtable, at, dx)
        K = self.words.shape[1]
        np.add.at(g["words"], wid, dtable[:, :K])
        g["words"][0] = 0
        gc = {k: g[f"c_{k}"] for k in self.char_net.p}
        dchars = self.char_net.backward(dtable[:, K:], ccache, gc)
        np.add.at(g["chars"], cid, dchars)
        return loss, g

    def adam(self, g: dict, state: dict, rate: float) -> None:
        self.__dict__.pop("known", None)
        state["t"] = t = state.get("t", 0) + 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, p in self.parameters().items():
            m, v = state.setdefault(k, (np.zeros_like(p), np.zeros_like(p)))
            d = g[k] * clip
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
