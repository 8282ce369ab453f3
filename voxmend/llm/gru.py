"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried on."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
#: Frequent words, the end of a document among them, in classes of one size; all other words in classes by their ending.
HEAD_CLASSES, CLASS_WORDS = 32, 32
TAIL_CLASSES = 64
HEAD = HEAD_CLASSES * CLASS_WORDS
SYMBOLS = HEAD + TAIL_CLASSES
#: Number of the end of a document: also what stands before its first word.
END = 0
STEPS = 16
STREAMS = 512
WINDOW = 32

Params = dict[str, np.ndarray]


def fresh(seed: int = 5) -> Params:
    rng = np.random.Generator(np.random.PCG64(seed))

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {
        "in": normal(SYMBOLS, 3 * HIDDEN, scale=0.2),  # each symbol's share of update gate, reset gate and candidate
        "gates": normal(HIDDEN, 2 * HIDDEN, scale=0.2),
        "cand": normal(HIDDEN, HIDDEN, scale=0.2),
        "class": normal(HIDDEN, HEAD_CLASSES + TAIL_CLASSES, scale=0.1),
        "class_b": np.zeros(HEAD_CLASSES + TAIL_CLASSES, np.float32),
        "word": normal(HEAD_CLASSES, HIDDEN, CLASS_WORDS, scale=0.1),
        "word_b": np.zeros((HEAD_CLASSES, CLASS_WORDS), np.float32),
    }
    p["in"][:, :HIDDEN] -= 1.0  # states change slowly at first
    return p


def pack(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f4").tobytes()


def unpack(data: bytes) -> Params:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    like = fresh()
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


#: Each symbol's class, in one byte: a stable order of so small numbers is found without comparisons.
CLASS = np.concatenate([np.arange(HEAD) // CLASS_WORDS, HEAD_CLASSES + np.arange(TAIL_CLASSES)]).astype(np.uint8)


def class_of(symbol: np.ndarray) -> np.ndarray:
    return CLASS[symbol]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(p: Params, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state, gates and candidate after symbols x from states h."""
    g = p["in"][x]
    a = g[:, : 2 * HIDDEN]
    a += h @ p["gates"]
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5
    z, r = a[:, :HIDDEN], a[:, HIDDEN:]
    n = g[:, 2 * HIDDEN :]
    n += (r * h) @ p["cand"]
    np.tanh(n, out=n)
    return h + z * (n - h), z, r, n


def exponentials(z: np.ndarray) -> np.ndarray:
    """Replaces z by its exponentials, up to a factor for each row, and returns their sums. Rows are only brought down to
    their maximum where some number is out of the range that float32 has exponentials of."""
    if z.size and not -60.0 < z.min() <= z.max() < 60.0:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.arange(len(z))
    total = exponentials(z)
    return np.log(np.maximum(z[rows, at], 1e-30) / total)


def log_probabilities(p: Params, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of P(class of y), times P(y in its class) for frequent words, from states h."""
    c = class_of(y)
    out = log_softmax_at(h @ p["class"] + p["class_b"], c)
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1, dtype=np.uint8))
    for k in range(HEAD_CLASSES):
        here = order[edge[k] : edge[k + 1]]
        if len(here):
            out[here] += log_softmax_at(h[here] @ p["word"][k] + p["word_b"][k], y[here] % CLASS_WORDS)
    return out


def document_scores(p: Params, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's symbols[off[d] : off[d + 1]], each ended by END.

    All documents advance together; those that have ended fall out. States go on from window to window, so a document is
    scored as one sequence however long it is.
    """
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    begin, size = off[:-1][order], size[order]
    out = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    before = np.full(len(order), END, np.int64)
    at, falling = 0, -size
    longest = int(size[0]) if len(size) else 0
    while at < longest:
        states, targets, docs = [], [], []
        for _ in range(min(WINDOW, longest - at)):
            live = int(np.searchsorted(falling, -at, "left"))  # documents with more than at symbols
            if len(h) > live:
                h, before = h[:live], before[:live]
            h = step(p, before, h)[0]
            before = symbols[begin[:live] + at]
            states.append(h)
            targets.append(before)
            docs.append(np.arange(live))
            at += 1
        found = log_probabilities(p, np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(docs), found, len(out))
    back = np.zeros(len(out))
    back[order] = out
    return back


def window_gradients(p: Params, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, Params, np.ndarray]:
    """(loss a symbol, gradients, last states) of a window of inputs x and targets y (steps by streams) from states h.
    A state is zero where its input is END. Gradients stop at the window's start; the states go on."""
    steps, streams = x.shape
    kept = []
    for t in range(steps):
        h = h * (x[t] != END)[:, None]
        new, z, r, n = step(p, x[t], h)
        kept.append((h, z, r, n, new))
        h = new
    hs = np.concatenate([k[4] for k in kept])
    flat = y.reshape(-1)
    c = class_of(flat)
    g: Params = {}
    rows = np.arange(len(flat))

    def soft(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
        total = exponentials(z)
        z *= (1 / total)[:, None]
        i = rows[: len(z)]
        loss = -float(np.log(np.maximum(z[i, at], 1e-30)).sum())
        z[i, at] -= 1
        return z, loss

    d, loss = soft(hs @ p["class"] + p["class_b"], c)
    g["class"], g["class_b"] = hs.T @ d, d.sum(axis=0)
    dh = d @ p["class"].T
    g["word"], g["word_b"] = np.zeros_like(p["word"]), np.zeros_like(p["word_b"])
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1, dtype=np.uint8))
    for k in range(HEAD_CLASSES):
        here = order[edge[k] : edge[k + 1]]
        if len(here):
            hk = hs[here]
            d, more = soft(hk @ p["word"][k] + p["word_b"][k], flat[here] % CLASS_WORDS)
            loss += more
            g["word"][k], g["word_b"][k] = hk.T @ d, d.sum(axis=0)
            dh[here] += d @ p["word"][k].T
    dh = dh.reshape(steps, streams, HIDDEN)
    later = np.zeros((streams, HIDDEN), np.float32)
    pre = np.zeros((steps, streams, 3 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        hp, z, r, n, _ = kept[t]
        d = dh[t] + later
        dn = d * z * (1 - n * n)
        drh = dn @ p["cand"].T
        pre[t, :, :HIDDEN] = d * (n - hp) * z * (1 - z)
        pre[t, :, HIDDEN : 2 * HIDDEN] = drh * hp * r * (1 - r)
        pre[t, :, 2 * HIDDEN :] = dn
        later = d * (1 - z) + drh * r + pre[t, :, : 2 * HIDDEN] @ p["gates"].T
        later *= (x[t] != END)[:, None]
    hp = np.concatenate([k[0] for k in kept])
    rh = np.concatenate([k[0] * k[2] for k in kept])
    pre = pre.reshape(-1, 3 * HIDDEN)
    g["gates"], g["cand"] = hp.T @ pre[:, : 2 * HIDDEN], rh.T @ pre[:, 2 * HIDDEN :]
    ids = x.reshape(-1)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.diff(ids, prepend=-1))
    g["in"] = np.zeros_like(p["in"])
    g["in"][ids[heads]] = np.add.reduceat(pre[order], heads, axis=0)
    n = len(flat)
    return loss / n, {k: v / n for k, v in g.items()}, h


class Trainer:
    """Adam over windows; feed() takes whole documents one after the other, as symbols with END after each."""

    def __init__(self, p: Params, rate: float, streams: int = STREAMS, steps: int = STEPS):
        self.p = {k: v.copy() for k, v in p.items()}
        self.rate, self.streams, self.steps, self.n, self.seen, self.loss = rate, streams, steps, 0, 0, 0.0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def feed(self, symbols: np.ndarray, last: bool = True) -> np.ndarray:
        """Cuts the run into streams of one length and walks along them. Returns what fills no whole stream, to go before
        the next run; of the last run this remainder is walked along too, in fewer streams, until nothing is left."""
        while len(symbols):
            streams = max(1, min(self.streams, len(symbols) // 64))
            length = len(symbols) // streams
            self.walk(symbols[: streams * length].reshape(streams, length).T)
            symbols = symbols[streams * length :]
            if not last:
                break
        return symbols

    def walk(self, y: np.ndarray) -> None:
        """Learns from streams (columns) of symbols, each stream on from the end of the one before it."""
        length, streams = y.shape
        x = np.vstack([np.full((1, streams), END, y.dtype), y[:-1]])
        x[0, 1:] = y[-1, :-1]
        h = np.zeros((streams, HIDDEN), np.float32)
        for a in range(0, length, self.steps):
            loss, g, h = window_gradients(self.p, x[a : a + self.steps], y[a : a + self.steps], h)
            self.update(g)
            size = y[a : a + self.steps].size
            self.seen += size
            self.loss += loss * size

    def update(self, g: Params) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        a, b = self.rate / (1 - 0.9**self.n), 1 / (1 - 0.99**self.n)
        for k, v in g.items():
            m, s = self.m[k], self.v[k]
            m += 0.1 * (scale * v - m)
            s += 0.01 * ((scale * v) ** 2 - s)
            self.p[k] -= a * m / (np.sqrt(b * s) + 1e-6)
