"""A small causal self-attention model in numpy: training with Adam, and batched scoring of padded windows.

A place of the model is a token: a word, read as the mean of the embeddings of its subword ids, or an end. One head
looks back within the window, and the sum of the last token's embedding and of what the head has seen goes to a
softmax over the class of the next token. The most frequent ids have an embedding of their own, the others share their
class's.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Width of the model, window length, and how far windows overlap when texts are scored.
WIDTH = 16
WINDOW = 24
OVERLAP = 4


class Tokens(NamedTuple):
    """Tokens as runs of embedding rows: token i reads rows[starts[i] : starts[i] + sizes[i]]; no token is empty."""

    rows: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def initial(inputs: int, classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    sizes = {"embed": (inputs, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "out": (WIDTH, classes), "bias": (classes,)}
    scale = {"embed": 0.3, "place": 0.1, "bias": 0.0}
    return {k: (rng.standard_normal(s) * scale.get(k, WIDTH**-0.5)).astype(np.float32) for k, s in sizes.items()}


def _gathered(t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the tokens at, and how many each has."""
    sizes = t.sizes[at]
    firsts = np.cumsum(sizes) - sizes
    return t.rows[np.arange(int(sizes.sum())) + np.repeat(t.starts[at] - firsts, sizes)], sizes


#: Rows of a token that are added one place at a time for all tokens; what longer tokens have beyond is added by token.
_STEPS = 8


def sums(embed: np.ndarray, t: Tokens, at: np.ndarray) -> np.ndarray:
    """The sums of the embeddings of the tokens at."""
    sizes = np.minimum(t.sizes[at], _STEPS + 1)
    # the longest tokens first, so that those that have a further row are a prefix
    order = np.argsort((_STEPS + 1 - sizes).astype(np.uint8), kind="stable")
    longer = len(at) - np.cumsum(np.bincount(sizes, minlength=_STEPS + 2))
    starts = t.starts[at][order]
    got = np.take(embed, t.rows[starts], axis=0)
    for step in range(1, _STEPS):
        if not longer[step]:
            break
        got[: longer[step]] += np.take(embed, t.rows[starts[: longer[step]] + step], axis=0)
    if n := int(longer[_STEPS]):
        more = t.sizes[at[order[:n]]] - _STEPS
        rows, _ = _gathered(Tokens(t.rows, starts[:n] + _STEPS, more), np.arange(n))
        got[:n] += np.add.reduceat(embed[rows], np.cumsum(more) - more)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return np.take(got, back, axis=0)


def means(embed: np.ndarray, t: Tokens, at: np.ndarray) -> np.ndarray:
    return sums(embed, t, at) / t.sizes[at][:, None].astype(embed.dtype)


def _joined(p: dict[str, np.ndarray]) -> np.ndarray:
    """The weights of queries (with the scale of their products), keys and values side by side."""
    return np.hstack([p["q"] * np.float32(WIDTH**-0.5), p["k"], p["v"]])


def _looked(flat: np.ndarray, joined: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Queries, keys and values of windows laid end to end, and how much each place looks at each, not yet of sum 1."""
    every = (flat @ joined).reshape(-1, WINDOW, 3 * WIDTH)
    qkv = [every[:, :, i : i + WIDTH] for i in range(0, 3 * WIDTH, WIDTH)]
    a = qkv[0] @ qkv[1].transpose(0, 2, 1)
    np.clip(a, -_BOUND, _BOUND, out=a)
    np.exp(a, out=a)
    a *= _SEEN
    return qkv, a


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(WINDOW, np.float32)
#: Scores are kept within these bounds, so that exponents need no shift.
_BOUND = np.float32(60)
#: Windows that are worked on together: few enough for a core's cache.
TOGETHER = 64


def class_log_p(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes y (windows by places) after the inputs x up to each place.

    x: (windows, places, WIDTH), without the places' own vectors. keep: places to score; the others get 0.
    """
    joined, ones = _joined(p), np.ones(len(p["bias"]), np.float32)
    out = np.zeros(y.shape, np.float32)
    for first in range(0, len(x), TOGETHER):
        part = slice(first, first + TOGETHER)
        flat = (x[part] + p["place"]).reshape(-1, WIDTH)
        (_, _, v), a = _looked(flat, joined)
        seen = a @ v
        seen /= (a @ _ONES)[:, :, None]
        h = seen.reshape(-1, WIDTH) @ p["o"]
        h += flat
        kept = keep[part]
        h, targets = h[kept.ravel()], y[part][kept]
        logits = h @ p["out"]
        logits += p["bias"]
        np.clip(logits, -_BOUND, _BOUND, out=logits)
        got = logits[np.arange(len(logits)), targets]
        np.exp(logits, out=logits)
        got -= np.log(logits @ ones)
        out[part][kept] = got
    return out


def gradients(p: dict[str, np.ndarray], t: Tokens, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the places of weight 1 of windows of tokens (at, windows by places), and its gradients."""
    embed, joined, ones = p["embed"], _joined(p), np.ones(len(p["bias"]), np.float32)
    sizes = t.sizes[at.ravel()]
    share = (1 / sizes).astype(np.float32)
    every = sums(embed, t, at.ravel())
    every *= share[:, None]
    n, loss = max(1.0, float(weight.sum())), 0.0
    g = {k: np.zeros_like(v) for k, v in p.items() if k in ("place", "o", "bias")}
    g_out, g_joined, back = np.zeros_like(p["out"].T), np.zeros_like(joined.T), np.empty_like(every)
    for first in range(0, len(at), TOGETHER):
        part, flats = slice(first, first + TOGETHER), slice(first * WINDOW, (first + TOGETHER) * WINDOW)
        flat = every[flats]
        flat.reshape(-1, WINDOW, WIDTH)[:] += p["place"]
        (q, k, v), a = _looked(flat, joined)
        a /= (a @ _ONES)[:, :, None]
        seen = (a @ v).reshape(flat.shape)
        h = seen @ p["o"]
        h += flat
        d = h @ p["out"]
        d += p["bias"]
        np.clip(d, -_BOUND, _BOUND, out=d)
        mass, target = weight[part].ravel(), np.arange(0, d.size, d.shape[1]) + y[part].ravel()
        logits = d.ravel()[target]
        np.exp(d, out=d)
        total = d @ ones
        loss += float((np.log(total) - logits) @ mass)
        of = (mass / n).astype(d.dtype)
        d *= (of / total)[:, None]
        d.reshape(-1)[target] -= of
        g_out += d.T @ h
        g["bias"] += np.ones(len(d), np.float32) @ d
        dh = d @ p["out"].T
        g["o"] += seen.T @ dh
        dseen = (dh @ p["o"].T).reshape(v.shape)
        da = dseen @ v.transpose(0, 2, 1)
        da -= ((da * a) @ _ONES)[:, :, None]
        da *= a
        dqkv = np.empty((*v.shape[:2], 3 * WIDTH), d.dtype)
        for i, (x, z) in enumerate(((da, k), (da.transpose(0, 2, 1), q), (a.transpose(0, 2, 1), dseen))):
            np.matmul(x, z, out=dqkv[:, :, i * WIDTH : (i + 1) * WIDTH])
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        # the queries hold the scale, which their keys' gradient needs and their own gets from the weights
        g_joined += dqkv.T @ flat
        dh += dqkv @ joined.T
        g["place"] += (np.ones(len(da), np.float32) @ dh.reshape(len(da), -1)).reshape(WINDOW, WIDTH)
        np.multiply(dh, share[flats, None], out=back[flats])
    g |= {"out": g_out.T, "q": g_joined[:WIDTH].T * np.float32(WIDTH**-0.5), "k": g_joined[WIDTH : 2 * WIDTH].T, "v": g_joined[2 * WIDTH :].T}
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows = t.rows[np.arange(len(owner)) + (t.starts[at.ravel()] - np.cumsum(sizes) + sizes)[owner]]
    cells = np.take(np.arange(embed.size).reshape(embed.shape), rows, axis=0)
    back = np.take(back.astype(np.float64), owner, axis=0)
    g["embed"] = np.bincount(cells.ravel(), weights=back.ravel(), minlength=embed.size).astype(embed.dtype).reshape(embed.shape)
    return loss / n, g


def train(p: dict[str, np.ndarray], t: Tokens, at: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, seed: int = 0, batch: int = 128) -> tuple[dict[str, np.ndarray], float]:
    """Weights after one pass of Adam over the windows in a random order, and the mean loss."""
    p = {k: v.copy() for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.random.default_rng(seed).permutation(len(at))
    losses = []
    for step, first in enumerate(range(0, len(order), batch), 1):
        some = order[first : first + batch]
        loss, g = gradients(p, t, at[some], y[some], weight[some])
        losses.append(loss)
        size = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        for k in p:
            m[k] += np.float32(0.1) * (g[k] - m[k])
            s[k] += np.float32(0.01) * (g[k] * g[k] - s[k])
            p[k] -= size * m[k] / (np.sqrt(s[k]) + np.float32(1e-8))
    return p, float(np.mean(losses)) if losses else 0.0


def windows(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over sequences of these lengths laid end to end.

    (start of each window, its sequence, first place that it scores): the first window of a sequence scores all its
    places, the others what comes after the overlap, so each place is scored once.
    """
    stride = WINDOW - overlap
    counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // stride)) + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    firsts = np.cumsum(lengths) - lengths
    return firsts[owner] + number * stride, owner, np.where(number > 0, overlap, 0)


def padded(tokens: np.ndarray, lengths: np.ndarray, begin: int, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, weight, owner) of the windows: rows of tokens; begin stands before a sequence's first."""
    start, owner, skip = windows(lengths, overlap)
    ends = np.cumsum(lengths)
    at = start[:, None] + np.arange(WINDOW)
    inside = at < ends[owner][:, None]
    at = np.minimum(at, max(0, len(tokens) - 1))
    before = np.concatenate([[begin], tokens[:-1]]) if len(tokens) else tokens
    before = before.copy()
    before[(ends - lengths)[lengths > 0]] = begin
    weight = inside & (np.arange(WINDOW) >= skip[:, None])
    return before[at], tokens[at], weight, owner
