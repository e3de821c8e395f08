"""A small character-level bidirectional LSTM with a CRF on top, in numpy.

Characters come in as classes. Training minimises the negative log-likelihood of tag
sequences with Adam; decoding is by Viterbi. All arrays are batches of windows.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start_model(classes: int, tags: int, seed: int = 7) -> dict[str, np.ndarray]:
    dice = np.random.default_rng(seed)
    model = {}
    for way in ("f", "b"):
        model[f"in_{way}"] = dice.normal(0, 0.3, (classes, 4 * HIDDEN))
        model[f"rec_{way}"] = dice.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    model["out"] = dice.normal(0, 0.2, (2 * HIDDEN, tags))
    model["bias"] = np.zeros(tags)
    model["trans"] = np.zeros((tags, tags))
    return model


def _run(x, inner, rec, keep=False):
    """Hidden states of one direction (n, t, HIDDEN), with what the backward pass needs."""
    n, t = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, held = np.empty((n, t, HIDDEN)), []
    for k in range(t):
        z = inner[x[:, k]] + h @ rec
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before_h, before_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if keep:
            held.append((i, f, o, g, tc, before_h, before_c))
    return out, held


def _run_back(x, inner, rec, held, d_out):
    d_inner, d_rec = np.zeros_like(inner), np.zeros_like(rec)
    dh, dc = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
    for k in reversed(range(x.shape[1])):
        i, f, o, g, tc, before_h, before_c = held[k]
        dh = dh + d_out[:, k]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1
        )
        np.add.at(d_inner, x[:, k], dz)
        d_rec += before_h.T @ dz
        dh, dc = dz @ rec.T, dc * f
    return d_inner, d_rec


def emissions(model, x) -> np.ndarray:
    """Tag scores (n, t, tags) of windows of character classes (n, t)."""
    ahead, _ = _run(x, model["in_f"], model["rec_f"])
    behind, _ = _run(x[:, ::-1], model["in_b"], model["rec_b"])
    return np.concatenate([ahead, behind[:, ::-1]], 2) @ model["out"] + model["bias"]


def _log_sum(a, axis):
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _step(model, x, y):
    """Loss per window and gradients."""
    n, t = x.shape
    ahead, held_f = _run(x, model["in_f"], model["rec_f"], True)
    behind, held_b = _run(x[:, ::-1], model["in_b"], model["rec_b"], True)
    both = np.concatenate([ahead, behind[:, ::-1]], 2)
    em, trans = both @ model["out"] + model["bias"], model["trans"]
    tags = trans.shape[0]
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[:, 0] = em[:, 0]
    for k in range(1, t):
        alpha[:, k] = em[:, k] + _log_sum(alpha[:, k - 1, :, None] + trans, 1)
    for k in reversed(range(t - 1)):
        beta[:, k] = _log_sum(trans + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
    log_z = _log_sum(alpha[:, -1], 1)
    rows, steps = np.arange(n)[:, None], np.arange(t)[None]
    gold = em[rows, steps, y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
    d_em = np.exp(alpha + beta - log_z[:, None, None])
    d_em[rows, steps, y] -= 1
    pair = alpha[:, :-1, :, None] + trans + (em + beta)[:, 1:, None, :] - log_z[:, None, None, None]
    d_trans = np.exp(pair).sum((0, 1))
    np.subtract.at(d_trans, (y[:, :-1], y[:, 1:]), 1)
    d_both = d_em @ model["out"].T
    grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, tags), "bias": d_em.sum((0, 1)), "trans": d_trans}
    grads["in_f"], grads["rec_f"] = _run_back(x, model["in_f"], model["rec_f"], held_f, d_both[:, :, :HIDDEN])
    grads["in_b"], grads["rec_b"] = _run_back(x[:, ::-1], model["in_b"], model["rec_b"], held_b, d_both[:, ::-1, HIDDEN:])
    return (log_z - gold).mean(), {k: g / n for k, g in grads.items()}


def train(x: np.ndarray, y: np.ndarray, classes: int, tags: int, steps: int = 240, batch: int = 48, rate: float = 0.02, seed: int = 7):
    """Fit to windows ``x`` (n, t) with tags ``y``; an empty sample gives the untrained model."""
    model = start_model(classes, tags, seed)
    if not len(x):
        return model
    dice = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        own = dice.integers(0, len(x), batch)
        _, grads = _step(model, x[own], y[own])
        pace = rate * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = np.clip(g, -5, 5)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def viterbi(model, scores: np.ndarray) -> np.ndarray:
    """Best tag sequences (n, t) for scores (n, t, tags)."""
    trans = model["trans"]
    best, back = scores[:, 0], []
    for k in range(1, scores.shape[1]):
        options = best[:, :, None] + trans
        back.append(options.argmax(1))
        best = options.max(1) + scores[:, k]
    path = [best.argmax(1)]
    rows = np.arange(len(scores))
    for step in reversed(back):
        path.append(step[rows, path[-1]])
    return np.stack(path[::-1], 1)
