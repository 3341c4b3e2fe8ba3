"""A small bidirectional gated recurrent network with attention pooling, in numpy.

The input at every word is the word's embedding beside the mean of the embeddings of its character trigrams, so
that a word that was never learned is still judged by its spelling. Both directions run in one loop. Attention
weighs the words' states, and the weighted state gives the logit of a window.
"""

from __future__ import annotations

import numpy as np

WORD_DIM, CHAR_DIM, STATE = 8, 8, 8
#: Rows of the table of character trigrams.
TRIGRAMS = 1 << 12
Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(vocabulary: int, seed: int) -> Params:
    random = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    return {
        "words": some(vocabulary + 1, WORD_DIM, scale=0.1),  # row 0: words that were not learned
        "chars": some(TRIGRAMS, CHAR_DIM, scale=0.3),
        "input": some(2, WORD_DIM + CHAR_DIM, 3 * STATE, scale=0.3),
        "input_bias": np.zeros((2, 1, 3 * STATE), np.float32),
        "state": some(2, STATE, 3 * STATE, scale=0.25),
        "state_bias": np.zeros((2, 1, STATE), np.float32),
        "attend": some(2 * STATE, STATE, scale=0.3),
        "attend_out": some(STATE, scale=0.3),
        "out": some(2 * STATE, scale=0.3),
        "out_bias": np.zeros(1, np.float32),
    }


def forward(p: Params, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``projected`` (time, 2, windows, 3 * STATE) is the input of both directions in the order
    of the text, ``mask`` (time, windows) is 0 after a window's last word. ``keep`` also returns what the
    gradient needs."""
    times, _, n, _ = projected.shape
    state, states, steps = np.zeros((2, n, STATE), np.float32), np.empty((times, n, 2 * STATE), np.float32), []
    for t in range(times):
        back = times - 1 - t
        x = np.stack([projected[t, 0], projected[back, 1]])
        m = np.stack([mask[t], mask[back]])[..., None]
        a = state @ p["state"]
        gates = sigmoid(x[..., : 2 * STATE] + a[..., : 2 * STATE])
        z, r = gates[..., :STATE], gates[..., STATE:]
        inner = a[..., 2 * STATE :] + p["state_bias"]
        new = np.tanh(x[..., 2 * STATE :] + r * inner)
        following = state + m * ((1 - z) * (new - state))
        if keep:
            steps.append((state, z, r, new, inner, m))
        state = following
        states[t, :, :STATE], states[back, :, STATE:] = state[0], state[1]
    hidden = np.tanh(states @ p["attend"])
    score = np.where(mask > 0, hidden @ p["attend_out"], np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    logit = pooled @ p["out"] + p["out_bias"]
    return (logit, (states, hidden, weight, pooled, steps)) if keep else logit


def logits(p: Params, tables: list[np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``forward`` for many windows: ``tables`` hold both directions' input by word, ``at`` (time, windows) the words.

    States are kept with the windows in the last axis, so that every operation runs over long rows.
    """
    times, n = at.shape
    gates, whole = slice(0, 2 * STATE), bool(mask.all())
    states = np.empty((times, 2 * STATE, n), np.float32)
    half = np.float32(0.5)
    for d, order in enumerate((range(times), range(times - 1, -1, -1))):
        turned, bias = np.ascontiguousarray(p["state"][d].T), p["state_bias"][d].T
        state = np.zeros((STATE, n), np.float32)
        for t in order:
            x = np.ascontiguousarray(tables[d][at[t]].T)
            a = turned @ state
            both = x[gates]
            both += a[gates]
            both *= half
            np.tanh(both, out=both)
            both *= half
            both += half
            inner = a[2 * STATE :]
            inner += bias
            inner *= both[STATE:]
            inner += x[2 * STATE :]
            np.tanh(inner, out=inner)
            inner -= state
            inner *= 1 - both[:STATE]
            if not whole:
                inner *= mask[t]
            state = np.add(state, inner, out=states[t, d * STATE : (d + 1) * STATE])
    hidden = np.tanh(p["attend"].T @ states)
    score = np.where(mask > 0, np.einsum("h,thn->tn", p["attend_out"], hidden), np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    out = np.einsum("h,thn->tn", p["out"], states)
    return (weight * out).sum(axis=0) + p["out_bias"]


def gradient(p: Params, kept, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters above the input, and of the projected input."""
    states, hidden, weight, pooled, steps = kept
    g = {k: np.zeros_like(p[k]) for k in ("state", "state_bias")}
    g["out"], g["out_bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_score[..., None] * p["attend_out"] * (1 - hidden**2)
    g["attend_out"] = np.einsum("tn,tnh->h", d_score, hidden)
    g["attend"] = np.einsum("tnh,tnk->hk", states, d_hidden)
    d_states = weight[..., None] * d_pooled + d_hidden @ p["attend"].T
    times, n = weight.shape
    d_projected = np.zeros((times, 2, n, 3 * STATE), np.float32)
    d_state = np.zeros((2, n, STATE), np.float32)
    turned = p["state"].transpose(0, 2, 1)
    for t in range(times - 1, -1, -1):
        back = times - 1 - t
        state, z, r, new, inner, m = steps[t]
        d_state = d_state + np.stack([d_states[t, :, :STATE], d_states[back, :, STATE:]])
        d_new_state = d_state * m
        d_new = d_new_state * (1 - z) * (1 - new**2)
        d_z = d_new_state * (state - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_inner = d_new * r
        d_a = np.concatenate([d_z, d_r, d_inner], axis=2)
        g["state"] += state.transpose(0, 2, 1) @ d_a
        g["state_bias"] += d_inner.sum(axis=1, keepdims=True)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_projected[t, 0], d_projected[back, 1] = d_x[0], d_x[1]
        d_state = d_state * (1 - m) + d_new_state * z + d_a @ turned
    return g, d_projected


def trigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the trigram table for every character of the words, and where each word's begin (n + 1 places)."""
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(places[-1]) - np.repeat(places[:-1] - starts, lengths)
    here = low[at].astype(np.int64)
    before, after = np.ones(len(here), np.int64), np.full(len(here), 2, np.int64)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[places[:-1]], after[places[1:] - 1] = 1, 2
    mixed = (before * 0x9E3779B1 + here * 0x85EBCA77 + after * 0xC2B2AE3D) & 0xFFFFFFFF
    return (mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 12 & (TRIGRAMS - 1), places


def spelling(p: Params, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Mean embedding of the trigrams of each word."""
    if len(places) == 1:
        return np.zeros((0, CHAR_DIM), np.float32)
    return np.add.reduceat(p["chars"][rows], places[:-1], axis=0) / np.diff(places)[:, None].astype(np.float32)


def project(p: Params, inputs: np.ndarray) -> np.ndarray:
    """(2, words, 3 * STATE): the inputs as both directions take them."""
    return inputs @ p["input"] + p["input_bias"]


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, gradients: Params) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.params[k] -= (rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(np.float32)
