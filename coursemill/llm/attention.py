"""A small causal self-attention model over subword ids, in numpy.

A text's ids are cut into blocks of ``BLOCK``. A block and the one before it are a context window: windows overlap by
half, every id is scored in exactly one of them, and it sees at least ``BLOCK`` ids before it where the text has so
many. All windows of many texts are computed together; masks keep an id from seeing what comes after it, and a
text from seeing another one.

The output is a binary tree over the ids, a Huffman tree of their counts in the corpus: the probability of an id is
the product of the decisions on its path. Before anything is learned the decisions have the odds of the counts, so
the model starts as the distribution of the ids in the corpus; whatever is learned, probabilities add up to one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .common import ranges

BLOCK, DIM = 16, 16
#: Ids whose paths are worked on at once.
TOGETHER = 1 << 18
#: Runs of blocks in a step.
RUNS = 16
#: Targets of one id in a step that make it worth while to work on them by themselves.
SHARED = 8
Params = dict[str, np.ndarray]


@dataclass
class Paths:
    """Paths from the root of the tree to every id, one after the other."""

    starts: np.ndarray  # ids + 1
    nodes: np.ndarray
    signs: np.ndarray  # 1 for the first child, -1 for the second
    odds: np.ndarray  # of each node: logarithm of the first child's share over the second's


def huffman(counts: np.ndarray) -> Paths:
    """The tree of these counts; every id counts once more, so that each has a probability."""
    weights = [int(c) + 1 for c in counts]
    size = len(weights)
    waiting = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(waiting)
    children, odds = [], []
    while len(waiting) > 1:
        (a, first), (b, second) = heapq.heappop(waiting), heapq.heappop(waiting)
        heapq.heappush(waiting, (a + b, size + len(children)))
        children.append((first, second))
        odds.append(np.log(a / b))
    paths: list[tuple[int, ...]] = [()] * (size + len(children))
    for node in range(len(children) - 1, -1, -1):  # parents were made after their children
        for sign, child in zip((1, -1), children[node]):
            paths[child] = (*paths[size + node], (node + 1) * sign)
    steps = np.array([s for p in paths[:size] for s in p], np.int64)
    starts = np.cumsum([0, *(len(p) for p in paths[:size])])
    return Paths(starts, np.abs(steps) - 1, np.sign(steps).astype(np.float32), np.array(odds, np.float32))


def new_params(size: int, seed: int) -> Params:
    random = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    return {
        "query": some(size, DIM, scale=0.3),
        "key": some(size, DIM, scale=0.3),
        "value": some(size, DIM, scale=0.3),
        "last": some(size, DIM, scale=0.3),
        "mix": some(DIM, DIM, scale=0.3),
        "distance": np.zeros(2 * BLOCK, np.float32),
        "node": np.zeros((max(1, size - 1), DIM), np.float32),
    }


@dataclass
class Model:
    params: Params
    paths: Paths


_HERE = np.arange(BLOCK)
_DISTANCE = np.clip(_HERE[:, None] + BLOCK - np.arange(2 * BLOCK), 0, None)
_LATER = _HERE[:, None] + BLOCK < np.arange(2 * BLOCK)


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each block, place of each input in the padded blocks) for texts of so many inputs, none of them 0."""
    n = -(-lengths // BLOCK)
    base = (np.cumsum(n) - n) * BLOCK
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - base, lengths)
    return np.repeat(np.arange(len(lengths)), n), place


def states(p: Params, inputs: np.ndarray, first: np.ndarray, keep: bool = False):
    """State after each input of blocks (n, BLOCK); ``first`` is true for blocks that no block of their text precedes."""
    query, key, value = (p[name][inputs] for name in ("query", "key", "value"))
    n = len(inputs)
    score = np.empty((n, BLOCK, 2 * BLOCK), np.float32)
    turned = key.transpose(0, 2, 1)
    np.matmul(query, turned, out=score[:, :, BLOCK:])
    score[0, :, :BLOCK] = 0
    np.matmul(query[1:], turned[:-1], out=score[1:, :, :BLOCK])
    score *= np.float32(DIM**-0.5)
    score += np.where(_LATER, np.float32(-1e9), p["distance"][_DISTANCE])
    score[first, :, :BLOCK] = -1e9
    score -= score.max(axis=2, keepdims=True)
    weight = np.exp(score, out=score)
    weight /= weight.sum(axis=2, keepdims=True)
    seen = weight[:, :, BLOCK:] @ value
    seen[1:] += weight[1:, :, :BLOCK] @ value[:-1]
    state = np.tanh(seen @ p["mix"] + p["last"][inputs])
    return (state, (query, key, value, weight, seen)) if keep else state


def _by_target(paths: Paths, targets: np.ndarray):
    """(order of equal targets, where those of each id begin and end, its path in ``paths``: first and length)."""
    order = np.argsort(targets.astype(np.uint16) if len(paths.starts) <= 1 << 16 else targets, kind="stable")
    ordered = targets[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    ids = ordered[first]
    return order, first, np.r_[first[1:], len(ordered)], paths.starts[ids], paths.starts[ids + 1] - paths.starts[ids]


def _against(model: Model, state: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, depths: np.ndarray):
    """Of states in the order of targets: odds against the decisions by id, state and depth, their places by id, paths' weights."""
    p, paths, turned = model.params, model.paths, []
    state = np.concatenate([state, np.ones((len(state), 1), state.dtype)], axis=1)
    places = np.r_[0, np.cumsum(depths * (ends - begins))]
    logit = np.empty(places[-1], state.dtype)
    lists = (x.tolist() for x in (starts, depths, begins, ends, places, places[1:]))
    for start, depth, a, b, u, v in zip(*lists):
        nodes = paths.nodes[start : start + depth]
        turns = np.concatenate([p["node"][nodes], paths.odds[nodes, None]], axis=1) * -paths.signs[start : start + depth, None]
        np.matmul(state[a:b], turns.T, out=logit[u:v].reshape(b - a, depth))
        turned.append(turns)
    return np.exp(np.clip(logit, None, 80, out=logit), out=logit), places, turned


def log_probabilities(model: Model, state: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each target after its state. Equal targets share the nodes of one path."""
    order, begins, ends, starts, depths = _by_target(model.paths, targets)
    logit, _, _ = _against(model, state[order], begins, ends, starts, depths)
    logit += 1
    each = depths.repeat(ends - begins)
    lost = np.add.reduceat(np.log(logit, out=logit), np.cumsum(each) - each)
    found = np.empty(len(targets))
    found[order] = -lost
    return found


def score(model: Model, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of every target of texts with so many inputs each, given the text before it."""
    text, place = blocks_of(lengths)
    padded = np.zeros(len(text) * BLOCK, inputs.dtype)
    padded[place] = inputs
    padded = padded.reshape(-1, BLOCK)
    first = np.r_[True, text[1:] != text[:-1]]
    found, step = np.empty(len(inputs)), TOGETHER // BLOCK
    ends = np.searchsorted(place, np.arange(0, len(text) + step, step) * BLOCK)
    for a, begin, end in zip(range(0, len(text), step), ends, ends[1:]):
        # The block before the first one comes along as context.
        before = a if first[a] else a - 1
        state = states(model.params, padded[before : a + step], np.r_[True, first[before + 1 : a + step]])
        state = state.reshape(-1, DIM)[place[begin:end] - before * BLOCK]
        found[begin:end] = log_probabilities(model, state, targets[begin:end])
    return found


def _tree_gradients(model: Model, state: np.ndarray, targets: np.ndarray):
    """(summed loss, gradients of the states, nodes, gradients of these nodes); a node can be there repeatedly."""
    p, paths = model.params, model.paths
    order, begins, ends, starts, depths = _by_target(paths, targets)
    ordered = state[order]
    d_ordered = np.empty_like(ordered)
    # The targets of an id share its path, if they are many; the others bring a path each.
    many = ends - begins >= SHARED
    a, b, start, depth = (x[many] for x in (begins, ends, starts, depths))
    against, places, turned = _against(model, ordered, a, b, start, depth)
    loss = float(np.log1p(against).sum())
    against /= 1 + against
    node_ends = np.cumsum(depth)
    d_node = np.empty((depth.sum(), DIM), state.dtype)
    lists = (x.tolist() for x in (a, b, places, places[1:], node_ends - depth, node_ends))
    for turns, i, j, u, v, x, y in zip(turned, *lists):
        own = against[u:v].reshape(j - i, y - x)
        np.matmul(own, turns[:, :DIM], out=d_ordered[i:j])
        np.matmul(own.T, ordered[i:j], out=d_node[x:y])
    at = ranges(start, depth)
    d_node *= -paths.signs[at, None]
    nodes = paths.nodes[at]
    if not many.all():
        n = (ends - begins)[~many]
        each = ranges(begins[~many], n)
        depth = depths[~many].repeat(n)
        at, owner = ranges(starts[~many].repeat(n), depth), each.repeat(depth)
        node, sign = paths.nodes[at], paths.signs[at]
        weights, states_ = p["node"][node], ordered[owner]
        against = np.exp(np.clip(-sign * (paths.odds[node] + np.einsum("md,md->m", weights, states_)), None, 80))
        loss += float(np.log1p(against).sum())
        turn = (-sign * against / (1 + against))[:, None]
        d_ordered[each] = np.add.reduceat(turn * weights, np.cumsum(depth) - depth)
        nodes, d_node = np.concatenate([nodes, node]), np.concatenate([d_node, turn * states_])
    d_state = np.empty_like(ordered)
    d_state[order] = d_ordered
    return loss, d_state, nodes, d_node


def gradients(model: Model, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, scored: np.ndarray):
    """Mean loss of the scored targets and, by parameters, (rows or None, gradients side by side)."""
    p = model.params
    state, (query, key, value, weight, seen) = states(p, inputs, first, keep=True)
    count = np.float32(max(1, scored.sum()))
    d_state, loss = np.zeros_like(state), 0.0
    nodes, d_node = np.zeros(0, np.int64), np.zeros((0, DIM), state.dtype)
    if scored.any():
        loss, d_state[scored], nodes, d_node = _tree_gradients(model, state[scored], targets[scored])
    d_state /= count
    d_sum = d_state * (1 - state**2)
    d_seen = d_sum @ p["mix"].T
    before = np.concatenate([np.zeros_like(value[:1]), value[:-1]])
    d_score = np.empty_like(weight)
    np.matmul(d_seen, before.transpose(0, 2, 1), out=d_score[:, :, :BLOCK])
    np.matmul(d_seen, value.transpose(0, 2, 1), out=d_score[:, :, BLOCK:])
    d_score -= np.einsum("nij,nij->ni", weight, d_score)[:, :, None]
    d_score *= weight
    turned = np.ascontiguousarray(weight.transpose(0, 2, 1))
    d_value = turned[:, BLOCK:] @ d_seen
    d_value[:-1] += turned[1:, :BLOCK] @ d_seen[1:]
    d_distance = np.bincount(_DISTANCE.ravel(), d_score.sum(axis=0).ravel(), 2 * BLOCK).astype(np.float32)
    d_score *= np.float32(DIM**-0.5)
    d_query = d_score[:, :, BLOCK:] @ key
    d_query[1:] += d_score[1:, :, :BLOCK] @ key[:-1]
    turned = np.ascontiguousarray(d_score.transpose(0, 2, 1))
    d_key = turned[:, BLOCK:] @ query
    d_key[:-1] += turned[1:, :BLOCK] @ query[1:]
    d_inputs = np.concatenate([d_query, d_key, d_value, d_sum], axis=2).reshape(-1, 4 * DIM)
    return loss / count, {
        ("query", "key", "value", "last"): (inputs.reshape(-1), d_inputs),
        ("mix",): (None, seen.reshape(-1, DIM).T @ d_sum.reshape(-1, DIM)),
        ("distance",): (None, d_distance),
        ("node",): (nodes, d_node / count),
    }


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sums of their values."""
    if not len(rows):
        return rows, values
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[begins], np.add.reduceat(values[order], begins)


class Adagrad:
    """Steps that shrink with the gradients a parameter has had; only rows that occur are touched."""

    def __init__(self, params: Params, had: Params):
        self.params, self.had = params, had

    def update(self, found: dict, rate: float) -> None:
        for names, (rows, gradient) in found.items():
            at = slice(None)
            if rows is not None:
                at, gradient = _by_row(rows, gradient)
            width = gradient.shape[-1] // len(names)
            for i, name in enumerate(names):
                own = gradient[..., i * width : (i + 1) * width]
                had = self.had[name][at] + own**2
                self.had[name][at] = had
                self.params[name][at] -= rate * own / np.sqrt(had)


def blocks(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, first, targets, scored) of the blocks of texts, whose ids, one more than ``lengths``, come one after the other."""
    text, place = blocks_of(lengths)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths + 1) - 1] = True
    inputs, targets = np.zeros((2, len(text) * BLOCK), ids.dtype)
    inputs[place], targets[place] = ids[~last], ids[np.flatnonzero(~last) + 1]
    scored = np.zeros(len(text) * BLOCK, bool)
    scored[place] = True
    first = np.r_[True, text[1:] != text[:-1]]
    return inputs.reshape(-1, BLOCK), first, targets.reshape(-1, BLOCK), scored.reshape(-1, BLOCK)


def steps_over(model: Model, optimizer: Adagrad, texts: tuple[np.ndarray, ...], step: int, random: np.random.Generator, rate) -> None:
    """Learn from every scored target of ``texts`` (``blocks``) once, ``step`` blocks at a time.

    A step takes ``RUNS`` runs of neighbouring blocks from different places, so that it meets several texts. ``rate``
    gives the rate of a step, and is told how many targets it has.
    """
    inputs, first, targets, scored = texts
    length = max(1, step // RUNS)
    starts = random.permutation(np.arange(0, len(inputs), length))
    for at in range(0, len(starts), RUNS):
        # The block before the first one of a run comes along as context.
        place = starts[at : at + RUNS, None] + np.arange(-1, length)
        inside = (place >= 0) & (place < len(inputs))
        place = np.where(inside, place, 0)
        begins = first[place] | ~inside
        begins[:, 0] = True
        counted = scored[place] & inside[:, :, None]
        counted[:, 0] = False
        _, found = gradients(
            model, *(x.reshape(-1, *x.shape[2:]) for x in (inputs[place], begins, targets[place], counted))
        )
        optimizer.update(found, rate(int(counted.sum())))
