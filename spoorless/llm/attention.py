"""A causal self-attention model over subword ids, in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np

#: Width of the model, its heads, and hidden units of its last layer.
WIDTH, HEADS, HIDDEN = 16, 1, 32
#: Inputs of a window, and how many at its beginning are only context; the rest are scored.
WINDOW, CONTEXT = 32, 8
#: Ids with an output of their own, in classes of MEMBERS; the last output stands for all others.
OUTPUTS, MEMBERS = 1024, 32
#: Windows of a step of training, of a batch of scoring, and of a lot of it that stays in the processor's cache.
STEP, BATCH, LOT = 128, 512, 128


class Outputs:
    """Places of ids among the model's outputs: the most frequent ones their own, the others one together.

    ``counts`` are of the whole training corpus. The others share their output's probability by count, each
    counted once more, so that every id of the vocabulary has a probability.
    """

    def __init__(self, counts: np.ndarray, outputs: int = OUTPUTS, members: int = MEMBERS):
        self.count, self.members = outputs, members
        order = np.lexsort((np.arange(len(counts)), -counts))[: outputs - 1]
        self.place = np.full(len(counts), outputs - 1, np.int64)
        # neighbours in frequency go to different classes, so that classes weigh alike
        classes = outputs // members
        self.place[order] = (np.arange(len(order)) % classes) * members + np.arange(len(order)) // classes
        rest = np.flatnonzero(self.place == outputs - 1)
        self.within = np.zeros(len(counts))
        self.within[rest] = np.log((counts[rest] + 1) / max(1, (counts[rest] + 1).sum()))
        mass = np.bincount(self.place, counts, outputs) + 1.0
        self.log_mass = np.log(mass / mass.sum()).astype(np.float32)


def initial(outputs: Outputs, seed: int = 12) -> dict[str, np.ndarray]:
    """Parameters from which training starts: small random ones, and the outputs' log frequencies."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
    d, k, classes = WIDTH, outputs.count, outputs.count // outputs.members
    by_class = outputs.log_mass.reshape(classes, -1).astype(np.float64)
    top = np.log(np.exp(by_class).sum(1))
    return {
        "embed": draw(k + 1, d, scale=0.3),  # the last is what stands before a text
        "qkv": draw(HEADS, d, 3 * d // HEADS, scale=d**-0.5), "mix": draw(HEADS, d // HEADS, d, scale=0.3 * d**-0.5), "near": np.linspace(-2, 0, WINDOW, dtype=np.float32)[None].repeat(HEADS, 0),
        "up": draw(d, HIDDEN, scale=d**-0.5), "up0": np.zeros(HIDDEN, np.float32), "down": draw(HIDDEN, d, scale=0.3 * HIDDEN**-0.5),
        "class": draw(d, classes, scale=0.1 * d**-0.5), "class0": top.astype(np.float32), "member": draw(classes, d, outputs.members, scale=0.1 * d**-0.5), "member0": (by_class - top[:, None]).astype(np.float32),
    }


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_MASK = np.where(_BACK >= 0, 0.0, -1e9).astype(np.float32)
#: Logits are bounded, so that sums of their exponentials stay finite without looking for the largest.
_TOP = np.float32(60)
_ONES = np.ones(4096, np.float32)


def windows(lengths: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Text and first input of each window, over texts of so many inputs; every input is scored in just one window."""
    fresh = WINDOW - context
    each = 1 + np.maximum(0, -(-(lengths - WINDOW) // fresh))
    owner = np.repeat(np.arange(len(lengths)), each)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * fresh


def framed(ids: np.ndarray, lengths: np.ndarray, before: int, context: int = CONTEXT, which: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows over texts in a row, or of some, which targets are scored, and each window's text.

    A text's inputs are ``before`` and its ids but the last, its targets its ids. Places past its end hold ``before``.
    """
    owner, start = (x[which] for x in windows(lengths, context))
    at = start[:, None] + np.arange(WINDOW)
    there = at < lengths[owner][:, None]
    scored = there & ((start[:, None] == 0) | (np.arange(WINDOW) >= context))
    place = (np.cumsum(lengths) - lengths)[owner][:, None] + np.minimum(at, lengths[owner][:, None] - 1)
    targets = rows_of(ids, place)
    inputs = np.where(there & (at > 0), rows_of(ids, np.maximum(place - 1, 0)), before)
    return inputs, targets, scored, owner


def forward(p: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, dict]:
    """The state at each input, which sees itself and those before it; and what the way back needs."""
    flat = p["embed"][inputs.ravel()]
    size, state, kept = WIDTH // HEADS, flat.copy(), []
    for h in range(HEADS):
        q, k, v = (np.ascontiguousarray(c).reshape(*inputs.shape, size) for c in np.split(flat @ p["qkv"][h], 3, axis=1))
        weights = np.matmul(q, k.transpose(0, 2, 1))
        weights += p["near"][h][WINDOW - 1 - np.maximum(_BACK, 0)] + _MASK
        np.minimum(weights, _TOP, out=weights)
        np.exp(weights, out=weights)
        total = weights.reshape(-1, WINDOW) @ _ONES[:WINDOW]
        seen = np.matmul(weights, v).reshape(-1, size) / total[:, None]
        state += seen @ p["mix"][h]
        kept.append((q, k, v, weights, total, seen))
    hidden = state @ p["up"] + p["up0"]
    np.maximum(hidden, np.float32(0), out=hidden)
    return state + hidden @ p["down"], {"flat": flat, "heads": kept, "state": state, "hidden": hidden}


def rows_of(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows by places that are all there; without a look at their bounds it takes a third of the time."""
    return np.take(table, places, axis=0, mode="clip")


def tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What :func:`states` looks up: an input's query, key and mixed value depend on nothing but the input."""
    size, out = WIDTH // HEADS, {}
    for h in range(HEADS):
        q, k, v = np.split(p["embed"] @ p["qkv"][h], 3, axis=1)
        out[f"q{h}"], out[f"k{h}"], out[f"v{h}"] = np.ascontiguousarray(q), np.ascontiguousarray(k), v @ p["mix"][h]
        out[f"bias{h}"] = p["near"][h][WINDOW - 1 - np.maximum(_BACK, 0)] + _MASK
    return out


def states(p: dict[str, np.ndarray], t: dict[str, np.ndarray], inputs: np.ndarray, skip: int = 0) -> np.ndarray:
    """The states of :func:`forward` by its tables, of the inputs from ``skip`` on; those before are only seen."""
    seen_by, flat = inputs.ravel(), np.ascontiguousarray(inputs[:, skip:]).ravel()
    state, n = rows_of(p["embed"], flat), len(inputs)
    for h in range(HEADS):
        weights = np.matmul(rows_of(t[f"q{h}"], flat).reshape(n, WINDOW - skip, -1), rows_of(t[f"k{h}"], seen_by).reshape(n, WINDOW, -1).transpose(0, 2, 1))
        weights += t[f"bias{h}"][skip:]
        np.minimum(weights, _TOP, out=weights)
        np.exp(weights, out=weights)
        seen = np.matmul(weights, rows_of(t[f"v{h}"], seen_by).reshape(n, WINDOW, -1)).reshape(len(flat), -1)
        seen /= (weights.reshape(-1, WINDOW) @ _ONES[:WINDOW])[:, None]
        state += seen
    hidden = state @ p["up"]
    hidden += p["up0"]
    np.maximum(hidden, np.float32(0), out=hidden)
    state += hidden @ p["down"]
    return state


def _softmax(logits: np.ndarray, at: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each row's place, and the slopes of its negative by the logits, if asked for."""
    np.minimum(logits, _TOP, out=logits)
    rows = np.arange(len(at))
    out = logits[rows, at]
    np.exp(logits, out=logits)
    total = logits @ _ONES[: logits.shape[1]]
    out -= np.log(total)
    if not slope:
        return out, None
    logits /= total[:, None]
    logits[rows, at] -= 1
    return out, logits


def log_probabilities(p: dict[str, np.ndarray], state: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target: of its class, and of it among the class's members.

    With ``grads`` the mean loss's gradients are added there, and those of the states are returned too.
    """
    kind, member = np.divmod(targets, p["member"].shape[2])
    out, slope = _softmax(state @ p["class"] + p["class0"], kind, grads is not None)
    back = None
    if grads is not None:
        slope *= np.float32(1 / max(1, len(targets)))
        grads["class"] += state.T @ slope
        grads["class0"] += slope.sum(0)
        back = slope @ p["class"].T
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(p["class"].shape[1] + 1))
    state, member = rows_of(state, order), rows_of(member, order)
    among = np.empty_like(out)
    for c in range(p["class"].shape[1]):
        rows = slice(bounds[c], bounds[c + 1])
        s = state[rows]
        among[rows], slope = _softmax(s @ p["member"][c] + p["member0"][c], member[rows], grads is not None)
        if grads is not None and len(s):
            slope *= np.float32(1 / len(targets))
            grads["member"][c] += s.T @ slope
            grads["member0"][c] += slope.sum(0)
            back[order[rows]] += slope @ p["member"][c].T
    out[order] += among
    return out, back


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the scored targets, and its gradients by every parameter."""
    g = {name: np.zeros_like(value) for name, value in p.items()}
    state, kept = forward(p, inputs)
    rows = np.flatnonzero(scored.ravel())
    logs, back = log_probabilities(p, state[rows], targets.ravel()[rows], g)
    d_state = np.zeros_like(state)
    d_state[rows] = back
    d_hidden = (d_state @ p["down"].T) * (kept["hidden"] > 0)
    g["down"] = kept["hidden"].T @ d_state
    g["up"], g["up0"] = kept["state"].T @ d_hidden, d_hidden.sum(0)
    d_state += d_hidden @ p["up"].T
    d_x = d_state.copy()
    size = WIDTH // HEADS
    for h, (q, k, v, weights, total, seen) in enumerate(kept["heads"]):
        g["mix"][h] = seen.T @ d_state
        d_seen = d_state @ p["mix"][h].T
        weights /= total.reshape(*weights.shape[:2], 1)
        own = (d_seen * seen).sum(1).reshape(*weights.shape[:2], 1)
        d_seen = d_seen.reshape(q.shape)
        d_v = np.matmul(weights.transpose(0, 2, 1), d_seen)
        d_scores = weights * (np.matmul(d_seen, v.transpose(0, 2, 1)) - own)
        by_place = d_scores.sum(0)
        g["near"][h] = [np.trace(by_place, -back) for back in range(WINDOW - 1, -1, -1)]
        d_q, d_k = np.matmul(d_scores, k), np.matmul(d_scores.transpose(0, 2, 1), q)
        d_qkv = np.concatenate([d.reshape(-1, size) for d in (d_q, d_k, d_v)], 1)
        g["qkv"][h] = kept["flat"].T @ d_qkv
        d_x += d_qkv @ p["qkv"][h].T
    # rows of an input are added up in the order of inputs
    flat = inputs.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    g["embed"][flat[order][first]] = np.add.reduceat(d_x[order], first, axis=0)
    return -float(logs.mean()), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.t = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        fix = rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for name in p:
            m, v = self.m[name], self.v[name]
            m += 0.1 * (g[name] - m)
            v += 0.01 * (g[name] * g[name] - v)
            p[name] -= (fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def train(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, rate: float, last: float = 0.1, seed: int = 0) -> list[float]:
    """One pass over the windows in a random order, the rate falling to ``last`` of it; changes ``p``, returns the losses."""
    order, adam, losses = np.random.default_rng(seed).permutation(len(inputs)), Adam(p), []
    steps = max(1, -(-len(order) // STEP))
    for k in range(steps if len(order) else 0):
        rows = order[k * STEP : (k + 1) * STEP]
        loss, g = gradients(p, inputs[rows], targets[rows], scored[rows])
        adam.step(p, g, rate * (1 - (1 - last) * k / steps))
        losses.append(loss)
    return losses


def scores(p: dict[str, np.ndarray], outputs: Outputs, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each text of ``ids`` in a row, each of ``lengths`` at least one."""
    total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), outputs.within[ids], len(lengths))
    inputs, targets, scored, owner = framed(outputs.place[ids], lengths, outputs.count)
    looked, going_on = tables(p), np.diff(owner, prepend=-1) == 0
    for which, skip in ((~going_on, 0), (going_on, CONTEXT)):  # a text's first window, all of it; of others what is new
        at = np.flatnonzero(which)
        for some in np.split(at, range(BATCH, len(at), BATCH)) if len(at) else ():
            state = np.concatenate([states(p, looked, inputs[some[k : k + LOT]], skip) for k in range(0, len(some), LOT)])
            rows = np.flatnonzero(scored[some, skip:].ravel())
            logs, _ = log_probabilities(p, rows_of(state, rows), targets[some, skip:].ravel()[rows])
            total += np.bincount(np.repeat(owner[some], WINDOW - skip)[rows], logs, len(lengths))
    return total
