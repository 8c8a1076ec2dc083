"""A small gated recurrent unit over class-factored words, in numpy: windows, truncated backpropagation, log-likelihoods.

Lanes run side by side; each lane is a stream of tokens, and a state goes on from window to window until its document ends. A target is a
class and, in the first classes, a word within the class, both by softmax of the state; the words of the other classes have fixed shares.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Parameters = dict[str, np.ndarray]
#: Largest exponent of a softmax.
HIGHEST = 60.0


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: inputs (words, and kinds of words that have none of their own), states, classes, and words a class."""

    inputs: int
    embedding: int
    states: int
    #: Classes whose words are told apart by softmax, and all classes.
    open_classes: int
    classes: int
    members: int


def initial(shape: Shape, class_logs: np.ndarray, member_logs: np.ndarray, seed: int = 7) -> Parameters:
    """Parameters that start as the word frequencies: ``class_logs[classes]``, ``member_logs[open_classes, members]`` (-30 where there is no word)."""
    rng = np.random.default_rng(seed)
    draw = lambda *size: rng.normal(0, 1 / np.sqrt(size[0]), size).astype(np.float32)
    return {
        "embed": rng.normal(0, 0.5, (shape.inputs, shape.embedding)).astype(np.float32),
        "enter": draw(shape.embedding, 3 * shape.states), "bias": np.zeros(3 * shape.states, np.float32),
        "gates": draw(shape.states, 2 * shape.states), "inner": draw(shape.states, shape.states),
        "classes": np.zeros((shape.states, shape.classes), np.float32), "class_bias": class_logs.astype(np.float32),
        "words": np.zeros((shape.open_classes, shape.states, shape.members), np.float32), "word_bias": member_logs.astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; where exp overflows the value is 0, as it should."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order of small numbers: of 16 bits, where they fit, since those are sorted by counting."""
    return np.argsort(numbers.astype(np.int16) if len(numbers) and numbers.max() < 1 << 15 else numbers, kind="stable")


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no sum over states within 1 can come to the highest exponent."""
    return bool((np.abs(weights).sum(-2) + bias).max(initial=-np.inf) < HIGHEST - 1)


class Window:
    """The run of a window: ``inputs``, ``goes_on`` (0 where a document begins) as ``[steps, lanes]``, from ``state [lanes, states]``."""

    def __init__(self, p: Parameters, inputs: np.ndarray, goes_on: np.ndarray, state: np.ndarray):
        steps, lanes = inputs.shape
        size = state.shape[1]
        self.p, self.inputs, self.goes_on = p, inputs, goes_on
        self.taken = p["embed"][inputs.ravel()]
        entered = (self.taken @ p["enter"] + p["bias"]).reshape(steps, lanes, 3 * size)
        self.before, self.gate, self.reset, self.new, self.after = (np.empty((steps, lanes, n), np.float32) for n in (size, 2 * size, size, size, size))
        for t in range(steps):
            before = np.multiply(state, goes_on[t][:, None], out=self.before[t])
            gate = np.matmul(before, p["gates"], out=self.gate[t])
            gate += entered[t, :, :2 * size]
            _sigmoid(gate)
            reset = np.multiply(gate[:, size:], before, out=self.reset[t])
            new = np.matmul(reset, p["inner"], out=self.new[t])
            new += entered[t, :, 2 * size:]
            _tanh(new)
            state = np.subtract(before, new, out=self.after[t])
            state *= gate[:, :size]
            state += new
        self.state = state

    def losses(self, classes: np.ndarray, members: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, Parameters | None, np.ndarray | None]:
        """Natural log probability of every target; with ``weights`` also the gradients and what flows into the states.

        ``members`` is the word's place in its class, or -1 where the class has fixed shares.
        """
        p, found = self.p, {}
        size = self.state.shape[1]
        states, classes, members = self.after.reshape(-1, size), classes.ravel(), members.ravel()
        logits = states @ p["classes"]
        logits += p["class_bias"]
        # States lie within 1, so weights would have to be huge to come here; below the limit no sum of exp overflows.
        if not _bounded(p["classes"], p["class_bias"]):
            np.minimum(logits, HIGHEST, out=logits)
        at = np.arange(len(classes))
        logs = logits[at, classes]
        np.exp(logits, out=logits)
        sums = logits @ np.ones(logits.shape[1], np.float32)
        logs -= np.log(sums)
        flow = None
        if weights is not None:
            weights = weights.ravel().astype(np.float32)
            logits *= (weights / sums)[:, None]
            logits[at, classes] -= weights
            found["classes"], found["class_bias"] = states.T @ logits, np.ones(len(logits), np.float32) @ logits
            flow = logits @ p["classes"].T
            found["words"], found["word_bias"] = np.zeros_like(p["words"]), np.zeros_like(p["word_bias"])
        inside = np.flatnonzero(members >= 0)
        order = inside[_order(classes[inside])]
        bounds = np.searchsorted(classes[order], np.arange(len(p["words"]) + 1))
        held, places, within = states[order], members[order], np.empty(len(order), np.float32)
        if flow is not None:
            shares, inflow = weights[order], np.empty_like(held)
        bounded = _bounded(p["words"], p["word_bias"])
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            span = slice(bounds[c], bounds[c + 1])
            own, picked = held[span], places[span]
            inner = own @ p["words"][c]
            inner += p["word_bias"][c]
            if not bounded:
                np.minimum(inner, HIGHEST, out=inner)
            spot = np.arange(len(own))
            chosen = inner[spot, picked]
            np.exp(inner, out=inner)
            sums = inner @ np.ones(inner.shape[1], np.float32)
            within[span] = chosen - np.log(sums)
            if flow is not None:
                inner *= (shares[span] / sums)[:, None]
                inner[spot, picked] -= shares[span]
                found["words"][c], found["word_bias"][c] = own.T @ inner, np.ones(len(inner), np.float32) @ inner
                inflow[span] = inner @ p["words"][c].T
        logs[order] += within
        if flow is not None:
            flow[order] += inflow
        return logs, (found if flow is not None else None), flow

    def backward(self, flow: np.ndarray, found: Parameters) -> Parameters:
        """Adds the gradients of the recurrent part: backpropagation to the window's first step and no farther."""
        p = self.p
        steps, lanes, size = self.after.shape
        flow = flow.reshape(steps, lanes, size)
        inward = np.empty((steps, lanes, 3 * size), np.float32)
        back = np.zeros((lanes, size), np.float32)
        gates, inner = p["gates"].T.copy(), p["inner"].T.copy()
        update, reset, open_gate = self.gate[:, :, :size], self.gate[:, :, size:], 1 - self.gate
        to_new = open_gate[:, :, :size] * (1 - self.new * self.new)
        to_update = (self.before - self.new) * update * open_gate[:, :, :size]
        to_reset = self.reset * open_gate[:, :, size:]
        for t in range(steps - 1, -1, -1):
            back += flow[t]
            own = inward[t]
            through = np.multiply(back, to_new[t], out=own[:, 2 * size:]) @ inner
            np.multiply(back, to_update[t], out=own[:, :size])
            np.multiply(through, to_reset[t], out=own[:, size:2 * size])
            back *= update[t]
            through *= reset[t]
            back += through
            back += own[:, :2 * size] @ gates
            back *= self.goes_on[t][:, None]
        turned = inward.reshape(-1, 3 * size)
        found["gates"] = self.before.reshape(-1, size).T @ turned[:, :2 * size]
        found["inner"] = self.reset.reshape(-1, size).T @ turned[:, 2 * size:]
        found["enter"], found["bias"] = self.taken.T @ turned, np.ones(len(turned), np.float32) @ turned
        rows = self.inputs.ravel()
        order = _order(rows)
        starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        found["embed"] = np.zeros_like(p["embed"])
        found["embed"][rows[order][starts]] = np.add.reduceat((turned @ p["enter"].T)[order], starts)
        return found


@dataclass(frozen=True)
class Stream:
    """Tokens of whole documents in order: input, class, member, and 0 where a document begins."""

    inputs: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    goes_on: np.ndarray


def train(p: Parameters, squares: Parameters, stream: Stream, lanes: int, steps: int, rate: float) -> None:
    """One pass over a stream cut into ``lanes`` of equal length, in windows of ``steps``; ``p`` and ``squares`` (of gradients) change in place."""
    total = len(stream.inputs)
    lanes = max(1, min(lanes, total // steps))
    length = -(-total // lanes)
    padded = length * lanes - total
    fold = lambda x, fill: np.concatenate([x, np.full(padded, fill, x.dtype)]).reshape(lanes, length).T
    inputs, classes, members, goes_on = fold(stream.inputs, 0), fold(stream.classes, 0), fold(stream.members, -1), fold(stream.goes_on, 0)
    counted = fold(np.ones(total, np.float32), 0)
    state = np.zeros((lanes, p["inner"].shape[0]), np.float32)
    np.seterr(over="ignore")
    for at in range(0, length, steps):
        span = slice(at, at + steps)
        window = Window(p, inputs[span], goes_on[span], state)
        weights = counted[span]
        _, found, flow = window.losses(classes[span], members[span], weights / max(weights.sum(), 1))
        window.backward(flow, found)
        state = window.state
        for name, gradient in found.items():
            np.clip(gradient, -0.5, 0.5, out=gradient)
            seen = squares[name]
            seen += gradient * gradient
            p[name] -= rate * gradient / np.sqrt(seen + 1e-10)


def document_logs(p: Parameters, stream: Stream, lengths: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """Natural log probability of every document of a stream, fixed shares left out. A document stays in one lane from its first to its last token."""
    if not len(lengths):
        return np.zeros(0)
    starts = np.cumsum(lengths) - lengths
    lanes = max(1, min(lanes, len(lengths)))
    # Longest first, each to the shortest lane: lanes end together unless one document is longer than its share.
    loads, held = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    heap = [(0, lane) for lane in range(lanes)]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        held[lane].append(doc)
        loads[lane] = load + int(lengths[doc])
        heapq.heappush(heap, (loads[lane], lane))
    by_load = np.argsort(-loads, kind="stable")
    loads, held = loads[by_load], [held[lane] for lane in by_load.tolist()]
    tokens = [np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in docs]) for docs in held]
    owner = [np.repeat(docs, lengths[docs]) for docs in held]
    totals = np.zeros(len(lengths))
    state = np.zeros((lanes, p["inner"].shape[0]), np.float32)
    np.seterr(over="ignore")
    for at in range(0, int(loads[0]), steps):
        live = int(np.searchsorted(-loads, -at, side="left"))
        state = state[:live]
        spots = np.zeros((live, steps), np.int64)
        docs = np.full((live, steps), -1, np.int64)
        for lane in range(live):
            part = tokens[lane][at:at + steps]
            spots[lane, :len(part)] = part
            docs[lane, :len(part)] = owner[lane][at:at + steps]
        spots, docs = spots.T, docs.T.ravel()
        window = Window(p, stream.inputs[spots], stream.goes_on[spots], state)
        logs, _, _ = window.losses(stream.classes[spots], stream.members[spots])
        state = window.state
        real = docs >= 0
        totals += np.bincount(docs[real], logs[real].astype(np.float64), len(lengths))
    return totals


def packed(p: Parameters) -> np.ndarray:
    """All parameters as one vector."""
    return np.concatenate([p[name].ravel() for name in sorted(p)])


def unpacked(vector: np.ndarray, like: Parameters) -> Parameters:
    result, at = {}, 0
    for name in sorted(like):
        result[name] = vector[at:at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return result


def chunks(parts: Iterator[tuple], tokens: int) -> Iterator[list]:
    """Groups of parts, by the size each states first, of about ``tokens`` together."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part[0]
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held
