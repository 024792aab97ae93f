"""Gradients of small networks over one batch: array operations that remember how they are undone.

A task holds a few hundred windows; what it gives back to Spark is one gradient. Only what the networks need is here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array, and for each array that it was made from the function that takes its gradient back there."""

    __slots__ = ("value", "grad", "parents")

    def __init__(self, value: np.ndarray, parents: tuple[tuple[Var, Callable], ...] = ()):
        self.value, self.parents = value, parents
        self.grad: np.ndarray | float = 0.0

    def __add__(self, other: Var) -> Var:
        return Var(self.value + other.value, ((self, lambda g: _shrink(g, self)), (other, lambda g: _shrink(g, other))))

    def __sub__(self, other: Var) -> Var:
        return Var(self.value - other.value, ((self, lambda g: _shrink(g, self)), (other, lambda g: _shrink(-g, other))))

    def __mul__(self, other: Var) -> Var:
        return Var(self.value * other.value, ((self, lambda g: _shrink(g * other.value, self)), (other, lambda g: _shrink(g * self.value, other))))

    def __matmul__(self, other: Var) -> Var:
        a, b = self.value, other.value

        def right(g: np.ndarray) -> np.ndarray:
            if b.ndim == 2:  # one matrix for all rows
                return a.reshape(-1, a.shape[-1]).T @ g.reshape(-1, g.shape[-1])
            return np.swapaxes(a, -1, -2) @ g

        return Var(a @ b, ((self, lambda g: g @ np.swapaxes(b, -1, -2)), (other, right)))

    def __getitem__(self, at) -> Var:
        def spread(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            out[at] = g
            return out

        return Var(self.value[at], ((self, spread),))


def _shrink(g: np.ndarray, to: Var) -> np.ndarray:
    """Sums a gradient over the axes along which a value was repeated."""
    shape = to.value.shape
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    longer = tuple(k for k, n in enumerate(shape) if n == 1 and g.shape[k] != 1)
    return g.sum(axis=longer, keepdims=True) if longer else g


def const(value) -> Var:
    return Var(np.asarray(value, float))


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), ((x, lambda g: g * (x.value > 0)),))


def tanh(x: Var) -> Var:
    y = np.tanh(x.value)
    return Var(y, ((x, lambda g: g * (1 - y * y)),))


def logistic(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def softmax(x: Var, axis: int) -> Var:
    e = np.exp(x.value - x.value.max(axis=axis, keepdims=True))
    y = e / e.sum(axis=axis, keepdims=True)
    return Var(y, ((x, lambda g: y * (g - (g * y).sum(axis=axis, keepdims=True))),))


def total(x: Var, axis: int) -> Var:
    return Var(x.value.sum(axis=axis), ((x, lambda g: np.broadcast_to(np.expand_dims(g, axis), x.value.shape)),))


def standardised(x: Var, axes: tuple[int, ...], epsilon: float) -> Var:
    """x less its mean over the axes, by its deviation there."""
    mean = x.value.mean(axis=axes, keepdims=True)
    root = np.sqrt(x.value.var(axis=axes, keepdims=True) + epsilon)
    y = (x.value - mean) / root

    def back(g: np.ndarray) -> np.ndarray:
        return (g - g.mean(axis=axes, keepdims=True) - y * (g * y).mean(axis=axes, keepdims=True)) / root

    return Var(y, ((x, back),))


def reshaped(x: Var, shape: tuple[int, ...]) -> Var:
    return Var(x.value.reshape(shape), ((x, lambda g: g.reshape(x.value.shape)),))


def moved(x: Var, order: tuple[int, ...]) -> Var:
    return Var(x.value.transpose(order), ((x, lambda g: g.transpose(np.argsort(order))),))


def joined(parts: list[Var]) -> Var:
    """Side by side along the last axis."""
    edges = np.cumsum([0, *[p.value.shape[-1] for p in parts]])
    return Var(np.concatenate([p.value for p in parts], -1), tuple((p, lambda g, a=a, b=b: g[..., a:b]) for p, a, b in zip(parts, edges, edges[1:])))


def dropped(x: Var, share: float, rng: np.random.Generator | None) -> Var:
    """x with a share of its values at zero and the rest scaled up; as it is without rng."""
    return x if rng is None or not share else x * const((rng.random(x.value.shape) >= share) / (1 - share))


def recurrent(x: Var, w: Var, u: Var, b: Var) -> Var:
    """The outputs (rows, steps, units) of a long short-term memory over x (rows, steps, inputs); gates in the order in,
    forget, candidate, out. Its gradient runs back through all steps."""
    rows, steps, _ = x.value.shape
    units = u.value.shape[0]
    given = x.value @ w.value + b.value
    h, c = np.zeros((rows, units)), np.zeros((rows, units))
    kept = []
    out = np.empty((rows, steps, units))
    for t in range(steps):
        z = given[:, t] + h @ u.value
        i, f, o = (logistic(z[:, k * units : (k + 1) * units]) for k in (0, 1, 3))
        n = np.tanh(z[:, 2 * units : 3 * units])
        before, c = c, f * c + i * n
        shown = np.tanh(c)
        kept.append((h, before, i, f, n, o, shown))
        h = out[:, t] = o * shown

    memo: dict[int, np.ndarray] = {}

    def gates(g: np.ndarray) -> np.ndarray:
        """Gradients of the gates' inputs at every step; all parents ask for them with the same g."""
        if id(g) not in memo:
            dz = np.empty((rows, steps, 4 * units))
            dh, dc = np.zeros((rows, units)), np.zeros((rows, units))
            for t in range(steps - 1, -1, -1):
                _, before, i, f, n, o, shown = kept[t]
                dh = dh + g[:, t]
                dc = dc + dh * o * (1 - shown * shown)
                dz[:, t] = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - n * n), dh * shown * o * (1 - o)], 1)
                dh, dc = dz[:, t] @ u.value.T, dc * f
            memo.clear()
            memo[id(g)] = dz
        return memo[id(g)]

    def of_w(g: np.ndarray) -> np.ndarray:
        return x.value.reshape(-1, x.value.shape[-1]).T @ gates(g).reshape(-1, 4 * units)

    def of_u(g: np.ndarray) -> np.ndarray:
        earlier = np.stack([k[0] for k in kept], 1)
        return earlier.reshape(-1, units).T @ gates(g).reshape(-1, 4 * units)

    return Var(out, ((x, lambda g: gates(g) @ w.value.T), (w, of_w), (u, of_u), (b, lambda g: gates(g).sum((0, 1)))))


def take_back(end: Var, gradient: np.ndarray) -> None:
    """Fills in the gradients of all that `end` was made from."""
    order: list[Var] = []
    seen: set[int] = set()
    stack = [(end, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(p, False) for p, _ in node.parents]
    end.grad = gradient
    for node in reversed(order):
        for parent, back in node.parents:
            parent.grad = parent.grad + back(node.grad)
