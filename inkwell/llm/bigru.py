"""A bidirectional gated recurrent network over bytes, in numpy.

Each direction reads the bytes of a batch of texts; at every position both states give
a distribution over languages.  Trained by backpropagation through time with Adam.
"""

from __future__ import annotations

from math import prod

import numpy as np

F32 = np.float32
#: A state is the number that stands for it times this: a tanh by the exponential is 1 - 2 / (1 + e^2x).
STATE = F32(-2)
#: Texts of a batch that are read at once, so that a step's numbers stay in the core's cache.
AT_ONCE = 256


def _reciprocal_exp1(x: np.ndarray) -> None:
    """1 / (1 + e^x) in place; where e^x is beyond these floats it is 0."""
    np.exp(x, out=x)
    x += F32(1)
    np.reciprocal(x, out=x)


class Direction:
    """Parameters of one direction: update gate, reset gate, candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.h = hidden
        self.table = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(F32)  # input weights and bias of each byte
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.u]


def _by_gate(weights: list[np.ndarray], h_n: int) -> np.ndarray:
    """(gate, direction, row, unit) of the directions' (row, 3 units) weights."""
    return np.stack([w.reshape(len(w), 3, h_n).transpose(1, 0, 2) for w in weights], axis=1).astype(F32)


class BiGRU:
    """Distribution over ``classes`` at every byte.

    Both directions take their steps together, gate by gate: in arrays of (gate,
    direction, step, text, unit) what a step reads and writes lies in whole blocks.  The
    second direction's steps run from the end of the text.
    """

    def __init__(self, classes: int, hidden: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.forward, self.backward = Direction(hidden, rng), Direction(hidden, rng)
        self.w = (rng.standard_normal((2 * hidden, classes)) / np.sqrt(2 * hidden)).astype(F32)
        self.b = np.zeros(classes, F32)
        self._held: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": {}}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, kept from call to call: fresh memory for every batch costs more than the sums made in it."""
        size = prod(shape)
        if name not in self._held or len(self._held[name]) < size:
            self._held[name] = np.empty(size, F32)
        return self._held[name][:size].reshape(shape)

    def params(self) -> list[np.ndarray]:
        return [*self.forward.params(), *self.backward.params(), self.w, self.b]

    def directions(self) -> tuple[Direction, Direction]:
        return self.forward, self.backward

    def _run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States (2, T, B, H) for bytes (T, B), times -1/2; with ``keep``, what the gradient needs, too: gates, candidates times -1/2, what the states give these, twice."""
        steps, batch = x.shape
        h_n = self.hidden
        # sigmoid and tanh by the exponential, which is quicker than tanh: all factors go into the weights
        factor = np.array([-1, -1, 2], F32)[:, None, None, None]
        table = (_by_gate([d.table for d in self.directions()], h_n) * factor).reshape(3, 512, h_n)
        u = _by_gate([d.u for d in self.directions()], h_n) * (STATE * factor)
        codes = np.concatenate((x, x[::-1].astype(np.intp) + 256), axis=1)
        out, kept = self._room("out", 2, steps, batch, h_n), steps if keep else 1
        every_gate, every_n, every_hun = self._room("gate", 2, 2, kept, batch, h_n), self._room("n", 2, kept, batch, h_n), self._room("hun", 2, kept, batch, h_n)
        h = np.zeros((2, batch, h_n), F32)
        of_h, of_byte = self._room("of_h", 3, 2, batch, h_n), self._room("of_byte", 3, 2 * batch, h_n)
        of_byte_g, of_byte_n = of_byte[:2].reshape(2, 2, batch, h_n), of_byte[2].reshape(2, batch, h_n)
        with np.errstate(over="ignore"):
            for t in range(steps):
                at = t if keep else 0
                gates, n = every_gate[:, :, at], every_n[:, at]
                np.take(table, codes[t], 1, out=of_byte, mode="clip")
                np.matmul(h, u, out=of_h)
                np.add(of_h[:2], of_byte_g, out=gates)
                _reciprocal_exp1(gates)
                if keep:
                    every_hun[:, at] = of_h[2]
                np.multiply(gates[1], of_h[2], out=n)
                n += of_byte_n
                _reciprocal_exp1(n)
                n -= F32(0.5)
                new = out[:, t]
                np.subtract(h, n, out=new)
                new *= gates[0]
                new += n
                h = new
        return out, every_gate, every_n, every_hun

    def _grads(self, x: np.ndarray, saved: tuple, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the directions' parameters, given those of the states (2, T, B, H)."""
        out, every_gate, every_n, every_hun = saved
        steps, batch = x.shape
        h_n = self.hidden
        # of the update gate, the reset gate, the candidate's part of the state, the candidate before its tanh; each lacks a factor
        d, factor = self._room("d", 4, 2, steps, batch, h_n), np.array([-2, 2, 4, 4], F32)
        d_h, none = np.zeros((2, batch, h_n), F32), np.zeros((2, batch, h_n), F32)
        a, b, back = np.empty_like(d_h), np.empty_like(d_h), np.empty((3, 2, batch, h_n), F32)
        u_t = (_by_gate([d.u for d in self.directions()], h_n) * factor[:3, None, None, None]).transpose(0, 1, 3, 2).copy()
        for t in range(steps - 1, -1, -1):
            z, r, n = every_gate[0, :, t], every_gate[1, :, t], every_n[:, t]
            d_z, d_r, d_hun, d_n = d[:, :, t]
            d_h += d_out[:, t]
            np.subtract(F32(1), z, out=a)
            a *= d_h
            np.subtract(out[:, t - 1] if t else none, n, out=b)
            b *= z
            np.multiply(a, b, out=d_z)
            np.multiply(n, n, out=b)
            np.subtract(F32(0.25), b, out=b)
            np.multiply(a, b, out=d_n)
            np.multiply(d_n, r, out=d_hun)
            np.subtract(F32(1), r, out=a)
            a *= d_hun
            np.multiply(a, every_hun[:, t], out=d_r)
            np.matmul(d[:3, :, t], u_t, out=back)
            d_h *= z
            for of_gate in back:
                d_h += of_gate
        rows = d.reshape(4, 2, -1, h_n)
        ones, grads = np.ones(steps * batch, F32), []
        for k, codes in enumerate((x, x[::-1])):
            order = np.argsort(codes, axis=None, kind="stable")
            held, first = np.unique(codes.ravel()[order], return_index=True)
            stretches = list(zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
            d_table, d_u = np.zeros((256, 3, h_n), F32), np.zeros((h_n, 3, h_n), F32)
            before = out[k, :-1].reshape(-1, h_n).T
            for gate, (i, j) in enumerate(((0, 0), (1, 1), (3, 2))):
                by_byte = np.take(rows[i, k], order, 0, out=self._room("by_byte", steps * batch, h_n), mode="clip")
                for c, lo, hi in stretches:
                    d_table[c, gate] = ones[lo:hi] @ by_byte[lo:hi]
                d_table[:, gate] *= factor[i]
                d_u[:, gate] = before @ rows[j, k, batch:] * (factor[j] * STATE)
            grads += [d_table.reshape(256, -1), d_u.reshape(h_n, -1)]
        return grads

    def _soft(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Probabilities (T, classes, B) for the states of both directions as ``_run`` gives them, in the order of the text."""
        w = self.w.T * STATE
        p = w[:, : self.hidden] @ f.transpose(0, 2, 1)
        p += w[:, self.hidden :] @ g.transpose(0, 2, 1)
        p += self.b[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, classes) for bytes (T, B); the end of short texts is padded with 0."""
        out = np.empty((len(x), self.classes, x.shape[1]), F32)
        for at in range(0, x.shape[1], AT_ONCE):
            f, g = self._run(x[:, at : at + AT_ONCE])[0]
            out[:, :, at : at + AT_ONCE] = self._soft(f, g[::-1])
        return out.transpose(0, 2, 1)

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions with y >= 0, each with the weight of its class, and gradients of all parameters."""
        saved = self._run(x, keep=True)
        f, g = saved[0][0], saved[0][1, ::-1]
        d = self._soft(f, g)
        on = y >= 0
        share = on.astype(F32) if weight is None else np.where(on, weight.astype(F32)[y], F32(0))
        share /= max(float(share.sum()), 1e-9)
        t, b = np.nonzero(on)
        k = y[t, b]
        loss = float(-(np.log(np.maximum(d[t, k, b], 1e-9)) * share[t, b]).sum())
        d[t, k, b] -= 1
        d *= share[:, None]
        flat = d.transpose(0, 2, 1).reshape(-1, self.classes)
        d_w = np.concatenate([states.reshape(-1, self.hidden).T @ flat * STATE for states in (f, g)])
        d_out = self._room("d_out", 2, *f.shape)
        np.matmul(flat, self.w[: self.hidden].T, out=d_out[0].reshape(-1, self.hidden))
        d_out[1] = (flat @ self.w[self.hidden :].T).reshape(g.shape)[::-1]
        return loss, [*self._grads(x, saved, d_out), d_w, flat.sum(axis=0)]


class Adam:
    """Steps of a model's parameters by their gradients, which are clipped."""

    def __init__(self, model: BiGRU, clip: float = 1.0) -> None:
        self.model, self.clip, self.i = model, clip, 0
        self.m = [np.zeros_like(p) for p in model.params()]
        self.v = [np.zeros_like(p) for p in model.params()]

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, weight: np.ndarray | None = None) -> float:
        loss, grads = self.model.loss_and_grads(x, y, weight)
        self.i += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        scale = min(1.0, self.clip / (norm + 1e-9))
        for p, g, a, b in zip(self.model.params(), grads, self.m, self.v, strict=True):
            g = g * F32(scale)
            a += F32(0.1) * (g - a)
            b += F32(0.01) * (g * g - b)
            p -= F32(rate) * (a / F32(1 - 0.9**self.i)) / (np.sqrt(b / F32(1 - 0.99**self.i)) + F32(1e-8))
        return loss


def train(model: BiGRU, batches, rate: float = 0.01, clip: float = 1.0) -> list[float]:
    """Adam over (x, y) batches; the rate falls linearly to a tenth, and the last quarter's parameters are averaged."""
    batches = list(batches)
    mean = [np.zeros_like(p) for p in model.params()]
    last = max(1, len(batches) // 4)
    adam, losses = Adam(model, clip), []
    for i, (x, y) in enumerate(batches, 1):
        losses.append(adam.step(x, y, rate * (1 - 0.9 * i / len(batches))))
        if i > len(batches) - last:
            for p, q in zip(model.params(), mean, strict=True):
                q += p / F32(last)
    for p, q in zip(model.params(), mean, strict=True):
        p[...] = q if batches else p
    return losses
