"""Networks over windows of rows, learned in the tasks that hold the windows: a bidirectional LSTM and an encoder-decoder with attention.

``Tape`` records array operations and runs them backwards for gradients. ``learn`` is mini-batch Adam with early stopping as a learner
of ``gather``: each task takes its share of a batch, gradients are summed over the tasks, and all tasks make the same step.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]


class Var:
    __slots__ = ("g", "v")

    def __init__(self, v: np.ndarray):
        self.v, self.g = v, None


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which a value of this shape was spread."""
    g = g.sum(tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    axes = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axes, keepdims=True) if axes else g


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Tape:
    """Operations in the order in which they were done. ``rng``: dropout is at work."""

    def __init__(self, rng: np.random.Generator | None = None):
        self.done: list = []
        self.rng = rng

    def _op(self, v: np.ndarray, parents: tuple[Var, ...], back: Callable[[np.ndarray], tuple]) -> Var:
        out = Var(v)
        self.done.append((out, parents, back))
        return out

    def backward(self, out: Var, g: np.ndarray) -> None:
        out.g = g
        for made, parents, back in reversed(self.done):
            if made.g is not None:
                for p, own in zip(parents, back(made.g), strict=True):
                    p.g = own if p.g is None else p.g + own

    def add(self, a: Var, b: Var) -> Var:
        return self._op(a.v + b.v, (a, b), lambda g: (_fit(g, a.v.shape), _fit(g, b.v.shape)))

    def mul(self, a: Var, b: Var) -> Var:
        return self._op(a.v * b.v, (a, b), lambda g: (_fit(g * b.v, a.v.shape), _fit(g * a.v, b.v.shape)))

    def matmul(self, a: Var, b: Var) -> Var:
        return self._op(a.v @ b.v, (a, b), lambda g: (_fit(g @ b.v.swapaxes(-1, -2), a.v.shape), _fit(a.v.swapaxes(-1, -2) @ g, b.v.shape)))

    def linear(self, x: Var, w: Var, b: Var) -> Var:
        def back(g):
            flat, own = g.reshape(-1, g.shape[-1]), x.v.reshape(-1, x.v.shape[-1])
            return (flat @ w.v.T).reshape(x.v.shape), own.T @ flat, flat.sum(0)

        return self._op((x.v.reshape(-1, x.v.shape[-1]) @ w.v + b.v).reshape(*x.v.shape[:-1], -1), (x, w, b), back)

    def sigmoid(self, a: Var) -> Var:
        y = _sigmoid(a.v)
        return self._op(y, (a,), lambda g: (g * y * (1 - y),))

    def elu(self, a: Var) -> Var:
        low = np.exp(np.minimum(a.v, 0))
        return self._op(np.where(a.v > 0, a.v, low - 1), (a,), lambda g: (g * np.where(a.v > 0, 1, low),))

    def softmax(self, a: Var, mask: np.ndarray | None = None) -> Var:
        z = a.v if mask is None else np.where(mask, a.v, -1e9)
        e = np.exp(z - z.max(-1, keepdims=True))
        y = e / e.sum(-1, keepdims=True)
        return self._op(y, (a,), lambda g: (y * (g - (g * y).sum(-1, keepdims=True)),))

    def norm(self, a: Var, scale: Var, shift: Var) -> Var:
        """Layer normalisation over the last axis."""
        centred = a.v - a.v.mean(-1, keepdims=True)
        inv = 1 / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5)
        y = centred * inv

        def back(g):
            own = g * scale.v
            return inv * (own - own.mean(-1, keepdims=True) - y * (own * y).mean(-1, keepdims=True)), _fit(g * y, scale.v.shape), _fit(g, shift.v.shape)

        return self._op(y * scale.v + shift.v, (a, scale, shift), back)

    def concat(self, parts: list[Var], axis: int = -1) -> Var:
        cuts = np.cumsum([p.v.shape[axis] for p in parts])[:-1]
        return self._op(np.concatenate([p.v for p in parts], axis), tuple(parts), lambda g: tuple(np.split(g, cuts, axis)))

    def take(self, a: Var, at) -> Var:
        def back(g):
            out = np.zeros_like(a.v)
            out[at] = g
            return (out,)

        return self._op(a.v[at], (a,), back)

    def shape(self, a: Var, shape: tuple[int, ...], order: tuple[int, ...] | None = None) -> Var:
        """Reshaped, then with its axes in another order."""
        order = order or tuple(range(len(shape)))
        return self._op(a.v.reshape(shape).transpose(order), (a,), lambda g: (g.transpose(np.argsort(order)).reshape(a.v.shape),))

    def sum(self, a: Var, axis: int) -> Var:
        return self._op(a.v.sum(axis), (a,), lambda g: (np.broadcast_to(np.expand_dims(g, axis), a.v.shape),))

    def dropout(self, a: Var, share: float) -> Var:
        if self.rng is None or not share:
            return a
        kept = (self.rng.random(a.v.shape) >= share).astype(a.v.dtype) / (1 - share)
        return self._op(a.v * kept, (a,), lambda g: (g * kept,))

    def lstm(self, x: Var, wx: Var, wh: Var, b: Var, h0: Var | None = None, c0: Var | None = None) -> Var:
        """Outputs and cells (side by side in the last axis) of every step of ``x`` (rows, steps, features)."""
        n, steps, _ = x.v.shape
        size = wh.v.shape[0]
        zero = np.zeros((n, size), x.v.dtype)
        h, c = (zero if h0 is None else h0.v), (zero if c0 is None else c0.v)
        zx = (x.v.reshape(-1, x.v.shape[-1]) @ wx.v + b.v).reshape(n, steps, 4 * size)
        gates, before, out = np.empty_like(zx), np.empty((n, steps, 2 * size), x.v.dtype), np.empty((n, steps, 2 * size), x.v.dtype)
        for t in range(steps):
            before[:, t, :size], before[:, t, size:] = h, c
            z = zx[:, t] + h @ wh.v
            a = gates[:, t]
            a[:, : 3 * size] = _sigmoid(z[:, : 3 * size])  # in, forget, out
            a[:, 3 * size :] = np.tanh(z[:, 3 * size :])
            c = a[:, size : 2 * size] * c + a[:, :size] * a[:, 3 * size :]
            h = a[:, 2 * size : 3 * size] * np.tanh(c)
            out[:, t, :size], out[:, t, size:] = h, c

        def back(g):
            dz, dh, dc = np.empty_like(zx), zero, zero
            for t in range(steps - 1, -1, -1):
                a = gates[:, t]
                i, f, o, u = a[:, :size], a[:, size : 2 * size], a[:, 2 * size : 3 * size], a[:, 3 * size :]
                squashed = np.tanh(out[:, t, size:])
                dh = dh + g[:, t, :size]
                dc = dc + g[:, t, size:] + dh * o * (1 - squashed**2)
                d = dz[:, t]
                d[:, :size], d[:, size : 2 * size] = dc * u * i * (1 - i), dc * before[:, t, size:] * f * (1 - f)
                d[:, 2 * size : 3 * size], d[:, 3 * size :] = dh * squashed * o * (1 - o), dc * i * (1 - u**2)
                dh, dc = d @ wh.v.T, dc * f
            flat = dz.reshape(-1, 4 * size)
            own = (flat @ wx.v.T).reshape(x.v.shape), x.v.reshape(-1, x.v.shape[-1]).T @ flat, before[..., :size].reshape(-1, size).T @ flat, flat.sum(0)
            return own if h0 is None else (*own, dh, dc)

        return self._op(out, (x, wx, wh, b) if h0 is None else (x, wx, wh, b, h0, c0), back)


class Network:
    """Parameters by name, and a forward pass over a batch of arrays."""

    def start(self, rng: np.random.Generator) -> Params:
        raise NotImplementedError

    def forward(self, tape: Tape, p: dict[str, Var], batch: list[np.ndarray]) -> Var:
        raise NotImplementedError


def _lstm_start(p: Params, name: str, width: int, size: int, rng: np.random.Generator) -> None:
    for part, shape in (("x", (width, 4 * size)), ("h", (size, 4 * size)), ("b", (4 * size,))):
        p[f"{name}.{part}"] = rng.uniform(-1, 1, shape) / np.sqrt(size)


def _linear_start(p: Params, name: str, width: int, size: int, rng: np.random.Generator) -> None:
    p[f"{name}.w"] = rng.uniform(-1, 1, (width, size)) / np.sqrt(width)
    p[f"{name}.b"] = np.zeros(size)


@dataclass(frozen=True)
class BiLstm(Network):
    """Two bidirectional layers; the last step's outputs make the prediction. Batch: windows (rows, steps, features)."""

    features: int
    hidden: int = 64
    dropout: float = 0.2

    def start(self, rng: np.random.Generator) -> Params:
        p: Params = {}
        for layer, width in ((1, self.features), (2, 2 * self.hidden)):
            for way in "fb":
                _lstm_start(p, f"{layer}{way}", width, self.hidden, rng)
        _linear_start(p, "out", 2 * self.hidden, 1, rng)
        return p

    def forward(self, tape: Tape, p: dict[str, Var], batch: list[np.ndarray]) -> Var:
        run = lambda name, x: tape.take(tape.lstm(x, p[f"{name}.x"], p[f"{name}.h"], p[f"{name}.b"]), np.s_[..., : self.hidden])
        x = Var(batch[0])
        back = np.s_[:, ::-1]
        both = tape.dropout(tape.concat([run("1f", x), tape.take(run("1b", tape.take(x, back)), back)]), self.dropout)
        # Backwards, the last step is the first: it has seen the last row only.
        last = tape.concat([tape.take(run("2f", both), np.s_[:, -1]), tape.take(run("2b", tape.take(both, np.s_[:, -1:])), np.s_[:, -1])])
        return tape.linear(tape.dropout(last, self.dropout), p["out.w"], p["out.b"])


@dataclass(frozen=True)
class Attention(Network):
    """Encoder-decoder with gated variable selection and attention over time. Batch: past (rows, back, features), known (rows, ahead, features).

    Each variable is embedded and passed through a gated block of its own; a softmax over variables weighs them at every step. LSTMs run through the past and on
    through the known steps; these attend to all steps up to their own, with heads that share their values, so that the mean of the heads' weights tells what was looked at.
    """

    past: int
    known: int
    hidden: int = 32
    heads: int = 4
    dropout: float = 0.1

    def start(self, rng: np.random.Generator) -> Params:
        p, d = {}, self.hidden
        for side, n in (("past", self.past), ("known", self.known)):
            p[f"{side}.embed"] = rng.normal(0, 1, (n, d)) / np.sqrt(d)
            p[f"{side}.place"] = np.zeros((n, d))
            for part in ("a", "b", "c", "g"):
                p[f"{side}.each.{part}"] = rng.uniform(-1, 1, (n, d, d)) / np.sqrt(d)
            _linear_start(p, f"{side}.pick", n * d, n, rng)
            _lstm_start(p, f"{side}.lstm", d, d, rng)
        for name in ("steps", "seen", "last"):
            _linear_start(p, f"{name}.in", d, d, rng)
            _linear_start(p, f"{name}.gate", d, d, rng)
            p[f"{name}.scale"], p[f"{name}.shift"] = np.ones(d), np.zeros(d)
        for name in ("past.each", "known.each"):
            p[f"{name}.scale"], p[f"{name}.shift"] = np.ones(d), np.zeros(d)
        for name in ("query", "key"):
            _linear_start(p, name, d, d, rng)
        _linear_start(p, "value", d, d // self.heads, rng)
        _linear_start(p, "mixed", d // self.heads, d, rng)
        _linear_start(p, "out", d, 1, rng)
        return p

    def _gated(self, tape: Tape, p: dict[str, Var], name: str, x: Var, skip: Var) -> Var:
        """What is let through of ``x``, added to ``skip`` and normalised."""
        x = tape.dropout(x, self.dropout)
        let = tape.mul(tape.linear(x, p[f"{name}.in.w"], p[f"{name}.in.b"]), tape.sigmoid(tape.linear(x, p[f"{name}.gate.w"], p[f"{name}.gate.b"])))
        return tape.norm(tape.add(let, skip), p[f"{name}.scale"], p[f"{name}.shift"])

    def select(self, tape: Tape, p: dict[str, Var], side: str, x: np.ndarray) -> tuple[Var, Var]:
        """(rows, steps, hidden) and the weights of the variables (rows, steps, variables)."""
        n, steps, own = x.shape
        d = self.hidden
        flat = Var(x.reshape(-1, own).T[..., None])
        e = tape.add(tape.mul(flat, tape.shape(p[f"{side}.embed"], (own, 1, d))), tape.shape(p[f"{side}.place"], (own, 1, d)))
        inner = tape.matmul(tape.elu(tape.matmul(e, p[f"{side}.each.a"])), p[f"{side}.each.b"])
        let = tape.mul(tape.matmul(inner, p[f"{side}.each.c"]), tape.sigmoid(tape.matmul(inner, p[f"{side}.each.g"])))
        each = tape.norm(tape.add(let, e), p[f"{side}.each.scale"], p[f"{side}.each.shift"])
        weight = tape.softmax(tape.linear(tape.shape(tape.shape(e, (own, n * steps, d), (1, 0, 2)), (n * steps, own * d)), p[f"{side}.pick.w"], p[f"{side}.pick.b"]))
        picked = tape.sum(tape.mul(tape.shape(each, (own, n * steps, d), (1, 0, 2)), tape.shape(weight, (n * steps, own, 1))), 1)
        return tape.shape(picked, (n, steps, d)), tape.shape(weight, (n, steps, own))

    def explain(self, tape: Tape, p: dict[str, Var], batch: list[np.ndarray]) -> tuple[Var, Var, Var, Var]:
        """Predictions (rows, ahead), attention (rows, ahead, back + ahead), weights of past and of known variables."""
        d, h = self.hidden, self.heads
        (n, back, _), ahead = batch[0].shape, batch[1].shape[1]
        (past, w_past), (known, w_known) = self.select(tape, p, "past", batch[0]), self.select(tape, p, "known", batch[1])
        run = lambda name, x, *state: tape.lstm(x, p[f"{name}.lstm.x"], p[f"{name}.lstm.h"], p[f"{name}.lstm.b"], *state)
        first = run("past", past)
        state = tape.take(first, np.s_[:, -1, :d]), tape.take(first, np.s_[:, -1, d:])
        out = tape.take(tape.concat([first, run("known", known, *state)], 1), np.s_[..., :d])
        steps = self._gated(tape, p, "steps", out, tape.concat([past, known], 1))
        later = tape.take(steps, np.s_[:, back:])
        split = lambda x, m: tape.shape(x, (n, m, h, d // h), (0, 2, 1, 3))
        q, k = split(tape.linear(later, p["query.w"], p["query.b"]), ahead), split(tape.linear(steps, p["key.w"], p["key.b"]), back + ahead)
        near = tape.mul(tape.matmul(q, tape.shape(k, k.v.shape, (0, 1, 3, 2))), Var(np.asarray(1 / np.sqrt(d // h), batch[0].dtype)))
        mask = np.arange(back + ahead) <= back + np.arange(ahead)[:, None]
        attention = tape.mul(tape.sum(tape.softmax(near, mask), 1), Var(np.asarray(1 / h, batch[0].dtype)))
        seen = tape.linear(tape.matmul(attention, tape.linear(steps, p["value.w"], p["value.b"])), p["mixed.w"], p["mixed.b"])
        last = self._gated(tape, p, "last", self._gated(tape, p, "seen", seen, later), later)
        return tape.shape(tape.linear(last, p["out.w"], p["out.b"]), (n, ahead)), attention, w_past, w_known

    def forward(self, tape: Tape, p: dict[str, Var], batch: list[np.ndarray]) -> Var:
        return self.explain(tape, p, batch)[0]


@dataclass(frozen=True)
class Training:
    epochs: int = 20
    patience: int = 3
    batch: int = 256
    rate: float = 1e-3
    least: float = 0.0  # by which an epoch must be better than the best
    root: bool = False  # the loss is the root of the mean square
    seed: int = 42


def gradients(net: Network, params: Params, batch: list[np.ndarray], y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, Params]:
    """The sum of squares over a batch, and its gradients."""
    tape, p = Tape(rng), {k: Var(v) for k, v in params.items()}
    out = net.forward(tape, p, batch)
    miss = out.v - y.reshape(out.v.shape)
    tape.backward(out, 2 * miss)
    return float((miss.astype(np.float64) ** 2).sum()), {k: np.zeros_like(params[k]) if v.g is None else v.g for k, v in p.items()}


def predict(net: Network, params: Params, batch: list[np.ndarray], size: int = 1024) -> np.ndarray:
    parts = [net.forward(Tape(), {k: Var(v) for k, v in params.items()}, [x[i : i + size] for x in batch]).v for i in range(0, len(batch[0]), size)]
    return np.concatenate(parts) if parts else np.zeros((0, 1))


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def learn(net: Network, how: Training, train: tuple[list[np.ndarray], np.ndarray], check: tuple[list[np.ndarray], np.ndarray], task: int, parts: int, state: bytes | None, upto: int) -> Generator[np.ndarray, np.ndarray, bytes]:
    """Epochs from a state (None: the beginning) on to ``upto``; the state after. Yields arrays to be summed over the tasks."""
    kind = np.float32
    if state is None:
        first = {k: v.astype(kind) for k, v in net.start(np.random.default_rng(how.seed)).items()}
        held = {f"now.{k}": v for k, v in first.items()} | {f"best.{k}": v for k, v in first.items()} | {f"{m}.{k}": np.zeros_like(v) for m in ("m", "s") for k, v in first.items()}
        held |= {"at": np.array([0, 0, 0]), "loss": np.array(np.inf)}  # epoch, steps, epochs without gain
    else:
        held = unpacked(state)
    names = [k[4:] for k in held if k.startswith("now.")]
    params = {k: held[f"now.{k}"].copy() for k in names}
    sizes = np.zeros(parts)
    sizes[task] = len(train[1])
    sizes = yield sizes
    share = max(1, how.batch // parts)
    epoch, step, idle = (int(x) for x in held["at"])
    best, loss = {k: held[f"best.{k}"] for k in names}, float(held["loss"])
    while epoch < upto and idle < how.patience and sizes.any():
        rng = np.random.default_rng([how.seed, epoch, task])
        order = rng.permutation(len(train[1]))
        for lo in range(0, int(sizes.max()), share):
            own = order[lo : lo + share]
            sse, grads = gradients(net, params, [x[own] for x in train[0]], train[1][own], rng) if len(own) else (0.0, {k: np.zeros_like(v) for k, v in params.items()})
            total = yield np.concatenate([[train[1][own].size, sse], *[grads[k].ravel() for k in names]])
            n = total[0]
            scale = 1 / n if not how.root else 1 / n / (2 * max(np.sqrt(total[1] / n), 1e-6))
            step += 1
            at = 2
            for k in names:
                g = (total[at : at + params[k].size].reshape(params[k].shape) * scale).astype(kind)
                at += params[k].size
                m, s = held[f"m.{k}"], held[f"s.{k}"]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                params[k] -= (how.rate / (1 - 0.9**step)) * m / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        out = predict(net, params, check[0])
        total = yield np.array([((out.reshape(check[1].shape) - check[1]).astype(np.float64) ** 2).sum(), check[1].size])
        epoch += 1
        now = float(np.sqrt(total[0] / total[1]) if how.root else total[0] / total[1]) if total[1] else -float(epoch)
        if now < loss - how.least:
            loss, idle, best = now, 0, {k: v.copy() for k, v in params.items()}
        else:
            idle += 1
    held |= {f"now.{k}": v for k, v in params.items()} | {f"best.{k}": v for k, v in best.items()} | {"at": np.array([epoch, step, idle]), "loss": np.array(loss)}
    return packed(held)

