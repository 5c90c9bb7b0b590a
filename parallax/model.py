"""A small sequential regression network held as plain numpy arrays.

The model is data: every weight is one row of the weights table
(``layer int, row int, col int, value double, activation string``, with
``row = -1`` for the bias).  This module only holds the in-memory record and
the numpy forward/backward pass used inside Spark tasks (Arrow batches) and
for the driver-side parameter bookkeeping.  All data-sized work runs in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Supported activation names, as stored in the weights table.
ACTIVATIONS = ("identity", "relu", "tanh", "sigmoid")


@dataclass(frozen=True)
class Dense:
    """One fully connected layer: ``act(x @ weights + bias)``."""

    weights: np.ndarray  # shape (n_in, n_out); row = input unit, col = output unit
    bias: np.ndarray  # shape (n_out,)
    activation: str = "identity"

    def __post_init__(self):
        w = np.asarray(self.weights, dtype=np.float64)
        b = np.asarray(self.bias, dtype=np.float64).reshape(-1)
        if w.ndim != 2:
            raise ValueError(f"layer weights must be 2-D, got shape {w.shape}")
        if b.shape[0] != w.shape[1]:
            raise ValueError(f"bias has {b.shape[0]} entries, layer has {w.shape[1]} outputs")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}; use one of {ACTIVATIONS}")
        object.__setattr__(self, "weights", w)
        object.__setattr__(self, "bias", b)

    @property
    def n_in(self) -> int:
        return self.weights.shape[0]

    @property
    def n_out(self) -> int:
        return self.weights.shape[1]


@dataclass(frozen=True)
class Model:
    """A sequential stack of dense layers (a regression network)."""

    layers: tuple[Dense, ...]

    def __post_init__(self):
        layers = tuple(self.layers)
        if not layers:
            raise ValueError("a model needs at least one layer")
        for a, b in zip(layers, layers[1:]):
            if a.n_out != b.n_in:
                raise ValueError(f"layer widths do not chain: {a.n_out} -> {b.n_in}")
        object.__setattr__(self, "layers", layers)

    # -- shape -------------------------------------------------------------
    @property
    def n_inputs(self) -> int:
        return self.layers[0].n_in

    @property
    def n_outputs(self) -> int:
        return self.layers[-1].n_out

    @property
    def n_params(self) -> int:
        return sum(l.weights.size + l.bias.size for l in self.layers)

    # -- flat parameter vector (layer by layer: weights row-major, then bias) --
    def params(self) -> np.ndarray:
        return np.concatenate([np.concatenate([l.weights.ravel(), l.bias]) for l in self.layers])

    def with_params(self, flat) -> "Model":
        flat = np.asarray(flat, dtype=np.float64).reshape(-1)
        if flat.size != self.n_params:
            raise ValueError(f"expected {self.n_params} parameters, got {flat.size}")
        out, pos = [], 0
        for l in self.layers:
            nw = l.weights.size
            w = flat[pos : pos + nw].reshape(l.weights.shape)
            pos += nw
            b = flat[pos : pos + l.n_out]
            pos += l.n_out
            out.append(Dense(w.copy(), b.copy(), l.activation))
        return Model(tuple(out))

    # -- constructors --------------------------------------------------------
    @staticmethod
    def from_lists(spec) -> "Model":
        """``spec``: iterable of ``(weights_rows, bias, activation)``."""
        return Model(tuple(Dense(np.array(w, dtype=np.float64), np.array(b, dtype=np.float64), a) for w, b, a in spec))

    @staticmethod
    def random(sizes, activations, seed: int = 0) -> "Model":
        """Glorot-uniform weights, zero bias; ``sizes`` = [n_in, h1, ..., n_out]."""
        if len(activations) != len(sizes) - 1:
            raise ValueError("need one activation per layer")
        rng = np.random.default_rng(seed)
        layers = []
        for n_in, n_out, act in zip(sizes, sizes[1:], activations):
            lim = np.sqrt(6.0 / (n_in + n_out))
            layers.append(Dense(rng.uniform(-lim, lim, size=(n_in, n_out)), np.zeros(n_out), act))
        return Model(tuple(layers))


# -- numpy kernels (run inside Spark tasks on Arrow batches) -------------------

def _act(name: str, z: np.ndarray) -> np.ndarray:
    if name == "identity":
        return z
    if name == "relu":
        return np.where(z < 0.0, 0.0, z)  # the expression form's rule (NaN stays NaN)
    if name == "tanh":
        return np.tanh(z)
    return 1.0 / (1.0 + np.exp(-z))


def _act_grad(name: str, z: np.ndarray, a: np.ndarray) -> np.ndarray:
    if name == "identity":
        return np.ones_like(z)
    if name == "relu":
        return (z > 0.0).astype(z.dtype)
    if name == "tanh":
        return 1.0 - a * a
    return a * (1.0 - a)


# Layers up to this many weights are evaluated as an explicit left fold
# (bit-identical to the expressions; 0.45 vs 0.2 ms per 10k rows for a 2-8-1
# net); wider ones use BLAS, which is 10-100x faster there (a 64x64 layer:
# 84 ms vs 5 ms per 10k rows, measured).  ``score`` sends the smallest
# networks (``operators.score.EXPR_MAX_WEIGHTS``) to the JVM expression path.
FOLD_MAX_WEIGHTS = 256


def _dense_fold(a: np.ndarray, l: Dense) -> np.ndarray:
    """``((a0*w0 + a1*w1) + ...) + b`` per unit, one IEEE operation at a time:
    the same order (and so the same bits) as the generated Column
    expressions and as an SQL engine evaluating ``a0*w0 + a1*w1 + ... + b``."""
    cols = np.ascontiguousarray(a.T)  # one contiguous column per input
    out = np.empty((a.shape[0], l.n_out))
    tmp = np.empty(a.shape[0])
    for j in range(l.n_out):
        z = cols[0] * l.weights[0, j]
        for i in range(1, l.n_in):
            np.multiply(cols[i], l.weights[i, j], out=tmp)
            np.add(z, tmp, out=z)
        z += l.bias[j]
        out[:, j] = z
    return out


def forward(model: Model, x: np.ndarray, exact: bool | None = None) -> np.ndarray:
    """Predictions for a batch ``x`` of shape (n, n_inputs).

    ``exact`` (default: for layers up to ``FOLD_MAX_WEIGHTS`` weights) sums
    in the expression order, bit-identical to ``score_expr`` for identity and
    ReLU layers; otherwise a BLAS matrix product (same values to ~1e-15).
    """
    a = np.asarray(x, dtype=np.float64)
    for l in model.layers:
        fold = (l.weights.size <= FOLD_MAX_WEIGHTS) if exact is None else exact
        z = _dense_fold(a, l) if fold else a @ l.weights + l.bias
        a = _act(l.activation, z)
    return a


def loss_grad_sums(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed squared error over the rows and its gradient w.r.t. ``model.params()``.

    Sums (not means) so that a minibatch seen in several Arrow chunks adds up
    to the same step: ``grad(batch) = sum(grad_sums(chunk)) / rows(batch)``.
    """
    x = np.asarray(x, dtype=np.float64)
    y = np.asarray(y, dtype=np.float64).reshape(x.shape[0], -1)
    acts, zs = [x], []
    a = x
    for l in model.layers:
        z = a @ l.weights + l.bias
        a = _act(l.activation, z)
        zs.append(z)
        acts.append(a)
    diff = acts[-1] - y
    loss = float(np.sum(diff * diff))
    delta = 2.0 * diff
    grads = []
    for i in range(len(model.layers) - 1, -1, -1):
        l = model.layers[i]
        delta = delta * _act_grad(l.activation, zs[i], acts[i + 1])
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = delta @ l.weights.T
    grads.reverse()
    return loss, np.concatenate([np.concatenate([gw.ravel(), gb]) for gw, gb in grads])


# -- shipping a model to tasks -------------------------------------------------

# Models up to this many parameters ride in the task closure; larger ones are
# sent once per executor as a Spark broadcast variable.
CLOSURE_MAX_PARAMS = 100_000


class ModelRef:
    """A picklable handle to a model for task closures.

    Small models are carried inline; large ones through a broadcast variable
    (fetched once per executor, not once per task).  ``get()`` returns the
    ``Model`` on either side.
    """

    def __init__(self, model: Model, spark_context=None, max_inline: int | None = None):
        self._inline = None
        self._bc = None
        limit = CLOSURE_MAX_PARAMS if max_inline is None else max_inline
        if model.n_params <= limit or spark_context is None:
            self._inline = model
        else:
            self._bc = spark_context.broadcast(model)

    @property
    def broadcast(self):
        return self._bc

    def get(self) -> Model:
        return self._inline if self._bc is None else self._bc.value

    def release(self) -> None:
        if self._bc is not None:
            self._bc.unpersist()
