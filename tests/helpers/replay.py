"""A sequential numpy replay of minibatch SGD: the tests' own oracle."""

import numpy as np

from parallax.model import Model, loss_grad_sums


def loss_and_grad(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared error ``mean_rows(sum_outputs((yhat - y)^2))`` and its gradient."""
    n = np.asarray(x).shape[0]
    loss, grad = loss_grad_sums(model, x, y)
    return loss / n, grad / n


def sgd_steps(model: Model, x: np.ndarray, y: np.ndarray, batch_no: np.ndarray, learning_rate: float):
    """Plain SGD over consecutive minibatches (rows already ordered by ``batch_no``).

    Returns ``(params, rows, weighted_loss_sum)``; the loss of each minibatch is
    taken before its step and weighted by its row count.
    """
    params = model.params()
    if x.shape[0] == 0:
        return params, 0, 0.0
    cuts = np.flatnonzero(np.diff(batch_no)) + 1
    bounds = np.concatenate([[0], cuts, [x.shape[0]]])
    loss_sum = 0.0
    m = model
    for s, e in zip(bounds[:-1], bounds[1:]):
        loss, g = loss_and_grad(m, x[s:e], y[s:e])
        loss_sum += loss * (e - s)
        params = params - learning_rate * g
        m = m.with_params(params)
    return params, int(x.shape[0]), loss_sum
