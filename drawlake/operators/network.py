"""Layered networks: outputs, back-propagation and training by gradient passes over distributed cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.functions.numeric import log_gamma, product

SQRT2 = float(np.sqrt(2))
#: Groups of parameters: one array (inputs or outputs), or a list with one array or None for each layer.
GROUPS = ("ti", "ih", "th", "hh", "bh", "ho", "io", "bo")


class Network:
    """A layered network: units tanh, sin (sqrt2 sin(sqrt2 x)) or identity; links input-hidden, hidden-hidden, skip and direct.

    A draw is a dict of arrays: ``ih`` per layer (inputs x units or None), ``hh`` per layer after the first,
    ``bh`` per layer, ``ho`` per layer, ``bo`` and ``io``, and the offsets added to inputs (``ti``) and to the units of
    each layer (``th``, or None) wherever they are used; missing parts count nothing. ``omit`` lists, for a layer or
    for -1 (the outputs), the inputs that have no links to it. ``keep`` leaves only the links of these layers to the outputs.
    """

    UNITS = {"tanh": np.tanh, "sin": lambda x: SQRT2 * np.sin(SQRT2 * x), "identity": lambda x: x}
    #: Derivative of a unit by its summed input x, of which it has made h.
    SLOPES = {"tanh": lambda x, h: 1 - h * h, "sin": lambda x, h: 2 * np.cos(SQRT2 * x), "identity": lambda x, h: np.ones_like(x)}

    def __init__(self, units: list[str], keep: set[int] | None = None, omit: dict[int, list[int]] | None = None):
        self.units, self.keep, self.omit = units, keep, omit or {}

    @staticmethod
    def _part(draw: dict, name: str, layer: int) -> np.ndarray | None:
        """A layer's array of a group of parameters."""
        group = draw.get(name)
        return None if group is None or layer >= len(group) else group[layer]

    def _seen(self, x: np.ndarray, layer: int) -> np.ndarray:
        """The inputs as a layer (-1: the outputs) has them: 0 where it omits one."""
        if layer not in self.omit:
            return x
        x = x.copy()
        x[:, self.omit[layer]] = 0
        return x

    def _used(self, h: np.ndarray, draw: dict, layer: int) -> np.ndarray:
        offset = self._part(draw, "th", layer)
        return h if offset is None else h + offset

    def _sums(self, x: np.ndarray, draw: dict) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Inputs with their offsets, summed inputs of the units, and values of the units."""
        if draw.get("ti") is not None:
            x = x + draw["ti"]
        sums: list[np.ndarray] = []
        layers: list[np.ndarray] = []
        for i, unit in enumerate(self.units):
            total = np.zeros((len(x), 1))
            if (w := self._part(draw, "ih", i)) is not None:
                total = total + product(self._seen(x, i), w)
            if i and (w := self._part(draw, "hh", i - 1)) is not None:
                total = total + product(self._used(layers[-1], draw, i - 1), w)
            if (b := self._part(draw, "bh", i)) is not None:
                total = total + b
            sums.append(total)
            layers.append(self.UNITS[unit](total))
        return x, sums, layers

    def _outputs(self, x: np.ndarray, layers: list[np.ndarray], draw: dict) -> np.ndarray:
        out = np.zeros((len(x), 1))
        for i, h in enumerate(layers):
            if (w := self._part(draw, "ho", i)) is not None and (self.keep is None or i in self.keep):
                out = out + product(self._used(h, draw, i), w)
        if self.keep is None:  # components leave out direct links and biases
            if draw.get("io") is not None:
                out = out + product(self._seen(x, -1), draw["io"])
            if draw.get("bo") is not None:
                out = out + draw["bo"]
        return out

    def hidden(self, x: np.ndarray, draw: dict) -> list[np.ndarray]:
        return self._sums(x, draw)[2]

    def output(self, x: np.ndarray, draw: dict) -> np.ndarray:
        x, _, layers = self._sums(x, draw)
        return self._outputs(x, layers, draw)

    def gradient(self, x: np.ndarray, draw: dict, slope) -> tuple[np.ndarray, dict]:
        """The outputs of ``x``, and the sums over its rows of the derivatives by all parameters, as a dict like ``draw``.

        ``slope(outputs)`` gives the derivatives of each row's error by its outputs. They are carried back through the
        layers: a unit gets them from the outputs and from the next layer, an input from all layers and the outputs.
        """
        if self.keep is not None:
            raise ValueError("a network of components has no gradient")
        x, sums, layers = self._sums(x, draw)
        out = self._outputs(x, layers, draw)
        by_out = slope(out)
        grad: dict = {n: [None] * len(draw[n]) if n in ("ih", "th", "hh", "bh", "ho") else None for n in GROUPS if draw.get(n) is not None}
        by_input = np.zeros(x.shape)
        if draw.get("bo") is not None:
            grad["bo"] = by_out.sum(0)
        if draw.get("io") is not None:
            grad["io"] = product(self._seen(x, -1).T, by_out)
            by_input += self._seen(product(by_out, draw["io"].T), -1)
        by_sum = None  # of the layer above
        for i in range(len(layers) - 1, -1, -1):
            by_unit = np.zeros(layers[i].shape)
            used = self._used(layers[i], draw, i)
            if (w := self._part(draw, "ho", i)) is not None:
                by_unit = by_unit + product(by_out, w.T)
                grad["ho"][i] = product(used.T, by_out)
            if by_sum is not None and (w := self._part(draw, "hh", i)) is not None:
                by_unit = by_unit + product(by_sum, w.T)
                grad["hh"][i] = product(used.T, by_sum)
            if self._part(draw, "th", i) is not None:
                grad["th"][i] = by_unit.sum(0)
            by_sum = by_unit * self.SLOPES[self.units[i]](sums[i], layers[i])
            if self._part(draw, "bh", i) is not None:
                grad["bh"][i] = by_sum.sum(0)
            if (w := self._part(draw, "ih", i)) is not None:
                grad["ih"][i] = product(self._seen(x, i).T, by_sum)
                by_input += self._seen(product(by_sum, w.T), i)
        if draw.get("ti") is not None:
            grad["ti"] = by_input.sum(0)
        return out, grad


def _class_shares(o: np.ndarray) -> np.ndarray:
    p = np.exp(o - o.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _one_hot(o: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (np.arange(o.shape[1]) == t[:, :1]).astype(np.float64)


#: For each kind of target, of outputs o and targets t (cases x targets): what a case loses, and minus its log
#: probability's derivative by the outputs. ``squared`` reports the squared error, and goes down by half of it.
LOSSES = {
    "squared": (lambda o, t: ((o - t) ** 2).sum(1), lambda o, t: o - t),
    "class": (lambda o, t: -np.log((_class_shares(o) * _one_hot(o, t)).sum(1)), lambda o, t: _class_shares(o) - _one_hot(o, t)),
    "binary": (lambda o, t: (np.logaddexp(0, o) - t * o).sum(1), lambda o, t: 1 / (1 + np.exp(-o)) - t),
    "count": (lambda o, t: (np.exp(o) - t * o + log_gamma(t + 1)).sum(1), lambda o, t: np.exp(o) - t),
}


def flat(params: dict) -> tuple[np.ndarray, list[tuple[str, int, tuple[int, ...]]]]:
    """All parameters in one array, in the order of ``GROUPS`` and layers, and (group, layer or -1, shape) of each part."""
    parts, places = [], []
    for name in GROUPS:
        group = params.get(name)
        for layer, x in enumerate(group) if isinstance(group, list) else [(-1, group)]:
            if x is not None:
                parts.append(np.asarray(x, np.float64).ravel())
                places.append((name, layer, np.asarray(x).shape))
    return np.concatenate(parts) if parts else np.zeros(0), places


def unflat(values: np.ndarray, like: dict) -> dict:
    """The dict of parameters of which ``flat`` made ``values``; ``like`` has its form."""
    out, at = {n: list(v) if isinstance(v, list) else v for n, v in like.items()}, 0
    for name, layer, shape in flat(like)[1]:
        n = int(np.prod(shape))
        x = values[at : at + n].reshape(shape)
        if layer < 0:
            out[name] = x
        else:
            out[name][layer] = x
        at += n
    return out


def _prepared(cases: DataFrame, inputs: list[str], target: str | list[str], validation: str | None) -> tuple[DataFrame, list[str]]:
    """Inputs, targets and ``_v`` of the cases whose targets are known."""
    targets = [target] if isinstance(target, str) else target
    keep = F.lit(False) if validation is None else F.coalesce(F.col(validation), F.lit(False))
    names = [f"_t{i}" for i in range(len(targets))]
    rows = cases.select(*[F.col(c).cast("double") for c in inputs], *[F.col(c).cast("double").alias(n) for n, c in zip(names, targets)], keep.alias("_v"))
    return rows.dropna(subset=names), names


def _gradient_sums(rows: DataFrame, inputs: list[str], names: list[str], params: dict, network: Network, loss: str) -> np.ndarray:
    """Losses and numbers of training and validation rows, then the gradient over the training rows.

    The parameters are broadcast. Each task adds up its batches and gives one row a parameter, which are summed by
    parameter; so the driver gets the parameters' number of rows, however many the tasks.
    """
    lose, slope = LOSSES[loss]
    shared = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = shared.value, None
        for batch in batches:
            x, t, held = batch[inputs].to_numpy(np.float64), batch[names].to_numpy(np.float64), batch["_v"].to_numpy(bool)
            out, grad = network.gradient(x, now, lambda o, t=t, held=held: np.where(held[:, None], 0.0, slope(o, t)))
            lost = lose(out, t)
            part = np.concatenate([[lost[~held].sum(), (~held).sum(), lost[held].sum(), held.sum()], flat(grad)[0]])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pd.DataFrame({"i": np.arange(len(sums)), "s": sums})

    found = rows.mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(4 + len(flat(params)[0]))
    for r in found:
        out[r["i"]] = r["s"]
    return out


def network_gradient(cases: DataFrame, inputs: list[str], target: str | list[str], params: dict, network: Network, loss: str = "squared") -> list[tuple[str, int, int, float]]:
    """(group, layer or -1, place, derivative) of the summed loss by each parameter; cases without a target are left out."""
    rows, names = _prepared(cases, inputs, target, None)
    sums, out, at = _gradient_sums(rows, inputs, names, params, network, loss)[4:], [], 0
    for name, layer, shape in flat(params)[1]:
        n = int(np.prod(shape))
        out += [(name, layer, i, float(g)) for i, g in enumerate(sums[at : at + n])]
        at += n
    return out


def network_fit(cases: DataFrame, inputs: list[str], target: str | list[str], start: dict, network: Network, steps: int, step: float | dict[str, float], validation: str | None = None, prior: float = 0.0, loss: str = "squared") -> list[tuple[int, float, float | None, dict]]:
    """Full-batch gradient descent of any ``Network`` on a kind of ``LOSSES``.

    Every step broadcasts the parameters, sums the gradients of all training cases and divides by N + 1; ``step`` is one
    number or one for each group of parameters (``GROUPS``); ``prior`` times a parameter is added to its gradient. Rows
    where the boolean column ``validation`` holds give a second loss only. Returns (step, mean loss, mean loss on
    validation rows, parameters), all before the step's move. Cases are persisted for the passes; null inputs are an
    error of numpy's kind (not a number), rows with a null target are left out. A class target counts from 0.
    """
    rows, names = _prepared(cases, inputs, target, validation)
    rows = rows.persist()
    now, places = flat(start)
    size = np.concatenate([np.full(int(np.prod(shape)), step[name] if isinstance(step, dict) else step) for name, _, shape in places])
    trace, params = [], unflat(now, start)
    for at in range(steps):
        sums = _gradient_sums(rows, inputs, names, params, network, loss)
        if not sums[1] + sums[3]:
            break
        trace.append((at, sums[0] / max(sums[1], 1), sums[2] / sums[3] if sums[3] else None, params))
        now = now - size / (sums[1] + 1) * (sums[4:] + prior * now)
        params = unflat(now, start)
    rows.unpersist()
    return trace


def early_stop(trace: list[tuple[int, float, float | None, dict]]) -> tuple[int, float, float | None, dict]:
    """The first step with the smallest validation loss."""
    return min(trace, key=lambda r: (r[2], r[0]))
