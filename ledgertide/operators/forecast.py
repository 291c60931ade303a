"""A small recurrent forecaster, trained for each group or trial in a task of its own; models are rows of a table."""

from __future__ import annotations

import io
import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.operators.evaluation import best_trial
from ledgertide.operators.features import SEQUENCE

INPUTS = 5
CLOSE_SCALE = 10_000.0
#: Points of history that a forecast shows, and epochs of a quick adaptation.
HISTORY, ADAPT_EPOCHS = 30, 18


@dataclass(frozen=True)
class Config:
    hidden: int = 16
    layers: int = 1
    head: int = 16
    learning_rate: float = 0.01
    epochs: int = 40
    batch: int = 64
    decay: float = 1e-4
    beta: float = 0.02
    clip: float = 1.0
    plateau: int = 4
    patience: int = 8
    seed: int = 11


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softplus(x):
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)


def _gelu(x):
    """Value and slope, by the usual tanh form."""
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * c * (1 + 0.134145 * x**2)


class Forecaster:
    """LSTM layers, then layer norm, a linear layer with GELU, and one to close and volatility (softplus)."""

    def __init__(self, config: Config, weights: dict[str, np.ndarray] | None = None):
        self.config = config
        if weights is not None:
            self.w = {k: v.copy() for k, v in weights.items()}
            return
        rng, h = np.random.default_rng(config.seed), config.hidden
        draw = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
        self.w = {"scale": np.ones(h), "shift": np.zeros(h), "head": draw(h, h, config.head), "head_bias": draw(h, config.head), "out": draw(config.head, config.head, 2), "out_bias": draw(config.head, 2)}
        for k in range(config.layers):
            d = h if k else INPUTS
            self.w |= {f"in_{k}": draw(h, d, 4 * h), f"back_{k}": draw(h, h, 4 * h), f"bias_{k}": draw(h, 4 * h)}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list, tuple]:
        w, h, layers, out = self.w, self.config.hidden, [], x
        for k in range(self.config.layers):
            hs = np.zeros((x.shape[1] + 1, len(x), h))
            cs, gates = hs.copy(), []
            for t in range(x.shape[1]):
                z = out[:, t] @ w[f"in_{k}"] + hs[t] @ w[f"back_{k}"] + w[f"bias_{k}"]
                i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
                cs[t + 1] = f * cs[t] + i * g
                hs[t + 1] = o * np.tanh(cs[t + 1])
                gates.append((i, f, o, g))
            layers.append((out, hs, cs, gates))
            out = hs[1:].transpose(1, 0, 2)
        last = out[:, -1]
        std = np.sqrt(last.var(axis=1, keepdims=True) + 1e-5)
        unit = (last - last.mean(axis=1, keepdims=True)) / std
        act, slope = _gelu((unit * w["scale"] + w["shift"]) @ w["head"] + w["head_bias"])
        return act @ w["out"] + w["out_bias"], layers, (unit, std, act, slope)

    def predict(self, x: np.ndarray) -> np.ndarray:
        y = self._forward(x)[0]
        return np.stack([y[:, 0], _softplus(y[:, 1])], axis=1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean smooth-L1 loss, by back-propagation through time."""
        w, h = self.w, self.config.hidden
        raw, layers, (unit, std, act, slope) = self._forward(x)
        d = np.clip((np.stack([raw[:, 0], _softplus(raw[:, 1])], axis=1) - y) / self.config.beta, -1, 1) / y.size
        d[:, 1] *= _sigmoid(raw[:, 1])
        g = {"out": act.T @ d, "out_bias": d.sum(axis=0)}
        d = (d @ w["out"].T) * slope
        g |= {"head": (unit * w["scale"] + w["shift"]).T @ d, "head_bias": d.sum(axis=0)}
        d = d @ w["head"].T
        g |= {"scale": (d * unit).sum(axis=0), "shift": d.sum(axis=0)}
        d = d * w["scale"]
        d = (d - d.mean(axis=1, keepdims=True) - unit * (d * unit).mean(axis=1, keepdims=True)) / std
        above = np.zeros((x.shape[1], len(x), h))  # what each step's output is told from above
        above[-1] = d
        for k in reversed(range(self.config.layers)):
            inputs, hs, cs, gates = layers[k]
            g |= {f"in_{k}": np.zeros_like(w[f"in_{k}"]), f"back_{k}": np.zeros_like(w[f"back_{k}"]), f"bias_{k}": np.zeros_like(w[f"bias_{k}"])}
            below, dh, dc = np.zeros((x.shape[1], len(x), inputs.shape[2])), np.zeros((len(x), h)), np.zeros((len(x), h))
            for t in reversed(range(x.shape[1])):
                i, f, o, c = gates[t]
                dh = dh + above[t]
                tc = np.tanh(cs[t + 1])
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * c * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c**2)], axis=1)
                g[f"in_{k}"] += inputs[:, t].T @ dz
                g[f"back_{k}"] += hs[t].T @ dz
                g[f"bias_{k}"] += dz.sum(axis=0)
                below[t], dh, dc = dz @ w[f"in_{k}"].T, dz @ w[f"back_{k}"].T, dc * f
            above = below
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, share: float = 0.2) -> dict:
        """AdamW with clipped gradients, a rate that halves on a plateau, and early stopping; the best weights on the last windows stay."""
        held = max(1, int(len(x) * share)) if len(x) > 1 else 0
        train, val = (slice(0, len(x) - held), slice(len(x) - held, None)) if held else (slice(None), slice(None))
        c, rng, rate, step = self.config, np.random.default_rng(self.config.seed), self.config.learning_rate, 0
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        best, kept, waited, best_epoch, epoch = np.inf, self.w, 0, 0, 0
        tx, ty = x[train], y[train]
        for epoch in range(1, c.epochs + 1):
            order = rng.permutation(len(tx))
            for at in range(0, len(order), c.batch):
                g = self.gradient(tx[order[at : at + c.batch]], ty[order[at : at + c.batch]])
                shrink = min(1.0, c.clip / (np.sqrt(sum(float((p**2).sum()) for p in g.values())) + 1e-6))
                step += 1
                for k, p in self.w.items():
                    m[k] = 0.9 * m[k] + 0.1 * shrink * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * (shrink * g[k]) ** 2
                    self.w[k] = p - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + c.decay * p)
            loss = self.loss(x[val], y[val])
            if loss < best - 1e-6:
                best, kept, waited, best_epoch = loss, {k: p.copy() for k, p in self.w.items()}, 0, epoch
                continue
            waited += 1
            if waited % c.plateau == 0:
                rate /= 2
            if waited >= c.patience:
                break
        self.w = {k: p.copy() for k, p in kept.items()}
        return self.metrics(x[val], y[val]) | {"epochs": epoch, "best_epoch": best_epoch}

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        d, b = np.abs(self.predict(x) - y), self.config.beta
        return float(np.where(d < b, d * d / (2 * b), d - b / 2).mean())

    def metrics(self, x: np.ndarray, y: np.ndarray) -> dict:
        e = (self.predict(x) - y) ** 2
        return {"loss": self.loss(x, y), "close_rmse": float(np.sqrt(e[:, 0].mean())), "vol_rmse": float(np.sqrt(e[:, 1].mean())), "combined_rmse": float(np.sqrt(e.mean()))}

    def one_step(self, last: np.ndarray) -> tuple[float, float]:
        close, vol = self.predict(last[None])[0]
        return float(close) * CLOSE_SCALE, float(vol)

    def roll(self, last: np.ndarray, steps: int) -> np.ndarray:
        """Predicts, appends and slides; the sentiment is carried forward."""
        window, out = last.copy(), []
        for _ in range(steps):
            close, vol = self.predict(window[None])[0]
            before = window[-1]
            change = np.clip((close - before[1]) / before[1] if abs(before[1]) > 1e-12 else 0.0, -1, 1)
            window = np.concatenate([window[1:], [[before[0], close, vol, change, np.clip(vol - before[2], -1, 1)]]])
            out.append((close * CLOSE_SCALE, vol))
        return np.array(out)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, config: str, weights: bytes) -> Forecaster:
        with np.load(io.BytesIO(weights)) as held:
            return cls(Config(**json.loads(config)), {k: held[k] for k in held.files})


_COLUMNS = ["sentiment_score", "market_close", "market_volatility", "close_change_pct", "volatility_change"]
MODELS = "symbol string, config string, weights binary, close_scale double, sequence int, loss double, close_rmse double, vol_rmse double, combined_rmse double, epochs int, best_epoch int"
_METRICS = ("loss", "close_rmse", "vol_rmse", "combined_rmse", "epochs", "best_epoch")


def _windows(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, and the last window, its first row repeated in front of fewer rows; without rows it is all zero."""
    rows = group.sort_values("date")[_COLUMNS].to_numpy(dtype=float)
    if not len(rows):
        return np.empty((0, SEQUENCE, INPUTS)), np.empty((0, 2)), np.zeros((SEQUENCE, INPUTS))
    if len(rows) <= SEQUENCE:
        pad = np.concatenate([np.repeat(rows[:1], SEQUENCE - len(rows), axis=0), rows]) if len(rows) < SEQUENCE else rows
        return np.empty((0, SEQUENCE, INPUTS)), np.empty((0, 2)), pad
    x = np.lib.stride_tricks.sliding_window_view(rows, SEQUENCE, axis=0)[:-1].transpose(0, 2, 1)
    return x, rows[SEQUENCE:, 1:3], rows[-SEQUENCE:]


def train(scaled: DataFrame, config: Config | None = None) -> DataFrame:
    """MODELS, a model for each symbol with its weights, configuration and validation metrics, which are null without a window."""
    config = config or Config()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = _windows(group)
        model = Forecaster(config)
        got = model.fit(x, y) if len(x) else {}
        return pd.DataFrame([{"symbol": group["symbol"].iloc[0], "config": json.dumps(asdict(config)), "weights": model.to_bytes(), "close_scale": CLOSE_SCALE, "sequence": SEQUENCE} | {k: got.get(k) for k in _METRICS}])

    return scaled.groupBy("symbol").applyInPandas(run, MODELS)


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(scaled: DataFrame, path: str) -> DataFrame:
    """MODELS of a folder."""
    return scaled.sparkSession.read.schema(MODELS).parquet(path)


def forecast(scaled: DataFrame, models: DataFrame, steps: int, adapt: bool = False) -> DataFrame:
    """(symbol, step, close, volatility, adapted_epochs): each symbol's model rolled forward.

    With adapt a copy of the model first learns from the symbol's own rows for ADAPT_EPOCHS epochs; it is not kept.
    """

    def run(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if group.empty or own.empty:
            return pd.DataFrame({"symbol": [], "step": [], "close": [], "volatility": [], "adapted_epochs": []})
        x, y, last = _windows(group)
        model, learned = Forecaster.from_bytes(own["config"].iloc[0], own["weights"].iloc[0]), None
        if adapt and len(x):
            model.config = replace(model.config, epochs=ADAPT_EPOCHS, learning_rate=5e-4, patience=4)
            learned = model.fit(x, y, share=0.25)["epochs"]
        ahead = model.roll(last, steps)
        return pd.DataFrame({"symbol": group["symbol"].iloc[0], "step": np.arange(1, steps + 1, dtype=np.int32), "close": ahead[:, 0], "volatility": ahead[:, 1], "adapted_epochs": pd.array([learned] * steps, dtype="Int32")})

    return scaled.groupBy("symbol").cogroup(models.groupBy("symbol")).applyInPandas(run, "symbol string, step int, close double, volatility double, adapted_epochs int")


def assembled(vector: DataFrame, banded: DataFrame, scale: DataFrame) -> DataFrame:
    """(symbol, history, forecast, suggested_ymin, suggested_ymax): the last HISTORY points and the banded steps as arrays."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    history = vector.withColumn("back", last).where(F.col("back") <= HISTORY).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "market_close", "market_volatility"))).alias("history"))
    rest = [c for c in banded.columns if c not in ("symbol", "step")]
    ahead = banded.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("step", *rest))).alias("forecast"))
    return history.join(ahead, "symbol").join(scale, "symbol", "left")


def sweep(scaled: DataFrame, grid: DataFrame, base: Config | None = None) -> DataFrame:
    """(symbol, trial, hidden, learning_rate, metrics...): a task for each symbol and trial; grid is a short list."""
    base = base or Config()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        x, y, _ = _windows(group)
        config = replace(base, hidden=int(first["hidden"]), learning_rate=float(first["learning_rate"]))
        got = Forecaster(config).fit(x, y) if len(x) else {}
        return pd.DataFrame([{"symbol": first["symbol"], "trial": int(first["trial"]), "hidden": config.hidden, "learning_rate": config.learning_rate} | {k: got.get(k) for k in _METRICS[:4]}])

    return scaled.crossJoin(grid).groupBy("symbol", "trial").applyInPandas(run, "symbol string, trial int, hidden int, learning_rate double, loss double, close_rmse double, vol_rmse double, combined_rmse double")


def train_best(scaled: DataFrame, trials: DataFrame, base: Config | None = None) -> DataFrame:
    """MODELS trained anew by the trial that is best by its mean metrics over symbols; trials without metrics don't count."""
    means = trials.groupBy("trial", "hidden", "learning_rate").agg(F.avg("combined_rmse").alias("combined_rmse"), F.avg("loss").alias("loss"))
    best = best_trial(means).first()
    if best is None or best["trial"] is None:
        raise ValueError("no trial has metrics")
    return train(scaled, replace(base or Config(), hidden=best["hidden"], learning_rate=best["learning_rate"]))
