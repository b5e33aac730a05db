"""Sequence learners behind the learners' interface: windows of rows made by Spark, networks learned in the tasks that hold them.

``recurrent`` predicts a row from the feature rows before it; ``attentive`` predicts a stretch of rows from a longer stretch before it and the features known for
the stretch itself. Features and target are scaled by the training rows; the last tenth of the training rows in time decides when to stop. Windows go to the
tasks once; only gradients are exchanged, and the driver holds the parameters (see ``gather``).

Without ``keys`` a series is cut into years, each its own window partition. Rows without a full window have no prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import encoder_windows, sequence_windows
from .checkpoint import cut
from .gather import Sum, drive, in_tasks, spread
from .networks import Attention, BiLstm, Network, Tape, Training, Var, learn, packed, predict, unpacked


def _scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    from .ml import population_scaler

    return {c: (m or 0.0, s) for c, (m, s) in population_scaler(df, columns).items()}


def _flat(column: str) -> F.Column:
    return F.transform(F.flatten(column), lambda x: x.cast("float")).alias(column)


class Sequenced:
    """A learned network with its scales and windows."""

    def __init__(self, net: Network, params: dict, features: list[str], target: str, scale: dict, keys: tuple[str, ...], ts: str, back: int, ahead: int):
        self.net, self.params, self.features, self.target, self.scale, self.keys, self.ts, self.back, self.ahead = net, params, features, target, scale, keys, ts, back, ahead

    def windows(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows that have windows, with the window columns ``_past`` (and ``_known``) as flat arrays, and the scaled target ``_s``; names of the window columns."""
        series = list(self.keys) or ["_year"]
        rows = df if self.keys else df.withColumn("_year", F.year(self.ts))
        scaled = lambda c: (F.col(c).cast("double") - self.scale[c][0]) / self.scale[c][1]
        own = {f"_f_{c}": scaled(c) for c in self.features} | {"_s": scaled(self.target)}
        rows = rows.withColumns(own)
        known = [f"_f_{c}" for c in self.features]
        if self.ahead:
            out = encoder_windows(rows, series, self.ts, [*known, "_s"], known, self.back, self.ahead, "_past", "_known", "_s", "_goal")
            return out.withColumns({c: _flat(c) for c in ("_past", "_known")}).drop(*known, *([] if self.keys else ["_year"])), ["_past", "_known"]
        out = sequence_windows(rows, series, self.ts, known, self.back, name="_past")
        return out.withColumn("_past", _flat("_past")).drop(*known, *([] if self.keys else ["_year"])), ["_past"]

    def arrays(self, columns: list) -> list[np.ndarray]:
        """Window columns (arrays of flat rows) as (rows, steps, features)."""
        width = len(self.features)
        shapes = [(self.back, width + (1 if self.ahead else 0)), (self.ahead, width)]
        return [np.asarray(c, np.float32).reshape(-1, *shapes[i]) for i, c in enumerate(columns)]

    def _frame(self, frame: pd.DataFrame) -> list[np.ndarray]:
        return self.arrays([np.concatenate(frame[c].to_numpy()) if len(frame) else np.zeros(0) for c in frame.columns])

    def steps(self, df: DataFrame) -> DataFrame:
        """The rows that have windows, with ``_out``: the predictions of all steps."""
        model, (mean, dev) = self, self.scale[self.target]
        rows, names = self.windows(df)

        @F.pandas_udf("array<double>")
        def predicted(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(list(predict(model.net, model.params, model._frame(frame)).astype(float) * dev + mean))

        return rows.filter(F.forall("_past", lambda x: x.isNotNull())).withColumn("_out", predicted(F.struct(*names))).drop(*names, "_s", "_goal")

    def __call__(self, df: DataFrame) -> DataFrame:
        """Rows with ``pred``; of the steps of a stretch the last, which is the row that ends it."""
        return self.steps(df).withColumn("pred", F.element_at("_out", -1)).drop("_out")

    def horizons(self, df: DataFrame) -> DataFrame:
        """(keys, ts of the stretch's last row, step from 1, pred): every step of every stretch."""
        return self.steps(df).select(*self.keys, self.ts, F.posexplode("_out").alias("step", "pred")).withColumn("step", F.col("step") + 1)

    def weights(self, df: DataFrame) -> DataFrame:
        """(keys, ts, kind, name, weight) of each stretch: attention by lag from the row that ends it, and the mean weight of each past and known variable."""
        model = self
        rows, names = self.windows(df)
        past, known, span = [*self.features, self.target], self.features, self.back + self.ahead

        @F.pandas_udf("array<double>")
        def looked(frame: pd.DataFrame) -> pd.Series:
            made = model.net.explain(Tape(), {k: Var(v) for k, v in model.params.items()}, model._frame(frame))
            return pd.Series(list(np.concatenate([made[1].v[:, -1, ::-1], made[2].v.mean(1), made[3].v.mean(1)], 1).astype(float)))

        label = [("lag", str(i)) for i in range(span)] + [("past", c) for c in past] + [("known", c) for c in known]
        labels = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in label])
        found = rows.withColumn("_w", F.arrays_zip(labels.alias("l"), looked(F.struct(*names)).alias("w")))
        return found.select(*self.keys, self.ts, F.explode("_w").alias("_w")).select(*self.keys, self.ts, F.col("_w.l.kind"), F.col("_w.l.name"), F.col("_w.w").alias("weight"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        scale = {c: [float(m), float(s)] for c, (m, s) in self.scale.items()}
        row = (type(self.net).__name__, {k: float(v) for k, v in vars(self.net).items()}, bytearray(packed(self.params)), self.features, self.target, scale, list(self.keys), self.ts, self.back, self.ahead)
        spark.createDataFrame([row], "net string, sizes map<string, double>, params binary, features array<string>, target string, scale map<string, array<double>>, keys array<string>, ts string, back int, ahead int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> Sequenced:
        r = SparkSession.active().read.parquet(path).first()
        kind = {"BiLstm": BiLstm, "Attention": Attention}[r["net"]]
        net = kind(**{k: v if k == "dropout" else int(v) for k, v in r["sizes"].items()})
        return Sequenced(net, unpacked(bytes(r["params"])), list(r["features"]), r["target"], {c: tuple(v) for c, v in r["scale"].items()}, tuple(r["keys"]), r["ts"], r["back"], r["ahead"])


def _fit(model: Sequenced, train: DataFrame, how: Training, per_task: int, per_round: int) -> Sequenced:
    """Learns ``model.params`` from the windows of the training rows, a stage for every ``per_round`` epochs."""
    rows, names = model.windows(train)
    goal = F.transform("_goal", lambda x: x.cast("float")) if model.ahead else F.array(F.col("_s").cast("float"))
    at = F.unix_micros(F.col(model.ts).cast("timestamp"))
    held = rows.select(*names, goal.alias("_y"), at.alias("_at"), F.xxhash64(*names).alias("_key"))
    whole = F.forall("_y", lambda x: x.isNotNull() & ~F.isnan(x))
    for c in names:
        whole = whole & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    held = cut(held.filter(whole))
    last = held.agg(F.percentile_approx("_at", 0.9, 10_000)).first()[0]
    dealt, parts = spread(held, per_task)
    state, ended = None, 0

    for upto in [*range(per_round, how.epochs, per_round), how.epochs]:

        def work(tab: pa.Table, summed: Sum, task: int, upto=upto, state=state) -> bytes | None:
            tab = tab.sort_by([("_at", "ascending"), ("_key", "ascending")])
            flat = lambda c: tab[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x, y, late = model.arrays([flat(c) for c in names]), flat("_y").reshape(len(tab), -1), tab["_at"].to_numpy() > (last or 0)
            pick = lambda which: ([a[which] for a in x], y[which])
            made = drive([learn(model.net, how, pick(~late), pick(late), task, parts, state, upto)], summed, parts == 1)
            return made[0] if task == 0 else None

        state = in_tasks(dealt, parts, work)
        got = unpacked(state)
        if got["at"][0] < upto or got["at"][0] == ended:
            break
        ended = got["at"][0]
    model.params = {k[5:]: v for k, v in unpacked(state).items() if k.startswith("best.")}
    return model


def recurrent(steps: int = 24, hidden: int = 64, dropout: float = 0.2, how: Training = Training(), keys: tuple[str, ...] = (), ts: str = "ts", per_task: int = 200_000, per_round: int = 5):
    """A two-layer bidirectional LSTM over the ``steps`` feature rows before each row."""

    def fit(train: DataFrame, features: list[str], target: str) -> Sequenced:
        train = train.dropna(subset=[target])
        model = Sequenced(BiLstm(len(features), hidden, dropout), {}, list(features), target, _scale(train, [*features, target]), keys, ts, steps, 0)
        return _fit(model, train, how, per_task, per_round)

    return fit


def attentive(back: int = 72, ahead: int = 24, hidden: int = 32, heads: int = 4, dropout: float = 0.1, how: Training = Training(rate=0.03, batch=128, least=1e-4, root=True), keys: tuple[str, ...] = (), ts: str = "ts", per_task: int = 50_000, per_round: int = 5):
    """An encoder-decoder with attention: ``ahead`` rows from ``back`` rows of features and target before them and their own features."""

    def fit(train: DataFrame, features: list[str], target: str) -> Sequenced:
        train = train.dropna(subset=[target])
        net = Attention(len(features) + 1, len(features), hidden, heads, dropout)
        return _fit(Sequenced(net, {}, list(features), target, _scale(train, [*features, target]), keys, ts, back, ahead), train, how, per_task, per_round)

    return fit

