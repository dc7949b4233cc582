"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled texts, one of good and one of bad ones.
A text is cut into pieces of ``PIECE`` bytes, so that a dictionary matters as much at the
end of a long text as at its start, and every piece is compressed with either. The
difference of the two sizes over their sum is all that the score knows of a text; logistic
calibration on labelled texts that built no dictionary makes it a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import runs

#: Labelled rows drawn of each class; half build the dictionaries, half calibrate.
ROWS_PER_CLASS = 3000
PIECE = 256
DICT_BYTES = 1 << 15
#: Where a class has fewer pieces they are repeated up to this number: the trainer needs some.
LEAST_PIECES = 1000
LEVEL = 3
CUT = 0.7
STEPS = 100


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: float = 0.0
    scale: float = 1.0
    weight: tuple[float, float] = (0.0, 0.0)  # intercept and slope

    def coders(self) -> list[zstandard.ZstdCompressor]:
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        out = []
        for d in (self.good, self.bad):
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT)
            z.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=z, compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **plain)))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.weight[0] + self.weight[1] * (x - self.centre) / self.scale)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def difference(text: bytes, coders: list[zstandard.ZstdCompressor]) -> float:
    """How much larger the text gets under the bad dictionary than under the good one, over the sum of both sizes; 0 for an empty text."""
    good = bad = 0
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        good += len(coders[0].compress(piece))
        bad += len(coders[1].compress(piece))
    return (bad - good) / max(bad + good, 1)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the pieces of ``texts``."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)] or [b" "]
    return zstandard.train_dictionary(DICT_BYTES, pieces * -(-LEAST_PIECES // len(pieces))).as_bytes()


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic curve: Newton steps, each halved until the penalised likelihood grows.

    Raises where that doesn't come to rest.
    """
    x = np.stack([np.ones(len(x)), x], 1)
    penalty = ridge * len(x)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (w @ w))

    w = np.zeros(2)
    for _ in range(STEPS):
        p = logistic(x @ w)
        slope = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(2), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() <= 1e-8:
            return float(w[0]), float(w[1])
    raise ArithmeticError("the calibration doesn't converge")


def train(rows: list[tuple[str, int]], prior: float | None = None) -> Model | None:
    """From (text, label) rows. prior: the share of label 1 that the scores are calibrated to."""
    sides: list[list[bytes]] = [[], []]
    for t, y in rows:
        sides[y].append(t.encode())
    if min(map(len, sides)) < 2:
        return None
    model = Model(dictionary(sides[1][::2]), dictionary(sides[0][::2]))
    coders = model.coders()
    rest = [(t, y) for y in (0, 1) for t in sides[y][1::2]]
    x, y = np.array([difference(t, coders) for t, _ in rest]), np.array([y for _, y in rest], float)
    model.centre, model.scale = float(x.mean()), float(x.std()) or 1.0
    model.weight = calibrate((x - model.centre) / model.scale, y)
    if prior is not None and 0 < prior < 1:
        share = y.mean()
        model.weight = (model.weight[0] + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share))), model.weight[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, seen, per_class: int = ROWS_PER_CLASS) -> Model | None:
    rows = cluster.labelled_sample(docs, labels, "quality", per_class, seen)
    share = labels.where(seen & F.col("quality").isin(0, 1)).agg(F.avg("quality").alias("p")).first()["p"]
    return train(rows, share)


def classify(docs: DataFrame, model: Model | None, keep: list[str], cut: float = CUT) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, predicted and the size difference.

    Null texts score as empty ones, whose difference is 0; without labels of both kinds all
    score 0.5. Long texts are compressed whole, piece by piece; repeated rows score alike.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer").add("size_difference", "double")

    def score(batches):
        coders = shipped.value.coders() if shipped.value else None
        for batch in batches:
            out = [np.zeros(0)]
            for run in runs(batch.column("_text")):
                out.append(np.array([difference(run.text(i), coders) for i in range(len(run))]) if coders else np.zeros(len(run)))
            x = np.concatenate(out)
            s = shipped.value.score(x) if coders else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(x)], names=[*keep, "score", "predicted", "size_difference"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(cluster.frugal(score), schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    held = cluster.fold("doc_id", 4, 2)
    model = fit(docs, cluster.table(spark, sf_dir, "labels"), ~held)
    return classify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
