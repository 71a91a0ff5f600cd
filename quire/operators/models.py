"""Batch stages around models the user passes in: embedding, generation and judging."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.core import clamp, pin
from quire.functions.text import json_block
from quire.operators.evaluation import SCORES, verdict
from quire.session import ship_by_value

ship_by_value(__name__)


def call_model(
    df: DataFrame,
    prompt: str,
    out: str,
    make: Callable[[], Callable[[list[str]], list[str]]],
    tries: int = 3,
    base_delay: float = 1.0,
    deadline: float = 120.0,
) -> DataFrame:
    """Add the model's answer to every prompt, with ``<out>_error`` and ``<out>_ms``.

    ``make`` builds the model once per task. A failing batch is tried again with growing, jittered pauses until the
    deadline; what still fails gets an error and a null answer, and the job goes on.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType()), T.StructField(f"{out}_ms", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            start, answers, error = time.monotonic(), [None] * len(rows), None
            for attempt in range(tries):
                try:
                    answers, error = model(list(rows[prompt])), None
                    break
                except Exception as exc:
                    error = f"{type(exc).__name__}: {exc}"
                    pause = base_delay * 2**attempt * random.uniform(0.5, 1.5)
                    if attempt + 1 == tries or time.monotonic() - start + pause > deadline:
                        break
                    time.sleep(pause)
            took = (time.monotonic() - start) * 1000 / max(len(rows), 1)
            yield rows.assign(**{out: answers, f"{out}_error": error, f"{out}_ms": took})

    return df.mapInPandas(run, schema)


def embed(
    df: DataFrame, text: str, out: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch_size: int = 64
) -> DataFrame:
    """Add the unit vector of every text as ``out`` and ``<out>_error``; no row is lost.

    ``make`` builds the model once per worker; it gets up to ``batch_size`` texts. A batch that fails is halved until the
    rows that cause it stand alone, so the others keep their vectors. A null text has the error ``no text`` and is not sent
    to the model; a vector of zeros stays as it is; a vector that is not finite is an error.
    """

    def load():
        model = make()

        def ask(texts, places, vectors, errors):
            try:
                found = np.asarray(model([texts[i] for i in places]), dtype="float64")
                if found.shape != (len(places), dim):
                    raise ValueError(f"shape {found.shape}, not {(len(places), dim)}")
                if not np.isfinite(found).all():
                    raise ValueError("not finite")
            except Exception as exc:
                if len(places) == 1:
                    errors[places[0]] = f"{type(exc).__name__}: {exc}"
                else:
                    half = len(places) // 2
                    ask(texts, places[:half], vectors, errors)
                    ask(texts, places[half:], vectors, errors)
                return
            norms = np.sqrt((found * found).sum(axis=1, keepdims=True))
            vectors[places] = found / np.where(norms == 0, 1.0, norms)

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            vectors, errors = np.zeros((len(texts), dim)), np.full(len(texts), None, dtype=object)
            places = [i for i, t in enumerate(texts) if t is not None]
            if places:
                ask(texts, places, vectors, errors)
            return {"vector": vectors, "error": errors}

        return predict

    shape = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    rows = df.withColumn("_e", predict_batch_udf(load, return_type=shape, batch_size=batch_size)(F.col(text)))
    error = F.when(F.col(text).isNull(), "no text").otherwise(F.col("_e.error"))
    return rows.withColumn(out, F.when(error.isNull(), F.col("_e.vector"))).withColumn(f"{out}_error", error).drop("_e")


def score(reply: Column, name: str) -> Column:
    """A score of a judge's reply between 0 and 1; null when it is missing or no number."""
    return clamp(F.get_json_object(reply, f"$.{name}").try_cast("double"), 0.0, 1.0)


def judged(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Parse replies into the five scores, a parse error and a verdict."""
    rows = pin(df, "_json", json_block(F.col(reply)))
    for name in SCORES:
        rows = rows.withColumn(
            name, F.when(F.get_json_object("_json", f"$.{name}").try_cast("double").isNotNull(), score(F.col("_json"), name))
        )
    rows = rows.withColumn("judge_error", F.when(F.col("_json").isNull(), F.lit("no json")))
    return rows.withColumn(
        "verdict", F.when(F.col("judge_error").isNotNull(), F.lit("error")).otherwise(verdict(F.array(*SCORES)))
    ).drop("_json")
