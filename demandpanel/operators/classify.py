"""Text classifiers as Column functions whose model is opened once a task."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F


class LinearModel:
    """Labels scored by a bias and a weight for every part of a word that a text holds; the first of equal scores wins.

    The file is JSON: ``labels``, ``bias`` (a number a label) and ``weights`` (part of a word → a number a label).
    """

    def __init__(self, content: bytes):
        model = json.loads(content)
        self.labels = model["labels"]
        self.bias = np.array(model["bias"], float)
        self.parts = [(part, np.array(weights, float)) for part, weights in model["weights"].items()]

    def label(self, text: str) -> str:
        score = self.bias.copy()
        for part, weights in self.parts:
            if part in text:
                score += weights
        return self.labels[int(score.argmax())]


def from_file(spark: SparkSession, path: str, model: Callable[[bytes], LinearModel] = LinearModel,
              on_open: Callable[[], None] | None = None) -> Callable[[Column], Column]:
    """A Column function that labels texts with the model kept at ``path``.

    The file's bytes travel once to each executor; ``model`` opens them at the start of a
    task and serves all its Arrow batches. NULL texts get no label. ``on_open`` is told of
    every opening.
    """
    shared = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))

    @F.pandas_udf("string")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        opened = model(shared.value)
        if on_open:
            on_open()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else opened.label(t))

    return classify
