"""The predictor as a function of DataFrames: protein sequences in, probability matrices out.

Model weights are outside this repository. A caller passes a `load` function
that runs once per Python worker and returns a batch predictor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrix import consensus_from_information, probability_to_information

BatchPredictor = Callable[[list[str]], np.ndarray]


def predict_matrices(proteins: DataFrame, load: Callable[[], BatchPredictor], *, sequence: str = "sequence") -> DataFrame:
    """Distinct sequences with their 10x4 probability matrix; the model is loaded once per worker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for batch in batches:
            predict = predict or load()
            values = predict(batch[sequence].tolist())
            yield pd.DataFrame({sequence: batch[sequence], "matrix": [m.astype("float64").tolist() for m in values]})

    return proteins.select(sequence).distinct().mapInPandas(run, f"{sequence} string, matrix array<array<double>>")


def model_side(model: str) -> str:
    """Side of the target a model's window lies on."""
    return "downstream" if model.lower().startswith("cas9") else "upstream"


def predictions(proteins: DataFrame, load: Callable[[], BatchPredictor], model: str) -> DataFrame:
    """Matrix, information content and consensus of every distinct protein."""
    rows = predict_matrices(proteins, load).withColumn("information", probability_to_information("matrix"))
    side = model_side(model)
    return rows.withColumn("consensus", consensus_from_information("information", side)).withColumn("pam_side", F.lit(side))
