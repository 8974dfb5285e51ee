"""Models: an ONNX session, loaded once a worker, over batches of feature arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def load_model(path: str, returns: str = "array<float>", output: int = 0) -> Callable[[Column], Column]:
    """predict(features) for a model file that every executor can read, or that came by SparkContext.addFile."""

    @F.pandas_udf(returns)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        session = onnxruntime.InferenceSession(path, options)
        name = session.get_inputs()[0].name
        for x in batches:
            made = session.run(None, {name: np.stack([np.asarray(v, np.float32) for v in x])})[output]
            yield pd.Series(list(made) if returns.startswith("array") else made.reshape(-1))

    return predict


class Model:
    """A model whose `predict` a program may call."""

    def __init__(self, path: str, returns: str = "array<float>", output: int = 0):
        self.predict = load_model(path, returns, output)
