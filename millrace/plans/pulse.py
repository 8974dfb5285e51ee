"""Pulse onsets in a sampled pressure signal, key by key.

The recurrences (a low-pass filter, then the sum of the last 32 rises) and the search for onsets refer to earlier
results, so each key is one ordered fold with NumPy; keys are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RISES, LEAST, SILENT, SHIFT = 32, 100.0, 75, 5


def preprocess(x: np.ndarray) -> np.ndarray:
    """y(n) = 2 y(n-1) - y(n-2) + x(n) - 2 x(n-5) + x(n-10); then the sum of max(0, y(n) - y(n-1)) over 32 places."""
    u = x.astype(float).copy()
    u[5:] -= 2 * x[:-5]
    u[10:] += x[:-10]
    y = np.cumsum(np.cumsum(u))
    rise = np.maximum(0, np.diff(y, prepend=y[:1]))
    total = np.concatenate([[0.0], np.cumsum(rise)])
    at = np.arange(len(x))
    return total[at + 1] - total[np.maximum(0, at + 1 - RISES)]


def onsets(pval: np.ndarray, threshold: float) -> list[int]:
    """Places of accepted onsets: the first of a run above the threshold whose largest value exceeds it by LEAST; after
    one, SILENT places are skipped."""
    above, out, n, i = pval > threshold, [], len(pval), 0
    while i < n:
        if not above[i]:
            i += 1
            continue
        j = i
        while j < n and not pval[j] < threshold:
            j += 1
        if pval[i:j].max() - pval[i] > LEAST:
            out.append(i)
            j = max(j, i) + SILENT
        i = j
    return out


def detect(samples: DataFrame, keys: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """keys and `onset`: the order value of each onset, less the filter's shift of SHIFT samples."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*[samples.schema[k] for k in keys], StructField("onset", LongType())])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        at = onsets(preprocess(pdf[value].to_numpy()), threshold)
        ts = pdf[order].to_numpy()
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(at) for k in keys} | {"onset": [int(ts[i]) - SHIFT for i in at]})
        return out[[*keys, "onset"]]

    return samples.groupBy(*keys).applyInPandas(find, schema)
