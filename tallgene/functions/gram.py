"""Sums of products of vectors, added up by tasks; the result is dims x dims."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgene.functions.metric import matrix as _matrix


def covariance(emb) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (divided by n - 1) and number of the vectors that are not null. Tasks add up sums and products of their rows about the
    first mean seen; the driver gets the sums of all tasks, dims x dims numbers in rows."""
    rows = emb.where("vec IS NOT NULL").select("vec")
    first = rows.limit(1).collect()
    if not first:
        return np.zeros(0), np.zeros((0, 0)), 0
    origin = np.array(first[0]["vec"], float)

    def sums(parts):
        n, s, ss = 0, np.zeros(len(origin)), np.zeros((len(origin), len(origin)))
        for part in parts:
            for at in range(0, len(part), 4096):
                x = _matrix(part["vec"].iloc[at : at + 4096]) - origin
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"i": np.arange(-1, len(origin)), "n": n, "row": [s, *ss]})

    added = rows.mapInPandas(sums, "i int, n long, row array<double>").select("i", "n", F.posexplode("row").alias("j", "x"))
    table = added.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    dims, n = len(origin), int(table["n"].iloc[0])
    full = np.zeros((dims + 1, dims))
    full[table["i"].to_numpy() + 1, table["j"].to_numpy()] = table["x"]
    mean = full[0] / n
    return origin + mean, (full[1:] - n * np.outer(mean, mean)) / max(1, n - 1), n
