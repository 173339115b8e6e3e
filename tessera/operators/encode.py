"""Encoders that turn texts into activations(row_idx, side, pos, feature, act)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SPANS = (("P", "prompt"), ("C", "chosen"), ("R", "rejected"))


def hash_encode(examples: DataFrame, d: int = 512, most: int | None = 64, spans=SPANS) -> tuple[DataFrame, DataFrame]:
    """Activations and span lengths of a hashing encoder in built-ins: one feature a token, act 1 + letters / 10.

    Of each span the first `most` tokens count; None: all of them.
    """
    acts = lens = None
    for side, column in spans:
        tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
        t = examples.select("row_idx", F.lit(side).alias("side"), (tokens if most is None else F.slice(tokens, 1, most)).alias("t"))
        a = t.select("row_idx", "side", F.posexplode("t").alias("pos", "token")).select("row_idx", "side", "pos", (F.conv(F.left(F.md5("token"), F.lit(7)), 16, 10).cast("long") % d).cast("int").alias("feature"), (1 + F.length("token") / 10.0).alias("act"))
        n = t.select("row_idx", "side", F.size("t").alias("n_tokens"))
        acts, lens = (a, n) if acts is None else (acts.unionByName(a), lens.unionByName(n))
    return acts, lens


def topk_encode(vectors: DataFrame, w_enc: np.ndarray, b_enc: np.ndarray, b_dec: np.ndarray, k: int, key: str = "row_idx", column: str = "x") -> DataFrame:
    """key, feature, act: the k largest of relu((x - b_dec) W + b). Weights are broadcast once; batches go by Arrow."""
    shared = vectors.sparkSession.sparkContext.broadcast((w_enc.astype(np.float64), b_enc, b_dec))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, c = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.maximum((np.stack(pdf[column].to_numpy()) - c) @ w + b, 0)
            top = np.argsort(-a, axis=1, kind="stable")[:, :k]
            v = np.take_along_axis(a, top, axis=1)
            out = pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), top.shape[1]), "feature": top.ravel().astype("int32"), "act": v.ravel()})
            yield out[out["act"] > 0]

    return vectors.select(key, column).mapInPandas(run, f"{key} long, feature int, act double")
