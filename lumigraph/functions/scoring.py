"""Running a scorer over rows: a model is made once per Python worker, rows go through in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Scorers by name; each is a function without arguments that gives a function from a list of inputs to scores.
SCORERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_scorer(name: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    SCORERS[name] = make


def _hash_scorer() -> Callable[[list[str]], np.ndarray]:
    """A stand-in without a model: a number in [0, 1) from the input's MD5."""
    import hashlib

    return lambda xs: np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32 for x in xs])


register_scorer("hash", _hash_scorer)


def score(df: DataFrame, input_col: str, scorer: str = "hash", threshold: float = 0.6, names: tuple[str, str] = ("real", "ai")) -> DataFrame:
    """df with score, predicted_label, its name, threshold and error; a failing input has an error and no score."""
    make = SCORERS[scorer]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        model = make()
        for b in batches:
            xs = b[input_col].tolist()
            try:
                s, err = np.asarray(model(xs), float), [None] * len(xs)
            except Exception:
                s, err = np.full(len(xs), np.nan), [None] * len(xs)
                for i, x in enumerate(xs):
                    try:
                        s[i] = float(np.asarray(model([x]))[0])
                    except Exception as e:  # one bad input must not end the batch
                        err[i] = f"{type(e).__name__}: {e}"
            label = (s >= threshold).astype(int)
            ok = pd.Series([e is None for e in err])
            yield b.reset_index(drop=True).assign(
                score=pd.Series(s).where(ok), predicted_label=pd.Series(label).where(ok).astype("Int64"), predicted_label_name=pd.Series([names[i] for i in label]).where(ok, None), threshold=threshold, error=err
            )

    return df.mapInPandas(run, f"{fields}, score double, predicted_label int, predicted_label_name string, threshold double, error string")
