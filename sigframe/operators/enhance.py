"""The seam for external enhancement engines: a plain function called on small batches inside Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = list[tuple[str, int, np.ndarray]]


@dataclass(frozen=True)
class Enhancer:
    """`run` takes up to `max_batch` items (stem, rate, samples) and returns the outputs by stem. Items shorter than
    `min_seconds` are padded with silence first and the output is cut back to their share."""

    name: str
    cache_id: str
    run: Callable[[Batch], dict[str, np.ndarray]]
    output_rate: int = 48000
    max_batch: int = 5
    min_seconds: float = 0.0


OUTPUT = "stem string, engine string, cache_id string, rate int, xs array<double>, error string"


def enhance(items: DataFrame, engine: Enhancer) -> DataFrame:
    """Run an engine over `stem, rate, xs`. Items at or above the output rate are left out. A batch that fails is
    retried item by item, so that one bad item only spoils itself; failures and missing outputs become rows with
    `error`."""

    def call(batch: Batch) -> list[tuple[str, np.ndarray | None, str | None]]:
        def padded(rate: int, x: np.ndarray) -> np.ndarray:
            need = int(np.ceil(engine.min_seconds * rate))
            return np.pad(x, (0, max(need - len(x), 0)))

        try:
            got = engine.run([(s, r, padded(r, x)) for s, r, x in batch])
        except Exception as e:  # noqa: BLE001  an engine may fail in any way
            if len(batch) > 1:
                return [row for one in batch for row in call([one])]
            return [(batch[0][0], None, f"{type(e).__name__}: {e}")]
        rows = []
        for stem, rate, x in batch:
            y = got.get(stem)
            if y is None:
                rows.append((stem, None, f"no output for {stem}"))
            else:
                rows.append((stem, np.asarray(y, dtype=float)[: round(len(x) * engine.output_rate / rate)], None))
        return rows

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            todo = list(zip(pdf["stem"], pdf["rate"].astype(int), (np.asarray(x, dtype=float) for x in pdf["xs"])))
            rows = [r for i in range(0, len(todo), engine.max_batch) for r in call(todo[i : i + engine.max_batch])]
            out = pd.DataFrame(rows, columns=["stem", "xs", "error"])
            yield out.assign(engine=engine.name, cache_id=engine.cache_id, rate=engine.output_rate)[
                ["stem", "engine", "cache_id", "rate", "xs", "error"]
            ]

    return items.filter(F.col("rate") < engine.output_rate).select("stem", "rate", "xs").mapInPandas(work, OUTPUT)
