"""Calls to an injected text client from a column."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import require_columns

# Replies that are worth another try.
RETRY_STATUS = (429, 500, 502, 503, 504)


class ClientError(Exception):
    """Failure of a client with a status code."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def llm_map(
    df: DataFrame, *, col: str, client: Callable[[], Callable[[str], str]], batch: int = 8, retries: int = 3, backoff: float = 1.0, out: str = "answer",
) -> DataFrame:
    """Adds ``out`` and ``<out>_error``, calling ``client()(text)`` for every row.

    ``client`` is a factory, run once per Python worker. ``batch`` calls run at a time. A
    ClientError with a status that can pass is tried again after 1, 2, 4 … times ``backoff``
    seconds; any other failure fills the error column. Tasks can be repeated by Spark, so the
    client has to be idempotent. Limit the total rate by the number of partitions.
    """
    require_columns(df, col)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = client()

        def one(text):
            if text is None:
                return None, None
            for attempt in range(retries + 1):
                try:
                    return call(text), None
                except ClientError as error:
                    if error.status not in RETRY_STATUS or attempt == retries:
                        return None, str(error)
                    time.sleep(backoff * 2**attempt)
                except Exception as error:  # reported in the error column
                    return None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(batch) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(one, texts)), columns=["value", "error"], dtype=object)

    answers = F.pandas_udf(run, "value STRING, error STRING").asNondeterministic()
    return df.withColumn("_r", answers(F.col(col))).withColumns({out: F.col("_r.value"), f"{out}_error": F.col("_r.error")}).drop("_r")
