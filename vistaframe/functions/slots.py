"""Places for models: typed column functions with deterministic stubs. A model goes in as a function over batches.

``arrow_slot`` loads the model once per worker and hands it whole Arrow batches; ``guarded_slot`` stops calling a remote
model within a task after its first failure and gives NULL from there on (a breaker over all tasks isn't promised); the rows of
the failed batch that come before the failing one are asked again, singly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(text: Column) -> Column:
    """Stub of both spelling models."""
    return text


def stub_color(name: Column, picture: Column | None = None, colors: tuple[str, ...] = ("black", "white", "gray", "brown", "red", "green", "blue")) -> Column:
    """Stub of the model that names the colour of an object in a picture; it looks at the name only."""
    at = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(len(colors))).cast("int")
    return F.get(F.array(*[F.lit(c) for c in colors]), at)


def stub_embedding(text: Column, width: int = 8) -> Column:
    """Stub of a text embedding: hashed parts of the md5."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(F.substring(F.md5(text), i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535)


def arrow_slot(load: Callable[[], Callable[[pd.DataFrame], pd.Series]], returns: str, *columns: Column) -> Column:
    """load() gives a function from a batch (columns by position) to a series; it is called once per task."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            yield model(pd.concat(parts, axis=1, keys=range(len(parts))))

    return run(*columns)


def guarded_slot(df: DataFrame, call: Callable[[pd.Series], pd.Series], column: str, out: str) -> DataFrame:
    """df with the answers of a remote model to a text column; NULL once a call has failed in the task."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def one_by_one(texts: pd.Series) -> pd.Series:
        """The rows of a failed batch singly, up to the one that fails."""
        said: list = [None] * len(texts)
        for i in range(len(texts)):
            try:
                said[i] = call(texts.iloc[i : i + 1]).iloc[0]
            except Exception:  # noqa: BLE001
                break
        return pd.Series(said, dtype=object, index=texts.index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = False
        for pdf in batches:
            answers = None
            if not open_:
                try:
                    answers = call(pdf[column])
                except Exception:  # noqa: BLE001 - whatever a remote model raises
                    answers, open_ = one_by_one(pdf[column]), True
            yield pdf.assign(**{out: answers if answers is not None else pd.Series([None] * len(pdf), dtype=object, index=pdf.index)})

    return df.mapInPandas(run, schema)
