"""Column selection, several views of one source, and the batch escape hatch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Leave out columns; a name that does not exist is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only these columns, in this order."""
    return df.select(*names)


def views(df: DataFrame, definitions: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Several projections of one source as rows tagged with ``view``, from a single scan.

    All views must select the same number of columns with matching types; names come from the first.
    """
    names = list(next(iter(definitions.values())))
    tagged = F.array(
        *[
            F.struct(F.lit(view).alias("view"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
            for view, columns in definitions.items()
        ]
    )
    return df.select(*keys, F.explode(tagged).alias("_v")).select(*keys, "_v.*")


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: StructType | str, batch_rows: int = 1000
) -> DataFrame:
    """Apply ``fn`` to batches given as a dict of column to list; it may return any number of rows."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows).to_pydict()
                yield pa.RecordBatch.from_pydict(fn(part), schema=arrow)

    return df.mapInArrow(run, target)
