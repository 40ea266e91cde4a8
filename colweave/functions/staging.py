"""Computing a column or a table once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.session import shared_folder


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add expensive columns that later steps refer to more than once, in filters above all.

    The optimizer moves a filter below the projection that makes its column, by writing the column's expression into
    the filter; a chain of such columns is then evaluated over and over. A column that comes out of a generator stays
    where it is, so the new columns are made by exploding a one-element array, which costs no row and no shuffle.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", made)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the folder all executors share and read back, for several later steps to read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
