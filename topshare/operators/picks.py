"""The first rows of many orders in one scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.session import materialize

_FLOATS = (T.DoubleType, T.FloatType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


class Pick(NamedTuple):
    """The first ``rows`` of the rows ``among``, by a value that is not null (if one is given), then by key."""

    rows: int
    among: Column
    by: Column | None = None
    descending: bool = False


def first_keys(df: DataFrame, keys: Sequence[str], picks: Sequence[Pick]) -> DataFrame:
    """Keys of the rows of all picks, without repeats (this starts jobs).

    One scan of the columns that are needed.  Each task goes through its rows
    in Arrow batches and holds the first rows of every pick, so that its memory
    does not grow with the input and it sends on at most the sum of all
    ``rows``; these candidates are written, and the last choice is made among
    them.  Null keys come first and NaN last, as in any order of Spark.  Repeated
    keys count as rows.  Keys have to be of simple types.
    """
    nested = [k for k in keys if isinstance(df.schema[k].dataType, _NESTED)]
    if nested:
        raise ValueError(f"keys of nested types have no order here: {', '.join(nested)}")
    order: list[str] = []
    columns: list[Column] = []
    for i, k in enumerate(keys):
        if isinstance(df.schema[k].dataType, _FLOATS):
            columns.append(F.isnan(F.col(f"`{k}`")).alias(f"nan{i}"))
            order.append(f"nan{i}")
        columns.append(F.col(f"`{k}`").alias(f"key{i}"))
        order.append(f"key{i}")
    for i, p in enumerate(picks):
        columns.append((p.among if p.by is None else p.among & p.by.isNotNull()).alias(f"among{i}"))
        if p.by is not None:
            columns.append(p.by.alias(f"by{i}"))
    flags = [f"among{i}" for i in range(len(picks))]
    needed = df.select(*columns)
    needed = needed.where(reduce(or_, [F.coalesce(F.col(c), F.lit(False)) for c in flags]))
    sorts = [
        ([(f"by{i}", "descending" if p.descending else "ascending")] if p.by is not None else [])
        + [(c, "ascending") for c in order]
        for i, p in enumerate(picks)
    ]
    limits = [p.rows for p in picks]
    sent = T.StructType([f for f in needed.schema.fields if f.name not in flags]).add("pick", T.IntegerType())

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, sort in enumerate(sorts):
                found = table.filter(table[flags[i]]).drop_columns(flags)
                if found.num_rows:
                    both = pa.concat_tables([held[i], found]) if i in held else found
                    held[i] = both.take(pc.sort_indices(both, sort, null_placement="at_start")[: limits[i]])
        for i, table in held.items():
            numbered = table.append_column("pick", pa.array([i] * table.num_rows, pa.int32()))
            yield from numbered.combine_chunks().to_batches()

    candidates, _path = materialize(needed.mapInArrow(hold, sent), "candidates")
    parts = []
    for i, sort in enumerate(sorts):
        by = [F.col(c).desc() if way == "descending" else F.col(c).asc() for c, way in sort]
        parts.append(candidates.where(F.col("pick") == i).orderBy(*by).limit(limits[i]))
    chosen = reduce(DataFrame.unionByName, parts)
    return chosen.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)]).distinct()
