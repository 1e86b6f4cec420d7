"""Images as one array a row: kernels run where the rows lie, over Arrow batches, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_image(df: DataFrame, arrays: list[str], scalars: list[str], width: int | str, kernel: Callable[..., list[tuple]], made: str) -> DataFrame:
    """The rows that ``kernel`` makes of each row, behind the row's ``scalars``.

    ``arrays`` are row-major images of ``width`` columns (a number, or the name of the scalar that holds each row's), given to the kernel as two-dimensional arrays of
    doubles, then the scalars' values.  Rows with a null or empty image, one that has null pixels or no width, make no rows.
    """
    given = df.select(*scalars, *(F.col(a).cast("array<double>").alias(a) for a in arrays))
    extra = StructType.fromDDL(made)
    schema = StructType([given.schema[s] for s in scalars] + extra.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in (*scalars, *arrays)}
            for i in range(batch.num_rows):
                # Told here, as a filter would draw or read an image once more for each condition.
                pixels = [columns[a][i].values for a in arrays]
                if any(v is None or not len(v) or v.null_count for v in pixels):
                    continue
                values = [columns[s][i].as_py() for s in scalars]
                columns_of = width if isinstance(width, int) else values[scalars.index(width)]
                if columns_of is None:
                    continue
                pictures = [v.to_numpy(zero_copy_only=False).reshape(-1, columns_of) for v in pixels]
                out += [(*values, *row) for row in kernel(*pictures, *values)]
            parts = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array([v.item() if isinstance(v, np.generic) else v for v in part], field.type) for part, field in zip(parts, arrow)], schema=arrow)

    return given.mapInArrow(run, schema)


#: Images that one Arrow batch of ``drawn`` holds at most, in pixels of all its columns.
BATCH_PIXELS = 1 << 21


def drawn(df: DataFrame, scalars: list[str], values: str, made: list[str], draw: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """(scalars..., made...): the row-major images that ``draw`` makes of each row's array of numbers, as arrays of doubles.

    Rows whose array is null or empty, or has nulls, get null images.  Batches are small, as images are far larger than what they are drawn from.
    """
    given = df.select(*scalars, values)
    schema = StructType([given.schema[s] for s in scalars] + StructType.fromDDL(", ".join(f"{c} array<double>" for c in made)).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(values))
            begin, pictures, pixels = 0, [], 0
            for i in range(batch.num_rows):
                v = source[i].values
                pictures.append(None if v is None or not len(v) or v.null_count else draw(v.to_numpy(zero_copy_only=False)))
                pixels += sum(p.size for p in pictures[-1] or ())
                if pixels >= BATCH_PIXELS or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    kept = [part.column(part.schema.get_field_index(s)).cast(arrow.field(s).type) for s in scalars]
                    yield pa.RecordBatch.from_arrays([*kept, *(_lists([p and p[k] for p in pictures]) for k in range(len(made)))], schema=arrow)
                    begin, pictures, pixels = i + 1, [], 0

    return given.mapInArrow(run, schema)


def _lists(images: list[np.ndarray | None]) -> pa.Array:
    """One list of doubles an image."""
    ends = np.cumsum([0, *(0 if p is None else p.size for p in images)], dtype=np.int32)
    known = [np.asarray(p, dtype=np.float64).ravel() for p in images if p is not None]
    missing = pa.array([p is None for p in images] + [False])
    offsets = pa.array(ends, mask=np.asarray(missing)) if any(p is None for p in images) else pa.array(ends)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(known) if known else np.empty(0)))
