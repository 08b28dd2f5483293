"""Attribute-value rows into wide tables.

Method: positional stitching. Entities get global ordinals; every attribute is written as a typed column aligned to a range of
ordinals; the columns of a range are put side by side by position. There is no pivot over values and no join per attribute.

Ranges are blocks of a hash of the entity, of about ``BLOCK`` entities each, and the ordinal of an entity is the number of
entities in the blocks before plus its place in its own block. Cells are reduced to one row per entity and attribute, on the map
side first, before they move to their block; so a block's size depends on entities and attributes alone, not on hot entities.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from quoin.operators.runs import co_sorted, floats, ints, key_runs

#: Entities of one block, roughly.
BLOCK = 4096
TYPES = {"double": DoubleType(), "long": LongType(), "boolean": BooleanType()}


def _typed(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values as ``kind`` and which of them fit it."""
    if kind == "double":
        return values, np.isfinite(values)
    whole = np.isfinite(values) & (np.floor(values) == values)
    if kind == "long":
        fits = whole & (np.abs(values) < 2.0**63)
        return np.where(fits, values, 0).astype(np.int64), fits
    fits = whole & ((values == 0) | (values == 1))
    return values == 1, fits


def _stitch(entity: str, attributes: Mapping[str, str], schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, ["block"]):
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = table.slice(low, high - low).combine_chunks()
                names = part[entity].combine_chunks().dictionary_encode()
                place = names.indices.to_numpy(zero_copy_only=False)  # rows are in entity order, so codes are places
                kinds, values, facts = part["attribute"].combine_chunks().dictionary_encode(), floats(part["value"]), ints(part["fact"], -1)
                code, known = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False), kinds.dictionary.to_pylist()
                n = len(names.dictionary)
                out = [names.dictionary, pa.array(ints(part["offset"], 0)[0] + np.arange(n, dtype=np.int64))]
                for name, kind in attributes.items():
                    rows = np.flatnonzero(code == known.index(name)) if name in known else np.zeros(0, dtype=np.int64)
                    typed, fits = _typed(values[rows], kind)
                    column, ids, there = np.zeros(n, dtype=typed.dtype), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
                    column[place[rows]], ids[place[rows]], there[place[rows]] = typed, facts[rows], fits
                    out += [pa.array(column, mask=~there), pa.array(ids, mask=~there)]
                yield from pa.Table.from_arrays(out, schema=schema).to_batches(max_chunksize=10_000)

    return task


def wide_by_position(df: DataFrame, entity: str, attribute: str, value: str, fact_id: str, order: str, attributes: Mapping[str, str], *, eligible: Column | None = None) -> DataFrame:
    """One row per entity: entity, ordinal, and for each of ``attributes`` (name -> double, long or boolean) the column of that
    name and ``<name>__id``, the row that supplied it.

    Of the ``eligible`` rows of an entity and attribute, the one of the greatest ``order`` supplies the cell (then the greatest id);
    where its value is null, NaN, infinite or no value of the type, both columns are null. Entities without any such row get a row of
    nulls; rows with a null entity are left out; rows of other or null attributes supply nothing. Null orders are the least. Repeated
    rows count once. A name among ``attributes`` that equals the entity column or "ordinal" raises. Extra columns are ignored.
    """
    if clash := {entity, "ordinal"} & {*attributes, *(f"{a}__id" for a in attributes)}:
        raise ValueError(f"attributes clash with result columns: {sorted(clash)}")
    rows = df.where(F.col(entity).isNotNull()).select(
        F.col(entity), F.when(F.col(attribute).isin(list(attributes)) & (F.lit(True) if eligible is None else eligible), F.col(attribute)).alias("attribute"),
        F.struct(F.col(order).alias("o"), F.col(fact_id).cast("long").alias("i"), F.col(value).cast("double").alias("v")).alias("cell"),
    )
    cells = rows.groupBy(entity, "attribute").agg(F.max("cell").alias("cell"))
    count = rows.agg(F.approx_count_distinct(entity)).first()[0]
    block = F.pmod(F.xxhash64(entity), F.lit(max(1, -(-count // BLOCK)))).cast("int")
    sizes = rows.select(entity).distinct().groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = cells.select(block.alias("block"), entity, "attribute", F.col("cell.v").alias("value"), F.col("cell.i").alias("fact")).join(offsets, "block")
    schema = StructType([StructField(entity, df.schema[entity].dataType), StructField("ordinal", LongType())])
    for name, kind in attributes.items():
        schema = schema.add(name, TYPES[kind]).add(f"{name}__id", LongType())
    task = _stitch(entity, dict(attributes), to_arrow_schema(schema))
    return co_sorted(placed, ["block"], [entity]).mapInArrow(task, schema)


def cells_of(wide: DataFrame, entity: str, attributes: Sequence[str]) -> DataFrame:
    """(entity, attribute, id) of each filled cell."""
    cells = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"{a}__id").alias("id")) for a in attributes))
    return wide.select(entity, F.explode(cells).alias("c")).where("c.id IS NOT NULL").select(entity, "c.attribute", "c.id")
