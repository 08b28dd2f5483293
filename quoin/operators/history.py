"""History of changing entity attributes from periodic snapshots or updates.

Method: all snapshots are co-partitioned by entity, and the sorted runs are merged by entity and time (the shuffle sort is that k-way
merge, over spilled runs where a partition is large). One pass over the merged stream keeps only the open version of the current entity
and emits a version when the payload changes. No history is held in memory, at any length; a hot entity is a longer stream, cut to one row
per snapshot time by a map-side reduction before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quoin.operators.runs import co_sorted


def _versions(keys: Sequence[str], time: str, sticky: Sequence[str], plain: Sequence[str], schema: pa.Schema):
    attributes = [*sticky, *plain]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity = began = state = None
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()

        for batch in batches:
            entities = zip(*(batch.column(k).to_pylist() for k in keys))
            payloads = zip(*(batch.column(a).to_pylist() for a in attributes))
            for own, at, new in zip(entities, batch.column(time).to_pylist(), payloads):
                if own != entity:
                    if entity is not None:
                        out.append((*entity, began, None, *state))
                    entity, began, state = own, at, new
                    continue
                new = tuple(s if n is None and i < len(sticky) else n for i, (s, n) in enumerate(zip(state, new)))
                if new != state:
                    out.append((*entity, began, at, *state))
                    began, state = at, new
            if len(out) >= 5_000:
                yield from flush()
        if entity is not None:
            out.append((*entity, began, None, *state))
        if out:
            yield from flush()

    return task


def attribute_history(sources: Sequence[DataFrame] | DataFrame, keys: Sequence[str], time: str, loaded: str, sticky: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """One row per version: keys, valid_from, valid_to (the next version's start; null: still valid) and the attributes.

    ``sticky`` attributes: null means not delivered, so unchanged. ``plain`` attributes: null is a value. Of rows of one entity and
    ``time`` the greatest ``loaded`` counts, then the greatest payload; null loaded is the least. A payload that returns to an
    earlier value starts a new version. Rows with a null key or time are left out; repeated rows count once; other columns are
    ignored. Several ``sources`` (snapshots, updates) are merged; an empty table gives no versions.
    """
    frames = [sources] if isinstance(sources, DataFrame) else list(sources)
    wanted = [*keys, time, loaded, *sticky, *plain]
    rows = frames[0].select(*wanted)
    for other in frames[1:]:
        rows = rows.unionByName(other.select(*wanted))
    for c in (*keys, time):
        rows = rows.where(F.col(c).isNotNull())
    one = rows.groupBy(*keys, time).agg(F.max(F.struct(loaded, *sticky, *plain)).alias("last"))
    one = one.select(*keys, time, *(F.col(f"last.{a}").alias(a) for a in (*sticky, *plain)))
    fields = {f.name: f.dataType for f in rows.schema}
    schema = StructType(
        [StructField(k, fields[k]) for k in keys] + [StructField("valid_from", fields[time]), StructField("valid_to", fields[time])] + [StructField(a, fields[a]) for a in (*sticky, *plain)]
    )
    return co_sorted(one, list(keys), [time]).mapInArrow(_versions(list(keys), time, list(sticky), list(plain), to_arrow_schema(schema)), schema)
