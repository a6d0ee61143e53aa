"""Folds over ordered rows of a key: partitions are sorted and read as a stream, so that only the fold's state is held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..ship import ship


class Fold:
    """State of one key: ``row`` sees its rows in order, ``end`` follows the last; both return result rows (without the key)."""

    def row(self, *values) -> list[tuple]:
        return []

    def end(self) -> list[tuple]:
        return []


def typed(df: DataFrame, *columns: str) -> str:
    """Columns with the types they have, as a piece of a schema: keys may be numbers or text."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def fold(df: DataFrame, keys: list[str], order: list, make: Callable[[], Fold], schema: str) -> DataFrame:
    """``make()`` folds the rows of every key, in order; result rows are the key followed by what the fold returns (``schema``).

    ``row`` is given the columns of ``df`` but the keys.  Results leave in batches, whatever the length of a key.
    """
    ship(df.sparkSession)
    at = [df.columns.index(k) for k in keys]
    rest = [i for i in range(len(df.columns)) if i not in at]
    schema = f"{typed(df, *keys)}, {schema}"
    kinds = df.sparkSession.createDataFrame([], schema).schema.json()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_json_string

        target = to_arrow_schema(_parse_datatype_json_string(kinds))
        key, state, out = None, None, []

        def flush():
            cols = list(zip(*out)) or [()] * len(target)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target)], target.names)
            out.clear()
            return batch

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                now = tuple(values[i] for i in at)
                if state is None or now != key:
                    if state is not None:
                        out.extend((*key, *r) for r in state.end())
                    key, state = now, make()
                out.extend((*key, *r) for r in state.row(*(values[i] for i in rest)))
                if len(out) >= 2_000:
                    yield flush()
        if state is not None:
            out.extend((*key, *r) for r in state.end())
        yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
