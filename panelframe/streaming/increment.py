"""Daily increments as a stream: files of raw rows, formulas that go on from each entity's state, one upsert a batch.

`with_formulas` keeps for each entity what its formulas need of the past (the tails of windows, the last value of
recursions) in Spark's state store, so that a batch costs its own rows, whatever the length of the histories. `daily` writes
what comes out to a table with versions and standardises the dates that a batch has touched, each once they are whole.
A batch that runs again after a failure finds its number in the manifest and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StructField, StructType

from panelframe.functions.expr import Ex
from panelframe.operators.history import _STATE, Program, read_states, write_states
from panelframe.operators.history import _bounds as bounds_of
from panelframe.sources.versions import Versions


def stream_files(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(form)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.load(path)


def without_repeats(events: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the delay; state is dropped behind the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def run_available(events: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Works through what is there and stops; `each` gets every micro-batch and may be called again for one after a failure."""
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_formulas(events: DataFrame, named: dict[str, Ex], entity: str = "entity", order: str = "d", buckets: int = 256) -> DataFrame:
    """The stream with the formulas added, as over each entity's whole history.

    Rows at or before the last one that an entity has seen are left out (they would change history), and of rows of one batch, entity and
    place in the order the last one counts. The order has to be a date or a number. The states of the entities of one bucket (a hash) lie together, so that
    a batch works on many entities at a time; a bucket holds its share of the entities, and their number holds for the life of a checkpoint.
    """
    program = Program(named)
    if program.whole:
        raise ValueError("leads and ranks in a whole history change with later rows: they can't stream")
    schema = StructType([*events.schema.fields, *(StructField(n, DoubleType()) for n in named)])
    names, kept = events.columns, pa.schema([(entity, to_arrow_type(events.schema[entity].dataType)), ("last", to_arrow_type(events.schema[order].dataType)), ("state", _STATE)])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([entity, order], kind="stable").drop_duplicates([entity, order], keep="last")
        old = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else kept.empty_table()
        if old.num_rows:
            at = pc.index_in(pa.array(rows[entity], kept.types[0], from_pandas=True), old.column(0).combine_chunks())
            last = old.column(1).take(at)
            rows = rows[pc.fill_null(pc.or_kleene(pc.is_null(at), pc.greater(pa.array(rows[order], kept.types[1], from_pandas=True), last)), False).to_numpy()]
        if not len(rows):
            return
        own = pa.array(rows[entity], kept.types[0], from_pandas=True)
        bounds = bounds_of(pa.chunked_array([own]))
        keys = own.take(pa.array(bounds[:-1]))
        found = pc.index_in(keys, old.column(0).combine_chunks()).to_numpy(zero_copy_only=False)
        of = np.flatnonzero(~np.isnan(found.astype(float)))
        before = read_states(old.column(2).take(pa.array(found[of].astype(int), pa.int64())), of, len(keys))
        made, left = program.run_all({c: rows[c].to_numpy(dtype=float, na_value=np.nan) for c in program.reads}, bounds, before)
        now = pa.table([keys, pa.array(rows[order], kept.types[1], from_pandas=True).take(pa.array(bounds[1:] - 1)), write_states(left, len(keys))], schema=kept)
        stay = old.filter(pc.invert(pc.is_in(old.column(0), keys)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as out:
            out.write_table(pa.concat_tables([stay, now]))
        state.update((sink.getvalue().to_pybytes(),))
        out = rows[names].reset_index(drop=True)
        yield out.assign(**{n: pd.Series(v) for n, v in made.items()})

    return events.withColumn("\u0001bucket", F.pmod(F.xxhash64(entity), F.lit(buckets))).groupBy("\u0001bucket").applyInPandasWithState(run, schema, "said binary", "append", GroupStateTimeout.NoTimeout)


def daily(factors: Versions, standard: Versions, keys: Sequence[str], standardize: Callable[[DataFrame], DataFrame], name: str = "daily") -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: upserts a batch's rows, and replaces the cross-sections of its dates by those of all rows they have now."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            days = [r[0] for r in batch.select(factors.day).distinct().collect()]  # dates, not rows
            if not days:
                return
            factors.upsert(batch, keys, (name, number))
            whole = factors.read(min(days), max(days)).where(F.col(factors.day).isin(days))
            standard.replace(standardize(whole), (name, number))
        finally:
            batch.unpersist()

    return each
