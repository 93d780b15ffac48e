"""What the document operators share: reading, per-row mapping through Arrow, span digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.session import materialize

#: Names inside an operator start with this, so that they cannot clash with a caller's columns.
PRE = "__llm_"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key and the text alone, whatever else the table holds; a null text counts as empty."""
    return df.select(
        F.col(id_col).alias(f"{PRE}id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(f"{PRE}text")
    )


def map_texts(
    df: DataFrame, id_col: str, text_col: str, name: str, kind: T.DataType, make: Callable[[], Callable[[str], object]]
) -> DataFrame:
    """One row (key, value) per input row; ``make`` builds the function from text to value, once a task.

    Texts are decoded one at a time, so a task holds one Arrow batch and one text.
    """
    rows = keyed_text(df, id_col, text_col)
    id_type = rows.schema[0].dataType
    out_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            values = pa.array([fn(t.as_py()) for t in batch.column(1)], type=out_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[id_col, name])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, id_type), T.StructField(name, kind)]))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span in its order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
