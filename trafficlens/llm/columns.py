"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts here: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where batches are bounded: bytes of one that Python gets, and rows of one that is read from ORC.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 512
_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
           "spark.sql.orc.columnarReaderBatchSize": BATCH_ROWS}


def named(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(named(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")))


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back, so lineage ends in files."""
    from trafficlens.plans.scratch import materialise

    return materialise(df, label)


def unique_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:8]}"


def bound_batches(spark: SparkSession) -> None:
    """From here on Python gets batches of about ``BATCH_BYTES`` in this session, however long the rows are.

    Spark's own bound is 10,000 rows, tens of MB of texts or ids, which lie in memory several times:
    as they were read, while Spark builds the batch, as it is sent, in Python, and as it comes back.
    """
    for name, value in _BOUNDS.items():
        spark.conf.set(name, value)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for the jobs that run here; the session's settings are put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in _BOUNDS}
    try:
        bound_batches(spark)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
