"""What the training-data operators share: reading tables, staging results, walking Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import text_batches  # noqa: F401
from ..plans.staging import staged  # noqa: F401

#: ASCII upper case to lower case; every other byte stays. As 256 bytes for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with a space for each byte that is no ASCII letter, digit or part of a non-ASCII character.
WORDS = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


#: Columns that operators add for themselves begin with this; columns of documents don't.
OWN = "_wordloom_"


def besides(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case: results that an operator adds take the place of columns named like them."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(content: str | bytes) -> str:
    return hashlib.sha256(content.encode() if isinstance(content, str) else content).hexdigest()


_resident: dict[str, Any] = {}


def resident(key: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, one thing at a time: workers outlive queries, and what they keep would add up.

    Things made of a file are keyed by its digest(), so that functions with the same file share one.
    """
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Gives up what the worker keeps; functions that keep nothing call it, as they may follow others in the same worker.

    What was freed goes back to the system: the allocators would keep it, and an idle worker counts in its executor's memory.
    """
    if _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)


def byte_rows(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value, made a few rows at a time so that a batch is never held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).cast(pa.large_binary()).to_pylist()


def text_rows(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def struct(**columns: tuple[list, pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))
