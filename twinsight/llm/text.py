"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names: ``only(df, doc_id="id", text="body")``.

    Everything else in ``df`` stays behind, so no other column can clash.
    """
    return df.select(*[col(source).alias(name) for name, source in columns.items()])


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: ``bytes.split`` splits on exactly the six ASCII blanks."""
    return data.split() if data else []


def texts(column) -> list[bytes | None]:
    """An Arrow string column as a list of UTF-8 byte strings."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def worker_state(name: str, build: Callable[[], Any], version: str = "") -> Any:
    """Something costly that one Python worker builds once and keeps between its tasks.

    It keeps one thing at a time, that of the operator it works for, so operators that follow each other in
    an application do not add up.
    """
    store = sys.modules.setdefault("_twinsight_worker_state", types.ModuleType("_twinsight_worker_state")).__dict__
    if store.get("key") != (name, version):
        if store.pop("state", None) is not None:
            gc.collect()  # caches refer to what fills them, so that nothing else would free them
        store["key"], store["state"] = (name, version), build()
    return store["state"]


def sliced(batch, rows: int = 500):
    """A record batch in parts, so that what a task makes of it at a time stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
