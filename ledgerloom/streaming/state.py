"""Settings and folders of streams with state."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ledgerloom.operators import lineage

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_ROCKS = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _CHANGELOG: "true"}


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in it keep their state in RocksDB and write only its changes; a running stream has its own settings."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, in the shared checkpoint folder; it stays."""
    return f"{lineage.folder(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
