"""Session factory with the settings that the plans rely on."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "murmur", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Spark's setting by which the shuffle files of an execution go when it ends; without it they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_inside: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()


@contextmanager
def one_off(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside is run once, so its shuffle files go as soon as it ends.

    The last of the threads that are inside puts the session's own value back, so frames that users run again keep their shuffles.
    """
    with _lock:
        n, own = _inside.get(spark) or (0, spark.conf.get(CLEANUP, None))
        _inside[spark] = n + 1, own
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, own = _inside.pop(spark)
            if n > 1:
                _inside[spark] = n - 1, own
            elif own is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, own)
