"""Session settings that the plans rely on."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Settings of the session that hold inside, and are as before after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer."""
    b = SparkSession.builder.appName("ionweave")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=base | conf).getOrCreate()
