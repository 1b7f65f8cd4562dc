"""Prepared copies of views: normalised text and folded fields are stored once, so that a query neither computes them nor reads what its conditions exclude."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

View = Callable[[SparkSession, str], DataFrame]

_VIEWS: dict[str, tuple[View, tuple[str, ...]]] = {}


def _setting(name: str, sf_dir: str) -> str:
    return f"newslens.prepared.{name}.{sf_dir.rstrip('/')}"


def preparable(*order: str) -> Callable[[View], View]:
    """A view that is read from its prepared copy where the session has one. Copies are sorted by ``order`` within files, which narrows the ranges that a scan is asked."""

    def mark(view: View) -> View:
        _VIEWS[view.__name__] = (view, order)

        @wraps(view)
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = spark.conf.get(_setting(view.__name__, sf_dir), None)
            return spark.read.parquet(path) if path else view(spark, sf_dir)

        return read

    return mark


def prepare(spark: SparkSession, sf_dir: str, root: str, *names: str) -> list[str]:
    """Writes views of the tables under ``sf_dir`` to ``root``, a folder that all executors reach, for this session. Tables that change need to be prepared again."""
    names = names or tuple(_VIEWS)
    for name in names:
        view, order = _VIEWS[name]
        path = f"{root}/{name}.parquet"
        view(spark, sf_dir).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        use(spark, sf_dir, name, path)
    return list(names)


def use(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    """A copy that another session has prepared."""
    spark.conf.set(_setting(name, sf_dir), path)


def forget(spark: SparkSession, sf_dir: str) -> None:
    for name in _VIEWS:
        spark.conf.unset(_setting(name, sf_dir))
