"""Tables behind a manifest: written aside, verified, and switched at once.

A snapshot is a folder of tables and numbered manifests, small files that name the parts of each table. Writers put new parts
beside the old ones, read them back, and then publish the next manifest by a rename that fails if another writer has
published that number first. Readers go by the newest manifest, so they see all tables of it or none, and a run that stops before
its rename leaves nothing but parts that no manifest names (:func:`swept` removes them).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published first; what was written is not seen by readers."""


def _files(spark: SparkSession, base: str):
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)


def _numbers(spark: SparkSession, base: str) -> list[int]:
    jvm, fs, _ = _files(spark, base)
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, base: str, number: int) -> dict:
    # one small file; wholetext keeps it in one row
    return json.loads(spark.read.text(f"{base}/_manifests/{number}.json", wholetext=True).first()[0])


def current(spark: SparkSession, base: str) -> tuple[int, dict]:
    """(number, tables) of the newest manifest; (0, {}) before the first. ``tables`` has of each name its schema and parts."""
    numbers = _numbers(spark, base)
    return (numbers[-1], _manifest(spark, base, numbers[-1])) if numbers else (0, {})


def read(spark: SparkSession, base: str, name: str, number: int | None = None) -> DataFrame:
    """A table as the newest manifest has it, or that of ``number``; an unknown one is a KeyError."""
    tables = current(spark, base)[1] if number is None else _manifest(spark, base, number)
    return spark.read.schema(StructType.fromJson(tables[name]["schema"])).parquet(*[f"{base}/{p}" for p in tables[name]["parts"]])


def _written(df: DataFrame, base: str, name: str) -> str:
    part, seen = f"{name}-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{base}/{part}")
    found = df.sparkSession.read.schema(df.schema).parquet(f"{base}/{part}").count()
    if found != seen.get["n"]:
        raise RuntimeError(f"{part}: {found} rows read of {seen.get['n']} written")
    return part


def publish(spark: SparkSession, base: str, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, after: int | None = None) -> int:
    """The number of the new manifest: some tables replaced, some with one part more, all others as they were.

    ``after`` is the number that the caller's data was read from (by default the newest); if another has been published since, or
    is while this one is written, :class:`Conflict` is raised and readers keep what they had.
    """
    number, tables = current(spark, base)
    if after is not None and after != number:
        raise Conflict(f"manifest {number} has been published after {after}")
    tables = {n: dict(t) for n, t in tables.items()}
    for name, df in (replaced or {}).items():
        tables[name] = {"schema": df.schema.jsonValue(), "parts": [_written(df, base, name)]}
    for name, df in (appended or {}).items():
        old = tables.get(name, {"schema": df.schema.jsonValue(), "parts": []})
        tables[name] = {"schema": old["schema"], "parts": [*old["parts"], _written(df, base, name)]}
    jvm, fs, context = _files(spark, base)
    path = jvm.org.apache.hadoop.fs.Path
    aside, final = path(f"{base}/_manifests/.{uuid.uuid4().hex}"), path(f"{base}/_manifests/{number + 1}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, final, never)  # fails if the manifest is there
    except Exception as error:
        fs.delete(aside, False)
        raise Conflict(f"manifest {number + 1} is there already") from error
    return number + 1


def swept(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Deletes what none of the newest ``keep`` manifests names, parts of stopped runs too; no writer may be at work."""
    jvm, fs, _ = _files(spark, base)
    path = jvm.org.apache.hadoop.fs.Path
    numbers = _numbers(spark, base)
    named = {p for n in numbers[-keep:] for t in _manifest(spark, base, n).values() for p in t["parts"]}
    gone = [s.getPath().getName() for s in fs.listStatus(path(base)) if not s.getPath().getName().startswith("_") and s.getPath().getName() not in named]
    for n in numbers[:-keep]:
        fs.delete(path(f"{base}/_manifests/{n}.json"), False)
    for name in gone:
        fs.delete(path(f"{base}/{name}"), True)
    return sorted(gone)
