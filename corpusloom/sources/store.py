"""Stored tables: reading, writing, keyed upserts and validation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fix_mojibake


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where that is unset and all run in one process, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, as write_records makes them: files are split between tasks. A line that is no record is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8."""
    df.write.mode("overwrite").json(path)


def repair_records(df: DataFrame) -> DataFrame:
    """Every string of the table repaired, at any depth of arrays, maps (values; keys stay) and structs."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return fix_mojibake(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: of(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def database_url(env: dict[str, str] | None = None) -> str:
    """DATABASE_URL, else one made of the POSTGRES_* variables, with the password quoted."""
    env = dict(os.environ if env is None else env)
    if env.get("DATABASE_URL"):
        return env["DATABASE_URL"]
    missing = [k for k in ("POSTGRES_DB", "POSTGRES_USER", "POSTGRES_PASSWORD") if not env.get(k)]
    if missing:
        raise ValueError(f"not set: {', '.join(missing)}")
    host, port = env.get("POSTGRES_HOST", "localhost"), env.get("POSTGRES_PORT", "5432")
    return f"postgresql://{env['POSTGRES_USER']}:{quote(env['POSTGRES_PASSWORD'], safe='')}@{host}:{port}/{env['POSTGRES_DB']}"


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """existing with the rows of new put in place of those with their keys. Of new rows with one key the last by version stays;
    without a version, and of equal ones, the greatest by its other columns, so that a rerun gives the same table."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(last_rows(new, keys, version).select(*existing.columns))


def last_rows(rows: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row for each key: the last by version, then by its columns as JSON."""
    order = [F.desc_nulls_last(version)] if version else []
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.desc(F.to_json(F.struct(*rows.columns)))))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")


def upsert_columns(existing: DataFrame, new: DataFrame, key: str, update: list[str], on_insert: dict[str, str] | None = None) -> DataFrame:
    """A full outer join on key: the columns in update come from new where it has the key, all others stay. A row that is
    only in new takes what new has; on_insert names, for a column, the column of new that fills it then."""
    old, fresh = existing.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    out = []
    for c in existing.columns:
        source = (on_insert or {}).get(c, c)
        value = F.col(f"n.{source}") if source in new.columns else F.lit(None).cast(existing.schema[c].dataType)
        if c == key:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in update:
            out.append(F.when(F.col("n._new"), value).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(value).alias(c))
    return both.select(*out)


def update_column(existing: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that values(key, column) names get its value, null too; the others keep theirs."""
    new = values.select(key, F.col(column).alias("_value"), F.lit(True).alias("_named"))
    put = F.when(F.col("_named"), F.col("_value")).otherwise(F.col(column))
    return existing.join(new, key, "left").withColumn(column, put).select(*existing.columns)


def violations(df: DataFrame, keys: list[str], required: list[str] = (), vectors: dict[str, int] | None = None, checks: dict[str, str] | None = None, references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """How many rows break each rule: unique keys, columns that must not be null, dimensions of vectors, conditions, and foreign keys."""
    found = [df.groupBy(*keys).count().filter("count > 1").select(F.lit(f"unique {','.join(keys)}").alias("rule"))]
    found += [df.filter(F.col(c).isNull()).select(F.lit(f"not null {c}").alias("rule")) for c in required]
    found += [df.filter(F.size(c) != n).select(F.lit(f"dimension {c}").alias("rule")) for c, n in (vectors or {}).items()]
    found += [df.filter(~F.coalesce(F.expr(rule), F.lit(True))).select(F.lit(f"check {name}").alias("rule")) for name, rule in (checks or {}).items()]
    for c, parent, parent_key in references:
        orphans = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(parent_key).alias(c)), c, "left_anti")
        found.append(orphans.select(F.lit(f"reference {c}").alias("rule")))
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    return union.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


def cascade_delete(edges: DataFrame, surviving: DataFrame, key: str) -> DataFrame:
    """Edges (src, dst) whose ends both survive."""
    ends = surviving.select(key)
    return edges.join(ends.withColumnRenamed(key, "src"), "src", "left_semi").join(ends.withColumnRenamed(key, "dst"), "dst", "left_semi")
