"""One table from several whose schemas have drifted: what each version needs, and the table that all of them make.

Schemas come from Parquet footers or the session's catalog, so nothing is read to plan. A column that a version lacks is
added, a narrower type is widened, and a value where others have a list becomes a list of it. What cannot be brought
together is refused before anything is written, and so are rows that share a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from millrace.operators.merging import duplicates

#: Types by how wide they are; each goes into every later one of its row.
WIDTHS = [["tinyint", "smallint", "int", "bigint", "decimal(38,0)"], ["float", "double"], ["int", "double"], ["date", "timestamp"]]


@dataclass(frozen=True)
class Step:
    """How a version gets a column: add, widen, wrap (a list of the value), keep, or refuse; from_type is null where it is added."""

    version: str
    column: str
    action: str
    from_type: str | None
    to_type: str


def _wider(a: DataType, b: DataType) -> DataType | None:
    """The type that holds both, or None."""
    if a == b:
        return a
    if isinstance(a, ArrayType) or isinstance(b, ArrayType):
        own, other = (x.elementType if isinstance(x, ArrayType) else x for x in (a, b))
        inner = _wider(own, other)
        return inner and ArrayType(inner)
    names = a.simpleString(), b.simpleString()
    for row in WIDTHS:
        if all(n in row for n in names):
            return a if row.index(names[0]) >= row.index(names[1]) else b
    return None


def target_of(schemas: dict[str, StructType]) -> tuple[StructType, list[tuple[str, str, str]]]:
    """The schema that all versions fit, columns in the order in which versions bring them, and (version, column, type) of what does not fit."""
    found: dict[str, StructField] = {}
    refused = []
    for version, schema in schemas.items():
        for f in schema.fields:
            before = found.get(f.name.lower())
            kind = f.dataType if before is None else _wider(before.dataType, f.dataType)
            if kind is None:
                refused.append((version, f.name, f.dataType.simpleString()))
            else:
                found[f.name.lower()] = StructField(f.name if before is None else before.name, kind)
    return StructType(list(found.values())), refused


def plan(schemas: dict[str, StructType]) -> list[Step]:
    """The steps of every version and column of the target, refusals included."""
    target, refused = target_of(schemas)
    bad = {(v, c.lower()) for v, c, _ in refused}
    steps = []
    for version, schema in schemas.items():
        own = {f.name.lower(): f.dataType for f in schema.fields}
        for f in target.fields:
            kind = own.get(f.name.lower())
            if (version, f.name.lower()) in bad:
                action = "refuse"
            elif kind is None:
                action = "add"
            else:
                action = "keep" if kind == f.dataType else "wrap" if isinstance(f.dataType, ArrayType) and not isinstance(kind, ArrayType) else "widen"
            steps.append(Step(version, f.name, action, kind and kind.simpleString(), f.dataType.simpleString()))
    return steps


def _value(step: Step, default: Column) -> Column:
    own = F.col(f"`{step.column}`")
    value = {"add": lambda: default, "wrap": lambda: F.when(own.isNotNull(), F.array(own)), "keep": lambda: own, "widen": lambda: own}[step.action]()
    return value.cast(step.to_type).alias(step.column)


def reconciled(tables: dict[str, DataFrame], keys: list[str], defaults: dict[str, Column] | None = None, version_col: str | None = None) -> DataFrame:
    """All rows of all versions in the target's columns.

    defaults: what a column is in rows of versions that lack it, else null; it may use that version's other columns, so a list
    can be made of an old column. Raises ValueError where types do not fit, and where rows share a key, with an example.
    version_col: a column with the version's name, if one is wanted.
    """
    schemas = {v: t.schema for v, t in tables.items()}
    steps = plan(schemas)
    if bad := [s for s in steps if s.action == "refuse"]:
        raise ValueError("; ".join(f"{s.version}.{s.column} is {s.from_type}, which does not go with {s.to_type}" for s in bad))
    parts = []
    for version, table in tables.items():
        own = [_value(s, (defaults or {}).get(s.column, F.lit(None))) for s in steps if s.version == version]
        parts.append(table.select(*own, *([F.lit(version).alias(version_col)] if version_col else [])))
    rows = reduce(DataFrame.unionByName, parts)
    if example := duplicates(rows, keys).orderBy(*keys).first():
        raise ValueError(f"several rows have one {', '.join(keys)}, such as {example.asDict()}")
    return rows


def stored_versions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables in the folders below a folder, by name in order. Only footers are read until rows are asked for."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory())
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if not n.startswith(("_", "."))}


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type) of the tables and views that the session's catalog lists."""
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{t.namespace[0] if t.namespace else 'default'}.{t.name}"))]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
