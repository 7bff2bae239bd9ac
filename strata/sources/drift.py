"""Keeping what a fixed schema would lose: fields it doesn't declare, and values of another type than it declares.

A record is parsed once to its declared fields and once to a VARIANT; what the first leaves out of the second is kept beside the record as
``_rest``, an array of (path, problem, value): problem 'unknown' for a field that isn't declared, 'retyped' for a value that
the declared type can't hold. Paths name fields from the record on, with [] for any element of an array. The levels looked at are
those of the schema, so the plan has a fixed size and no shuffle.

Defined cases: a null field is no drift; a number or an object in a text field is its text, as everywhere in Spark; an element that is
retyped leaves its array with a null in its place; text that isn't a JSON object (an empty file, a cut one, one with a key
twice) is a broken record, kept in ``_corrupt_record``; such a record has no rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import lineage
from .schemas import CORRUPT, schema

REST = "_rest"
REST_TYPE = "array<struct<path string, problem string, value variant>>"


def _entry(path: Column, problem: str, value: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(problem).alias("problem"), value.alias("value"))


def _none() -> Column:
    return F.array().cast(REST_TYPE)


def _held(value: Column) -> Column:
    """False for a missing and for a null value."""
    return value.isNotNull() & ~F.is_variant_null(value)


def _lost(value: Column, kind: T.DataType, path: str) -> Column:
    """What a value of a declared type loses."""
    retyped = F.array(_entry(F.lit(path), "retyped", value)).cast(REST_TYPE)
    if isinstance(kind, T.StructType):
        fits = F.try_variant_get(value, "$", "map<string,variant>")
        inside = left_out(value, kind, f"{path}.")
    elif isinstance(kind, T.ArrayType):
        fits = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(fits, lambda x: _lost(x, kind.elementType, f"{path}[]")))
    else:
        fits, inside = F.try_variant_get(value, "$", kind.simpleString()), _none()
    return F.when(~_held(value), _none()).when(fits.isNull(), retyped).otherwise(inside)


def left_out(record: Column, declared: T.StructType, prefix: str = "") -> Column:
    """The rest of a VARIANT object under a schema."""
    fields = F.try_variant_get(record, "$", "map<string,variant>")
    unknown = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(declared.names) & _held(e["value"]))
    parts = [F.transform(unknown, lambda e: _entry(F.concat(F.lit(prefix), e["key"]), "unknown", e["value"])).cast(REST_TYPE)]
    parts += [_lost(F.try_element_at(fields, F.lit(f.name)), f.dataType, f"{prefix}{f.name}") for f in declared.fields]
    return F.concat(*parts)


def with_rest(texts: DataFrame, ddl: str, text: str = "value") -> DataFrame:
    """The declared fields of each JSON text, ``_corrupt_record`` and ``_rest``, then the other columns of ``texts``.

    A record with a retyped value stays a record: that value is null in it and whole in ``_rest``.
    """
    declared = schema(ddl)
    strict = F.from_json(text, schema(ddl, corrupt=True), {"columnNameOfCorruptRecord": CORRUPT})
    others = [c for c in texts.columns if c != text]
    parsed = texts.select(*others, text, strict.alias("_strict"), F.try_parse_json(text).alias("_record"))
    whole = F.try_variant_get("_record", "$", "map<string,variant>").isNotNull()
    lenient = F.try_variant_get("_record", "$", declared.simpleString())
    chosen = F.when(~whole, F.lit(None)).when(F.col(f"_strict.{CORRUPT}").isNull(), F.struct(*(F.col(f"_strict.`{n}`").alias(n) for n in declared.names))).otherwise(lenient)
    chosen = parsed.select(*others, text, "_record", chosen.cast(declared).alias("_fields"), F.coalesce(whole, F.lit(False)).alias("_whole"))
    return chosen.select(
        *(F.col(f"_fields.`{n}`").alias(n) for n in declared.names),
        F.when(~F.col("_whole"), F.coalesce(F.col(text), F.lit(""))).alias(CORRUPT),
        F.when(F.col("_whole"), left_out(F.col("_record"), declared)).otherwise(_none()).alias(REST),
        *others,
    )


def read_with_rest(spark: SparkSession, path: str, ddl: str, pattern: str = "*.json", multi_line: bool = True) -> DataFrame:
    """``read_documents`` that keeps the rest: one row per file (with ``multi_line`` off, per line) with lineage."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return with_rest(lineage(reader.text(path, wholetext=multi_line)), ddl)


def drift_report(records: DataFrame, *by: str) -> DataFrame:
    """by, path, problem, n_records, n_values: how often the records lose something at a path."""
    kinds = F.array_distinct(F.transform(REST, lambda e: F.struct(e["path"].alias("path"), e["problem"].alias("problem"))))
    times = lambda k: F.size(F.filter(REST, lambda e: (e["path"] == k["path"]) & (e["problem"] == k["problem"])))
    each = records.select(*by, F.explode(F.transform(kinds, lambda k: F.struct(k["path"].alias("path"), k["problem"].alias("problem"), times(k).alias("n")))).alias("_e"))
    counts = F.count(F.lit(1)).alias("n_records"), F.sum("_e.n").alias("n_values")
    return each.groupBy(*by, F.col("_e.path").alias("path"), F.col("_e.problem").alias("problem")).agg(*counts)
