"""Shards of other programs: pickled lists of plain values, read without running anything.

A pickle is a small program. The reader here knows only the instructions that build lists,
tuples, dictionaries, texts, numbers, booleans and None; any other, such as one that would
import or call something, is an error before it does anything. Files come through Spark's
own reader, so they may lie in any store, and each is decoded by one task.
"""

from __future__ import annotations

import pickletools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagemill import schemas
from passagemill.sources.tables import shard_number

_VALUES = {
    "INT", "LONG", "LONG1", "LONG4", "BININT", "BININT1", "BININT2", "FLOAT", "BINFLOAT",
    "UNICODE", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8",
}
_CONSTANTS = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False}
_EMPTY = {"EMPTY_LIST": list, "EMPTY_DICT": dict, "EMPTY_TUPLE": tuple}
_TUPLES = {"TUPLE1": 1, "TUPLE2": 2, "TUPLE3": 3}


def _pairs(values: list) -> dict:
    return dict(zip(values[::2], values[1::2]))


def plain_value(data: bytes) -> Any:
    """The value of a pickle of plain values; ValueError for every other instruction."""
    stack: list[Any] = []
    marks: list[int] = []
    memo: dict[int, Any] = {}

    def since_mark() -> list:
        start = marks.pop()
        taken = stack[start:]
        del stack[start:]
        return taken

    def last(n: int) -> list:
        if len(stack) < n + (marks[-1] if marks else 0):
            raise IndexError
        taken = stack[-n:]
        del stack[-n:]
        return taken

    try:
        for op, arg, at in pickletools.genops(data):
            name = op.name
            if name in _VALUES:
                stack.append(arg)
            elif name in _CONSTANTS:
                stack.append(_CONSTANTS[name])
            elif name in _EMPTY:
                stack.append(_EMPTY[name]())
            elif name == "MARK":
                marks.append(len(stack))
            elif name in _TUPLES:
                stack.append(tuple(last(_TUPLES[name])))
            elif name == "TUPLE":
                stack.append(tuple(since_mark()))
            elif name == "LIST":
                stack.append(since_mark())
            elif name == "DICT":
                stack.append(_pairs(since_mark()))
            elif name in ("APPEND", "APPENDS"):
                more = last(1) if name == "APPEND" else since_mark()
                _expect(stack[-1], list).extend(more)
            elif name in ("SETITEM", "SETITEMS"):
                more = last(2) if name == "SETITEM" else since_mark()
                _expect(stack[-1], dict).update(_pairs(more))
            elif name in ("PUT", "BINPUT", "LONG_BINPUT"):
                memo[arg] = stack[-1]
            elif name == "MEMOIZE":
                memo[len(memo)] = stack[-1]
            elif name in ("GET", "BINGET", "LONG_BINGET"):
                stack.append(memo[arg])
            elif name == "STOP":
                return last(1)[0]
            elif name not in ("PROTO", "FRAME"):
                raise ValueError(f"instruction {name} at byte {at}: only plain values are read")
    except (IndexError, KeyError, TypeError) as error:
        raise ValueError(f"no whole pickle: {error!r}") from None
    raise ValueError("no whole pickle: it does not stop")


def _expect(value: Any, kind: type) -> Any:
    if type(value) is not kind:
        raise TypeError(f"{type(value).__name__} where a {kind.__name__} belongs")
    return value


def decode_shards(files: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Rows of shards given as (path, content): path, position in the list and `schema`'s fields.

    A shard is a list of dictionaries; keys that a dictionary lacks are null, others are left
    out. It may also be a list of lists or tuples, whose items are the fields in order.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField("path", T.StringType()), T.StructField("position", T.LongType()), *schema.fields])
    arrow = to_arrow_schema(whole, prefers_large_types=False)
    names = schema.fieldNames()

    def fields(item: Any) -> tuple:
        if isinstance(item, dict):
            return tuple(map(item.get, names))
        if isinstance(item, (list, tuple)) and len(item) == len(names):
            return tuple(item)
        raise ValueError(f"an item of the list is neither a dictionary nor {len(names)} values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = [fields(item) for item in _expect_list(plain_value(content.as_buffer().to_pybytes()), path)]
                columns = [[path.as_py()] * len(rows), range(len(rows)), *(zip(*rows) if rows else [[]] * len(names))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(values), f.type) for values, f in zip(columns, arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, whole)


def _expect_list(value: Any, path: Any) -> list:
    if type(value) is not list:
        raise ValueError(f"{path}: a {type(value).__name__} is no list of rows")
    return value


def read_foreign_shards(
    spark: SparkSession, path: str, schema: str | T.StructType, prefix: str = "",
    missing: int | None = 0, pattern: str = r"(\d+)\.pkl$",
) -> DataFrame:
    """Rows of all pickled shards whose file name contains `prefix`: shard, position, fields.

    The shard's number stands in its name; without one it is `missing`, or last for None.
    Sort by (shard, position) only where the order matters. Values must have the types that
    `schema` names; files of 2 GB and more cannot be read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{prefix}*.pkl").load(path)
    name: Column = F.element_at(F.split("path", "/"), -1)
    return decode_shards(files, schema).withColumn("shard", shard_number(name, pattern, missing)).drop("path")


def read_foreign_results(spark: SparkSession, path: str) -> DataFrame:
    """Search results pickled as one list of (ids, scores), aligned with the questions by position."""
    pairs = read_foreign_shards(
        spark, path, "doc_ids ARRAY<LONG>, scores ARRAY<DOUBLE>", pattern=r"(\d+)$")
    return pairs.select(F.col("position").alias("example_pos"), "doc_ids", "scores").to(
        T._parse_datatype_string(schemas.SEARCH_RESULTS))
