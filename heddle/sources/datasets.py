"""Data sets by name: where their files are, what they hold, and how a row becomes an example.

A data set is registered once, with a format, a schema and an adapter; `scan` finds it by its name and gives rows of one shape. Reading is Spark's own: a task for
each piece of a file, columns that nobody asks for are not read, and the task and other filters stand directly on the scan, where formats that can take
them do. Lines without text are no rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The common shape.
EXAMPLE = ["task", "id", "context", "question", "answers"]


@dataclass(frozen=True)
class DataSet:
    """path is below the root that `scan` is given, "" the root itself. columns: those of EXAMPLE, as expressions over a row; what is left out is empty.
    needs_task: scans without a task are refused. task_folder: the files lie in folders task=<name>."""

    format: str
    path: str
    columns: dict[str, Callable[[], Column]]
    schema: str | None = None
    needs_task: bool = False
    task_folder: bool = False


_SETS: dict[str, DataSet] = {}


def register(name: str, found: DataSet) -> None:
    if name in _SETS:
        raise ValueError(f"there is a data set {name} already")
    if unknown := set(found.columns) - set(EXAMPLE):
        raise ValueError(f"{name} has columns that examples do not have: {sorted(unknown)}")
    if found.format not in ("parquet", "jsonl", "csv"):
        raise ValueError(f"no format {found.format}")
    _SETS[name] = found


def names() -> list[str]:
    return sorted(_SETS)


def scan(spark: SparkSession, name: str, root: str, task: str | None = None, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """The examples of a data set: task, id, context, question, answers. task: only those of one task; where: a filter over the data set's own columns;
    limit: at most so many rows, after the filters."""
    if name not in _SETS:
        raise ValueError(f"no data set {name}; there are {names()}")
    found = _SETS[name]
    if found.needs_task and task is None:
        raise ValueError(f"{name} is read by task")
    if limit is not None and limit < 0:
        raise ValueError("a limit is no negative number")
    path = f"{root}/{found.path}" if found.path else root
    if found.format == "parquet":
        rows = spark.read.parquet(path)
    elif found.format == "csv":
        rows = spark.read.schema(found.schema).csv(path, header=True)
    else:  # a line without text is no row, and one that is no JSON an error
        rows = spark.read.schema(f"{found.schema}, task string" if found.task_folder else found.schema).json(path, mode="FAILFAST")
    if where is not None:
        rows = rows.where(where)
    if task is not None:
        rows = rows.where((F.col("task") if found.task_folder else found.columns["task"]()) == task)
    empty = {"task": F.lit(name), "id": F.lit(None).cast("long"), "context": F.lit(""), "question": F.lit(""), "answers": F.array().cast("array<string>")}
    own = {c: f() for c, f in found.columns.items()} | ({"task": F.col("task")} if found.task_folder else {})
    out = rows.select(*(own.get(c, empty[c]).alias(c) for c in EXAMPLE))
    return out if limit is None else out.limit(limit)


register("probes", DataSet("parquet", "benchmark.parquet", {"task": lambda: F.lit("probe"), "id": lambda: F.col("item_id"), "context": lambda: F.col("text")}))
register("corpus", DataSet("parquet", "documents.parquet", {"task": lambda: F.col("lang"), "id": lambda: F.col("doc_id"), "context": lambda: F.col("text"), "answers": lambda: F.array("source")}))
register("lines", DataSet("jsonl", "", {"id": lambda: F.col("id"), "context": lambda: F.col("context")}, "id long, context string", task_folder=True))
