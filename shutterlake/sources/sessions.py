"""A sink for one ordered text document: a review session as JSON, or an audit log line by line.

Tasks write their rows, already in order, to parts beside the target. Only when
all of them have succeeded does the commit join the parts, in the order of the
partitions and a chunk at a time, to a document that then takes its name in one
step. A write that fails leaves neither parts nor document.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from shutterlake.sources.folders import _system

# The writer travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.head, self.tail = options.get("head", ""), options.get("tail", "")
        self.between = options.get("between", "\n")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        system, folder = _system(self.parts)
        system.create_dir(folder, recursive=True)
        # Attempts of one task write files of their own; only one of them is committed.
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        rows = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write(((self.between if rows else "") + row[0]).encode())
                rows += 1
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, target = _system(self.path)
        _, folder = _system(self.parts)
        unnamed = f"{folder}/document"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(unnamed) as out:
            out.write(self.head.encode())
            before = False
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                out.write(self.between.encode() if before else b"")
                before = True
                with system.open_input_stream(f"{folder}/{part.path}") as source:
                    while block := source.read(CHUNK):
                        out.write(block)
            out.write(self.tail.encode())
        system.move(unnamed, target)
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = _system(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_document"

    def schema(self) -> str:
        return "value STRING"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def _write(lines: DataFrame, path: str, **options: str) -> None:
    lines.sparkSession.dataSource.register(DocumentSink)
    lines.write.format("one_document").mode("append").options(**options).save(path)


def write_session(decisions: DataFrame, path: str, timestamp: str) -> None:
    """One JSON document: timestamp, totalSets, reviewed and the list of decisions, ordered by their paths.

    Expects original, duplicate, keepOriginal and keepDuplicate; more columns go
    into the decisions too. A set is reviewed when one of its files goes.
    """
    totals = decisions.agg(
        F.count("*").alias("all"), F.count_if(~F.col("keepOriginal") | ~F.col("keepDuplicate")).alias("reviewed")
    ).head()
    head = {"timestamp": timestamp, "totalSets": totals["all"], "reviewed": totals["reviewed"]}
    row = F.to_json(F.struct(*decisions.columns), {"ignoreNullFields": "false"})
    lines = decisions.orderBy("original", "duplicate").select(row.alias("value"))
    opened = json.dumps(head, ensure_ascii=False)[:-1] + ', "decisions": [\n'
    _write(lines, path, head=opened, between=",\n", tail="\n]}\n")


def read_session(spark: SparkSession, path: str, decision: str) -> DataFrame:
    """(timestamp, totalSets, reviewed, decisions) of a session; `decision` is the DDL of one of them."""
    ddl = f"timestamp STRING, totalSets BIGINT, reviewed BIGINT, decisions ARRAY<STRUCT<{decision}>>"
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def write_audit(plan: DataFrame, path: str, *order: str, line: Column | None = None) -> None:
    """One line per pair of a plan, in the given order: a JSON object, or `line`."""
    text = F.to_json(F.struct(*plan.columns)) if line is None else line
    _write(plan.orderBy(*order).select(F.regexp_replace(text, "\n", " ").alias("value")), path, tail="\n")
