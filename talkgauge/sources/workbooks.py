"""Laid-out reports as workbooks: the data source ``workbooks`` writes one file for each report.

Rows meet by report and come in order, so a task holds one report at a time. Files get their names when all tasks are done, so a task that
is done again leaves nothing behind. Paths are of a file system that all executors mount.
"""

from __future__ import annotations

import os
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from talkgauge.sources.xlsx import workbook


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WorkbooksWriter(DataSourceWriter):
    def __init__(self, schema, options):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")

    def write(self, iterator):
        from pyspark import TaskContext

        task, written = TaskContext.get(), []
        for report, rows in groupby(iterator, key=lambda row: row["report"]):
            sheets: dict[str, list[list[object]]] = {}
            for row in rows:
                sheets.setdefault(row["sheet"], []).append([c["s"] if c["n"] is None else int(c["n"]) if c["n"] == int(c["n"]) else c["n"] for c in row["cells"]])
            os.makedirs(self.folder, exist_ok=True)
            part = f"{self.folder}/.{task.partitionId()}-{task.taskAttemptId()}-{len(written)}.part"
            with open(part, "wb") as file:
                file.write(workbook(sheets))
            written.append((part, f"{self.folder}/{os.path.basename(report)}"))
        return _Files(written)

    def commit(self, messages):
        for message in messages:
            for part, path in message.files if message else ():
                os.replace(part, path)

    def abort(self, messages):
        for message in messages:
            for part, _ in message.files if message else ():
                if os.path.exists(part):
                    os.remove(part)


class WorkbooksDataSource(DataSource):
    @classmethod
    def name(cls):
        return "workbooks"

    def schema(self):
        return "report string, sheet string, cells array<struct<s:string,n:double>>"

    def writer(self, schema, overwrite):
        return WorkbooksWriter(schema, self.options)


def write_workbooks(rows: DataFrame, folder: str) -> None:
    """Writes laid-out rows, a workbook for each report; a file of that name is replaced."""
    rows.sparkSession.dataSource.register(WorkbooksDataSource)
    ordered = rows.repartition("report").sortWithinPartitions("report", "sheet_no", "place")
    ordered.select("report", "sheet", "cells").write.format("workbooks").mode("append").save(folder)
