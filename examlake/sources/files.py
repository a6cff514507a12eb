"""Folders with one JSON file for each paper, or a folder of them for each paper's attempts, as a data source that is read and written by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .papers import ATTEMPT, PAPER

NAME, END, DRAFTS = "exam_files", ".json", "draft"
#: Files and folders that one task reads.
FILES_A_TASK, FOLDERS_A_TASK = 2000, 200


@dataclass
class Part(InputPartition):
    """What a task reads: names of files by folder; None: all files of the folder."""

    found: list[tuple[str, list[str] | None]]


def _opened(options) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(options["path"])
    return system, root.rstrip("/")


def _names(system: fs.FileSystem, path: str, kind: fs.FileType) -> list[str]:
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == kind)


def _ids(system: fs.FileSystem, path: str) -> list[str]:
    """Ids of a folder's files; drafts and files that are still being written have none."""
    return [n.removesuffix(END) for n in _names(system, path, fs.FileType.File) if n.endswith(END) and not n.startswith((DRAFTS, "."))]


def _plain(name: object) -> bool:
    return isinstance(name, str) and name not in ("", ".", "..") and "/" not in name


class ExamFilesReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.nested = dict(options), str(options.get("nested", "false")).lower() == "true"
        self.wanted = {name: set(json.loads(options[name])) for name in ("ids", "folders") if name in options}

    def partitions(self) -> list[Part]:
        system, root = _opened(self.options)
        ids = sorted(filter(_plain, self.wanted["ids"])) if "ids" in self.wanted else None
        if self.nested:
            folders = sorted(filter(_plain, self.wanted["folders"])) if "folders" in self.wanted else _names(system, root, fs.FileType.Directory)
            return [Part([(folder, ids) for folder in folders[k : k + FOLDERS_A_TASK]]) for k in range(0, len(folders), FOLDERS_A_TASK)]
        names = _ids(system, root) if ids is None else ids
        return [Part([("", names[k : k + FILES_A_TASK])]) for k in range(0, len(names), FILES_A_TASK)]

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # there is nothing to read
            return
        system, root = _opened(self.options)
        for folder, ids in part.found:
            place = f"{root}/{folder}".rstrip("/")
            for name in _ids(system, place) if ids is None else ids:
                if name.startswith(DRAFTS):
                    continue
                try:
                    with system.open_input_stream(f"{place}/{name}{END}") as stream:
                        text = stream.read().decode("utf-8")
                    whole = isinstance(json.loads(text), dict)
                    yield (folder, name, text, None) if whole else (folder, name, None, "no object")
                except FileNotFoundError:
                    continue  # never there, or deleted since it was listed
                except (ValueError, RecursionError) as problem:
                    yield folder, name, None, f"damaged: {type(problem).__name__}"


class ExamFilesWriter(DataSourceWriter):
    """Each file is written beside its place and moved there, so readers see the old or the new one; a task that is run again writes the same files again."""

    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _opened(self.options)
        for row in rows:
            if not _plain(row.id) or row.id.startswith((DRAFTS, ".")) or not (_plain(row.folder) or row.folder in (None, "")):
                raise ValueError(f"no name of a file: {row.folder!r}, {row.id!r}")
            place = f"{root}/{row.folder or ''}".rstrip("/")
            system.create_dir(place, recursive=True)
            staged = f"{place}/.{row.id}-{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as stream:
                stream.write(row.json.encode("utf-8"))
            system.move(staged, f"{place}/{row.id}{END}")
        return WriterCommitMessage()


class ExamFiles(DataSource):
    """folder, id, json, error: a row for each file; damaged ones have an error in place of their text.

    Options: nested (files lie in one folder a paper), ids and folders (JSON lists: the only ones that are looked at). Keys are options and not filters
    that Spark pushes down: with those, a DataFrame that stood in several places of a plan gave rows that one place's filter should have left out (4.1.2).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "folder string, id string, json string, error string"

    def reader(self, schema) -> ExamFilesReader:
        return ExamFilesReader(self.options)

    def writer(self, schema, overwrite: bool) -> ExamFilesWriter:
        return ExamFilesWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known to it."""
    spark.dataSource.register(ExamFiles)
    return spark


def exam_files(spark: SparkSession, path: str, nested: bool = False, ids: Iterable[str] | None = None, folders: Iterable[str] | None = None) -> DataFrame:
    """The files in a folder (ExamFiles); with ids, and folders where nested, these files alone are opened, and nothing is listed if it needn't be."""
    reader = registered(spark).read.format(NAME).option("nested", nested)
    for name, wanted in (("ids", ids), ("folders", folders)):
        reader = reader if wanted is None else reader.option(name, json.dumps(sorted(wanted)))
    return reader.load(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (id, json and perhaps folder) as files, in place of those that have their names."""
    folder = F.col("folder") if "folder" in rows.columns else F.lit("")
    registered(rows.sparkSession)
    rows.select(folder.alias("folder"), "id", "json", F.lit(None).cast("string").alias("error")).write.format(NAME).mode("append").save(path)


def _read(files: DataFrame, schema: str) -> DataFrame:
    return files.where("error is null").select(F.from_json("json", schema).alias("p")).where("p.id is not null").select("p.*")


def papers_in(files: DataFrame) -> DataFrame:
    """Papers (PAPER) of exam_files(); damaged files and those without an id are passed over."""
    return _read(files, PAPER)


def attempts_in(files: DataFrame) -> DataFrame:
    """Attempts (ATTEMPT) of nested exam_files(), newest first."""
    return _read(files, ATTEMPT).orderBy(F.desc("id"), "paper_id")


def damaged(files: DataFrame) -> DataFrame:
    """error, n: how many files gave no row, by what was wrong."""
    return files.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
