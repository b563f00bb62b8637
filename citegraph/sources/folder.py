"""Folder source: a walk on the driver finds the paths, the executors read the texts.

Hidden names are skipped, ``node_modules`` folders and ignored ones are listed as excluded, links below the root are not
followed, and what cannot be read is listed with its error. Patterns that end in ``/**`` keep whole folders unlisted.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions.text import META_NAMES, Glob

IGNORE_FILE = ".corpusignore"


def utf16_order(path: str) -> bytes:
    """Sort key of corpus order: UTF-16 code units."""
    return path.encode("utf-16-be", "surrogatepass")


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file: a line each, trimmed, without blank lines and '#' comments."""
    lines = (line.strip() for line in text.replace("\r\n", "\n").split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def read_ignore(folder: str) -> list[str]:
    """Patterns of a folder's ignore file; a missing file has none, an unreadable one raises."""
    try:
        with open(os.path.join(folder, IGNORE_FILE), encoding="utf-8") as lines:
            return parse_ignore(lines.read())
    except FileNotFoundError:
        return []


def is_meta(path: str, names: Sequence[str] = META_NAMES) -> bool:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return (name[:dot] if dot > 0 else name).lower() in names


@dataclass
class Discovery:
    """Paths relative to the root, '/'-separated, in corpus order."""

    root: str
    documents: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    not_followed: list[str] = field(default_factory=list)
    unreadable: list[tuple[str, str]] = field(default_factory=list)
    root_excluded: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, "document", None) for p in self.documents] + [(p, "excluded", None) for p in self.excluded]
        rows += [(p, "not_followed", None) for p in self.not_followed] + [(p, "unreadable", r) for p, r in self.unreadable]
        return spark.createDataFrame(rows, "path string, kind string, reason string")


def discover(root: str, ignore: Sequence[str] = (), project_ignore: Sequence[str] = (), project: str | None = None, meta_names: Sequence[str] = META_NAMES) -> Discovery:
    """Walk ``root``. ``ignore`` patterns are relative to the root, ``project_ignore`` ones to ``project`` (the working folder)."""
    found = Discovery(root)
    project = os.path.abspath(project or os.getcwd())
    base = os.path.relpath(os.path.abspath(root), project).replace(os.sep, "/")
    own, theirs = [Glob(p) for p in ignore], [Glob(p) for p in project_ignore]
    inside = base != ".." and not base.startswith("../")

    def paths(path: str):
        yield path, own
        if inside:
            yield (path if base == "." else f"{base}/{path}"), theirs

    matched = lambda path: any(g.matches(p) for p, globs in paths(path) for g in globs)
    pruned = lambda path: any(g.prunes(p) for p, globs in paths(path) for g in globs)
    if inside and base != ".":
        parts = base.split("/")
        found.root_excluded = any(g.prunes("/".join(parts[: i + 1])) for i in range(len(parts)) for g in theirs)
    found.root_excluded |= any(g.pattern == "**" for g in [*own, *theirs])
    if found.root_excluded:
        return found
    pending = [""]
    while pending:
        folder = pending.pop()
        try:
            with os.scandir(os.path.join(root, folder)) as listing:
                entries = list(listing)
        except OSError as error:
            found.unreadable.append((folder or ".", errno.errorcode.get(error.errno, "EIO")))
            continue
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name.startswith("."):
                continue
            if entry.is_symlink():
                kind = "folder" if os.path.isdir(entry.path) else "file"
                if kind == "file" and not entry.name.lower().endswith(".md") and os.path.exists(entry.path):
                    continue
                if matched(path) or pruned(path):
                    found.excluded.append(path)
                elif kind == "folder" or entry.name.lower().endswith(".md") or not os.path.exists(entry.path) and entry.name.lower().endswith(".md"):
                    found.not_followed.append(path)
                elif not os.path.exists(entry.path):
                    found.not_followed.append(path)
            elif entry.is_dir(follow_symlinks=False):
                if entry.name == "node_modules" or pruned(path):
                    found.excluded.append(path + "/")
                else:
                    pending.append(path)
            elif entry.name.lower().endswith(".md"):
                if is_meta(path, meta_names) or matched(path):
                    found.excluded.append(path)
                elif not os.access(entry.path, os.R_OK):
                    found.unreadable.append((path, "EACCES"))
                else:
                    found.documents.append(path)
    for names in (found.documents, found.excluded, found.not_followed):
        names.sort(key=utf16_order)
    found.unreadable.sort(key=lambda x: utf16_order(x[0]))
    return found


def read_documents(spark: SparkSession, found: Discovery, slices: int | None = None) -> DataFrame:
    """documents(uri, doc_ord, markdown, version). Bytes that are no UTF-8 become U+FFFD; a byte order mark stays."""
    root = os.path.abspath(found.root)
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(found.documents)], "uri string, doc_ord long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = []
                for uri in part.column(0).to_pylist():
                    with open(os.path.join(root, uri), "rb") as file:
                        texts.append(file.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["uri", "doc_ord", "markdown"])

    spread = rows.repartition(slices or max(1, min(len(found.documents), spark.sparkContext.defaultParallelism * 4)))
    return spread.mapInArrow(read, "uri string, doc_ord long, markdown string").withColumn("version", F.lit(None).cast("int"))


def in_memory(spark: SparkSession, documents: Sequence[tuple]) -> DataFrame:
    """(uri, markdown[, version]) in the order given."""
    rows = [(d[0], i, d[1], d[2] if len(d) > 2 else None) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "uri string, doc_ord long, markdown string, version int")


def meta_documents(paths: DataFrame, names: Sequence[str] = META_NAMES) -> DataFrame:
    """The paths of a table (column ``path``) that are meta documents by their base name."""
    from citegraph.functions.text import base_name

    return paths.filter(base_name(F.col("path")).isin(*names))
