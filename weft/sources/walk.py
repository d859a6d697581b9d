"""Files of a directory tree: deterministic, pruned before descending, binaries refused."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.native import SNIFFED, looks_binary, tap_file
from weft.functions.text import AUDIO, IMAGE, MIME, glob_regex

# --- fixed values ----------------------------------------------------------------------------------------------------

SKIPPED_DIRS = {".git", "node_modules", "__pycache__", ".hg", ".svn", "target", "build", ".venv", "venv"}
#: Extensions of binary formats, refused without a look at the content. Images and sounds are let in before.
BINARY = set(
    "png jpg jpeg gif webp ico bmp tiff pdf zip gz bz2 xz zst tar 7z rar exe dll so dylib a o bin dat db sqlite wasm mp3 mp4 wav ogg flac "
    "avi mkv mov ttf otf woff woff2 gguf ape tvim pyc class jar".split()
)

# ---------------------------------------------------------------------------------------------------------------------

DB_DIR = ".weft"
IGNORE_FILE = ".weftignore"
SCHEMA = "relpath string, abspath string, mtime long, size long, mime string, modality string"


def extension_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def mime_of_path(path: str) -> str:
    return MIME.get(extension_of(path), "text/plain")


def modality_of_path(path: str) -> str:
    ext = extension_of(path)
    return "image" if ext in IMAGE else "audio" if ext in AUDIO else "text"


def glob(pattern: str, path: str) -> bool:
    import re

    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), path) is not None


@dataclass
class Rules:
    """What is admitted. ignore: (pattern, only directories)."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ignore: list[tuple[str, bool]] = field(default_factory=list)
    db_dir: str = DB_DIR

    @classmethod
    def of(cls, root: str, include: list[str] = (), exclude: list[str] = (), db_dir: str = DB_DIR) -> Rules:
        rules = cls(list(include), list(exclude), [], db_dir)
        try:
            with open(os.path.join(root, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
                rules.ignore = parse_ignore(f.read())
        except OSError:
            pass
        return rules

    def dir(self, rel: str, name: str) -> bool:
        if name.startswith(".") or name in SKIPPED_DIRS or name == self.db_dir:
            return False
        return not any(glob(p, rel) for p, _ in self.ignore)

    def file(self, rel: str, name: str) -> bool:
        if name.startswith(".") or any(glob(p, rel) for p, only_dir in self.ignore if not only_dir):
            return False
        if any(glob(p, rel) for p in self.exclude):
            return False
        return not self.include or any(glob(p, rel) for p in self.include)


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """One pattern per line; what follows a # is a comment; a trailing slash means directories only."""
    lines = (line.partition("#")[0].strip() for line in text.splitlines())
    return [(p.rstrip("/"), p.endswith("/")) for p in lines if p.rstrip("/")]


def readable(path: str) -> bool:
    """Whether a file may be text: its extension is of no binary format, and its first bytes are UTF-8."""
    ext = extension_of(path)
    if ext in IMAGE or ext in AUDIO:
        return True
    if ext in BINARY:
        return False
    try:
        with open(path, "rb") as f:
            return not looks_binary(f.read(SNIFFED))
    except OSError:
        return False


def walk_names(root: str, rules: Rules) -> Iterator[tuple[str, str]]:
    """(relative, absolute) paths that names alone admit: files of a directory in order, then its directories."""
    stack = [""]
    while stack:
        rel = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            continue
        dirs = []
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                if rules.dir(path, e.name):
                    dirs.append(path)
            elif e.is_file() and rules.file(path, e.name):
                yield path, os.path.join(root, path)
        stack.extend(reversed(dirs))


def entry_of(rel: str, path: str) -> tuple | None:
    if not readable(path):
        return None
    try:
        st = os.stat(path)
    except OSError:
        return None
    return rel, path, int(st.st_mtime), st.st_size, mime_of_path(rel), modality_of_path(rel)


@dataclass
class _Slice(InputPartition):
    paths: list[tuple[str, str]]


class _WalkReader(DataSourceReader):
    SLICE = 500

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        split = lambda name: [x for x in options.get(name, "").split("\n") if x]
        self.rules = Rules.of(self.root, split("include"), split("exclude"), options.get("db_dir", DB_DIR))

    def partitions(self) -> list[InputPartition]:
        names = list(walk_names(self.root, self.rules))
        return [_Slice(names[i : i + self.SLICE]) for i in range(0, len(names), self.SLICE)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        # names are listed once by the driver, contents are looked at by the tasks
        for rel, path in partition.paths:
            if found := entry_of(rel, path):
                yield found


class WalkSource(DataSource):
    """spark.read.format("weft_walk").option("path", dir): the admitted files of a tree that all executors can read."""

    @classmethod
    def name(cls) -> str:
        return "weft_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WalkReader(self.options)


def walk(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), db_dir: str = DB_DIR) -> DataFrame:
    spark.dataSource.register(WalkSource)
    return (
        spark.read.format("weft_walk").option("path", root).option("include", "\n".join(include)).option("exclude", "\n".join(exclude))
        .option("db_dir", db_dir).load()
    )


def with_identity(files: DataFrame, paranoid: bool = False) -> DataFrame:
    """files and ``tap_hash``, ``full_hash`` (only if ``paranoid``), ``docid``; unreadable files have nulls."""
    types = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tap = [tap_file(p) for p in batch["abspath"]]
            full = [tap_file(p, True) if paranoid else None for p in batch["abspath"]]
            yield batch.assign(tap_hash=tap, full_hash=full, docid=full if paranoid else tap)

    return files.mapInPandas(identify, types + ", tap_hash string, full_hash string, docid string")


def with_content(files: DataFrame) -> DataFrame:
    """files and ``content`` binary, read by the tasks."""
    types = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)

    def content(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                yield part.assign(content=[content(p) for p in part["abspath"]])

    return files.mapInPandas(read, types + ", content binary")
