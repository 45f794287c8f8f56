"""Catalog snapshots: ignore-aware directory scans, host-fed files, and their bodies."""

from __future__ import annotations

import os
import re
import warnings
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernlode.functions.text import glob_regex, normalize_path

MAX_ENTRIES = 100_000
# Directories that are never entered.
PRUNED = (".git", "node_modules", ".build", "target")
CATALOG_DDL = "root_id string, rel_path string, abs_path string, size long"


class IgnoreRules:
    """Patterns of one ignore file: later ones win, '!' re-includes, a trailing '/' means directories only."""

    def __init__(self, text: str, base: str = ""):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.lstrip("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            rule = glob_regex(line) if "/" not in line else "^" + glob_regex("/" + line.lstrip("/"))[2:]
            self.rules.append((re.compile(rule), keep, only_dirs))

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        """True ignored, False kept, None no rule."""
        if self.base and not rel.startswith(self.base + "/"):
            return None
        own = rel[len(self.base) + 1 :] if self.base else rel
        out = None
        for pattern, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(own):
                out = not keep
        return out


def _list(root: str, rel_dir: str, rules: list[IgnoreRules]) -> tuple[list[os.DirEntry], list[str], list[IgnoreRules]]:
    """(files, folders to enter, rules that hold below) of one folder."""
    here = os.path.join(root, rel_dir)
    rules = rules + _read_rules(os.path.join(here, ".gitignore"), rel_dir)
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError as e:
        warnings.warn(f"folder skipped: {here}: {e.strerror}", RuntimeWarning, stacklevel=2)
        return [], [], rules
    files, folders = [], []
    for e in entries:
        rel = f"{rel_dir}/{e.name}" if rel_dir else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        if is_dir and e.name in PRUNED:
            continue
        verdicts = [v for r in rules if (v := r.verdict(rel, is_dir)) is not None]
        if verdicts and verdicts[-1]:
            continue
        if is_dir:
            folders.append(rel)
        elif e.is_file(follow_symlinks=False):
            files.append(e)
    return files, folders, rules


def _sized(entries: list[os.DirEntry]) -> Iterator[tuple[os.DirEntry, int]]:
    """The files with their sizes; one that has gone since its folder was read is left out."""
    for e in entries:
        try:
            yield e, e.stat().st_size
        except FileNotFoundError:
            continue


class Wanted(NamedTuple):
    """The entries that a scan asks for, tested before a folder is listed or a file's size is read."""

    prefix: str = ""
    suffix: str = ""
    min_size: int = 0
    max_size: int | None = None

    def folder(self, rel: str) -> bool:
        """Whether an entry below the folder can be wanted."""
        return self.prefix.startswith(f"{rel}/") or f"{rel}/".startswith(self.prefix)

    def file(self, rel: str) -> bool:
        return rel.startswith(self.prefix) and rel.endswith(self.suffix)

    def size(self, size: int) -> bool:
        return size >= self.min_size and (self.max_size is None or size <= self.max_size)


def walk(root: str, root_id: str, units: list[tuple[str, bool]] | None = None, wanted: Wanted | None = None) -> Iterator[tuple[str, str, str, int]]:
    """Regular files under ``root`` that no ignore file excludes and that are ``wanted``; hidden files count.

    ``units`` are the folders to list, each with whether those below it are walked; without them the whole root is.
    """
    wanted = wanted or Wanted()
    for top, deep in [("", True)] if units is None else units:
        stack = [(top, _rules_above(root, top))]
        while stack:
            rel_dir, above = stack.pop()
            files, folders, rules = _list(root, rel_dir, above)
            base = f"{rel_dir}/" if rel_dir else ""
            own = [e for e in files if wanted.file(base + e.name)]
            yield from ((root_id, base + e.name, e.path, size) for e, size in _sized(own) if wanted.size(size))
            if deep:
                stack += [(rel, rules) for rel in folders if wanted.folder(rel)]


def frontier(root: str, wanted: Wanted, units: int) -> list[tuple[str, bool]]:
    """The root as units of work: the widest folders opened first until there are ``units``; at most as many are listed.

    A folder with most of a root's files below it is opened like any other, so that its own folders are dealt out.
    """
    queue = deque([("", _rules_above(root, ""))])
    opened: list[tuple[str, bool]] = []
    while queue and len(opened) < units and len(opened) + len(queue) < 2 * units:
        rel_dir, above = queue.popleft()
        _, folders, rules = _list(root, rel_dir, above)
        opened.append((rel_dir, False))
        queue.extend((rel, rules) for rel in folders if wanted.folder(rel))
    return opened + [(rel, True) for rel, _ in queue]


def _rules_above(root: str, rel_dir: str) -> list[IgnoreRules]:
    """The rules that hold in a folder before its own: those of the root and of the folders on the way."""
    rules = _read_rules(os.path.join(root, ".git/info/exclude"), "")
    parts = rel_dir.split("/") if rel_dir else []
    for k in range(len(parts)):
        rules = rules + _read_rules(os.path.join(root, *parts[:k], ".gitignore"), "/".join(parts[:k]))
    return rules


def _read_rules(path: str, base: str) -> list[IgnoreRules]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return [IgnoreRules(f.read(), base)]
    except OSError:
        return []


class CatalogSource(DataSource):
    """``spark.read.format("fernlode_catalog").option("roots", "id=path;id=path")``: each root's folders are dealt to up to ``tasks`` tasks.

    The options prefix, suffix, minSize and maxSize narrow the scan.  They are options and not filters that Spark pushes down, for
    Spark keeps the pushed filters of a Python source with the DataFrame: one that is used again without them would lose rows.
    """

    @classmethod
    def name(cls) -> str:
        return "fernlode_catalog"

    def schema(self) -> str:
        return CATALOG_DDL

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(self.options)


class _CatalogReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [tuple(r.split("=", 1)) for r in options["roots"].split(";") if r]
        self.tasks = max(int(options.get("tasks", "1")), 1)
        most = options.get("maxSize")
        self.wanted = Wanted(options.get("prefix", ""), options.get("suffix", ""), int(options.get("minSize", "0")), None if most is None else int(most))

    def partitions(self) -> list[InputPartition]:
        out = []
        for root_id, path in self.roots:
            units = frontier(path, self.wanted, 4 * self.tasks)
            out += [InputPartition((root_id, path, own)) for k in range(self.tasks) if (own := units[k :: self.tasks])]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root_id, path, units = partition.value
        yield from walk(path, root_id, units, self.wanted)


def scan(spark: SparkSession, roots: dict[str, str], prefix: str = "", suffix: str = "", min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """The catalog of local roots that all executors see: entries whose path starts and ends so, of a size within the bounds."""
    spark.dataSource.register(CatalogSource)
    reader = spark.read.format(CatalogSource.name()).option("roots", ";".join(f"{k}={v}" for k, v in roots.items())).option("tasks", spark.sparkContext.defaultParallelism)
    reader = reader.option("prefix", prefix).option("suffix", suffix).option("minSize", min_size)
    return (reader if max_size is None else reader.option("maxSize", max_size)).load()


def finalize(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, list[str]]:
    """The snapshot in (path, root) order, and a diagnostic if it was cut."""
    total = entries.count()
    rows = entries.orderBy("rel_path", "root_id", "abs_path").limit(max_entries)
    return rows, [f"catalog truncated to {max_entries} of {total} entries"] if total > max_entries else []


def host_files(spark: SparkSession, files: list[tuple[str, bytes]], root_id: str = "host") -> DataFrame:
    """A corpus of (path, bytes) pairs; paths that leave the root are refused."""
    rows = []
    for path, data in files:
        rel = normalize_path(path)
        if rel is None or path.startswith("/"):
            raise ValueError(f"path leaves the root: {path}")
        rows.append((root_id, rel, f"{root_id}:{rel}", len(data), bytearray(data)))
    return spark.createDataFrame(rows, CATALOG_DDL + ", content binary")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path of any store as (abs_path, size, content), by Spark's own reader; it passes over hidden and empty files, so left-join a catalog to it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("abs_path"), F.col("length").alias("size"), "content")


def decode(content: str = "content"):
    """Text of a binary column with invalid UTF-8 replaced."""
    return F.make_valid_utf8(F.col(content).cast("string"))
