"""Read-only git source: text of status, diff, log, blame and show, and the churn of a history as a table."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.sources.logs import parse_numstat

MAX_CHARS = 20_000
#: What each operation runs, and what each detail of a diff adds.
COMMANDS = {"status": ["status", "--short", "--branch"], "diff": ["diff"], "log": ["log", "--oneline"], "blame": ["blame"], "show": ["show"]}
DETAILS = {"summary": ["--shortstat"], "files": ["--name-status"], "patches": [], "full": []}


class GitError(ValueError):
    pass


def _run(root: str, arguments: list[str]) -> str:
    done = subprocess.run(["git", "--no-pager", "-C", root, *arguments], capture_output=True, text=True, errors="replace", stdin=subprocess.DEVNULL)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git ended with {done.returncode}")
    return done.stdout


def git(root: str, op: str, path: str | None = None, rev: str | None = None, detail: str = "patches", staged: bool = False, limit: int = 50, max_chars: int = MAX_CHARS) -> str:
    """Text of a read-only operation, cut at ``max_chars`` with a note of it.

    A path must stay below the root and neither it nor a revision may look like an option.
    """
    if op not in COMMANDS:
        raise GitError(f"unknown operation {op}")
    for value in (path, rev):
        if value is not None and (value.startswith("-") or "\x00" in value):
            raise GitError(f"not allowed: {value!r}")
    if path is not None and (path.startswith("/") or ".." in path.split("/")):
        raise GitError(f"outside the root: {path}")
    if op == "blame" and path is None:
        raise GitError("blame needs a path")
    if max_chars < 1:
        raise GitError("max_chars must be positive")
    after = [*([rev] if rev else []), *(["--", path] if path else [])]
    if op == "diff":
        flags = ["--cached"] if staged else []
        if detail == "bundle":
            text = "\n".join(_run(root, ["diff", *flags, *DETAILS[part], *after]).rstrip("\n") for part in ("summary", "files", "patches"))
        elif detail in DETAILS:
            text = _run(root, ["diff", *flags, *DETAILS[detail], *after])
        else:
            raise GitError(f"unknown detail {detail}")
    else:
        text = _run(root, [*COMMANDS[op], *([f"-{max(limit, 1)}"] if op == "log" else []), *after])
    return text if len(text) <= max_chars else f"{text[:max_chars]}\n… {len(text) - max_chars} more characters"


def history(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """(commit, insertions, deletions, path) of every file that each commit changes."""
    if rev.startswith("-"):
        raise GitError(f"not allowed: {rev!r}")
    text = _run(root, ["log", "--no-renames", "--format=%x01%H", "--numstat", rev])
    commits = [(part[:40], part[40:].strip("\n").replace("\n", "\x00")) for part in text.split("\x01")[1:]]
    rows = spark.createDataFrame(commits, "commit string, body string")
    return rows.select("commit", F.inline(parse_numstat(F.col("body"))))
