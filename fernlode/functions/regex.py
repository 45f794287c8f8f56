"""Regular expressions in linear time: Arrow's automaton over lines, behind literals that a text must hold.

Java's matcher backtracks, so that one line can hold a task for hours; the automaton reads a line once whatever the pattern.
Look-around and back-references are therefore refused.  Classes (``\\w``, ``\\d``, ``\\s``) are Unicode's; ``\\b`` and, within
brackets, ``\\W`` and ``\\S`` are those of ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from fernlode.functions.text import ascii_lower

HITS_DDL = "array<struct<k:int,at:bigint,n:bigint>>"
_INSIDE = {"w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "d": r"\p{Nd}", "D": r"\P{Nd}", "s": r"\s\x0b\x85\p{Z}"}
_OUTSIDE = {**{k: f"[{v}]" for k, v in _INSIDE.items()}, "W": f"[^{_INSIDE['w']}]", "S": f"[^{_INSIDE['s']}]"}
_META = set("\\.+*?()|[]{}^$")


def _pieces(pattern: str):
    """(text, inside brackets) of a pattern, an escape and its letter as one piece."""
    k, inside, first = 0, False, 0
    while k < len(pattern):
        piece = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        if not inside and piece == "[":
            inside, first = True, k + (2 if pattern[k + 1 : k + 2] == "^" else 1)
            yield piece, False
        elif inside and piece == "]" and k != first:
            inside = False
            yield piece, False
        else:
            yield piece, inside
        k += len(piece)


def linear_pattern(pattern: str) -> str:
    """The pattern with Unicode's classes and groups that capture nothing; ValueError if the automaton cannot run it."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        raise ValueError(f"invalid regular expression: {pattern}: {e}") from e
    pieces = [(_INSIDE if inside else _OUTSIDE).get(p[1:], p) if p[0] == "\\" and len(p) > 1 else "\0" if p == "(" and not inside else p for p, inside in _pieces(pattern)]
    return re.sub(r"\0(?:\?P?<\w+>|(?!\?))", "(?:", "".join(pieces)).replace("\0", "(")


def required_literals(pattern: str, case: bool) -> list[str]:
    """Runs of characters that every match holds, from the outermost sequence; none where it has alternatives or flags.

    Without case they are lower-case and end before letters that have another form outside ASCII (k, s).
    """
    if re.search(r"\(\?[A-Za-z-]+[:)]|\\Q", pattern):
        return []
    runs, depth, previous = [""], 0, ""
    for piece, inside in _pieces(pattern):
        if piece == "|" and depth == 0 and not inside:
            return []
        plain = not inside and depth == 0 and (piece not in _META and len(piece) == 1 or len(piece) == 2 and not piece[1].isalnum())
        if not inside and depth == 0 and piece in ("*", "?", "{") and previous:
            runs[-1] = runs[-1][:-1]  # the character before may be absent
        if not inside and piece in "()" and len(piece) == 1:
            depth += 1 if piece == "(" else -1
        if not inside and piece == "{":
            depth += 1
        elif not inside and piece == "}":
            depth -= 1
        c = piece[-1]
        if plain and (case or c.isascii() and c.lower() not in "ks"):
            runs[-1] += c if case else c.lower()
            previous = c
        else:
            runs.append("")
            previous = ""
    return [r for r in runs if r]


def may_hold(text: Column, pattern: str, case: bool) -> Column:
    """Whether a text has the literals of a pattern; a text without one of them has no match."""
    out, own = F.lit(True), text if case else ascii_lower(text)
    for literal in required_literals(pattern, case):
        out = out & own.contains(literal)
    return out


def _cased(pattern: str, case: bool) -> str:
    return pattern if case else f"(?i:{pattern})"


def _word(byte: int) -> bool:
    return byte == 95 or 48 <= byte <= 57 or 65 <= byte <= 90 or 97 <= byte <= 122


def _marked_spans(own: pa.Array, pattern: str, case: bool) -> list[list[tuple[int, int]]]:
    """The byte spans of all matches, one after another, of each line: a replacement sets marks that occur in no line around them."""
    marks = (chr(c) for c in range(0xE000, 0xF8FF) if not pc.any(pc.match_substring(own, chr(c))).as_py())
    left, right = next(marks), next(marks)
    out = []
    for line in pc.replace_substring_regex(own, f"({_cased(pattern, case)})", f"{left}\\1{right}").to_pylist():
        spans: list[tuple[int, int]] = []
        head, *rest = line.split(left)
        at = len(head.encode())
        for part in rest:
            inner, after = part.split(right)
            end = at + len(inner.encode())
            spans.append((at, end))
            at = end + len(after.encode())
        out.append(spans)
    return out


def scan(own: pa.Array, pattern: str, case: bool, whole_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the lines that match, bytes before the first match, number of matches); ``pattern`` as ``linear_pattern`` gives it."""
    hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(own, pattern, ignore_case=not case), False))
    found = own.take(hit)
    if not whole_word:
        # Of the functions that give a place only this one reads UTF-8 as such.
        spans = pc.struct_field(pc.extract_regex_span(found, f"(?P<m>{_cased(pattern, case)})"), [0])
        at = pc.list_element(spans, 0)
        n = pc.count_substring_regex(found, pattern, ignore_case=not case)
        return hit.to_numpy(), at.to_numpy(), n.to_numpy()
    keep, at, n = [], [], []
    for k, line, spans in zip(hit.to_pylist(), found.to_pylist(), _marked_spans(found, pattern, case)):
        raw = line.encode()
        whole = [a for a, b in spans if (a == 0 or not _word(raw[a - 1])) and (b == len(raw) or not _word(raw[b]))]
        if whole:
            keep.append(k)
            at.append(whole[0])
            n.append(len(whole))
    return np.array(keep, np.int64), np.array(at, np.int64), np.array(n, np.int64)


def line_hits(own: Column, pattern: str, case: bool, whole_word: bool = False) -> Column:
    """Of an array of lines those that match: place in the array from 0, bytes before the first match, number of matches."""
    linear = linear_pattern(pattern)

    @F.arrow_udf(HITS_DDL)
    def hits(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at_line, at, n = scan(pc.list_flatten(texts).cast(pa.string()), linear, case, whole_word)
        text = np.searchsorted(starts, at_line, side="right") - 1
        fields = [pa.array(at_line - starts[text], pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
        values = pa.StructArray.from_arrays(fields, fields=[pa.field("k", pa.int32()), pa.field("at", pa.int64()), pa.field("n", pa.int64())])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), values)

    return hits.asNondeterministic()(own)  # so that a filter on it does not run it twice
