"""A search index in segments: postings by trigram for literals of any kind, and block-max postings by term for BM25.

Files are numbered in chunks of at most ``CHUNK_FILES``, shortest first, so that the files of a block of ``BLOCK_FILES`` are
alike in length.  A segment has three written tables:

* files(chunk, at, root_id, rel_path, dl, text),
* grams(gram, chunk, n, files): for three characters of a line (A-Z lower-cased; fewer before the line's end) the files of a chunk,
* terms(term, chunk, files, tfs, dls, cuts): the files of a chunk with a token, and where each block of them begins; read as a row a block.

Grams and terms are sorted by their key, so a search reads the row groups of its own keys.  Lists of a chunk are
intersected within the chunk, shortest first; no list of a whole corpus is ever put together.  Added files are a segment of their own, and
removed ones are listed (chunk, files) until ``compact`` rewrites the index.  All segments answer as one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.functions.text import LOWER, UPPER, ascii_lower, tokenize_query
from fernlode.storage import broadcast_if_small, map_batches, materialize, new_path, remove

KEY = ["root_id", "rel_path"]
CHUNK_FILES, BLOCK_FILES, CHUNK_BYTES = 1024, 8, 16 << 20
BLOCKS_A_CHUNK = CHUNK_FILES // BLOCK_FILES
#: A search whose files lie in at most so many chunks carries them in its plan; beyond it they are a written table.
PLAN_CHUNKS = 2048
GROWTH = 2
K1, B = 1.2, 0.75
CODE_BITS = 21
FOLD = str.maketrans(UPPER, LOWER)
#: Candidates with their scores that are sent to the texts; beyond them the texts are moved, once.
BROADCAST_FILES = 400_000
#: Keys of a chunk that are sent as a batch.
SENT_KEYS = 20_000
RAW = "kind string, key long, term string, chunk long, at int, n int, root_id string, rel_path string, text string, dl int, files array<int>, tfs array<int>, dls array<int>, cuts array<int>"
TOP_DDL = "chunk long, at int, root_id string, rel_path string, score long"


class SearchIndex(NamedTuple):
    """Folders of the segments, the table of removed files (or none), and the live files and tokens."""

    spark: SparkSession
    segments: tuple[str, ...]
    removed: DataFrame | None
    n: int
    tokens: int

    @property
    def avgdl(self) -> float:
        return self.tokens / self.n if self.n else 1.0

    def table(self, kind: str) -> DataFrame:
        """The written rows of all segments; those of terms as (term, block, n, max_tf, min_dl, files, tfs, dls)."""
        schema = {"files": "chunk long, at int, root_id string, rel_path string, dl int, text string", "grams": "gram long, chunk long, n int, files array<int>", "terms": "term string, chunk long, files array<int>, tfs array<int>, dls array<int>, cuts array<int>"}
        rows = self.spark.read.schema(schema[kind]).parquet(*[f"{s}/{kind}" for s in self.segments])
        return rows.select("term", F.inline(F.transform("cuts", _block))) if kind == "terms" else rows


def _block(start: Column, k: Column) -> Column:
    """The k-th block of a term's files in a chunk, which begins at ``start``; the first file of a block is the shortest."""
    n = F.coalesce(F.get("cuts", k + 1), F.size("files")) - start
    own = {c: F.slice(c, start + 1, n) for c in ("files", "tfs", "dls")}
    block = F.col("chunk") * BLOCKS_A_CHUNK + F.shiftright(F.get("files", start), BLOCK_FILES.bit_length() - 1)
    return F.struct(block.alias("block"), n.alias("n"), F.array_max(own["tfs"]).alias("max_tf"), F.get("dls", start).alias("min_dl"), *(v.alias(c) for c, v in own.items()))


def _local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the caller's as a relation of the plan itself, without tasks of their own."""
    names = [f.split(" ")[0] for f in ddl.split(", ")]
    return spark.sql("SELECT inline(from_json(:rows, :ddl))", args={"rows": json.dumps([dict(zip(names, r)) for r in rows]), "ddl": f"array<struct<{', '.join(f.replace(' ', ': ') for f in ddl.split(', '))}>>"})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def text_grams(text: str) -> np.ndarray:
    """The distinct grams of a text: three code points of 21 bits; where a line ends sooner, the rest is 0."""
    c = np.concatenate([_codes(text), np.zeros(2, np.int64)])
    c[(c >= 65) & (c <= 90)] += 32
    c[c == 10] = 0
    a, b = c[:-2], c[1:-1]
    second = b * (a > 0)
    grams = ((a << 2 * CODE_BITS) | (second << CODE_BITS) | (c[2:] * (second > 0)))[a > 0]
    grams.sort()
    return grams[np.diff(grams, prepend=-1) != 0]


def gram_ranges(pattern: str) -> list[tuple[int, int]]:
    """What a text that holds the pattern in a line has of grams: one of each range (a gram of its own for each three characters)."""
    c = [int(x) for x in _codes(pattern.translate(FOLD))]
    if len(c) >= 3:
        own = {(x << 2 * CODE_BITS) | (y << CODE_BITS) | z for x, y, z in zip(c, c[1:], c[2:])}
        return [(g, g) for g in sorted(own)]
    free = CODE_BITS * (3 - len(c))
    start = sum(x << CODE_BITS * (2 - k) for k, x in enumerate(c))
    return [(start, start + (1 << free) - 1)]


def _chunks(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(root_id, rel_path, text, words) to the rows of all three tables."""

    def batch(kind: str, size: int, **columns) -> pa.RecordBatch:
        known = {"kind": pa.array([kind]).take(pa.array(np.zeros(size, np.int64))), **columns}
        arrays = [pa.nulls(size, f.type) if f.name not in known else known[f.name] if isinstance(known[f.name], pa.Array) else pa.array(known[f.name], f.type) for f in ARROW]
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW)

    def lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.array(values[cuts[0] : cuts[-1]], pa.int32()))

    def parts(n: int) -> Iterator[tuple[int, int]]:
        return ((a, min(a + SENT_KEYS, n)) for a in range(0, n, SENT_KEYS))

    def rows_of(held: list[tuple[str, str, str, str]], chunk: int) -> Iterator[pa.RecordBatch]:
        pieces = pc.split_pattern(pa.array([r[3] for r in held], pa.string()), " ")
        file, words = np.repeat(np.arange(len(held)), np.diff(pieces.offsets.to_numpy())), pieces.flatten()
        real = pc.greater(pc.binary_length(words), 0)
        file, words = file[real.to_numpy(zero_copy_only=False)], words.filter(real)
        count = np.bincount(file, minlength=len(held))
        order = sorted(range(len(held)), key=lambda k: (count[k], held[k][0], held[k][1]))
        place = np.empty(len(held), np.int64)
        place[order] = np.arange(len(held))
        held, lengths = [held[k] for k in order], np.maximum(count[order], 1)
        same = lambda n: np.full(n, chunk, np.int64)

        yield batch("files", len(held), chunk=same(len(held)), at=np.arange(len(held)), root_id=[r[0] for r in held], rel_path=[r[1] for r in held], text=[r[2] for r in held], dl=lengths)
        grams = [text_grams(r[2]) for r in held]
        every = np.concatenate(grams)
        files = np.repeat(np.arange(len(held)), [len(g) for g in grams])
        by_gram = np.argsort(every, kind="stable")
        every, files = every[by_gram], files[by_gram]
        edges = np.append(np.flatnonzero(np.diff(every, prepend=-1)), len(every))
        for a, b in parts(len(edges) - 1):
            yield batch("grams", b - a, key=every[edges[a:b]], chunk=same(b - a), n=np.diff(edges[a : b + 1]), files=lists(edges[a : b + 1], files))

        coded = words.dictionary_encode()
        postings, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * CHUNK_FILES + place[file], return_counts=True)
        files = postings % CHUNK_FILES
        edges = np.append(np.flatnonzero(np.diff(postings // CHUNK_FILES, prepend=-1)), len(postings))
        starts = np.flatnonzero(np.diff(postings // BLOCK_FILES, prepend=-1))
        ends = np.searchsorted(starts, edges)
        cuts = starts - np.repeat(edges[:-1], np.diff(ends))
        for a, b in parts(len(edges) - 1):
            cut = edges[a : b + 1]
            yield batch("terms", b - a, term=coded.dictionary.slice(a, b - a), chunk=same(b - a), files=lists(cut, files), tfs=lists(cut, tfs), dls=lists(cut, lengths[files]), cuts=lists(ends[a : b + 1], cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (segment << 44) | (TaskContext.get().partitionId() << 24)
        held: list[tuple[str, str, str, str]] = []
        size = 0
        for b in batches:
            for root, path, text, words in zip(*(c.to_pylist() for c in b.columns)):
                held.append((root, path, text, words))
                size += len(text)
                if len(held) == CHUNK_FILES or size > CHUNK_BYTES:
                    yield from rows_of(held, chunk)
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from rows_of(held, chunk)

    return run


ARROW = pa.schema([
    ("kind", pa.string()), ("key", pa.int64()), ("term", pa.string()), ("chunk", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("root_id", pa.string()), ("rel_path", pa.string()), ("text", pa.string()), ("dl", pa.int32()),
    ("files", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int32())),
])


def _segment(corpus: DataFrame, number: int) -> tuple[str, int, int]:
    """(folder, files, tokens) of a written segment; the corpus is read once."""
    spark = corpus.sparkSession
    words = F.regexp_replace(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}]+", " ")
    raw, folder = new_path(spark, "index-raw"), new_path(spark, "index")
    own = corpus.select(*KEY, F.coalesce("text", F.lit("")).alias("text")).filter(~binary_text(F.col("text"))).withColumn("words", words.substr(F.lit(1), F.char_length("text") * 3))
    map_batches(own, _chunks(number), RAW).write.parquet(raw)  # without folders for the kinds, which would sort the rows
    read = lambda kind: spark.read.schema(RAW).parquet(raw).filter(F.col("kind") == kind)
    read("files").select("chunk", "at", *KEY, "dl", "text").write.parquet(f"{folder}/files")
    read("grams").select(F.col("key").alias("gram"), "chunk", "n", "files").repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.parquet(f"{folder}/grams")
    read("terms").select("term", "chunk", "files", "tfs", "dls", "cuts").repartitionByRange("term", "chunk").sortWithinPartitions("term", "chunk").write.parquet(f"{folder}/terms")
    remove(spark, raw)
    sums = spark.read.schema("dl int").parquet(f"{folder}/files").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    return folder, sums["n"], sums["tokens"]


def binary_text(text: Column) -> Column:
    """A NUL among the first 8192 bytes of a text."""
    return text.contains("\0") & (F.octet_length(F.substring_index(text, "\0", 1)) < 8192)


def build_index(corpus: DataFrame) -> SearchIndex:
    """The index of a corpus (root_id, rel_path, text); binary texts are left out, as every search passes over them."""
    folder, n, tokens = _segment(corpus, 0)
    return SearchIndex(corpus.sparkSession, (folder,), None, n, tokens)


def update_index(index: SearchIndex, added: DataFrame | None = None, removed: DataFrame | None = None) -> SearchIndex:
    """The index without the files ``removed`` (root_id, rel_path) and with those of ``added``; an added file replaces one of its key."""
    gone = None if removed is None else removed.select(*KEY)
    if added is not None:
        gone = added.select(*KEY) if gone is None else gone.unionByName(added.select(*KEY))
    files = index.table("files").select("chunk", "at", *KEY, "dl")
    dead = materialize(_live(index, files).join(gone.groupBy(*KEY).agg(F.count("*").alias("_n")).drop("_n"), KEY, "left_semi"), "removed", narrow=True)
    lost = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    rows = dead.select("chunk", "at")
    if index.removed is not None:
        rows = rows.unionByName(index.removed.select("chunk", F.explode("files").alias("at")))
    lists = materialize(rows.groupBy("chunk").agg(F.collect_set("at").alias("files")), "removed", narrow=True)  # at most CHUNK_FILES numbers a row
    out = index._replace(removed=lists, n=index.n - lost["n"], tokens=index.tokens - lost["tokens"])
    if added is None:
        return out
    folder, n, tokens = _segment(added, len(index.segments))
    return out._replace(segments=(*out.segments, folder), n=out.n + n, tokens=out.tokens + tokens)


def _live(index: SearchIndex, files: DataFrame) -> DataFrame:
    """``files`` (chunk, at, ...) without the removed ones."""
    if index.removed is None:
        return files
    return files.join(index.removed.withColumnRenamed("files", "_gone"), "chunk", "left").filter("_gone IS NULL OR NOT array_contains(_gone, at)").drop("_gone")


def compact(index: SearchIndex) -> SearchIndex:
    """One segment of the live files; the old folders are deleted."""
    fresh = build_index(_live(index, index.table("files")).select(*KEY, "text"))
    drop_index(index)
    return fresh


def drop_index(index: SearchIndex) -> None:
    for folder in index.segments:
        remove(index.spark, folder)


def candidates(index: SearchIndex, patterns: list[str]) -> DataFrame:
    """(p, chunk, files): the live files that hold every gram of the pattern number p in some line; one pass for all patterns.

    The longest part of a pattern without a line break counts; an empty one is in every file.
    """
    ranges = [(p, lo, hi, len(r)) for p, text in enumerate(patterns) for r in [gram_ranges(text)] for lo, hi in r]
    single = [r for r in ranges if r[1] == r[2]]
    wide = [r for r in ranges if r[1] != r[2]]
    grams, parts = index.table("grams"), []
    if single:
        wanted = _local(index.spark, [(lo, p, need) for p, lo, _, need in single], "gram long, p int, need int")  # the caller's patterns
        parts.append(grams.filter(F.col("gram").isin(sorted({r[1] for r in single}))).join(F.broadcast(wanted), "gram").select("p", "chunk", "files", "need"))
    for p, lo, hi, _ in wide:
        parts.append(grams.filter(F.col("gram").between(lo, hi)).select(F.lit(p).alias("p"), "chunk", "files", F.lit(0).alias("need")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    lists = rows.groupBy("p", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.size("files").alias("n"), "files"))).alias("l"), F.max("need").alias("need"))
    both = F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0))["files"], lambda s, x: F.array_intersect(s, x["files"]))
    files = F.when(F.col("need") == 0, F.array_distinct(F.flatten(F.transform("l", lambda x: x["files"])))).otherwise(both)
    found = lists.filter("need = 0 OR size(l) = need").select("p", "chunk", files.alias("files"))
    if index.removed is not None:
        found = found.join(index.removed.withColumnRenamed("files", "_gone"), "chunk", "left").select("p", "chunk", F.when(F.col("_gone").isNull(), F.col("files")).otherwise(F.array_except("files", "_gone")).alias("files"))
    return found.filter("size(files) > 0")


def _held(index: SearchIndex, found: DataFrame) -> tuple[DataFrame, list[int] | None]:
    """(p, chunk, at) of the candidates, and their chunks where they are few enough to prune a scan by."""
    head = found.limit(PLAN_CHUNKS + 1).collect()  # bounded: rows of at most CHUNK_FILES numbers
    if len(head) <= PLAN_CHUNKS:
        rows = [(r["p"], r["chunk"], at) for r in head for at in r["files"]]
        return F.broadcast(_local(index.spark, rows, "p int, chunk long, at int")), sorted({r["chunk"] for r in head})
    return materialize(found.select("p", "chunk", F.explode("files").alias("at")), "candidates"), None


def document_frequencies(index: SearchIndex, terms: list[str]) -> dict[str, int]:
    """Live files with each term."""
    rows = index.table("terms").filter(F.col("term").isin(terms))
    count = F.sum("n")
    if index.removed is not None:
        gone = index.removed.withColumnRenamed("files", "_gone")
        rows = rows.withColumn("chunk", _chunk_of("block")).join(gone, "chunk", "left")
        count = F.sum(F.size(F.when(F.col("_gone").isNull(), F.col("files")).otherwise(F.array_except("files", "_gone"))))
    return {r["term"]: r["df"] for r in rows.groupBy("term").agg(count.cast("long").alias("df")).collect()}  # a row a term


def _chunk_of(block: str) -> Column:
    return F.shiftright(block, BLOCKS_A_CHUNK.bit_length() - 1)


def saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _parts(index: SearchIndex, queries: list[list[str]]) -> DataFrame:
    """(p, k, term, weight): the k-th term of query p with its inverse document frequency (1 for a single term)."""
    df = document_frequencies(index, sorted({t for q in queries for t in q}))
    rows = [(p, k, t, df.get(t, 0), len(q) > 1) for p, q in enumerate(queries) for k, t in enumerate(q)]
    weights = _local(index.spark, rows, "p int, k int, term string, df long, several boolean")
    return weights.select("p", "k", "term", F.when(F.col("several"), F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).otherwise(F.lit(1.0)).alias("weight"))


def _scored(index: SearchIndex, postings: DataFrame) -> DataFrame:
    """(p, chunk, at, score) from term rows with p, k and weight; the parts of a file are added in the query's order."""
    each = postings.select("p", "k", "weight", _chunk_of("block").alias("chunk"), F.explode(F.arrays_zip("files", "tfs", "dls")).alias("f"))
    part = F.col("weight") * saturated(F.col("f.tfs"), F.col("f.dls"), index.avgdl)
    summed = each.select("p", "chunk", F.col("f.files").alias("at"), F.struct("k", part.alias("v")).alias("part")).groupBy("p", "chunk", "at").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return summed.select("p", "chunk", "at", F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["v"]) * 1_000_000).cast("long").alias("score"))


def bm25_of(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(root_id, rel_path, score) of every live file with one of the terms, from their postings alone."""
    rows = index.table("terms").filter(F.col("term").isin(terms)).join(F.broadcast(_parts(index, [terms])), "term")  # a row a term
    return _scored(index, rows).join(_live(index, index.table("files").select("chunk", "at", *KEY)), ["chunk", "at"]).select(*KEY, "score")


class Top(NamedTuple):
    """The best files as (chunk, at, root_id, rel_path, score), the chunks they lie in, and the blocks read of all that hold a term."""

    files: DataFrame
    found: int
    chunks: list[int]
    blocks_read: int
    blocks: int


def bm25_top(index: SearchIndex, terms: list[str], k: int = 50, keep: Callable[[DataFrame, list[int]], DataFrame] | None = None) -> Top:
    """The k best files by score, path and root, equal to the first k of ``bm25_of``.

    A block's bound is what its files could score with the block's largest counts and smallest length.  Blocks are read
    best first, in rounds that grow, until the k-th score so far is above every bound that is left.  ``keep`` filters the
    scored files (chunk, at, root_id, rel_path, score) of a round, in the given chunks, for searches that ask more than the terms.
    """
    spark, weights = index.spark, _parts(index, [terms])
    rows = index.table("terms").filter(F.col("term").isin(terms)).join(F.broadcast(weights), "term")  # a row a term
    most = F.sum(F.col("weight") * saturated(F.col("max_tf"), F.col("min_dl"), index.avgdl))
    # Rounded upwards, so that a bound is never below a score that is rounded to an integer.
    bounds = materialize(rows.groupBy("block").agg((F.ceil(most * 1_000_000) + 1).cast("long").alias("bound")), "bounds", narrow=True)
    total = bounds.count()
    now: list[tuple] = []
    read, size, least, mark = 0, max(4, k // BLOCK_FILES), None, None
    while True:
        open_ = bounds if least is None else bounds.filter(F.col("bound") >= least)
        # Blocks in the order of (bound, block); those up to the mark have been read.
        unseen = open_ if mark is None else open_.filter((F.col("bound") < mark[0]) | (F.col("bound") == mark[0]) & (F.col("block") > mark[1]))
        chosen = unseen.orderBy(F.desc("bound"), "block").limit(size).collect()  # the round's size
        if not chosen:
            break
        mark = (chosen[-1]["bound"], chosen[-1]["block"])
        read += len(chosen)
        blocks = [r["block"] for r in chosen]
        picked = rows.filter(F.col("block").isin(blocks)) if len(blocks) <= PLAN_CHUNKS else rows.join(F.broadcast(_local(spark, [(b,) for b in blocks], "block long")), "block")
        scored = _scored(index, picked)
        chunks = sorted({b // BLOCKS_A_CHUNK for b in blocks})
        names = index.table("files").select("chunk", "at", *KEY).filter(F.col("chunk").isin(chunks))
        found = _live(index, scored.join(names, ["chunk", "at"])).select("chunk", "at", *KEY, "score")
        found = found if least is None else found.filter(F.col("score") >= least)
        found = found if keep is None else keep(found, chunks)
        top = (found.unionByName(_local(spark, now, TOP_DDL)) if now else found).orderBy(F.desc("score"), "rel_path", "root_id").limit(k)
        now = [tuple(r) for r in top.collect()]  # k rows
        least = now[-1][-1] if len(now) == k else None
        size = min(size * GROWTH, 1 << 16)
    return Top(_local(spark, now, TOP_DDL), len(now), sorted({r[0] for r in now}), read, total)


def many_candidates(index: SearchIndex, pattern: str, files: int) -> bool:
    """Whether more than so many files hold the pattern's grams."""
    sizes = candidates(index, [pattern]).agg(F.sum(F.size("files")).alias("n")).first()["n"]
    return (sizes or 0) > files


def matching_files(index: SearchIndex, patterns: list[str]) -> DataFrame:
    """(p, chunk, at, root_id, rel_path, text, score): the candidates with their texts and BM25 scores (0 without a term), one pass for all patterns."""
    held, chunks = _held(index, candidates(index, patterns))
    near = lambda frame: frame if chunks is None else frame.filter(F.col("chunk").isin(chunks))
    texts, queries = near(index.table("files")), [tokenize_query(p) for p in patterns]
    if not any(queries):
        return texts.join(held, ["chunk", "at"]).withColumn("score", F.lit(0).cast("long"))
    names = sorted({t for q in queries for t in q})
    terms = near(index.table("terms").filter(F.col("term").isin(names)).withColumn("chunk", _chunk_of("block"))).join(F.broadcast(_parts(index, queries)), "term")  # a row a term
    # The scores meet the numbers of the files; a text is moved at most once, whatever the patterns.
    scored = held.join(_scored(index, terms.drop("chunk")), ["p", "chunk", "at"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return texts.join(broadcast_if_small(materialize(scored, "scored", narrow=True), BROADCAST_FILES), ["chunk", "at"])
