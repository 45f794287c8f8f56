"""Chains and replay rings as keyed state of Structured Streaming.

State is per key in RocksDB and comes back from the query's checkpoint, so a lost executor or a restarted query goes on
where it was; nothing is read again from the output.  The session must name the RocksDB provider: ``state_session``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fernlode.functions.hashing import ledger_identity
from fernlode.operators.chains import label_identity

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows (or frames and subscribers of packed ones) that a task holds at a time of what a tape's subscribers get.
RING_ROWS = 20_000
PACKED_RING = "origin string, subscribers array<string>, seqs array<long>, sessions array<string>, payloads array<string>"
RING_COLUMNS = ["tape", "origin", "subscribers", "seqs", "sessions", "payloads"]
CHAIN_COLUMNS = ["log_id", "seq", "payload", "prev_hash", "record_hash"]


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one is left as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


class _Chain(StatefulProcessor):
    """Value state: the next seq and the head of a log.  List state: records that came before one that is still missing.

    Without ``dense`` any seq past the last one is the next, in the order of each trigger.
    """

    def __init__(self, dense: bool):
        self.dense = dense

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, head string")
        self.early = handle.getListState("early", "seq long, payload string, digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], _timers) -> Iterator[pd.DataFrame]:
        # Each call of a state is a message to the executor: none that only asks whether there is one.
        following, head = self.head.get() or (0, "")
        own = {int(s): (p, d) for s, p, d in self.early.get()}
        waited = len(own)
        for frame in rows:
            for s, p, d in zip(frame["seq"], frame["payload"], frame["event_hash"]):
                if s >= following:  # earlier ones are in the chain: they were delivered again
                    own.setdefault(int(s), (p, d))
        out = []
        for seq in sorted(own):
            if self.dense and seq != following:
                break
            following = seq
            payload, digest = own.pop(following)
            previous, head = head, hashlib.sha256((head + digest).encode()).hexdigest()
            out.append((key[0], following, payload, previous, head))
            following += 1
        self.head.update((following, head))
        if own:
            self.early.put([(s, p, d) for s, (p, d) in sorted(own.items())])
        elif waited:
            self.early.clear()
        yield pd.DataFrame(dict(zip(CHAIN_COLUMNS, zip(*out))) if out else None, columns=CHAIN_COLUMNS)

    def close(self) -> None:
        pass


def _append_chains(records: DataFrame, payload: Column, digest: Column, dense: bool) -> DataFrame:
    rows = records.filter("log_id IS NOT NULL AND seq IS NOT NULL").select("log_id", F.col("seq").cast("long").alias("seq"), payload.alias("payload"), digest.alias("event_hash"))
    dtype = records.schema["log_id"].dataType.simpleString()
    return rows.groupBy("log_id").transformWithStateInPandas(_Chain(dense), f"log_id {dtype}, seq long, payload string, prev_hash string, record_hash string", "append", "none")


def append_ledger(records: DataFrame) -> DataFrame:
    """records(log_id, seq, kind_json), a stream, appended to the chain of each log: with prev_hash and record_hash.

    A record that comes again is left out, one that comes early waits for those before it; records without log or seq are
    dropped.  A trigger's records of one log are held by one task, so the source's rate limit bounds its memory.
    """
    out = _append_chains(records, F.col("kind_json"), ledger_identity(F.col("seq"), F.col("kind_json")), True)
    return out.withColumnRenamed("payload", "kind_json")


def append_labels(labels: DataFrame) -> DataFrame:
    """labels(run_id, seq, outcome, source), a stream, sealed as one chain a run, as ``chains.seal_labels`` seals a whole table.

    seq may have gaps but must not fall from trigger to trigger within a run: what is not past the last one was delivered before.
    """
    rows = labels.withColumnRenamed("run_id", "log_id")
    out = _append_chains(rows, F.to_json(F.struct("outcome", "source")), label_identity(), False)
    kept = F.from_json("payload", "outcome string, source string")
    return out.select(F.col("log_id").alias("run_id"), "seq", kept["outcome"].alias("outcome"), kept["source"].alias("source"), F.col("record_hash").alias("chained_hash"))


class _Ring(StatefulProcessor):
    """List state: the last frames of a tape.  Map state: its subscribers."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq long, session string, payload string")
        self.subscribers = handle.getMapState("subscribers", "subscriber string", "session string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], _timers) -> Iterator[pd.DataFrame]:
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        known = {k[0]: v[0] for k, v in self.subscribers.iterator()} if self.subscribers.exists() else {}
        news = pd.concat(list(rows)).sort_values("at", kind="stable")
        text = lambda v: None if pd.isna(v) else v
        rows_of = lambda f: [(int(r.seq), text(r.session), text(r.payload)) for r in f.itertuples(index=False)]
        joining = news["subscriber"].notna()
        self.ring.put((ring + rows_of(news[~joining].tail(self.keep)))[-self.keep :])
        for name, session in dict(zip(news[joining]["subscriber"], news[joining]["session"])).items():
            self.subscribers.updateValue((name,), (text(session),))
        yield from _served(key[0], self.keep, ring, known, news, text, packed=True)

    def close(self) -> None:
        pass


def _served(tape, keep: int, ring: list[tuple], known: dict[str, str | None], news: pd.DataFrame, text, packed: bool = False) -> Iterator[pd.DataFrame]:
    """What the subscribers get of a trigger's rows, in frames of about RING_ROWS rows: a tape's rows for all of them can be far more than what came.

    ``packed``: a row for all frames that the same subscribers see, which between two joins are few.
    """
    seeing: dict[str | None, np.ndarray] = {}  # the subscribers of a frame, by its session
    sent: list[tuple[np.ndarray, tuple, str]] = []
    size, widest, held = 0, 0, set()
    for r in news.itertuples(index=False):
        session, subscriber = text(r.session), text(r.subscriber)
        if subscriber is None:
            frame = (int(r.seq), session, text(r.payload))
            ring.append(frame)
            if len(ring) >= 2 * keep:  # evicted in runs, so that a frame is moved once
                ring = ring[-keep:]
            if session not in seeing:
                seeing[session] = np.array([s for s, own in known.items() if _sees(own, session)], object)
            to = [(seeing[session], frame, "live")]
        else:
            last, alone = ring[-keep:], np.array([subscriber], object)
            to = [(alone, f, "replay") for f in last if f[0] > r.seq and _sees(session, f[1])]
            known[subscriber] = session
            seeing.clear()
        to = [x for x in to if len(x[0])]
        for names, *_ in to:
            size += 1 if packed and id(names) in held else len(names)
            held.add(id(names))
            widest = max(widest, len(names))
        sent += to
        if size >= (max(RING_ROWS, 4 * widest) if packed else RING_ROWS) or len(sent) >= RING_ROWS:
            yield (_packed_frame if packed else _ring_frame)(tape, sent)
            sent, size, widest, held = [], 0, 0, set()
    yield (_packed_frame if packed else _ring_frame)(tape, sent)


def _ring_frame(tape, sent: list[tuple[np.ndarray, tuple, str]]) -> pd.DataFrame:
    times = [len(names) for names, _, _ in sent]
    columns = [np.repeat(np.array(v, object), times) for v in ([f[0] for _, f, _ in sent], [f[1] for _, f, _ in sent], [f[2] for _, f, _ in sent], [o for _, _, o in sent])]
    names = np.concatenate([np.array([], object), *(n for n, _, _ in sent)])
    return pd.DataFrame({"tape": [tape] * len(names), "subscriber": names, "seq": columns[0], "session": columns[1], "payload": columns[2], "origin": columns[3]})


def _packed_frame(tape, sent: list[tuple[np.ndarray, tuple, str]]) -> pd.DataFrame:
    runs: dict[int, tuple[np.ndarray, str, list[tuple]]] = {}
    for names, frame, origin in sent:
        runs.setdefault(id(names), (names, origin, []))[2].append(frame)
    rows = [(tape, origin, names.tolist(), *([f[k] for f in frames] for k in range(3))) for names, origin, frames in runs.values()]
    return pd.DataFrame(dict(zip(RING_COLUMNS, zip(*rows))) if rows else None, columns=RING_COLUMNS)


def _sees(own: str | None, session: str | None) -> bool:
    return own is None or session is None or own == session


def replay_ring(frames: DataFrame, subscriptions: DataFrame, keep: int) -> DataFrame:
    """Frames of each tape to its subscribers: at most the last ``keep`` ones when they come, then every one that follows.

    frames(tape, at, seq, session, payload) and subscriptions(tape, at, subscriber, after, session) are streams, ``at`` the
    order within a tape.  A subscriber gets frames with seq past its ``after``, of its session or of none; without a session
    all.  One that subscribes again is served again from the ring.  Frames that left the ring are gone for late subscribers.
    """
    return ring_rows(replay_ring_packed(frames, subscriptions, keep))


def replay_ring_packed(frames: DataFrame, subscriptions: DataFrame, keep: int) -> DataFrame:
    """``replay_ring`` before ``ring_rows``: a row for the frames that the same subscribers see, which grows with what came and not with its square."""
    none = F.lit(None).cast("string")
    a = frames.select("tape", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), "session", "payload", none.alias("subscriber"))
    b = subscriptions.filter("subscriber IS NOT NULL").select("tape", F.col("at").cast("long").alias("at"), F.coalesce("after", F.lit(-1)).cast("long").alias("seq"), "session", none.alias("payload"), F.col("subscriber").cast("string").alias("subscriber"))
    dtype = frames.schema["tape"].dataType.simpleString()
    return a.unionByName(b).groupBy("tape").transformWithStateInPandas(_Ring(keep), f"tape {dtype}, {PACKED_RING}", "append", "none")


def ring_rows(packed: DataFrame) -> DataFrame:
    """(tape, subscriber, seq, session, payload, origin): a row for each frame and subscriber of packed ones."""
    frames = packed.select("tape", "origin", "subscribers", "sessions", "payloads", F.posexplode("seqs").alias("_k", "seq"))
    columns = ["seq", F.get("sessions", F.col("_k")).alias("session"), F.get("payloads", F.col("_k")).alias("payload"), "origin"]
    return frames.select("tape", F.explode("subscribers").alias("subscriber"), *columns)
