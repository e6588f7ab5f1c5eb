"""Suffix-array deduplication by a distributed, common-prefix-aware merge sort.

The suffixes are those at the anchors of repeats.py whose k-gram occurs again. A task sorts the suffixes of its
documents into runs, front-codes them (each keeps only what differs from its predecessor) and exchanges the runs by
ranges of the k-gram's hash. A range merges its runs with a loser tree whose players remember the prefix they share
with the last winner: two players are compared from there on and never again on a known prefix. The same is done
with the texts before the anchors, read backwards. The common prefixes of neighbours that both merges leave behind
give classes of equal continuations and of equal beginnings of each length; a window is a repeat if another place is
in both its classes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .textops import Batches, sha256, symbol_table, union

#: Length of a repeat in bytes, and of the k-grams that make anchors.
WINDOW, GRAM = 200, 40
#: Different contexts of one anchor that a task merges (under 20 MB); with more, their windows are dealt one by one.
MANY = 50_000


def byte_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    at = np.arange(len(data))
    return symbol_table()[data], at, at + 1


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return known + ((n - known) * 8 - x.bit_length()) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefixes with the predecessor, lengths of the rests, and the rests of sorted strings."""
    shared, before = [], b""
    for s in strings:
        shared.append(common_prefix(before, s))
        before = s
    rests = [s[k:] for s, k in zip(strings, shared)]
    return np.array(shared, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def front_decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(shared.tolist(), lengths.tolist()):
        before = before[:k] + rests[at : at + n]
        at += n
        out.append(before)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The order of all strings as (run, place), and each one's common prefix with its predecessor.

    runs: sorted strings and their common prefixes with the predecessor in the run.
    """
    n = len(runs)
    width = 1 << max(0, n - 1).bit_length()
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - n)
    known = [0] * width  # bytes that a player's string shares with the last winner
    place = [0] * width

    def loser_of(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two players."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p > q:  # a follows the last winner further: it is smaller
            return a, b
        if p < q:
            return b, a
        k = common_prefix(x, y, p)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers = [0] * width
    level = list(range(width))
    at = width
    while at > 1:
        nxt = []
        for i in range(0, at, 2):
            w, lose = loser_of(level[i], level[i + 1])
            losers[at // 2 + i // 2] = lose
            nxt.append(w)
        level, at = nxt, at // 2
    winner = level[0]
    order: list[tuple[int, int]] = []
    shared: list[int] = []
    while heads[winner] is not None:
        strings, prefixes = runs[winner]
        i = place[winner]
        order.append((winner, i))
        shared.append(known[winner])
        i += 1
        place[winner] = i
        if i < len(strings):
            heads[winner], known[winner] = strings[i], prefixes[i]
        else:
            heads[winner] = None
        node = (winner + width) >> 1
        while node:
            winner, losers[node] = loser_of(winner, losers[node])
            node >>= 1
    return order, np.array(shared, np.int64)


FIELDS = ["gram", "context", "row", "place", "low", "high", "copies", "many"]


def packed_run(entries: list[tuple]) -> bytes:
    """A run of (suffix, text before it backwards, *FIELDS) as buffers after their lengths: both sides sorted and front-coded."""
    entries.sort(key=lambda e: e[0])
    back = sorted(range(len(entries)), key=lambda i: entries[i][1])
    sides = [front_coded([e[0] for e in entries]), front_coded([entries[i][1] for i in back])]
    buffers = [np.array([e[2:] for e in entries], np.int64).T.tobytes(), np.array(back, np.uint32).tobytes(), *[x if isinstance(x, bytes) else x.tobytes() for side in sides for x in side]]
    return struct.pack("<8q", *map(len, buffers)) + b"".join(buffers)


def unpacked_run(blob: bytes) -> tuple:
    """(FIELDS by name, front-coded suffixes, order of the other side, front-coded texts before)."""
    cuts = np.cumsum([64, *struct.unpack_from("<8q", blob)])
    parts = [blob[a:b] for a, b in zip(cuts, cuts[1:])]
    fields = np.frombuffer(parts[0], np.int64).reshape(len(FIELDS), -1)
    sides = [(np.frombuffer(parts[i], np.uint16), np.frombuffer(parts[i + 1], np.uint16), parts[i + 2]) for i in (2, 5)]
    return dict(zip(FIELDS, fields)), sides[0], np.frombuffer(parts[1], np.uint32), sides[1]


def repeated_windows(blobs: list[bytes], window: int) -> dict[str, np.ndarray]:
    """Runs of repeated windows of one range: FIELDS of each place, and first and last: windows place - last .. place - first."""
    runs = [unpacked_run(b) for b in blobs]
    columns = {c: np.concatenate([r[0][c] for r in runs]) for c in FIELDS}
    base = np.r_[0, np.cumsum([len(r[0]["gram"]) for r in runs])]
    n = int(base[-1])
    order, shared = merged([(front_decoded(*r[1]), r[1][0].tolist()) for r in runs])
    ahead = np.array([base[k] + i for k, i in order])
    order, back_shared = merged([(front_decoded(*r[3]), r[3][0].tolist()) for r in runs])
    behind = np.array([base[k] + int(runs[k][2][i]) for k, i in order])
    low, high, copies = columns["low"], columns["high"], columns["copies"]
    lows, highs = int(low.min()), int(high.max())
    found = np.zeros((n, highs - lows + 3), np.int8)
    forward, backward = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(lows, highs + 1):
        live = np.flatnonzero((low <= o) & (o <= high))
        if not len(live):
            continue
        forward[ahead] = np.cumsum(shared < window - o)
        backward[behind] = np.cumsum(back_shared < o)
        key = forward[live] * (n + 1) + backward[live]
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        together = np.add.reduceat(copies[live][by_key], edge)
        again = np.repeat(together >= 2, np.diff(np.r_[edge, len(key)]))
        found[live[by_key[again]], o - lows + 1] = 1
    change = np.diff(found, axis=1)
    entry, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return {c: v[entry] for c, v in columns.items()} | {"first": first + lows, "last": last + lows - 1}


def _runs(asked: DataFrame, window: int, ranges: int) -> DataFrame:
    """(range, blob): sorted, front-coded runs of the wanted contexts of each task's documents."""
    schema = pa.schema([("range", pa.int32()), ("blob", pa.binary())])

    def run(batches: Batches) -> Batches:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flushed():
            keys = sorted(held)
            blobs = [packed_run(held[k]) for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

        for b in batches:
            for row, z, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = repeats.expanded(z)
                for w in wanted:
                    p, low, high = w["place"], w["low"], w["high"]
                    if w["many"]:
                        for i in range(p - high, p - low + 1):
                            s = text[i : i + window]
                            held.setdefault(xxhash.xxh64_intdigest(s) % ranges, []).append((s, b"", 0, 0, row, i, 0, 0, 1, 1))
                            size += window
                    else:
                        held.setdefault(w["gram"] % ranges, []).append((text[p : p + window - low], text[p - high : p][::-1], w["gram"], w["context"], row, p, low, high, w["copies"], 0))
                        size += window + high - low
                if size > repeats.RUN_BYTES:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    return asked.select("row", "z", "wanted").mapInArrow(run, "range int, blob binary")


def spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(row, spans array<struct<start, end>>): byte ranges covered by repeated windows; rows without one are absent.

    texts: repeats.held(docs). Short texts have no window; identical rows are each other's repeats.
    """
    long_enough = texts.where(F.col("size") >= window).withColumn("owner", F.lit(0).cast("long"))
    n, buckets = repeats.deal(texts)
    claimed = repeats.spooled(repeats.claims(repeats.dealt(long_enough, byte_symbols, window, gram, buckets), n, across=False, limit=many))
    runs = _runs(repeats.asked(claimed, long_enough), window, buckets)
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "context", "row", "place", "first", "last", "many")])

    def merge(batches: Batches) -> Batches:
        for _, rows in repeats.one_by_one(batches, 2):
            found = repeated_windows([blob for _, blob in rows], window)
            if len(found["gram"]):
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in schema.names], schema=schema)

    ordered = runs.repartition(n, "range").sortWithinPartitions("range")
    answers = repeats.spooled(ordered.mapInArrow(merge, ", ".join(f"{c} long" for c in schema.names)))
    shared = repeats.answered(claimed, answers.where("many = 0").select("gram", "context", "first", "last"))
    alone = answers.where("many = 1").select("row", "place", "first", "last")
    found = shared.select("row", "place", "first", "last").unionByName(alone)
    span = F.struct((F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + window).alias("end"))
    return found.groupBy("row").agg(F.collect_list(span).alias("spans"))


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) or, as a digest, kept_sha256 for each row of docs.

    Every byte covered by a `window`-byte string that also starts anywhere else is removed; strings are judged on the
    input. Null and empty texts keep nothing; rows of a null id are texts like any other and stay null; rows that share
    an id are judged each; texts of any length are searched whole; an empty table gives no rows; other columns aren't read.
    """
    texts = repeats.held(docs, id_col, text_col)
    found = spans(texts, window, gram, many)
    kept_kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), kept_kind])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for doc_id, z, marks in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = repeats.expanded(z)
                cut = union(np.array([(m["start"], m["end"]) for m in marks or ()], np.int64).reshape(-1, 2)).tolist()
                kept, at = [], 0
                for s, e in cut:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(kept), len(cut), sha256(kept) if digest else kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    joined = texts.join(found, "row", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))
