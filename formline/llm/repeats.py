"""What the two repeat removers share: finding the places where a repeat can be, and asking for their contexts.

A repeat is a window of W symbols (bytes or words) that occurs elsewhere. Sorting every window of a corpus costs many
times the corpus, so windows are dealt by anchors: the anchor of a window is its k-gram of the smallest hash (the
leftmost of equal ones), which depends on the window's symbols alone. Equal windows therefore have the same anchor at
the same offset, and successive windows mostly share theirs: one anchor stands for a run of windows, and its context
is all their symbols.

1. Each batch of documents deals its anchors into buckets by the anchor's hash, packed.
2. A bucket keeps the anchors whose k-gram occurs again; equal contexts get one representative.
3. Documents are asked for the contexts of their representatives. An anchor with very many different contexts
   (a short common passage in different surroundings) isn't asked for its context but for its windows one by one:
   they are dealt by the whole window, so that no key gathers them.

Rows are told apart by a number of their own, not by doc_id: an id may be null or stand for several texts.

The operators then compare the contexts by their own methods and tell which windows of a context are repeats; all
holders of the context receive the answer by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textops import Batches, mix, powers, prefix_hash, range_hash, utf8

#: Symbols worked on at once, and bytes of a run.
PIECE, RUN_BYTES = 1 << 20, 48 << 20
#: Bytes of text for each bucket, whose anchors a task holds at once.
BUCKET_BYTES = 32 << 20

#: Splits a text into symbols: hashes of the symbols, and byte offsets of their starts and ends.
Symbols = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]


def spooled(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: of a block's rest and of the next block's beginning."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(symbols: np.ndarray, ends: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of several texts written one after the other; ends[i] is the end of the text of symbol i.

    place: the k-gram's first symbol; low, high: the windows begin at place - high .. place - low; gram, context:
    hashes of the k-gram and of all symbols of these windows.
    """
    n = len(symbols)
    if n < window:
        return {c: np.zeros(0, np.int64) for c in ("place", "low", "high", "gram", "context")}
    prefix = prefix_hash(symbols)
    at = np.arange(n - k + 1)
    grams = mix((prefix[k:] - prefix[:-k]) * powers(n + 1)[1][: n - k + 1])
    place_bits = np.uint64((1 << 22) - 1)
    least = sliding_min((grams & ~place_bits) | at.astype(np.uint64), window - k + 1)
    place = (least & place_bits).astype(np.int64)
    start = np.flatnonzero(np.arange(n - window + 1) + window <= ends[: n - window + 1])
    place = place[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else np.zeros(0, np.int64)
    first, last = start[new], start[np.r_[new[1:] - 1, len(start) - 1]] if len(new) else new
    place = place[new]
    return {"place": place, "low": place - last, "high": place - first, "gram": grams[place], "context": range_hash(prefix, first, last + window)}


def pieces(texts: Iterable[bytes], symbols: Symbols, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, end of its text for each, text, symbol's place in its text) of about PIECE symbols each.

    A longer text is cut into pieces that overlap by a window less one symbol, so that each window is in one piece.
    """
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def joined():
        lengths = np.array([len(h) for h, _, _ in held])
        stop = np.cumsum(lengths)
        return (
            np.concatenate([h for h, _, _ in held]),
            np.repeat(stop, lengths),
            np.repeat([t for _, t, _ in held], lengths),
            np.concatenate([np.arange(o, o + len(h)) for h, _, o in held]),
        )

    for t, text in enumerate(texts):
        hashes = symbols(text)[0]
        for offset in range(0, max(1, len(hashes) - window + 1), PIECE):
            part = hashes[offset : offset + PIECE + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > PIECE:
                yield joined()
                held, size = [], 0
            held.append((part, t, offset))
            size += len(part)
    if held:
        yield joined()


def held(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, size, z): the texts compressed, each row with a number, written once so that the numbers last."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("z", pa.binary())])

    def run(batches: Batches) -> Batches:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = utf8(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary())], schema=schema)

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spooled(picked.mapInArrow(run, "row long, doc_id long, size long, z binary"))


def expanded(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def deal(texts: DataFrame) -> tuple[int, int]:
    """Partitions of the session, and the number of buckets that work is dealt into: twice that, or more for large texts."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum("size")).first()[0] or 0
    return n, max(2 * n, total // BUCKET_BYTES)


def one_by_one(batches: Batches, columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) for each key of batches that come ordered by their first column; only one key's rows are held."""
    last, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if row[0] != last and rows:
                yield last, rows
                rows = []
            last = row[0]
            rows.append(row)
    if rows:
        yield last, rows


PACKED = [("gram", np.uint64), ("context", np.uint64), ("owner", np.int64), ("row", np.int64), ("place", np.int32), ("low", np.int16), ("high", np.int16)]


def dealt(texts: DataFrame, symbols: Symbols, window: int, k: int, buckets: int) -> DataFrame:
    """(bucket, blob): the packed anchors of each batch of texts (row, owner, z)."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows, owners = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = []
            for hashes, ends, text, place in pieces(map(expanded, b.column(2).to_pylist()), symbols, window):
                a = anchors(hashes, ends, window, k)
                at = text[a["place"]]
                a["row"], a["owner"], a["place"] = rows[at], owners[at], place[a["place"]]
                parts.append(a)
            if not parts:
                continue
            columns = {c: np.concatenate([p[c] for p in parts]).astype(kind) for c, kind in PACKED}
            bucket = (columns["gram"] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((columns["context"], columns["gram"], bucket))  # equal ones stand together, so that copies compress
            columns = {c: v[order] for c, v in columns.items()}
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = [b"".join(v[cuts[i] : cuts[i + 1]].tobytes() for v in columns.values()) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return texts.select("row", "owner", "z").mapInArrow(run, "bucket int, blob binary")


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in PACKED)
    out = {c: [] for c, _ in PACKED}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, kind in PACKED:
            out[c].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {c: np.concatenate(v) if v else np.zeros(0, dict(PACKED)[c]) for c, v in out.items()}


CLAIM = "gram long, context long, owner long, row long, place int, low short, high short, copies int, representative boolean, many boolean"


def claims(packed: DataFrame, partitions: int, across: bool, limit: int) -> DataFrame:
    """The anchors whose k-gram occurs again (across: with another owner), with one representative for each context.

    copies: places of the context. many: the anchor has more than `limit` different contexts. The representative of a
    context is its place of the smallest owner, row and place.
    """
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int16(), pa.int16(), pa.int32(), pa.bool_(), pa.bool_()]
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(CLAIM.split(", "), kinds)])

    def claimed(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        a = unpacked(blobs)
        order = np.argsort(a["gram"], kind="stable")
        gram = a["gram"][order]
        again = np.zeros(len(gram), bool)
        again[1:] = gram[1:] == gram[:-1]
        again[:-1] |= again[1:]
        order = order[again]
        if not len(order):
            return
        a = {c: v[order] for c, v in a.items()}
        order = np.lexsort((a["place"], a["row"], a["owner"], a["context"], a["gram"]))
        a = {c: v[order] for c, v in a.items()}
        new_gram = np.r_[True, a["gram"][1:] != a["gram"][:-1]]
        new_context = new_gram | np.r_[True, a["context"][1:] != a["context"][:-1]]
        group, context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
        copies = np.bincount(context)[context]
        different = np.bincount(group, weights=new_context).astype(np.int64)
        keep = np.ones(len(group), bool)
        if across:
            edge = np.flatnonzero(new_gram)
            keep = (np.minimum.reduceat(a["owner"], edge) != np.maximum.reduceat(a["owner"], edge))[group]
        many = different[group] > limit
        columns = [a["gram"].view(np.int64), a["context"].view(np.int64), a["owner"], a["row"], a["place"], a["low"], a["high"], copies.astype(np.int32), new_context, many]
        for s in range(0, len(group), 50_000):
            some = np.flatnonzero(keep[s : s + 50_000]) + s
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], schema=schema)

    def run(batches: Batches) -> Batches:
        for _, rows in one_by_one(batches, 2):
            yield from claimed([blob for _, blob in rows])

    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, CLAIM)


def asked(claimed: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that hold representatives, or anchors with many contexts, with these in `wanted`."""
    wanted = (
        claimed.where("representative or many")
        .groupBy("row")
        .agg(F.collect_list(F.struct("gram", "context", "place", "low", "high", "copies", "many")).alias("wanted"))
    )
    return texts.join(wanted, "row")


def answered(claimed: DataFrame, answers: DataFrame) -> DataFrame:
    """Joins the holders of a context with what was found out about it."""
    return claimed.where("not many").select("gram", "context", "owner", "row", "place").join(answers, ["gram", "context"])
