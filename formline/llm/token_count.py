"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols stand in a linked list; a heap holds the adjacent pairs whose concatenation is a piece. The
lowest rank (highest score, then leftmost) is merged until the heap is empty. The count is the initial symbols
minus the merges; no identifiers are made. A symbol that is no piece counts as its UTF-8 bytes (byte fallback).

No piece of such a vocabulary joins a space to what stands before it (checked on load), so that merges never
cross the border before a run of spaces. Texts are therefore cut there and each different word is merged once
for each worker.
"""

from __future__ import annotations

import struct
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Batches, Recent, utf8

SPACE = "▁"
#: Bytes of remembered words in a Python worker, about what one takes besides its letters, and the longest one kept.
REMEMBERED, ENTRY, LONGEST = 128 << 20, 110, 256
#: The kinds of pieces this merging knows (normal, unknown, control, byte).
KINDS = (1, 2, 3, 6)
_loaded: dict[int, "Counts"] = {}


def _fields(data: bytes):
    """Field numbers and raw values of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[i : i + n]
            i += n


class Counts(Recent):
    """Word -> tokens, filled as words appear."""

    def __init__(self, model: bytes, bound: int = REMEMBERED):
        super().__init__(bound)
        self.rank: dict[str, float] = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) not in KINDS:
                    raise ValueError("pieces defined by users and unused ones aren't supported")
                if piece.get(3, 1) == 1:
                    self.rank[piece[1].decode()] = -struct.unpack("<f", piece[2])[0]
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(1, b"identity") != b"identity" or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models that keep texts as they are, with a space in front, are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces of this vocabulary join words")

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.merged(SPACE + word)
            if len(word) > LONGEST:
                return n
        self.keep(word, n, ENTRY + 2 * len(word))
        return n

    def merged(self, text: str) -> int:
        """Tokens of a text with its spaces already written as SPACE."""
        rank, symbols = self.rank, list(text)
        count = n = len(symbols)
        plain = True
        for c in symbols:
            if c not in rank:
                plain = False
                count += len(c.encode()) - 1
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        last = symbols[0] if n else ""
        for i in range(1, n):
            c = symbols[i]
            if (pair := last + c) in rank:
                heap.append((rank[pair], i - 1, pair))
            last = c
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = following[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            count -= 1
            if not plain:
                count -= sum(len(s.encode()) - 1 for s in (symbols[i], symbols[j]) if s not in rank)
            symbols[i], symbols[j] = pair, ""
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (right := pair + symbols[k]) in rank:
                    heappush(heap, (rank[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + pair) in rank:
                heappush(heap, (rank[left], h, left))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total, run = 0, 0
        for word in words:
            run += 1
            if word:
                total += self[word] if run == 1 else self.merged(SPACE * run + word)
                run = 0
        return total + (self.merged(SPACE * run) if run else 0)


def loaded(model: bytes) -> Counts:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counts(model)
    return _loaded[key]


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each; an empty
    table gives no rows; other columns of docs are not read. There is no shuffle: each text is one scan's work.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Batches) -> Batches:
        counts = loaded(model)
        for b in batches:
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([counts.count(t.decode()) for t in texts], pa.int64())], schema=schema
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
