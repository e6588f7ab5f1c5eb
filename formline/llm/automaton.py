"""Substring deduplication with suffix automata of reference shards.

References are the contexts of repeats.py over words: what documents with a repeated k-gram hold around it, each
different context once with the smallest doc_id that holds it. Shards of a bounded number of words are turned into
generalised suffix automata whose states know the smallest doc_id of their occurrences. The documents' passages are
streamed through: the matching statistics give, at each word, the state of the last `window` words and so the first
document in which this window starts. Spans of such windows are maximal once they are joined in the document.

Each shard's automaton lives in the task that streams the passages of that shard: the passages are dealt to it by
their anchors, so no automaton has to reach every task, and none is larger than a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .textops import Batches, prefix_hash, range_hash, separators, sha256, symbol_table, union, word_bounds

#: Words of a repeat, of the k-grams that make anchors, and of a reference shard.
WINDOW, GRAM, SHARD = 50, 16, 100_000
#: Different contexts of one anchor in a shard; with more, their windows are dealt one by one.
MANY = 4_000


def word_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data, separators())
    return range_hash(prefix_hash(symbol_table()[data]), starts, ends), starts, ends


class Automaton:
    """A generalised suffix automaton over sequences of words, with the smallest owner of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def add(self, words: list[bytes], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if owner < least[q]:
                    least[q] = owner
                continue
            cur = -1
            p = last
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                least.append(owner)
                while p >= 0 and (q := nxt[p].get(w)) is None:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            least.append(1 << 63)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur >= 0:
                link[cur] = clone
                last = cur
            else:
                last = clone
                least[clone] = owner

    def finish(self) -> None:
        """Hands the owners from longer to shorter states."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def first_owners(self, words: list[bytes], window: int) -> list[int]:
        """For each window of the words the smallest owner of a sequence that holds it; 2**63 if none does."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out = []
        for k, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
            if k >= window - 1:
                out.append(least[state] if matched >= window else 1 << 63)
        return out


def _passages(asked: DataFrame, window: int, ranges: int) -> DataFrame:
    """(range, gram, context, row, owner, place, high, many, words): the wanted contexts, and the windows of anchors with many."""
    schema = pa.schema([("range", pa.int32()), *[(c, pa.int64()) for c in ("gram", "context", "row", "owner", "place", "high", "many")], ("words", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows: list[tuple] = []
            for row, owner, z, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = repeats.expanded(z).split()
                for w in wanted:
                    p, low, high = w["place"], w["low"], w["high"]
                    if w["many"]:
                        for i in range(p - high, p - low + 1):
                            s = b" ".join(words[i : i + window])
                            h = xxhash.xxh64_intdigest(s)
                            rows.append((h % ranges, 0, h - (1 << 63), row, owner, i, 0, 1, s))
                    else:
                        rows.append((w["gram"] % ranges, w["gram"], w["context"], row, owner, p, high, 0, b" ".join(words[p - high : p - low + window])))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return asked.select("row", "owner", "z", "wanted").mapInArrow(run, "range int, gram long, context long, row long, owner long, place long, high long, many long, words binary")


ANSWER = ["gram", "context", "row", "place", "first", "last", "least", "many"]


def streamed(passages: list[tuple], window: int) -> list[tuple]:
    """ANSWER rows of one shard: runs of windows of a passage with the same first document.

    passages: (gram, context, row, owner, place, high, many, words), all of a shard's anchors.
    """
    automaton = Automaton()
    split = {}
    for p in passages:
        if (words := split.get(p[7])) is None:
            words = split[p[7]] = p[7].split(b" ")
        automaton.add(words, p[3])
    automaton.finish()
    out, known = [], {}
    for gram, context, row, owner, place, high, many, text in passages:
        if (owners := known.get(text)) is None:
            owners = known[text] = automaton.first_owners(split[text], window)
        start = 0
        for j in range(1, len(owners) + 1):
            if j == len(owners) or owners[j] != owners[start]:
                if owners[start] < 1 << 63 and (not many or owners[start] < owner):
                    out.append((gram, context, row, place, high - j + 1, high - start, owners[start], many))
                start = j
    return out


def spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(row, spans array<struct<start, end>>): word ranges covered by windows that start in a document of a smaller id.

    texts: repeats.held(docs). Rows without such a window are absent; rows with a null id take no part.
    """
    long_enough = texts.where((F.col("size") >= 2 * window - 1) & F.col("doc_id").isNotNull()).withColumn("owner", F.col("doc_id"))
    n, buckets = repeats.deal(texts)
    claimed = repeats.spooled(repeats.claims(repeats.dealt(long_enough, word_symbols, window, gram, buckets), n, across=True, limit=many))
    passages = _passages(repeats.asked(claimed, long_enough), window, 1 << 20)
    schema = pa.schema([(c, pa.int64()) for c in ANSWER])

    def stream(batches: Batches) -> Batches:
        """Passages come ordered by range, so that a shard ends between two ranges."""
        held, size, last = [], 0, None

        def answers(passages):
            rows = streamed(passages, window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(ANSWER))], schema=schema)

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(9)]
            for key, *row in zip(*columns):
                if key != last and size > SHARD:
                    yield answers(held)
                    held, size = [], 0
                last = key
                held.append(tuple(row))
                size += window + row[5]
        if held:
            yield answers(held)

    ordered = passages.repartition(n, "range").sortWithinPartitions("range")
    answers = repeats.spooled(ordered.mapInArrow(stream, ", ".join(f"{c} long" for c in ANSWER)))
    shared = repeats.answered(claimed, answers.where("many = 0").select("gram", "context", "first", "last", "least")).where("least < owner")
    alone = answers.where("many = 1").select("row", "place", "first", "last")
    found = shared.select("row", "place", "first", "last").unionByName(alone)
    span = F.struct((F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + window).alias("end"))
    return found.groupBy("row").agg(F.collect_list(span).alias("spans"))


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, many: int = MANY) -> DataFrame:
    """doc_id, n_words, n_removed and kept (string) or, as a digest, kept_sha256 for each row of docs.

    Each word covered by a window of `window` words whose sequence also starts in a document of a smaller id is
    removed; windows are judged on the input. Kept words are joined by one space. Null and empty texts have no words;
    a null id stays null and keeps its words, and none is smaller than another id; rows that share an id, with one
    text or several, have no smaller id among themselves; texts of any length are searched whole; an empty table
    gives no rows; other columns aren't read.
    """
    texts = repeats.held(docs, id_col, text_col)
    found = spans(texts, window, gram, many)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for doc_id, z, marks in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = repeats.expanded(z).split()
                cut = union(np.array([(m["start"], m["end"]) for m in marks or ()], np.int64).reshape(-1, 2)).tolist()
                kept, at = [], 0
                for s, e in cut:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                text = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), sha256(text) if digest else text.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    joined = texts.join(found, "row", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string"))
