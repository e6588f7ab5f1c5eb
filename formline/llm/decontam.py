"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's passages become rows of word hashes; longer ones are cut into overlapping segments of a window's
   length, so that like is held against like. Document frequencies of their words are counted over all documents.
2. The TF-IDF rows of all segments are decomposed by a randomised SVD into one latent space: random projections, power
   rounds and the Gram matrix are sums over rows, made by Spark tasks; only (words x rank) matrices reach the driver, and
   words share WIDTH columns at most.
3. Every document is cut into overlapping windows of words, each window is projected into the latent space, and its
   cosine with each segment, as a share of what a copy of the segment reaches there, makes candidates. Words that no
   passage holds have zero loadings but count in a window's norm, with the median weight of the known ones. A window whose known
   words can't reach the bound isn't projected. A projection may lose what sets passages apart, so every run of RUN
   words (or the whole passage, if it is shorter) that a text shares with a passage makes a candidate as well: no
   verbatim copy of whatever length is missed, nor an edited one with RUN words in a row unchanged.
4. Candidates are verified by the longest common subsequence with the whole passage and with its answer, which is
   its last sentence.

Passages are searched in blocks of BLOCK_WORDS words, or one passage; a task holds one block's Finder at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textops import Batches, folded, free_name, mix, prefix_hash, range_hash, symbol_table, utf8, word_bounds

#: Words of a block of a text; blocks of a window; texts are worked on in chunks of this many bytes.
BLOCK, WINDOW, CHUNK = 8, 4, 1 << 18
#: Words of a block of passages, columns of the TF-IDF matrix, rank of the latent space, and the settings of the randomised SVD.
BLOCK_WORDS, WIDTH, RANK, OVERSAMPLE, POWER_ROUNDS = 200_000, 1 << 17, 160, 16, 2
#: A segment of which the latent space keeps a smaller share is told from others by shared runs alone.
FAINT = 0.3
#: Words of a run that a text and a passage share.
RUN = 4

#: Letters and digits make words, in lower case; other ASCII separates, every non-ASCII byte is a letter.
_apart = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes each; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its text) of every word, in order."""
    texts = [folded(t) for t in texts]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_bounds(data, _apart)
    hashes = range_hash(prefix_hash(symbol_table()[data]), starts, ends)
    edges = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(edges, starts, side="right")


class Lexicon:
    """Place of each known word's hash, -1 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.hashes >> np.uint64(48)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(48)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        good = self.hashes[at] == hashes[maybe]
        out[maybe[good]] = at[good]
        return out


def run_hashes(at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` places from each place on; 64 bits, so that equal runs have equal hashes."""
    total = np.zeros(max(0, len(at) - length + 1), np.uint64)
    for i in range(length):
        total = mix(total + at[i : len(at) - length + 1 + i].astype(np.uint64))
    return total


class Runs:
    """The passages that hold each run of one length."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        hashes = [np.unique(run_hashes(w, length)) for _, w in items]
        owner = np.repeat([k for k, _ in items], [len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.length, self.owner, self.lexicon = length, owner[order], Lexicon(flat)
        self.starts = np.r_[np.searchsorted(flat[order], self.lexicon.hashes), len(flat)]

    def hits(self, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word where a shared run begins, passage)."""
        if len(at) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(at) - self.length + 1
        whole = text[:last] == text[self.length - 1 :]
        for i in range(self.length):
            whole &= at[i : last + i] >= 0
        word = np.flatnonzero(whole)
        run = self.lexicon.places(run_hashes(at, self.length)[word])
        word, run = word[run >= 0], run[run >= 0]
        n = self.starts[run + 1] - self.starts[run]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(word, n), self.owner[np.repeat(self.starts[run], n) + inner]


def segments(count: int) -> list[tuple[int, int]]:
    """Ranges of a passage's words of about a window's length each, overlapping by half; a short passage is one."""
    length = BLOCK * WINDOW
    if count <= length + length // 2:
        return [(0, count)]
    return [(s, min(s + length, count)) for s in range(0, count - length // 2, length // 2)]


class Space:
    """The columns in use, their weights, and the latent space's loadings."""

    def __init__(self, columns: np.ndarray, idf: np.ndarray, loadings: np.ndarray | None = None):
        self.columns, self.idf, self.loadings = columns, idf, loadings
        self.unknown = float(np.median(idf)) if len(idf) else 1.0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Column of each word of the benchmark."""
        return np.searchsorted(self.columns, hashes % np.uint64(WIDTH))


def passages_of(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, words binary, answer binary): the passages' word hashes; those without an id or without words are left out."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("answer", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if len(found := words([text])[0]):
                    rows.append((item, found.tobytes(), words([answer_of(text)])[0].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    picked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    return picked.mapInArrow(run, "item_id long, words binary, answer binary")


def columns_of(passages: DataFrame) -> np.ndarray:
    """The sorted columns that the passages' words use, WIDTH at most."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(flat % np.uint64(WIDTH)).astype(np.int32))], names=["column"])

    return np.array(sorted(r[0] for r in passages.select("words").mapInArrow(run, "column int").distinct().collect()), np.uint64)


def document_frequencies(docs: DataFrame, columns: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """Documents, and how many of them hold a word of each column."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])
    size = len(columns)

    def run(batches: Batches) -> Batches:
        total, n = np.zeros(size, np.int64), 0
        place = np.full(WIDTH, -1, np.int32)
        place[columns] = np.arange(size)
        for b in batches:
            texts = utf8(b.column(0))
            n += len(texts)
            for s, e in chunks(texts):
                hashes, text = words(texts[s:e])
                at = place[hashes % np.uint64(WIDTH)]
                known = at >= 0
                total += np.bincount(np.unique(text[known].astype(np.int64) * size + at[known]) % size, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found].astype(np.int32)), pa.array(np.r_[n, total[found]])], schema=schema)

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n, df = 0, np.zeros(size, np.int64)
    for r in rows:
        if r.word < 0:
            n = r.n
        else:
            df[r.word] = r.n
    return n, df


def weighted(passages: DataFrame, space: Space) -> DataFrame:
    """(at array<int>, weight array<double>): a TF-IDF row of unit length for each segment."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            at, weight = [], []
            for raw in b.column(0).to_pylist():
                places = space.places(np.frombuffer(raw, np.uint64))
                for s, e in segments(len(places)):
                    u, c = np.unique(places[s:e], return_counts=True)
                    x = c * space.idf[u]
                    at.append(u)
                    weight.append(x / np.linalg.norm(x))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float64()))], names=["at", "weight"])

    return passages.select("words").mapInArrow(run, "at array<int>, weight array<double>")


def _row_sums(passages: DataFrame, shape: tuple[int, int], work) -> np.ndarray:
    """Sum over passages, made in tasks: work(sparse rows) -> matrix of the given shape."""
    schema = pa.schema([("part", pa.binary())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for b in batches:
            total += work(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], schema=schema)

    out = np.zeros(shape)
    for r in passages.mapInArrow(run, "part binary").toLocalIterator():
        out += np.frombuffer(r.part).reshape(shape)
    return out


def randomised_svd(passages: DataFrame, width: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """The first right singular vectors (width x rank) of sparse rows (at array<int>, weight array<double>)."""
    size = min(width, rank + OVERSAMPLE)
    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(POWER_ROUNDS + 1):
        here = basis

        def spread(rows, here=here):
            out = np.zeros(here.shape)
            for at, w in rows:
                a, w = np.array(at, int), np.array(w)
                out[a] += np.outer(w, w @ here[a])
            return out

        basis, _ = np.linalg.qr(_row_sums(passages, (width, size), spread))

    def gram(rows, here=basis):
        out = np.zeros((size, size))
        for at, w in rows:
            y = np.array(w) @ here[np.array(at, int)]
            out += np.outer(y, y)
        return out

    values, vectors = np.linalg.eigh(_row_sums(passages, (size, size), gram))
    order = np.argsort(-values)[: min(rank, size)]
    return basis @ vectors[:, order]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of places; -1 matches nothing."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    masks.pop(-1, None)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Finder:
    """What a task needs to find the passages of a block in texts. items: (item_id, word hashes, those of the answer)."""

    def __init__(self, space: Space, items: list[tuple[int, np.ndarray, np.ndarray]], cosine: float, overlap: float, answer: float):
        self.lexicon = Lexicon(np.concatenate([w for _, w, _ in items]))
        self.items = [(item, self.lexicon.places(w), self.lexicon.places(a)) for item, w, a in items]
        self.cosine, self.overlap, self.answer = cosine, overlap, answer
        column = space.places(self.lexicon.hashes)
        weight = space.idf[column]
        self.squared = np.r_[weight**2, space.unknown**2]  # place -1 is the last one
        self.project = np.vstack([weight[:, None] * space.loadings[column], np.zeros((1, space.loadings.shape[1]))]).astype(np.float32)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, w, _) in enumerate(self.items):
            by_length.setdefault(min(len(w), RUN), []).append((k, w))
        self.runs = [Runs(n, some) for n, some in by_length.items()]
        owner, latent, least = [], [], []
        for k, (_, w, _) in enumerate(self.items):
            for s, e in segments(len(w)):
                at = self.project[w[s:e]].sum(0)
                whole = float(self.norms(w[None, s:e])[0])
                kept = float(np.linalg.norm(at)) / whole
                owner.append(k)
                # cosine of a window with the segment, over the cosine that a copy of the segment has
                latent.append(at / whole / max(kept, 1e-9) ** 2 * (kept >= FAINT))
                least.append(kept)
        self.owner, self.latent = np.array(owner), np.array(latent, np.float32).T.copy()
        #: The least share of a segment's length that the latent space keeps: what a window must reach of its own at least.
        self.kept = min([1.0, *[x for x in least if x >= FAINT]])

    def norms(self, places: np.ndarray) -> np.ndarray:
        """Lengths of the TF-IDF rows of windows (rows of places, -1 unknown, -2 none); repeated words add up."""
        order = np.sort(places, axis=1)
        n, width = order.shape
        new = np.ones((n, width), bool)
        new[:, 1:] = (order[:, 1:] != order[:, :-1]) | (order[:, 1:] < 0)
        flat = np.flatnonzero(new)
        times = np.diff(np.r_[flat, n * width])
        value = order.ravel()[flat]
        size = np.where(value == -2, 0.0, self.squared[value] * times.astype(float) ** 2)
        return np.sqrt(np.maximum(np.add.reduceat(size, np.searchsorted(flat, np.arange(n) * width)), 1e-18))

    def verified(self, item: int, region: np.ndarray) -> tuple[float, float]:
        """Greatest share of the passage, and of its answer there, that is a common subsequence with a stretch of about its length."""
        _, passage, answer = self.items[item]
        n = len(passage)
        if len(passage) and sum(map(set(region.tolist()).__contains__, passage.tolist())) < self.overlap * n:
            return (0.0, 0.0)  # no subsequence can be longer than the shared words
        length = n + n // 2 + 4
        step = max(1, n // 4)
        best = (0.0, 0.0)
        for s in range(0, max(1, len(region) - length + step), step):
            part = region[s : s + length]
            share = common_subsequence(passage, part) / n
            if share > best[0]:
                best = (share, common_subsequence(answer, part) / max(1, len(answer)))
        return best

    def candidates(self, at: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, word where the window begins, item, cosine) for words' places and the words of each text."""
        first = np.r_[0, np.cumsum(count)[:-1]]
        blocks = -(-count // BLOCK)
        base = np.r_[0, np.cumsum(blocks + WINDOW)]  # empty blocks after each text keep windows apart
        text = np.repeat(np.arange(len(count)), count)
        block = base[text] + (np.arange(len(at)) - first[text]) // BLOCK
        weight = self.squared[at]
        size = base[-1] + WINDOW
        whole, known = (np.bincount(block, weights=w, minlength=size) for w in (weight, np.where(at >= 0, weight, 0)))
        whole, known = (sum(w[k : size - WINDOW + k] for k in range(WINDOW)) for w in (whole, known))
        start = np.flatnonzero((known > 0) & (known * (1 + self.repeats(at, text, block, size)) >= (self.cosine * self.kept) ** 2 * whole))
        doc = np.searchsorted(base, start, side="right") - 1
        even = (start - base[doc]) % (WINDOW // 2) == 0
        start, doc = start[even], doc[even]
        word = first[doc] + (start - base[doc]) * BLOCK
        for s in range(0, len(start), 512):
            d, w = doc[s : s + 512], word[s : s + 512]
            index = w[:, None] + np.arange(WINDOW * BLOCK)
            inside = index < (first[d] + count[d])[:, None]
            places = np.where(inside, at[np.minimum(index, len(at) - 1)], -1)
            norm = self.norms(np.where(inside, places, -2))
            close = self.project[places].sum(1) @ self.latent / norm[:, None]
            for k, segment in zip(*np.nonzero(close >= self.cosine)):
                yield int(d[k]), int(w[k]), int(self.owner[segment]), float(close[k, segment])

    def repeats(self, at: np.ndarray, text: np.ndarray, block: np.ndarray, size: int) -> np.ndarray:
        """Known words of each window that stand before in it, or some more: a word's weights add up when it is repeated."""
        some = np.flatnonzero(at >= 0)
        order = some[np.lexsort((some, at[some]))]
        again = order[1:][(at[order[1:]] == at[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (order[1:] - order[:-1] < WINDOW * BLOCK)]
        n = np.bincount(block[again], minlength=size)
        return sum(n[k : size - WINDOW + k] for k in range(WINDOW))

    def shared_runs(self, at: np.ndarray, text: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, begin of the stretch of a window's length, item, cosine of the stretch) where a run is shared."""
        first = np.r_[0, np.cumsum(count)[:-1]]
        length = WINDOW * BLOCK
        for runs in self.runs:
            word, item = runs.hits(at, text)
            doc = text[word]
            begin = first[doc] + (word - first[doc]) // length * length
            for d, w, k in np.unique(np.column_stack([doc, begin, item]), axis=0).tolist():
                yield d, w, k, self.cosine_at(at[w : min(w + length, first[d] + count[d])], k)

    def cosine_at(self, places: np.ndarray, item: int) -> float:
        return float((self.project[places].sum(0) @ self.latent[:, self.owner == item]).max() / self.norms(places[None])[0])

    def found(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item_id, cosine, share, answer's share) of verified passages."""
        for s, e in chunks(texts):
            hashes, text = words(texts[s:e])
            at = self.lexicon.places(hashes)
            if not (at >= 0).any():
                continue
            count = np.bincount(text, minlength=e - s)
            stop = np.cumsum(count)
            done: dict[tuple[int, int], tuple[float, float, float]] = {}
            for doc, word, item, cosine in chain(self.candidates(at, count), self.shared_runs(at, text, count)):
                key = (doc, item)
                if key in done and done[key][1] >= self.overlap and done[key][2] >= self.answer:
                    continue
                around = len(self.items[item][1])
                region = at[max(stop[doc] - count[doc], word - around) : min(stop[doc], word + WINDOW * BLOCK + around)]
                share, answer = self.verified(item, region)
                if key not in done or share > done[key][1]:
                    done[key] = (cosine, share, answer)
            for (doc, item), (cosine, share, answer) in done.items():
                if share >= self.overlap and answer >= self.answer:
                    yield s + doc, self.items[item][0], cosine, share, answer


def answer_of(text: bytes) -> bytes:
    """The last sentence."""
    parts = [p for p in re.split(rb"(?<=[.!?])\s+", text.strip()) if p.strip()]
    return parts[-1] if parts else b""


class Search:
    """The latent space of a benchmark and its passages in blocks, each one row of a checkpointed table."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = 0.45, overlap: float = 0.6, answer: float = 0.5, rank: int = RANK, block_words: int = BLOCK_WORDS):
        passages = cut(passages_of(benchmark, item_col, item_text))
        n, total = passages.agg(F.count("*"), F.sum(F.octet_length("words") / 8)).first()
        self.blocks, self.settings = 0, (cosine, overlap, answer)
        if not n:
            return
        columns = columns_of(passages)
        documents, df = document_frequencies(docs, columns, text_col)
        space = Space(columns, np.log((1 + documents) / (1 + df)) + 1e-3)
        rows = cut(weighted(passages, space))
        # rank well below the number of segments, which is where passages start to share directions
        space.loadings = randomised_svd(rows, len(columns), max(1, min(rank, int(0.8 * rows.count()))))
        self.space = space
        self.blocks = max(1, int(-(-total // block_words)))
        deal = F.pmod(F.xxhash64("item_id", "words"), F.lit(self.blocks)).cast("int").alias("block")
        self.table = cut(passages.groupBy(deal).agg(F.array_sort(F.collect_list(F.struct("item_id", "words", "answer"))).alias("items")))

    def finders(self) -> Iterator[Finder]:
        """One block's Finder after the other."""
        for k in range(self.blocks):
            for row in self.table.where(F.col("block") == k).collect():  # one bounded row
                yield Finder(self.space, [(x["item_id"], np.frombuffer(x["words"], np.uint64), np.frombuffer(x["answer"], np.uint64)) for x in row["items"]], *self.settings)


HIT = "row long, item_id long, share double, answer_share double, cosine double"


def hits(keyed: DataFrame, search: Search, text_col: str, key: str = "__row") -> DataFrame:
    """(row, item_id, share, answer_share, cosine) of every passage found in the rows of keyed, told apart by the column `key`; tasks hold one block each.

    Null and empty texts hold none, repeated rows are searched each, and an empty benchmark or table gives no rows.
    """

    def of(finder: Finder) -> DataFrame:
        def run(batches: Batches) -> Batches:
            for b in batches:
                ids = b.column(0)
                rows = [(ids[k].as_py(), item, share, answer, cosine) for k, item, cosine, share, answer in finder.found(utf8(b.column(1)))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["row", "item_id", "share", "answer_share", "cosine"])

        return keyed.select(key, F.col(text_col).cast("string")).mapInArrow(run, HIT)

    found = [of(f) for f in search.finders()]
    return reduce(DataFrame.unionByName, found) if found else keyed.sparkSession.createDataFrame([], HIT)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the greatest share; ties: smallest), share, answer_share, cosine for each row of docs.

    Null and empty texts hold no passage, and passages without an id or words aren't looked for; a passage that stands
    under several ids is found for each. A null doc_id stays null; repeated rows are searched each; texts of any length
    are searched whole; empty tables give no rows or no findings; other columns aren't read.
    """
    search = Search(docs, benchmark, text_col, **settings)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flag = (F.col("n_items") > 0).alias("contaminated")
    columns = ["n_items", "item_id", "share", "answer_share", "cosine"]
    if search.blocks != 1:
        keyed = cut(picked.withColumn("__row", F.monotonically_increasing_id()))
        best = F.min_by(F.struct("item_id", "share", "answer_share", "cosine"), F.struct(-F.col("share"), "item_id"))
        each = hits(keyed, search, "text").groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n"), best.alias("b"))
        return keyed.select("__row", "doc_id").join(each, "__row", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_items"), "b.*").select("doc_id", *columns, flag)
    finder = next(search.finders())
    schema = pa.schema([("doc_id", pa.int64()), ("n_items", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("answer_share", pa.float64()), ("cosine", pa.float64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            best: dict[int, list] = {}
            for k, item, cosine, share, answer in finder.found(utf8(b.column(1))):
                best.setdefault(k, []).append((-share, item, answer, cosine))
            top = [min(best[k]) if k in best else (None,) * 4 for k in range(b.num_rows)]
            found = zip(*[(len(best.get(k, ())), item, share and -share, answer, cosine) for k, (share, item, answer, cosine) in enumerate(top)]) if top else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(found, list(schema)[1:])]], schema=schema)

    return picked.mapInArrow(run, "doc_id long, n_items long, item_id long, share double, answer_share double, cosine double").select("doc_id", *columns, flag)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that hold no benchmark passage; columns as given.

    Rows with a null or empty text stay, repeated rows are judged each, and empty tables give no rows or all of docs.
    """
    search = Search(docs, benchmark, text_col, **settings)
    if not search.blocks:
        return docs
    if search.blocks > 1:
        key = free_name(docs.columns, "row")
        keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
        return keyed.join(hits(keyed, search, text_col, key).select(F.col("row").alias(key)).distinct(), key, "left_anti").drop(key)
    finder = next(search.finders())

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode() for t in texts]
        found = {k for k, *_ in finder.found(raw)}
        return pd.Series([k in found for k in range(len(raw))])

    return docs.where(~holds(F.col(text_col).cast("string")))
