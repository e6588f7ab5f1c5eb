"""Near-duplicates by the Jaccard similarity of word shingles: SimHash segments under one-wildcard variants propose, exact similarity makes links.

1. Texts with the same set of shingles are one node, named by a hash of the set.
2. A node's fingerprint has a bit for each of many sums of weights of its shingles, set if the sum is positive. Two sets at
   Jaccard s differ in a bit with a chance of about arccos(2 s / (1 + s)) / pi at most, whatever their sizes: 15.2 % at 0.8, so
   that 64 bits can't both reach that far and tell documents apart. WHOLE bits verify, the others are cut into segments.
3. Each segment is indexed under its variants with one bit wildcarded, as in `simhash`: a pair that differs in one bit of
   some segment at most shares a variant and is compared on the WHOLE bits. `plan` makes the segments as many as leave a
   pair at the bound without such a segment with a chance of MISSED. Variants aren't shuffled one by one: a
   segment is dealt by either half, of which such a pair shares one, and its variants are joined inside that block.
4. What fingerprints connect is a cluster. The sets of its nodes are sent to it once and walked: one is compared with all of a
   similar size that are not yet reached and hold one of its rarest shingles, on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected
from .simhash import one_of_each, with_row_keys
from .textops import DEALT, Batches, mix, prefix_hash, range_hash, separators, sliced, symbol_table, utf8, word_bounds

WORDS, SIMILARITY = 5, 0.8
SEED = 29
#: Bits on which candidates are verified, the least bits of a segment, and members of a variant that a large table should have.
WHOLE, BITS, MEMBERS = 192, 18, 128
#: By how much sets of few shingles, whose sums aren't quite normal, differ in more bits (0.1575 measured where four of five are shared).
FEW = 1.04
#: Chances that a pair at the bound is told apart by all segments, and by the WHOLE bits.
MISSED, REFUSED = 5e-5, 1e-5
#: Texts are worked on in chunks of about this many bytes.
CHUNK = 1 << 18
#: Sets of a cluster that are compared without an index of their rarest shingles, and nodes of a variant that are compared as pairs.
DIRECT, PAIRS = 64, 256
#: Records of blocks that are joined at once.
SLICE = 1 << 16

_random = np.random.default_rng(SEED)
#: Odd multipliers of the words of a shingle.
_PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Every other half byte, and every other byte.
_HALVES, _BYTES = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x00FF00FF00FF00FF)


@lru_cache(maxsize=4)
def _lanes(n: int) -> np.ndarray:
    """Odd multipliers that make of a shingle's hash n words of 16 weights each."""
    return np.random.default_rng(SEED + 1).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plan(rows: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """Segments, bits of each, and the most of the WHOLE bits in which a pair may differ, for a table of `rows` rows."""
    p, bits = FEW * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, BITS
    while rows >> (bits - 1) > MEMBERS:
        bits += 2
    found = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = math.ceil(math.log(MISSED) / math.log1p(-found)) if found < 1 else 1
    within, left = 0, 1 - (1 - p) ** WHOLE
    while left > REFUSED:
        within += 1
        left -= math.comb(WHOLE, within) * p**within * (1 - p) ** (WHOLE - within)
    return segments, bits, within


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of the different shingles of each text; a shorter text is one shingle, an empty one has none."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(t.lower() for t in texts[start:stop]) + b" ", np.uint8)
        s, e = word_bounds(data, separators())
        hashes = range_hash(prefix_hash(symbol_table()[data]), s, e)
        edges = np.cumsum([len(t) + 1 for t in texts[start:stop]])
        cuts = np.r_[0, np.searchsorted(s, edges)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            h, k = hashes[a:b], min(words, b - a)
            if not k:
                yield np.zeros(0, np.uint64)
                continue
            total = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                total += h[i : len(h) - k + 1 + i] * _PLACES[i]
            yield np.unique(mix(total + np.uint64(k)))
        start = stop


def node_of(grams: np.ndarray) -> int:
    """A hash of the set."""
    return int((mix(grams * _PLACES[-1]).sum(dtype=np.uint64) + np.uint64(len(grams))).view(np.int64))


def fingerprint(grams: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash of a set of shingles: a bit is set if its weights, odd numbers from -15 to 15 by a shingle's hash, have a positive sum."""
    lanes = _lanes(-(-bits // 16))
    sums = np.zeros((4, 4 * len(lanes)), np.int64)
    for k in range(0, len(grams), 1024):
        x = mix(grams[k : k + 1024, None] * lanes)
        for i, half in enumerate((x & _HALVES, (x >> np.uint64(4)) & _HALVES)):
            some = np.add.reduceat(half, np.arange(0, len(x), 16), axis=0)
            sums[2 * i] += (some & _BYTES).sum(0, dtype=np.uint64).view(np.uint16)
            sums[2 * i + 1] += ((some >> np.uint64(8)) & _BYTES).sum(0, dtype=np.uint64).view(np.uint16)
    return (2 * sums > 15 * len(grams)).ravel()[:bits]


def prefixes(size: np.ndarray, begin: np.ndarray, flat: np.ndarray, count: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of each set, by which all pairs at `similarity` or above are found: (owners, starts) of a list of sets for each shingle, and each set's first place in `chosen`.

    Of two such sets with n shingles, n - ceil(similarity x n) + 1 rarest ones have one in common, whatever order all
    sets agree on. Here it is how many of the cluster's sets hold a shingle, so that what a template repeats finds nothing.
    """
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, count[flat], owner))
    place = np.arange(len(flat)) - begin[owner]
    keep = place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]
    return flat[order][keep], owner[keep], np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=len(size)))]


def forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning forest of the pairs at `similarity` or above. Of more than DIRECT sets only those that share one of their rarest shingles are compared."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sets = nodes[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    values, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.r_[0, np.cumsum(size)]
    indexed = len(nodes) > DIRECT
    if indexed:
        chosen, owner, first = prefixes(size, begin, flat, count, similarity)
        listed = np.argsort(chosen, kind="stable")
        holders, lists = owner[listed], np.searchsorted(chosen[listed], np.arange(len(values) + 1))
    open_, edges, marked = np.ones(len(nodes), bool), [], np.zeros(len(values), bool)
    for root in range(len(nodes)):
        if not open_[root]:
            continue
        open_[root], stack = False, [root]
        while stack:
            v = stack.pop()
            lo, hi = np.searchsorted(size, [similarity * size[v] - 1e-9, size[v] / similarity + 1e-9])
            if indexed:
                start, stop = lists[chosen[first[v] : first[v + 1]]], lists[chosen[first[v] : first[v + 1]] + 1]
                n = stop - start
                near = np.unique(holders[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())])
                rest = near[open_[near] & (near >= lo) & (near < hi)]
            else:
                rest = lo + np.flatnonzero(open_[lo:hi])
            if not len(rest):
                continue
            mine = flat[begin[v] : begin[v + 1]]
            marked[mine] = True
            shared = np.zeros(len(rest), np.int64)
            for k in range(0, len(rest), 256):
                some = rest[k : k + 256]
                held = np.concatenate([flat[begin[r] : begin[r + 1]] for r in some])
                shared[k : k + 256] = np.add.reduceat(marked[held], np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            marked[mine] = False
            reached = rest[shared >= similarity * (size[v] + size[rest] - shared) - 1e-9]
            open_[reached] = False
            edges += [(int(nodes[v]), int(nodes[r])) for r in reached]
            stack.extend(reached.tolist())
    return edges


def _nodes(words: int, bits: int):
    def run(batches: Batches) -> Batches:
        for b in sliced(batches):
            nodes, prints = [], []
            for g in shingle_sets(utf8(b.column(1)), words):
                nodes.append(node_of(g))
                prints.append(np.packbits(fingerprint(g, bits)).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], names=["row", "node", "print"])

    return run


def _dealt(segments: int, bits: int):
    """Two records for each segment of the fingerprints (node, print): key = (segment and half, this half, other half)."""
    half = bits // 2
    place = np.arange(2 * segments, dtype=np.int64) << half

    def run(batches: Batches) -> Batches:
        for b in batches:
            nodes, prints = b.column(0).to_numpy(), b.column(1).to_pylist()
            for k in range(0, len(nodes), DEALT):
                some = prints[k : k + DEALT]
                on = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1)[:, : WHOLE + segments * bits]
                whole = np.packbits(on[:, :WHOLE], axis=1).view(np.int64)
                halves = (on[:, WHOLE:].reshape(-1, half).astype(np.float32) @ (2.0 ** np.arange(half)).astype(np.float32)).astype(np.int64).reshape(-1, segments, 2)
                key = (halves.reshape(len(some), -1) | place) << half | halves[:, :, ::-1].reshape(len(some), -1)
                columns = [key.ravel(), *(np.repeat(x, 2 * segments) for x in (nodes[k : k + DEALT], *whole.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", *(f"w{i}" for i in range(WHOLE // 64))])

    return run


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes one component of each pair's two, in place: label is the least member of each one's component."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label[:] = label[label]


def joined(key: np.ndarray, node: np.ndarray, whole: np.ndarray, half: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(least member, other member) of the components of nodes that share a block and a one-wildcard variant of its other half, and differ in `within` of the whole bits at most."""
    names, place = np.unique(node, return_inverse=True)
    label = np.arange(len(names))
    for bit in range(half):
        variant = key & ~np.int64(1 << bit)
        order = np.argsort(variant, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(variant[order]) != 0])
        sizes = np.diff(np.r_[starts, len(key)])
        for n in np.unique(sizes[(sizes > 1) & (sizes <= PAIRS)]):
            one, two = np.triu_indices(n, 1)
            at, step = starts[sizes == n], max(1, SLICE // len(one))
            for k in range(0, len(at), step):
                a, b = (order[(at[k : k + step, None] + x).ravel()] for x in (one, two))
                apart = label[place[a]] != label[place[b]]
                a, b = a[apart], b[apart]
                near = _differ(whole[a], whole[b]) <= within
                merge(label, place[a[near]], place[b[near]])
        for s, n in zip(starts[sizes > PAIRS], sizes[sizes > PAIRS]):
            rest, stack, found = order[s : s + n], [], []
            while len(rest):
                if not stack:
                    stack, rest = [rest[0]], rest[1:]
                v = stack.pop()
                near = _differ(whole[rest], whole[v]) <= within
                if near.any():
                    found.append((np.full(near.sum(), v), rest[near]))
                    stack.extend(rest[near])
                    rest = rest[~near]
            if found:
                merge(label, *(place[np.concatenate(x)] for x in zip(*found)))
    other = np.flatnonzero(label != np.arange(len(label)))
    return names[label[other]], names[other]


def _joined(half: int, within: int):
    def made(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, node, *whole = np.concatenate(parts, axis=1)
        pairs = joined(key, node, np.column_stack(whole).view(np.uint64), half, within)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] = []
        for b in batches:
            part = np.stack([c.to_numpy() for c in b.columns])
            if sum(x.shape[1] for x in held) >= SLICE:  # what is held ends with the block of its last record
                block = part[0] >> half
                cut_at = int(np.searchsorted(block, held[-1][0, -1] >> half, "right"))
                if cut_at < len(block):
                    yield made(held + [part[:, :cut_at]])
                    held, part = [], part[:, cut_at:]
            if part.shape[1]:
                held.append(part)
        if held:
            yield made(held)

    return run


def proposed(prints: DataFrame, segments: int, bits: int, within: int) -> DataFrame:
    """Edges (a, b) that connect all nodes of prints (node, print) with a segment that differs in one bit at most and `within` other whole bits at most."""
    half, n = bits // 2, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "key long, node long, " + ", ".join(f"w{i} long" for i in range(WHOLE // 64))
    records = prints.mapInArrow(_dealt(segments, bits), kinds)
    return records.repartition(n, F.shiftright("key", half)).sortWithinPartitions("key").mapInArrow(_joined(half, within), "a long, b long")


def _sets(words: int):
    def run(batches: Batches) -> Batches:
        for b in sliced(batches):
            for k, g in enumerate(shingle_sets(utf8(b.column(2)), words)):
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(1)[k : k + 1], pa.array([g.tobytes()], pa.binary())], names=["cluster", "node", "grams"])

    return run


def _walked(similarity: float):
    def made(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        """(node, group) of the nodes that are linked to one before them."""
        group: dict[int, int] = {}
        for a, b in forest(np.array(nodes, np.int64), [np.frombuffer(s, np.uint64) for s in sets], similarity):
            group[b] = group.get(a, a)
        return list(group.items())

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["node", "group"])

    def run(batches: Batches) -> Batches:
        last, nodes, sets, found = None, [], [], []
        for b in batches:
            for cluster, node, grams in zip(*(c.to_pylist() for c in b.columns)):
                if cluster != last:
                    found += made(nodes, sets) if nodes else []
                    last, nodes, sets = cluster, [], []
                    if len(found) > 10_000:
                        yield batch(found)
                        found = []
                nodes.append(node)
                sets.append(grams)
        yield batch(found + (made(nodes, sets) if nodes else []))

    return run


def groups(keyed: DataFrame, text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, key: str = "__row") -> DataFrame:
    """(row, group) for each row of keyed, told apart by the column `key`; rows of a group are linked at `similarity` or above.

    Null and empty texts are one group, and so are texts with the same set of shingles (repeated rows too). A text of
    fewer words is one shingle. Texts of any length are read whole; an empty table gives no rows.
    """
    segments, bits, within = plan(keyed.count(), similarity)
    text = F.col(text_col).cast("string").alias("text")
    rows = cut(keyed.select(F.col(key).alias("__row"), text).mapInArrow(_nodes(words, WHOLE + segments * bits), "row long, node long, print binary"))
    prints = rows.where("print is not null").groupBy("node").agg(F.min(F.struct("row", "print")).alias("m")).select("node", "m.print")
    clusters = connected(proposed(prints, segments, bits, within)).withColumnRenamed("root", "cluster")
    asked = rows.groupBy("node").agg(F.min("row").alias("__row")).join(clusters, "node")
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = keyed.select(F.col(key).alias("__row"), text).join(asked, "__row").select("cluster", "node", "text").mapInArrow(_sets(words), "cluster long, node long, grams binary")
    linked = sets.repartition(n, "cluster").sortWithinPartitions("cluster").mapInArrow(_walked(similarity), "node long, group long")
    return rows.select("row", "node").join(linked, "node", "left").select("row", F.coalesce("group", "node").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest id (null last; ties: the smallest hash of the text, then any); columns as given.

    Null and empty texts are one group, repeated rows are copies of each other, and an empty table gives no rows.
    """
    keyed, key = with_row_keys(docs)
    return one_of_each(keyed, groups(keyed, text_col, words, similarity, key), id_col, text_col, key)
