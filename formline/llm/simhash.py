"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in three bits at most have
one segment in which they differ in one bit at most (fewer segments than the usual four). Each segment is indexed
under its 32 variants with one bit wildcarded: such a pair shares a variant of that segment, so an equality join on
(segment, wildcard, remaining bits) finds every pair, which is then verified on all 64 bits.

Different texts with one fingerprint are one row of the index. A bucket isn't expanded into pairs: its links are
walked from fingerprint to fingerprint, each step comparing one with all that are not yet reached, and only a
spanning forest is kept. That loses no link for components: what is linked in a bucket stays connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected
from .repeats import spooled
from .textops import Batches, free_name, utf8

SEED = 42
SEGMENTS, BITS = 2, 32
#: Shingles whose bits are unpacked at once, and fingerprints of a bucket that are walked as one.
CHUNK, BUCKET = 1 << 14, 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the shingles, repeats included."""
    tokens = text.lower().split()  # bytes: only A-Z change, and the separators are U+0020 and U+0009 to U+000D
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)))]
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), CHUNK):
        ones += np.unpackbits(values[k : k + CHUNK], axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the signed form of the 64 bits. Null and empty texts have fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among different fingerprints."""
    rest, edges, stack = fps, [], []
    while len(rest):
        if not stack:
            stack, rest = [rest[0]], rest[1:]
        v = stack.pop()
        near = np.bitwise_count(rest ^ v) <= bits
        if near.any():
            reached = rest[near]
            edges += [(v, x) for x in reached]
            stack.extend(reached)
            rest = rest[~near]
    return edges


def _walked(bits: int, most: int | None):
    """Edges (a, b) of the buckets (key, fp) of a partition; the members of buckets of more than `most` come back as (fp, key, hot)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])

    def rows(pairs: np.ndarray, hot: bool) -> pa.RecordBatch:
        pairs = pairs.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), hot))], schema=schema)

    def run(batches: Batches) -> Batches:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits
        edges = [np.column_stack([fp[two][near], fp[two + 1][near]])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if most is not None and n > most:
                yield rows(np.column_stack([fp[s : s + n], key[s : s + n].view(np.uint64)]), True)
            elif found := _forest(fp[s : s + n], bits):
                edges.append(np.array(found, np.uint64))
        if sum(map(len, edges)):
            yield rows(np.unique(np.concatenate(edges).astype(np.uint64), axis=0), False)

    return run


def links(fps: DataFrame, bits: int = 3, most: int = BUCKET) -> DataFrame:
    """Edges (a, b) among the different values of fp that connect all pairs at `bits` (3 at most) differing bits or fewer.

    A bucket of more than `most` fingerprints is split by the other segment's four bytes, of which such a pair shares
    one at least. Nulls aren't linked, and no values give no edges.
    """
    if bits > 2 * SEGMENTS - 1:
        raise ValueError("two segments find pairs at three bits or fewer")
    low, high = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned("fp", BITS)
    variant = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * BITS - 1))).alias("v")
    masked = F.when(F.col("v") < BITS, low).otherwise(high).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, v % {BITS})")))
    keys = fps.where("fp is not null").select("fp").distinct().select("fp", variant).select((F.col("v").cast("long") * (1 << BITS) + masked).alias("key"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "a long, b long, hot boolean"
    found = spooled(keys.repartition(n, "key").mapInArrow(_walked(bits, most), kinds))
    other = F.when(F.col("key") < BITS * (1 << BITS), high).otherwise(low)
    byte = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)).alias("x")) for i in range(BITS // 8)])).alias("p")
    split = found.where("hot").select(F.col("a").alias("fp"), F.col("b").alias("key")).select("key", "fp", byte).select(F.xxhash64("key", "p").alias("key"), "fp")
    rest = split.repartition(n, "key").mapInArrow(_walked(bits, None), kinds)
    return found.where("not hot").select("a", "b").unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hexadecimal digits and the smallest doc_id reachable over links.

    Null and empty texts share fingerprint zero, linked like any other. Rows with a null id keep their fingerprint
    and take the smallest id of their component (null if it has none). Repeated rows each appear; an empty table
    gives no rows; other columns aren't read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classes = _classes(fps, bits)
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, root, component_id) for each different fp."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(fps, bits))
    class_of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(class_of.join(smallest, "root").select("fp", "root", "component_id"))


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row in a column of a free name, which a checkpoint makes lasting; and that name."""
    key = free_name(docs.columns, "row")
    return cut(docs.withColumn(key, F.monotonically_increasing_id())), key


def one_of_each(keyed: DataFrame, groups: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """The row of the smallest id (null last; ties: smallest hash of the text, then any) of each group of groups (row, group), without the column `key`."""
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text"), F.col(key).alias("row"))
    ranked = keyed.select(rank.alias("rank"), F.col(key).alias("row")).join(groups, "row")
    kept = ranked.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(key))
    return keyed.join(kept, key, "left_semi").drop(key)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id, or any if all ids are null; columns as given.

    Null and empty texts are one group; repeated rows are copies of each other; an empty table gives no rows.
    """
    keyed, key = with_row_keys(docs)
    fps = cut(fingerprints(keyed, key, text_col, words))
    return one_of_each(keyed, fps.join(_classes(fps, bits), "fp").select(F.col("doc_id").alias("row"), F.col("root").alias("group")), id_col, text_col, key)
