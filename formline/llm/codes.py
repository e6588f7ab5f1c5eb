"""Vector code compression: integer product codebooks whose nearest entries are found in GNATs.

A vector of floors is cut into equal consecutive parts, and each part is replaced by the index of the nearest entry of its
position's codebook. Codebooks come from a few rounds of assignment and integer means.

The entries of a codebook stand in a geometric near-neighbour access tree: a node has split points, every other entry
goes to the child of its nearest split point, and for each split point the node stores the least and the greatest distance
to the entries of each child. A query's distances to the split points then rule out whole children: one whose range
begins behind, or ends before, what the best entry so far could reach. Ranges and distances are rounded outwards and only
strictly worse children go, so that equal distances are still compared, as integers, and the lower index wins.

Vectors are packed once. A round is one pass over them: each task holds its codebooks' trees and leaves a count and sums for
each entry it used, which Spark adds up; codebooks (parts x entries x components) are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import spooled
from .textops import Batches

#: Parts of a vector, entries of a codebook and rounds.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Split points of a node, entries of a leaf, and vectors searched at once.
SPLITS, LEAF, BLOCK = 12, 16, 1 << 13
#: Rounding of distances, far above what a square root loses; digits (in bits) that sums of long integers are told in.
EPSILON, LIMB = 1e-12, 31
#: Bytes of the labels' sums that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
LONG = (1 << 63) - 1


def in_doubles(q: np.ndarray, p: np.ndarray) -> bool:
    """Whether doubles hold all squared distances of the rows of q and p, and what they're summed up from."""
    return q.dtype != object and p.dtype != object and 4.0 * q.shape[1] * float(max(np.abs(q).max(initial=0), np.abs(p).max(initial=0))) ** 2 < 2.0**51


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of q and p: integers in doubles if these hold them, else integers of any size."""
    if in_doubles(q, p):
        a, b = q.astype(float), p.astype(float)
        return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    a, b = q.astype(object), p.astype(object)
    out = np.zeros((len(a), len(b)), object)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def _roots(x: np.ndarray) -> np.ndarray:
    """Square roots in doubles; beyond these infinite."""
    if x.dtype == object:
        x = np.array([float(v) if v < 1 << 1000 else np.inf for v in x.ravel()]).reshape(x.shape)
    return np.sqrt(x)


class Gnat:
    """A node of the tree over some entries of a codebook."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index, self.all = np.arange(len(points)) if index is None else index, points
        self.children: list[Gnat] = []
        if len(index) <= LEAF:
            self.own, self.points = index, points[index]
            return
        own = [0]
        d = squares(points[index], points[index])
        near = d[:, 0].copy()
        while len(own) < SPLITS:  # the entry furthest from all split points is the next one
            near[own] = -1
            own.append(int(np.argmax(near)))
            near = np.minimum(near, d[:, own[-1]])
        own = sorted(own)
        self.own, self.points = index[own], points[index[own]]
        owner = np.argmin(d[:, own], axis=1)
        owner[own] = -1
        low, high = [], []
        for j in range(SPLITS):
            members = np.flatnonzero(owner == j)
            if len(members):
                r = _roots(d[np.ix_(own, members)])
                low.append(r.min(1) * (1 - EPSILON))
                high.append(r.max(1) * (1 + EPSILON))
                self.children.append(Gnat(points, index[members]))
        #: Distances of each split point to the entries of each child, rounded outwards.
        self.low, self.high = np.array(low).T, np.array(high).T

    def search(self, q: np.ndarray, best: np.ndarray, at: np.ndarray, rows: np.ndarray, met: list[int]) -> None:
        """Betters best (squared distances) and at (indexes) of the queries in `rows`; met[0] counts distances."""
        d = squares(q[rows], self.points)
        met[0] += d.size
        least = np.argmin(d, axis=1)  # own is ascending, so the first of equals has the lowest index
        value, entry = d[np.arange(len(rows)), least], self.own[least]
        if best.dtype == object and value.dtype != object:
            value = value.astype(np.int64).astype(object)
        better = (at[rows] < 0) | (value < best[rows]) | ((value == best[rows]) & (entry < at[rows]))
        best[rows[better]], at[rows[better]] = value[better], entry[better]
        if not self.children:
            return
        root = _roots(d)
        inner, outer = root * (1 - EPSILON), root * (1 + EPSILON)
        with np.errstate(invalid="ignore"):  # infinite distances rule nothing out
            away = np.stack([np.maximum(inner - self.high[:, j], self.low[:, j] - outer).max(1) for j in range(len(self.children))], axis=1)
        away = np.where(np.isnan(away), -np.inf, away)
        first = np.argmin(away, axis=1)
        for nearest in (True, False):  # the most promising child of each query is searched before any other
            for j, child in enumerate(self.children):
                open_ = ((first == j) == nearest) & ~(away[:, j] > _roots(best[rows]) * (1 + EPSILON))
                if open_.any():
                    child.search(q, best, at, rows[open_], met)


def nearest(tree: Gnat, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: the lower index), and the distances computed."""
    at, met = np.full(len(q), -1), [0]
    best = np.zeros(len(q), float if in_doubles(q, tree.all) else object)
    for s in range(0, len(q), BLOCK):
        tree.search(q, best, at, np.arange(s, min(s + BLOCK, len(q))), met)
    return at, best, met[0]


def _integers(rows: list[list[int]]) -> np.ndarray:
    flat = [abs(x) for r in rows for x in r]
    return np.array(rows, np.int64 if max(flat, default=0) < 1 << 62 else object).reshape(len(rows), -1)


def _floors(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of an array column as a matrix; missing components count as zero."""
    lengths = np.asarray(column.value_lengths())
    x = np.zeros((len(column), width))
    x[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not len(scaled) or np.abs(scaled).max(initial=0) < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(s) if np.isfinite(s) else int(v) * int(scale) for s, v in zip(*rows)] for rows in zip(scaled.tolist(), x.tolist())], object)


#: A packed vector: bytes of a component (0: decimal text), and the components.
PACKED = "vec_id long, kind int, v binary"


def _packed(rows: DataFrame, width: int, scale: float) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("kind", pa.int32()), ("v", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            m = _floors(b.column("v"), width, scale)
            kind = 0 if m.dtype == object else 4 if np.abs(m).max(initial=0) < 1 << 31 else 8
            v = [" ".join(map(str, r)).encode() for r in m] if not kind else [r.tobytes() for r in m.astype(f"<i{kind}")]
            fields = [schema.field(0), b.schema.field("label"), schema.field(1), schema.field(2)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(np.full(len(m), kind, np.int32)), pa.array(v, pa.binary())], schema=pa.schema(fields))

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, kind int, v binary")


def _unpacked(kinds: np.ndarray, blobs: list[bytes], width: int) -> np.ndarray:
    """Vectors of one batch; those of several kinds as the widest."""
    if (kinds == 4).all() or (kinds == 8).all():
        return np.frombuffer(b"".join(blobs), f"<i{kinds[0]}").reshape(len(blobs), width).astype(np.int64)
    rows = [[int(x) for x in v.decode().split()] if not k else np.frombuffer(v, f"<i{k}").tolist() for k, v in zip(kinds, blobs)]
    return _integers(rows)


class Codebooks:
    """Entries of each part position, and the trees over them."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = [_integers(e) for e in entries]
        self.trees: list[Gnat] | None = None

    def __getstate__(self):
        return self.entries

    def __setstate__(self, state):
        self.entries, self.trees = state, None

    def assigned(self, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        """Indexes (rows x parts), squared distances of each part, and the distances computed."""
        self.trees = self.trees or [Gnat(e) for e in self.entries]
        d, index, best, met = m.shape[1] // len(self.trees), [], [], 0
        for p, tree in enumerate(self.trees):
            at, value, n = nearest(tree, np.ascontiguousarray(m[:, p * d : (p + 1) * d]))
            index.append(at)
            best.append(value)
            met += n
        return np.column_stack(index), best, met

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for r in e.tolist() for x in r).encode()).hexdigest()


def _limbs(value: int, n: int) -> list[int]:
    """Digits of LIMB bits, all of the number's sign."""
    size, sign = abs(value), -1 if value < 0 else 1
    return [sign * (size >> LIMB * k & (1 << LIMB) - 1) for k in range(n)]


def _moved(packed: DataFrame, books: Codebooks, width: int, limbs: int) -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of its parts; those without parts stay."""
    parts, k = len(books.entries), len(books.entries[0])
    d = width // parts
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        n, s = np.zeros(parts * k, np.int64), np.zeros((parts * k, d), np.int64 if limbs == 1 else object)
        for b in batches:
            m = _unpacked(b.column(0).to_numpy(), b.column(1).to_pylist(), width)
            index, _, _ = books.assigned(m)
            for p in range(parts):
                at, part = index[:, p] + p * k, m[:, p * d : (p + 1) * d]
                n += np.bincount(at, minlength=parts * k)
                if limbs > 1:
                    np.add.at(s, at, part.astype(object))
                else:  # below 2**31 x rows of a batch: exact in doubles
                    for i in range(d):
                        s[:, i] += np.bincount(at, part[:, i], parts * k).astype(np.int64)
        used = np.flatnonzero(n)
        sums = [[x for v in s[i] for x in _limbs(int(v), limbs)] for i in used] if limbs > 1 else list(s[used])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums, pa.list_(pa.int64()))], schema=schema)

    each = packed.select("kind", "v").mapInArrow(run, "slot int, n long, s array<long>")
    total = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d * limbs)])
    entries = [[[int(x) for x in r] for r in e.tolist()] for e in books.entries]
    for row in total.collect():  # a row for each entry
        digits = [int(x) for x in row[2:]]
        sums = [sum(digits[i * limbs + l] << LIMB * l for l in range(limbs)) if limbs > 1 else digits[i] for i in range(d)]
        entries[row.slot // k][row.slot % k] = [x // row.n for x in sums]
    return Codebooks(entries)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("v")).where("v is not null").where(~bad)


def _first(rows: DataFrame, k: int, parts: int, width: int, scale: float) -> Codebooks:
    """Codebooks of the k smallest ids; null ids count as one behind all others, and of rows that share an id the smallest vector is taken."""
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(k).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) if known else F.lit(False)
    least = rows.where(chosen | F.col("vec_id").isNull() if None in ids else chosen).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id"))
    m = _floors(pa.array([r.v for r in least.collect()], pa.list_(pa.float64())), width, scale)
    d = width // parts
    return Codebooks([[[int(x) for x in r[p * d : (p + 1) * d]] for r in m.tolist()] for p in range(parts)])


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[Codebooks, DataFrame, int] | None:
    """(codebooks, packed vectors, components of a packed vector), or None if no vector is left. See `compress`."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part: 1 to 256 entries")
    rows = _kept(vectors, id_col, vector_col, label_col)
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    width = max(1, -(-size // parts)) * parts
    books = _first(rows, entries, parts, width, scale)
    packed = spooled(_packed(rows, width, scale))
    least, longest = packed.agg(F.min("kind"), F.max(F.when(F.col("kind") == 0, F.octet_length("v")))).first()
    bits = 31 if least == 4 and packed.where("kind = 8").isEmpty() else max(64, 4 * (longest or 0))
    limbs = 1 if bits == 31 else -(-(bits + 40) // LIMB)
    for _ in range(rounds):
        books = _moved(packed, books, width, limbs)
    return books, packed, width


def encode(books: Codebooks, packed: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, code, error, distances): two hexadecimal digits for each part, the squared distances' sum, and how many distances were computed for the batch (in its first row)."""
    label = packed.schema["label"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for b in batches:
            m = _unpacked(b.column("kind").to_numpy(), b.column("v").to_pylist(), width)
            index, best, met = books.assigned(m)
            text = index.astype(np.uint8).tobytes().hex()
            step = 2 * index.shape[1]
            error = [min(int(x), LONG) for x in sum(best[1:], best[0])]
            columns = [b.column("vec_id"), b.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error, pa.int64()), pa.array([met, *[0] * (len(m) - 1)][: len(m)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "distances"])

    return packed.mapInArrow(run, f"vec_id long, label {label}, code string, error long, distances long")


def _long(c: Column) -> Column:
    return F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row whose vector is neither null nor holds null or non-finite components.

    Shorter vectors count as padded with zeros, and all are padded to a multiple of `parts`; empty vectors are all zero.
    Rows with a null id are coded like others; a null label is a label of its own (label_col None: all rows share one).
    Repeated rows are each coded and each count in the means. The first codebooks hold one entry for each of the
    smallest ids (fewer if there are fewer). Equal distances go to the lower index. Errors beyond a long are given as its
    end. Empty tables give no rows; other columns aren't read.
    """
    made = fit(vectors, parts, entries, rounds, scale, id_col, vector_col, label_col)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, packed, width = made
    coded = spooled(encode(books, packed, width).drop("distances"))
    sums = spooled(coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")).withColumnRenamed("label", "of"))
    n, longest = sums.agg(F.count("*"), F.max(F.octet_length(F.col("of").cast("string")))).first()
    joined = coded.join(F.broadcast(sums) if n * (64 + (longest or 0)) <= BROADCAST_BYTES else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
