"""Exact top-k inner products by pivot-table elimination.

The distances of every vector to the pivots and to the origin are computed once, in the pass that packs the table into
blocks. They fix a vector's place in the space that the pivots span, and how far from that space it lies. For a query q
and a candidate x these two give the greatest lower bound of their distance that the pivots' distances allow:
|q - x|^2 >= |Pq - Px|^2 + (r(q) - r(x))^2, with the projections P and the remainders r; no single pivot's bound
|d(q, p) - d(x, p)| exceeds it. With the norms it bounds the inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 from
above. Candidates are evaluated in the order of that bound until the k-th score so far exceeds every bound that is left.

A block of candidates is one row, and so is a block of queries; each pair of blocks is a task's work, from which
only k rows for a query leave. A query brings along its k-th score among the sampled vectors, below which no block
has to look.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .textops import Batches

#: Vectors of a block, and candidates evaluated between two looks at the bounds.
BLOCK, STEP = 1 << 12, 32
#: Vectors read to choose the pivots from, and bytes of queries that a broadcast may hold.
SAMPLE, BROADCAST_BYTES = 2048, 64 << 20
#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null ids and vectors, and without vectors that hold a null or non-finite component."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where("v is not null and vec_id is not null")
    return picked.where(~F.coalesce(bad, F.lit(True)))


def _matrix(lists, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of rows of possibly different lengths as one matrix; missing components count as zero.

    A double holds such a value exactly whatever its size. Only products beyond the range of doubles need objects.
    """
    out = np.zeros((len(lists), width))
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[math.floor(scale * x) if math.isfinite(scale * x) else int(x) * int(scale) for x in row] for row in out.tolist()], object)


def _greatest(x: np.ndarray) -> float:
    return _float(np.abs(x).max(initial=0)) if x.size else 0.0


def exact_scores(c: np.ndarray, q: np.ndarray, greatest: float) -> np.ndarray:
    """Inner products of rows of c with q: in doubles where these are exact, else in integers of any size."""
    if greatest < EXACT and c.dtype != object and q.dtype != object:
        return (c @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in c], object)


def _floats(x: np.ndarray) -> np.ndarray:
    """Nearest doubles; integers beyond them are infinite."""
    return x if x.dtype != object else np.array([[_float(a) for a in row] for row in x], float)


def _float(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


class Pivots:
    """Points of one norm in the directions of vectors far from the space of those before them."""

    def __init__(self, x: np.ndarray, n: int):
        x = _floats(x)
        x = np.where(np.isfinite(x), x, 0.0)
        biggest = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        x = x[biggest[:, 0] > 0] / biggest[biggest[:, 0] > 0]
        size = np.sqrt((x * x).sum(1))
        unit = x / size[:, None]
        self.norm = float(np.clip(np.median(size * biggest[biggest > 0]), 1e-100, 1e100)) if len(x) else 1.0
        rest, left, chosen = unit, np.ones(len(unit)), []
        while len(chosen) < min(n, len(unit)) and left.max() > 1e-3:
            chosen.append(int(np.argmax(left)))
            axis = rest[chosen[-1]] / math.sqrt(left[chosen[-1]])
            rest = rest - np.outer(rest @ axis, axis)
            left = (rest * rest).sum(1)
        self.points = unit[chosen] * self.norm
        self.triangle = np.linalg.qr(self.points.T, mode="r") if chosen else np.zeros((0, 0))
        #: What rounding can do to a place, as a share of (|x|^2 + |p|^2) / |p|.
        self.rounding = 1e-12 * (float(np.linalg.cond(self.triangle)) if chosen else 1.0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the origin and to each pivot."""
        x = _floats(x)
        own = (x * x).sum(1)[:, None]
        return np.hstack([own, own + self.norm**2 - 2 * x @ self.points.T])

    def places(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates in the pivots' space followed by the remainder (never too small), norms, and the coordinates' possible error."""
        own = distances[:, 0]
        inner = (own[:, None] + self.norm**2 - distances[:, 1:]) / 2
        at = np.linalg.solve(self.triangle.T, inner.T).T if len(self.points) else inner
        norm, error = np.sqrt(own), self.rounding * (own + self.norm**2) / self.norm
        remainder = np.sqrt(np.maximum(own - (at * at).sum(1) + 4 * norm * error, 0))
        return np.hstack([at, remainder[:, None]]), norm, error


def highest_scores(pivots: Pivots, qd: np.ndarray, cd: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries and candidates from their distances to the pivots.

    The greatest lower bound of |q - x|^2 turned into a product, with room for rounding. Where doubles don't reach
    nothing is bound.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        (q, qn, qe), (c, cn, ce) = pivots.places(qd), pivots.places(cd)
        bound = q @ c.T + np.outer(qn + qe, ce) + np.outer(qe, cn) + 1e-3
    return np.where(np.isfinite(bound), bound, np.inf)


def told(score: int) -> tuple[int, str | None]:
    """A score as a long, and if it is at or beyond an end of that range a string that sorts like it."""
    least, most = -(1 << 63), (1 << 63) - 1
    if least < score < most:
        return score, None
    digits = str(abs(score))
    if score > 0:
        return most, f"1{len(digits):06d}{digits}"
    return least, f"0{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def best_of_block(qid, q, qd, least, cid, c, cd, pivots: Pivots, k: int):
    """Rows (query id, candidate id, score) of each query's k best in a block, ties to the smaller candidate id, and how many were evaluated for each query.

    least: a score that each query's k-th best reaches, or None.
    """
    greatest = _greatest(c) * _greatest(q) * c.shape[1]
    bounds = highest_scores(pivots, qd, cd)
    out, evaluated = [], []
    for i in range(len(q)):
        high = bounds[i]
        live = np.flatnonzero((cid != qid[i]) & (True if least[i] is None else high >= _float(least[i])))
        ranked = live[np.argsort(-high[live], kind="stable")]
        best: list[tuple] = []
        at = 0
        while at < len(ranked) and (len(best) < k or -best[-1][0] <= float(high[ranked[at]])):
            some = ranked[at : at + STEP]
            at += len(some)
            scores = exact_scores(c[some], q[i], greatest).tolist()
            best = sorted([*best, *((-s, x) for s, x in zip(scores, cid[some].tolist()))])[:k]
        evaluated.append(at)
        out += [(int(qid[i]), x, -s) for s, x in best]
    return out, evaluated


#: A block as one row: ids, vectors and distances packed; vectors beyond doubles are kept as text.
PACKED = "ids binary, vectors binary, big boolean, distances binary, least array<string>"


def _packed(rows: DataFrame, pivots: Pivots, width: int, scale: float, k: int = 0, sample: tuple | None = None) -> DataFrame:
    """Blocks of at most BLOCK rows. sample (ids, vectors): each row's k-th score among them stands in `least`."""
    names = ["ids", "vectors", "big", "distances", "least"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            ids = b.column(0).to_numpy().astype(np.int64)
            lists = b.column(1).to_pylist()
            for s in range(0, len(ids), BLOCK):
                part, v = ids[s : s + BLOCK], _matrix(lists[s : s + BLOCK], width, scale)
                big = v.dtype == object
                blob = "\n".join(" ".join(map(str, row)) for row in v).encode() if big else v.tobytes()
                least = []
                if sample is not None:
                    greatest = _greatest(v) * _greatest(sample[1]) * width
                    for i, row in zip(part, v):
                        scores = sorted(exact_scores(sample[1][sample[0] != i], row, greatest).tolist(), reverse=True)
                        least.append(str(scores[k - 1]) if len(scores) >= k else None)
                with np.errstate(over="ignore", invalid="ignore"):
                    distances = pivots.distances(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.tobytes()], pa.binary()), pa.array([blob], pa.binary()), pa.array([big]), pa.array([distances.tobytes()], pa.binary()), pa.array([least], pa.list_(pa.string()))], names=names
                )

    return rows.select("vec_id", "v").mapInArrow(run, PACKED)


def _unpacked(ids: bytes, vectors: bytes, big: bool, distances: bytes, width: int):
    n = len(ids) // 8
    v = np.array([[int(x) for x in row.split(" ")] for row in vectors.decode().split("\n")], object) if big else np.frombuffer(vectors).reshape(n, width)
    return np.frombuffer(ids, np.int64), v, np.frombuffer(distances).reshape(n, -1)


def _found(vectors: DataFrame, k: int, every: int, pivots: int, scale: float, id_col: str, vector_col: str) -> DataFrame | None:
    """(query_id, vec_id, score, beyond, evaluated, candidates): each block's best; the counts stand in a row of each query and block with a null vec_id."""
    rows = sound(vectors, id_col, vector_col)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    width = max(width, 1)
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()
    known = (np.array([r.vec_id for r in sample], np.int64), _matrix([r.v for r in sample], width, scale))
    chosen = Pivots(known[1], min(pivots, width))
    blocks = cut(_packed(rows, chosen, width, scale))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = cut(_packed(asked, chosen, width, scale, k, known))
    size = queries.agg(F.sum(F.octet_length("vectors") + F.octet_length("distances"))).first()[0] or 0
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    if size <= BROADCAST_BYTES:
        pairs = blocks.withColumn("one", F.lit(1)).join(F.broadcast(named.withColumn("one", F.lit(1))), "one")
    else:  # every block of queries meets every block of candidates under a key of its own, so that no key gathers them
        deal = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(deal)))
        pairs = left.join(named.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))), "part")
    columns = ["ids", "vectors", "big", "distances", "q_ids", "q_vectors", "q_big", "q_distances", "q_least"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string()), ("evaluated", pa.int64()), ("candidates", pa.int64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                cid, c, cd = _unpacked(*row[:4], width)
                qid, q, qd = _unpacked(*row[4:8], width)
                best, evaluated = best_of_block(qid, q, qd, [x if x is None else int(x) for x in row[8]], cid, c, cd, chosen, k)
                out = [(i, x, *told(s), None, None) for i, x, s in best] + [(i, None, None, None, e, len(cid)) for i, e in zip(qid.tolist(), evaluated)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long, beyond string, evaluated long, candidates long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 48, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k highest integer inner products among all other rows.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part. Shorter vectors count as padded with zeros, so empty ones score 0. Ties go to the smaller
    vec_id; repeated rows of an id are candidates each, but never for a query of the same id; a query id with several
    rows is answered once, for its smallest vector. Empty tables give no rows; other columns aren't read. Products are
    exact and ranked exactly whatever their size; a score beyond a long's range is given as the end of that range.
    """
    found = _found(vectors, k, every, pivots, scale, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def elimination(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 48, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, evaluated, candidates): how many candidates of each query the bounds left to be evaluated; it depends on the blocks."""
    found = _found(vectors, k, every, pivots, scale, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, evaluated long, candidates long")
    return found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"), F.sum("candidates").alias("candidates"))
