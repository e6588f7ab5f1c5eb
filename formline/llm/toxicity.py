"""Toxicity by a classifier chain.

Categories are predicted one after the other; each category's linear model sees the words of the text and the
probabilities of the categories before it. In training those probabilities are out-of-fold predictions, so that a
later model meets them as imperfect as they will be on unseen text.

The models are fitted on a bounded sample of labelled rows (MAX_LABELLED, those of the smallest hash of the id);
everything else covers all rows. Features are the presence of the words and of the word beginnings (PREFIXES bytes
long, so that inflected words share some) that separate a category's classes best in the sample (MAX_WORDS a
category), counted by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textops import Batches, folded, utf8

#: Labelled rows used for fitting, at most; words a category's model looks at, at most; folds.
MAX_LABELLED, MAX_WORDS, FOLDS = 20_000, 512, 5
#: Lengths of word beginnings in bytes; 0 stands for the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
#: Rows in which a word must occur in the sample.
LEAST_ROWS = 5
#: Words a task counts before it hands its counts on.
MOST_COUNTED = 150_000
#: Bits of a count: over MAX_LABELLED.
WIDTH = 20

_letters = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    """Different words: runs of letters in lower case; every non-ASCII byte counts as a letter."""
    return set(folded(text).translate(_letters).split())


def features_of(text: bytes) -> dict[int, set[bytes]]:
    """For each length of PREFIXES the different word beginnings of a text."""
    words = words_of(text)
    return {k: {w[:k] for w in words if len(w) >= k} if k else words for k in PREFIXES}


def _named(features: dict[int, set[bytes]]) -> list[bytes]:
    return [bytes([k]) + w for k, ws in features.items() for w in ws]


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One category's model: prefix length -> word -> weight, weights of the earlier categories' probabilities, intercept."""

    name: str
    words: dict[int, dict[bytes, float]]
    earlier: list[float]
    intercept: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def probabilities(self, text: bytes) -> list[float]:
        present = features_of(text)
        found: list[float] = []
        for link in self.links:
            z = link.intercept + sum(w * p for w, p in zip(link.earlier, found))
            z += sum(weights[w] for k, weights in link.words.items() for w in weights.keys() & present[k])
            found.append(float(probability(z)))
        return found


def _blocks(marks: np.ndarray, rest: np.ndarray, rows: np.ndarray, size: int = 1024):
    """The chosen rows of [marks, rest, 1] as doubles, a few at a time: the whole matrix is never made."""
    for k in range(0, len(rows), size):
        some = rows[k : k + size]
        yield some, np.hstack([marks[some].astype(float), rest[some], np.ones((len(some), 1))])


def _logistic(marks: np.ndarray, rest: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on some rows by Newton steps; the last weight is the intercept and isn't penalised."""
    width = marks.shape[1] + rest.shape[1] + 1
    w, penalty = np.zeros(width), np.full(width, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        h, g = np.diag(penalty), -penalty * w
        for some, x in _blocks(marks, rest, rows):
            p = probability(x @ w)
            h += (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
            g += x.T @ (y[some] - p)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over 0/1 columns of labels, in the order given.

    Labels other than 0 and 1, null among them, and labels of unknown rows are left out; of several labels of an id the
    greatest counts, and of several texts the first in order. A category of one class only predicts its base rate.
    No labelled rows give a chain that predicts 0. Null and empty texts have no words; other columns aren't read.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    known = known.where(" and ".join(["doc_id is not null", *[f"y{i} in (0, 1)" for i in range(len(categories))]]))
    known = known.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)  # bounded, so that it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ys = [f"y{i}" for i in range(len(categories))]
    rows = cut(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", *ys).agg(F.min("text").alias("text")))
    counted = pa.schema([("word", pa.binary()), ("n", pa.int64()), *[(y, pa.int64()) for y in ys]])

    def count(batches: Batches) -> Batches:
        seen: dict[bytes, int] = {}  # rows and rows of each class, side by side in one number

        def told() -> pa.RecordBatch:
            sums = [pa.array([n >> WIDTH * k & (1 << WIDTH) - 1 for n in seen.values()], pa.int64()) for k in range(1 + len(ys))]
            found = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *sums], schema=counted)
            seen.clear()
            return found

        for b in batches:
            ones = zip(*(b.column(k + 1).to_pylist() for k in range(len(ys))))
            for text, own in zip(utf8(b.column(0)), ones):
                mark = 1 + sum(y << WIDTH * (k + 1) for k, y in enumerate(own))
                for word in _named(features_of(text)):
                    seen[word] = seen.get(word, 0) + mark
                if len(seen) > MOST_COUNTED:
                    yield told()
        yield told()

    parts = rows.select("text", *ys).mapInArrow(count, "word binary, n long, " + ", ".join(f"{y} long" for y in ys))
    counts = parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= LEAST_ROWS)
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    chain = Chain()
    if not totals["n"]:
        chain.links = [Link(c, {}, [], -12.0) for c in categories]
        return chain
    counts = cut(counts)
    n, chosen = totals["n"], []
    for y in ys:
        share = (totals[y] or 0) / n
        if 0 < share < 1:  # the greatest standardised differences between a word's rate and the whole rate
            gap = F.abs(F.col(y) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
            chosen.append([bytes(r.word) for r in counts.orderBy(F.desc(gap), "word").limit(MAX_WORDS).collect()])
        else:
            chosen.append([])
    wanted = {w: i for i, w in enumerate(dict.fromkeys(w for ws in chosen for w in ws))}

    def marked(batches: Batches) -> Batches:
        schema = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), *[(y, pa.int32()) for y in ys]])
        for b in batches:
            at = [sorted(wanted[w] for w in wanted.keys() & set(_named(features_of(t)))) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), *[b.column(k + 2) for k in range(len(ys))]], schema=schema)

    got = rows.select("doc_id", "text", *ys).mapInArrow(marked, "doc_id long, at array<int>, " + ", ".join(f"{y} int" for y in ys)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    marks = np.zeros((len(got), len(wanted)), bool)
    for i, r in enumerate(got):
        marks[i, list(r["at"])] = True
    folds, earlier = np.arange(len(got)) % FOLDS, []
    for name, y_name, words in zip(categories, ys, chosen):
        y = np.array([r[y_name] for r in got], float)
        if not words or y.min() == y.max():
            rate = np.clip(y.mean(), 1e-5, 1 - 1e-5)
            chain.links.append(Link(name, {}, [0.0] * len(earlier), float(np.log(rate / (1 - rate)))))
            earlier.append(np.full(len(y), rate))
            continue
        own = marks[:, [wanted[w] for w in words]]
        rest = np.column_stack(earlier) if earlier else np.zeros((len(y), 0))
        w = _logistic(own, rest, y, np.arange(len(y)))
        weights: dict[int, dict[bytes, float]] = {}
        for word, value in zip(words, w[: len(words)].tolist()):
            weights.setdefault(word[0], {})[word[1:]] = value
        chain.links.append(Link(name, weights, w[len(words) : -1].tolist(), float(w[-1])))
        held = np.zeros(len(y))
        for f in range(FOLDS):
            part = _logistic(own, rest, y, np.flatnonzero(folds != f))
            for some, x in _blocks(own, rest, np.flatnonzero(folds == f)):
                held[some] = probability(x @ part)
        earlier.append(held)
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, category: str = "toxic") -> DataFrame:
    """doc_id, p_<category> for each link, and toxic (p of `category` at threshold or above) for each row of docs.

    Null and empty texts get the probabilities of a text without words; a null id stays null; repeated rows are
    scored each; an empty table gives no rows; other columns aren't read. There is no shuffle.
    """
    names = [k.name for k in chain.links]
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{n}", pa.float64()) for n in names]])

    def run(batches: Batches) -> Batches:
        for b in batches:
            p = np.array([chain.probabilities(t) for t in utf8(b.column(1))]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names))
    return out.withColumn("toxic", F.col(f"p_{category}") >= threshold)


def clean(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, category: str = "toxic") -> DataFrame:
    """The rows of docs that the chain doesn't reject; columns as given. The text is judged where it is read, without a join.

    Null and empty texts are judged as texts without words; rows of a null id and repeated rows are judged each; a
    probability at the threshold rejects; an empty table gives no rows.
    """
    at = [k.name for k in chain.links].index(category)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series([chain.probabilities((t or "").encode())[at] >= threshold for t in texts])

    return docs.where(~rejected(F.col(text_col).cast("string")))
