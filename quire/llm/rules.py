"""Quality rules: rule statistics of every text and an isolation forest over them, with a threshold from labelled rows.

An isolation forest of TREES trees is grown on up to SAMPLE labelled rows that pass the base rules (the ones with the
smallest hash of doc_id); each tree takes PSI of them, splits a random feature at a random value, and an odd document ends on a short
path. Scores of all labelled rows that pass the base rules are counted in BINS bins, good and bad apart; the threshold is
the bin edge with the largest gap between bad rows and good rows rejected, among those that reject at most GOOD_LOSS of
the good rows. Without labelled rows of both kinds only the base rules decide.

Edge cases: null text is empty (no words, fails the base rules); repeated rows are returned as often as they come; rows
without doc_id are judged, but never labelled; conflicting labels count as bad; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_side, staged
from .words import lean

TREES, PSI, SAMPLE, BINS, GOOD_LOSS, SEED = 100, 256, 8_192, 1_000, 0.005, 11
MIN_WORDS, MAX_REPEAT = 50, 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_DIGITS = b"0123456789"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = ("word_length", "symbols", "repeats", "other", "distinct")


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    n_space = len(data) - len(data.translate(None, _SPACES))
    chars = len(text) - n_space
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeats = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        m = len(number)
        distinct = m
        if m < 2_000_000:
            w = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            w = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1] * m + ids[2:]
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = np.zeros(n, bool)
            for i in range(3):
                at[i : n - 2 + i] |= twice
            repeats = int(at.sum())
    else:
        distinct = len(set(words))
    digits = len(data) - len(data.translate(None, _DIGITS))
    letters = len(data) - len(data.translate(None, _LETTERS))
    other = len(data) - n_space - letters - digits
    k = max(n, 1)
    # Rates are shrunk towards none, so that a single repeat in a short text isn't an oddity.
    return (n, chars, symbols, dup, repeats, chars / k, symbols / k, repeats / (n + 200), other / (chars + 100), float(np.log1p(distinct) / np.log1p(k)))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} double" for x in FEATURES)


@lean
def _statistics(batches):
    kinds = [pa.int64()] * 5 + [pa.float64()] * len(FEATURES)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


class IsolationForest:
    """Random trees in arrays; score() is 2 ** (-mean path / expected path), near 1 for what is isolated early."""

    def __init__(self, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        self.depth = max(int(np.ceil(np.log2(max(self.psi, 2)))), 1) + 2
        size = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, size), np.int8)
        self.cut = np.full((trees, size), np.inf)
        self.path = np.zeros((trees, size))
        self.leaf = np.ones((trees, size), bool)
        for t in range(trees):
            work = [(0, x[rng.choice(len(x), self.psi, replace=False)], 0)]
            while work:
                at, rows, depth = work.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                open_ = np.flatnonzero(high > low)
                self.path[t, at] = depth + expected(len(rows))
                if depth >= self.depth - 1 or not len(open_):
                    continue
                f = rng.choice(open_)
                cut = rng.uniform(low[f], high[f])
                self.feature[t, at], self.cut[t, at], self.leaf[t, at] = f, cut, False
                left = rows[:, f] < cut
                for side, part in ((1, rows[left]), (2, rows[~left])):
                    if len(part):
                        work.append((2 * at + side, part, depth + 1))
                    else:
                        self.path[t, 2 * at + side] = depth + 1

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.cut)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                down = np.where(x[row, self.feature[t, at]] < self.cut[t, at], 1, 2) + 2 * at
                at = np.where(self.leaf[t, at], at, down)
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.cut) / max(expected(self.psi), 1e-9))


def expected(n: int) -> float:
    """Mean path of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _scorer(forest: IsolationForest | None):
    @F.pandas_udf("double")
    def score(*columns):
        import pandas as pd

        x = np.column_stack([c.to_numpy() for c in columns]) if len(columns[0]) else np.empty((0, len(columns)))
        return pd.Series(forest.score(x) if forest is not None else np.zeros(len(x)))

    return score


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The score from which documents go, from (bin, good rows, bad rows)."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best, at, g, b = 0.0, float("inf"), 0, 0
    for k, x, y in sorted(bins, reverse=True):
        g, b = g + x, b + y
        if good and bad and g <= GOOD_LOSS * good and b / bad - g / good > best:
            best, at = b / bad - g / good, k / BINS
    return at


def _stats(documents: DataFrame) -> DataFrame:
    """The statistics of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = docs.mapInArrow(_statistics, _SCHEMA)
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))


def _good(labels: DataFrame) -> DataFrame:
    own = labels.filter("doc_id is not null and quality is not null")
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))


def _fitted(known: DataFrame) -> tuple[IsolationForest | None, float]:
    """The forest and the score from which documents go, from the staged statistics of labelled rows."""
    known = known.filter("not base_failed")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").select(*FEATURES).limit(SAMPLE).collect()
    forest = IsolationForest(np.array([tuple(r) for r in sample], float)) if len(sample) >= 2 else None
    bins = known.select(F.floor(_scorer(forest)(*FEATURES) * BINS).alias("bin"), "good").groupBy("bin").agg(F.count_if("good"), F.count_if(~F.col("good")))
    return forest, threshold([tuple(r) for r in bins.collect()])


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, score for every row of documents(doc_id, text)."""
    stats = staged(_stats(documents), "rules")
    forest, cut = _fitted(staged(stats.join(_good(labels), "doc_id"), "labelled"))
    out = stats.withColumn("score", _scorer(forest)(*FEATURES))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") < F.lit(cut))).alias("kept"), "score")


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that judge() keeps, with all their columns; texts stay where they are, without a join.

    Statistics for the fit are computed for labelled rows only, if their ids are few enough to go to every task.
    """
    good = staged(_good(labels), "good")
    side = small_side(good)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = _stats(docs.join(side, "doc_id", "left_semi")) if side is not good else _stats(docs)
    forest, cut = _fitted(staged(known.join(side, "doc_id"), "labelled"))

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        rows = [statistics(t) for t in texts]
        x = np.array([r[5:] for r in rows], float).reshape(len(rows), len(FEATURES))
        base = np.array([r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT * r[0] for r in rows], bool)
        return pd.Series(~base & ((forest.score(x) if forest is not None else np.zeros(len(x))) < cut))

    return documents.filter(good(F.col("text").cast("string")))
