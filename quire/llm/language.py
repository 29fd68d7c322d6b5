"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Every word gets a score for each learned language: the mean log-likelihood ratio of its hashed byte n-grams (1 to
ORDER, with word borders) times its length, learned with add-ALPHA smoothing from a bounded sample of about SAMPLE rows
a language (those with the smallest hash of text and doc_id; all rows of a language that has fewer). Every language with
a row is learned. A word whose script (by code-point ranges) makes up less than
RARE of a language's letters rules that language out for the word. The best path over words pays SWITCH for each change
of language; its runs are the spans. A document's language has the most letters in the path; score is their share,
times the mean posterior of these words.

Edge cases: text that is null or has no letter is `und` with score 0; without training rows everything is `und`; ties go
to the language first in order; a text in a script that no language has is scored without ruling out; repeated rows are
returned as often as they come; null lang isn't learned from; a very long text is scored in pieces cut at blanks, with the same result; other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

ORDER, BITS, ALPHA, SAMPLE, SWITCH, RARE = 4, 16, 0.5, 1_000, 6.0, 0.001
#: Bytes of words that are scored at once, times languages; texts are cut at blanks for that.
PIECE = 1_000_000
#: Characters of neighbouring texts that are labelled at once, times languages.
TOGETHER = 64_000_000
#: More values of lang than this aren't languages; learn() then raises, as its tables would outgrow driver and tasks.
MOST = 1_000
#: The first code point of script blocks; the last range is everything else.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(r"[ \t-\r]")


def letters(text: str) -> np.ndarray:
    """Whether each code point is a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    high = points >= 128
    if high.any():
        u, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in u.tolist()])[at]
    return out


def _words(texts: list[str]):
    """For all words of all texts: text number, start and end in bytes; the bytes; letters and script of each word."""
    low = [" " + t.lower() + " " for t in texts]
    coded = [t.encode("utf-8", "replace") for t in low]
    data = np.frombuffer(b"".join(coded), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    of = np.searchsorted(np.cumsum([len(c) for c in coded]), start, "right")
    joined = "".join(low)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    first = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each code point starts
    alpha = np.zeros(len(data), np.int32)
    script = np.zeros(len(data), np.int8)
    alpha[first[: len(points)]] = letters(joined)[: len(first)]
    high = points >= 0x370
    script[first[: len(points)]] = np.where(high, _OF[np.searchsorted(_STARTS, points, "right") - 1], 0)
    if len(start):
        n = np.add.reduceat(alpha, start)
        kind = np.maximum.reduceat(np.where(alpha > 0, script, 0), start)
    else:
        n, kind = np.empty(0, np.int32), np.empty(0, np.int8)
    return of, start, end, data, space, n, kind


def _gram_ids(data: np.ndarray, space: np.ndarray):
    """For each order the hashed n-gram that ends at each byte, and whether it stays within one word and its borders."""
    packed = data.astype(np.uint64)
    packed[space] = np.uint64(32)
    key = packed.copy()
    for k in range(1, ORDER + 1):
        if k > 1:
            key[k - 1 :] |= packed[: len(packed) - k + 1] << np.uint64(8 * (k - 1))
        ok = ~space if k == 1 else np.ones(len(data), bool)
        ok[: k - 1] = False
        for i in range(1, k - 1):  # only the first and the last byte may be borders
            ok[i:] &= ~space[: len(space) - i]
        if k == 2:
            ok[1:] &= ~(space[1:] & space[:-1])
        yield ((key * _MUL + np.uint64(k)) * _MUL >> np.uint64(64 - BITS)).astype(np.int64), ok


def _counted(batches):
    """(lang, kind, id, n): hashed n-grams are kind 0, letters by script kind 1."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, other in zip(texts, langs, strict=True) if other == lang]
            total, scripts = np.zeros(1 << BITS, np.int64), np.zeros(len(_NAMES), np.int64)
            own = [t[a:b] for t in own for a, b in slices(t, PIECE // 4)]
            for a, b in chunks([len(t) for t in own], PIECE // 4):
                _, _, _, data, space, n, kind = _words(own[a:b])
                for ids, ok in _gram_ids(data, space):
                    total += np.bincount(ids[ok], minlength=1 << BITS)
                scripts += np.bincount(kind, n, len(_NAMES)).astype(np.int64)
            for what, x in ((0, total), (1, scripts)):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), what), pa.int32()), pa.array(at), pa.array(x[at])], ["lang", "kind", "id", "n"])


class Model:
    """Per-language tables of log-likelihood ratios and of scripts."""

    def __init__(self, rows):
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        count, script = np.zeros((1 << BITS, len(self.langs))), np.zeros((len(_NAMES), len(self.langs)))
        for lang, kind, i, n in rows:
            (script if kind else count)[i, number[lang]] += n
        p = (count + ALPHA) / (count + ALPHA).sum(axis=0)
        self.ratio = (np.log(p) - np.log(p.mean(axis=1, keepdims=True))).astype(np.float32) if self.langs else count
        self.ratio = np.vstack([self.ratio, np.zeros_like(self.ratio[:1])])
        share = script / np.maximum(script.sum(axis=0), 1)
        self.barred = (share < RARE) & (share >= RARE).any(axis=1)[:, None]

    def word_scores(self, texts: list[str]):
        """Text number, start and end (in the text's lower-cased bytes between two blanks), letters and scores of each word."""
        parts = []
        piece = max(PIECE // max(len(self.langs), 1), 10_000)
        cut = [(i, a, b) for i, t in enumerate(texts) for a, b in slices(t, piece)]
        done = dict.fromkeys(range(len(texts)), 0)  # bytes of each text before the next slice
        for x, y in chunks([b - a for _, a, b in cut], piece):
            some = [texts[i][a:b] for i, a, b in cut[x:y]]
            of, start, end, data, space, n, kind = _words(some)
            scores = np.zeros((len(start), len(self.langs)), np.float32)
            if len(start):
                total = np.zeros((len(data), len(self.langs)), np.float32)
                for ids, ok in _gram_ids(data, space):
                    ids[~ok] = 1 << BITS  # a row of zeros
                    total += self.ratio.take(ids, axis=0)
                scores = np.add.reduceat(total, start, axis=0) / ORDER  # with the space behind, which ends its last n-grams
                scores[n == 0] = 0
                scores -= np.where(self.barred[kind] & (n > 0)[:, None], np.float32(30), np.float32(0))
            first, shift = 0, []
            for (i, _, _), t in zip(cut[x:y], some, strict=True):
                size = len(t.lower().encode("utf-8", "replace"))
                shift.append(done[i] - first)
                done[i] += size
                first += size + 2
            shift = np.array(shift, np.int64)[of]
            parts.append((np.array([i for i, _, _ in cut[x:y]])[of], start + shift, end + shift, n, scores))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (*[np.empty(0, np.int64)] * 4, np.empty((0, len(self.langs)), np.float32))


def slices(text: str, limit: int):
    """Ranges of text of about limit characters that begin with a blank (or at the start)."""
    a = 0
    while len(text) - a > limit:
        m = _BLANK.search(text, a + limit)
        if not m:
            break
        yield a, m.start()
        a = m.start()
    yield a, len(text)


def viterbi(scores: np.ndarray, of: np.ndarray, n_texts: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; words of a text are neighbours, texts are independent, a change costs switch."""
    first = np.searchsorted(of, np.arange(n_texts))
    length = np.bincount(of, minlength=n_texts)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    label = np.zeros(len(of), np.int64)
    most = int(length[0]) if n_texts else 0
    live = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # texts with more than t words
    value = np.zeros((n_texts, scores.shape[1]), np.float32)
    stay = np.zeros(scores.shape, bool)
    came = np.zeros(len(of), np.int16)
    for t, m in enumerate(live.tolist()):
        at = first[:m] + t
        v = value[:m]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(m), best] - np.float32(switch)
            stay[at] = v >= top[:, None]
            came[at] = best
            v = np.maximum(v, top[:, None])
        value[:m] = v + scores[at]
    now = value.argmax(axis=1) if n_texts else np.empty(0, np.int64)
    for t in range(most - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], came[at])
    return label


def labelled(model: Model, texts: list[str]):
    """Per text (language, score) and the word arrays of its path."""
    of, start, end, n, scores = model.word_scores(texts)
    label = viterbi(scores, of, len(texts))
    k = len(model.langs)
    mass = np.bincount(of * k + label, n, len(texts) * k).reshape(len(texts), k)
    p = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    post = p[np.arange(len(of)), label] / p.sum(axis=1) if len(scores) else np.empty(0)
    sure = np.bincount(of * k + label, n * post, len(texts) * k).reshape(len(texts), k)
    best = mass.argmax(axis=1)
    total = mass.sum(axis=1)
    row = np.arange(len(texts))
    score = np.where(total > 0, sure[row, best] / np.maximum(total, 1), 0)
    names = [model.langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
    return names, np.clip(score, 0, 1), (of, start, end, label, n)


def _predicted(model: Model):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks([len(t) for t in texts], max(TOGETHER // max(len(model.langs), 1), 250_000)):
                if model.langs:
                    names, score, _ = labelled(model, texts[a:b])
                else:
                    names, score = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in (batch.column("doc_id"), batch.column("held_out"))), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _spans(model: Model):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or not model.langs:
                    continue
                _, _, (_, start, end, label, n) = labelled(model, [text])
                raw = (" " + text.lower() + " ").encode("utf-8", "replace")
                cut = np.r_[0, np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    if j > i and n[i:j].sum():
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([model.langs[label[i]]]), pa.array([raw[start[i] : end[j - 1]].decode("utf-8", "replace")])], ["doc_id", "lang", "span"])

    return run


def learn(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows of documents(text, lang) with both set; about sample rows of each language."""
    rows = documents.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"))
    rows = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"lang has more than {MOST} values")
    # A cut of the hash gives about sample rows of a language without sorting them.
    cuts = rows.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")).alias("share"))  # at most MOST rows
    found = documents.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("u"))
    found = found.join(F.broadcast(cuts), "lang").filter("u < share").select("lang", "text")
    counts = found.mapInArrow(_counted, "lang string, kind int, id long, n long").groupBy("lang", "kind", "id").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])  # at most 2 ** BITS + scripts rows a language


def _parted(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))


def predict(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents(doc_id, text, lang); learnt from rows not held out."""
    docs = _parted(documents)
    model = learn(docs.filter("not held_out"), sample)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def spans(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang, span (lower-cased) for every run of the path."""
    docs = _parted(documents)
    return docs.select("doc_id", "text").mapInArrow(_spans(learn(docs.filter("not held_out"), sample)), "doc_id long, lang string, span string")
