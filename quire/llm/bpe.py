"""Byte-pair encoding and decoding by a pair occurrence index, and token counts over distinct pre-tokens.

A text is cut at special strings and then by the tokenizer's pattern into pre-tokens. The distinct new pre-tokens of a
batch are laid out in one array; an index maps each adjacent pair to all its positions; ranks are applied in ascending
order from a heap, and every merge updates the lists of the pairs it makes. A merge's rank is above the ranks of its
parts' merges, so one ascending pass is the same as repeated lowest-rank merging in each pre-token.

Codes of pre-tokens are kept for a worker's lifetime in a table of at most CACHE entries, which is emptied when full:
memory is bounded and results don't depend on it. Encoding has no shuffle; a lost executor only repeats its own
partitions.

Edge cases: null text is empty: no tokens, and digests of the empty string; repeated rows are returned as often as they
come; rows without doc_id keep it null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pinned_splits, staged
from .words import chunks, lean

VOCABULARY = "byte_bpe_50k.json"
CACHE = 250_000
#: Characters of neighbouring texts whose new pre-tokens share one pair occurrence index.
BATCH = 32_000_000
#: Characters of neighbouring texts whose pre-token frequencies are packed together for token counts.
BLOCK = 16_000_000

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers up to U+00FF, where the standard module is faster than Unicode properties.
_L, _N = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def _pattern(letters: str, numbers: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


_LATIN = re.compile(_pattern(_L, _N)).findall


@lru_cache(1)
def _any():
    import regex

    return regex.compile(_pattern("\\p{L}", "\\p{N}")).findall


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any()(text)
    return _LATIN(text)


def _letters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind: itself, or from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Codes of pre-tokens under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[letters[b]] for b in range(256)])
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.merged = []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merged.append((vocab[a], vocab[b], vocab[a + b]))
        pairs = np.array([(a << 20) + b for a, b, _ in self.merged])
        self.ranks = np.argsort(pairs)
        self.pairs = pairs[self.ranks]
        self.index, self.codes = Index(), []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words at once over one pair occurrence index."""
        if not words:
            return []
        coded = [w.encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b"\0".join(coded) + b"\0\0", np.uint8)
        ends = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
        sym = self.first[data]
        sym[ends - 1] = sym[-1] = -1  # between words, and behind all
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            key = (left << 20) + right
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[found] == key
            if not hit.any():
                return
            at, rank = at[hit], self.ranks[found[hit]]
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cut, cut[1:], strict=False):
                r = int(rank[a])
                if (to := index.get(r)) is None:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)
                else:
                    to.append(at[a:b])

        note(np.arange(n - 1), sym[:-1], sym[1:])
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = self.merged[rank]
            at = index.pop(rank)
            i = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            j = after[i]
            i = i[(sym[i] == a) & (sym[j] == b)]  # else an earlier merge took one of the two
            if not len(i):
                continue
            j = after[i]
            if a == b and (j[:-1] == i[1:]).any():  # in a run of one symbol the leftmost pairs merge
                taken, free = [], -1
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x != free:
                        taken.append(x)
                        free = y
                i = np.array(taken)
                j = after[i]
            sym[i], sym[j] = new, -2
            k = after[j]
            after[i] = k
            before[k] = i
            h = before[i]
            note(np.concatenate([i, h]), np.concatenate([sym[i], sym[h]]), np.concatenate([sym[k], sym[i]]))
        left = sym >= 0
        sizes = np.add.reduceat(left, np.r_[0, ends[:-1]])
        out, at = sym[left].tolist(), 0
        result = []
        for size in sizes.tolist():
            result.append(out[at : at + size])
            at += size
        return result

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and special strings in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return pretokens(text)
        return [p for i, x in enumerate(self.cut(text)) for p in ([x] if i % 2 else pretokens(x))]

    def numbers(self, texts: list[str]) -> list[array]:
        """The number of each pre-token of each text; codes[number] is then (length, ids as text, bytes)."""
        if len(self.index) > CACHE:
            self.index, self.codes = Index(), []
        rows = [array("I", map(self.index.__getitem__, self.parts(t))) for t in texts]
        new = list(self.index)[len(self.codes) :]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            ids = [self.special[w]] if w in self.special else ids
            self.codes.append((len(ids), ",".join(map(str, ids)).encode(), b"".join(map(self.bytes.__getitem__, ids))))
        return rows

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.numbers([text])[0] for i in self.codes[w][1].split(b",")]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(path: str):
    @lean
    def run(batches):
        e = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks([len(t) for t in texts], BATCH):
                n, digest, decoded = [], [], []
                for row in e.numbers(texts[a:b]):
                    codes = list(map(e.codes.__getitem__, row))
                    n.append(sum([c[0] for c in codes]))
                    digest.append(hashlib.sha256(b",".join([c[1] for c in codes])).hexdigest())
                    text = b"".join([c[2] for c in codes]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    @lean
    def run(batches):
        e = encoder(path)
        for batch in batches:
            keys, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks([len(t) for t in texts], BATCH // 16):
                n, all_ids, decoded = [], [], []
                for row in e.numbers(texts[a:b]):
                    codes = list(map(e.codes.__getitem__, row))
                    n.append(sum([c[0] for c in codes]))
                    if codes:
                        all_ids.append(b",".join([c[1] for c in codes]))
                    decoded.append(b"".join([c[2] for c in codes]).decode("utf-8", "replace"))
                flat = np.fromstring(b",".join(all_ids).decode(), np.int32, sep=",") if all_ids else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n, pa.int64()), ids, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _two(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents(doc_id, text)."""
    return _two(documents).mapInArrow(_encoded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every row of documents(doc_id, text)."""
    return _two(documents).mapInArrow(_ids(path), "doc_id long, n_tokens long, ids array<int>, decoded string")


@lru_cache(2)
def _library(path: str):
    """(pre-tokens of a text, pieces of each of several pre-tokens) of the library that reads the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda t: [t] if t else []), (lambda words: [len(x) for x in model.encode(words, num_threads=1)])
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        cut = encoder(path).parts
    else:
        cut = lambda t: [t] if t else []  # noqa: E731  this kind isn't cut the same way alone, so a text is one unit
    return cut, lambda words: [len(x.ids) for x in model.encode_batch(words, add_special_tokens=False)]


def _frequencies(cut, batches):
    """(block number, slots by pre-token, rows) of one scan partition; a row is doc_id, n_bytes, slots and frequencies."""
    block, slot, rows, total = TaskContext.get().partitionId() << 32, Index(), [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            if rows and total + len(text) > BLOCK:
                yield block, slot, rows
                block, slot, rows, total = block + 1, Index(), [], 0
            found = Counter(cut(text))
            rows.append((key, len(text.encode("utf-8", "replace")), array("i", map(slot.__getitem__, found)), array("i", found.values())))
            total += len(text)
    if rows:
        yield block, slot, rows


def _check(slot: Index) -> int:
    """A checksum of a block's pre-tokens in the order of their slots."""
    return zlib.crc32("\0".join(slot).encode("utf-8", "replace")) >> 1


def _named(path: str):
    """(home, slot, word) for each distinct pre-token of a block; slot -1 has the block's checksum as its word."""

    @lean
    def run(batches):
        for block, slot, _ in _frequencies(_library(path)[0], batches):
            words = sorted(slot)  # neighbours are alike, which compresses well
            at = [*(slot[w] for w in words), -1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), pa.array([*words, str(_check(slot))], pa.string())], ["home", "slot", "word"])

    return run


def _packed(path: str):
    @lean
    def run(batches):
        for block, slot, rows in _frequencies(_library(path)[0], batches):
            ends = pa.array(np.r_[0, np.cumsum([len(r[2]) for r in rows])].astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.frombuffer(r[i], np.int32) for r in rows]))) for i in (2, 3))
            t = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists], ["doc_id", "n_bytes", "slots", "times"])
            out = io.BytesIO()
            with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
                w.write_table(t)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(slot)]), pa.array([_check(slot)]), pa.array([out.getvalue()], pa.binary())], ["block", "n_slots", "seal", "blob"])

    return run


def _sized(path: str):
    """Rows sorted by pre-token: each distinct one is counted once, and its count goes to all its rows."""

    @lean
    def run(batches):
        _, pieces = _library(path)
        last, count = None, 0
        for batch in batches:
            column = batch.column("word").to_pylist()
            for a, b in chunks([len(w) for w in column], BATCH // 4):
                words, at, k = [], [], -1
                for w in column[a:b]:
                    if w != last:
                        words.append(w)
                        last, k = w, k + 1
                    at.append(k)
                found = np.array([*pieces(words), count], np.int64)  # at -1 is the pre-token of the rows before
                n = found[at]
                count = int(n[-1])
                for i in np.flatnonzero(batch.column("slot").slice(a, b - a).to_numpy() < 0):
                    n[i] = int(column[a + i])
                yield pa.RecordBatch.from_arrays([batch.column("home").slice(a, b - a), batch.column("slot").slice(a, b - a), pa.array(n.astype(np.int32))], ["home", "slot", "n"])

    return run


def _summed(limit: int):
    def run(blobs, sized):
        import pandas as pd

        n = np.zeros(len(sized), np.int64)
        n[sized["slot"].to_numpy()] = sized["n"].to_numpy()  # slot -1, the checksum, goes last
        if len(blobs) != 1 or blobs["n_slots"].sum() + 1 != len(sized) or blobs["seal"].iloc[0] != n[-1]:
            raise RuntimeError("the two scans were cut differently; stage the documents first")
        out = []
        for blob in blobs["blob"]:
            t = pa.ipc.open_stream(blob).read_all().combine_chunks()
            slots, times = (t.column(c).combine_chunks() for c in ("slots", "times"))
            total = np.r_[0, np.cumsum(n[slots.values.to_numpy()] * times.values.to_numpy())]
            ends = slots.offsets.to_numpy()
            tokens = total[ends[1:]] - total[ends[:-1]]
            out.append(pd.DataFrame({"doc_id": t.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "n_bytes": t.column("n_bytes").to_numpy(), "n_tokens": tokens, "over_limit": tokens > limit}))
        return pd.concat(out)

    return run


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents(doc_id, text).

    One scan names the distinct pre-tokens of each block of documents. They are dealt out and sorted by pre-token, and
    the library counts each that is distinct over all documents once. A second scan packs the pre-token frequencies of
    the documents of a block; the counts are joined to them by block and summed. No ids are made. A pre-token is one row
    a block however often it occurs, so frequent ones weigh no more; what is shuffled grows with distinct pre-tokens a
    block, and a word has at most one row a block, so even the commonest has less than a task's even share once there are
    fewer tasks than a block has distinct pre-tokens. Both scans must meet the rows in the same order: documents is a
    table, or staged. A checksum of each block's pre-tokens in order makes unequal scans fail.
    """
    docs = _two(documents)
    with pinned_splits(documents.sparkSession):
        words = docs.mapInArrow(_named(path), "home long, slot int, word string")
        sized = words.repartition("word").sortWithinPartitions("word").mapInArrow(_sized(path), "home long, slot int, n int")
        blobs = docs.mapInArrow(_packed(path), "block long, n_slots long, seal long, blob binary")
        return staged(blobs.groupBy("block").cogroup(sized.groupBy("home")).applyInPandas(_summed(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"), "counts")
