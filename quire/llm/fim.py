"""Fill-in-the-middle: documents are cut at two token borders and rearranged around markers.

Tokens are `[A-Za-z]+|[^A-Za-z]`. A chunk of bytes is scanned by an automaton of four states: OTHER, behind `<` (OPEN), in
letters (WORD), and in letters that are one P, S or M behind `<` (NAMED). What a chunk hands on is its transition function:
for each state it may be entered in, the state it leaves in, the tokens that begin in it, and whether a marker ends in it.
Composition of such functions is associative, so a scan by doubling gives every chunk of a document its entry state.

A document of at most GIANT bytes is one chunk, which its own task scans and cuts. The chunks of giant documents are dealt
to all tasks; their functions, 13 numbers a chunk, are composed by document; then each cut, now a rank within one chunk
and that chunk's entry state, is found by the document's task in that chunk alone.

Forms: plain (the text as it is), psm (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle). Cuts
and form are drawn from SHA-256 of the seed and doc_id.

Edge cases: null text is empty, and an empty text is plain; rows without doc_id draw as if its digits were none; repeated
rows come out as often as they come in, rows of one doc_id with other texts are cut by their own tokens; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_side, staged

CHUNK, GIANT = 1 << 18, 1 << 20
#: Percentages of documents that stay plain, and of the others that are rearranged suffix first.
PLAIN, SUFFIX_FIRST, SEED = 10, 20, 1
OTHER, OPEN, WORD, NAMED = range(4)
_FUNCTION = "chars long, " + ", ".join([*(f"e{s} int" for s in range(4)), *(f"n{s} long" for s in range(4)), *(f"m{s} boolean" for s in range(4))])


def _points(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the code points that begin in piece: their places, first bytes, and whether they are letters."""
    b = np.frombuffer(piece, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    x = b[at]
    return at, x, ((x | 32) - np.uint8(97)) < 26


def _begins(letter: np.ndarray, entered: int) -> np.ndarray:
    """Which code points begin a token, if the chunk is entered in the given state."""
    return ~(letter & np.r_[entered in (WORD, NAMED), letter[:-1]]) if len(letter) else letter


def transition(piece: bytes) -> tuple[int, list[int], list[int], list[bool]]:
    """Code points, and by entry state: the state left in, tokens begun, whether a marker ended."""
    _, x, letter = _points(piece)
    n = len(x)
    if not n:
        return 0, [0, 1, 2, 3], [0] * 4, [False] * 4
    named = np.isin(x, np.frombuffer(b"PSM", np.uint8))
    is_open, close = x == ord("<"), x == ord(">")
    begun = int(_begins(letter, OTHER).sum())
    inside = bool((is_open[:-2] & named[1:-1] & close[2:]).any())
    ends, counts, marks = [], [], []
    for s in range(4):
        behind_open = is_open[-2] if n > 1 else s == OPEN
        ends.append(OPEN if is_open[-1] else OTHER if not letter[-1] else NAMED if named[-1] and behind_open else WORD)
        counts.append(begun - int(s in (WORD, NAMED) and letter[0]))
        marks.append(inside or bool(s == NAMED and close[0]) or bool(s == OPEN and n > 1 and named[0] and close[1]))
    return n, ends, counts, marks


def composed(ends: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of chunks 0 to i for every i, by doubling; arrays of (chunks, 4)."""
    ends, counts, marks = ends.copy(), counts.copy(), marks.copy()
    step = 1
    while step < len(ends):
        via = ends[:-step]  # the state in which the later function is entered
        later = lambda x, via=via, step=step: np.take_along_axis(x[step:], via, 1)
        e, n, m = later(ends), counts[:-step] + later(counts), marks[:-step] | later(marks)
        ends[step:], counts[step:], marks[step:] = e, n, m
        step *= 2
    return ends, counts, marks


def select(piece: bytes, entered: int, rank: int) -> tuple[int, int]:
    """Bytes and code points of piece before its token of the given rank."""
    at, _, letter = _points(piece)
    i = int(np.flatnonzero(_begins(letter, entered))[rank])
    return int(at[i]), i


def _cuts():
    """A UDF of a small text and two draws: its tokens, whether it holds a marker, and both cuts in bytes and code points."""

    def run(text, h1, h2):
        import pandas as pd

        out = []
        for piece, x, y in zip(text, h1.tolist(), h2.tolist(), strict=True):
            at, _, letter = _points(piece)
            begins = np.flatnonzero(_begins(letter, OTHER))
            n = len(begins)
            marker = any(m in piece for m in (b"<P>", b"<S>", b"<M>"))
            row = [n, marker]
            for k in sorted((x % (n + 1), y % (n + 1))):
                row += (int(at[begins[k]]), int(begins[k])) if k < n else (len(piece), len(letter))
            out.append(row)
        return pd.DataFrame(out, columns=["n", "marker", "a", "a_chars", "b", "b_chars"])

    return F.pandas_udf(run, "n long, marker boolean, a long, a_chars long, b long, b_chars long")


def _function():
    def run(piece):
        import pandas as pd

        rows = [(n, *e, *c, *m) for n, e, c, m in map(transition, piece)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _FUNCTION.split(", ")])

    return F.pandas_udf(run, _FUNCTION)


def _resolved(group):
    """One document's chunks: its tokens, and for both cuts chunk, entry state, rank in the chunk and code points before it."""
    import pandas as pd

    group = group.sort_values("i")
    of = lambda c: group[[f"{c}{s}" for s in range(4)]].to_numpy()
    ends, counts, marks = composed(of("e").astype(np.int64), of("n").astype(np.int64), of("m").astype(bool))
    upto, chars = counts[:, OTHER], np.cumsum(group["chars"].to_numpy())
    n = int(upto[-1])
    row = [group["key"].iloc[0], n, bool(marks[-1, OTHER]), int(chars[-1])]
    for k in sorted((int(group["h1"].iloc[0]) % (n + 1), int(group["h2"].iloc[0]) % (n + 1))):
        i = int(np.searchsorted(upto, k, "right")) if k < n else -1  # -1: behind the text
        row += (i, int(ends[i - 1, OTHER]) if i > 0 else OTHER, k - int(upto[i - 1]) if i > 0 else k, int(chars[i - 1]) if i > 0 else 0)
    return pd.DataFrame([row], columns=["key", "n", "marker", "chars", "a_i", "a_state", "a_rank", "a_before", "b_i", "b_state", "b_rank", "b_before"])


def _selected():
    """A UDF of a chunk (null: none), its entry state and a rank: bytes and code points before that token."""

    def run(piece, state, rank):
        import pandas as pd

        return pd.DataFrame([(0, 0) if p is None else select(p, s, r) for p, s, r in zip(piece, state, rank, strict=True)], columns=["bytes", "chars"])

    return F.pandas_udf(run, "bytes long, chars long")


def _giants(docs: DataFrame, chunk: int, giant: int) -> DataFrame | None:
    """docs of more than giant bytes with n, marker and cuts, or None if there are none."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = docs.filter(F.octet_length("t") > giant).withColumn("key", F.unhex(F.sha2(F.concat(digits, F.lit(":"), "t"), 256)))
    pieces = F.transform(F.expr(f"sequence(0L, (octet_length(t) - 1) div {chunk})"), lambda i: F.substring(F.col("t").cast("binary"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    dealt = own.select("key", "h1", "h2", F.posexplode(pieces).alias("i", "piece")).repartition("key", "i")
    functions = dealt.withColumn("f", _function()("piece")).select("key", "h1", "h2", "i", "f.*").dropDuplicates(["key", "i"])
    functions = staged(functions, "functions")
    if functions.isEmpty():
        return None
    where = ", ".join(f"{c}_i int, {c}_state int, {c}_rank long, {c}_before long" for c in "ab")
    cuts = staged(functions.groupBy("key").applyInPandas(_resolved, f"key binary, n long, marker boolean, chars long, {where}"), "cuts")
    out = own.join(small_side(cuts), "key")
    for c in "ab":
        behind = F.col(f"{c}_i") < 0
        piece = F.when(~behind, F.substring(F.col("t").cast("binary"), F.col(f"{c}_i") * chunk + 1, F.lit(chunk)))
        out = out.withColumn("found", _selected()(piece, f"{c}_state", f"{c}_rank"))
        out = out.withColumn(c, F.when(behind, F.octet_length("t")).otherwise(F.col(f"{c}_i").cast("long") * chunk + F.col("found.bytes")))
        out = out.withColumn(f"{c}_chars", F.when(behind, F.col("chars")).otherwise(F.col(f"{c}_before") + F.col("found.chars")))
    return out.select(*docs.columns, "n", "marker", *(F.col(c).cast("long") for c in ("a", "a_chars", "b", "b_chars")))


def transform(documents: DataFrame, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of documents(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    draws = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    docs = docs.withColumns({f"h{i + 1}": F.conv(F.substring(draws, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)})
    small = docs.filter(F.octet_length("t") <= giant).withColumn("cut", _cuts()(F.col("t").cast("binary"), "h1", "h2"))
    rows = small.select(*docs.columns, "cut.*")
    large = _giants(docs, chunk, giant)
    rows = rows if large is None else rows.unionByName(large)

    part = lambda a, b: F.substring(F.col("t").cast("binary"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.octet_length("t"))
    form = F.when((F.col("t") == "") | F.col("marker") | (F.col("h3") % 100 >= 100 - PLAIN), "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    p, s, m = map(F.lit, ("<P>", "<S>", "<M>"))
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("a_chars")).alias("prefix_chars"), F.when(cut, F.col("b_chars") - F.col("a_chars")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that a rearranged output was made of; cut texts hold no markers, so the pieces between them are whole."""
    piece = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    return F.when(form == "plain", output).when(form == "spm", F.concat(piece(3), piece(4), piece(2))).otherwise(F.concat(piece(2), piece(4), piece(3)))
