import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import exact, fim, trie

ODD = [None, "", "  \n", "a", "A", "a", "A b", "É", "é", "é" * 5000, "word " * 200_000, "a\x00b", "<P>", "x < y", "🙂a🙂<S", "ab1cd", "ß"]
DOCS = "doc_id long, text string, sha string, t string, digest string, keep_id long, id_ string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t", "d", 7, "i") for i, t in rows], DOCS)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def groups(rows):
    """(doc_id, keep_id, group_size, kept, digest) in plain Python."""
    by = {}
    for i, t in rows:
        by.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        own = by[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), keep is None or i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


MANY = [*enumerate(ODD), (3, "a"), (3, "b"), (4, "A"), (4, "A"), (None, "a"), (None, "only"), (None, "ONLY"), *((100 + i, ["Hot copy", "hot COPY"][i % 2]) for i in range(300)), *((500 + i, f"cold {i // 2}") for i in range(200))]


@pytest.mark.parametrize("hot, most", [(64, 250_000), (1, 250_000), (1, 0), (10**6, 0)])
def test_exact_duplicates_against_plain_python(spark, monkeypatch, hot, most):
    monkeypatch.setattr(exact, "HOT", hot)
    monkeypatch.setattr(exact, "REPEATED", most)
    df = documents(spark, MANY).repartition(7)
    assert sorted(map(tuple, exact.exact_duplicates(df).collect()), key=str) == groups(MANY)


@pytest.mark.parametrize("hot", [1, 64])
def test_exact_duplicates_compare_texts_not_digests(spark, monkeypatch, hot):
    """A digest of three values: every group holds different texts."""
    monkeypatch.setattr(exact, "HOT", hot)
    weak = lambda t: F.pmod(F.length(t), F.lit(3))
    assert sorted(map(tuple, exact.exact_duplicates(documents(spark, MANY).repartition(5), weak).collect()), key=str) == groups(MANY)


def test_exact_duplicates_dropped(spark):
    df = documents(spark, MANY)
    out = exact.deduplicated(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], lowered(r["text"])) for r in out.collect())
    kept = {(x[0], x[4]) for x in groups(MANY) if x[3]}
    want = {(i, lowered(t)) for i, t in MANY if (i, hashlib.sha256(lowered(t).encode()).hexdigest()) in kept}
    assert set(got) == want and set(got.values()) == {1} and len({t for _, t in got}) == len(got)
    assert exact.deduplicated(df.limit(0)).count() == 0 == exact.exact_duplicates(df.limit(0)).count()


def test_exact_duplicates_run_without_python(spark):
    plan = exact.exact_duplicates(documents(spark, MANY))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def rearranged(i, t):
    """The row of op12 in plain Python, and the text it was made of."""
    t = t or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return i, len(u), "plain", None, None, t, t
    if h4 % 100 < 20:
        return i, len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", t
    return i, len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", t


def cut_texts():
    rng = random.Random(4)
    texts = [*ODD, "<" * 30, "<S", "a<P>b", "x<M>", "P>" * 20, "<P" * 20, "<<S><", "<Ab>"]
    texts += ["".join(rng.choices("aZP<SM>é🙂 1\n", k=rng.randint(0, 60))) for _ in range(150)]
    return [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(texts)), (5, "other text of five"), (5, "other text of five"), (None, "no id")]


@pytest.mark.parametrize("chunk, giant", [(fim.CHUNK, fim.GIANT), (1, 0), (3, 8), (64, 100)])
def test_fill_in_middle_against_plain_python(spark, chunk, giant):
    """Also with chunks of single bytes, that split code points, markers and words."""
    rows = [(i, t if chunk > 3 else (t or "")[:300]) for i, t in cut_texts()]
    out = fim.transform(documents(spark, rows), chunk, giant)
    got = out.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((rearranged(i, t) for i, t in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(documents(spark, rows).limit(0), chunk, giant).count() == 0


def test_transition_functions_are_those_of_the_automaton():
    """Against the automaton run byte by byte from each state, for all short texts of a small alphabet, and composed."""
    import itertools

    import numpy as np

    def run(state, piece):
        begun, marker = 0, False
        for c in piece:
            if c & 0xC0 == 0x80:
                continue
            letter = chr(c).isascii() and chr(c).isalpha()
            begun += not (letter and state in (fim.WORD, fim.NAMED))
            marker |= state == fim.NAMED and c == ord(">")
            state = (fim.NAMED if state == fim.OPEN and chr(c) in "PSM" else fim.WORD) if letter else fim.OPEN if c == ord("<") else fim.OTHER
        return state, begun, marker

    pieces = ["".join(x).encode() for k in range(5) for x in itertools.product("aP<>é", repeat=k)]
    pieces += [p[1:] for p in pieces if p[:1] == b"\xc3"]
    functions = [fim.transition(p) for p in pieces]
    for p, (n, *f) in zip(pieces, functions, strict=True):
        assert n == sum(c & 0xC0 != 0x80 for c in p)
        assert [tuple(x[s] for x in f) for s in range(4)] == [run(s, p) for s in range(4)], p
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 40):
        some = rng.choices(range(len(pieces)), k=size)
        ends, counts, marks = fim.composed(*(np.array([functions[i][k] for i in some]) for k in (1, 2, 3)))
        for j in range(size):
            whole = b"".join(pieces[i] for i in some[: j + 1])
            assert [(ends[j, s], counts[j, s], marks[j, s]) for s in range(4)] == [run(s, whole) for s in range(4)]


def plain_trie(rows):
    """All nodes in plain Python from (conv_id, turn, role, text)."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).digest(), text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in v if len(built[c]) == len(k))
        out.append((v[0], len(k), members[k[:-1]][0] if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, n long, bucket long, tid long, pos long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], TURNS)


def made_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "né🙂", ""])) for c in range(70, 230) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(20)]  # copies
    rows += [(2000 + c, t, "user", "one long" if t < 30 + 3 * c else "then") for c in range(4) for t in range(45)]  # a long shared path
    rows += [(c, None, None, None) for c in (5, 5, 7, -3, -100, -199)] + [(None, 1, "user", "x"), (3, 0, "bot", "tie"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    return rows + [(c, t, "user", "under zero") for c in (-101, -100, -150, 9_000_000_100, 9_000_000_101) for t in range(3)]


@pytest.mark.parametrize("local", [25, trie.LOCAL])
def test_prefix_trie_against_plain_python(spark, monkeypatch, local):
    """With all buckets split to the end, some, and none; ids of copies in several blocks."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = made_turns()
    got = trie.prefix_trie(conversations(spark, rows).repartition(5), local).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_prefix_trie_of_many_children_and_few_rows(spark, monkeypatch):
    """Joins that can't broadcast; no conversation, one without turns of its own left."""
    monkeypatch.setattr(trie, "small_side", lambda df: df)
    rows = made_turns()[:300]
    assert sorted(map(tuple, trie.prefix_trie(conversations(spark, rows), 150).collect()), key=str) == plain_trie(rows)
    assert trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0
    alone = [(101, 1, "user", "a")]
    assert [tuple(r) for r in trie.prefix_trie(conversations(spark, alone)).collect()] == plain_trie(alone)


def test_running_totals_over_ranges(spark):
    rows = [(k, i, i % 5) for k, n in ((1, 2000), (2, 1), (3, 40)) for i in range(n)]
    out = trie.running(spark.createDataFrame(rows, "k long, i long, x long").repartition(3), ["k"], ["i"], F.col("x"), "upto", "test")
    want = {(k, i): sum(j % 5 for j in range(i + 1)) for k, i, _ in rows}
    assert {(r["k"], r["i"]): r["upto"] for r in out.collect()} == want
