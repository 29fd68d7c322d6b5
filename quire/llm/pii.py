"""Personal data: base patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans are those of four patterns with their checks. The field works on islands (neighbouring chunks of text that
hold a digit, an at sign or a bracketed `at`): tokens outside can't start a segment, so decoding an island alone is exact.
Entities are bounded, as the dynamic programming needs: a segment is a whole candidate of up to LONGEST tokens between
alphanumeric borders (a spelled-out address of eight groups has 15, of four labels with `[dot]` about 25); with neither
colon nor at sign it has 7 to DIGITS digits (cards have at most 19). Longer runs hold no entity of these kinds. Its
features are those of the whole span (digit groups, checksums, separators, domain shape, borders, the word before).
Dynamic programming over the last LONGEST tokens chooses boundaries and kinds jointly, in time linear in the text and
with 18 bytes a token of an island. Weights come from maximum likelihood (forward-backward over segmentations) on
SENTENCES seeded synthetic sentences with and without personal data, since no table labels spans. A predicted span that
meets a base span is dropped, so base spans stay as they are. n_email to n_phone count base spans, n_email_all to
n_phone_all those that the field adds as well.

Edge cases: null text is empty and has no spans; repeated rows are returned as often as they come; rows without doc_id
keep it null; an empty table gives no rows; of equal scores the shorter path and the kind first in order win; other
columns are not read (masked() returns them as they are).
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST, DIGITS, SENTENCES, EPOCHS, RATE, PENALTY, SEED = 40, 24, 900, 4, 0.5, 1e-4, 17
#: Scores of candidates that a worker remembers.
REMEMBERED = 100_000

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The base patterns with possessive runs and a start at a run's border: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_PLAIN = str.maketrans("", "", "+-() .")
_TRIGGER = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind as listed and then start."""
    out: list[tuple[str, int, int]] = []
    at, low = text.find("@"), 0
    while at >= 0:
        # A match lies in one run of local characters before and pattern characters behind an at sign.
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", low)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(m.group().translate(_PLAIN)) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _chunk_start(text: str, at: int, low: int) -> int:
    left = max(text.rfind(" ", low, at), low - 1)
    return max(left, text.rfind("\n", left + 1, at), text.rfind("\t", left + 1, at)) + 1


def _chunk_end(text: str, at: int) -> int:
    at = min(at, len(text))
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def islands(text: str):
    """(start, end) of the runs of chunks that hold a trigger; neighbours a single blank apart are one island."""
    end = 0
    first = None
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if first is not None and p < end:
            continue
        left = _chunk_start(text, p, end)
        right = _chunk_end(text, m.end())
        if text[left:right].strip("()[] ") in ("@", "at"):  # stands alone between blanks
            left = _chunk_start(text, max(left - 1, end), end)
            right = _chunk_end(text, right + 1)
        while text[right + 1 : right + 6] in ("[dot]", "(dot)") and text[right] == " ":
            right = _chunk_end(text, _chunk_end(text, right + 1) + 1)
        if first is not None and left - end <= 1:
            end = right
            continue
        if first is not None:
            yield first, end
        first, end = left, right
    if first is not None:
        yield first, end


_GROUPS = re.compile(r"[0-9]+")
_SEVEN = re.compile(r"(?:[0-9][^0-9]*+){7}")
_QUAD = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\Z")
_HEX = re.compile(r"(?i)[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}\Z")
_ADDRESS = re.compile(r"(?i)[a-z0-9][a-z0-9._%+-]*\s?(@|[\[(]\s?at\s?[\])])\s?[a-z0-9-]+((\s?[\[(]\s?dot\s?[\])]\s?|\.)[a-z0-9-]+)+\Z")


def features(span: str, before: str, left: str, right: str) -> list[str]:
    """Names of the features of a whole candidate, the word before it and the characters at its borders."""
    groups = _GROUPS.findall(span)
    digits = "".join(groups)
    n = len(digits)
    letters = sum(map(str.isalpha, span))
    seps = "".join(sorted({c for c in span if not c.isalnum()}))
    out = ["bias", f"n{min(n, 20)}", f"groups{'-'.join(str(len(g)) for g in groups[:6])}", f"seps{seps}", f"first{span[0] if not span[0].isalnum() else 'a' if span[0].isalpha() else '9'}", f"left{left}", f"right{right}", f"before {before}"]
    out.append("letters" if letters else "no letters")
    if "@" in span or "at" in span:
        out.append("address" if _ADDRESS.match(span) else "no address")
        out.append(f"ats{min(span.count('@'), 2)}")
    if (m := _QUAD.match(span)) and all(int(x) <= 255 for x in m.groups()):
        out.append("quad")
    if ":" in span:
        out.append("hex" if _HEX.match(span) and (span.count(":") == 7 or "::" in span) and letters else "colons")
    if not letters:
        out.append("luhn" if 12 <= n <= 19 and luhn(digits) else "no luhn")
        out.append("plus" if span[0] == "+" else "no plus")
        out.append("parens" if span.count("(") == span.count(")") == 1 else f"parens{min(span.count('(') + span.count(')'), 2)}")
        out.append("tel" if 9 <= n <= 15 else "no tel")
    return out


def _tidy(word: str) -> str:
    """The word before a candidate as a feature; of a very long one the end."""
    word = word.strip(".,:;()\"'=").lower()
    return "9" if any(map(str.isdigit, word)) else word


def _steps(text: str, start: int, end: int):
    """(start, end, candidates) of each token of an island, the candidates being those that end with it.

    A candidate is its number of tokens, its start, and the arguments of features(). Only the last LONGEST tokens are
    remembered.
    """
    first = text[max(0, start - 40) : start].split()
    word = first[-1] if first else ""
    window: deque = deque(maxlen=LONGEST)  # a start: its place, digits, marks and colons before it, the word before, the character before
    digits = marks = colons = 0
    chunk = start  # where the chunk of non-blanks that the token is in begins
    for m in _TOKEN.finditer(text, start, end):
        a, b = m.span()
        x = m.group()
        c = x[0]
        if c.isspace():
            if chunk < a:
                word = text[max(chunk, a - 80) : a]
            chunk = b
        left = text[a - 1] if a else "^"
        inside = left.isalnum()
        if c in "+(" or c.isalnum() and not (a and inside):
            window.append((a, digits, marks, colons, _tidy(text[max(chunk, a - 80) : a] or word), "a" if inside else left))
        else:
            window.append(None)
        if c.isdigit():
            digits += b - a
        elif c == ":":
            colons += 1
        elif x == "@" or x == "at":
            marks += 1
        elif "\n" in x:
            window.clear()
        found = []
        if text[b - 1].isalnum() and not (b < len(text) and text[b].isalnum()):
            right = text[b] if b < len(text) else "$"
            right = "a" if right.isalnum() else right
            n = len(window)
            for k, opened in enumerate(window):
                if opened is None:
                    continue
                s, d, at, co, w, left = opened
                if digits - d < 7 and marks == at and colons - co < 2 or digits - d > DIGITS and colons == co and marks == at:
                    continue
                found.append((n - k, s, (text[s:b], w, left, right)))
        yield a, b, found


def _worth(text: str, start: int, end: int) -> bool:
    """Whether an island can hold a candidate at all."""
    return text.find("@", start, end) >= 0 or text.find("at", start, end) >= 0 or text.count(":", start, end) >= 2 or _SEVEN.search(text, start, end) is not None


def candidates(text: str, start: int, end: int):
    """Tokens of an island and its candidate segments (i, j, features): tokens i to j - 1 of at most LONGEST."""
    tokens, found = [], []
    if not _worth(text, start, end):
        return tokens, found
    for a, b, ends in _steps(text, start, end):
        tokens.append((a, b))
        j = len(tokens)
        found += [(j - n, j, features(*context)) for n, _, context in ends]
    return tokens, found


Weights = dict[tuple[str, str], float]


def _scores(found, w: Weights):
    return [[sum([w.get((k, f), 0.0) for f in fs]) for k in KINDS] for _, _, fs in found]


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + log(sum([exp(x - m) for x in xs]))


def marginals(n: int, found, scores) -> tuple[float, list[list[float]]]:
    """Log partition sum over all segmentations, and the probability of each candidate and kind."""
    ends, starts = defaultdict(list), defaultdict(list)
    for c, (i, j, _) in enumerate(found):
        ends[j].append(c)
        starts[i].append(c)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_sum([alpha[j - 1], *(alpha[found[c][0]] + s for c in ends[j] for s in scores[c])])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sum([beta[i + 1], *(beta[found[c][1]] + s for c in starts[i] for s in scores[c])])
    z = alpha[n]
    return z, [[exp(alpha[i] + s + beta[j] - z) for s in scores[c]] for c, (i, j, _) in enumerate(found)]


def decode(n: int, found, scores) -> list[tuple[int, int, str]]:
    """The best segmentation's entities (i, j, kind)."""
    best, came = [0.0] * (n + 1), [None] * (n + 1)
    ends = defaultdict(list)
    for c, (_, j, _) in enumerate(found):
        ends[j].append(c)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for c in ends[j]:
            k = max(range(len(KINDS)), key=scores[c].__getitem__)
            if (v := best[found[c][0]] + scores[c][k]) > best[j]:
                best[j], came[j] = v, (found[c][0], KINDS[k])
    out, j = [], n
    while j:
        if came[j]:
            out.append((came[j][0], j, came[j][1]))
            j = came[j][0]
        else:
            j -= 1
    return out[::-1]


_FILLER = "the of and in with on for is as was from by this that to a le de la und der die el los contact call reach mail write server host number see about between".split()


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A synthetic sentence and its spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 8)))
    name = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        n = rng.choice((13, 14, 15, 15, 16, 16, 16, 19))
        x = d(n - 1)
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = rng.choice(("", " ", "-", "."))
        cuts = (4, 10) if n == 15 else range(4, n, 4)
        return sep.join(x[a:b] for a, b in zip((0, *cuts), (*cuts, n), strict=True))

    def bad_card() -> str:
        x = d(16)
        while luhn(x):
            x = d(16)
        return x

    def email() -> str:
        at, dot = rng.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", ".")))
        return rng.choice((name(), f"{name()}.{d(2)}", f"{name()}_{name()}", f"{name()}+{name()}")) + at + rng.choice((name(), f"{name()}{d(1)}.{name()}", f"{name()}-{name()}")) + dot + rng.choice(("com", "org", "net", "de", "fr"))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {d(2)} {d(7)}", f"00{d(2)} {d(2)} {d(7)}", f"+{d(2)}-{d(3)}-{d(6)}", f"0{d(3)} {d(7)}", f"({a}) {b} {c}"))

    def ip() -> str:
        h = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(4))
        return rng.choice((".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(h() for _ in range(8)), f"{h()}:{h()}::{rng.randint(1, 9)}"))

    nothing = (
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}",
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"${rng.randint(1, 999)},{d(3)},{d(3)}.{d(2)}", lambda: f"{rng.choice('ABCX')}{d(2)}-{d(5)}", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{rng.randint(1, 999)},{d(3)},{d(3)}", lambda: d(rng.randint(1, 12)), bad_card, lambda: f"{d(2)}.{d(6)}, {d(2)}.{d(6)}", lambda: f"{rng.randint(256, 999)}.{d(3)}.{rng.randint(300, 999)}.{d(2)}",
        lambda: " ".join(d(rng.randint(1, 5)) for _ in range(rng.randint(3, 8))), lambda: f"{rng.randint(1900, 2030)} {d(4)} {d(4)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(8)}-{d(4)}-{d(4)}",
    )
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(1, 5)):
            text += rng.choice((rng.choice(_FILLER), word())) + rng.choice((" ", " ", " ", ", ", ". "))
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            x = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
            spans.append((kind, len(text), len(text) + len(x)))
            text += x
        else:
            text += rng.choice(nothing)()
        text += rng.choice((" ", " ", ". ", ", ", "\n"))
    return text + word(), spans


@lru_cache(1)
def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights by AdaGrad on the log-likelihood of the true segmentations."""
    rng = random.Random(seed)
    rows = []
    for _ in range(sentences):
        text, spans = sentence(rng)
        for a, b in islands(text):
            tokens, found = candidates(text, a, b)
            if found:
                truth = {(s, e): KINDS.index(k) for k, s, e in spans}
                rows.append((len(tokens), found, [truth.get((tokens[i][0], tokens[j - 1][1])) for i, j, _ in found]))
    w: Weights = defaultdict(float)
    seen: Weights = defaultdict(float)
    for _ in range(epochs):
        rng.shuffle(rows)
        for n, found, truth in rows:
            _, p = marginals(n, found, _scores(found, w))
            grad: Weights = defaultdict(float)
            for (_, _, fs), gold, probs in zip(found, truth, p, strict=True):
                for k, (kind, q) in enumerate(zip(KINDS, probs, strict=True)):
                    g = (gold == k) - q
                    if abs(g) > 1e-6:
                        for f in fs:
                            grad[kind, f] += g
            for key, g in grad.items():
                g -= PENALTY * w[key]
                seen[key] += g * g
                w[key] += RATE * g / sqrt(seen[key] + 1e-8)
    return {k: v for k, v in w.items() if abs(v) > 1e-4}


class Scorer:
    """The best kind and its score for candidates; those met before are remembered, up to REMEMBERED of them."""

    def __init__(self, w: Weights):
        self.rows = {f: tuple(w.get((k, f), 0.0) for k in KINDS) for f in {f for _, f in w}}
        self.seen: dict = {}

    def best(self, context: tuple[str, str, str, str]) -> tuple[float, int]:
        rows = [r for f in features(*context) if (r := self.rows.get(f))]
        scores = [sum(r[k] for r in rows) for k in range(len(KINDS))]
        top = max(scores)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[context] = found = top, scores.index(top)
        return found

    def entities(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The entities of the best segmentation of an island, as decode() gives them."""
        if not _worth(text, start, end):
            return []
        starts, ends = array("q"), array("q")
        size, kind = array("B"), array("B")  # of the segment that ends with each token; 0 without one
        best = deque([0.0], maxlen=LONGEST + 1)  # the last ones of the best scores up to each token
        seen = self.seen
        for a, b, found in _steps(text, start, end):
            starts.append(a)
            ends.append(b)
            value, n_best, k_best = best[-1], 0, 0
            for n, _, context in found:
                score, k = seen.get(context) or self.best(context)
                if score > 0 and (v := best[-n] + score) > value:
                    value, n_best, k_best = v, n, k
            best.append(value)
            size.append(n_best)
            kind.append(k_best)
        out, j = [], len(size)
        while j:
            if n := size[j - 1]:
                out.append((KINDS[kind[j - 1]], starts[j - n], ends[j - 1]))
                j -= n
            else:
                j -= 1
        return out[::-1]


def added_spans(text: str, base: list[tuple[str, int, int]], scorer: Scorer) -> list[tuple[str, int, int]]:
    out, taken = [], []
    for a, b in sorted((a, b) for _, a, b in base):  # joined where they overlap
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for start, end in islands(text):
        for kind, a, b in scorer.entities(text, start, end):
            at = bisect_left(taken, [b]) - 1  # the last one that starts before b
            if at < 0 or taken[at][1] <= a:
                out.append((kind, a, b))
    return out


def _sorted(spans):
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _counts(spans) -> list[int]:
    return [sum(s[0] == k for s in spans) for k in KINDS]


def find(text: str, scorer: Scorer) -> tuple[list, list]:
    """Base spans and all spans of one text, each by kind and start."""
    base = base_spans(text)
    return base, _sorted(base + added_spans(text, base, scorer))


def _found(w: Weights):
    def run(batches):
        scorer = Scorer(w)
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base, every = find(t or "", scorer)
                rows.append((*_counts(base), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), *_counts(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_{k}_all" for k in KINDS)])

    return run


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and the counts of all spans for every row of documents(doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_found(train()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_email_all long, n_ip_all long, n_card_all long, n_phone_all long")


def mask(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans one bracket takes the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(documents: DataFrame) -> DataFrame:
    """documents with every span of text masked; other columns stay."""
    w = train()

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(w)
        for some in texts:
            yield some.map(lambda t: t if t is None else mask(t, find(t, scorer)[1]))

    return documents.withColumn("text", run(F.col("text")))
