"""Mixing sources to target weights: soft memberships from labelled rows, rates by least squares projected on r >= low.

Domains are the four label states: quality good or poor, toxic or not. A multinomial logistic regression, fitted on the
driver on up to SAMPLE labelled documents (smallest hash of doc_id), gives each document a posterior over domains from
statistics that DataFrame functions compute, among them the hits of a lexicon of LEXICON words that set toxic rows apart.

Rates r >= 0 minimise  sum_k (sum_d w_d p_dk r_d - t_k)**2 / m_k + RIDGE sum_d w_d (r_d - 1)**2  where w_d is a document's
share of all tokens, t_k the target share and m_k the share of domain k: expected token totals of the domains meet the
targets with rates as near 1 as they can be. The gradient by r_d, over w_d, is p_d . c + RIDGE (r_d - 1), c_k being the
residual of domain k over m_k; a projected-gradient step takes r_d to max(low, r_d - length * gradient). Lengths are
spectral (Barzilai and Borwein), from 1 / (1 + RIDGE), which always lowers the error, to 1 / RIDGE; a step that leaves the
error above the worst of the last MEMORY ones is shortened. A step is one scan of a staged narrow table, whose only
results are six sums: no shuffle, nothing that grows on the driver. Rates are replayed from the steps (four numbers each)
within the scan, and staged every REPLAYED steps. The rates given out are one last step of length 1 / RIDGE, which needs
no earlier rates: max(low, 1 - p_d . c / RIDGE). low is 0 by default and rates have no upper bound. What RIDGE and soft
posteriors leave unmet of a scarce domain's target stays unmet, as does the target of a domain that no document belongs
to; attained() returns it by domain.

Native: DataFrame functions only on the documents' path.

Edge cases: null or empty text has no tokens and keeps rate 1; without labelled rows of two domains or without tokens all
rates are 1; repeated rows are documents of their own; rows without doc_id are never labelled; conflicting labels count
as poor and toxic; other columns stay in mixed() and are not read elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged

DOMAINS = ("clean", "toxic", "poor", "poor_toxic")
TARGETS = {"clean": 0.9, "toxic": 0.04, "poor": 0.05, "poor_toxic": 0.01}
SAMPLE, LEXICON, RIDGE = 4_000, 24, 0.02
#: Steps at most, the length of a step over its size at which the fit ends, errors looked back at, steps replayed in a scan.
ROUNDS, TOLERANCE, MEMORY, REPLAYED = 80, 2e-6, 8, 8


def _domain(labels: DataFrame) -> DataFrame:
    own = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return own.select("doc_id", (F.when(F.col("q") == 1, 0).otherwise(2) + F.when(F.col("t") == 1, 1).otherwise(0)).alias("domain"))


def _lexicon(sample: DataFrame) -> list[str]:
    words = sample.select((F.col("domain") % 2 == 1).alias("toxic"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("word"))
    both = words.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    scored = both.filter("a >= 3").withColumn("odds", F.log((F.col("a") + 0.5) / (F.col("b") + 0.5))).filter("odds > 0")
    return [r["word"] for r in scored.orderBy(F.desc(F.col("a") * F.col("odds")), "word").limit(LEXICON).collect()]


def _features(lexicon: list[str]):
    """Token count and features as columns of text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(map(re.escape, lexicon)) + r")\b")) if lexicon else F.lit(0)
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    n = F.regexp_count(text, F.lit("[^\\s]+"))
    return n.cast("long").alias("tokens"), symbols.alias("symbols"), hits.alias("hits"), F.length(text).alias("chars")


def _numbers():
    n = F.greatest("tokens", F.lit(1))
    return [F.log1p("tokens") / 5, F.least(F.col("symbols") / n, F.lit(1.0)) * 5, F.sqrt(F.least(F.col("symbols") / n, F.lit(1.0))) * 3, F.least("hits", F.lit(3)).cast("double"), (F.col("hits") > 0).cast("double") * 3, F.least(F.col("chars") / n, F.lit(20.0)) / 4]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient steps."""
    k = len(DOMAINS)
    w, b = np.zeros((x.shape[1], k)), np.log(np.bincount(y, minlength=k) + 1.0)
    b -= b.mean()
    gold = np.eye(k)[y]
    step = 4.0 / (1 + (x * x).sum(axis=1).mean())
    pw, pb = w, b
    for r in range(800):
        m = r / (r + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z = x @ vw + vb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - gold) / len(x)
        pw, pb = w, b
        w, b = vw - step * (x.T @ e + 1e-4 * vw), vb - step * e.sum(axis=0)
    return w, b


def _rate(c: list[float], low: float | Column):
    """The rate as a column of the posteriors, from the scaled residuals c; 1 without any."""
    if not c:
        return F.lit(1.0)
    return F.greatest(F.lit(low), 1 - sum((F.col(f"p_{d}") * F.lit(v / RIDGE) for d, v in zip(DOMAINS, c, strict=True)), F.lit(0.0)))


def _posteriors(documents: DataFrame, labels: DataFrame, columns: list[str]) -> tuple[DataFrame, bool]:
    """Staged (columns..., tokens, p_<domain>...) for every row; whether a classifier could be fitted."""
    known = _domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = F.col("text").cast("string").alias("text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    sample = staged(docs.join(F.broadcast(known), "doc_id"), "labelled")  # at most SAMPLE ids
    lexicon = _lexicon(sample)
    rows = sample.select("domain", *_features(lexicon)).select("domain", *(c.cast("double") for c in _numbers())).collect()
    discard(sample)
    fitted = len({r[0] for r in rows}) > 1
    x, y = np.array([tuple(r)[1:] for r in rows], float), np.array([r[0] for r in rows], int)
    w, b = _fit(x, y) if fitted else (np.zeros((6, len(DOMAINS))), np.zeros(len(DOMAINS)))
    base = documents.select(*columns, text).select(*columns, *_features(lexicon))
    z = [sum((c * float(w[i, k]) for i, c in enumerate(_numbers())), F.lit(float(b[k]))) for k in range(len(DOMAINS))]
    base = base.select(*columns, "tokens", *(v.alias(f"z{k}") for k, v in enumerate(z)))
    base = base.withColumn("top", F.greatest(*(F.col(f"z{k}") for k in range(len(DOMAINS)))))
    e = [F.exp(F.col(f"z{k}") - F.col("top")) for k in range(len(DOMAINS))]
    total = sum(e[1:], e[0])
    return staged(base.select(*columns, "tokens", *((v / total).alias(f"p_{d}") for d, v in zip(DOMAINS, e, strict=True))), "posteriors"), fitted


def _stepped(rate: Column, c: np.ndarray, length: float, low: float | Column) -> Column:
    """A projected-gradient step from rate."""
    pull = sum((F.col(f"p_{d}") * F.lit(float(v * length)) for d, v in zip(DOMAINS, c, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(low), rate * F.lit(1 - length * RIDGE) + F.lit(length * RIDGE) - pull)


def fit_rates(t: DataFrame, targets: dict[str, float], low: float | Column = 0.0) -> list[float]:
    """The scaled residuals that give the rates of the staged table t(tokens, p_<domain>...)."""
    masses = [F.col("tokens") * F.col(f"p_{d}") for d in DOMAINS]
    sums = t.agg(F.sum("tokens"), *(F.sum(x) for x in masses)).first()
    if not sums[0]:
        return []
    total, goal = float(sums[0]), np.array([targets[d] for d in DOMAINS])
    scale = np.maximum(np.array(sums[1:], float) / total, 1e-6)
    rows, start, steps = t, F.greatest(F.lit(low), F.lit(1.0)), []

    def scanned(last: tuple[np.ndarray, float] | None) -> tuple[np.ndarray, float, float]:
        """Residuals and error behind the steps and the last one, and the square of the last one's size."""
        rate = start
        for c, length in steps:
            rate = _stepped(rate, c, length, low)
        at = rows.withColumn("old", rate).withColumn("new", _stepped(F.col("old"), *last, low) if last else F.col("old"))
        off = F.sum(F.col("tokens") * (F.col("new") - 1) ** 2), F.sum(F.col("tokens") * (F.col("new") - F.col("old")) ** 2)
        *mass, ridge, moved = (x / total for x in at.agg(*(F.sum(x * F.col("new")) for x in masses), *off).first())
        e = np.array(mass) - goal
        return e, float((e * e / scale).sum() + RIDGE * ridge), moved

    e, error, _ = scanned(None)
    short, long, length, errors = 1 / (1 + RIDGE), 1 / RIDGE, 1 / (1 + RIDGE), [error]
    for _ in range(ROUNDS):
        c = e / scale
        after, error, moved = scanned((c, length))
        while error > max(errors[-MEMORY:]) - 1e-4 * moved / length and length > short:
            length = max(length / 4, short)
            after, error, moved = scanned((c, length))
        steps.append((c, length))
        errors.append(error)
        bend = float(((after - e) ** 2 / scale).sum()) + RIDGE * moved
        e = after
        if moved**0.5 / length < TOLERANCE:
            break
        length = min(max(moved / bend, short), long)
        if len(steps) == REPLAYED:
            rate = start
            for c, n in steps:
                rate = _stepped(rate, c, n, low)
            kept = staged(rows.select("tokens", *(f"p_{d}" for d in DOMAINS), rate.alias("rate")), "rates")
            if rows is not t:
                discard(rows)
            rows, start, steps = kept, F.col("rate"), []
    if rows is not t:
        discard(rows)
    return (e / scale).tolist()


def rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, low: float = 0.0) -> DataFrame:
    """doc_id, source, tokens, p_<domain>..., rate, expected_tokens for every row of documents(doc_id, text, source)."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    t, fitted = _posteriors(own, labels, ["doc_id", "source"])
    residuals = fit_rates(t, targets, low) if fitted else []
    rate = F.when(F.col("tokens") > 0, _rate(residuals, low)).otherwise(F.lit(1.0))
    return t.withColumn("rate", rate).withColumn("expected_tokens", F.col("rate") * F.col("tokens"))


def source_weights(mixture: DataFrame) -> DataFrame:
    """source, tokens, expected_tokens, weight: the share of each source in the mixture."""
    by = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("expected_tokens").alias("expected_tokens"))
    total = by.agg(F.sum("expected_tokens").alias("all"))
    return by.join(F.broadcast(total)).select("source", "tokens", "expected_tokens", (F.col("expected_tokens") / F.col("all")).alias("weight"))


def attained(mixture: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, target, before, share, residual: each domain's share of all tokens before and after, and what it misses."""
    all_ = F.sum("tokens")
    sums = [F.struct(F.lit(d).alias("domain"), F.lit(targets[d]).alias("target"), (F.sum(F.col("tokens") * F.col(f"p_{d}")) / all_).alias("before"), (F.sum(F.col("expected_tokens") * F.col(f"p_{d}")) / all_).alias("share")) for d in DOMAINS]
    return mixture.agg(F.array(*sums).alias("d")).select(F.inline("d")).withColumn("residual", F.col("share") - F.col("target"))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, low: float = 1.0, spare_clean: bool = False) -> DataFrame:
    """documents with each row repeated by its rate: the whole part, and one more with the rest as probability by hash.

    With low = 1 no document goes, and what is above its target stays above; with low = 0 such documents go,
    but with spare_clean none that is more likely clean than not.
    Rows without doc_id draw by their text.
    """
    own = documents.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(documents.columns)})
    of = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    at = own.withColumns({"doc_id": F.col(of["doc_id"]).cast("long"), "text": F.col(of["text"]).cast("string")})
    t, fitted = _posteriors(at, labels, list(of.values()))
    floor = F.when(F.col("p_clean") > 0.5, F.lit(max(low, 1.0))).otherwise(F.lit(low)) if spare_clean else F.lit(low)
    residuals = fit_rates(t, targets, floor) if fitted else []
    rate = F.when(F.col("tokens") > 0, _rate(residuals, floor)).otherwise(F.lit(1.0))
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(of["doc_id"]).cast("long"), F.xxhash64(of["text"])), F.lit(29)), F.lit(1_000_003)) / 1_000_003
    copies = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")
    out = t.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*(F.col(n).alias(c) for c, n in of.items()))
