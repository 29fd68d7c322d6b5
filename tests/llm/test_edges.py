"""Every operator on documents: columns with the names that the code uses inside, and very long texts."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, exact, fim, kneser_ney, language, license, minhash, mixing, pii, rules
from quire.llm.queries import tokenizer

INSIDE = ("t", "w", "key", "rid", "salt", "bucket", "tokens", "p_clean", "rate", "count", "text_key", "sig", "bands", "block", "h", "n", "kept", "score", "lang_pred", "h1", "cut", "digest", "hot", "sha", "component_id", "least", "domain", "z0", "top", "old", "new", "part", "paragraph", "licenses", "form", "output", "ids", "word", "value", "group_size")
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, long=None):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 400)}é" if i % 9 == 0 else f"wort{rng.randint(0, 90)}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(10)] + [None, "", "Licensed under the MIT License. a@b.cz", "Licensed under the MIT License. a@b.cz"]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + ([long] if long else []))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(10)], LABELS)


model = functools.cache(lambda: license.Model([]))
OPERATORS = {
    "op1": lambda d, lab: kneser_ney.classify(d, lab),
    "op2": lambda d, lab: rules.judge(d, lab),
    "op3": lambda d, lab: license.scan(d, model()).select("doc_id", "n_paragraphs", "families"),
    "op4": lambda d, lab: pii.detect(d),
    "op6": lambda d, lab: minhash.near_duplicates(d),
    "op7": lambda d, lab: language.predict(d),
    "op8": lambda d, lab: bpe.encode_digests(d, tokenizer()),
    "op9": lambda d, lab: mixing.rates(d, lab),
    "op10": lambda d, lab: bpe.token_counts(d, tokenizer()),
    "op11": lambda d, lab: exact.exact_duplicates(d),
    "op12": lambda d, lab: fim.transform(d),
}


@pytest.mark.parametrize("op", OPERATORS)
def test_columns_with_inside_names_change_nothing(spark, op):
    docs, labels = corpus(spark)
    clashing = docs.withColumns({c: F.lit(c) for c in INSIDE})
    plain = OPERATORS[op](docs, labels)
    got = OPERATORS[op](clashing, labels.withColumns({c: F.lit(c) for c in INSIDE}))
    assert got.columns == plain.columns
    rounded = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert rounded(got.collect()) == rounded(plain.collect())


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(14)
    long = " ".join(f"wort{rng.randint(0, 5000)}" for _ in range(130_000)) + " é" * 5
    docs, labels = corpus(spark, long)
    of = len(docs.collect()) - 1
    row = lambda op: OPERATORS[op](docs, labels).filter(F.col("doc_id") == of).first()
    n = len(Tokenizer.from_file(tokenizer()).encode(long, add_special_tokens=False).ids)
    assert row("op8")["n_tokens"] == n and row("op10")["n_tokens"] == n and row("op10")["over_limit"]
    w = long.split()
    assert row("op2")["n_words"] == len(w) and row("op6")["n_shingles"] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    perplexity = [r["perplexity"] for r in OPERATORS["op1"](docs, labels).collect()]
    assert None not in perplexity and 0 < min(perplexity) and max(perplexity) < float("inf") and row("op11")["group_size"] == 1 and row("op4")["n_email"] == 0
    out = row("op12")
    assert out["output"] == long or len(out["output"]) == len(long) + 9 and out["n"] > len(w)
