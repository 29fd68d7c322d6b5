"""The five stages together, against plain Python on a small corpus."""

import hashlib
import itertools
import os
import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from quire.llm import mixing, pii, rules
from quire.llm.queries import tokenizer
from quire.llm.shared import shared_dir

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gone string, copy int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def corpus():
    rng = random.Random(77)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [make(rng.randint(60, 120)) for _ in range(120)]
    texts += [t + " moron idiot" for t in (make(70) for _ in range(60))]
    texts += ["%%% ### " * 20 + make(60) for _ in range(12)]
    near = make(100)
    texts += [near] * 4 + [near + f" end{i}" for i in range(4)]
    texts += [make(70) + " write to a.b@c.de or call (509) 555-6973", make(30), "", None, "word " * 300]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "x", 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, make(80), "en", "s0", 9, "x", 5), (3, make(90), None, None, None, None, None)]
    labels = [(i, int(not 180 <= i < 192), int(120 <= i < 180)) for i in range(0, 192) if i % 3]
    return rows, labels


def least_squares(p, w, floor, goal):
    """Rates of the mixing objective by many plain projected-gradient steps."""
    w = w / w.sum()
    mass = np.maximum(w @ p, 1e-6)
    r, z, step = np.ones(len(w)), np.ones(len(w)), 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p / mass)[-1] + mixing.RIDGE)
    for k in range(20_000):
        slope = p @ (((w * z) @ p - goal) / mass) + mixing.RIDGE * (z - 1)
        new = np.maximum(floor, z - step * slope)
        z, r = new + k / (k + 3) * (new - r), new
    return r


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        seen[name] = out.collect()
        at = spark.createDataFrame(seen[name], docs.schema)

    # 1: the base rules by hand, the forest's verdict from the operator's own rows, on exactly these rows
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in rules.judge(docs, marked).collect()}
    kept = [r for r in rows if len(words(r[1])) >= 50 and r[1] != "word " * 300]
    kept = [r for r in kept if verdict[r[0], len(words(r[1]))]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[5] or "")
    assert sorted(map(tuple, seen["quality rules"]), key=key) == sorted(kept, key=key)
    assert {i for i in range(120) if i % 3} <= {r[0] for r in kept}

    # 2: components by all pairs, one row each, exact repeats once
    unique = list(dict.fromkeys(kept))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(r[1]) for r in unique)]
    comp = list(range(len(unique)))
    for a, b in itertools.combinations(range(len(unique)), 2):
        if None not in (unique[a][0], unique[b][0]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            comp = [comp[a] if c == comp[b] else c for c in comp]
    least = {c: min(unique[i][0] for i in range(len(unique)) if comp[i] == c) for c in set(comp) if unique[c][0] is not None}
    single = [r for i, r in enumerate(unique) if r[0] is None or least[comp[i]] == r[0]]
    assert sorted(map(tuple, seen["near-dedup"]), key=key) == sorted(single, key=key)
    assert sum(r[1].startswith(rows[192][1]) for r in single) == 1

    # 3: every span masked, n_chars set anew
    scorer = pii.Scorer(pii.train())
    masked = [(r[0], t, *r[2:4], len(t), *r[5:]) for r in single for t in [pii.mask(r[1], pii.find(r[1], scorer)[1])]]
    assert sorted(map(tuple, seen["pii"]), key=key) == sorted(masked, key=key)
    assert any("[EMAIL]" in r[1] and "[PHONE]" in r[1] for r in masked)

    # 4: copies as the rates of the least-squares minimum say
    at = spark.createDataFrame(seen["pii"], docs.schema)
    m = mixing.rates(at.withColumn("source", F.col("text")), marked).collect()  # the text as a name for the row
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in m])
    floor = np.where(p[:, 0] > 0.5, 1.0, 0.0)
    rate = least_squares(p, np.array([r["tokens"] for r in m], float), floor, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]))
    copies = {t: sum(r["text"] == t for r in seen["mixing"]) for t in (r["source"] for r in m)}
    assert all(np.floor(r - 1e-3) <= copies[x["source"]] <= np.ceil(r + 1e-3) for x, r in zip(m, rate, strict=True))
    assert sum(copies.values()) == len(seen["mixing"]) and abs(len(seen["mixing"]) - rate.sum()) < 3 * np.sqrt(len(m))
    assert rate[["moron" in r["source"] for r in m]].mean() < 0.6 and min(copies[r["source"]] for r, f in zip(m, floor, strict=True) if f) >= 1

    # 5: the library's ids, and run() gives the same rows as the stages one by one
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want = []
    for r in seen["mixing"]:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), ids, hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    folder = re.sub("^file:/*", "/", shared_dir(spark))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=order) == sorted(want, key=order)
    assert [n.split("-")[2] for n in set(os.listdir(folder)) - before] == ["mixing"]  # what the last stage reads


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_operators_on_ties_and_repeats(spark):
    """Equal rows get equal results, in every operator that judges rows one by one."""
    from quire.llm import kneser_ney, language

    text = "good words of a plain text " * 12
    docs = spark.createDataFrame([(i % 3, text, "en", "s", 1, "x", 1) for i in range(9)], COLUMNS)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (kneser_ney.classify(docs, labels), language.predict(docs).drop("held_out"), rules.judge(docs, labels), mixing.rates(docs, labels)):
        got = [tuple(r)[1:] for r in rows.collect()]
        assert len(got) == 9 and len(set(got)) == 1
    assert kneser_ney.classify(docs.limit(0), labels).count() == rules.judge(docs.limit(0), labels).count() == mixing.rates(docs.limit(0), labels).count() == 0
