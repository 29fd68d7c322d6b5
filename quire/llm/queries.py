"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, fim, kneser_ney, language, license, minhash, mixing, pii, rules, trie, vectors
from .shared import table


def tokenizer(name: str = bpe.VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).withColumn("licenses", F.to_json("licenses"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer())


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    texts = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *texts)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_kneser_ney_quality, op2_quality_rules, op3_license_scan, op4_pii, op5_embedding_dedup, op6_minhash_dedup, op7_language_id, op8_bpe, op9_mixing, op10_token_counts, op11_exact_dedup, op12_fill_in_middle, op13_prefix_trie)}

_REACH = """
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
"""

ORACLE_SQL = {
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH},
comp AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, v.vec_id) AS component_id, v.vec_id = coalesce(c, v.vec_id) AS kept
FROM v LEFT JOIN comp ON id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
{_REACH},
comp AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON id = d.doc_id
""",
    "op11_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
           WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
      array_to_string(u[greatest(x, y) + 1:n], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS first,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384::BIGINT))),
                 4294967295::BIGINT) % 6 AS h FROM t),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d
      FROM (SELECT c.conv_id, t.role, t.text, 0 AS own, t.p FROM c JOIN t ON t.conv_id = c.first AND t.p <= c.h
            UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.p FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h)),
s AS (SELECT conv_id, d, length(text) AS chars, list((role, text)) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, d, chars, min(conv_id) OVER (PARTITION BY d, prefix) AS node, max(d) OVER (PARTITION BY conv_id) AS last FROM s),
n AS (SELECT node, d, count(*) AS n, any_value(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last) AS ends FROM m GROUP BY node, d),
e AS (SELECT n.*, up.node AS parent FROM n LEFT JOIN m up ON up.conv_id = n.node AND up.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS k FROM e WHERE d > 0 GROUP BY parent, d),
f AS (SELECT e.*, coalesce(k.k, 0) AS k FROM e LEFT JOIN k ON k.parent = e.node AND k.d = e.d),
sums AS (SELECT a.node, a.d, sum((f.n - 1) * f.chars) AS saved, count(*) FILTER (f.k = 0) AS leaves FROM f JOIN m a ON a.conv_id = f.node AND a.d <= f.d GROUP BY a.node, a.d)
SELECT f.node AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.k AS n_children, sums.leaves AS n_leaves,
       sums.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN sums ON sums.node = f.node AND sums.d = f.d
""",
}
