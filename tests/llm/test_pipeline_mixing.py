import corpus_pipeline
import numpy as np
from quire.llm import mixing


def test_pipeline_mixing_lowers_what_exceeds_its_target(spark, tmp_path):
    """Half the documents are toxic and the target is 4 %: most of them must go, and no clean one does."""
    texts = [" ".join(("house", "tree", "river")[(i * 7 + k * k) % 3] for k in range(50)) + (" moron" * 3 if i % 2 else "") for i in range(400)]
    docs = spark.createDataFrame([(i if i < 380 else None, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mix(spark, docs, str(tmp_path))
    kept = [r["text"] for r in out.collect()]
    toxic = np.mean(["moron" in t for t in kept])
    assert out.columns == docs.columns and toxic < 2 * mixing.TARGETS["toxic"]
    assert {t for t in texts if "moron" not in t} <= set(kept)
