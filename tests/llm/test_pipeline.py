"""The five stages against brute force on a small table."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from tallystone.llm import mixing


def test_stages_take_effect_one_after_another(spark, tmp_path):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = words(30)
    docs, labels = [], []
    for i in range(120):
        text = words(rng.randrange(40, 80))
        if i % 6 == 0:
            text += " scumbag"
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, text, "en", "ab"[i % 2], 0))
    copies = [(200 + k, docs[k][1] + (" tail" if k % 2 else ""), "en", "a", 0) for k in range(1, 30, 4)]
    leaks = [(300 + k, f"{words(20)} {item} {words(20)}", "en", "b", 0) for k in range(3)]
    odd = [(400, None, None, None, None), (401, "", "en", "a", 0), (1, docs[1][1], "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs + copies + leaks + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "sharding":
            assert frame.columns == columns
            frame.write.parquet(f"{tmp_path}/{name}")
            frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = Counter(r["doc_id"] for r in frame.collect())
    clean = {i for i in range(120) if i % 6} | {r[0] for r in copies if (r[0] - 200) % 6} | {r[0] for r in leaks} | {400, 401}
    assert set(kept["toxicity"]) == clean and kept["toxicity"][1] == 2
    unique = Counter({i: 1 for i in clean if not 200 <= i < 300})
    assert kept["near_dedup"] == unique
    assert kept["decontamination"] == Counter({i: 1 for i in unique if not 300 <= i < 400})
    before = spark.read.parquet(f"{tmp_path}/decontamination")
    assert kept["mixing"] == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(before).collect() if r["copies"]})
    assert kept["sharding"] == kept["mixing"]
    assert Counter(r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()) == kept["sharding"]


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
