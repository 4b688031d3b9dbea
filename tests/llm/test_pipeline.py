"""The stages in turn."""

import pytest

import corpus_pipeline
from paperloom.llm.store import table, written

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path, odd_docs):
    folder = str(tmp_path)
    text = " ".join(f"word{k} thing{k % 11}" for k in range(120))
    leak = " ".join(f"item{k}" for k in range(20))
    rows = [(k, f"{text} own{k} {' '.join(f'u{k}x{j}' for j in range(200))}", "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(100, rows[4][1], "en", "s1", 1), (101, f"{rows[4][1]} more", "en", "s1", 1)]
    rows += [(102, f"{text} {' '.join(f'u102x{j}' for j in range(200))} {leak}", "en", "s1", 1), (103, "short", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = table(spark, folder, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert 103 not in kept[0] and set(kept[0]) >= set(range(30))
    assert 100 not in kept[1] and 101 not in kept[1] and 4 in kept[1]
    assert 102 not in kept[2] and len(kept[2]) == len(kept[1]) - 1
    assert set(kept[3]) <= set(kept[2]) and kept[4] == kept[3]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    runs = [corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)]  # side by side in one process
    for rows in runs:
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, tmp_path, odd_docs, no_docs):
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert len(corpus_pipeline.token_output(spark, docs, str(tmp_path)).collect()) == docs.count()
