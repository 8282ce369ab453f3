"""The corpus pipeline, stage by stage, and the registered queries."""

import collections

import corpus_pipeline
from test_documents import measured
from test_similar import survivors

from voxmend.llm import queries


def test_stages(spark, docs, rows, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(names).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "pack"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, now, str(tmp_path))
        if name != "pack":
            assert found.schema.names == names
        found.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    good = [r for r in rows if measured(r[1])[6]]
    assert collections.Counter(r["text"] for r in seen["quality"]) == collections.Counter(r[1] for r in good)
    assert collections.Counter(map(tuple, seen["language"])) <= collections.Counter(map(tuple, seen["quality"]))
    assert len(seen["language"]) >= 0.9 * len(seen["quality"])
    group = survivors([(r["doc_id"], r["text"]) for r in seen["language"]])
    first = {g: min((r["doc_id"] is None, r["doc_id"] or 0) for r, x in zip(seen["language"], group) if x == g) for g in group}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in seen["near_duplicates"]) == sorted(first.values())
    kept = {tuple(r) for r in seen["near_duplicates"]}
    assert {tuple(r) for r in seen["mix"]} <= kept and max(collections.Counter(map(tuple, seen["mix"])).values()) <= 3
    pieces = collections.Counter(r["doc_id"] for r in seen["pack"] if r["piece"] == 0)
    assert pieces == collections.Counter(r["doc_id"] for r in seen["mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(seen["pack"])


def test_no_documents(spark, docs, tmp_path):
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in queries.QUERIES and corpus_pipeline.ORACLE_SQL is None


def test_own_tables_can_be_cleared(spark, tmp_path):
    from voxmend.llm.common import clear, own_folder, written

    found = written(spark.range(5), "numbers")
    assert found.count() == 5
    clear(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
