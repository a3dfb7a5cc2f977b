"""The pipeline against plain steps, each on its predecessor's table."""

import os
import shutil
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from helpers import awkward, stored  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402
from test_tables import plain_rules, plain_targets, words  # noqa: E402

from claimsweep.llm import quality  # noqa: E402


def test_stages_one_by_one(spark, tmp_path):
    text = "alpha beta gamma delta " * 2 + " ".join(f"word{i}" for i in range(30))
    rows = awkward() + [(700 + i, text, "a") for i in range(5)] + [(800 + i, f"{text} number {i} " + f"tail{i} " * 3, "b") for i in range(40)]
    rows += [(900 + i, f"{text} nasty{i % 3} insult {i} of mine", "c") for i in range(40)]
    docs = stored(spark, rows, tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 900)) for i, *_ in rows if i and i >= 800], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    table = docs
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
        out = apply(spark, table, str(tmp_path))
        out.write.mode("overwrite").parquet(str(tmp_path / f"out{k}"))
        table = spark.read.parquet(str(tmp_path / f"out{k}"))
        after = table.collect()
        if k < 4:
            assert table.columns == docs.columns
        ids = sorted((r["doc_id"] or -1) for r in after)
        if k == 0:
            assert ids == sorted(r[0] or -1 for r in plain_rules(before, quality.LINE_LIMIT, quality.LEAST_LEFT) if r[-1])
        if k == 1:
            assert not any(i >= 900 for i in ids) and {i for i, *_ in before if i and i < 850} <= set(ids)
        if k == 2:
            groups = plain_components([plain_fingerprint(t) for _, t, _ in before])
            assert len(after) == len(set(groups))
            assert set(ids) == {min(b[0] or -1 for b, x in zip(before, groups) if x == g) for g in groups}
        if k == 3:
            sizes, taken = {}, {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + len(words(t))
            for r in after:
                taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
            for s, goal in plain_targets(sizes).items():
                assert abs(taken.get(s, 0) - goal) <= max(len(words(t)) for _, t, x in before if x == s) / 2 + 1e-6
        if k == 4:
            assert ids == sorted(i or -1 for i, *_ in before) and all(r["round_trip"] for r in after)
    shutil.rmtree(tmp_path / "out4")


def test_run_over_small_table_and_empty_one(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("round_trip and size(ids) > 0").count() == out.count() > 50
    stored(spark, [], tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
