"""Row ids name the same rows in every read of a stored table."""

from helpers import stored

from claimsweep.llm.common import with_row_id

SPLITS = "spark.sql.files.maxPartitionBytes"


def test_row_ids_do_not_hang_on_splits(spark, tmp_path):
    for i in range(6):
        stored(spark, [(100 * i + j, f"text {j} " * (1 + 40 * i)) for j in range(20)], tmp_path / "d" / f"part={i}")
    docs, before = spark.read.parquet(str(tmp_path / "d")), spark.conf.get(SPLITS)
    seen = []
    try:
        for size in ("128m", "1500", "6000"):  # other splits, as with other cores
            spark.conf.set(SPLITS, size)
            rows = with_row_id(docs, "r").select("doc_id", "r").collect()
            seen.append({x["doc_id"]: str(x["r"]) for x in rows})
    finally:
        spark.conf.set(SPLITS, before)
    assert seen[0] == seen[1] == seen[2]
    assert len(set(seen[0].values())) == 120
