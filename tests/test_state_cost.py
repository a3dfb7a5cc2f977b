"""The keyed state of the streams works row by row."""

from pyspark.sql.group import GroupedData

from claimsweep.streaming import state


def test_state_of_the_streams_makes_no_frame_per_key(spark, tmp_path, monkeypatch):
    def refused(*args, **options):
        raise AssertionError("a frame for every key")

    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", refused)
    schema = "claim_id string, submitted_at timestamp_ntz, invoice_number string, invoice_date string, invoice_amount string"
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path))
    assert "dup_any" in state.duplicate_hits(arriving).columns
    assert state.rows_so_far(arriving, "claim_id").schema == arriving.schema
