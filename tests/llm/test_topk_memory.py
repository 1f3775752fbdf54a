from facetry.llm import topk


def test_copies_of_query_packs_stay_off_the_driver(spark, tmp_path):
    """The packs' file is small, their copies a key are not: no side of the join may be broadcast."""
    one = spark.createDataFrame([(0, 1, 1, 1, bytearray(8), bytearray(8))], topk.PACKED)
    one.write.parquet(str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    met = topk._meet(packs, packs, 8)
    assert met.count() == 1
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
