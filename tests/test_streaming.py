from orrery.streaming import popularity


def test_counts_grow_with_the_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1:5\n2:5\n1:5\n")
    query = popularity.popularity(popularity.watches(spark, str(folder))).writeStream.format("memory").queryName("watched").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("watched").collect()} == {(5, 2)}
        (folder / "b.txt").write_text("1:5\n3:5\n3:6\nnonsense\n")
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("watched").collect()} == {(5, 3), (6, 1)}
    finally:
        query.stop()
