from seawake.streaming import daily_counts, read_reports

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselType,Status\n"


def test_daily_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + "1,2024-01-01T10:00:00,1,2,3,4,70,0\n1,2024-01-01T11:00:00,1,2,3,4,70,0\n2,2024-01-01T11:00:00,1,2,3,4,70,0\n")
    (folder / "b.csv").write_text(HEAD + "1,2024-01-09T10:00:00,1,2,3,4,70,0\n")
    query = daily_counts(read_reports(spark, str(folder), 1)).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.mmsi, r.n) for r in spark.table("days").collect()) == [(1, 2), (2, 1)]
