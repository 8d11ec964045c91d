from waymark.plans import records


def test_an_image_in_the_middle_of_a_street_is_seen(spark, monkeypatch):
    street = spark.createDataFrame([(1, "primary", [(8.0, 52.0), (8.0, 52.0008)])], "edge_id long, highway string, pts array<struct<lon: double, lat: double>>")
    images = spark.createDataFrame([(7, 52.0004, 8.0)], "image_id long, lat double, lon double")
    monkeypatch.setattr(records, "_edges", lambda spark, d: street)
    monkeypatch.setattr(records.views, "images", lambda spark, d, *columns: images)
    row = records.a26_street_coverage(spark, "").first()
    # Of the five samples, 22 m apart, at least the middle one has it within 25 m.
    assert 88 < row.length_m < 90
    assert row.covered_share >= 0.2
