"""The format of landed board documents."""

import os

from pyspark.sql import functions as F

from tidewell.sources import landing


def documents(spark, ids):
    return spark.createDataFrame([("lever", f"b{i}", f'[{{"id": {i}, "text": "naïve\\n{i}"}}]') for i in ids], "source_type string, source_external_key string, body string").withColumn("fetched_at", F.lit("2024-03-02 10:00:00.123456").cast("timestamp"))


def test_documents_come_back_as_they_landed(spark, tmp_path):
    landing.register(spark)
    path = str(tmp_path / "boards")
    assert spark.read.format(landing.NAME).load(path).count() == 0
    landing.land(documents(spark, range(40)).repartition(20), path, 0)
    landing.land(documents(spark, range(100, 103)).withColumn("body", F.lit(None).cast("string")), path, 1)
    landing.land(documents(spark, [200]), path, 1)  # a landing that is made again
    back = spark.read.format(landing.NAME).load(path)
    want = documents(spark, [*range(40), 200])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.select(back.columns).collect()))
    assert len(landing.BoardReader(path).partitions()) == -(-len(landing._listed(path)) // landing.FILES_A_TASK) == 2


def test_a_landing_counts_when_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "boards")
    landing.land(documents(spark, [1]), path, 0)
    landing.land(documents(spark, [2]), path, 1)
    os.remove(f"{path}/{1:012d}/_SUCCESS")
    assert {f.split("/")[-2] for f in landing._listed(path)} == {f"{0:012d}"}


def test_a_stream_goes_on_behind_its_offset(spark, tmp_path):
    landing.register(spark)
    path, out = str(tmp_path / "boards"), str(tmp_path / "out")
    seen = []
    for n, ids in enumerate(([1, 2], [], [3], [])):
        if ids:
            landing.land(documents(spark, ids), path, n)
        stream = spark.readStream.format(landing.NAME).load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-cp").trigger(availableNow=True).start(out).awaitTermination()
        seen.append(spark.read.schema(landing.SCHEMA).parquet(out).count() if os.path.exists(out) else 0)
    assert seen == [2, 2, 3, 3]
    assert landing.BoardStream(path).partitions({"last": ""}, landing.BoardStream(path).latestOffset())[0].names == landing._listed(path)


def test_places_come_from_dimension_files(spark, tmp_path):
    from tidewell.functions import geo
    from tidewell.sources import raw

    (tmp_path / "a.json").write_text('{"states": ["Kerala "], "cities": ["Newtown", "st. john\'s"], "aliases": {"Oldtown": "Newtown"}}')
    (tmp_path / "b.json").write_text('{"cities": ["newtown", ""]}')
    known = raw.places(raw.load_geo_dims(spark, str(tmp_path)))
    assert known == geo.Places(("kerala",), ("newtown", "st. john's"), (("oldtown", "newtown"),))
    df = spark.createDataFrame([(x,) for x in ("OLDTOWN, East", "Newtowns", "Kerala", "Pune", "St. John's")], "place string")
    none = F.lit(None).cast("string")
    got = {r[0]: r[1] for r in df.select("place", geo.classify_relevance(F.array("place"), none, none, places=known)).collect()}
    assert got == {"OLDTOWN, East": "india", "Newtowns": "unknown", "Kerala": "india", "Pune": "unknown", "St. John's": "india"}
    assert geo.PLACES == raw.places(raw.load_geo_dims(spark)) or set(geo.PLACES.cities) == set(raw.places(raw.load_geo_dims(spark)).cities)
