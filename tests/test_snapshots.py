import pytest
from pyspark.sql import functions as F

from areaweave.operators.clean import standardise_ids
from areaweave.operators.rules import LayerExtractionError
from areaweave.sinks import snapshots as S
from areaweave.sources import ledger
from tests.conftest import frame, line, point

LAYERS = "lga_id STRING, layer STRING, element_type STRING, osmid BIGINT, name STRING"


def layers(spark, *areas):
    return frame(spark, [(a, "roads", "way", i, None, line((5.2, 7.2), (5.3, 7.3 + i))) for a in areas for i in range(3)], LAYERS)


def read(spark, path, name="layers"):
    return sorted((r["lga_id"], r["osmid"]) for r in S.read_snapshot(spark, path, name).select("lga_id", "osmid").collect())


def test_only_the_last_commit_of_each_area_is_read(spark, tmp_path):
    path = f"{tmp_path}/out"
    both = layers(spark, "a", "b")
    S.stage({"layers": both, "quarantined": both}, path, "1")
    S.commit(both, path, "1")
    assert read(spark, path) == [(a, i) for a in "ab" for i in range(3)]

    # A run for one area that now has nothing quarantined and one feature less.
    part = layers(spark, "a").where("osmid > 0")
    S.stage({"layers": part, "quarantined": part.limit(0)}, path, "2")
    assert len(read(spark, path)) == 6  # not yet
    S.commit(part, path, "2")
    assert read(spark, path) == [("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert {a for a, _ in read(spark, path, "quarantined")} == {"b"}


def test_vacuum_keeps_what_is_current_and_what_is_being_written(spark, tmp_path):
    path = f"{tmp_path}/out"
    for run, area in (("1", "a"), ("2", "b"), ("3", "a"), ("9", "b")):
        S.stage({"layers": layers(spark, area)}, path, run)
        if run != "9":
            S.commit(layers(spark, area), path, run)
    assert S.vacuum(spark, path, "5") == ["1"]
    assert S.vacuum(spark, path, "5") == []
    S.commit(layers(spark, "b"), path, "9")
    assert len(read(spark, path)) == 6 and S.vacuum(spark, path, "5") == ["2"]


def test_ledger_tells_broken_files_from_empty_ones(spark, tmp_path):
    path = tmp_path / "in"
    for layer in ("roads", "schools", "landuse"):
        spark.range(1000).select(F.col("id").alias("osmid")).coalesce(1).write.parquet(f"{path}/layer={layer}")
    spark.range(0).select(F.col("id").alias("osmid")).write.parquet(f"{path}/layer=buildings")
    whole = next((path / "layer=schools").glob("*.parquet"))
    whole.write_bytes(whole.read_bytes()[:-200])  # cut off
    torn = next((path / "layer=landuse").glob("*.parquet"))
    data = bytearray(torn.read_bytes())
    data[4:600] = b"\xff" * 596  # the footer stands, the pages do not
    torn.write_bytes(bytes(data))
    for crc in path.glob("*/.*.crc"):
        crc.unlink()
    found = {r["file"].split("layer=")[1].split("/")[0]: (r["n"], r["problem"]) for r in ledger.read_ledger(spark, str(path), "osmid BIGINT").collect()}
    assert found["roads"] == (1000, None) and found["buildings"] == (0, None) and found["schools"] == (0, "unreadable")
    assert found["landuse"][1] is not None

    notes = ledger.input_notes(ledger.read_ledger(spark, str(path), "osmid BIGINT"))
    assert sorted(r["layer"] for r in notes.collect()) == ["landuse", "schools"]
    with pytest.raises(LayerExtractionError, match="'landuse' failed to extract: 1 of its input files"):
        ledger.check_inputs(notes)
    ledger.check_inputs(notes.limit(0))


def test_ids_of_any_type_do_not_end_the_job(spark):
    rows = [("yes", "12", point(0.0, 0.0)), ("no", "n77", point(1.0, 0.0)), (None, None, point(2.0, 0.0))]
    done = standardise_ids(frame(spark, rows, "bridge STRING, id STRING")).orderBy("bridge").collect()
    assert [(r["osmid"], r["osmid_text"]) for r in done] == [(None, None), (None, "no"), (12, "yes")]
