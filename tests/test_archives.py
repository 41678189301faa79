import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.sources import archives

ROWS = [("a", [1.0, 2.0]), ("b", [3.5, -4.0]), (None, [0.0, 1.0]), ("c", None), ("d", []), ("é", [1.0, 2.0, 3.0]), ("a", [1.0, 2.0])]


def _table(spark, rows):
    return spark.createDataFrame(rows, "concept_id string, vec array<float>")


def _got(df):
    return sorted(((r[0], None if r[1] is None else tuple(r[1])) for r in df.collect()), key=str)


def _want(rows):
    return sorted(((k, None if v is None else tuple(v)) for k, v in rows), key=str)


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_archives_read_back(spark, tmp_path, rows):
    path = str(tmp_path / "v")
    archives.write_vectors(_table(spark, ROWS), path, rows=rows)
    assert _got(archives.read_vectors(spark, path, rows=rows)) == _want(ROWS)
    assert all(f.endswith(".npz") for f in os.listdir(path))
    archives.write_vectors(_table(spark, ROWS[:2]), path, mode="append")
    assert _got(archives.read_vectors(spark, path)) == _want(ROWS + ROWS[:2])
    archives.write_vectors(_table(spark, ROWS[:1]), path)
    assert _got(archives.read_vectors(spark, path)) == _want(ROWS[:1])


def test_foreign_archives_by_ranges(spark, tmp_path):
    matrix = np.arange(5000 * 3, dtype=np.float64).reshape(5000, 3)
    for save, name in ((np.savez, "plain"), (np.savez_compressed, "packed")):
        save(tmp_path / f"{name}.npz", embeddings=matrix, names=np.array([f"k{i}" for i in range(5000)]))
        path = str(tmp_path / f"{name}.npz")
        df = archives.read_vectors(spark, path, rows=700, vectors="embeddings", keys="names")
        assert df.rdd.getNumPartitions() == 8
        assert df.where(F.col("vec")[0] != F.substring("concept_id", 2, 9).cast("int") * 3).count() == 0
        assert df.select("concept_id").distinct().count() == 5000
    numbered = archives.read_vectors(spark, path, vectors="embeddings")
    assert numbered.where("vec[0] != cast(concept_id AS int) * 3").count() == 0


def test_empty_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "none")
    archives.write_vectors(_table(spark, []), path)
    assert archives.read_vectors(spark, path).count() == 0
    archives.write_vectors(_table(spark, ROWS[:2]), path)
    bad = spark.range(100).select(
        F.col("id").cast("string").alias("concept_id"),
        F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.array(F.lit(1.0).cast("float"))).alias("vec"),
    )
    with pytest.raises(Exception, match="broken"):
        archives.write_vectors(bad, path)
    assert _got(archives.read_vectors(spark, path)) == _want(ROWS[:2])
    assert not [f for f in os.listdir(path) if not f.endswith(".npz")]


def test_null_component_is_nan(spark, tmp_path):
    archives.write_vectors(_table(spark, [("a", [1.0, None])]), str(tmp_path / "n"))
    (row,) = archives.read_vectors(spark, str(tmp_path / "n")).collect()
    assert row["vec"][0] == 1.0 and math.isnan(row["vec"][1])
