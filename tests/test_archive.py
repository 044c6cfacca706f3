"""Chained archives: the same chunks however partitioned, every kind of damage named, and restores that go on."""

import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillstone.operators import archive
from quillstone.sources.log import Log


@pytest.fixture
def tables(spark):
    docs = spark.range(230).select(F.when(F.col("id") < 200, "t").otherwise("u").alias("tenant"), F.format_string("d%03d", "id").alias("id"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("indexes"), (F.col("id") % 3 == 0).alias("deleted"))
    fences = spark.range(25).select(F.lit("t").alias("tenant"), F.col("id").alias("name"), F.lit(None).cast("string").alias("owner"))
    return {"documents": (docs, ["id"]), "fences": (fences, ["name"])}


def made(spark, tables, folder, **options):
    manifest = archive.export(tables, "t", f"file://{folder}", 30, **options)
    return manifest, {name: table.schema for name, (table, _) in tables.items()}


def test_chunks_do_not_depend_on_partitions(spark, tables, tmp_path):
    one, schemas = made(spark, tables, tmp_path / "one")
    other = {name: (table.orderBy(F.rand(3)).repartition(7), order) for name, (table, order) in tables.items()}
    two, _ = made(spark, other, tmp_path / "two")
    rows = lambda m: sorted(map(tuple, m.collect()))
    assert rows(one) == rows(two) and one.count() == 8 and archive.root(one) == archive.root(two)
    back = archive.read(spark, f"file://{tmp_path}/one", schemas, archive.root(one))
    for name, (table, _) in tables.items():
        plain = lambda df: sorted(map(str, df.collect()))
        assert back[name].columns == table.columns and plain(back[name]) == plain(table.filter("tenant = 't'"))


@pytest.mark.parametrize("kind", ["missing", "unexpected", "swapped", "changed", "chain", "root"])
def test_damage_is_named(spark, tables, tmp_path, kind):
    manifest, schemas = made(spark, tables, tmp_path)
    folder, expected = tmp_path / "documents", archive.root(manifest)
    if kind == "missing":
        shutil.rmtree(folder / "chunk_=3")
    elif kind == "unexpected":
        shutil.copytree(folder / "chunk_=3", folder / "chunk_=77")
    elif kind == "swapped":
        (folder / "chunk_=3").rename(folder / "x")
        (folder / "chunk_=4").rename(folder / "chunk_=3")
        (folder / "x").rename(folder / "chunk_=4")
    elif kind == "changed":
        rows = [r.asDict() for r in spark.read.parquet(str(folder / "chunk_=3")).collect()]
        rows[4]["deleted"] = not rows[4]["deleted"]
        shutil.rmtree(folder / "chunk_=3")
        spark.createDataFrame(rows, StructType([*schemas["documents"].fields, StructField("position_", LongType())])).write.parquet(str(folder / "chunk_=3"))
    elif kind == "chain":
        edited = manifest.toPandas()
        edited.loc[(edited.table == "documents") & (edited.chunk == 3), "chain"] = "0" * 64
        spark.createDataFrame(edited, manifest.schema).write.mode("overwrite").parquet(f"file://{tmp_path}/manifest")
    schemas = {name: table.schema for name, (table, _) in tables.items()}
    found = {(r.table, r.chunk, r.problem) for r in archive.problems(spark, f"file://{tmp_path}", schemas, "other" if kind == "root" else expected).collect()}
    wish = {"missing": {("documents", 3, "missing")}, "unexpected": {("documents", 77, "unexpected")}, "swapped": {("documents", 3, "swapped"), ("documents", 4, "swapped")}, "changed": {("documents", 3, "changed")}, "chain": {("documents", 3, "chain")}, "root": {("manifest", None, "root")}}[kind]
    assert found == wish
    with pytest.raises(ValueError, match=kind):
        archive.read(spark, f"file://{tmp_path}", schemas, "other" if kind == "root" else expected)


def test_a_restore_goes_on(spark, tables, tmp_path):
    manifest, schemas = made(spark, tables, tmp_path / "a")
    logs = {name: Log(spark, f"file://{tmp_path}/{name}", ["tenant", *order]) for name, (_, order) in tables.items()}
    path = f"file://{tmp_path}/a"
    # broken off after the first table
    assert archive.restore(path, {"documents": logs["documents"]}, schemas, at_once=3) == 3
    assert archive.restore(path, logs, schemas, archive.root(manifest), at_once=3) == 1
    assert archive.restore(path, logs, schemas, at_once=3) == 0
    for name, (table, _) in tables.items():
        assert sorted(map(str, logs[name].read().select(table.columns).collect())) == sorted(map(str, table.filter("tenant = 't'").collect()))
