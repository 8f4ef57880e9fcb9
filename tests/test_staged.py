from pathlib import Path

from wagerlens.sources.staged import shared_folder, staged


def test_staged_tables_follow_their_inputs(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    assert staged(spark, "t", [source], build).count() == staged(spark, "t", [source], build).count() == 3 and len(built) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert staged(spark, "t", [source], build).count() == 8 and len(built) == 2
    folder = Path(shared_folder(spark).removeprefix("file://"))
    for path in folder.glob("staged-t-*"):
        path.rename(path.with_name("gone-" + path.name))
    assert staged(spark, "t", [source], build, cluster_by="id").count() == 8 and len(built) == 3
