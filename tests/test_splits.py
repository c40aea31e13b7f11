"""Splits of landed files: small beside the files, however large these are."""

from recordloom.plans import landed
from recordloom.sources import landing


def partitions(spark, folder, lines: int) -> int:
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text("".join(f'{n},"a\n{k}",{"x" * 80}\n' for n in range(lines)))
    with landed.small_splits(spark, str(folder)):
        return landing.lines_of(spark, str(folder)).rdd.getNumPartitions()


def test_splits_do_not_grow_in_number_with_the_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    few, many = partitions(spark, tmp_path / "few", 400), partitions(spark, tmp_path / "many", 20_000)
    assert 3 < few <= many <= 2 * landed.SPLITS
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_folder_without_bytes(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert landed.split_bytes(spark, str(tmp_path)) == landed.SPLIT_BYTES
