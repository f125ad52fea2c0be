import os

from brindle.sources.scratch import Scratch, release, shared_dir


def folder(spark):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://").removeprefix("file:")


def test_drop_and_release(spark):
    scratch = Scratch(spark, "here")
    one, two = scratch.keep(spark.range(5)), scratch.keep(spark.range(3))
    assert one.count() == 5 and len(os.listdir(scratch.base.removeprefix("file://"))) == 2
    scratch.drop(one, two.where("id > 0"))
    scratch.drop(one)  # once more does nothing
    assert two.count() == 3 and len(os.listdir(scratch.base.removeprefix("file://"))) == 1
    release(spark)
    assert not os.path.exists(folder(spark))
    assert Scratch(spark, "again").keep(spark.range(2)).count() == 2


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) and Scratch(spark, "x").base.startswith(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/x-")
