import os

import pytest

from jsonloom.llm.common import Work, checkpoint_dir, fresh, kept_apart


def test_work_owns_its_tables_alone(spark):
    one, other = Work(spark), Work(spark)
    a, b, c = one.store(spark.range(5)), one.store(spark.range(6)), other.store(spark.range(7))
    sent = one.send([1, 2])
    paths = [p.removeprefix("file:") for p in (*one.paths, *other.paths)]
    assert a.count() + b.count() == 11 and all(map(os.path.isdir, paths)) and all(checkpoint_dir(spark).removeprefix("file:") in p for p in paths)
    one.drop(a)
    assert [os.path.isdir(p) for p in paths] == [False, True, True]
    one.clear()
    assert [os.path.isdir(p) for p in paths] == [False, False, True] and c.count() == 7
    with pytest.raises(Exception, match="destroyed|unpersist|Attempted|No such file"):
        spark.range(1).rdd.map(lambda _: sent.value).collect()
    other.clear()


def test_names():
    assert fresh("n", ["N", "n_"]) == "n__" and kept_apart(["kept", "x", "x_"], ["kept"]) == ["kept_", "x", "x_"]
