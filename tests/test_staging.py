from pathlib import Path

import pytest

from quarry.plans import staging


def folder(df):
    return Path(df._staged.removeprefix("file://").removeprefix("file:"))


def test_scopes_delete_what_is_not_kept(spark):
    outer = staging.stage(spark.range(3), "outer")
    with staging.scope(spark) as own:
        a = staging.stage(spark.range(5), "a")
        with staging.scope(spark):
            b = staging.stage(a.selectExpr("id + 1 AS id"), "b")
            inner = folder(b)
        assert not inner.exists()
        kept, gone = own.keep(staging.stage(a.where("id > 2"), "c")), folder(a)
        dropped = staging.stage(a, "d")
        where = folder(dropped)
        staging.drop(dropped)
        assert not where.exists() and gone.exists()
    assert not gone.exists() and kept.count() == 2 and outer.count() == 3


def test_scopes_end_after_errors(spark):
    with pytest.raises(RuntimeError), staging.scope(spark):
        path = folder(staging.stage(spark.range(1), "lost"))
        raise RuntimeError
    assert not path.exists()
    after = staging.stage(spark.range(1), "after")
    assert folder(after).exists()
