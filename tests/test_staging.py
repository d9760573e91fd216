"""Staged tables: where they go, when they go away, and which are broadcast."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from floorlake import staging


def files(df):
    return [Path(f.removeprefix("file:")) for f in (x.replace("file://", "file:") for x in df.inputFiles())]


def test_scratch_removes_what_is_not_kept(spark):
    with staging.scratch(spark):
        gone = staging.staged(spark.range(10), "gone")
        kept = staging.staged(gone.filter("id > 3"), "kept", keep=True)
        paths = files(gone)
        assert paths and all(p.exists() for p in paths)
    assert not any(p.exists() for p in paths)
    assert kept.count() == 6 and all(p.exists() for p in files(kept))
    with pytest.raises(RuntimeError), staging.scratch(spark):
        paths = files(staging.staged(spark.range(3), "gone"))
        raise RuntimeError
    assert not any(p.exists() for p in paths)


def test_staged_types_and_empty_tables(spark):
    d = spark.sql("SELECT array(1L, 2L) a, named_struct('x', 1.5D) s, cast(null AS binary) b WHERE false")
    again = staging.staged(d, "empty")
    assert again.schema.simpleString() == d.schema.simpleString() and again.count() == 0


def test_broadcast_by_size(spark):
    d = staging.staged(spark.range(1000), "some")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(staging.broadcast_if_small(d)) and not hinted(staging.broadcast_if_small(d, 100))


def test_batches_are_bounded(spark):
    staging.small_batches(spark)
    assert int(spark.conf.get(staging.ARROW_BYTES).rstrip("b")) <= staging.BATCH_BYTES
    spark.conf.set(staging.ARROW_BYTES, "1000")
    staging.small_batches(spark)
    assert spark.conf.get(staging.ARROW_BYTES).rstrip("b") == "1000"
    spark.conf.unset(staging.ARROW_BYTES)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: None, set=lambda key, value: None)
    of = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(of("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(of("local-cluster[2,1,1024]"))
    assert staging.shared_dir(of("local[2]")).startswith("file:///")
