from types import SimpleNamespace

import pytest

from lustra.session import materialize, new_scratch_path, scratch_dir


def session(setting, master, checkpoint=None):
    context = SimpleNamespace(
        master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoint
    )
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_configured_folder_wins_everywhere():
    assert scratch_dir(session("hdfs://shared/check/", "yarn")) == "hdfs://shared/check"
    assert scratch_dir(session("/shared", "local[2]", "/other")) == "/shared"
    assert scratch_dir(session(None, "yarn", "hdfs://own")) == "hdfs://own"


def test_only_a_local_master_may_do_without():
    folder = scratch_dir(session(None, "local[2]"))
    assert folder == scratch_dir(session(None, "local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session(None, "spark://host:7077"))


def test_a_written_table_keeps_schema_and_rows(make, values, spark):
    df = make("`a.b` int, t string", (1, None), (None, "x"))
    written = materialize(df, "test")
    assert written.schema == df.schema and values(written) == values(df)
    assert written.inputFiles()
    assert new_scratch_path(spark, "x") != new_scratch_path(spark, "x")
