from rooftop.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_comes_from_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(d.rstrip("/")) and "/rooftop/x-" in a


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    import pytest

    from rooftop import session as S

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    monkeypatch.setattr(S.tempfile, "mkdtemp", lambda **kw: pytest.fail("temp folder on a cluster"))
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Session())
    assert S.is_local("local[8]") and S.is_local("local") and not S.is_local("local-cluster[3,2,1024]")


def test_clear_scratch(spark):
    from rooftop.session import clear_scratch, materialized
    df = materialized(spark.range(5), "t")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    import os
    assert os.path.exists(path)
    clear_scratch(spark)
    assert not os.path.exists(path)
