import os

import pytest

from scriptorium import common as C


def test_staged_tables_are_released(spark):
    df = C.stage_table(spark.range(3), "some")
    path = C.local_path(df.inputFiles()[0]).rsplit("/", 1)[0]
    assert df.count() == 3
    assert path.startswith(C.local_path(C.scratch_dir(spark)))
    assert C.release_stages(spark) >= 1
    assert not os.path.exists(path)


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Nothing)}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.scratch_dir(Session)
