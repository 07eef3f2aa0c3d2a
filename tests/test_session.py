import os
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry_point
from sparkcorpus import session


def test_a_cluster_needs_a_shared_folder(spark):
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: {}))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(cluster, "x")
    local = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *_: "/w" if "warehouse" in key else None), sparkContext=SimpleNamespace(master="local[2]", getConf=lambda: {}, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc, applicationId="other"))
    assert session.shared_dir(local, "x").startswith("/w/_shared/x-")
    assert session._made.pop("other")


def test_shared_folders_can_be_cleared(spark):
    df = session.cut_lineage(spark.range(3), "kept")
    folder = os.path.dirname(df.inputFiles()[0]).removeprefix("file://").removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(folder)
    before = list(session._made[spark.sparkContext.applicationId])
    session._made[spark.sparkContext.applicationId] = [f for f in before if f.endswith(os.path.basename(folder))]
    assert session.clear_shared(spark) == 1 and not os.path.isdir(folder)
    session._made[spark.sparkContext.applicationId] = [f for f in before if not f.endswith(os.path.basename(folder))]


@pytest.mark.parametrize("name,raises", [("sparkcorpus.llm", False), ("sparkcorpus.llm.registry", False), ("regex", True)])
def test_only_a_missing_subpackage_is_left_out(monkeypatch, name, raises):
    def broken(_):
        raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(entry_point.importlib, "import_module", broken)
    if raises:
        with pytest.raises(ModuleNotFoundError):
            entry_point.queries()
    else:
        assert len(entry_point.queries()) > 50
