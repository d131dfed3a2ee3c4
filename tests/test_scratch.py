from types import SimpleNamespace

import pytest

from listmill.scratch import shared_folder


def session(**settings):
    named = {k.replace("_", "."): v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named.get(key, default)))


def test_folder_of_the_cluster():
    cluster = session(spark_checkpoint_dir="hdfs://h/x/", spark_master="yarn")
    first, second = shared_folder(cluster, "a"), shared_folder(cluster, "a")
    assert first.startswith("hdfs://h/x/listmill/a-") and first != second


def test_own_folder_only_for_a_local_session_without_a_setting():
    local = session(spark_master="local[2]")
    assert shared_folder(local, "a").rsplit("/", 1)[0] == shared_folder(local, "b").rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(spark_master=master), "a")
