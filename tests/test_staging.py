import pytest

from answerloom.plans import staging


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


class _Session:
    sparkContext = _Context()
    conf = {}


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(_Session())
