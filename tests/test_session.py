import pytest

from tablescout.session import shared_folder


class _Conf:
    def get(self, key, default=None):
        return default


class _Cluster:
    """A session of a cluster without a shared folder."""

    conf = _Conf()

    class sparkContext:
        master, applicationId = "spark://somewhere:7077", "app"
        getConf = staticmethod(lambda: _Conf())


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Cluster())
