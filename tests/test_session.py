import pytest

from gridloom import session


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_masters_may_use_a_local_folder(master):
    session._local_only(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_other_masters_need_the_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._local_only(master)
