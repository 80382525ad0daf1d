import pytest

from moodspark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", stages=str(tmp_path_factory.mktemp("stages")))
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the named columns or as a whole."""
    found = [tuple(r) for r in df.collect()]
    if order:
        at = [df.columns.index(c) for c in order]
        return sorted(found, key=lambda r: tuple(str(r[k]) for k in at))
    return sorted(found, key=repr)
