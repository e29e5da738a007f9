import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session()


def rows(df):
    """Rows as sorted tuples, for order-free comparison."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(name="rows", scope="session")
def rows_fixture():
    return rows
