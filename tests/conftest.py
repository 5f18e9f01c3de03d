import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodemap import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 2, spark__driver__memory="6g", spark__sql__codegen__wholeStage="false",
                       spark__sql__adaptive__enabled="false")


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of plain tuples of the named columns."""
    def read(df, *cols):
        def plain(v):
            return tuple(v) if isinstance(v, list) else v
        return sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=str)

    return read
