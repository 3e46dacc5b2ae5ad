import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quadrat.session import local_session  # noqa: E402

LIST = Path(__file__).resolve().parents[1] / "FIXTURES.md"


class Study:
    """Study tables by the fixture names of FIXTURES.md, read where that list says they are."""

    def __init__(self, text):
        self.root = Path(re.search(r"relative to `([^`]+)`", text).group(1))
        self.short = re.search(r"`(db/)` stands for `([^`]+)`|`(db/)` stands for\s+`([^`]+)`", text.replace("\n", " "))
        self.rows = [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("| ")]

    def _full(self, cell):
        name = re.search(r"`([^`]+)`", cell).group(1)
        return self.root / name.replace(self.short.group(1), self.short.group(2), 1)

    def __getitem__(self, fixture):
        return next(self._full(r[1]) for r in self.rows if r[0].startswith(fixture))

    def with_column(self, column):
        return next(self._full(r[0]) for r in self.rows if len(r) == 3 and column in r[2])


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "quadrat-tests")


@pytest.fixture(scope="session")
def study():
    found = Study(LIST.read_text()) if LIST.exists() else None
    if found is None or not found.root.exists():
        pytest.skip("study tables not present")
    return found
