import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lakewarden.session import build_session

    session = build_session("lakewarden-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def fixture_tables():
    """Golden tables of FIXTURES.md by section number."""
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
    sections, current = {}, None
    for line in open(path, encoding="utf-8"):
        if line.startswith("## "):
            current = line[3:].split(".")[0].split(" ")[0]
            sections[current] = []
        elif line.startswith("|") and not line.startswith("|---"):
            sections[current].append([c.strip() for c in line.strip().strip("|").split("|")])
    return sections
