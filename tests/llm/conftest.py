"""The session and folder come from the tests above; brute-force checks read the smallest tables."""

import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def documents(folder):
    return pd.read_parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def pages(folder):
    return pd.read_parquet(f"{folder}/pages.parquet")
