import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest
from conftest_llm import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, n int, row int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lineaweave.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, lang, source]), with columns whose names the operators use themselves."""
    def make(rows):
        full = [(i, t, *(list(r) + ["en", "s"][len(r):]), None, "x", "y", 7, 3) for i, t, *r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, equal and repeated rows."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one"), (6, "one"), (6, "one"), (None, "no id here"),
            (7, prose(2, 80)), (8, prose(2, 80)), (9, "é ü 日本 😀 \x00 \x85"), (10, "!!! ### 123")]
