import os

import pytest

from conftest import rows
from millrace.llm.tokens import TOKENIZERS, token_counts

FILES = ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"]
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, FILES[0])), reason="no tokenizers")
TEXTS = ["", "hello world", "<|endoftext|>", "ünï 日本", None, "a " * 5000]


@pytest.mark.parametrize("name", FILES)
def test_counts(spark, name):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "id int, text string, tokens int")
    got = dict(rows(token_counts(df, ["id"], vocabulary=os.path.join(TOKENIZERS, name))))
    assert got[0] == got[4] == 0 and got[1] >= 2 and got[2] > 1 and got[5] >= 5000


def test_the_same_vocabulary_counts_alike(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    a, b = (rows(token_counts(df, ["id"], vocabulary=os.path.join(TOKENIZERS, n))) for n in FILES[:2])
    assert a == b


def test_empty_and_unknown(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert rows(token_counts(df, ["id"])) == []
    with pytest.raises(OSError):
        token_counts(df, ["id"], vocabulary="/nowhere.json")
