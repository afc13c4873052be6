"""Token counts by public tokenizers. Vocabulary files are read from a path; none is part of this repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the queries look for vocabulary files; the environment variable overrides it.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"
_MOST = 64 << 20

_loaded: dict[int, Callable[[Sequence[str]], list[int]]] = {}


def _counter(name: str, data: bytes, pattern: str) -> Callable[[Sequence[str]], list[int]]:
    """A function from texts to token counts, by the kind of the vocabulary file; special tokens are ordinary text."""
    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode("utf-8"))
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(list(texts), add_special_tokens=False)]
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        e = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in p.encode(list(texts), num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary file: {name}")


#: How byte-level vocabularies of the .tiktoken kind cut a text before merging: the public pattern of that family.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str | None = None, pattern: str = SPLIT, name: str = "tokens") -> DataFrame:
    """``keep…, tokens``: the length of each text in tokens; 0 for NULL and empty texts.

    The vocabulary file (at most 64 MB, checked) is read once on the driver and broadcast; each Python worker builds its
    tokenizer once. Whole texts are encoded, batch by batch; nothing is shuffled.
    """
    path = vocabulary or os.path.join(TOKENIZERS, DEFAULT)
    if os.path.getsize(path) > _MOST:
        raise ValueError(f"{path} is larger than {_MOST} bytes")
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast((os.path.basename(path), f.read()))
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    given = df.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("x"))
    shape = ", ".join([*[f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1])], "n long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value[0]) ^ len(shared.value[1])
        if key not in _loaded:
            _loaded[key] = _counter(*shared.value, pattern)
        encode = _loaded[key]
        for b in batches:
            texts = b.column(len(keep))
            n = np.zeros(b.num_rows, np.int64)
            for lo in range(0, b.num_rows, 64):  # encodings hold more than their ids: few at a time
                n[lo : lo + 64] = encode(texts.slice(lo, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], [*b.schema.names[:-1], "n"])

    return given.mapInArrow(count, shape).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)} | {"n": name})
