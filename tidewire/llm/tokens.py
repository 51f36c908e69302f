"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary file, ranks in tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; a larger file is refused.
MOST_BYTES = 64 << 20

_made: dict[int, object] = {}


def encoding(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary, made once per process."""
    key = hash((ranks, pattern))
    if key not in _made:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _made[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _made[key]


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns given with n_tokens, the size of the text in tokens.

    Null texts have null tokens, empty ones 0. The driver reads the vocabulary file and sends
    it out, so executors need no copy.
    """
    if Path(vocabulary).stat().st_size > MOST_BYTES:
        raise ValueError(f"vocabulary of more than {MOST_BYTES} bytes")
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value, pattern).encode_ordinary
        for b in batches:
            n = [None if t is None else len(encode(t)) for t in map(pa.StringScalar.as_py, b.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*columns, "n_tokens"])

    kinds = {f.name: f.dataType.simpleString() for f in documents.select(*columns).schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_tokens bigint"
    return documents.select(*columns, F.col(text).alias("_text")).mapInArrow(counted, schema)
