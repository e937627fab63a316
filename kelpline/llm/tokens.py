"""Token counts by a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The encoder of a rank file; made once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the carried columns and ``n_tokens`` of each row's whole ``text``; null text has 0."""
    names = ["doc_id", *carry]
    chosen = docs.select(*names, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*names).schema), "n_tokens BIGINT"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in (x.as_py() for x in b.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return chosen.mapInArrow(run, schema)
