"""Token counts of whole texts under a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.session import let_workers_import

#: Where the vocabulary lies; any tiktoken rank file will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern published with that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Pieces of a very long text; it is cut only before white space, where the pattern never joins two pieces.
PIECE = 1 << 20


def count_tokens(text: str | None, enc) -> int:
    """Tokens of a text; 0 for null and empty. Long texts are encoded in pieces of bounded size."""
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > PIECE:
        cut = text.rfind("\n", at + 1, at + PIECE)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
            cut = text.rfind("\n", at + 1, cut - 1)
        if cut <= at:
            break
        n += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def with_token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens LONG of the whole text (0 for null or empty). Row-local, no shuffle."""
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = pa.array([count_tokens(t.as_py(), enc) for t in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], n], names=[*keep, "n_tokens"])

    let_workers_import(df.sparkSession)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
