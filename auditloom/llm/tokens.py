"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.runtime import spread

#: Folder of the vocabulary files and the file used unless told otherwise.
VOCABULARIES = os.environ.get("AUDITLOOM_VOCABULARIES", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the column ``text``.

    Rows whose text is null or empty are left out. The whole text is encoded, in one pass over the data.
    """
    path = vocabulary or os.path.join(VOCABULARIES, VOCABULARY)
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.col(text).alias("_text"))
    rows = spread(rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tokens int"
    names = [*keep, "tokens"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes = [len(own.encode_ordinary(x.encode("utf-8", "replace").decode("utf-8"))) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(sizes, pa.int32())], names)

    return rows.mapInArrow(measure, schema)
