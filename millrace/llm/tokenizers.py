"""Public tokenizers as broadcast values, and a token count per text.

The folder of the vocabulary files is a parameter (``MILLRACE_TOKENIZERS`` or
``/opt/tokenizers``). A file is read on the driver and sent to the executors: its
size is fixed by the tokenizer (under 2 MB), whatever the data.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k"
#: pre-split of these vocabularies (fixed value of the tokenizer family)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: parts in which a very long text is handed to the encoder, cut where the pre-split cuts as well
PART = 200_000

_ENCODERS: dict[str, object] = {}


def ranks_file(name: str = DEFAULT, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or FOLDER, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def tokenizer_hash(name: str = DEFAULT, folder: str | None = None) -> str:
    return hashlib.sha256(PATTERN.encode() + ranks_file(name, folder)).hexdigest()[:16]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def encoder(raw: bytes):
    """The encoder of a vocabulary, kept per Python worker."""
    import tiktoken

    key = hashlib.sha256(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=parse_ranks(raw), special_tokens={})
    return _ENCODERS[key]


def count_tokens(enc, text: str | None) -> int:
    """Exact number of tokens; a text is handed over in parts that end where the pre-split ends a piece."""
    if not text:
        return 0
    total, at = 0, 0
    while len(text) - at > PART:
        # " x": a blank before a letter always opens a new piece
        cut = at + PART
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut + 1].isalpha() and not text[cut - 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def with_tokens(df: DataFrame, key: str, text_col: str = "text", name: str = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens); null texts have 0 tokens. Copies met in one batch are encoded once."""
    spark: SparkSession = df.sparkSession
    raw = spark.sparkContext.broadcast(ranks_file(name))
    columns = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            told: dict[str | None, int] = {}
            out = []
            for text in batch.column(len(columns)).to_pylist():
                if text not in told:
                    told[text] = count_tokens(enc, text)
                out.append(told[text])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out, pa.int64())], names=[*columns, "n_tokens"])

    source = df.select(*columns, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, n_tokens long")
