"""Byte-level BPE encoding and decoding with a local rank file (operator 10).

``encode`` runs the tiktoken library inside tasks, one row at a time, without a shuffle. A text longer than ``chunk_chars``
is cut only where no match of the split pattern can reach over, and none looks: between a word character and a space, and
around long runs of white space. Of such a run all but the last character are one match, or all of it at the end of the text; that match goes to the
library as a piece of its own, as the library's regular expressions can't take a million of them.

Null text: as an empty one, with no ids. Very long texts: in parts, as above; one match of any length stays one.
Repeated rows: one output row each; nothing is ranked, so there are no ties. Empty table: no rows. Other columns of docs are left out, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SAFE = re.compile(r"(?<=\w)(?= )")
#: White space as the library's expressions have it, in runs that are taken apart.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(f"[{_BLANK}]{{10000,}}")


def load_encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, chunk_chars: int) -> Iterator[str]:
    """The text in parts of about chunk_chars, cut at safe boundaries; a part without one stays whole."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = _SAFE.search(text, start + chunk_chars)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(encoding, text: str, chunk_chars: int) -> list[int]:
    """The ids of the whole text."""
    if len(text) <= chunk_chars:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    start = 0
    for run in _LONG_BLANK.finditer(text):
        for part in safe_parts(text[start : run.start()], chunk_chars):
            out += encoding.encode_ordinary(part)
        # What follows a run takes its last character along.
        start = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding._encode_single_piece(text[run.start() : start])
    for part in safe_parts(text[start:], chunk_chars):
        out += encoding.encode_ordinary(part)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 50_000, rows_per_batch: int = 500) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``: the ids of each text and the bytes that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_per_batch):
                batch = whole.slice(at, rows_per_batch)
                ids, decoded = [], []
                for text in batch.column(1).to_pylist():
                    own = ids_of(encoding, text, chunk_chars)
                    ids.append(own)
                    decoded.append(encoding.decode_bytes(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
