"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 20
MEMO_PIECES = 1_000_000
STEP_CHARS = 2 << 20

# A byte-level pre-tokenizer never joins a visible character with the white space behind it, so a text
# may be cut there without touching a token. White space is the Unicode property, written out.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# Inside one unbroken stretch only letter and digit runs end surely.
_CLASS_END = re.compile(r"[a-z](?=[0-9.,;:!?])|[0-9](?=[a-zA-Z.,;:!?])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cuts a text where no token can cross: behind every visible stretch, and inside a stretch of more
    than `size` characters at the end of a letter or digit run. What has no such place stays in one
    piece, so the pieces always encode to the same tokens as the whole text."""
    pieces = _PIECE.findall(text)
    if len(text) <= size or max(map(len, pieces)) <= size:
        return pieces
    out = []
    for piece in pieces:
        start = 0
        while len(piece) - start > size and (cut := _CLASS_END.search(piece, start + size)):
            out.append(piece[start : cut.end()])
            start = cut.end()
        out.append(piece[start:])
    return out


def byte_balanced(sizes: np.ndarray, limit: int = BATCH_BYTES) -> list[np.ndarray]:
    """Positions grouped into calls of nearly equal bytes, at most `limit` unless one piece is larger."""
    if not len(sizes):
        return []
    calls = int(np.ceil(sizes.sum() / limit)) or 1
    ends = np.cumsum(sizes)
    cell = np.minimum((ends - sizes // 2) * calls // max(1, int(ends[-1])), calls - 1)
    return [part for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(cell)) + 1)]


_encoders: dict[str, object] = {}


def _encoder(path: str):
    """One tokenizer per worker process, on one thread: Spark already gives every core a task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _encoders[path] = lambda texts: [
                len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
    return _encoders[path]


def _encode_lengths(pieces: list[str], encode) -> dict[str, int]:
    sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
    found: dict[str, int] = {}
    for call in byte_balanced(sizes):
        part = [pieces[i] for i in call]
        found.update(zip(part, encode(part)))
    return found


def count_tokens(texts: list[str], path: str, memo: dict[str, int] | None = None) -> list[int]:
    """Token count of every text. A piece that recurs is encoded once; `memo` keeps counts between
    batches and is emptied when it holds MEMO_PIECES. SentencePiece models see whole texts, as their
    rules for blanks at the start of a text do not allow a cut."""
    encode = _encoder(path)
    memo = {} if memo is None else memo
    if path.endswith(".model"):
        known = _encode_lengths(list(dict.fromkeys(texts)), encode)
        return [known[t] for t in texts]
    out = []
    for step in byte_balanced(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_CHARS):
        pieces = [safe_pieces(texts[i]) for i in step]
        if len(memo) > MEMO_PIECES:
            memo.clear()
        memo.update(_encode_lengths(sorted(set().union(*pieces) - memo.keys()), encode))
        out += [sum(map(memo.__getitem__, p)) for p in pieces]
    return out


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row; all other columns pass through.

    No shuffle: the scan's partitions are encoded where they are read, the texts stay on the worker
    and only three numbers a row come back. Null and empty texts have 0 bytes and 0 tokens; repeated
    rows are counted each; an empty table gives an empty result. Columns of the input that are named
    like a result are replaced."""
    keep = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]
    slim = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = slim.drop("_text").withColumn("n_bytes", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            texts = [t or "" for t in column.to_pylist()]
            counts = count_tokens(texts, path, memo)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_text"]
            names = [f.name for f in batch.schema if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(size), pa.array(counts, pa.int64())], [*names, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
