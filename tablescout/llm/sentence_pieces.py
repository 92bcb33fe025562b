"""SentencePiece encoding and decoding by one pass of an Aho-Corasick automaton over the pieces.

The automaton runs over a stretch of text once; at every position its output links list the pieces
that end there, longest first, and each is tried as the last piece of the prefix. What "best" means
follows the model file:

* unigram: the sum of scores is relaxed (Viterbi);
* bpe: ids are defined by merge order and not by a sum, so a piece is accepted when it can follow
  the last piece of the prefix before it, that is when merging the two alone leaves both as they
  are. Exactly one piece per position passes, and the path is what merging the whole text gives."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import text_batches

BLANK = "▁"
MEMO_STRETCHES = 600_000
STEP_TEXTS = 64
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield tag >> 3, buf[at : at + size]
        at += size


class PieceModel:
    """Vocabulary of a .model file with an encoder and a decoder."""

    def __init__(self, data: bytes):
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, self.squeeze, self.rule = UNIGRAM, True, True, ""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece[2], np.float32)[0]) if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                self.rule = spec.get(1, b"").decode()
        if self.rule != "identity" or self.kind not in (UNIGRAM, BPE) or any(k == _USER for _, _, k in pieces):
            raise ValueError("only identity-normalised unigram and bpe models without user pieces are supported")
        self.pieces = [p for p, _, _ in pieces]
        self.types = [k for _, _, k in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.unknown = self.types.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == _BYTE}
        normal = [i for i, k in enumerate(self.types) if k == _NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.low = min(self.scores[i] for i in normal) - 10.0  # an unknown character
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), self.scores[i]))
        self.automaton.make_automaton()
        # No piece holds a blank behind another character, so stretches starting at blanks encode on
        # their own; characters of no piece separate stretches as well.
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            self.stretch = re.compile(r"[\s\S]+")
        else:
            lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
            self.stretch = re.compile(f"{BLANK}*[^{BLANK}{lone}]+|[{lone}]|{BLANK}+" if lone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._follows: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost on ties; for two joined pieces only."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _can_follow(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        return self._merged(a + b) == [a, b]

    def _last_pieces(self, text: str) -> list[int]:
        """bpe: the piece that ends at every position, -1 for a character of no piece. Matches arrive by end
        position, so every prefix is settled before it is used."""
        last, follows = [-1] * (len(text) + 1), self._follows
        for end, (piece, size, _) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            left = last[end + 1 - size]
            if left >= 0:
                pair = left << 32 | piece
                ok = follows.get(pair)
                if ok is None:
                    if len(follows) > MEMO_STRETCHES:
                        follows.clear()
                    ok = follows[pair] = self._can_follow(left, piece)
                if not ok:
                    continue
            last[end + 1] = piece
        return last

    def _best_pieces(self, text: str) -> list[int]:
        """unigram: the last piece of the best-scored path to every position."""
        best = [0.0] + [-np.inf] * len(text)
        last, settled = [-1] * (len(text) + 1), 0
        for end, (piece, size, score) in self.automaton.iter(text):
            while settled <= end:  # what no piece covers is one unknown character
                best[settled + 1] = best[settled] + self.low
                settled += 1
            if best[end + 1 - size] + score > best[end + 1]:
                best[end + 1], last[end + 1] = best[end + 1 - size] + score, piece
        return last

    def _encode_stretch(self, text: str) -> list[int]:
        last = self._last_pieces(text) if self.kind == BPE else self._best_pieces(text)
        ids: list[int] = []
        at, pieces = len(text), self.pieces
        while at > 0:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= len(pieces[piece])
                continue
            at -= 1
            if self.bytes:
                ids += [self.bytes[b] for b in reversed(text[at : at + 1].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids[::-1]

    def encode(self, text: str | None, memo: dict[str, bytes] | None = None) -> np.ndarray:
        """Piece ids of a whole text; a stretch that recurs is encoded once."""
        return self.encode_many([text], memo)[0]

    def encode_many(self, texts: list[str | None], memo: dict[str, bytes] | None = None) -> list[np.ndarray]:
        memo = {} if memo is None else memo
        out = []
        for at in range(0, len(texts), STEP_TEXTS):
            parts = []
            for text in texts[at : at + STEP_TEXTS]:
                if text and self.squeeze:
                    text = re.sub(" +", " ", text).strip(" ")
                shown = ((BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)) if text else ""
                parts.append(self.stretch.findall(shown))
            if len(memo) > MEMO_STRETCHES:
                memo.clear()
            for stretch in set().union(*parts) - memo.keys():
                memo[stretch] = np.asarray(self._encode_stretch(stretch), np.int32).tobytes()
            out += [np.frombuffer(b"".join(map(memo.__getitem__, p)), np.int32) for p in parts]
        return out

    def decode(self, ids) -> str:
        """Text of piece ids: blanks shown as blanks, byte pieces joined to UTF-8, control ids left out."""
        return self.decode_many([ids])[0]

    def decode_many(self, rows) -> list[str]:
        names = getattr(self, "_names", None)
        if names is None:
            byte = {i: b for b, i in self.bytes.items()}
            names = self._names = [
                bytes([byte[i]]) if i in byte
                else b"" if k == _CONTROL
                else " ⁇ ".encode() if k == _UNKNOWN
                else p.replace(BLANK, " ").encode()
                for i, (p, k) in enumerate(zip(self.pieces, self.types))
            ]
        out = []
        for ids in rows:
            raw = b"".join([names[i] for i in ids]) if ids is not None else b""
            text = raw.decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One automaton per worker process."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def encode_pieces(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", check: str | None = None) -> DataFrame:
    """Adds the piece ids of every whole text as array<int> and, if `check` names a column, whether decoding
    them gives the text back. Other columns pass through, those of the results' names are replaced.

    Null and empty texts give an empty array (and true), repeated rows are encoded each. No shuffle;
    `path` names the vocabulary file on every machine."""
    text_batches(df.sparkSession)
    keep = df.drop(ids, *([check] if check else []))
    out = keep.withColumn(ids, F.array(F.lit(0)))
    schema = (out.withColumn(check, F.lit(True)) if check else out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = piece_model(path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(at, STEP_TEXTS)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                rows = model.encode_many(texts, memo)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                added = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32()))]
                if check:
                    added.append(pa.array([a == (b or "") for a, b in zip(model.decode_many(rows), texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema.names)

    return keep.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an array of piece ids; null and empty arrays give an empty text."""
    keep = df.drop(text)
    schema = keep.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            texts = model.decode_many(r.values.to_numpy() if r.is_valid else None for r in rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return keep.mapInArrow(run, schema)
