"""Secret scan: fixed patterns, and a linear-chain conditional random field over the tokens of whole texts.

The patterns give the base spans. The field tags every token as begin (B), inside (I) or outside (O) of a secret from its
shape, the words beside it and features of the whole file, and Viterbi reads off the best tags; what it finds apart
from the base spans is added under the kind `crf`. It is trained here: stretches of the table's own texts, labelled
by the base spans, some of them given secrets of other alphabets, lengths and wording, so that shape and neighbours
rather than the patterns decide.

A token is a run of ASCII letters, digits, + / _ . - and all non-ASCII characters, or one other character; white space
parts tokens. Nothing is cut off: long texts are tokenised in strips that end at white space, then tagged as one chain.
Tokens whose best tag is O whatever their neighbours are (`_certain_margin`) part the chain exactly, so the
step-by-step search runs over the rest only.

A null text counts as empty: no spans. Rows keep their count and order of columns; repeated rows are scanned alike."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and the least lengths of what they must hold.
ASSIGN = rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"  # a run of 24 or more is a leftmost maximal run that is long enough
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

BASE_KINDS = ("assign", "access", "hex")
ADDED = "crf"
MAX_ROWS = 2_000
WINDOW = 400
GROUP_BYTES = 2 << 20
STRIP_BYTES = 1 << 20
WORDS = 4_096
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_assign, _access, _hex = re.compile(ASSIGN, re.I), re.compile(ACCESS), re.compile(HEX)


# ---- base spans


def base_spans(text: bytes, long_tokens: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) in bytes, per kind leftmost and non-overlapping. `long_tokens`:
    byte ranges that hold all word characters in runs of HEX_LEAST or more."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m.start(1)) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for a, b in [(0, len(text))] if long_tokens is None else long_tokens:
        found += [("hex", m.start(), m.end(), m.start()) for m in _hex.finditer(text, a, b)]
    return found


# ---- tokens and their features

_byte = np.arange(256)
_is = lambda chars: np.isin(_byte, list(chars.encode()))
_DIGIT, _LOWER, _UPPER = _is("0123456789"), (_byte >= 97) & (_byte <= 122), (_byte >= 65) & (_byte <= 90)
_MARK, _HIGH, _SPACE = _is("+/_.-"), _byte >= 128, _byte <= 32
_HEXED = _DIGIT | ((_byte >= 97) & (_byte <= 102)) | ((_byte >= 65) & (_byte <= 70))
_WORD = _DIGIT | _LOWER | _UPPER | _MARK | _HIGH
# 0: space, 1: lower, 2: upper, 3: digit, 4: mark, 5: non-ASCII, 6: a token of its own
_CLASS = np.select([_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _HIGH], range(6), 6).astype(np.uint8)
_FOLDED = np.where(_UPPER, _byte + 32, np.where(_DIGIT, 48, _byte))
_draw = np.random.default_rng(20240611)
_LETTER = (_draw.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1))[_FOLDED]
_PLACE = _draw.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_EDGE = 3  # empty places between two texts, so that neighbours never come from another text


def _strips(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about STRIP_BYTES that end at white space or between two texts."""
    at = 0
    while at < len(raw):
        to = at + STRIP_BYTES
        if to < len(raw):
            border = int(edges[np.searchsorted(edges, to)])
            while to < border and not _SPACE[raw[to : min(border, to + 4096)]].any():
                to = min(border, to + 4096)
            if to < border:
                to += int(np.argmax(_SPACE[raw[to : min(border, to + 4096)]]))
        yield at, min(to, len(raw))
        at = to


def tokenize(raw: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """start, size (bytes), shape figures and word number of all tokens; edges: ends of the texts, ascending."""
    parts = []
    for a, b in _strips(raw, edges):
        x = raw[a:b]
        kind = _CLASS[x]
        word = _WORD[x]
        fresh = kind > 0
        fresh[1:] &= ~(word[1:] & word[:-1])
        inner = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b)] - a
        fresh[inner] = kind[inner] > 0
        start = np.flatnonzero(fresh)
        if not len(start):
            continue
        total = lambda flags: np.add.reduceat(flags, start, dtype=np.int32)
        size = total(kind > 0)
        change = np.zeros(len(x), bool)
        change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        began = np.zeros(len(x), np.int64)
        began[start] = start
        place = np.arange(len(x)) - np.maximum.accumulate(began)
        named = np.add.reduceat(np.where(kind > 0, _LETTER[x] * _PLACE[place & 255], np.uint64(0)), start)
        named ^= named >> np.uint64(29)
        named *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append({
            "start": start + a, "size": size, "digits": total(kind == 3), "uppers": total(kind == 2), "lowers": total(kind == 1),
            "marks": total(kind == 4), "highs": total(kind == 5), "hexed": total(_HEXED[x]), "changes": total(change) - change[start],
            "word": ((named >> np.uint64(32)) % np.uint64(WORDS - 1)).astype(np.int32) + 1,
        })
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("start", "size", "digits", "uppers", "lowers", "marks", "highs", "hexed", "changes", "word")}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0: none, 1: under a fifth, 2: under a half, 3: less than all, 4: all."""
    return np.where(part == 0, 0, np.where(part == whole, 4, np.where(5 * part < whole, 1, np.where(2 * part < whole, 2, 3))))


#: feature group -> number of values; 0 is the empty place between texts in all groups of tokens.
GROUPS = {
    "form": 14 * 8, "mix": 126, "turns": 14 * 6, "word": WORDS, "before1": WORDS, "before2": WORDS, "before3": WORDS,
    "after1": WORDS, "form_before": 14 * 8, "form_after": 14 * 8, "file_size": 32, "file_marks": 16, "file_digits": 16,
}
_OFFSET = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])))
N_FEATURES = sum(GROUPS.values())
FILE_GROUPS = ("file_size", "file_marks", "file_digits")


def file_figures(tokens: dict[str, np.ndarray], edges: np.ndarray) -> dict[str, np.ndarray]:
    """Features of whole texts: size, share of single characters among the tokens, share of digits."""
    text = np.searchsorted(edges, tokens["start"], "right")
    alone = (tokens["digits"] + tokens["lowers"] + tokens["uppers"] + tokens["marks"] + tokens["highs"]) == 0
    count = lambda w: np.bincount(text, weights=w, minlength=len(edges))
    whole = np.maximum(np.diff(np.append(0, edges)), 1)
    return {
        "file_size": np.minimum(np.log2(whole).astype(int), 31),
        "file_marks": np.minimum(16 * count(alone) / np.maximum(count(np.ones(len(text))), 1), 15).astype(int),
        "file_digits": np.minimum(64 * count(tokens["digits"]) / whole, 15).astype(int),
    }


def features(tokens: dict[str, np.ndarray], edges: np.ndarray, files: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, at): feature numbers of every place of the chain, a column a group, and the place of each token. Texts lie
    one after the other with _EDGE empty places before, between and after them; `files` are their file_figures."""
    text = np.searchsorted(edges, tokens["start"], "right")
    at = np.arange(len(text)) + _EDGE * (text + 1)
    n = len(text) + _EDGE * (len(edges) + 1)
    size = tokens["size"]
    length = np.searchsorted(_LENGTHS, size, "right") + 1
    make = np.select(
        [tokens["digits"] == size, tokens["hexed"] == size, tokens["highs"] > 0, tokens["lowers"] + tokens["uppers"] == size,
         tokens["digits"] + tokens["lowers"] + tokens["uppers"] == size, tokens["digits"] + tokens["lowers"] + tokens["uppers"] + tokens["marks"] == size],
        [1, 2, 3, 4, 5, 6], 7,
    )
    mix = 1 + _share(tokens["digits"], size) * 25 + _share(tokens["uppers"], size) * 5 + _share(tokens["lowers"], size)

    def laid(values):
        out = np.zeros(n, np.int32)
        out[at] = values
        return out

    def moved(values, by):
        out = np.zeros(n, np.int32)
        if by > 0:
            out[by:] = values[:-by]
        else:
            out[:by] = values[-by:]
        return out

    form, word = laid(length * 8 + make), laid(tokens["word"])
    columns = {
        "form": form, "mix": laid(mix), "turns": laid(length * 6 + np.minimum(tokens["changes"], 5)), "word": word,
        "before1": moved(word, 1), "before2": moved(word, 2), "before3": moved(word, 3), "after1": moved(word, -1),
        "form_before": moved(form, 1), "form_after": moved(form, -1), **{k: laid(v[text]) for k, v in files.items()},
    }
    return np.stack([columns[g] + _OFFSET[g] for g in GROUPS], axis=1), at


# ---- the field

O, B, I = 0, 1, 2  # noqa: E741


@dataclass
class Field:
    """weights[feature, B or I]; O is the tag against which both are measured. moves[from, to]."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, 2), np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    bias: np.ndarray = field(default_factory=lambda: np.full(2, -20.0))

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 3))
        for a in range(0, len(ids), 1 << 18):
            part = ids[a : a + (1 << 18)]
            out[a : a + len(part), 1:] = self.bias + sum(self.weights[part[:, g]] for g in range(part.shape[1]))
        return out


def _certain_margin(moves: np.ndarray) -> np.ndarray:
    """The most that B or I can win against O through the moves to it and from it."""
    return np.array([max(moves[a, x] + moves[x, b] - moves[a, O] - moves[O, b] for a in range(3) for b in range(3)) for x in (B, I)])


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of a batch of chains [chain, step, tag] that start after and end before an O; ties go to the lower tag."""
    best = moves[O] + emissions[:, 0]
    back = np.zeros(emissions.shape, np.int8)
    for t in range(1, emissions.shape[1]):
        ways = best[:, :, None] + moves
        back[:, t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + emissions[:, t]
    tags = np.zeros(emissions.shape[:2], np.int8)
    tags[:, -1] = (best + moves[:, O]).argmax(axis=1)
    for t in range(emissions.shape[1] - 1, 0, -1):
        tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t, None].astype(int), 1)[:, 0]
    return tags


def decode(emissions: np.ndarray, at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tags of all places. Places without token and places that are O in any case part the chain; the stretches between
    are searched in batches of one length."""
    tags = np.zeros(len(emissions), np.int8)
    unsure = np.zeros(len(emissions), bool)
    unsure[at] = (emissions[at, 1:] + _certain_margin(moves) >= 0).any(axis=1)
    where = np.flatnonzero(unsure)
    if not len(where):
        return tags
    new = np.append(True, np.diff(where) > 1)
    start, size = where[new], np.diff(np.append(np.flatnonzero(new), len(where)))
    for n in np.unique(size):
        rows = start[size == n][:, None] + np.arange(n)
        for a in range(0, len(rows), max(1, 200_000 // int(n))):
            part = rows[a : a + max(1, 200_000 // int(n))]
            tags[part] = viterbi(emissions[part], moves)
    return tags


# ---- training


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(emissions: np.ndarray, tags: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradients by emissions and by moves) of a batch [chain, step, tag]; steps with real = 0 are
    empty places, which are O for certain."""
    emissions = np.where(real[:, :, None], emissions, np.array([0.0, -1e9, -1e9]))
    n, steps, _ = emissions.shape
    ahead, behind = np.empty_like(emissions), np.empty_like(emissions)
    ahead[:, 0] = emissions[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _lse(ahead[:, t - 1, :, None] + moves, 1) + emissions[:, t]
    behind[:, -1] = 0
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _lse(moves + (emissions[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    whole = _lse(ahead[:, -1], 1)
    chance = np.exp(ahead + behind - whole[:, None, None])
    pairs = np.exp(
        ahead[:, :-1, :, None] + moves + (emissions[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    ).sum(axis=(0, 1))
    said = np.eye(3)[tags]
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    value = np.take_along_axis(emissions, tags[:, :, None], 2).sum() + (moves * seen).sum() - whole.sum()
    return float(value), (said - chance) * real[:, :, None], seen - pairs


def fit(ids: list[np.ndarray], tags: list[np.ndarray], epochs: int = 10, rate: float = 0.25, l2: float = 1e-4, seed: int = 7) -> Field:
    """Adagrad on the likelihood of the labelled chains (places of whole windows with their empty edges)."""
    model = Field(bias=np.array([-3.0, -3.0]))
    if not ids:
        return Field()
    order, draw = sorted(range(len(ids)), key=lambda i: len(ids[i])), np.random.default_rng(seed)
    w = np.zeros((N_FEATURES, 2))
    sums = [np.full_like(w, 1e-2), np.full((3, 3), 1e-2), np.full(2, 1e-2)]
    batches = [order[a : a + 64] for a in range(0, len(order), 64)]
    for _ in range(epochs):
        for b in draw.permutation(len(batches)):
            rows = batches[b]
            steps = max(len(ids[i]) for i in rows)
            x = np.zeros((len(rows), steps, len(GROUPS)), np.int32)
            y, real = np.zeros((len(rows), steps), int), np.zeros((len(rows), steps), bool)
            for r, i in enumerate(rows):
                x[r, : len(ids[i])], y[r, : len(ids[i])], real[r, : len(ids[i])] = ids[i], tags[i], ids[i][:, 0] != 0
            e = np.zeros((len(rows), steps, 3))
            e[:, :, 1:] = model.bias + sum(w[x[:, :, g]] for g in range(x.shape[2]))
            _, by_e, by_moves = likelihood(e, y, real, model.moves)
            g_e = by_e[:, :, 1:].reshape(-1, 2) / len(rows)
            grad = np.stack([
                sum(np.bincount(x[:, :, g].ravel(), g_e[:, c], N_FEATURES) for g in range(x.shape[2])) for c in (0, 1)
            ], axis=1) - l2 * w
            for value, step, total in ((w, grad, sums[0]), (model.moves, by_moves / len(rows), sums[1]), (model.bias, g_e.sum(axis=0), sums[2])):
                total += step * step
                value += rate * step / np.sqrt(total)
    model.weights = w.astype(np.float32)
    return model


def _secret(draw: np.random.Generator) -> bytes:
    """A secret of some alphabet and length."""
    lower, upper, digit = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    sets = [b"0123456789abcdef", b"0123456789ABCDEF", lower + upper + digit, lower + upper + digit + b"+/", lower + digit, upper + digit]
    alphabet = np.frombuffer(sets[draw.integers(len(sets))], np.uint8)
    body = alphabet[draw.integers(0, len(alphabet), int(draw.choice([16, 20, 24, 32, 36, 40, 43, 64])))].tobytes()
    return [b"", b"", b"", b"sk-", b"ghp_", b"key-"][draw.integers(6)] + body


def _dressed(text: bytes, draw: np.random.Generator) -> tuple[bytes, list[tuple[int, int]]]:
    """The text with a secret or a look-alike put in at a word border, and the secret's place."""
    borders = [i for i, c in enumerate(text) if c == 32] or [len(text)]
    at = borders[draw.integers(len(borders))]
    name = [b"password", b"pwd", b"passphrase", b"secret", b"token", b"api_key", b"auth", b"credential", b"key", b"bearer", b"access", b"PRIVATE"][draw.integers(12)]
    link = [b" = ", b": ", b"=", b" is ", b' = "', b": '", b" ", b" => "][draw.integers(8)]
    if draw.random() < 0.35:  # look-alikes stay outside
        plain = [b"4111111111111111", b"+1 (212) 555-0187", b"192.168.13.77", b"2024-06-11", b"jane.doe@example.org", b"v1.22.333", b"https://example.org/a/b?id=77",
                 b"unbelievable-internationalisation", b"123456", b"ISBN 978-3-16-148410-0"][draw.integers(10)]
        return text[:at] + b" " + [b"", b"id = ", b"see ", b"call: ", b"version "][draw.integers(5)] + plain + text[at:], []
    value = _secret(draw)
    lead = b" " + name + link
    return text[:at] + lead + value + (b'"' if link.endswith(b'"') else b"'" if link.endswith(b"'") else b"") + text[at:], [
        (at + len(lead), at + len(lead) + len(value))
    ]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of WINDOW bytes with the figures of their file: around each base span (three of a text at most), else one."""
    for batch in batches:
        out = []
        for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
            raw = (text or "").encode()
            edges = np.array([len(raw)])
            files = file_figures(tokenize(np.frombuffer(raw, np.uint8), edges), edges)
            middles = [(a + b) // 2 for _, a, b, _ in base_spans(raw)[:3]] or [place % max(1, len(raw))]
            for m in middles:
                window = raw[max(0, m - WINDOW // 2) : m + WINDOW // 2].decode("utf-8", "ignore")
                out.append((window, *(int(files[k][0]) for k in FILE_GROUPS)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int32()) for i in range(4)], ["window", *FILE_GROUPS]
        )


def labelled(windows: list[tuple], seed: int = 11) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Chains of the windows (text and file figures) as they are, and once more dressed: feature numbers and tags."""
    draw, texts, secrets, files = np.random.default_rng(seed), [], [], []
    for window, *figures in windows:
        raw = window.encode()
        for text, put in ((raw, []), _dressed(raw, draw)):
            texts.append(text)
            secrets.append([(s, e) for _, _, e, s in base_spans(text)] + put)
            files.append(figures)
    edges = np.cumsum([len(t) for t in texts])
    tokens = tokenize(np.frombuffer(b"".join(texts), np.uint8), edges)
    ids, at = features(tokens, edges, dict(zip(FILE_GROUPS, np.array(files).T)))
    tags = np.zeros(len(ids), np.int8)
    start, end = tokens["start"], tokens["start"] + tokens["size"]
    per_text = np.searchsorted(start, np.append(0, edges))
    for i, found in enumerate(secrets):
        own, base = slice(per_text[i], per_text[i + 1]), int(edges[i]) - len(texts[i])
        for a, b in found:
            inside = np.flatnonzero((start[own] < b + base) & (end[own] > a + base)) + per_text[i]
            tags[at[inside]] = I
            tags[at[inside[:1]]] = B
    chains = [slice(per_text[i] + _EDGE * i, per_text[i + 1] + _EDGE * (i + 2)) for i in range(len(texts)) if per_text[i] < per_text[i + 1]]
    return [ids[c] for c in chains], [tags[c] for c in chains]


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    """Learns from windows of about `max_rows` texts, drawn by the hash of their content; a smaller table is used whole.
    A table without texts gives a field that tags nothing."""
    total = docs.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    some = docs.select("text", place.alias("place"))
    if total > max_rows:
        some = some.where(F.col("place") < int((1 << 30) * max_rows / total))
    drawn = some.mapInArrow(_windows, f"window string, {', '.join(f'{g} int' for g in FILE_GROUPS)}")
    windows = sorted(tuple(r) for r in drawn.collect())  # WINDOW bytes each
    return fit(*labelled(windows)) if windows else Field()


# ---- scanning


def scan_texts(texts: pa.Array, model: Field) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of all spans of every text, in code points, end exclusive, by start, then kind."""
    sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[sizes[0] : sizes[-1]]
    edges = sizes[1:] - sizes[0]
    out: list[list[tuple[str, int, int]]] = []
    a = 0
    while a < len(edges):
        base = int(edges[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(edges, base + GROUP_BYTES, "right")))
        out += _scan_group(data[base : edges[b - 1]], edges[a:b] - base, model)
        a = b
    return out


def _scan_group(raw: np.ndarray, edges: np.ndarray, model: Field) -> list[list[tuple[str, int, int]]]:
    tokens = tokenize(raw, edges)
    ids, at = features(tokens, edges, file_figures(tokens, edges))
    tags = decode(model.emissions(ids), at, model.moves)[at]
    start, end = tokens["start"], tokens["start"] + tokens["size"]
    text_of = np.searchsorted(edges, start, "right")
    marked = np.flatnonzero(tags)
    heads = marked[(tags[marked] == B) | (np.append(True, (np.diff(marked) > 1) | (text_of[marked[1:]] != text_of[marked[:-1]])))[: len(marked)]] if len(marked) else marked
    added: dict[int, list[tuple[int, int]]] = {}
    for h, nxt in zip(heads.tolist(), [*heads[1:].tolist(), len(tags)]):
        last = h
        while last + 1 < nxt and tags[last + 1] == I and text_of[last + 1] == text_of[h]:
            last += 1
        added.setdefault(int(text_of[h]), []).append((int(start[h]), int(end[last])))
    long_: dict[int, list[tuple[int, int]]] = {}
    for t in np.flatnonzero(tokens["size"] >= HEX_LEAST).tolist():
        long_.setdefault(int(text_of[t]), []).append((int(start[t]), int(end[t])))
    out = []
    for i, stop in enumerate(edges.tolist()):
        first = int(edges[i - 1]) if i else 0
        part = raw[first:stop]
        found = [(k, a, b) for k, a, b, _ in base_spans(part.tobytes(), [(a - first, b - first) for a, b in long_.get(i, [])])]
        known = sorted((a, b) for _, a, b in found)
        for a, b in added.get(i, []):
            if not any(a - first < y and b - first > x for x, y in known):
                found.append((ADDED, a - first, b - first))
        if found:
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            found = sorted(((k, int(chars[a]), int(chars[b])) for k, a, b in found), key=lambda s: (s[1], (*BASE_KINDS, ADDED).index(s[0])))
        out.append(found)
    return out


def secret_spans(docs: DataFrame, model: Field, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `spans`, array<struct<kind, start, end>>, of every row. Only `keep` and the text go to
    Python; a kept column named spans is replaced."""
    keep = [c for c in keep if c != "spans"]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string())
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in scan_texts(texts, model)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], schema=None, names=[*keep, "spans"])

    return kept.mapInArrow(run, schema)
