"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags each token as the beginning of a secret, inside one or outside. It scores the token's
shape, its neighbours and the file, plus the transition from the tag before, and is decoded by
Viterbi line by line. It is trained here, on two sources: a sample of about ``SAMPLE_DOCS``
documents (twice that at most) whose labels are the fixed patterns' own matches, and lines made up by
rule. The sample is drawn by hash, so it is the same at every partitioning; the weights (some
hundred numbers) are broadcast, and every token of every document is decoded.

Defined cases: a null text is empty and has no secrets; of a span of the field that touches patterns'
matches, the parts outside them are reported if they hold a letter or digit, and the matches stay; a corpus without any secret trains on the made-up lines alone;
repeated rows are scanned alike; empty tables give an empty result. Only the id and the text are
read, nothing is shuffled, and a task holds a few megabytes of text at a time.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Bounds of the training sample: documents, characters of each, and lines kept of either kind.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LINES = 2000, 20_000, 600
#: Tokens of a training line on either side of its middle.
SAMPLE_TOKENS = 30

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
#: Marks between a match and the rest of its token; "=" may end a secret.
JOINTS = " \t\x0b\x0c\r\"'`()[]{}<>.,;:!?&|"
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def fixed_matches(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, kind, start of the secret itself`` of the patterns' matches, in order."""
    low = text.lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a maximal run of 16 or more: what begins earlier in a shorter run cannot reach it
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda m: (m[0], KINDS.index(m[2])))


# --- features ------------------------------------------------------------------------------------

_BYTES = np.arange(256)
_CLASS = {
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "hex": ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 102)),
    "link": np.isin(_BYTES, list(b"+/_-=.")),
    "quote": np.isin(_BYTES, list(b"\"'`")),
    "beyond": _BYTES >= 128,
}
_BLANK = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
NAMES = (
    "bias", "length8", "length12", "length16", "length24", "length40", "digit", "digits", "mixed", "hex", "encoded", "quoted",
    "beyond", "changes3", "changes6", "all_digits", "symbols",
    "keyword", "assigns", "only_mark", "access", "header",
)
_HEADS = tuple(x.encode() for x in (*_KEYWORDS, "credential", "bearer", "private"))
N_FEATURES = len(NAMES) + 3 * 5 + 3


@dataclass
class Tokens:
    """Tokens of texts laid one after another: byte ranges, line and text numbers, feature rows."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    text: np.ndarray
    rows: np.ndarray


def tokenize(texts: list[bytes]) -> Tokens:
    joined = b"\n".join(texts)
    data = np.frombuffer(joined + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    text = np.searchsorted(begins, start, side="right") - 1
    line = np.cumsum(data == 10)[start]
    n = len(start)
    rows = np.zeros((n, N_FEATURES), np.float32)
    if n:
        _fill(rows, data, joined.lower(), start, end, line, text)
    return Tokens(start, end, line, text, rows)


def _fill(rows: np.ndarray, data: np.ndarray, low: bytes, start: np.ndarray, end: np.ndarray, line: np.ndarray, text: np.ndarray) -> None:
    n = len(start)
    length = end - start

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[end] - total[start]

    of = {name: count(table[data]) for name, table in _CLASS.items()}
    letter = of["lower"] + of["upper"]
    is_digit, is_letter = _CLASS["digit"][data], (_CLASS["lower"] | _CLASS["upper"])[data]
    change = np.concatenate([[False], (is_digit[1:] & is_letter[:-1]) | (is_letter[1:] & is_digit[:-1])])
    changes = count(change)
    core = length - of["quote"]
    last, first = data[end - 1], data[start]
    marks = np.isin(last, list(b":="))
    keyword, header, access = (np.zeros(n, bool) for _ in range(3))
    for word in _HEADS:
        at = low.find(word)
        while at >= 0:
            i = int(np.searchsorted(start, at, side="right")) - 1
            (header if word in (b"bearer", b"credential", b"private") else keyword)[i] = True
            at = low.find(word, at + 1)
    access[(length >= 18) & (first == 65) & (data[np.minimum(start + 1, len(data) - 1)] == 75)] = True
    columns = [
        np.ones(n), core >= 8, core >= 12, core >= 16, core >= 24, core >= 40, of["digit"] > 0, 5 * of["digit"] >= core,
        (of["lower"] > 0) & (of["upper"] > 0) & (of["digit"] > 0), (of["hex"] >= core - 1) & (of["digit"] > 0) & (core >= 8),
        (letter + of["digit"] + of["link"] >= core - 1) & (core >= 8), of["quote"] > 0, of["beyond"] > 0, changes >= 3, changes >= 6,
        of["digit"] == length, length - letter - of["digit"] - of["beyond"] >= 3,
        keyword, marks, marks & (length == 1), access, header,
    ]
    for i, column in enumerate(columns):
        rows[:, i] = column
    at = len(NAMES)
    for shift in (1, 2, -1):  # the tokens before, and the one after, of the same line
        here, there = (slice(shift, n), slice(0, n - shift)) if shift > 0 else (slice(0, n + shift), slice(-shift, n))
        same = line[here] == line[there]
        for column in (keyword, marks, header, core >= 12, access):
            rows[here, at] = column[there] & same
            at += 1
    per_text = np.bincount(text, minlength=int(text[-1]) + 1)
    for column in (keyword, of["beyond"] > 0, length - letter - of["digit"] - of["beyond"] >= 3):  # the file: share of such tokens
        share = np.bincount(text, column, minlength=len(per_text)) / np.maximum(per_text, 1)
        rows[:, at] = share[text]
        at += 1


# --- the field -----------------------------------------------------------------------------------

OUT, BEGIN, INSIDE = 0, 1, 2
_NEVER = -1e9


@dataclass
class Field:
    """Weights of features by tag, and of transitions; inside follows only begin or inside."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Most likely tags, line by line; lines of one slice step forward together."""
        n = len(tokens.start)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = tokens.rows @ self.weights
        heads = np.flatnonzero(np.concatenate([[True], tokens.line[1:] != tokens.line[:-1]]))
        sizes = np.diff(np.concatenate([heads, [n]]))
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[order], sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # lines with a token at each step
        best = np.zeros((len(heads), 3), np.float64)
        come = np.zeros((n, 3), np.int8)
        for step in range(int(sizes[0])):
            k = alive[step]
            at = heads[:k] + step
            if step == 0:
                best[:k] = score[at]
                best[:k, INSIDE] = _NEVER
                continue
            paths = best[:k, :, None] + self.moves[None]
            come[at] = paths.argmax(axis=1)
            best[:k] = paths.max(axis=1) + score[at]
        tag = best.argmax(axis=1)
        for step in range(int(sizes[0]) - 1, -1, -1):
            k = alive[step]
            at = heads[:k] + step
            tags[at] = tag[:k]
            tag[:k] = come[at, tag[:k]]
        return tags


def train(lines: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100, ridge: float = 0.02) -> Field:
    """Maximum conditional likelihood by forward and backward sums; all lines of a round step together."""
    longest = max(len(t) for _, t in lines)
    m = len(lines)
    x = np.zeros((m, longest, N_FEATURES))
    y = np.zeros((m, longest), int)
    real = np.zeros((m, longest), bool)
    for i, (rows, tags) in enumerate(lines):
        x[i, : len(tags)], y[i, : len(tags)], real[i, : len(tags)] = rows, tags, True
    w, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    ban = np.zeros((3, 3))
    ban[OUT, INSIDE] = _NEVER
    onehot = np.eye(3)[y] * real[..., None]
    seen = np.einsum("mtf,mtk->fk", x, onehot)
    seen_moves = np.einsum("mti,mtj->ij", onehot[:, :-1], onehot[:, 1:])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

    for turn in range(1, rounds + 1):
        score, step = x @ w, moves + ban
        forth, back = np.zeros((m, longest, 3)), np.zeros((m, longest, 3))
        forth[:, 0] = score[:, 0]
        forth[:, 0, INSIDE] = _NEVER
        for t in range(1, longest):
            new = lse(forth[:, t - 1, :, None] + step, 1) + score[:, t]
            forth[:, t] = np.where(real[:, t, None], new, forth[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = lse(forth[:, -1], 1)
        odds = np.exp(forth + back - total[:, None, None]) * real[..., None]
        pair = forth[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        moved = (np.exp(np.minimum(pair, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
        slopes = ((seen - np.einsum("mtf,mtk->fk", x, odds)) / m - ridge * w / 10, (seen_moves - moved) / m - ridge * moves / 10)
        for i, (value, slope) in enumerate(zip((w, moves), slopes)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * slope
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * slope**2
            value += 0.1 * (state[2 * i] / (1 - 0.9**turn)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**turn)) + 1e-8)
    return Field(w, moves + ban)


def made_up_lines(seed: int = 11, n: int = 300) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines by rule, with the ranges of their secrets; about a third have none."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits
    word = lambda: pick(letters, rng.randint(1, 12)) + rng.choice(["", "", "", ".", ","])
    out = []
    for _ in range(n):
        before, after = [word() for _ in range(rng.randint(0, 9))], [word() for _ in range(rng.randint(0, 9))]
        secret = rng.choice([pick(mixed, rng.randint(16, 44)), pick(digits + "abcdef", rng.randint(32, 64)), "AKIA" + pick(letters.upper() + digits, 16), pick(mixed + "+/", rng.randint(20, 40)) + "="])
        head = rng.choice([["password", "="], ["secret:"], ["token", "="], ["api_key="], ["Authorization:", "Bearer"], ["client", "secret", "is"], ["private", "key:"], []])
        shape = rng.random()
        if shape < 0.65:
            quote = rng.choice(["", '"'])
            text = " ".join([*before, *head, ""]) + quote
            out.append((f"{text}{secret}{quote} " + " ".join(after), [(len(text), len(text) + len(secret))]))
        else:  # like a secret's surroundings, or long and odd, but none
            odd = rng.choice([pick(letters, rng.randint(14, 30)), pick(digits, rng.randint(4, 16)), f"{pick(letters, 8)}.{pick(digits, 2)}@mail.example.com", ".".join(pick(digits, 3) for _ in range(4)), rng.choice(["token", "password", "secret"]) + rng.choice(["", ".", "s"])])
            out.append((" ".join([*before, odd, *after]), []))
    return out


def tagged(tokens: Tokens, secrets: list[list[tuple[int, int]]], begins: np.ndarray) -> np.ndarray:
    """Tags of tokens that overlap byte ranges given for each text."""
    tags = np.zeros(len(tokens.start), np.int8)
    for number, ranges in enumerate(secrets):
        for a, b in ranges:
            hit = np.flatnonzero((tokens.end > begins[number] + a) & (tokens.start < begins[number] + b))
            tags[hit] = INSIDE
            tags[hit[:1]] = BEGIN
    return tags


def training_lines(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and tags of a bounded choice of lines: made up ones, and those of ``texts`` with the patterns' labels."""
    made = made_up_lines()
    out = []
    for source, ranges in (([t for t, _ in made], [r for _, r in made]), (texts, [[(m[3], m[1]) for m in fixed_matches(t)] for t in texts])):
        coded = [t.encode() for t in source]
        ranges = [[(len(t[:a].encode()), len(t[:b].encode())) for a, b in r] for t, r in zip(source, ranges)]
        tokens = tokenize(coded)
        sizes = np.array([len(t) + 1 for t in coded], int)
        tags = tagged(tokens, ranges, np.cumsum(sizes) - sizes)
        if not len(tags):
            continue
        heads = np.flatnonzero(np.concatenate([[True], tokens.line[1:] != tokens.line[:-1]]))
        ends = np.concatenate([heads[1:], [len(tags)]])
        with_secret = np.add.reduceat(tags > 0, heads) > 0
        kinds = (np.flatnonzero(with_secret), np.flatnonzero(~with_secret))
        for lines in kinds:
            step = max(1, len(lines) // SAMPLE_LINES)
            for i in lines[::step][:SAMPLE_LINES]:
                a, b = heads[i], ends[i]
                middle = a + int(tags[a:b].argmax())  # the first secret, or the line's beginning
                a, b = max(a, middle - SAMPLE_TOKENS), min(b, middle + SAMPLE_TOKENS)
                out.append((tokens.rows[a:b], tags[a:b]))
    return out


def fit(docs: DataFrame) -> Field:
    """The field, trained on the made-up lines and the bounded sample of ``docs``."""
    rows = docs.count()
    if not rows:
        return train(training_lines([]))
    # a share of the hashes, not a top-n: only the sample itself reaches the driver
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 2)
    sample = docs.select(mark.alias("mark"), F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    sample = sample.where(F.col("mark") < int(min(1.0, SAMPLE_DOCS / rows) * (1 << 62)))
    drawn = sample.limit(2 * SAMPLE_DOCS).collect()  # reached only if one row is repeated very often
    return train(training_lines([r["text"] for r in sorted(drawn, key=lambda r: (r["mark"], r["text"]))]))


def outside(text: str, a: int, b: int, matches: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """The parts of ``a`` to ``b`` that no match covers, without the marks that join them to one."""
    parts, at = [], a
    for x, y, _, _ in matches:
        if y > at and x < b:
            parts.append((at, x))
            at = y
    if at == a:
        return [(a, b)]
    out = []
    for x, y in [*parts, (at, b)]:
        found = text[x:y]
        x, y = x + len(found) - len(found.lstrip(JOINTS + "=")), y - (len(found) - len(found.rstrip(JOINTS)))
        if x < y and any(c.isalnum() for c in text[x:y]):
            out.append((x, y))
    return out


def scan_texts(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """``start, end, kind`` of all secrets of each text, in code points: the patterns' and the field's."""
    base = [fixed_matches(t) for t in texts]
    coded = [t.encode() for t in texts]
    tokens = tokenize(coded)
    tags = field.decode(tokens)
    out = [[(a, b, k) for a, b, k, _ in m] for m in base]
    sizes = np.array([len(t) + 1 for t in coded], int)
    begins = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(tags == BEGIN):
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE and tokens.line[j] == tokens.line[i]:
            j += 1
        number = int(tokens.text[i])
        a, b = int(tokens.start[i] - begins[number]), int(tokens.end[j - 1] - begins[number])
        found = coded[number][a:b]
        a, b = a + len(found) - len(found.lstrip(b"\"'`([{<")), b - (len(found) - len(found.rstrip(b"\"'`)]}>.,;:!?")))
        if b <= a:
            continue
        a = len(coded[number][:a].decode(errors="ignore"))
        b = a + len(coded[number][len(texts[number][:a].encode()) : b].decode(errors="ignore"))
        out[number] += [(x, y, "crf") for x, y in outside(texts[number], a, b, base[number])]
    order = [*KINDS, "crf"]
    return [sorted(x, key=lambda s: (s[0], order.index(s[2]))) for x in out]


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, secrets`` with an array of ``kind, start, end`` for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    secret = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = scan_texts([t or "" for t in part.column(1).to_pylist()], shared.value)
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, secret)], ["doc_id", "secrets"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, secrets array<struct<kind: string, start: long, end: long>>")
