"""BPE encoding by tree concatenation, and decoding.

A text is halved until its leaves are short; leaves are encoded on their own and joined pairwise up the
tree. The upper levels of a long text's tree are Spark's: its halves, halved until they have at most
``PART`` characters, are rows of a written table, dealt to tasks that encode them in parallel, each by
the lower levels of the tree; then they come together, one row of ids a part, and are joined. Shorter
texts are encoded within the task that reads them. Around each join a window is encoded again and
grows until both sides agree with it exactly:

* Window ends are places where every scan of the word pattern has a border whatever stands before
  (a change of character class, such as from a letter to a blank). The pattern looks at nothing
  before a match, so left of the first place the left half is right, and right of the second one the
  right half is.
* In a run of one character class, which the pattern never splits, window ends are token borders of
  the halves, and the window must begin with the left half's token there and end with the right
  half's. Then every two neighbouring tokens have been encoded together, which for BPE makes the
  whole sequence the encoding of the run.
* A window that has grown over both halves is their encoding.

Special tokens in a text are cut out first, as the library does. The tokenizer must be a byte-level
BPE with the standard pattern, no normalizer, plain special tokens and ids in the order of merges;
another one is refused. Leaves and windows are encoded by ``tiktoken`` from the same vocabulary, which
gives the same ids several times faster; the tests compare the two over all code points. Decoding is
the library's own.

Defined cases: a null or empty text has no tokens and decodes to the empty text; a null list of ids
decodes to null; repeated rows and ids are encoded row by row; an empty table gives an empty result.
Only the id and the text (or ids) are read. Only long texts are shuffled; a task holds a few megabytes
of text, and where parts are joined one text and its ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship, slices

#: Fixed value: the word pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf.
LEAF = 2048
#: Characters of a text that one task encodes; halves of longer ones are encoded in parallel.
PART = 1 << 16
#: First radius of the window around a join.
RADIUS = 32


def byte_places() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


Ids = list[int] | array


def like(ids: Ids, window: list[int]) -> Ids:
    """The window's ids in the form of those they go between."""
    return window if isinstance(ids, list) else array("i", window)


def halves(a: int, b: int, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` that halving gives, from left to right."""
    if b - a <= size:
        return [(a, b)]
    m = (a + b) // 2
    return halves(a, m, size) + halves(m, b, size)


class TreeEncoder:
    """Encodes texts as ``tokenizers`` does with ``add_special_tokens=False``."""

    def __init__(self, path: str, leaf: int = LEAF, radius: int = RADIUS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the cores to its tasks
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        specials = spec["added_tokens"] or []
        if not plain or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("the tokenizer must be a byte-level BPE with the standard pattern and no normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in specials):
            raise ValueError("special tokens that take in their surroundings are not supported")
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids of the tokenizer must follow the order of its merges")
        self.tokenizer = Tokenizer.from_file(path)
        places = byte_places()
        ranks = {bytes(places[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
        self._plain = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = {t["content"]: t["id"] for t in specials}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cutter = re.compile(f"({'|'.join(names)})") if names else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = [len(self.tokenizer.id_to_token(i) or "") for i in range(size)]  # a byte is a character there
        self.leaf, self.radius = leaf, radius

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        pieces: list[str] = []
        plans: list[list] = []
        for text in texts:
            parts = self.cutter.split(text) if text and self.cutter else [text or ""]
            plan: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(self.special[part])
                elif part:
                    leaves = halves(0, len(part), self.leaf)
                    plan.append((part, leaves, len(pieces)))
                    pieces += [part[a:b] for a, b in leaves]
            plans.append(plan)
        coded = [self._plain(p) for p in pieces]
        out = []
        for plan in plans:
            ids: list[int] = []
            for part in plan:
                if isinstance(part, int):
                    ids.append(part)
                else:
                    text, leaves, at = part
                    ids += self._joined(text, [(a, b, coded[at + i]) for i, (a, b) in enumerate(leaves)])
            out.append(ids)
        return out

    def parts(self, text: str, size: int) -> list[tuple[int, str]]:
        """Number of the unit, and text, of each part. Units begin and end at special tokens or the text's ends: one is a plain
        stretch of more than ``size`` characters, cut into halves of halves, or what lies between two such stretches."""
        out: list[tuple[int, str]] = []
        held: list[str] = []
        count = unit = 0
        for piece in self.cutter.split(text) if self.cutter else [text]:
            if held and count + len(piece) > size:
                out.append((unit, "".join(held)))
                held, count, unit = [], 0, unit + 1
            if len(piece) > size:
                out += [(unit, piece[a:b]) for a, b in halves(0, len(piece), size)]
                unit += 1
            else:
                held.append(piece)
                count += len(piece)
        return [*out, (unit, "".join(held))] if held else out

    def join_parts(self, pieces: list[str], coded: list[array]) -> array:
        """Ids of a unit from those of its parts."""
        ends = np.cumsum([0, *map(len, pieces)]).tolist()
        return self._joined("".join(pieces), list(zip(ends, ends[1:], coded)))

    def _joined(self, text: str, nodes: list[tuple[int, int, Ids]]) -> Ids:
        """Ids of ``text`` from its leaves, joined as the halving parted them."""
        if len(nodes) == 1:
            return nodes[0][2]
        a, b = nodes[0][0], nodes[-1][1]
        cut = next(i for i, node in enumerate(nodes) if node[0] == (a + b) // 2)
        return self._join(text, a, (a + b) // 2, b, self._joined(text, nodes[:cut]), self._joined(text, nodes[cut:]))

    def _join(self, text: str, a: int, m: int, b: int, left: Ids, right: Ids) -> Ids:
        radius = self.radius
        while True:
            low, high = max(a, m - radius), min(b, m + radius)
            l = a if low == a else next((p for p in range(m - 1, low, -1) if border(text, p)), None)  # noqa: E741
            r = b if high == b else next((p for p in range(m + 1, high) if border(text, p)), None)
            if l is not None and r is not None:
                i, j = self._back(left, text[l:m]), self._forth(right, text[m:r])
                if i is not None and j is not None:
                    return left[:i] + like(left, self._plain(text[l:r])) + right[j:]
            elif low > a and high < b and one_run(text[low - 1 : high + 2]):
                done = self._inside(text, low, m, high, left, right)
                if done is not None:
                    return done
            if low == a and high == b:
                return like(left, self._plain(text[a:b]))
            radius *= 2

    def _back(self, ids: Ids, tail: str) -> int | None:
        """Number of tokens before ``tail``, the text's end, or None if it begins inside a token."""
        rest, i = len(tail.encode()), len(ids)
        while rest > 0:
            i -= 1
            rest -= self.width[ids[i]]
        return i if rest == 0 else None

    def _forth(self, ids: Ids, head: str) -> int | None:
        rest, j = len(head.encode()), 0
        while rest > 0:
            rest -= self.width[ids[j]]
            j += 1
        return j if rest == 0 else None

    def _inside(self, text: str, low: int, m: int, high: int, left: Ids, right: Ids) -> Ids | None:
        """Join inside a run: the window must agree with a token at either end."""
        for l in range(low, min(low + 32, m)):  # noqa: E741
            i = self._back(left, text[l:m])
            if i is not None:
                break
        else:
            return None
        for r in range(high, max(high - 32, m), -1):
            j = self._forth(right, text[m:r])
            if j is not None:
                break
        else:
            return None
        window = self._plain(text[l:r])
        if i < len(left) and j > 0 and window[0] == left[i] and window[-1] == right[j - 1]:
            return left[:i] + like(left, window) + right[j:]
        return None


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """Class of a character in the word pattern; "?" where library versions might differ.

    Letters, numbers and other marks count by their Unicode category, if it has been the same kind since
    Unicode 3.2, which every library's tables contain.
    """
    if c in " \t\n\r":
        return "S"
    if c == "'":
        return "'"
    if ord(c) < 0x250 and c.isalpha():
        return "L"
    old, now = unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]
    if old != now or now in "CZ":
        return "?"
    return now if now in "LN" else "P"


def border(text: str, p: int) -> bool:
    """Whether every scan has a border at ``p``: no alternative of the pattern reaches over it."""
    before, after = kind(text[p - 1]), kind(text[p])
    if "?" in (before, after) or before == after:
        return False
    if before in "LN":
        return True
    if before == "P":
        return after in "LNS"
    return before == "'" and after in "NS"


def one_run(text: str) -> bool:
    """Whether the text is of one class, so that the pattern has no border in it."""
    kinds = {kind(c) for c in text}
    return len(kinds) == 1 and kinds <= {"L", "N", "P", "S"}


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int) -> TreeEncoder:
    return TreeEncoder(path, leaf)


def _lists(ids: list[Ids]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """``doc_id, ids`` of each document; ``path`` is the tokenizer file, present on every machine."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, leaf)
        for some in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([some.column(0), _lists(coder.encode(some.column(1).to_pylist()))], ["doc_id", "ids"])

    ship(docs.sparkSession)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > part, F.lit(False))
    coded = rows.where(~is_long).mapInArrow(whole, f"doc_id {id_kind}, ids array<int>")
    cut = materialize(text_parts(rows.where(is_long), path, leaf, part), "text-parts")
    return coded if cut.isEmpty() else coded.union(joined_parts(cut, path, leaf))


def text_parts(docs: DataFrame, path: str, leaf: int, part: int) -> DataFrame:
    """``row, doc_id, unit, part, piece``: the parts of each text in order; ``row`` tells rows apart and holds once it is written."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, leaf)
        for one in slices(batches, 2, 1):  # a text at a time
            for row in range(one.num_rows):
                pieces = coder.parts(one.column(2)[row].as_py(), part)
                at = pa.array([row] * len(pieces), pa.int32())
                columns = [pa.array([u for u, _ in pieces], pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array([p for _, p in pieces], pa.string())]
                yield pa.RecordBatch.from_arrays([one.column(0).take(at), one.column(1).take(at), *columns], ["row", "doc_id", "unit", "part", "piece"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row long, doc_id {id_kind}, unit int, part int, piece string")


def joined_parts(cut: DataFrame, path: str, leaf: int) -> DataFrame:
    """``doc_id, ids``: parts encoded in parallel, wherever their text came from, then joined for each text."""
    id_kind = cut.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, leaf)
        for some in slices(batches, 4):
            yield pa.RecordBatch.from_arrays([*some.columns, _lists(coder.encode(some.column(4).to_pylist()))], ["row", "doc_id", "unit", "part", "piece", "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part").combine_chunks()
        units = table.column("unit").to_numpy()
        pieces = table.column("piece").to_pylist()
        coded = [array("i", x.values.to_numpy().tobytes()) for x in table.column("ids")]
        first = [*np.flatnonzero(np.diff(units, prepend=-1)).tolist(), len(units)]
        ids = array("i")
        for a, b in zip(first, first[1:]):
            ids += encoder(path, leaf).join_parts(pieces[a:b], coded[a:b])
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": _lists([ids])})

    ship(cut.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    coded = cut.repartition("row", "part").mapInArrow(encode, f"{kinds}, ids array<int>")
    return coded.groupBy("row").applyInArrow(join, f"doc_id {id_kind}, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: the ids' text, special tokens written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, LEAF).tokenizer
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                there = lists.is_valid().to_pylist()
                ids = [flat[a:b].tolist() if v else None for a, b, v in zip(ends, ends[1:], there)]
                texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
                decoded = [None if x is None else next(texts) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.string())], ["doc_id", "ids", "text"])

    ship(coded.sparkSession)
    id_kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_kind}, ids array<int>, text string")
