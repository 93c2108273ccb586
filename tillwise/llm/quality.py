"""Quality rules, line first.

Every line is judged by itself: punctuation, navigation and boilerplate rules. Failing lines are
removed (a long line without a sentence end only if the lines after it do not end its sentence), and
a document that loses too large a share of its characters with them is rejected, as is
one that fails the base rules (too few words, too much repetition).

Defined cases: a null text has no words and is rejected; lines without a word are kept and never
judged; repeated rows are judged alike, row by row; an empty table gives an empty result. The other
columns of the input are carried along untouched, whatever their names. No shuffle takes place, and
a task holds a bounded slice of its rows at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import BLANKS, ship, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Words that only separate the entries of a menu.
SEPARATOR = re.compile(rb"[|/>-]+|(?:\xc2\xb7|\xe2\x80\xa2|\xe2\x80\xba|\xc2\xbb)+")
ANY_SEPARATOR = re.compile(r"(?:^|[\x20\x09-\x0D])[|/>·•›»-]+(?:[\x20\x09-\x0D]|\Z)")
#: Unicode's terminal punctuation of all scripts without its commas, and the ellipsis.
ENDS = (
    r"!.:;?\u037E\u0387\u0589\u05C3\u061B\u061D-\u061F\u06D4\u0700-\u070A\u070C\u07F9\u0830-\u0835\u0837-\u083E"
    r"\u085E\u0964\u0965\u0E5A\u0E5B\u0F08\u0F0D-\u0F12\u104A\u104B\u1361\u1362\u1364-\u1368\u166E\u16EB-\u16ED"
    r"\u1735\u1736\u17D4-\u17D6\u17DA\u1803-\u1805\u1809\u1944\u1945\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5D-\u1B5F"
    r"\u1B7D\u1B7E\u1C3B-\u1C3F\u1C7E\u1C7F\u2024\u2026\u203C\u203D\u2047-\u2049\u2CF9-\u2CFB\u2E2E\u2E3C"
    r"\u2E4E\u2E4F\u2E53\u2E54\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F4\uA6F6\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F"
    r"\uA9C7-\uA9C9\uAA5D-\uAA5F\uAADF\uAAF0\uAAF1\uABEB\uFE12\uFE15\uFE16\uFE52\uFE54-\uFE57\uFF01\uFF0E"
    r"\uFF1A\uFF1B\uFF1F\uFF61\U0001039F\U000103D0\U00010857\U0001091F\U00010A56\U00010A57\U00010AF0-\U00010AF5"
    r"\U00010B3A-\U00010B3F\U00010B99-\U00010B9C\U00010F55-\U00010F59\U00010F86-\U00010F89\U00011047-\U0001104D"
    r"\U000110BE-\U000110C1\U00011141-\U00011143\U000111C5\U000111C6\U000111CD\U000111DE\U000111DF"
    r"\U00011238-\U0001123C\U000112A9\U0001144B\U0001144C\U0001145B\U000115C2-\U000115C5\U000115C9-\U000115D7"
    r"\U00011641\U00011642\U0001173C-\U0001173E\U00011944\U00011946\U00011A42\U00011A43\U00011A9B\U00011A9C"
    r"\U00011AA1\U00011AA2\U00011C41-\U00011C43\U00011C71\U00011EF7\U00011EF8\U00011F43\U00011F44"
    r"\U00012470-\U00012474\U00016A6E\U00016A6F\U00016AF5\U00016B37-\U00016B39\U00016B44\U00016E98\U0001BC9F"
    r"\U0001DA88-\U0001DA8A"
)
#: A word that ends a sentence, perhaps inside closing quotes or brackets.
SENTENCE_END = re.compile(rf"[{ENDS}][\"')\]»’”]*(?:[\x20\x09-\x0D]|\Z)")
SHOUT = re.compile(rb"[!?]{2,}\Z")
ANY_SHOUT = re.compile(r"[!?]{2}")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings",
    "accept cookies", "accept all cookies", "enable javascript", "subscribe to our", "sign up for our", "click here to",
    "share on facebook", "share on twitter", "log in to post", "log in to comment", "skip to content",
    "skip to main content", "back to top",
)
#: What may stand before the first letter of a line that goes on with a sentence.
OPENING = " \t\x0b\x0c\r\"'([«„“‘"
#: A line of fewer words is a heading or a list entry and needs no sentence end.
MIN_SENTENCE_WORDS = 12
#: A document of fewer words is rejected.
MIN_WORDS = 50
#: A document is rejected when it loses more than this share of its word characters.
MAX_LOST = 0.3


def going_on(lines: list[str]) -> list[bool]:
    """Whether the lines after each one go on with its sentence and end it.

    A line that goes on begins, perhaps in quotes or brackets, with a letter that is not a capital.
    """
    out = [False] * len(lines)
    for i in range(len(lines) - 2, -1, -1):
        first = lines[i + 1].lstrip(OPENING)[:1]
        if first.isalpha() and not first.isupper() and not first.istitle():
            out[i] = out[i + 1] or SENTENCE_END.search(lines[i + 1]) is not None
    return out


def line_fault(line: str, goes_on: bool = False) -> str | None:
    """The rule that a line fails, or None; ``goes_on``: the next lines end its sentence."""
    words = line.encode().split()
    n = len(words)
    if n == 0:
        return None
    if n >= 4 and 5 * sum(SEPARATOR.fullmatch(w) is not None for w in words) >= n:
        return "navigation"
    n_symbols = sum(map(line.count, SYMBOLS))
    if n_symbols >= 3 and 10 * n_symbols >= word_chars(line):
        return "symbols"
    if n >= 3 and 2 * sum(SHOUT.search(w) is not None for w in words) >= n:
        return "punctuation"
    if n >= MIN_SENTENCE_WORDS and not goes_on and SENTENCE_END.search(line) is None:
        return "punctuation"
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    return None


def suspects(text: str, n_symbols: int) -> bool:
    """Whether a line of ``text`` can fail a rule; one look at the whole text spares most lines theirs."""
    low = text.lower()
    return bool(
        n_symbols
        or ANY_SEPARATOR.search(text)
        or ANY_SHOUT.search(text)
        or any(phrase in low for phrase in BOILERPLATE)
    )


def word_chars(text: str) -> int:
    """Code points that are in words."""
    return len(text) - sum(map(text.count, BLANKS))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) < 1 << 21:
        windows = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:  # number the pairs first, so that two numbers always fit
        pairs = np.unique((w[:-1] << 32) | w[1:], return_inverse=True)[1]
        windows = (pairs[:-1] << 32) | w[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def judge(text: str | None, max_lost: float = MAX_LOST) -> dict:
    """Base figures of a text, its lines' verdict and what is left of it."""
    text = text or ""
    words = text.encode().split()
    chars = word_chars(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    repeated = 0
    if len(set(lines)) < len(lines):
        repeated = sum(c - 1 for line, c in Counter(lines).items() if c > 1 and WORD.search(line))
    repeats = repeat_words(words)
    goes_on = going_on(lines)
    if suspects(text, n_symbols):
        left = [line for line, on in zip(lines, goes_on) if line_fault(line, on) is None]
    else:
        left = [
            line
            for line, on in zip(lines, goes_on)
            if on or SENTENCE_END.search(line) is not None or len(line.encode().split()) < MIN_SENTENCE_WORDS
        ]
    lost = chars - sum(map(word_chars, left)) if len(left) < len(lines) else 0
    failed = len(words) < MIN_WORDS or 100 * repeats > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": n_symbols,
        "n_dup_lines": repeated,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and lost <= max_lost * chars,
        "n_bad_lines": len(lines) - len(left),
        "lost_chars": lost,
        "cleaned": "\n".join(left) if len(left) < len(lines) else text,
    }


_FIGURES = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_bad_lines", pa.int64()),
    ("lost_chars", pa.int64()),
]


def quality_report(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per document: base figures, lines that failed, characters lost, verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = [judge(t, max_lost) for t in part.column(1).to_pylist()]
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in _FIGURES]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(n for n, _ in _FIGURES)])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_chars long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that pass, without their failing lines; all columns kept.

    ``n_chars``, where the table has it, is brought in line with the text that is left.
    """
    names = docs.columns
    at = names.index("text")
    count_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            rows = [judge(t, max_lost) for t in part.column(at).to_pylist()]
            columns = list(part.columns)
            columns[at] = pa.array([r["cleaned"] for r in rows], part.schema.field(at).type)
            if count_at is not None:
                changed = pa.array([r["n_bad_lines"] > 0 for r in rows])
                counts = pa.array([len(r["cleaned"]) for r in rows]).cast(part.schema.field(count_at).type)
                columns[count_at] = pc.if_else(changed, counts, columns[count_at])
            out = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield out.filter(pa.array([r["kept"] for r in rows], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
