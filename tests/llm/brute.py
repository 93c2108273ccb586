"""Plain versions of the query contracts, row by row and without Spark."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def first(rows):
    """Rows by id, nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def suffix_dedup(rows):
    seen, out = set(), []
    for doc, text in first(rows):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(piece)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((doc, len(data), sum(hit), spans, sha(bytes(c for c, h in zip(data, hit) if not h))))
    return out


def shingles(text, size):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size, percent):
    """Position of each row's component, named by the position of its least id."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def jaccard(rows, size=3, percent=90):
    sizes, roots = components(rows, size, percent)
    return [(r[0], n, rows[k][0]) for r, n, k in zip(rows, sizes, roots)]


def decontamination(rows, items):
    windows = defaultdict(set)
    for name, text in items:
        words = NORMAL.findall(lower(text or ""))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words = NORMAL.findall(lower(text or ""))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        listed = sorted(str(x) for x in names if x is not None)
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out.append((doc, len(words), len(hit), len(listed), sha(",".join(listed)), bad))
    return out


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def line_dedup(rows):
    """``doc_id, lines, dropped, kept text``."""
    holders = defaultdict(set)
    split = [((d is not None, d or 0), (t or "").split("\n")) for d, t in rows]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for doc, lines in split:
        for line in lines:
            holders[key(line)].add(doc)
    out = []
    for (doc, _), (own, lines) in zip(rows, split):
        left = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == own]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def warc(rows):
    """``rows`` of page_id, html with distinct ids."""
    owner = defaultdict(int)
    for page, html in rows:
        owner[html or ""] = max(owner[html or ""], page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        mine = owner[html or ""] == page
        out.append((page, len(data), digest, "response" if mine else "revisit", None if mine else owner[html or ""]))
    return out


def fixed_secrets(text):
    text = text or ""
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))))


def leaf(row):
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    return sha("".join(parts))


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, place):
    """Place in the run and the run of every level below the last."""
    for level in levels[:-1]:
        yield place % 16, level[place // 16 * 16 : place // 16 * 16 + 16]
        place //= 16


def merkle(rows):
    """Rows ``doc_id, source, lang, n_chars, text`` in, the contract's rows out."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    top = tree_levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for place, (_, _, mine, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = [*siblings(trees[s], place), *siblings(top, k)]
            node = mine
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf((*row[:4], None if row[4] is None else lower(row[4])))
            for at, run in steps:
                node = sha("".join((*run[:at], node, *run[at + 1 :])))
            proof = sha("".join(x for at, run in steps for i, x in enumerate(run) if i != at))
            out.append((row[0], mine, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs, items, top=20):
    found = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    many, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lower(text or "")))
        ranked = []
        for doc, c in found:
            m = 100 - 25 + 25 * sum(c.values()) * many // length
            score = sum(
                k * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in asked.items()
                if t in c
            )
            if score > 0:
                ranked.append((-score, doc is not None, doc or 0))
        ranked.sort()
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(ranked[:top])]
    return out
