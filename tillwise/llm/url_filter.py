"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical URL expressions, a host and the beginning of a path; an entry fits its
host and all subdomains. A page's candidates are its host's suffixes with the beginnings of its path
that have a listed length. The filter is a table of 512-bit blocks: a candidate's hash names one
block and eight bits in it, one bit in each of the block's eight words. Candidates whose bits are
all set go on to an exact hash join with the list, which removes the false positives; the longest
entry wins. The filter has at most ``MAX_BLOCKS`` blocks, so it can be broadcast at any size of the
list: a longer list only lets more candidates through to the join, never changes a result.

Defined cases: a null URL, or one without ``://``, has an empty host and path and meets no entry;
entries with a null host or path are ignored; of entries listed twice, block wins over allow; rows
that repeat an id are judged one by one; empty tables give empty results or the default verdict.
Other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Blocks of the broadcast filter: 2**16 blocks of 64 bytes are 4 MB.
MAX_BLOCKS = 1 << 16
#: Entries a block is meant for: 16 entries of 8 bits set a quarter of its 512 bits.
ENTRIES_PER_BLOCK = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z in lower case) and path (up to ``? #``)."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(bare, r"(?s)^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(bare, F.length(host) + 1, F.length(bare))


def _bits(n_blocks: int, *key: str) -> tuple[Column, Column]:
    """Block number and the block's eight words that a key sets."""
    h1, h2 = F.xxhash64(*key), F.xxhash64(F.lit(1), *key)
    block = F.pmod(h1, F.lit(n_blocks))
    one = F.lit(1).cast("long")
    words = F.array(*[F.call_function("shiftleft", one, F.shiftright(h2, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)])
    return block, words


def blocked_bloom(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """Filter table ``block, w0 .. w7`` of the entries, and its number of blocks."""
    n_blocks = max(1, min(max_blocks, listed.count() // ENTRIES_PER_BLOCK + 1))
    block, words = _bits(n_blocks, "host", "path")
    rows = listed.select(block.alias("block"), words.alias("w"))
    return rows.groupBy("block").agg(*[F.bit_or(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(8)]), n_blocks


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def judge_urls(pages: DataFrame, entries: DataFrame, default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page.

    ``entries`` has ``host, path, verdict``. Pages meet the filter before any shuffle, and only
    possible hits take part in the join; the verdicts return to the pages by URL, each URL once.
    """
    listed = entries.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = materialize(listed.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"), "listed")
    bloom, n_blocks = blocked_bloom(listed, max_blocks)
    lengths = [r[0] for r in listed.select(F.length("path")).distinct().collect()]  # a URL's length bounds their number
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = judged.where("host <> ''").select("host", "path").distinct()
    begin = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path"))
    candidates = urls.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("c_host"), begin.alias("begin")).select(
        "host", "path", "c_host", F.explode("begin").alias("n")
    )
    candidates = candidates.select("host", "path", "c_host", F.expr("substring(path, 1, n)").alias("c_path"))
    block, words = _bits(n_blocks, "c_host", "c_path")
    probed = candidates.withColumns({"block": block, "w": words}).join(F.broadcast(bloom), "block")
    for i in range(8):
        word = F.get("w", F.lit(i))
        probed = probed.where(F.col(f"w{i}").bitwiseAND(word) == word)
    possible = probed.select("host", "path", "c_host", "c_path")
    exact = listed.select(F.col("host").alias("c_host"), F.col("path").alias("c_path"), "verdict")
    rule = F.concat("c_host", "c_path")
    best = possible.join(exact, ["c_host", "c_path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    return judged.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, entries: DataFrame, default: str = "allow") -> DataFrame:
    """The pages whose URL is allowed; all columns kept."""
    blocked = judge_urls(pages.select("page_id", "url"), entries, default).where("verdict = 'block'").select("host", "path").distinct()
    blocked = materialize(blocked, "blocked")
    host, path = host_and_path(pages["url"])
    return pages.join(blocked, (host == blocked["host"]) & (path == blocked["path"]), "left_anti")
