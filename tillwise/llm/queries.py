"""Queries of the training-data operators, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, contamination, jaccard, lexical, line_runs, merkle, packing, quality, secret_scan, shards, suffix_dedup, url_filter, warc,
)

#: Rules of the URL query: host, beginning of the path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: slots move between shards until their sizes are near equal."""
    rows = shards.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), kept=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination.judged(hits).drop("text_key", "spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(named(F.filter("secrets", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        named(F.col("secrets")).alias("spans"),
    )


def tokenizer_path() -> str:
    """The public byte-level BPE file; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and sum both up: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = tokenizer_path()
    decoded = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.line_verdicts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(archives, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version for every document; those whose id's checksum 5 divides have their text lower-cased."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.versions(table(spark, sf_dir, "documents"), changed, F.translate("text", UPPER, LOWER))
    return found.drop("new_leaf", "copied")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_packing": op13_packing,
}

_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({{{c}}}::varchar) || ':' || {{{c}}}::varchar, '-')" for c in merkle.COLUMNS) + ")"
_OLD_LEAF = _LEAF.format(**{c: c for c in merkle.COLUMNS})
_NEW_LEAF = _LEAF.format(**{c: _LOWERED if c == "text" else c for c in merkle.COLUMNS})
#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"""
_NEXT_LEVEL = """SELECT grp, l + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(total) + 15) // 16
  FROM {0} WHERE total > 1 GROUP BY grp, l, pos // 16"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op2_url_filters": f"""
WITH rules(r_host, r_path, verdict) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
bare AS (SELECT page_id, regexp_extract(r, '^[^?#]*', 0) AS b FROM rest),
parts AS (SELECT page_id, regexp_extract(b, '^[^/]*', 0) AS raw, b FROM bare),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            substr(b, length(raw) + 1) AS path FROM parts)
SELECT page_id, host, path,
  (SELECT arg_max(r_host || r_path, length(r_host || r_path)) FROM rules
    WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
  coalesce((SELECT arg_max(verdict, length(r_host || r_path)) FROM rules
    WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
FROM split
""",
    "op9_line_dedup": """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS dropped
           FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op11_merkle": f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, {_OLD_LEAF} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_NEW_LEAF} END AS new_leaf FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM base
), lv AS (
  SELECT grp, 0 AS l, pos, leaf AS digest, total FROM placed UNION ALL {_NEXT_LEVEL.format("lv")}
), sub AS (SELECT grp, l AS height, digest FROM lv WHERE total = 1)
, tv AS (
  SELECT 'all' AS grp, 0 AS l, row_number() OVER (ORDER BY grp) - 1 AS pos, digest, count(*) OVER () AS total FROM sub
  UNION ALL {_NEXT_LEVEL.format("tv")}
), top AS (SELECT digest FROM tv WHERE total = 1)
, runs AS (SELECT grp, l, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM lv WHERE total > 1 GROUP BY ALL)
, top_runs AS (SELECT l, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM tv WHERE total > 1 GROUP BY ALL)
, steps AS (
  SELECT doc_id, l AS s, (pos // (16 ** l)::bigint % 16)::bigint AS slot, ds FROM placed JOIN runs USING (grp) WHERE run = pos // (16 ** (l + 1))::bigint
  UNION ALL
  SELECT doc_id, height + l, (k // (16 ** l)::bigint % 16)::bigint, ds
  FROM base JOIN (SELECT grp, height, row_number() OVER (ORDER BY grp) - 1 AS k FROM sub) USING (grp) JOIN top_runs ON run = k // (16 ** (l + 1))::bigint
), fold AS (
  SELECT doc_id, 0 AS s, coalesce(new_leaf, leaf) AS digest FROM base
  UNION ALL
  SELECT f.doc_id, f.s + 1, sha256(array_to_string(ds[1:slot], '') || f.digest || array_to_string(ds[slot + 2:], ''))
  FROM fold f JOIN steps p ON f.doc_id = p.doc_id AND f.s = p.s
), ends AS (SELECT doc_id, arg_max(digest, s) AS folded_root FROM fold GROUP BY 1)
, proofs AS (SELECT doc_id, sha256(string_agg(array_to_string(ds[1:slot], '') || array_to_string(ds[slot + 2:], ''), '' ORDER BY s)) AS p FROM steps GROUP BY 1)
SELECT b.doc_id, b.leaf, sub.digest AS subroot, top.digest AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = top.digest AS verified
FROM base b JOIN sub USING (grp) CROSS JOIN top JOIN ends ON ends.doc_id = b.doc_id LEFT JOIN proofs ON proofs.doc_id = b.doc_id
""",
    "op12_lexical": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS w FROM documents WHERE text IS NOT NULL)
, s AS (SELECT count(*) AS n_docs, sum(len(w))::bigint AS n_terms FROM d WHERE len(w) > 0)
, q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL)
, tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL)
, wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, s GROUP BY term, n_docs)
, sc AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) CROSS JOIN s GROUP BY ALL
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank::integer AS rank, doc_id, score FROM r WHERE rank <= 20
""",
}
