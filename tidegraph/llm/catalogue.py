"""The queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, lines, manifest, media, neardup, packing, quality, secrets, sharding, simhash, tokens, whitening


def vocabulary_path() -> str:
    """The public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), vocabulary_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_documents(spark, sf_dir), vocabulary_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_documents(spark, sf_dir))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir), vocabulary_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_report(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_line_dedup, op3_language, op4_media, op5_secrets, op6_packing, op7_sharding, op8_neardup, op9_quality, op10_token_counts, op11_whitening, op12_simhash, op13_manifest)
}

def _manifest_sql(levels: int = 8, group_levels: int = 4) -> str:
    """SQL of ``op13_manifest`` for at most 8 ** levels rows of a language and 8 ** group_levels languages."""
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f})) || ':' || {f} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"
    # CRC-32 bit by bit: eight steps for each byte of the decimal id
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda state, byte: list_reduce(list_prepend(xor(state, byte), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda c, i: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))), 4294967295::UBIGINT) % 3 = 0"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"rows AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} THEN {leaf(lower)} ELSE {leaf('text')} END AS forged FROM documents)"]

    def tower(name: str, first: str, count: int) -> None:
        """Nodes ``g, idx, node, n`` of each level: a single node of a group stays as it is."""
        parts.append(f"{name}0 AS MATERIALIZED ({first})")
        for k in range(count):
            node = "CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END"
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, idx // 8 AS idx, {node} AS node, any_value((n + 7) // 8) AS n FROM {name}{k} GROUP BY g, idx // 8)")

    def climb(name: str, start: str, count: int) -> str:
        """``id, g, proof, fold`` after the levels of a tower."""
        for k in range(count):
            side = lambda op: f"coalesce(string_agg(o.node, '' ORDER BY o.idx) FILTER (WHERE o.idx {op} s.idx), '')"
            parts.append(f"""{name}_climb{k} AS MATERIALIZED (
  SELECT s.id, s.g, s.idx // 8 AS idx, any_value(s.proof) || {side('<>')} AS proof,
    CASE WHEN any_value(o.n) = 1 THEN any_value(s.fold) ELSE sha256({side('<')} || any_value(s.fold) || {side('>')}) END AS fold
  FROM {start} s JOIN {name}{k} o ON s.g IS NOT DISTINCT FROM o.g AND s.idx // 8 = o.idx // 8 GROUP BY s.id, s.g, s.idx)""")
            start = f"{name}_climb{k}"
        return start

    parts.append("placed AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM rows)")
    tower("leaf", "SELECT lang AS g, idx, leaf AS node, n FROM placed", levels)
    parts.append(f"subroots AS MATERIALIZED (SELECT g, node, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM leaf{levels})")
    tower("group", "SELECT 0 AS g, idx, node, n FROM subroots", group_levels)
    parts.append("start AS (SELECT id, lang AS g, idx, '' AS proof, forged AS fold FROM placed)")
    done = climb("leaf", "start", levels)
    parts.append(f"over AS (SELECT d.id, 0 AS g, s.idx, d.proof, d.fold FROM {done} d JOIN subroots s ON d.g IS NOT DISTINCT FROM s.g)")
    done = climb("group", "over", group_levels)
    return f"""WITH {", ".join(parts)}
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = r.node AS verified
FROM placed p JOIN {done} d USING (id) JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.g, group{group_levels} r"""


_WHITE = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WHITE}+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b, k = x.n AND k = y.n AS equal FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
), parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
), classes AS (SELECT a AS doc_id, min(b) AS least_equal FROM links WHERE equal GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept, least(d.doc_id, coalesce(least_equal, d.doc_id)) AS class_id
FROM documents d JOIN parts USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN classes USING (doc_id)
""",
    "op9_quality": f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_WHITE}+'), lambda x: x <> '') AS ws FROM documents
), words AS (SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE n > 1) GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_word_lines
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 8 * (4 * n_symbols > n_words)::INT + 16 * (2 * n_dup_lines > n_word_lines)::INT)::INT AS failed FROM m
)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
""",
    "op13_manifest": _manifest_sql(),
}
