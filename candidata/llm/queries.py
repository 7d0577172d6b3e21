"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.llm import (
    collocations,
    decontamination,
    licenses,
    line_dedup,
    mixing,
    pii,
    quality_rules,
    sharding,
    simhash_index,
    token_counts,
    token_output,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, shared lines and the verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.BASE, "n_shared_lines", "n_shared_words", "kept"
    )


SQL["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), lines AS (
  SELECT * FROM (
    SELECT doc_id, source, text,
           trim(unnest(string_split(lower(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10))), ' ') AS line
    FROM d) WHERE line <> ''
), held AS (
  SELECT DISTINCT source, text, line, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM lines
), hashed AS (
  SELECT text, line, seed, substr(md5(line || '#' || seed), 1, 15) AS h
  FROM (SELECT DISTINCT text, line FROM held), (VALUES (1), (2), (3)) AS s(seed)
), firsts AS (
  SELECT text, seed, min(h) AS h, arg_min(line, h) AS line, list_sort(list(h))[2] AS next FROM hashed GROUP BY ALL
), limits AS (
  SELECT source, true AS of_host, line FROM held GROUP BY source, line HAVING count(*) >= 10
  UNION ALL SELECT NULL, false, line FROM held WHERE n >= 50 GROUP BY line HAVING count(DISTINCT text) >= 10
), kin AS (
  SELECT DISTINCT l.source, of_host, l.line, f.seed, h.text, CASE WHEN f.line = l.line THEN f.next ELSE f.h END AS kin
  FROM limits l JOIN held h ON l.line = h.line AND (NOT of_host OR l.source IS NOT DISTINCT FROM h.source)
  JOIN firsts f ON f.text = h.text
), spread AS (
  SELECT source, of_host, line, seed, sum(c) * sum(c) >= 10 * sum(c * c) AS wide FROM (
    SELECT source, of_host, line, seed, kin, count(*) AS c FROM kin GROUP BY ALL) GROUP BY source, of_host, line, seed
), shared AS (
  SELECT source, of_host, line FROM spread GROUP BY ALL HAVING count(*) FILTER (wide) >= 2
), removed AS (
  SELECT doc_id, count(*) AS n_lines, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n_words
  FROM lines l WHERE EXISTS (SELECT 1 FROM shared s WHERE s.line = l.line AND (NOT s.of_host OR l.source IS NOT DISTINCT FROM s.source))
  GROUP BY doc_id
), stats AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_shared_lines,
         CAST(coalesce(r.n_words, 0) AS BIGINT) AS n_shared_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_shared_words > 50 * n_words) AS kept
FROM stats
"""


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of every source, with suffix sums."""
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["source"])
    return token_counts.length_histogram(lengths, "source")


@query
def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written in Re-Pair blocks and read back."""
    path = fresh_path(spark, "token-blocks")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_output.read_tokens(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents")).drop("__text", "__root")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items."""
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=60
    ).drop("__text")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, own or inherited.

    Documents have no paths; here every fifth is its directory's licence file, and every
    twenty-fifth and hundred-and-twenty-fifth one of the directories above.
    """
    i = F.col("doc_id")
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    part = F.concat(F.lit("part"), F.pmod(F.floor(i / 5), F.lit(16)))
    path = (
        F.when(i % 125 == 0, F.concat_ws("/", source, F.lit("LICENSE")))
        .when(i % 25 == 0, F.concat_ws("/", source, lang, F.lit("LICENSE")))
        .when(i % 5 == 0, F.concat_ws("/", source, lang, part, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", source, lang, part, F.concat(i, F.lit(".txt"))))
    )
    docs = table(spark, sf_dir, "documents").withColumn("path", path)
    return licenses.scan(docs).select("doc_id", "path", *licenses.RESULTS)


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them a smaller document holds, and a digest of the rest."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op11_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), keys AS (
  SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2
)
SELECT l.doc_id, count(*) AS n_lines, count(k.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN keys k ON l.key = k.key AND l.doc_id IS DISTINCT FROM k.owner
GROUP BY r, l.doc_id
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words belong together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4), (5)) AS s(m)
), counts AS (
  SELECT lang, w[i:i + m - 1] AS gram, count(*) AS f FROM places GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE len(gram) = 1 GROUP BY lang
), phrases AS (
  SELECT lang, gram, f FROM counts WHERE f >= 100 AND len(gram) > 1
), cuts AS (
  SELECT lang, gram, f AS a, unnest(range(1, len(gram))) AS k FROM phrases
), scores AS (
  SELECT c.lang, c.gram, a, k, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN counts x ON c.lang = x.lang AND x.gram = c.gram[1:k]
  JOIN counts y ON c.lang = y.lang AND y.gram = c.gram[k + 1:]
), least AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS c FROM scores) WHERE c = 1
), parts AS (
  SELECT lang, gram[i:i + m - 1] AS gram, max(f) AS longer FROM (
    SELECT lang, gram, f, m, unnest(range(1, len(gram) - m + 2)) AS i
    FROM phrases, (VALUES (2), (3), (4)) AS s(m) WHERE m < len(gram)) GROUP BY ALL
), kept AS (
  SELECT s.*, array_to_string(s.gram, ' ') AS phrase FROM least s LEFT JOIN parts p ON s.lang = p.lang AND s.gram = p.gram
  WHERE p.longer IS NULL OR 100 * p.longer < 100 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op10_license_scan"] = (
    r"""
WITH t(k, name, text) AS (VALUES """
    + ", ".join(f"({k}, {_literal(n)}, {_literal(x)})" for k, (n, x) in enumerate(licenses.TEMPLATES))
    + r"""),
d AS (
  SELECT doc_id, text, CASE
    WHEN doc_id % 125 = 0 THEN coalesce(source, 'none') || '/LICENSE'
    WHEN doc_id % 25 = 0 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/LICENSE'
    ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/part' || (doc_id // 5) % 16 || '/'
      || CASE WHEN doc_id % 5 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END END AS path
  FROM documents
), counts AS (
  SELECT term, count(*) AS n FROM (
    SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term
    FROM d) GROUP BY term
), idf AS (
  SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + n)) AS idf FROM counts
  UNION ALL
  SELECT DISTINCT term, ln(1.0::DOUBLE + (SELECT count(*) FROM d)) FROM (
    SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM t)
  WHERE term <> '' AND term NOT IN (SELECT term FROM counts)
), plain AS (
  SELECT doc_id, path, list_transform(string_split(text, chr(10)), lambda x:
    CASE WHEN NOT regexp_matches(lower(x), '""" + licenses.HOLDER + r"""') THEN x
      WHEN contains(lower(x), 'all rights reserved') THEN 'copyright all rights reserved' ELSE 'copyright' END) AS lines
  FROM d
), units AS (
  SELECT doc_id, i * 9 + n AS place, array_to_string(lines[i:i + n - 1], chr(10)) AS unit FROM (
    SELECT doc_id, lines, n, unnest(range(1, greatest(len(lines) - n + 2, 2))) AS i
    FROM plain, (VALUES """
    + ", ".join(f"({n})" for n in licenses.HEADER_LINES)
    + r""") AS v(n))
  UNION ALL SELECT doc_id, 0, array_to_string(lines, chr(10)) FROM plain WHERE ends_with(path, '/LICENSE')
), unit_terms AS (
  SELECT doc_id, place, term, count(*) * any_value(idf) AS w FROM (
    SELECT doc_id, place, unnest(list_filter(string_split_regex(lower(unit), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term
    FROM units) JOIN idf USING (term) GROUP BY ALL
), template_terms AS (
  SELECT k, name, term, count(*) * any_value(idf) AS w FROM (
    SELECT k, name, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term
    FROM t) JOIN idf USING (term) GROUP BY ALL
), norms AS (SELECT doc_id, place, sqrt(sum(w * w)) AS norm FROM unit_terms GROUP BY ALL),
template_norms AS (SELECT k, sqrt(sum(w * w)) AS norm FROM template_terms GROUP BY ALL),
cosines AS (
  SELECT doc_id, place, k, name, round(sum(u.w * x.w) / any_value(n.norm) / any_value(m.norm), 9) AS cosine
  FROM unit_terms u JOIN template_terms x USING (term) JOIN norms n USING (doc_id, place) JOIN template_norms m USING (k)
  WHERE n.norm > 0 GROUP BY doc_id, place, k, name
), firsts AS (
  SELECT doc_id, place, arg_max(name, (cosine, -k)) AS best, max(cosine) AS cosine, max((cosine, -k)) AS top FROM cosines GROUP BY ALL
), told AS (
  SELECT f.doc_id, f.best, f.cosine, f.top, f.best NOT IN ('proprietary', 'BSD-2-Clause') AS strong
  FROM firsts f LEFT JOIN cosines c ON c.doc_id = f.doc_id AND c.place = f.place AND c.name <> f.best
  GROUP BY f.doc_id, f.place, f.best, f.cosine, f.top
  HAVING f.cosine >= 0.7 AND f.cosine >= coalesce(max(c.cosine), 0) + 0.01
), own AS (
  SELECT doc_id, arg_max(best, (strong, top)) AS own_license, round(arg_max(cosine, (strong, top)), 6) AS similarity
  FROM told GROUP BY doc_id
), files AS (
  SELECT doc_id, path, own_license, similarity, regexp_replace(path, '/?[^/]*$', '') AS dir FROM d LEFT JOIN own USING (doc_id)
), notices AS (
  SELECT dir, arg_min(own_license, (-similarity, path, own_license)) AS of_dir FROM files
  WHERE ends_with(path, '/LICENSE') AND own_license IS NOT NULL GROUP BY dir
), above AS (
  SELECT DISTINCT f.dir, n.dir AS from_dir, n.of_dir FROM files f JOIN notices n
  ON f.dir = n.dir OR starts_with(f.dir, n.dir || '/')
), nearest AS (
  SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir, arg_max(of_dir, length(from_dir)) AS of_dir FROM above GROUP BY dir
)
SELECT doc_id, path, own_license, similarity, coalesce(own_license, of_dir) AS license,
  CASE WHEN own_license IS NULL THEN from_dir WHEN ends_with(path, '/LICENSE') THEN 'file' ELSE 'header' END AS license_from
FROM files LEFT JOIN nearest USING (dir)
"""
)
