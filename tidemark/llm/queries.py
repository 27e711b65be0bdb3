"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, languages, lines, packing, pieces, quality, resampling, substrings, suffixes, toxicity, urls, vectors, whitening


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


HOST_RULES = (
    urls.host_rule("allow", "com/"),
    urls.host_rule("block", "example.com/en/"),
    urls.host_rule("allow", "www.example.com/en/"),
    urls.host_rule("block", "net/es/"),
    urls.host_rule("block", "net/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes with dropout and decodes again; lossless is checked row by row."""
    docs, model = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    ids = pieces.encode(docs.select("doc_id", "text"), model, seed=20240607, dropout=0.1)
    out = pieces.decode(ids, model)
    return out.select("doc_id", "n_ids", "ids_crc32", F.md5("text").alias("decoded_md5"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), (*HOST_RULES, *urls.PATTERNS))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrates on a draw of about 4,000 rows of remainder 3, counts n-grams on all other rows but 2, holds out 2."""
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = languages.train(docs.where(rest != 2), "lang", calibrate=rest == 3)
    out = languages.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of remainder 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~held))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


QUERIES = {
    "op1_piece_dropout": op1_piece_dropout,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """
        WITH pieces AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
        ), keyed AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS trimmed FROM pieces
        ), held AS (
            SELECT trimmed, min(doc_id) AS first_id FROM keyed WHERE length(trimmed) >= 10 GROUP BY trimmed HAVING count(DISTINCT source) >= 8
        ), marked AS (
            SELECT k.doc_id, k.line, k.pos, coalesce(h.first_id <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN held h ON k.trimmed = h.trimmed
        ), kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(k.text) END AS text_md5
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op4_url_filter": r"""
        WITH rules(name, verdict, host, start) AS (VALUES
            ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
            ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
        ), rests AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
        ), best AS (
            SELECT page_id, arg_max(r.name, length(r.name)) AS rule, arg_max(r.verdict, length(r.name)) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.start) GROUP BY page_id
        )
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN
            regexp_matches(p.host, '(?s)^(.*\.)?(cheap-pills|spam-farm|adult-[a-z0-9]+|(online-)?casino(-[a-z0-9]+)*)\.')
            OR regexp_matches(p.path, '/(viagra|cialis)([/._-]|$)') OR regexp_matches(p.path, '/wp-login\.php$') THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts p LEFT JOIN best b USING (page_id)""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM texts WHERE len(w) > 0
        ), grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM starts
        ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
        ), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (SELECT u, v FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * inter >= 85 * (x.n + y.n - inter)
        ), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
        ), comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN comps c ON d.doc_id = c.a LEFT JOIN sizes s USING (doc_id)""",
    "op9_near_dedup": r"""
        WITH RECURSIVE good AS MATERIALIZED (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END
        ), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
        ), comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN comps c ON e.vec_id = c.a LEFT JOIN degrees d ON e.vec_id = d.u""",
    "op10_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13
        ), windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts
        ), firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
        ), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE first_id < doc_id
        ), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
        ), kept AS (SELECT t.doc_id, t.w, coalesce(len(l.ps), 0) AS n_removed, CASE WHEN l.ps IS NULL THEN t.w ELSE (SELECT coalesce(list(t.w[j] ORDER BY j), []) FROM (SELECT unnest(range(1, len(t.w) + 1)) AS j) WHERE NOT list_contains(l.ps, j)) END AS rest
            FROM texts t LEFT JOIN lost l USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept""",
    "op12_resampling": r"""
        WITH RECURSIVE texts AS (
            SELECT 0 AS corpus, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), starts AS (SELECT corpus, id, w, unnest(range(1, len(w) + 1)) AS i FROM texts
        ), runs AS (SELECT corpus, id, array_to_string(w[i:i + k - 1], ' ') AS f FROM starts, range(1, 4) r(k) WHERE i + k - 1 <= len(w)
        ), counted AS MATERIALIZED (SELECT corpus, id, f, count(*) AS n FROM runs GROUP BY ALL
        ), named AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
        ), bits(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8
        ), effect AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8
        ), later(d, b, v) AS (SELECT 0, b, v FROM effect UNION ALL SELECT d + 1, l.b, xor(l.v >> 8, e.v) FROM later l JOIN effect e ON e.b = l.v & 255 WHERE d < (SELECT max(length(h)) FROM named) // 2
        ), base(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(s.v >> 8, e.v) FROM base s JOIN effect e ON e.b = s.v & 255 WHERE n < (SELECT max(length(h)) FROM named) // 2
        ), letters AS (SELECT f, length(h) // 2 AS size, unnest(range(length(h) // 2)) AS p, h FROM named
        ), folded AS (
            SELECT f, any_value(size) AS size, bit_xor(l.v) AS v FROM letters JOIN later l ON l.d = size - 1 - p AND l.b = 16 * (strpos('0123456789ABCDEF', substr(h, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * p + 2, 1)) - 1 GROUP BY f
        ), buckets AS MATERIALIZED (SELECT f, xor(xor(folded.v, base.v), 4294967295) % 10000 AS b FROM folded JOIN base ON base.n = size
        ), tallies AS (SELECT b, sum(n) FILTER (corpus = 0) AS s, sum(n) FILTER (corpus = 1) AS t FROM counted JOIN buckets USING (f) GROUP BY b
        ), sizes AS (SELECT sum(s) AS s_all, coalesce(sum(t), 0) AS t_all FROM tallies
        ), gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM tallies, sizes
        ), weighed AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN buckets USING (f) JOIN gains USING (b) WHERE corpus = 0 GROUP BY id
        ), drawn AS (SELECT doc_id, floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g FROM documents
        ), scored AS (
            SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + g)::BIGINT AS score, len(w) >= 20 AS able
            FROM drawn d JOIN texts x ON x.corpus = 0 AND x.id = d.doc_id LEFT JOIN weighed g ON g.id = d.doc_id
        ), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE able)
        SELECT s.doc_id, n_features, weight, score, r AS rank FROM scored s LEFT JOIN ranked k ON k.doc_id = s.doc_id AND r <= 5 * n // 100""",
}
