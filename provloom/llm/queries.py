"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.llm import classifier, language
from provloom.llm.embeddings import near_vectors
from provloom.llm.hard_negatives import mine_negatives
from provloom.llm.mixing import mix_documents
from provloom.llm.ngram_join import jaccard_components
from provloom.llm.packing import pack_documents
from provloom.llm.piece_counts import token_counts
from provloom.llm.rules import cascade
from provloom.llm.suffix_tree import score_texts
from provloom.llm.token_files import token_digests, write_token_files
from provloom.llm.urls import Rule, judge_urls
from provloom.llm.whitening import whiten
from provloom.storage import Scratch, load


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are installed; pass another path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))


#: Target shares of tokens by domain.
MIX_WEIGHTS = {"clean": 0.93, "toxic": 0.06, "low": 0.01}


def domain_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.SubwordModel:
    labels = load(spark, sf_dir, "labels")
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return classifier.fit(docs, labels.select("doc_id", domain.alias("domain")), "domain")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also each domain's posterior, and the totals of all documents: wanted and reached."""
    docs = load(spark, sf_dir, "documents")
    mixed = mix_documents(docs, domain_model(spark, docs, sf_dir), MIX_WEIGHTS, anchor="clean")
    at = {d: mixed.mix.domains.index(d) for d in MIX_WEIGHTS if d in mixed.mix.domains}
    posteriors = [(F.col("posterior")[at[d]] if d in at else F.lit(0.0)).alias(f"p_{d}") for d in MIX_WEIGHTS]
    totals = [F.lit(float(x[at[d]]) if d in at else 0.0).alias(f"{name}_{d}") for name, x in (("wanted", mixed.wanted), ("reached", mixed.reached)) for d in MIX_WEIGHTS]
    return mixed.rates.select("doc_id", "tokens", *posteriors, "rate", "copies", *totals)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def bucket_of(mod: int):
    """crc32 of doc_id as text, modulo ``mod``: how the queries hold rows out of training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.SubwordModel:
    return classifier.fit(docs, load(spark, sf_dir, "labels"), "quality", may_learn=bucket_of(4) != 2)


def language_model(docs: DataFrame) -> language.KernelModel:
    return language.fit(docs, may_learn=bucket_of(5) != 0)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return classifier.score_quality(docs, quality_model(spark, docs, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(load(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op4").path("files")
    write_token_files(load(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_digests(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language.identify(docs, language_model(docs))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where it is too large for one."""
    rows = whiten(load(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_ids": op4_token_ids,
    "op5_lm_scores": op5_lm_scores,
    "op6_mixing": op6_mixing,
    "op7_url_filters": op7_url_filters,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), near AS (SELECT a, b, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM near p JOIN pairs n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), good AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.i AS x, b.i AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.i <> b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
        ), met AS (SELECT x, count(*) AS n FROM links GROUP BY x
        ), least AS (SELECT r.x, min(v.vec_id) AS m FROM reach r JOIN v ON v.i = r.y GROUP BY r.x)
        SELECT v.vec_id, coalesce(met.n, 0) AS n_links, least(v.vec_id, coalesce(least.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(least.m, v.vec_id)) AS kept
        FROM v LEFT JOIN met ON met.x = v.i LEFT JOIN least ON least.x = v.i""",
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
        ), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
        ), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = d.doc_id""",
    "op7_url_filters": """
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
        ), rules(verdict, rhost, rpath) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), best AS (
            SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
        )
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)""",
    "op3_quality_rules": r"""
        WITH words AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
        ), repeats AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(8) r(k) WHERE n > 1 GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), m AS (
            SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
                   len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letterless,
                   len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS again
            FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
        ), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 5 * n_symbols > n_words OR 2 * upper > letters OR 10 * letterless > 3 * n_words
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 5 * again > n_words) AS kept
        FROM b""",
}
