"""One query for each operator, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html_extract, line_dedup, ngram_join, packing, quality, secrets, tokens, toxicity

#: Tokenizer files, by name in the public_tokenizers package unless a path is given.
PACKING_TOKENIZER = "word_bpe_49k.json"
COUNTING_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_documents(docs, threshold=0.8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(COUNTING_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_line_dedup, op2_best_fit_packing, op3_nearest_neighbours, op4_ngram_jaccard_join, op5_benchmark_decontamination, op6_secret_scan, op7_html_extraction, op8_toxicity, op9_quality, op10_token_counts]
    return {f.__name__: f for f in own}


def _shingles(table: str, key: str, least: int) -> str:
    """Views <key>_w (words of each row) and <key>_s (its distinct five-word shingles; rows of fewer than `least` words have
    none, other short ones one of all their words)."""
    trimmed = r"regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
    return f"""{key}_w AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: {trimmed}), lambda x: x <> '') AS w FROM {table}),
{key}_s AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM {key}_w WHERE len(w) >= {least}))"""


DECONTAMINATION_SQL = f"""WITH {_shingles("documents", "doc_id", 5)}, {_shingles("benchmark", "item_id", 5)},
size AS (SELECT item_id, count(*) AS n FROM item_id_s GROUP BY item_id),
short AS (SELECT item_id, len(w) AS l, array_to_string(w, ' ') AS s FROM item_id_w WHERE len(w) BETWEEN 1 AND 4),
run AS (SELECT DISTINCT doc_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, greatest(1, len(w) - l + 2))) AS i FROM doc_id_w, (SELECT DISTINCT l FROM short)))
SELECT r.doc_id, i.item_id, 1::BIGINT AS n_shared, 1::BIGINT AS n_shingles, 1.0::DOUBLE AS containment FROM run r JOIN short i ON r.l = i.l AND r.s = i.s UNION ALL
SELECT d.doc_id, i.item_id, count(*) AS n_shared, max(size.n) AS n_shingles, count(*) / max(size.n)::DOUBLE AS containment
FROM doc_id_s d JOIN item_id_s i ON d.s = i.s JOIN size ON size.item_id = i.item_id GROUP BY d.doc_id, i.item_id HAVING count(*) / max(size.n)::DOUBLE >= 0.8"""

LINKS_SQL = f"""WITH RECURSIVE {_shingles("documents", "doc_id", 1)},
size AS (SELECT doc_id, count(*) AS n FROM doc_id_s GROUP BY doc_id),
half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM doc_id_s a JOIN doc_id_s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8::DOUBLE * (x.n + y.n - count(*)) - 1e-9),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
copies AS (SELECT array_to_string(w, ' ') AS t, count(*) AS n FROM doc_id_w WHERE len(w) > 0 GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links, coalesce(c.n, 1) AS n_copies
FROM doc_id_w d LEFT JOIN copies c ON c.t = array_to_string(d.w, ' ')"""


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express in good time; the other operators are held against brute force in tests/llm."""
    return {"op4_ngram_jaccard_join": LINKS_SQL, "op5_benchmark_decontamination": DECONTAMINATION_SQL}
