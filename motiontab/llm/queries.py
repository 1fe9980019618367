"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.llm import alignment, bestfit, lexical, linededup, lmscore, mixing, neardup, ngramjoin, packing, quality, tokencount, topk, urlfilter
from motiontab.llm.common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2)


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.98)


#: (action, host, path) of the URL rules.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(read(spark, sf_dir, "documents"), n=5, percent=80)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.fit(docs, read(spark, sf_dir, "labels")).apply(docs).select("doc_id", "quality_score", "accepted")


#: Target weights of the languages.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixture = mixing.fit(docs, language_labels(docs, read(spark, sf_dir, "labels")), TARGETS)
    return mixture.apply(docs).select("doc_id", "source", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(mixture.domains)], "rate")


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of documents that were labelled and found good."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"), percent=80)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=1024, end_id=2)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_packing": op2_packing,
    "op3_embedding_near_duplicates": op3_embedding_near_duplicates,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_token_alignment": op13_token_alignment,
}

_CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _url_sql() -> str:
    fits = [
        f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN struct_pack(n := {len(h + p)}, rule := '{h}{p}', action := '{a}') END" for a, h, p in URL_RULES
    ]
    found = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)"
    terms = urlfilter.terms_of()
    strict, soft = ([t for t, w in terms.items() if (w >= urlfilter.LIMIT) == heavy] for heavy in (True, False))
    hits = [" + ".join(map(found, some)) for some in (strict, soft)]
    weight = " + ".join(f"{terms[t]} * {found(t)}" for t in terms)
    return f"""
    WITH u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://(.*)$', 1, 's') ELSE '' END AS rest,
                      translate(coalesce(url, ''), '{_CAPS}', '{_CAPS.lower()}') AS low FROM pages),
    p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_CAPS}', '{_CAPS.lower()}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, list_sort(list_filter([{", ".join(fits)}], lambda x: x IS NOT NULL), 'DESC')[1] AS fit,
                 {hits[0]} AS n_strict, {hits[1]} AS n_soft, {weight} AS weight FROM p)
    SELECT page_id, host, path, fit.rule AS rule,
           coalesce(fit.action, CASE WHEN weight >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
    FROM r"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_VALID}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_embedding_near_duplicates": f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                         WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
    m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN m ON vec_id = m.a LEFT JOIN n ON vec_id = n.a""",
    "op4_url_filter": _url_sql(),
    "op5_ngram_jaccard": f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPS}', '{_CAPS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
    d AS (SELECT DISTINCT doc_id, g FROM g),
    n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON documents.doc_id = m.a""",
    "op9_line_dedup": """
    WITH l AS (SELECT doc_id, i AS pos, a[i] AS line, list_distinct(list_filter(regexp_split_to_array(lower(a[i]), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '')) AS w
               FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
    s AS (SELECT list_sort(w) AS w, len(w) AS n, min(struct_pack(d := doc_id, p := pos)) AS f FROM l WHERE len(w) > 0 GROUP BY 1, 2),
    d AS (SELECT DISTINCT x.f FROM s x JOIN s y ON y.f < x.f AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND y.w[1] <= x.w[len(x.w)] AND x.w[1] <= y.w[len(y.w)]
          WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
    k AS (SELECT f FROM s EXCEPT SELECT f FROM d),
    j AS (SELECT l.*, k.f IS NOT NULL AS kept FROM l LEFT JOIN k ON k.f = struct_pack(d := l.doc_id, p := l.pos)),
    t AS (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_lines, count(*) FILTER (WHERE len(w) > 0 AND NOT kept) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept OR len(w) = 0), '') AS text FROM j GROUP BY doc_id)
    SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, md5(text) AS text_md5 FROM t""",
    "op11_ranked_search": f"""
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPS}', '{_CAPS.lower()}'), '{_TERM}')) AS t FROM documents),
    q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPS}', '{_CAPS.lower()}'), '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
    f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
    n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY ALL),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
    w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY t),
    s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
          FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (doc_id), a GROUP BY ALL HAVING score > 0),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
