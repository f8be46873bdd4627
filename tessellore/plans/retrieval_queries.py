"""Queries of the scoring family and of the records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators import records, scoring, store
from tessellore.runtime import broadcast_if_small, ensure_checkpoint_dir, strip, table

QUESTION = "rotated signature of the webhook with retryCount 153 of the webhook"
ENDPOINT_QUESTION = "list rate locks of the sandbox"
DIMENSION = 64
QUESTIONS = [QUESTION, ENDPOINT_QUESTION, "what is the overview", "?!"]
SENTINELS = ["overview", "welcome", "authentication", "pagination", "webhooks"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_records")


_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> store.Store:
    """The store of the tables, built in the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = f"{ensure_checkpoint_dir(spark)}/store-{len(_BUILT)}"
        rows = table(spark, sf_dir, "chunk_vectors").filter(F.col("chunk_id").isNotNull())
        stats = records.build_stats(pages(spark, sf_dir), chunks(spark, sf_dir))
        store.write_store(path, chunks(spark, sf_dir), rows, DIMENSION, stats, _endpoint_entries(spark, sf_dir))
        _BUILT[key] = path
    return store.read_store(spark, _BUILT[key])


def question(spark: SparkSession, sf_dir: str, text: str = QUESTION) -> store.Question:
    """A question with a vector of the tables' own model, which is not at hand: the usable one of smallest id stands for it."""
    rows = table(spark, sf_dir, "chunk_vectors").filter(scoring.usable_vector(F.col("embedding"), DIMENSION))
    return store.Question(text, rows.orderBy("vec_id").limit(1).collect()[0]["embedding"])


def term_stats(spark, sf_dir):
    return built(spark, sf_dir).lexical.terms


def corpus_stats(spark, sf_dir):
    return built(spark, sf_dir).lexical.corpus.select("docs", "tokens", "terms", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


def bm25_topn(spark, sf_dir):
    return store.lexical_hits(built(spark, sf_dir).lexical, [store.Question(QUESTION)]).select(F.col("id").alias("chunk_id"), "score", "rank")


def bm25_batch(spark, sf_dir):
    """Several questions in one pass."""
    hits = store.lexical_hits(built(spark, sf_dir).lexical, [store.Question(q) for q in QUESTIONS])
    return hits.select("question", F.col("id").alias("chunk_id"), "score", "rank")


def dense_topn(spark, sf_dir):
    return store.dense_hits(built(spark, sf_dir).vectors, [question(spark, sf_dir)]).select(F.col("id").alias("chunk_id"), "score", "rank")


def hits_with_payload(spark, sf_dir):
    return store.retrieve(built(spark, sf_dir), [question(spark, sf_dir)])


def rrf_hybrid(spark, sf_dir):
    found = hits_with_payload(spark, sf_dir)
    return found.select(F.col("id").alias("chunk_id"), "rank", "score", "sources", "title", "url", "kind", T.preview(F.col("page_content")).alias("preview"))


def retrieve_words(spark, sf_dir):
    """A plain question without a vector: the lexical ranking alone is fused."""
    found = store.retrieve(built(spark, sf_dir), ENDPOINT_QUESTION, 3)
    return found.select(F.col("id").alias("chunk_id"), "rank", "score", "sources")


def stored_payload(spark, sf_dir):
    """The payload that hits are joined to, read back from the store."""
    return built(spark, sf_dir).payload.select(F.col("id").alias("chunk_id"), F.sha2(F.coalesce("page_content", F.lit("")), 256).alias("text_hash"), "url", "title", "chunk_index")


def stored_vectors(spark, sf_dir):
    """The vectors of the store: how many, and that all have length one."""
    packed = built(spark, sf_dir).vectors
    return packed.agg(F.count("*").alias("vectors"), F.countDistinct("id").alias("chunks"), F.min(F.length("packed")).alias("bytes"))


def stored_stats(spark, sf_dir):
    """The build counters read back from the store's JSON."""
    built(spark, sf_dir)
    schema = "records_loaded bigint, records_deduped bigint, chunks bigint, smallest int, median int, p95 int, largest int"
    return spark.read.schema(schema).json(f"{_BUILT[spark.sparkContext.applicationId, sf_dir]}/stats")


def _endpoint_entries(spark, sf_dir):
    """Reference pages as endpoints: what is searched is title, address and excerpt."""
    searched = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("excerpt", F.lit("")))
    return pages(spark, sf_dir).filter("kind = 'reference'").select(F.col("page_id").alias("id"), searched.alias("searched"), "title", "url")


def gated_endpoints(spark, sf_dir):
    return store.gated(built(spark, sf_dir), ENDPOINT_QUESTION).select(F.col("id").alias("page_id"), "score", "overlap", "place")


def endpoint_projection(spark, sf_dir):
    """Gated endpoints as a response lists them."""
    return store.gated(built(spark, sf_dir), ENDPOINT_QUESTION).select("place", F.coalesce("title", F.lit("")).alias("name"), F.col("url").alias("path"))


def dedupe_content(spark, sf_dir):
    return records.deduplicated(records.indexable(pages(spark, sf_dir))).select("page_id", "url", "body_hash")


def dropped_dups(spark, sf_dir):
    return records.dropped_copies(records.indexable(pages(spark, sf_dir)))


def filter_null_safe(spark, sf_dir):
    return records.indexable(pages(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def sparse_body_route(spark, sf_dir):
    return records.text_route(pages(spark, sf_dir)).groupBy("type", "route").agg(F.count("*").alias("n"))


def chunk_size_stats(spark, sf_dir):
    return records.size_stats(chunks(spark, sf_dir))


def kind_counts(spark, sf_dir):
    return records.kind_counts(chunks(spark, sf_dir))


def distinct_kinds(spark, sf_dir):
    return records.kind_totals(chunks(spark, sf_dir))


def manifest_counts(spark, sf_dir):
    return records.manifest_counts(table(spark, sf_dir, "crawl_manifest"))


def manifest_latest(spark, sf_dir):
    return records.latest_per_url(table(spark, sf_dir, "crawl_manifest")).select("url", "fetches", "fetched_at", "loaded_at")


def text_fingerprints(spark, sf_dir):
    return records.text_fingerprints(chunks(spark, sf_dir), "chunk_id", "page_content")


def corpus_fingerprint(spark, sf_dir):
    return records.corpus_fingerprint(chunks(spark, sf_dir), "chunk_id", "page_content")


def dropped_preview(spark, sf_dir):
    return records.dropped_preview(records.indexable(pages(spark, sf_dir)))


def fetch_stamps(spark, sf_dir):
    """First and last fetch of each kind, as ISO timestamps."""
    stamped = table(spark, sf_dir, "crawl_manifest").groupBy(T.or_else(F.col("kind"), F.lit("other")).alias("kind")).agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"))
    return stamped.select("kind", T.iso_timestamp(F.col("a")).alias("first"), T.iso_timestamp(F.col("b")).alias("last"))


def table_cells(spark, sf_dir):
    """Excerpts as cells of a table, and their first lines."""
    return pages(spark, sf_dir).filter("excerpt IS NOT NULL").select("page_id", T.flat_description(F.col("excerpt")).alias("cell"))


def sentinel_smoke(spark, sf_dir):
    return records.sentinels(pages(spark, sf_dir), SENTINELS)


def build_stats(spark, sf_dir):
    return records.build_stats(pages(spark, sf_dir), chunks(spark, sf_dir))


def header_format(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("page_id", T.chunk_header(F.col("title"), F.col("slug"), F.col("breadcrumb")).alias("header"))


def url_cache_paths(spark, sf_dir):
    return table(spark, sf_dir, "crawl_manifest").groupBy(T.url_cache_key(F.col("url")).alias("cache_key")).agg(F.count("*").alias("fetches"))


def rewrite_markdown(spark, sf_dir):
    sites = table(spark, sf_dir, "doc_sites").select(F.col("site_key").alias("source"), "base_url", "section_prefix")
    rewritten = pages(spark, sf_dir).join(broadcast_if_small(sites), "source")
    out = T.rewrite_body(F.col("body_md"), F.col("base_url"), F.col("section_prefix"))
    return rewritten.select("page_id", F.sha2(out, 256).alias("body_hash"), F.length(out).alias("chars"))


def pending_embeddings(spark, sf_dir):
    """Chunks with text for which no usable vector is stored yet."""
    usable = table(spark, sf_dir, "chunk_vectors").filter(scoring.usable_vector(F.col("embedding"), DIMENSION))
    done = usable.filter(F.col("chunk_id").isNotNull()).select("chunk_id")
    todo = chunks(spark, sf_dir).filter(F.length(strip(F.coalesce("page_content", F.lit("")))) > 0)
    return todo.join(done, "chunk_id", "left_anti").select("chunk_id")


def category_summary(spark, sf_dir):
    c = F.col("category")
    return pages(spark, sf_dir).groupBy(c["slug"].alias("slug"), c["title"].alias("title"), c["type"].alias("type")).agg(F.count("*").alias("pages"), F.countDistinct(c["id"]).alias("ids"))


QUERIES = {f.__name__: f for f in (
    term_stats, corpus_stats, bm25_topn, bm25_batch, dense_topn, rrf_hybrid, retrieve_words, stored_payload, stored_vectors, stored_stats, gated_endpoints, endpoint_projection, dedupe_content, dropped_dups, filter_null_safe, sparse_body_route,
    chunk_size_stats, kind_counts, distinct_kinds, manifest_counts, manifest_latest, text_fingerprints, corpus_fingerprint, sentinel_smoke, build_stats,
    dropped_preview, fetch_stamps, table_cells, header_format, url_cache_paths, rewrite_markdown, pending_embeddings, category_summary,
)}

_TOKENS = r"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z0-9_]*|\p{{Nd}}+'), lambda t: lower(t))"
_INDEX = (
    "docs AS (SELECT {id} AS id, row_number() OVER () AS row, " + _TOKENS + " AS tokens FROM {source}), "
    "postings AS (SELECT row, id, len(tokens) AS dl, unnest(tokens) AS term FROM docs), "
    "tfs AS (SELECT term, row, id, dl, count(*) AS tf FROM postings GROUP BY ALL), "
    "terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tfs GROUP BY 1), "
    "sizes AS (SELECT count(*) AS docs, coalesce(sum(len(tokens)), 0)::BIGINT AS tokens FROM docs), "
    "corpus AS (SELECT any_value(docs) AS docs, any_value(tokens) AS tokens, avg(ln(docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)) AS avg_idf, count(*) AS terms, "
    "any_value(tokens)::DOUBLE / any_value(docs) AS avgdl FROM terms, sizes)"
)
_SCORES = (
    _INDEX + ", query AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({question}) AS term) GROUP BY 1), "
    "weights AS (SELECT term, qtf, avgdl, CASE WHEN ln(docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) < 0 THEN 0.25 * avg_idf ELSE ln(docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) END AS idf FROM terms JOIN query USING (term), corpus), "
    "scores AS (SELECT row, id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tfs JOIN weights USING (term) GROUP BY 1, 2)"
)


def _index_sql(**names: str) -> str:
    return _INDEX.format(**names)


def _scores_sql(question: str, **names: str) -> str:
    return _SCORES.format(question="[" + ", ".join(f"'{t}'" for t in T.question_tokens(question)) + "]", **names)


_CHUNK_INDEX = _index_sql(id="chunk_id", text="page_content", source="chunks")
_CHUNK_SCORES = _scores_sql(QUESTION, id="chunk_id", text="page_content", source="chunks")
_LEXICAL = _CHUNK_SCORES + (
    ", lexical20 AS (SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 20), "
    "lexical AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lexical20 WHERE score > 0)"
)
_UNIT = (
    "usable AS (SELECT vec_id, chunk_id, embedding::DOUBLE[64] AS v FROM chunk_vectors WHERE len(embedding) = 64 "
    "AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "question AS (SELECT v AS q FROM usable ORDER BY vec_id LIMIT 1), "
    "dense20 AS (SELECT chunk_id AS id, round(array_cosine_similarity(v, q), 6) AS score FROM usable, question WHERE chunk_id IS NOT NULL ORDER BY score DESC, id LIMIT 20), "
    "dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense20)"
)
_FUSED = (
    _LEXICAL + ", " + _UNIT + ", both_ AS (SELECT id, rank, 'semantic' AS source FROM dense UNION ALL SELECT id, rank, 'bm25' FROM lexical), "
    "fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(CASE WHEN source = 'semantic' THEN rank END) AS s, min(CASE WHEN source = 'bm25' THEN rank END) AS b FROM both_ GROUP BY 1), "
    "hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, s NULLS LAST, b NULLS LAST, id) AS rank FROM fused QUALIFY rank <= 5)"
)
_STRIP = r"regexp_replace({0}, '^[\s\v\x1c-\x1f\x85\p{{Z}}]+|[\s\v\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_BLANK = r"NOT regexp_matches(coalesce(body_md, ''), '[^\s\v\x1c-\x1f\x85\p{Z}]')"
_DEDUPE = (
    "kept AS (SELECT *, sha256(coalesce(body_md, '')) AS body_hash, CASE WHEN " + _BLANK + " THEN page_id END AS apart FROM page_records WHERE type IS DISTINCT FROM 'custompage'), "
    "placed AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS kept_id FROM kept WINDOW w AS (PARTITION BY body_hash, apart ORDER BY "
    "CASE WHEN coalesce(discovered_via, '') <> 'sidebar' THEN 1 ELSE 0 END, length(coalesce(body_md, '')) DESC, coalesce(url, ''), page_id))"
)
_SIZES = (
    "sizes AS (SELECT length(page_content) AS size, row_number() OVER (ORDER BY length(page_content)) - 1 AS i, count(*) OVER () AS n FROM chunks WHERE page_content IS NOT NULL)"
)
_SIZE_STATS = (
    "SELECT count(*) AS chunks, min(size)::INT AS smallest, max(CASE WHEN i = n // 2 THEN size END)::INT AS median, max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN size END)::INT AS p95, max(size)::INT AS largest FROM sizes"
)

def _batch_sql() -> str:
    parts = []
    for i, q in enumerate(QUESTIONS):
        if T.question_tokens(q):
            scores = _scores_sql(q, id="chunk_id", text="page_content", source="chunks")
            parts.append(f"SELECT * FROM (WITH {scores} SELECT {i} AS question, id AS chunk_id, score, (row_number() OVER (ORDER BY score DESC, id))::INT AS rank FROM scores WHERE score > 0 ORDER BY score DESC, id LIMIT 20)")
    return " UNION ALL ".join(parts)


_GATED = (
    "entries AS (SELECT page_id, concat_ws(chr(10), coalesce(title, ''), coalesce(url, ''), coalesce(excerpt, '')) AS searched FROM page_records WHERE kind = 'reference'), "
    + _scores_sql(ENDPOINT_QUESTION, id="page_id", text="searched", source="entries")
    + ", best AS (SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 5), "
    "kept AS (SELECT b.id, b.score, len(list_intersect(d.tokens, (SELECT list(term) FROM query)))::DOUBLE / (SELECT count(*) FROM query) AS overlap FROM best b JOIN docs d ON d.id = b.id WHERE b.score > 0), "
    "placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place, lead(score) OVER (ORDER BY score DESC, id) AS second FROM kept WHERE overlap >= 0.3), "
    "gated AS (SELECT id AS page_id, score, round(overlap, 6) AS overlap, place::INT AS place FROM placed WHERE place = 1 OR place <= CASE WHEN (SELECT second IS NULL OR score / second >= 2.0 FROM placed WHERE place = 1) THEN 1 ELSE 3 END)"
)
_PLAIN = _scores_sql(ENDPOINT_QUESTION, id="chunk_id", text="page_content", source="chunks")
_BUILD_STATS = f"WITH {_SIZES}, counters AS (SELECT count(*) AS records_loaded, count(DISTINCT CASE WHEN NOT ({_BLANK}) THEN sha256(body_md) END) + count(*) FILTER ({_BLANK}) AS records_deduped FROM page_records WHERE type IS DISTINCT FROM 'custompage'), stats AS ({_SIZE_STATS}) SELECT * FROM counters, stats"

ORACLE = {
    "bm25_batch": _batch_sql(),
    "retrieve_words": f"WITH {_PLAIN}, best AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scores WHERE score > 0) SELECT id AS chunk_id, r::INT AS rank, round(1.0::DOUBLE / (60 + r), 9) AS score, 'bm25' AS sources FROM best WHERE r <= 3",
    "stored_payload": "SELECT chunk_id, sha256(coalesce(page_content, '')) AS text_hash, url, title, chunk_index FROM chunks",
    "stored_vectors": f"WITH {_UNIT} SELECT count(*) AS vectors, count(DISTINCT chunk_id) AS chunks, 512 AS bytes FROM usable WHERE chunk_id IS NOT NULL",
    "stored_stats": _BUILD_STATS,
    "endpoint_projection": f"WITH {_GATED} SELECT place, coalesce(title, '') AS name, url AS path FROM gated JOIN page_records USING (page_id)",
    "corpus_fingerprint": "WITH hashed AS (SELECT chunk_id // 65536 AS block, chunk_id AS id, sha256(coalesce(page_content, '')) AS h FROM chunks), blocks AS (SELECT block, count(*) AS n, sha256(string_agg(id || ':' || h, chr(10) ORDER BY id, h)) AS h FROM hashed GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS texts, sha256(string_agg(block || ':' || h, chr(10) ORDER BY block)) AS fingerprint FROM blocks",
    "dropped_preview": f"WITH {_DEDUPE} SELECT page_id, kept_id, body_hash FROM placed WHERE place > 1 ORDER BY page_id LIMIT 5",
    "fetch_stamps": "SELECT coalesce(nullif(kind, ''), 'other') AS kind, strftime(min(fetched_at), '%Y-%m-%dT%H:%M:%S+00:00') AS first, strftime(max(fetched_at), '%Y-%m-%dT%H:%M:%S+00:00') AS last FROM crawl_manifest GROUP BY 1",
    "table_cells": "SELECT page_id, " + _STRIP.format("replace(replace(excerpt, '|', chr(92) || '|'), chr(10), ' ')") + " AS cell FROM page_records WHERE excerpt IS NOT NULL",
    "term_stats": f"WITH {_CHUNK_INDEX} SELECT term, df, total FROM terms",
    "corpus_stats": f"WITH {_CHUNK_INDEX} SELECT docs, tokens, terms, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM corpus",
    "bm25_topn": f"WITH {_LEXICAL} SELECT id AS chunk_id, score, rank::INT AS rank FROM lexical",
    "dense_topn": f"WITH {_UNIT} SELECT id AS chunk_id, score, rank::INT AS rank FROM dense",
    "rrf_hybrid": f"WITH {_FUSED} SELECT h.id AS chunk_id, h.rank::INT AS rank, h.score, array_to_string(list_filter([CASE WHEN s IS NOT NULL THEN 'semantic' END, CASE WHEN b IS NOT NULL THEN 'bm25' END], lambda x: x IS NOT NULL), ',') AS sources, c.title, c.url, c.kind, substring(c.page_content, 1, 500) AS preview FROM hits h JOIN chunks c ON c.chunk_id = h.id",
    "gated_endpoints": f"WITH {_GATED} SELECT * FROM gated",
    "dedupe_content": f"WITH {_DEDUPE} SELECT page_id, url, body_hash FROM placed WHERE place = 1",
    "dropped_dups": f"WITH {_DEDUPE} SELECT page_id, kept_id, body_hash FROM placed WHERE place > 1",
    "filter_null_safe": "SELECT type, count(*) AS n FROM page_records WHERE type IS DISTINCT FROM 'custompage' GROUP BY 1",
    "sparse_body_route": "WITH r AS (SELECT type, CASE WHEN type = 'endpoint' THEN 'synth' WHEN type = 'basic' AND length(" + _STRIP.format("coalesce(body_md, '')") + ") < 200 AND CASE WHEN json_valid(oas) THEN coalesce(len(json_keys(oas, '$.paths')), 0) ELSE 0 END > 0 THEN 'body+synth' ELSE 'body' END AS route FROM page_records) SELECT type, route, count(*) AS n FROM r GROUP BY ALL",
    "chunk_size_stats": f"WITH {_SIZES} {_SIZE_STATS}",
    "kind_counts": "SELECT coalesce(nullif(kind, ''), 'other') AS kind, count(*) AS n FROM chunks GROUP BY 1",
    "distinct_kinds": "SELECT count(*) AS total, count(DISTINCT nullif(kind, '')) AS kinds FROM chunks",
    "manifest_counts": "SELECT coalesce(nullif(kind, ''), 'other') AS kind, CASE WHEN error IS NOT NULL AND http_status IS NULL THEN 'failed' WHEN http_status <> 200 THEN 'bad_status' WHEN error IS NOT NULL THEN 'empty' WHEN cache_hit THEN 'cached' ELSE 'fetched' END AS outcome, count(*) AS n, count(DISTINCT substring(error, 1, 300)) AS errors FROM crawl_manifest GROUP BY ALL",
    "manifest_latest": "SELECT url, count(*) AS fetches, max(fetched_at) AS fetched_at, max(loaded_at) FILTER (fetched_at = m OR (fetched_at IS NULL AND m IS NULL)) AS loaded_at FROM (SELECT *, max(fetched_at) OVER (PARTITION BY url) AS m FROM crawl_manifest) GROUP BY url",
    "text_fingerprints": "SELECT chunk_id, sha256(coalesce(page_content, '')) AS text_hash FROM chunks",
    "sentinel_smoke": "SELECT slug, page_id, length(coalesce(body_md, ''))::INT AS chars, length(coalesce(body_md, '')) >= 500 AS passed FROM page_records WHERE slug IN ('overview', 'welcome', 'authentication', 'pagination', 'webhooks') QUALIFY row_number() OVER (PARTITION BY slug ORDER BY page_id) = 1",
    "build_stats": _BUILD_STATS,
    "header_format": "SELECT page_id, 'Title: ' || coalesce(nullif(" + _STRIP.format("title") + ", ''), coalesce(slug, '')) || chr(10) || 'Section: ' || coalesce(nullif(array_to_string(list_filter(coalesce(breadcrumb, []), lambda x: x IS NOT NULL AND x <> ''), ' > '), ''), 'Documentation') || chr(10) || chr(10) AS header FROM page_records",
    "url_cache_paths": r"WITH p AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+', '') AS p FROM crawl_manifest) SELECT CASE WHEN p = '' OR p LIKE '%/' THEN p || '_index' ELSE p END AS cache_key, count(*) AS fetches FROM p GROUP BY 1",
    "rewrite_markdown": r"""WITH r AS (SELECT page_id, rtrim(base_url, '/') || '/' || section_prefix AS base, coalesce(body_md, '') AS b FROM page_records JOIN doc_sites ON site_key = source),
        m AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(b,
            '\(\s*doc:([A-Za-z0-9][A-Za-z0-9._-]*)(#[^)\s]+)?\s*\)', '(' || chr(1) || '/docs/\1\2)', 'g'),
            '\(\s*ref:([A-Za-z0-9][A-Za-z0-9._-]*)(#[^)\s]+)?\s*\)', '(' || chr(1) || '/reference/\1\2)', 'g'),
            '\(\s*changelog:([A-Za-z0-9][A-Za-z0-9._-]*)(#[^)\s]+)?\s*\)', '(' || chr(1) || '/changelog/\1\2)', 'g'), chr(1), base) AS b FROM r),
        d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '(?s)\[block:html\].*?\[/block\]', '', 'g'), '<([A-Z][A-Za-z0-9]*)\s*/>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS b FROM m),
        s AS (SELECT page_id, """ + _STRIP.format("b") + r""" AS b FROM d)
        SELECT page_id, sha256(b) AS body_hash, length(b)::INT AS chars FROM s""",
    "pending_embeddings": f"WITH {_UNIT} SELECT chunk_id FROM chunks WHERE length(" + _STRIP.format("coalesce(page_content, '')") + ") > 0 AND chunk_id NOT IN (SELECT chunk_id FROM usable WHERE chunk_id IS NOT NULL)",
    "category_summary": "SELECT category.slug AS slug, category.title AS title, category.type AS type, count(*) AS pages, count(DISTINCT category.id) AS ids FROM page_records GROUP BY ALL",
}
