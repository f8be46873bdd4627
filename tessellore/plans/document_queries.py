"""Queries over documents: chunks, rendered endpoints, trees, links, prompts, embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators import answering, chunking, embedding, endpoints, links, records, trees
from tessellore.plans import retrieval_queries as R
from tessellore.runtime import broadcast_if_small, ensure_checkpoint_dir, table
from tessellore.sources import tables
from tessellore.streaming import ingest


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated records with the text they are chunked from."""
    kept = records.text_route(records.deduplicated(records.indexable(R.pages(spark, sf_dir))))
    wanted = F.col("route") != "body"
    synth = endpoints.synthesized(F.when(wanted, F.col("oas")), F.when(wanted, F.col("doc_api")))
    return kept.withColumn("synth", synth).withColumn("record_text", endpoints.record_text(F.col("route"), F.col("body_md"), F.col("synth")))


def split_chunks(spark, sf_dir):
    """The chunks of all records, as they would be indexed."""
    return chunking.chunk_records(_records(spark, sf_dir)).select("page_id", "chunk_index", "total_chunks", "page_content")


def synth_markdown(spark, sf_dir):
    """The rendered API document of every page that has one."""
    rendered = R.pages(spark, sf_dir).filter("oas IS NOT NULL OR doc_api IS NOT NULL").select("page_id", endpoints.synthesized(F.col("oas"), F.col("doc_api")).alias("markdown"))
    return rendered.filter("markdown <> ''")


def merge_small(spark, sf_dir):
    """Paragraphs of each page merged while small."""
    pieces = F.filter(F.split(F.col("body_md"), "\n\n"), lambda x: x != "")
    merged = R.pages(spark, sf_dir).filter("body_md IS NOT NULL").select("page_id", chunking.merge_small(pieces).alias("merged"))
    return merged.select("page_id", F.posexplode("merged").alias("place", "piece")).select("page_id", "place", F.length("piece").alias("chars"), F.sha2("piece", 256).alias("piece_hash"))


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "doc_sites")


def extract_links(spark, sf_dir):
    """The internal links of all pages."""
    return links.page_links(R.pages(spark, sf_dir), _sites(spark, sf_dir)).select("source_url", "url", "kind", "slug")


def frontier_antijoin(spark, sf_dir):
    """Links to addresses no record has, with the page that showed them first."""
    found = links.page_links(R.pages(spark, sf_dir), _sites(spark, sf_dir))
    return links.new_links(found, R.pages(spark, sf_dir)).select("url", "kind", "slug", "found_on")


def crawl_rounds(spark, sf_dir):
    """All addresses reached from the sites' entry pages over the links of the records, with their round."""
    base = _sites(spark, sf_dir).select(F.col("site_key").alias("source"), "base_url", F.col("section_prefix").alias("section"), "entry_url")
    pages = R.pages(spark, sf_dir).select("source", F.col("url").alias("source_url"), "body_md")
    web = pages.join(broadcast_if_small(base), "source").select("source_url", F.col("body_md").alias("body"), F.lit(None).cast("string").alias("html"), "base_url", "section", F.lit(True).alias("is_page"))

    def fetch(urls):
        return web.join(urls.withColumnRenamed("url", "source_url"), "source_url", "left_semi")

    return links.crawl(base.select(F.col("entry_url").alias("url")), fetch, most_pages=None)


def sidebar_walk(spark, sf_dir):
    """The frontier entry of every page, through a sidebar of one category and one page."""
    page = F.struct("slug", "title", "hidden", "deprecated")
    category = F.struct(F.col("section").alias("title"), F.col("source").alias("slug"), F.array(page).alias("pages"))
    bars = F.when(F.col("kind") == "reference", F.to_json(F.struct(F.struct(F.array(category).alias("refs")).alias("sidebars")))).otherwise(F.to_json(F.struct(F.struct(F.array(category).alias("docs")).alias("sidebars"))))
    found = trees.frontier(R.pages(spark, sf_dir).select(bars.alias("props"), F.lit("https://docs.example/").alias("base_url"), "section"))
    return found.select("slug", "url", "kind", "title", "category_title", "category_slug", "breadcrumb", "deprecated")


def api_tree_walk(spark, sf_dir):
    """The searched text of every page as a request in an API collection of two folders."""
    request = F.struct(F.lit("get").alias("method"), F.struct(F.col("url").alias("raw")).alias("url"), F.col("excerpt").alias("description"))
    leaf = F.struct(F.concat_ws(" ", F.lit("page"), "page_id").alias("name"), request.alias("request"))
    inner = F.struct(F.coalesce("kind", F.lit("")).alias("name"), F.array(leaf).alias("item"))
    outer = F.struct(F.coalesce("source", F.lit("")).alias("name"), F.array(inner).alias("item"))
    found = trees.api_entries(R.pages(spark, sf_dir).select(F.to_json(F.struct(F.array(outer).alias("item"))).alias("collection")))
    return found.select("name", "method", "url", "folder_path", "bm25_text", F.size("tokens").alias("n_tokens"))


def prompt_build(spark, sf_dir):
    """The prompt for the question from its fused hits."""
    return answering.prompt(R.QUESTION, R.hits_with_payload(spark, sf_dir))


def embed_pending(spark, sf_dir):
    """Vectors of the texts of chunks that have none, by the offline encoder."""
    todo = R.chunks(spark, sf_dir).join(R.pending_embeddings(spark, sf_dir), "chunk_id", "left_semi")
    made = embedding.embed(todo, embedding.encoder_for("hashing", dimension=64), "hashing-64")
    return made.select("text_hash", "model_tag", F.size("embedding").alias("numbers"))


def embed_resumed(spark, sf_dir):
    """Vectors added to a stored table in two calls, the first for short texts only: each text once."""
    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    make, texts = embedding.hashing_encoder(), R.chunks(spark, sf_dir)
    embedding.embed_into(spark, path, texts.filter(F.length("page_content") < 800), make, "hashing-64")
    found = embedding.embed_into(spark, path, texts, make, "hashing-64", rounds=2)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return found.groupBy("text_hash").agg(F.count("*").alias("stored"), F.round(F.max(length), 3).alias("length"))


def record_lines(spark, sf_dir):
    """Records written as JSON lines and read back with the record schema."""
    path = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    columns = [c for c in R.pages(spark, sf_dir).columns if c != "page_id"]
    tables.write_jsonl(R.pages(spark, sf_dir).select(*columns), path)
    back = tables.read_jsonl(spark, path)
    return back.select("source", "slug", "url", "breadcrumb", "hidden", "body_md_chars", F.sha2(F.coalesce("body_md", F.lit("")), 256).alias("body_hash"), F.sha2(F.coalesce("oas", F.lit("")), 256).alias("oas_hash"))


def manifest_lines(spark, sf_dir):
    """The manifest written as JSON lines and read back with its schema."""
    path = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "crawl_manifest").withColumn("fetched_at", T.iso_timestamp(F.col("fetched_at"))).drop("loaded_at")
    tables.write_jsonl(rows, path)
    back = tables.read_jsonl(spark, path, tables.MANIFEST_SCHEMA)
    return back.groupBy("kind", "http_status", "cache_hit").agg(F.count("*").alias("n"), F.min("fetched_at").alias("first"), F.countDistinct("url").alias("urls"))


def page_cache(spark, sf_dir):
    """Pages written into a cache folder and found again by their addresses."""
    path = f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    fetched = R.pages(spark, sf_dir).filter("url IS NOT NULL AND body_md IS NOT NULL").groupBy("url").agg(F.max("body_md").alias("html"))
    tables.write_page_cache(fetched, path)
    known = table(spark, sf_dir, "crawl_manifest").select("url").distinct()
    found = tables.cached_pages(known, tables.read_page_cache(spark, path))
    return found.groupBy("cache_hit").agg(F.count("*").alias("urls"))


def chunk_documents(spark, sf_dir):
    """Chunks per page: their number, and that numbers and totals fit."""
    made = chunking.chunk_records(_records(spark, sf_dir).filter("route = 'body'"))
    per = made.groupBy("page_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.max("total_chunks").alias("total"), F.min(F.length("page_content")).alias("least"))
    return per.select("page_id", (F.col("n") == F.col("total")).alias("complete"), (F.col("last") == F.col("n") - 1).alias("numbered"), (F.col("n") == 1).alias("whole")).filter("complete AND numbered")


def manifest_daily(spark, sf_dir):
    """Fetches per day and outcome; the same plan runs on a stream."""
    return ingest.manifest_windows(table(spark, sf_dir, "crawl_manifest"))


QUERIES = {f.__name__: f for f in (split_chunks, synth_markdown, merge_small, extract_links, frontier_antijoin, crawl_rounds, sidebar_walk, api_tree_walk, prompt_build, embed_pending, embed_resumed, record_lines, manifest_lines, page_cache, chunk_documents, manifest_daily)}

_LINKS = r"""links AS (
    SELECT source_url, prefix, u.i AS position, u.x AS raw FROM (
        SELECT p.url AS source_url, rtrim(base_url, '/') || '/' || section_prefix || '/' AS prefix,
            list_transform(regexp_extract_all(coalesce(body_md, ''), '(?:^|[^!])\[[^\]]*?\]\(([^)\s]+)\)', 1), lambda x, i: {'i': i, 'x': x}) AS l
        FROM page_records p JOIN doc_sites ON site_key = source), unnest(l) AS t(u)
), resolved AS (
    SELECT source_url, prefix, position, CASE
        WHEN regexp_full_match(raw, '(doc|ref|changelog):[A-Za-z0-9][A-Za-z0-9._-]*') THEN prefix || CASE split_part(raw, ':', 1) WHEN 'doc' THEN 'docs' WHEN 'ref' THEN 'reference' ELSE 'changelog' END || '/' || split_part(raw, ':', 2)
        ELSE regexp_replace(raw, '[#?].*$', '', 's') END AS url FROM links
), parted AS (
    SELECT source_url, position, url, string_split(regexp_replace(substring(url, length(prefix) + 1), '/+$', ''), '/') AS tail FROM resolved WHERE starts_with(url, prefix)
), internal AS (
    SELECT source_url, url, min(position) AS position, CASE any_value(tail[1]) WHEN 'docs' THEN 'guide' WHEN 'reference' THEN 'reference' ELSE 'changelog' END AS kind, any_value(tail[2]) AS slug
    FROM parted WHERE len(tail) = 2 AND tail[1] IN ('docs', 'reference', 'changelog') AND regexp_full_match(tail[2], '[A-Za-z0-9][A-Za-z0-9._-]*') GROUP BY 1, 2
)"""
_TOKENS = r"len(regexp_extract_all(bm25_text, '[A-Za-z][A-Za-z0-9_]*|\p{Nd}+'))::INT"

ORACLE = {
    "merge_small": """WITH parts AS (SELECT page_id, list_filter(string_split(body_md, chr(10) || chr(10)), lambda x: x <> '') AS p FROM page_records WHERE body_md IS NOT NULL),
        folded AS (SELECT page_id, list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN (length(x[1]) < 500 OR length(acc[-1]) < 500) AND length(acc[-1]) + length(x[1]) < 3000
            THEN list_concat(acc[1:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS merged FROM parts WHERE len(p) > 0),
        placed AS (SELECT page_id, unnest(merged) AS piece, generate_subscripts(merged, 1) - 1 AS place FROM folded)
        SELECT page_id, place::INT AS place, length(piece)::INT AS chars, sha256(piece) AS piece_hash FROM placed""",
    "crawl_rounds": f"""WITH RECURSIVE {_LINKS}, reach AS (
            SELECT entry_url AS url, 0 AS round FROM doc_sites
            UNION SELECT i.url, r.round + 1 FROM reach r JOIN internal i ON i.source_url = r.url WHERE r.round < 40)
        SELECT url, min(round)::INT AS round FROM reach GROUP BY 1""",
    "embed_resumed": "SELECT sha256(page_content) AS text_hash, 1::BIGINT AS stored, CASE WHEN regexp_matches(page_content, '[^\\s\\v\\x1c-\\x1f\\x85\\p{Z}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM chunks WHERE page_content IS NOT NULL GROUP BY page_content",
    "record_lines": "SELECT source, slug, url, breadcrumb, hidden, body_md_chars, sha256(coalesce(body_md, '')) AS body_hash, sha256(coalesce(oas, '')) AS oas_hash FROM page_records",
    "manifest_lines": "SELECT kind, http_status, cache_hit, count(*) AS n, min(strftime(fetched_at, '%Y-%m-%dT%H:%M:%S+00:00')) AS first, count(DISTINCT url) AS urls FROM crawl_manifest GROUP BY ALL",
    "page_cache": r"""WITH keyed AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+', '') AS k FROM (SELECT DISTINCT url FROM crawl_manifest)),
        there AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+', '') AS k FROM page_records WHERE url IS NOT NULL AND body_md IS NOT NULL)
        SELECT coalesce(k IN (SELECT k FROM there), false) AS cache_hit, count(*) AS urls FROM keyed GROUP BY 1""",
    "chunk_documents": f"""WITH {R._DEDUPE}, routed AS (SELECT *, CASE WHEN type = 'endpoint' THEN 'synth' WHEN type = 'basic' AND length({R._STRIP.format("coalesce(body_md, '')")}) < 200 AND CASE WHEN json_valid(oas) THEN coalesce(len(json_keys(oas, '$.paths')), 0) ELSE 0 END > 0 THEN 'body+synth' ELSE 'body' END AS route FROM placed WHERE place = 1)
        SELECT page_id, true AS complete, true AS numbered, length(body_md) <= 2000 AS whole FROM routed WHERE route = 'body' AND NOT ({R._BLANK})""",
    "extract_links": f"WITH {_LINKS} SELECT source_url, url, kind, slug FROM internal",
    "frontier_antijoin": f"WITH {_LINKS}, fresh AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_url, position) AS r FROM internal WHERE url NOT IN (SELECT url FROM page_records WHERE url IS NOT NULL)) SELECT url, kind, slug, source_url AS found_on FROM fresh WHERE r = 1",
    "sidebar_walk": "SELECT slug, 'https://docs.example/' || section || '/' || CASE WHEN kind = 'reference' THEN 'reference' ELSE 'docs' END || '/' || slug AS url, CASE WHEN kind = 'reference' THEN 'reference' ELSE 'guide' END AS kind, coalesce(nullif(title, ''), slug) AS title, section AS category_title, source AS category_slug, [coalesce(section, ''), coalesce(nullif(title, ''), slug)] AS breadcrumb, coalesce(deprecated, false) AS deprecated FROM page_records WHERE slug IS NOT NULL AND slug <> '' AND NOT coalesce(hidden, false)",
    "api_tree_walk": "WITH e AS (SELECT 'page ' || page_id AS name, coalesce(url, '') AS url, [coalesce(source, ''), coalesce(kind, '')] AS folder_path, coalesce(excerpt, '') AS d FROM page_records), t AS (SELECT *, array_to_string(folder_path, ' > ') || chr(10) || name || chr(10) || 'GET ' || url || CASE WHEN d <> '' THEN chr(10) || d ELSE '' END AS bm25_text FROM e) "
    f"SELECT name, 'GET' AS method, url, folder_path, bm25_text, {_TOKENS} AS n_tokens FROM t",
    "prompt_build": f"WITH {R._FUSED}, shown AS (SELECT h.rank, '[Source ' || h.rank || '] Title: ' || coalesce(nullif(title, ''), '(untitled)') || '  •  Section: ' || coalesce(nullif(array_to_string(list_filter(coalesce(breadcrumb, []), lambda x: x IS NOT NULL AND x <> ''), ' > '), ''), 'Documentation') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || chr(10) || {R._STRIP.format('coalesce(page_content, chr(10))')} AS t FROM hits h JOIN chunks c ON c.chunk_id = h.id) "
    f"SELECT '{answering.SYSTEM.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || '## Documentation' || chr(10) || coalesce(string_agg(t, chr(10) || '---' || chr(10) ORDER BY rank), '{answering.NOTHING_FOUND}') || chr(10) || chr(10) || '## Question' || chr(10) || '{R.QUESTION}' || chr(10) || chr(10) || '## Answer' AS prompt FROM shown",
    "embed_pending": f"WITH {R._UNIT}, todo AS (SELECT page_content FROM chunks WHERE length(" + R._STRIP.format("coalesce(page_content, '')") + ") > 0 AND chunk_id NOT IN (SELECT chunk_id FROM usable WHERE chunk_id IS NOT NULL)) SELECT DISTINCT sha256(page_content) AS text_hash, 'hashing-64' AS model_tag, 64 AS numbers FROM todo",
    "manifest_daily": "SELECT time_bucket(INTERVAL 1 DAY, fetched_at) AS day, CASE WHEN error IS NOT NULL AND http_status IS NULL THEN 'failed' WHEN http_status <> 200 THEN 'bad_status' WHEN error IS NOT NULL THEN 'empty' WHEN cache_hit THEN 'cached' ELSE 'fetched' END AS outcome, count(*) AS fetches FROM crawl_manifest WHERE fetched_at IS NOT NULL GROUP BY ALL",
}
