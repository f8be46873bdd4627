"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.llm import duplicates, markup, mixing, neighbours, packing, sentences, splitting, survivors
from tessellore.runtime import ensure_checkpoint_dir, table


#: The header a chunk's text may begin with.
CHUNK_HEADER = r"^Title: [^\n]*\nSection: [^\n]*\n\n"


def _texts(spark: SparkSession, sf_dir: str, header: bool) -> DataFrame:
    """The bodies of page records and the texts of chunks as tbl, row_id, body."""
    pages = table(spark, sf_dir, "page_records").select(F.lit("page_records").alias("tbl"), F.col("page_id").alias("row_id"), F.col("body_md").alias("body"))
    content = F.col("page_content") if header else F.regexp_replace("page_content", CHUNK_HEADER, "")
    return pages.unionByName(table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), content.alias("body")))


def _page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of problem 1: three words, likeness 0.60, at least 200 characters."""
    pages = table(spark, sf_dir, "page_records").select("page_id", "body_md")
    return duplicates.duplicate_groups(pages, words=3, least=0.6, least_chars=200, count_links=False)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records in one group."""
    return duplicates.grouped_pairs(_page_groups(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every page at five words and a probability likeness of 0.8 over shingle counts."""
    pages = table(spark, sf_dir, "page_records").select("page_id", "body_md")
    return duplicates.duplicate_groups(pages, least_chars=1, weighted=True)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every page that takes part in p1_found, and to how many other texts it is linked."""
    pages = table(spark, sf_dir, "page_records").select("page_id", "body_md")
    return duplicates.duplicate_groups(pages, words=3, least=0.6, least_chars=200)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of markup in each text."""
    return markup.found_families(markup.clean_texts(_texts(spark, sf_dir, header=True)))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every page body and chunk, with counts of what was kept."""
    return markup.clean_texts(_texts(spark, sf_dir, header=True))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized page bodies and chunk texts."""
    return splitting.split_texts(_texts(spark, sf_dir, header=False))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were split, and whether a run without white space had to be broken."""
    return splitting.cut_kinds(p4_pieces(spark, sf_dir))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the page bodies written as large text files, a blank line between two bodies, read by byte ranges of 1 MiB."""
    bodies = table(spark, sf_dir, "page_records").filter("body_md IS NOT NULL").select("body_md")
    path = f"{ensure_checkpoint_dir(spark)}/bodies-{uuid.uuid4().hex}"
    bodies.write.option("lineSep", "\n\n").text(path)
    pieces = splitting.split_files(spark, path, range_bytes=1 << 20)
    return pieces.withColumn("file", F.regexp_extract("path", r"part-(\d+)", 1).cast("int")).drop("path")


def _survivor_choice(spark: SparkSession, sf_dir: str, bundles: list[survivors.Bundle]) -> DataFrame:
    members = survivors.page_members(table(spark, sf_dir, "page_records"), _page_groups(spark, sf_dir), whole=True)
    return survivors.choose_bundles(members, bundles, survivors.page_dependencies(), ranks=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that each field of a group's survivor comes from."""
    chosen = _survivor_choice(spark, sf_dir, [*survivors.page_bundles(), survivors.place_bundle()])
    return chosen.filter("bundle <> 'place'").select("group_id", F.col("bundle").alias("field_name"), F.col("member").alias("page_id"))


def p5_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each bundle with its place in the bundle's preferences; beyond 1 a dependency decided."""
    chosen = _survivor_choice(spark, sf_dir, [*survivors.page_bundles(), survivors.place_bundle()])
    return chosen.select("group_id", "bundle", F.col("member").alias("page_id"), "rank")


def p5_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have a bundle from another member than its most preferred one, because of a dependency."""
    return p5_choices(spark, sf_dir).groupBy("bundle").agg(F.count("*").alias("groups"), F.count_if(F.col("rank") > 1).alias("constrained"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group of copies, with all columns of page records."""
    bundles = survivors.record_bundles()
    return survivors.surviving_records(table(spark, sf_dir, "page_records"), _survivor_choice(spark, sf_dir, bundles), bundles)


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other vectors of every usable vector."""
    return neighbours.neighbours(table(spark, sf_dir, "chunk_vectors").select("vec_id", "embedding"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of neighbours with a cosine of 0.85 or more."""
    return neighbours.similar_pairs(p6_neighbours(spark, sf_dir), 0.85)


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall at 5 of p6_neighbours for the rows whose id is divisible by 20, against all rows, and whether it reaches 0.9."""
    found = neighbours.recall_against_brute_force(table(spark, sf_dir, "chunk_vectors"), p6_neighbours(spark, sf_dir))
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that only fit into several containers."""
    return packing.split_documents(_packed(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(_packed(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents, table(spark, sf_dir, "mix_targets"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens packed, the least possible number of containers, and whether none is overfull."""
    filled = packing.fill_report(_packed(spark, sf_dir))
    return filled.select("least_containers", "tokens", (F.col("fullest") <= packing.CAPACITY).alias("within"), (F.col("containers") <= 1.01 * F.col("least_containers") + 1).alias("tight"))


def p8_allotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has and shall give, and whether the mixture holds that to within a document."""
    shares = p8_shares(spark, sf_dir)
    return shares.select("source", "own_tokens", "allotted_tokens", "is_short", (F.col("actual_tokens") >= F.col("allotted_tokens")).alias("reached"), (F.col("repeats_used") <= F.col("max_repeats")).alias("within"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that cannot reach their share, from the mixture's report."""
    return mixing.short_sources(mixing.report(*_mixture(spark, sf_dir)))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each use of a document with its slot."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mixing.report(*_mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_groups": p1_groups,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p5_choices": p5_choices,
    "p5_constrained": p5_constrained,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p6_recall": p6_recall,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_files": p4_files,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_totals": p7_totals,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_allotted": p8_allotted,
    "p9_found": p9_found,
}

#: The groups of problem 1, as pairs (root, node) of everything that reaches each other.
_REACH = r"""
        WITH RECURSIVE docs AS (
            SELECT page_id, list_filter(regexp_split_to_array(lower(body_md), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM page_records WHERE length(regexp_replace(body_md, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 200
        ), shingles AS (
            SELECT DISTINCT page_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' '))) AS s FROM docs
        ), sizes AS (SELECT page_id, count(*) AS n FROM shingles GROUP BY 1
        ), common AS (
            SELECT a.page_id AS a, b.page_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.page_id < b.page_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM common c JOIN sizes x ON x.page_id = a JOIN sizes y ON y.page_id = b WHERE c.n >= 0.6 * (x.n + y.n - c.n)
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT DISTINCT a AS root, a AS node FROM ways
            UNION SELECT r.root, w.b FROM reach r JOIN ways w ON w.a = r.node
        )"""

#: The members of the groups ranked by the preferences of each bundle.
_RANKED = r""", members AS (SELECT DISTINCT min(root) OVER (PARTITION BY node) AS group_id, node AS page_id FROM reach
        ), looked AS (
            SELECT group_id, p.*, trim(updated_at) AS u FROM members JOIN page_records p USING (page_id)
        ), timed AS (
            SELECT *, CASE WHEN regexp_full_match(u, '-?[0-9]{9,15}') THEN u::BIGINT
                WHEN regexp_full_match(u, '.*(Z|[+-][0-9]{2}:[0-9]{2})') THEN epoch_ms(try_cast(u AS TIMESTAMPTZ))
                ELSE epoch_ms(try_cast(u AS TIMESTAMP)) END AS ms, length(trim(excerpt, E' \t\n\r')) AS e,
                len(list_filter([title, parent_slug, category.slug, category.title], lambda x: trim(x, E' \t\n\r') <> '')) + CASE WHEN len(breadcrumb) > 0 THEN 1 ELSE 0 END AS filled
            FROM looked
        ), ranked AS (
            SELECT group_id, page_id, e, url, source, section, slug,
                row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN lower(trim(discovered_via)) = 'sidebar' THEN 0 ELSE 1 END, url, page_id) AS r1,
                row_number() OVER (PARTITION BY group_id ORDER BY ms DESC NULLS LAST, length(body_md) DESC, page_id) AS r2,
                row_number() OVER (PARTITION BY group_id ORDER BY e DESC NULLS LAST, page_id) AS r3,
                row_number() OVER (PARTITION BY group_id ORDER BY filled DESC, ms DESC NULLS LAST, page_id) AS r4
            FROM timed
        )"""
#: The member of each bundle; the place is the best one that goes with the address.
_CHOICES = """, placed AS (
            SELECT m.group_id, m.page_id, m.r4 FROM ranked m JOIN ranked u ON u.group_id = m.group_id AND u.r1 = 1
            WHERE u.url IS NULL OR (m.source IS NOT DISTINCT FROM u.source AND m.section IS NOT DISTINCT FROM u.section AND m.slug IS NOT DISTINCT FROM u.slug)
            QUALIFY row_number() OVER (PARTITION BY m.group_id ORDER BY m.r4) = 1
        ), choices AS (
            SELECT group_id, 'url' AS bundle, page_id, 1 AS rank FROM ranked WHERE r1 = 1
            UNION ALL SELECT group_id, 'body_md', page_id, 1 FROM ranked WHERE r2 = 1
            UNION ALL SELECT group_id, 'excerpt', page_id, 1 FROM ranked WHERE r3 = 1 AND e > 0
            UNION ALL SELECT group_id, 'place', page_id, r4::INT FROM placed
        )"""

ORACLE = {
    "p1_groups": _REACH + """, bodies AS (SELECT page_id, body_md, min(page_id) OVER (PARTITION BY body_md) AS first FROM page_records WHERE page_id IN (SELECT page_id FROM docs)
        ), far AS (SELECT a, b FROM links JOIN bodies x ON x.page_id = a JOIN bodies y ON y.page_id = b WHERE x.body_md <> y.body_md AND x.page_id = x.first AND y.page_id = y.first
        ), linked AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM far UNION ALL SELECT b FROM far) GROUP BY 1)
        SELECT page_id, coalesce((SELECT min(root) FROM reach r WHERE r.node = page_id), page_id) AS group_id, coalesce(n, 0) AS links
        FROM bodies LEFT JOIN linked ON linked.node = bodies.first""",
    "p1_found": _REACH + " SELECT root AS page_id_a, node AS page_id_b FROM reach WHERE root < node",
    "p5_found": _REACH + _RANKED + """
        SELECT group_id, 'url' AS field_name, page_id FROM ranked WHERE r1 = 1
        UNION ALL SELECT group_id, 'body_md', page_id FROM ranked WHERE r2 = 1
        UNION ALL SELECT group_id, 'excerpt', page_id FROM ranked WHERE r3 = 1 AND e > 0""",
    "p5_choices": _REACH + _RANKED + _CHOICES + " SELECT * FROM choices",
    "p5_constrained": _REACH + _RANKED + _CHOICES + " SELECT bundle, count(*) AS groups, count(*) FILTER (rank > 1) AS constrained FROM choices GROUP BY 1",
    "p6_recall": """
        SELECT count(*) AS queries, true AS reached FROM chunk_vectors
        WHERE vec_id % 20 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p6_found": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[64] AS v FROM chunk_vectors
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), ranked AS (
            SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.v, b.v) AS s,
                   row_number() OVER (PARTITION BY a.vec_id ORDER BY round(array_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS r
            FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
        )
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM ranked WHERE r <= 5 AND s >= 0.85""",
    "p4_found": r"""
        WITH texts AS (
            SELECT 'page_records' AS tbl, page_id AS row_id, body_md AS body FROM page_records
            UNION ALL SELECT 'chunks', chunk_id, regexp_replace(page_content, '^Title: [^\n]*\nSection: [^\n]*\n\n', '') FROM chunks
        )
        SELECT tbl, row_id, CASE WHEN list_max(list_transform(regexp_split_to_array(body, '[\s\v\x1c-\x1f\x85\p{Z}]+'), lambda x: length(x))) > 1500
            THEN 'hard' ELSE 'soft' END AS cut_kind
        FROM texts WHERE length(body) > 2000""",
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 8192",
    "p7_totals": """
        SELECT CAST(ceil(sum(octet_length(encode(text))) / 8192.0) AS BIGINT) AS least_containers, CAST(sum(octet_length(encode(text))) AS BIGINT) AS tokens, true AS within, true AS tight
        FROM documents""",
    "p8_allotted": """
        WITH sized AS (
            SELECT replace(lower(trim(source)), '-', '_') AS source, coalesce(octet_length(encode(text)), 0) AS n FROM documents
        ), own AS (
            SELECT t.source, t.target_share, t.max_repeats, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS tokens
            FROM mix_targets t LEFT JOIN sized s ON s.source = t.source GROUP BY ALL
        ), total AS (SELECT sum(tokens) AS n FROM own)
        SELECT source, tokens AS own_tokens, CAST(least(round_even(target_share * n, 0), max_repeats * tokens) AS BIGINT) AS allotted_tokens,
            max_repeats * tokens < target_share * n AS is_short, true AS reached, true AS within
        FROM own, total""",
    "p8_found": """
        WITH sized AS (
            SELECT replace(lower(trim(source)), '-', '_') AS source, coalesce(octet_length(encode(text)), 0) AS n FROM documents
        ), own AS (
            SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(s.n), 0) AS tokens
            FROM mix_targets t LEFT JOIN sized s ON s.source = t.source GROUP BY ALL
        )
        SELECT source FROM own WHERE max_repeats * tokens < target_share * (SELECT sum(tokens) FROM own)""",
}
