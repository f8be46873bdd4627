"""Page records from the JSON embedded in fetched pages.

Values fall back as the page's author would see them: an empty slug or title gives way to the
frontier's, while hidden and deprecated only do where the key is missing. API documents are kept for
reference pages only, reduced to five keys, and are null without paths and schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators.records import embedded_props

# Keys kept of an API document, and the category of release notes.
OAS_KEYS = ("openapi", "info", "servers", "paths", "components")
CHANGELOG_CATEGORY = ("Release Notes", "changelog", "changelog")


def at(props: Column, path: str) -> Column:
    return F.get_json_object(props, f"$.{path}")


def flag(props: Column, path: str, otherwise: Column) -> Column:
    """A boolean by key: the fallback counts only where the key is missing."""
    return F.coalesce(at(props, path).try_cast("boolean"), otherwise, F.lit(False))


def category(props: Column) -> Column:
    c = lambda key: at(props, f"doc.category.{key}")
    return F.when(
        at(props, "doc.category").isNotNull(),
        F.struct(c("title").alias("title"), c("slug").alias("slug"), c("type").alias("type"), F.coalesce(c("_id"), c("id")).alias("id")),
    )


def oas_summary(oas: Column) -> Column:
    """The kept keys of an API document as JSON, null where it has neither paths nor schemas."""
    size = lambda path: F.coalesce(F.size(F.json_object_keys(F.get_json_object(oas, path))), F.lit(0))
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.get_json_object(oas, f"$.{k}") if k in ("info", "servers", "paths", "components") else F.concat(F.lit('"'), F.get_json_object(oas, f"$.{k}"), F.lit('"')), F.lit("{}" if k == "components" else "null"))) for k in OAS_KEYS]
    return F.when((size("$.paths") > 0) | (size("$.components.schemas") > 0), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def extract_records(fetched: DataFrame) -> DataFrame:
    """Records of fetched pages (html and the frontier's columns, base_url, section, source); pages without any give none."""
    p = F.col("props")
    rows = fetched.withColumn("props", embedded_props(F.col("html"))).filter(p.isNotNull())
    listed = F.from_json(at(p, "changelogs"), "array<struct<slug:string,title:string,body:string,type:string,hidden:boolean,updatedAt:string,createdAt:string>>")
    match = F.to_json(F.get(F.filter(listed, lambda c: c["slug"] == F.col("slug")), F.lit(0)))
    is_log = F.col("kind") == "changelog"
    rows = rows.withColumn("log", F.when(is_log, F.coalesce(at(p, "changelog"), match, at(p, "doc"))))
    log, custom = F.col("log"), at(p, "doc").isNull() & at(p, "custompage").isNotNull()
    shape = F.when(is_log & log.isNotNull(), "changelog").when(~is_log & at(p, "doc").isNotNull(), "doc").when(~is_log & custom, "custompage")
    rows = rows.withColumn("shape", shape).filter(F.col("shape").isNotNull())

    def pick(key: str) -> Column:
        return F.when(F.col("shape") == "changelog", F.get_json_object(log, f"$.{key}")).when(F.col("shape") == "doc", at(p, f"doc.{key}")).otherwise(at(p, f"custompage.{key}"))

    def held(key: str) -> Column:
        """What a doc page has beside its body, as JSON text; null where it is empty."""
        value = at(p, f"doc.{key}")
        return F.when((F.col("shape") == "doc") & ~value.isin("", "{}", "[]", "false"), value)

    reference = (F.col("kind") == "reference") & (F.col("shape") == "doc")
    body = F.coalesce(pick("body"), F.lit(""))
    clean = T.rewrite_body(body, F.col("base_url"), F.col("section"))
    fixed = F.struct(*(F.lit(v).alias(k) for k, v in zip(("title", "slug", "type"), CHANGELOG_CATEGORY)), F.lit(None).cast("string").alias("id"))
    return rows.select(
        "source", "section",
        F.when(F.col("shape") == "custompage", "custompage").otherwise(F.col("kind")).alias("kind"),
        T.or_else(pick("slug"), F.col("slug")).alias("slug"),
        T.or_else(pick("title"), F.col("title")).alias("title"),
        "url",
        F.when(F.col("shape") == "changelog", fixed).when(F.col("shape") == "doc", category(p)).alias("category"),
        "parent_slug", "breadcrumb",
        F.coalesce(pick("hidden").try_cast("boolean"), F.col("hidden"), F.lit(False)).alias("hidden"),
        F.coalesce(pick("deprecated").try_cast("boolean"), F.col("deprecated"), F.lit(False)).alias("deprecated"),
        F.when(F.col("shape") == "custompage", "custompage").otherwise(pick("type")).alias("type"),
        flag(p, "doc.isApi", F.lit(False)).alias("is_api"),
        flag(p, "doc.isReference", F.lit(False)).alias("is_reference"),
        F.coalesce(pick("excerpt"), F.lit("")).alias("excerpt"),
        clean.alias("body_md"), F.length(clean).alias("body_md_chars"), F.length(body).alias("raw_body_chars"),
        pick("updatedAt").alias("updated_at"), pick("createdAt").alias("created_at"), pick("revision").alias("revision"),
        F.when(reference, oas_summary(at(p, "oasDefinition"))).alias("oas"),
        F.when(reference, at(p, "oasPublicUrl")).alias("oas_public_url"),
        at(p, "doc.api").alias("doc_api"),
        held("reusableContent").alias("reusable_content"),
        held("tutorials").alias("doc_tutorials"),
        F.when(F.col("shape") == "custompage", F.length(F.coalesce(at(p, "custompage.html"), F.lit("")))).alias("html_chars"),
        F.when(F.col("shape") == "custompage", flag(p, "custompage.fullscreen", F.lit(False))).alias("fullscreen"),
    )
