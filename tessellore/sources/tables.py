"""Readers and writers: JSON lines, API collections, the page cache, index artifacts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.functions import text as T

RECORD_SCHEMA = (
    "source string, section string, kind string, slug string, title string, url string, category struct<title:string,slug:string,type:string,id:string>, parent_slug string, breadcrumb array<string>, "
    "hidden boolean, deprecated boolean, type string, is_api boolean, is_reference boolean, excerpt string, body_md string, body_md_chars int, raw_body_chars int, updated_at string, created_at string, revision string, "
    "discovered_via string, oas string, oas_public_url string, doc_api string, reusable_content string, doc_tutorials string, html_chars int, fullscreen boolean"
)
MANIFEST_SCHEMA = "url string, slug string, kind string, fetched_at string, discovered_via string, http_status int, cache_hit boolean, body_hash string, error string"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a bad line is an error. Nested JSON stays text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """API collections, one whole document a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "collection")


def _read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as fs

    for batch in batches:
        pages = []
        for root, name in zip(batch["root"], batch["name"]):
            system, inner = fs.FileSystem.from_uri(root)
            with system.open_input_stream(f"{inner}/{name}") as source:
                pages.append(source.read().decode("utf-8", "replace"))
        yield pd.DataFrame({"cache_key": batch["name"].str.removesuffix(".html"), "html": pages})


def _cache_uri(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def _write_pages(uri: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        system, inner = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for key, page in zip(batch["cache_key"], batch["html"]):
                folder = f"{inner}/{key}".rpartition("/")[0]
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{inner}/{key}.html") as out:
                    out.write(page.encode("utf-8", "replace"))
            yield pd.DataFrame({"written": [len(batch)]})

    return write


def write_page_cache(pages: DataFrame, root: str) -> int:
    """Write pages (url, html) to the cache, a file each, and return how many; addresses with one path share a file, rows without page are left out.

    Files are replaced as a whole, so a task that is run again changes nothing.
    """
    keyed = pages.select(T.url_cache_key(F.col("url")).alias("cache_key"), "html").filter("cache_key IS NOT NULL AND html IS NOT NULL")
    one = keyed.groupBy("cache_key").agg(F.max("html").alias("html"))
    return one.mapInPandas(_write_pages(_cache_uri(root)), "written bigint").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def _list_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as fs

    for batch in batches:
        for root, part in zip(batch["root"], batch["part"]):
            system, inner = fs.FileSystem.from_uri(root)
            files = system.get_file_info(fs.FileSelector(f"{inner}/{part}" if part else inner, recursive=bool(part), allow_not_found=True))
            names = [f.path[len(inner) + 1 :] for f in files if f.is_file and f.path.endswith(".html")]
            yield pd.DataFrame({"root": root, "name": names}, dtype=object)


def read_page_cache(spark: SparkSession, root: str) -> DataFrame:
    """Cached pages: cache_key (the path below the root, without .html) and html.

    The engine's own listing leaves out names that begin with an underscore, which index pages do. Only the
    folders right below the root are listed here; what is in them is listed and read by the workers.
    """
    import pyarrow.fs as fs

    uri = _cache_uri(root)
    system, inner = fs.FileSystem.from_uri(uri)
    parts = [""]  # the files right below the root, then whole folders
    for top in (f for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if not f.is_file):
        parts.append(top.path[len(inner) + 1 :])
    folders = spark.createDataFrame([(uri, p) for p in parts], "root string, part string").repartition(len(parts))
    names = folders.mapInPandas(_list_pages, "root string, name string").repartition(max(8, len(parts)))
    return names.mapInPandas(_read_pages, "cache_key string, html string")


def cached_pages(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Addresses with their cached page, null where there is none."""
    return urls.withColumn("cache_key", T.url_cache_key(F.col("url"))).join(cache, "cache_key", "left").withColumn("cache_hit", F.col("html").isNotNull())


def read_env_file(path: str | None) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and a missing file are nothing, quotes around a value go."""
    if path is None or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as source:
        pairs = (line.removeprefix("export ").partition("=") for line in map(str.strip, source) if line and not line.startswith("#"))
        return {name.strip(): value.strip().strip("\"'") for name, found, value in pairs if found}


@dataclass(frozen=True)
class Settings:
    """Where things are and how much is retrieved; the environment may say otherwise."""

    store: str | None = None
    retrieval_k: int = 5
    rrf_k: int = 60
    depth: int = 20

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, file: str | None = None) -> Settings:
        """Settings of the environment; what it leaves open may stand as NAME=value lines in a file."""
        env = read_env_file(file) | dict(os.environ if env is None else env)
        return cls(env.get("VECTOR_STORE_PATH"), int(env.get("RETRIEVAL_K", 5)), int(env.get("RRF_K", 60)), int(env.get("RRF_INPUT_DEPTH", 20)))


def locate_store(settings: Settings, here: str = ".", remote: str | None = None) -> str:
    """The index folder: the one that is set (which must exist), else ./vector_store, else the remote one."""
    if settings.store:
        if "://" not in settings.store and not os.path.isdir(settings.store):
            raise FileNotFoundError(settings.store)
        return settings.store
    local = os.path.join(here, "vector_store")
    if os.path.isdir(local):
        return local
    if remote:
        return remote
    raise FileNotFoundError("no index folder")
