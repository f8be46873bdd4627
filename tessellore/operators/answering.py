"""From a question to an answer: hits, gated endpoints, prompt, language model, response."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.runtime import strip

# Fixed values of the prompt's layout.
NOTHING_FOUND = "(no documentation matched this query)"
SYSTEM = "Answer from the documentation below and cite its sources; say so if it doesn't hold the answer."


def source_text():
    """One hit as a numbered source."""
    title = T.or_else(F.col("title"), F.lit("(untitled)"))
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] Title: "), title, F.lit("  •  Section: "), T.joined_breadcrumb(F.col("breadcrumb")))
    return F.concat(head, F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\n\n"), strip(F.coalesce("page_content", F.lit(""))))


def endpoint_text():
    """One endpoint with its folder and the first line of its description."""
    said = strip(F.coalesce("description", F.lit("")))
    lines = F.array(
        F.concat(F.lit("- "), F.concat_ws(" ", "method", "url"), F.lit(" — "), F.col("name")),
        F.when(F.size("folder_path") > 0, F.concat(F.lit("  Folder: "), F.array_join("folder_path", " > "))),
        F.when(said != "", F.concat(F.lit("  "), T.first_line(said))),
    )
    return F.array_join(F.array_compact(lines), "\n")


def ordered_text(rows: DataFrame, order: str, text, between: str) -> DataFrame:
    """One row: the rows' texts in order. Only ever used on a handful of hits."""
    listed = rows.select(F.struct(F.col(order).alias("o"), text.alias("t")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("all"))
    return listed.select(F.array_join(F.transform("all", lambda x: x["t"]), between).alias("text"))


def prompt(question: str, hits: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """The prompt for a question from its hits (rank, title, breadcrumb, url, page_content) and endpoints (place, method, url, name, folder_path, description)."""
    found = ordered_text(hits, "rank", source_text(), "\n---\n").select(T.or_else(F.col("text"), F.lit(NOTHING_FOUND)).alias("sources"))
    shown = found.withColumn("listed", F.lit(""))
    if endpoints is not None:
        shown = found.crossJoin(ordered_text(endpoints, "place", endpoint_text(), "\n").withColumnRenamed("text", "listed"))  # one row each
    block = F.when(F.col("listed") != "", F.concat(F.lit("\n\n## Relevant API endpoint(s)\n"), "listed")).otherwise("")
    return shown.select(F.concat(F.lit(f"{SYSTEM}\n\n## Documentation\n"), "sources", block, F.lit(f"\n\n## Question\n{question.strip()}\n\n## Answer")).alias("prompt"))


def sources(hits: DataFrame) -> DataFrame:
    """Hits as a response shows them."""
    return hits.select("rank", "title", "url", "kind", "breadcrumb", T.preview(F.col("page_content")).alias("preview"), F.col("page_content").alias("full_content"), "score")


@dataclass
class Answer:
    """A response: the answer's text with what it rests on."""

    answer: str
    sources: list[dict]
    relevant_endpoints: list[dict]


def answer(question: str, hits: DataFrame, endpoints: DataFrame | None, model: Callable[[str], str]) -> Answer:
    """Ask a language model; the hits, a handful of rows, are the only data that reach the driver."""
    if len(question) < 1:
        raise ValueError("an empty question")
    text = prompt(question, hits, endpoints).first()["prompt"]
    listed = [] if endpoints is None else [r.asDict() for r in endpoints.orderBy("place").select("name", "method", F.col("url").alias("path"), strip(F.coalesce("description", F.lit(""))).alias("description"), "folder_path").collect()]
    return Answer(model(text), [r.asDict() for r in sources(hits).orderBy("rank").drop("rank").collect()], listed)


def quoting_model(prompt_text: str) -> str:
    """An offline stand-in for a language model: it returns the first source."""
    return prompt_text.partition("[Source 1]")[2].partition("\n---\n")[0].partition("\n\n## ")[0].strip() or NOTHING_FOUND
