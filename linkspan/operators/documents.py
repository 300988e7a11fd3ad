"""Question-and-answer documents: pages, tags, chunks, incremental loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes

_BLANK = codes.WHITESPACE + "\u001c\u001d\u001e\u001f"
_QUESTION = r"(?s)^Q:\s*(.*?)(?=\n\n|\n<query>|$)"
_QUERY = "<query>"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _tidy(text: Column) -> Column:
    return F.regexp_replace(_trim(text), "\n{3,}", "\n\n")


def _tagged(pages: Column) -> Column:
    """An array of pages tagged, each as `tag_page` does it.

    One transform a step: a value that later steps use more than once is made once a page.
    """
    tidy = F.transform(pages, _tidy)
    asked = F.transform(tidy, lambda p: F.struct(
        p.alias("tidy"), F.when(p.startswith("Q:"), F.regexp_extract(p, _QUESTION, 0)).alias("whole"),
    ))
    cut = F.transform(asked, lambda p: F.struct(
        p["tidy"].alias("tidy"), p["whole"].alias("whole"),
        _trim(F.substring(p["tidy"], F.length(p["whole"]) + 1, F.length(p["tidy"]))).alias("rest"),
    ))
    placed = F.transform(cut, lambda p: F.struct(
        p["tidy"].alias("tidy"), p["whole"].alias("whole"), p["rest"].alias("rest"), F.instr(p["rest"], _QUERY).alias("at"),
    ))
    parts = F.transform(placed, lambda p: F.struct(
        p["tidy"].alias("tidy"), _trim(F.regexp_replace(p["whole"], r"^Q:\s*", "")).alias("question"),
        _trim(F.when(p["at"] > 0, F.substring(p["rest"], F.lit(1), p["at"] - 1)).otherwise(p["rest"])).alias("answer"),
        F.when(p["at"] > 0, F.substring(p["rest"], p["at"], F.length(p["rest"]))).otherwise("").alias("query"),
    ))
    return F.transform(parts, lambda p: F.when(p["question"].isNotNull(), _trim(F.concat(
        F.lit("<question>"), p["question"], F.lit("</question>\n"),
        F.when(p["answer"] != "", F.concat(F.lit("<answer>"), p["answer"], F.lit("</answer>\n"))).otherwise(""),
        p["query"],
    ))).otherwise(p["tidy"]))


def tag_page(text: Column) -> Column:
    """A page without superfluous blank lines, its question and answer tagged.

    A page that starts with "Q:" gets <question> up to the first blank line,
    <answer> for what follows, and keeps its <query> tail.
    """
    return F.element_at(_tagged(F.array(text)), 1)


def content_type(path: Column) -> Column:
    """Kind of a document from its path."""
    return (
        F.when(path.contains("markdown") | path.contains(".md"), "text")
        .when(path.contains("tables"), "tables")
        .when(path.contains("images_desc"), "image")
        .otherwise("unknown")
    )


def document_name(path: Column) -> Column:
    """File name, or for tables and image descriptions the folder's name."""
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    return F.when(content_type(path).isin("tables", "image"), folder).otherwise(
        F.element_at(parts, -1)
    )


def describe_documents(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Add doc_name, content_type, source_file and file_hash."""
    return documents.withColumns({
        "doc_name": document_name(F.col(path)),
        "content_type": content_type(F.col(path)),
        "source_file": document_name(F.col(path)),
        "file_hash": F.sha2(F.col(text), 256),
    })


def chunk_documents(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks of all text documents with their metadata and hashes.

    Numbers count the non-empty pages of a document.
    """
    texts = describe_documents(documents, path, text).filter(F.col("content_type") == "text")
    raw = F.split(F.col(text), F.lit(r"\Q" + codes.PAGE_BREAK + r"\E"))
    pages = F.filter(_tagged(raw), lambda p: p != "")
    return (
        texts.select(
            path, "doc_name", "content_type", "source_file", "file_hash",
            F.posexplode_outer(pages).alias("position", "page_content"),
        )
        .select(
            path, "doc_name", "content_type", "source_file", "file_hash",
            (F.col("position") + 1).alias("faq"), "page_content",
            F.sha2("page_content", 256).alias("chunk_hash"),
        )
        .filter(F.col("page_content").isNotNull())  # documents without any page
    )


def known_hashes(store: DataFrame, name: str) -> DataFrame:
    return store.select(name).filter(F.col(name).isNotNull()).distinct()


def new_chunks(documents: DataFrame, store: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks to add to a store: unchanged files are skipped, then chunks the
    store already has.  Repeats inside one load are kept."""
    fresh = documents.withColumn("file_hash", F.sha2(F.col(text), 256)).join(
        known_hashes(store, "file_hash"), "file_hash", "left_anti"
    )
    return chunk_documents(fresh.drop("file_hash"), path, text).join(
        known_hashes(store, "chunk_hash"), "chunk_hash", "left_anti"
    )
