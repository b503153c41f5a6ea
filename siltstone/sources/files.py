"""Texts from files, pages and images: a router by name and extractors that a caller may add to."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extractor
from .office import hwp_text, pdf_text, xlsx_text

PREVIEW = "Preview/PrvText.txt"


def html_text(source: Column) -> Column:
    """Visible text of a page, as column functions: no scripts, styles or tags, the common entities, single blanks."""
    bare = F.regexp_replace(source, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def hwpx_text(content: bytes) -> str:
    """The preview text of a zipped document; one without it is empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return book.read(PREVIEW).decode("utf-8") if PREVIEW in book.namelist() else ""


def zipped_xml_text(content: bytes, members: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sorted(n for n in book.namelist() if re.fullmatch(members, n))
        found = [re.sub(r"<[^>]+>", "", re.sub(r"</(?:w|a):p>", "\n", book.read(n).decode("utf-8"))) for n in parts]
    return html.unescape("\n".join(found)).strip()


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def page_text(content: bytes) -> str:
    bare = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", plain_text(content))
    return " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split())


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "txt": plain_text,
    "md": plain_text,
    "csv": plain_text,
    "html": page_text,
    "htm": page_text,
    "docx": lambda b: zipped_xml_text(b, r"word/document\.xml"),
    "pptx": lambda b: zipped_xml_text(b, r"ppt/slides/slide\d+\.xml"),
    "hwpx": hwpx_text,
    "hwp": hwp_text,
    "pdf": pdf_text,
    "xlsx": xlsx_text,
}


def read_files(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, name, route, text, status) of the files below a path; a failing or unknown format has a status instead of a text."""
    known = EXTRACTORS | (extractors or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    @F.pandas_udf("struct<text:string,status:string>")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            rows = []
            for name, content in zip(names, contents, strict=True):
                run = known.get(name.lower().rpartition(".")[2])
                try:
                    rows.append((run(content), "ok") if run else (None, "no extractor"))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    rows.append((None, f"failed: {e}"))
            yield pd.DataFrame(rows, columns=["text", "status"])

    return files.withColumn("__x", extract("name", "content")).select("path", "name", extractor(F.col("name")).alias("route"), "__x.text", "__x.status")


def image_text(ocr: str, caption: str) -> str:
    return f"[OCR]\n{ocr}\n\n[Vision]\n{caption}"


def encoded(content: Column) -> Column:
    """Bytes as one line of base64, as a model of images takes them."""
    return F.translate(F.base64(content), "\r\n", "")


def read_images(images: DataFrame, ocr: Callable[[bytes], str], caption: Callable[[bytes], str]) -> DataFrame:
    """(title, content) to (title, url, text); an OCR that fails gives no words."""

    @F.pandas_udf("string")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            out = []
            for content in contents:
                try:
                    words = ocr(content)
                except Exception:  # noqa: BLE001
                    words = ""
                out.append(image_text(words, caption(content)))
            yield pd.Series(out)

    return images.select("title", F.concat(F.lit("image://"), "title").alias("url"), describe("content").alias("text"))


#: Fixed names of a page summary's fields; others are passed over.
PAGE = "title string, extract string, content_urls struct<desktop:struct<page:string>>"


def page_fields(body: Column) -> Column:
    """(title, extract, url) of a page summary's JSON; fields that lack are null, and so are all of a text that is no JSON."""
    page = F.from_json(body, PAGE)
    return F.struct(page["title"].alias("title"), page["extract"].alias("extract"), page["content_urls"]["desktop"]["page"].alias("url"))


def fetch_bodies(requests: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """``fetch_pages`` for a service that answers with a summary's JSON: one call of ``get`` for each title, parsed as columns."""

    @F.pandas_udf("struct<body:string,status:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for titles in batches:
            rows = []
            for title in titles:
                try:
                    rows.append((get(title), "ok"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"failed: {e}"))
            yield pd.DataFrame(rows, columns=["body", "status"])

    named = requests.select(F.trim(F.translate("title", "_", " ")).alias("title"))
    got = named.withColumn("__p", run("title")).select("title", page_fields(F.col("__p.body")).alias("page"), "__p.status")
    return got.select("title", "page.url", F.col("page.extract").alias("summary"), "status")


def fetch_pages(requests: DataFrame, fetch: Callable[[str], dict]) -> DataFrame:
    """(title) to (title, url, summary, status): one call of ``fetch`` for each; _ in a title counts as a blank."""

    @F.pandas_udf("struct<url:string,summary:string,status:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for titles in batches:
            rows = []
            for title in titles:
                try:
                    page = fetch(title)
                    rows.append((page.get("url"), page.get("extract"), "ok"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, f"failed: {e}"))
            yield pd.DataFrame(rows, columns=["url", "summary", "status"])

    named = requests.select(F.trim(F.translate("title", "_", " ")).alias("title"))
    return named.withColumn("__p", run("title")).select("title", "__p.url", "__p.summary", "__p.status")
