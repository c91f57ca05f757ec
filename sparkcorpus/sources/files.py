"""Files to text by suffix, uploads, and the text codecs of interchange files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sparkcorpus.functions.arrow import arrow

from sparkcorpus.functions.text import base_name, suffix_of
from sparkcorpus.sources.html import to_text

ALLOWED = ("pdf", "docx", "txt", "md", "markdown", "html", "htm", "csv", "json", "log")


class UnsupportedSource(ValueError):
    """A kind of file that needs a library which is not there."""


def clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def csv_cells(line: str) -> list[str]:
    """Cells of one line; every quote toggles, and none is kept."""
    out, quoted = [""], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def csv_to_text(text: str) -> str:
    return "\n".join(" | ".join(csv_cells(x)) for x in text.replace("\r\n", "\n").split("\n") if x.strip())


def docx_to_text(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    parts = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return "\n".join("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts) for p in tree.iter(f"{w}p"))


def file_to_text(data: bytes, suffix: str) -> str:
    if suffix == "pdf":
        raise UnsupportedSource("no PDF library is installed; register an extractor")
    if suffix == "docx":
        return clean(docx_to_text(data))
    text = data.decode("utf-8", errors="replace")
    if suffix in ("html", "htm"):
        return clean(to_text(text))
    return clean(csv_to_text(text)) if suffix == "csv" else clean(text)


def text_column(extractors: dict | None = None):
    """A function of (bytes, suffix) to a struct of text and error; `extractors` adds kinds of file."""
    more = dict(extractors or {})

    @arrow("struct<text:string,error:string>")
    def extract(data: pd.Series, suffix: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s in zip(data, suffix, strict=True):
            try:
                rows.append(((more[s](d) if s in more else file_to_text(d, s)), None))
            except Exception as e:  # noqa: BLE001  a bad file must not end the job; its row says why
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return extract


def read_files(spark: SparkSession, path: str, allowed: tuple | None = None, extractors: dict | None = None) -> DataFrame:
    """(path, name, suffix, bytes, content_hash, text, error) of files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), "content").withColumn("suffix", suffix_of(F.col("name")))
    if allowed is not None:
        files = files.filter(F.col("suffix").isin(*allowed))
    out = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("x", text_column(extractors)("content", "suffix"))
    return out.select("path", "name", "suffix", "bytes", "content_hash", "x.text", "x.error")


def uploads(df: DataFrame, allowed: tuple = ALLOWED, most_bytes: int = 50 << 20) -> DataFrame:
    """Rows (name, content) that may be stored, as documents with an id of 12 hex digits and status `stored`."""
    suffix = suffix_of(F.col("name"))
    rows = df.withColumn("suffix", suffix).withColumn("bytes", F.length("content").cast("long")).filter(F.col("suffix").isin(*allowed) & (F.col("bytes") <= most_bytes) & (F.col("bytes") > 0))
    return rows.withColumns({"id": F.substring(F.sha2(F.concat(F.encode("name", "UTF-8"), F.lit(b"\0"), F.col("content")), 256), 1, 12), "status": F.lit("stored"), "source_kind": F.lit("upload")})


ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
UNESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "\\": "\\"}


def copy_escape(text: str | None) -> str:
    return "\\N" if text is None else re.sub(r"[\\\n\r\t]", lambda m: ESCAPES[m.group()], text)


def copy_unescape(field: str) -> str | None:
    """One pass over a field: what an escape gives is not read again."""
    return None if field == "\\N" else re.sub(r"\\(.)", lambda m: UNESCAPES.get(m.group(1), m.group(1)), field)


@arrow("array<string>")
def copy_row(line: pd.Series) -> pd.Series:
    return line.map(lambda x: [copy_unescape(f) for f in x.split("\t")])


def read_copy(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    rows = spark.read.text(path).filter(F.col("value") != "\\.").select(copy_row("value").alias("f"))
    return rows.select(*[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


@arrow("string")
def copy_line(fields: pd.Series) -> pd.Series:
    return fields.map(lambda f: "\t".join(copy_escape(x) for x in f))


def write_copy(df: DataFrame, path: str) -> None:
    df.select(copy_line(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("value")).write.mode("overwrite").text(path)


def attach_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str] = ("chunk_id", "seq")) -> DataFrame:
    """Rows with the vectors of a bulk load; `missing_vectors` tells what it left out."""
    return chunks.drop("embedding").join(vectors.select(*keys, "embedding"), list(keys), "left")


def missing_vectors(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNull())


def text_only(c: Column) -> Column:
    return F.decode(c, "UTF-8")


CASES = "schema string, name string, kind string, judge string, note string, cases array<struct<id:string,doc:string,q:string,topic:string,cat:string,targets:array<struct<excerpt:string,doc:string,seq_hint:int,doc_names:array<string>>>>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(set, kind, judge, case, case_doc, question, target, excerpt, target_doc, doc_names): a row for each target of
    each case of JSON case sets; a case without targets has one row with a null target."""
    sets = spark.read.schema(CASES).json(path, multiLine=True)
    rows = sets.select(F.col("name").alias("set"), F.coalesce("kind", F.lit("retrieval")).alias("kind"), F.coalesce("judge", F.lit("all-hit")).alias("judge"), F.explode("cases").alias("c"))
    rows = rows.select("set", "kind", "judge", F.col("c.id").alias("case"), F.col("c.doc").alias("case_doc"), F.col("c.q").alias("question"), F.posexplode_outer("c.targets").alias("target", "t"))
    return rows.select("set", "kind", "judge", "case", "case_doc", "question", "target", F.col("t.excerpt").alias("excerpt"), F.col("t.doc").alias("target_doc"), F.col("t.doc_names").alias("doc_names"))
