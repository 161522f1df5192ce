"""A data source of pages: files in, a row a page out; text engines are injected."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: bytes of a file -> the texts of its pages.  May raise Encrypted, or anything else for a file that it can't read.
Engine = Callable[[bytes], list[str]]
PAGES = "path string, engine string, page int, text string, sha256 string, error string"


class Encrypted(Exception):
    """The file wants a password."""


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def page_rows(path: str, data: bytes, engines: list[tuple[str, Engine]], least_chars: int = 100) -> Iterator[tuple]:
    """The pages of a file by the first engine that reads it with `least_chars` characters; the last one's result stands whatever it finds.

    A file that no engine reads, and an encrypted one, is one row with its error and no page; one without pages is a row with neither.
    """
    error = "no engine"
    for at, (name, engine) in enumerate(engines):
        try:
            texts = [t or "" for t in engine(data)]
        except Encrypted as e:
            yield path, name, None, None, None, f"encrypted: {e}"[:200]
            return
        except Exception as e:  # a damaged file is a row, not the end of the job
            error = f"corrupted: {type(e).__name__}: {e}"[:200]
            continue
        # Pages are joined by newlines, which count.
        if sum(map(len, texts)) + max(0, len(texts) - 1) >= least_chars or at == len(engines) - 1:
            for page, text in enumerate(texts) if texts else [(None, None)]:
                yield path, name, page, text, None if text is None else hashlib.sha256(text.encode()).hexdigest(), None
            return
    yield path, None, None, None, None, error


def page_source(engines: list[tuple[str, Engine]], name: str = "lexmill_pages") -> type[DataSource]:
    """A DataSource class for spark.dataSource.register: options are path (a folder or file of any file system that pyarrow opens), suffix (.pdf) and partition_bytes.

    A partition is a range of the files in the order of their names, of about partition_bytes; a file is read by the task that lists it and is never held with others.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.suffix = options["path"], options.get("suffix", ".pdf").lower()
            self.bytes = int(options.get("partition_bytes", 64 << 20))

        def partitions(self) -> list[InputPartition]:
            fs, top = pyarrow.fs.FileSystem.from_uri(self.path)
            info = fs.get_file_info(top)
            found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True))
            out, size = [[]], 0
            for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(self.suffix)), key=lambda f: f.path):
                if out[-1] and size + f.size > self.bytes:
                    out.append([])
                    size = 0
                out[-1].append(f.path)
                size += f.size
            return [_Files(paths) for paths in out]

        def read(self, partition: _Files) -> Iterator[tuple]:
            fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
            for path in partition.paths:
                try:
                    with fs.open_input_stream(path) as stream:
                        data = stream.read()
                except OSError as e:
                    yield path, None, None, None, None, f"unreadable: {e}"[:200]
                    continue
                yield from page_rows(path, data, engines)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(self.options)

    return Pages


def read_pages(spark: SparkSession, path: str, engines: list[tuple[str, Engine]], suffix: str = ".pdf", partition_bytes: int = 64 << 20) -> DataFrame:
    """Pages of the files under a path (a URI or an absolute path), see page_source."""
    name = f"lexmill_pages_{uuid.uuid4().hex[:8]}"
    spark.dataSource.register(page_source(engines, name))
    return spark.read.format(name).option("path", path).option("suffix", suffix).option("partition_bytes", partition_bytes).load()


def keep_longer(pages: DataFrame, ocr: DataFrame, least_text: int = 100, least_mean: int = 20) -> DataFrame:
    """(doc_id, page, text, engine, replaced) of documents after full OCR: where a document has too little text (in all, or a page) and its OCR has strictly more
    characters, pages joined by newlines, all its pages are those of the OCR; else they stay.

    pages(doc_id, page, text, engine) and ocr(doc_id, page, text).
    """
    chars = lambda df: df.groupBy("doc_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("chars"), F.count("*").alias("n_pages"))
    own, other = chars(pages), chars(ocr).select("doc_id", F.col("chars").alias("ocr_chars"))
    little = (F.col("chars") < least_text) | (F.col("chars") / F.greatest("n_pages", F.lit(1)) < least_mean)
    verdict = own.join(other, "doc_id", "left").select("doc_id", F.coalesce(little & (F.col("ocr_chars") > F.col("chars")), F.lit(False)).alias("replaced"))
    kept = pages.join(verdict.where("not replaced"), "doc_id").select("doc_id", "page", "text", "engine", "replaced")
    new = ocr.join(verdict.where("replaced"), "doc_id").select("doc_id", "page", "text", F.lit("ocr").alias("engine"), "replaced")
    return kept.union(new)


def assemble(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, text, n_pages, n_chars, hashes) of pages(doc_id, page, text): the pages of each document in their order, with each page's sha256."""
    one = F.struct("page", F.coalesce("text", F.lit("")).alias("text"))
    out = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return out.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"), F.size("p").cast("long").alias("n_pages"),
                      F.transform("p", lambda x: F.sha2(x["text"], 256)).alias("hashes")).withColumn("n_chars", F.length("text").cast("long"))
