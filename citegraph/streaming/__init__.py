"""Incremental lint with Structured Streaming: documents are parsed and judged as they arrive.

The rules of a single document need no state, so they run batch by batch; the corpus pass needs the whole index and runs
over the table of extractions that the stream has written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citegraph.plans.parse import PARSED, parse_documents
from citegraph.plans.validate import CorpusResult

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Parsed rows as a stream writes them: with the time of the file, or of the batch, that they come from.
WRITTEN = PARSED + ", written timestamp"


def parsed_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """documents (a stream of uri, doc_ord, markdown, version and perhaps ``written``) -> parsed rows appended under ``out``, once each."""

    def append(batch: DataFrame, number: int) -> None:
        when = F.col("written") if "written" in batch.columns else F.current_timestamp()
        rows = batch.withColumn("written", when)
        parsed = parse_documents(rows, kept=("written",))
        # A batch that is run again after a failure writes the same folder again.
        parsed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(source, path):
    return source.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)


def _plain(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _documents(files: DataFrame, root: str) -> DataFrame:
    """uri (the path from the root on), doc_ord, markdown, version, written. Order is that of uris; a text is read as a whole."""
    return files.select(
        relative(_plain(F.col("path")), root).alias("uri"), F.lit(0).cast("long").alias("doc_ord"), F.col("content").cast("string").alias("markdown"), F.lit(None).cast("int").alias("version"),
        F.col("modificationTime").alias("written"),
    )


def folder_stream(spark, path: str) -> DataFrame:
    """Markdown files below a folder as a stream. Spark's file source takes each name once; ``refresh`` also reads what was written anew."""
    return _documents(_files(spark.readStream, path), path)


def refresh(spark, path: str, out: str) -> int:
    """Parse the files of a folder that ``out`` doesn't hold at their present time, and append them there; how many.

    Listing reads no contents. Only names of changed files pass through the driver, which lists folders anyway.
    """
    listed = _files(spark.read, path).select("path", relative(_plain(F.col("path")), path).alias("uri"), F.col("modificationTime").alias("written"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    started = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    number = 0
    if started:
        seen = spark.read.schema(WRITTEN + ", batch long").parquet(out)
        number = (seen.agg(F.max("batch")).head()[0] or 0) + 1
        listed = listed.join(seen.select("uri", "written"), ["uri", "written"], "left_anti")
    changed = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in listed.select("path").toLocalIterator()]
    if changed:
        parse_documents(_documents(_files(spark.read, changed), path), kept=("written",)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return len(changed)


def relative(whole, folder: str):
    """The part of a path behind a folder, which a scheme may precede in either."""
    plain = F.regexp_replace(whole, "^[a-z][a-z0-9+.-]*:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return F.substring(plain, F.lit(len(root) + 1), F.length(plain))


def corpus_of(spark, out: str) -> CorpusResult:
    """The validation of everything a stream has written so far; a document written again counts as it came last."""
    spark.catalog.refreshByPath(out)  # else Spark answers with what an earlier call has cached
    rows = spark.read.schema(WRITTEN + ", batch long").parquet(out)
    fields = [f for f in rows.columns if f not in ("uri", "written", "batch")]
    # The latest row of each uri: aggregated on the map side, without a sort of all versions.
    newest = rows.groupBy("uri").agg(F.max_by(F.struct(*fields), F.struct("written", "batch")).alias("row")).select("uri", "row.*")
    ordered = newest.withColumn("doc_ord", F.xxhash64("uri")) if newest.filter("doc_ord <> 0").isEmpty() else newest
    return CorpusResult(ordered.persist(), True)
