"""The one opaque stage: Markdown in, one row of nested facts for each document out. Everything after it is relational."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from citegraph.markdown import plain

RANGE = "struct<start_line:int,start_character:int,end_line:int,end_character:int>"
HEADING = (
    f"struct<depth:int,text:string,range:{RANGE},references:boolean,obstruction:string,issue:string,section_id:string,title:string,"
    "parent_id:string,expected_id:string,extracted:boolean>"
)
ENTRY = f"struct<text:string,range:{RANGE},problem:string,target:string,title:string,direction:string,explanation:string,obstruction:string>"
CITATION = f"struct<keyword:string,kind:string,candidate:string,target:string,conforms:boolean,splitter:string,literal:boolean,range:{RANGE},context:string>"
REFERENCES = f"struct<nested:boolean,obstruction:string,range:{RANGE}>"
PARSED = (
    f"uri string, doc_ord long, version int, unparsable string, headings array<{HEADING}>, refs {REFERENCES}, entries array<{ENTRY}>, citations array<{CITATION}>"
)
#: Documents of a worker's slice; a single larger document is a slice of its own.
SLICE = 256


def _structs(rows: Sequence[tuple], kind: pa.DataType) -> pa.StructArray:
    """Tuples as structs, a column at a time: dictionaries for each row would cost several times as much as the parse."""
    columns = zip(*rows) if rows else [() for _ in kind]
    arrays = [_structs(values, f.type) if pa.types.is_struct(f.type) else pa.array(values, f.type) for f, values in zip(kind, columns)]
    return pa.StructArray.from_arrays(arrays, fields=list(kind))


def _lists(lists: Sequence[Sequence[tuple]], kind: pa.DataType) -> pa.ListArray:
    offsets = [0, *accumulate(map(len, lists))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs([row for rows in lists for row in rows], kind.value_type), type=kind)


def _optional(rows: Sequence[tuple | None], kind: pa.DataType) -> pa.StructArray:
    names = [f.name for f in kind]
    inner = kind.field("range").type
    named = lambda row: dict(zip(names, row)) | {"range": dict(zip((f.name for f in inner), row[names.index("range")]))}
    return pa.array([row and named(row) for row in rows], kind)


def parse_documents(documents: DataFrame, most_characters: int | None = None, kept: Sequence[str] = (), facts: Sequence[str] = plain.FACTS) -> DataFrame:
    """documents(uri, doc_ord, markdown, version) -> parsed, and the columns ``kept`` as they are.

    A document that breaks the parser, or exceeds a budget of characters where a host sets one, carries the reason in
    ``unparsable`` and no facts; the others go on. A null text is empty. Every document is read as a whole; of the
    ``facts`` that aren't asked for the lists stay empty, but level-1 headings always come.
    """
    schema = T._parse_datatype_string(PARSED)
    for name in kept:
        schema = schema.add(documents.schema[name])
    arrow = to_arrow_schema(schema)
    wanted = frozenset(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                unparsable, found = [], []
                for markdown in part.column(3).to_pylist():
                    try:
                        found.append(plain.extract_rows(markdown or "", most_characters, wanted))
                        unparsable.append(None)
                    except Exception as broken:  # one bad document never stops the corpus
                        found.append(([], None, [], []))
                        unparsable.append(f"{type(broken).__name__}: {broken}"[:200])
                headings, refs, entries, citations = zip(*found)
                kind = lambda name: arrow.field(name).type
                columns = [
                    part.column(0), part.column(1), part.column(2), pa.array(unparsable, pa.string()), _lists(headings, kind("headings")), _optional(refs, kind("refs")),
                    _lists(entries, kind("entries")), _lists(citations, kind("citations")), *part.columns[4:],
                ]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    version = F.col("version") if "version" in documents.columns else F.lit(None)
    return documents.select("uri", F.col("doc_ord").cast("long"), version.cast("int"), "markdown", *kept).mapInArrow(run, schema)


def headings(parsed: DataFrame) -> DataFrame:
    return parsed.select("uri", "doc_ord", F.posexplode("headings").alias("ord", "h")).select("uri", "doc_ord", "ord", "h.*")


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.select("uri", "doc_ord", F.posexplode("entries").alias("ord", "e")).select("uri", "doc_ord", "ord", "e.*")


def citations(parsed: DataFrame) -> DataFrame:
    return parsed.select("uri", "doc_ord", F.posexplode("citations").alias("ord", "c")).select("uri", "doc_ord", "ord", "c.*")
