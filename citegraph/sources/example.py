"""A bundled corpus of nine documents with prefix traps, three kinds of dashes and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegraph.sources.folder import in_memory

# DocID: (title, dash of level 1 and 2, sections, entries, citations)
_DOCS = {
    "0.0": ("Charter", "--", "1 2 2.1 2.2 3", "0.0.1 dependency, 0.0.2 dependency, 3.1 dependency, 4.2 dependency, 8.1 authority", "2.1 per 3.1, 2.1 per 4.2, 2.2 see 8.1#3"),
    "0.0.1": ("Glossary", "--", "1 2 3", "4.2 contract", "3 per 4.2#1.1"),
    "0.0.2": ("Roles", "–—", "1 2 3", "0.0 dependency", "3 See 0.0#3"),
    "3.1": ("Intake", "--", "1 1.1 1.2 2 3", "0.0.1 dependency, 8.1 constraint", "3 per 8.1, 3 per 8.1#3"),
    "4.2": ("Ledger", "--", "1 1.1 1.2 2 3", "0.0.1 dependency, 3.1 authority, 4.10 dependency, 8.1 authority", "1.1 see 0.0.1#3, 3 per 4.10"),
    "4.10": ("Archive", "—-", "1 2", "4.2 dependency, 8.1 constraint", "2 see 8.1, 2 see 8.1#3.2"),
    "8.1": ("Scheduling", "--", "1 2 2.1 2.2 3 3.1 3.2", "3.1 dependency, 8.1.3 contract, 8.10 dependency", "2.2 see 3.1#3, 3.2 per 8.1.3, 3.2 per 8.10"),
    "8.1.3": ("Retries", "--", "1 2", "8.1 authority", "1 per 8.1#3.2"),
    "8.10": ("Alarms", "--", "1 2", "4.2 dependency, 8.1 authority", "1 per 8.1#3.2, 2 see 4.2#1"),
}


def texts() -> list[tuple[str, str]]:
    """(path, markdown) of the nine documents."""
    found = []
    for doc, (title, dashes, sections, entries, citations) in _DOCS.items():
        lines = [f"# {doc} {dashes[0]} {title}", "", f"What this collection holds about {title.lower()}."]
        cited: dict[str, list[str]] = {}
        for citation in citations.split(", "):
            section, rest = citation.split(" ", 1)
            cited.setdefault(section, []).append(rest)
        for section in sections.split():
            lines += ["", f"{'#' * (section.count('.') + 2)} {doc}#{section} {dashes[1]} Part {section}", "", f"The details of part {section}."]
            lines += [f"More is written elsewhere, {c}." if i % 2 else f"This holds {c}, among others." if c[0].islower() else f"{c} for more." for i, c in enumerate(cited.get(section, []))]
        lines += ["", "## References", ""]
        for entry in entries.split(", "):
            target, direction = entry.split()
            lines.append(f"- {target} - {_DOCS[target][0]} ({direction} - what {title.lower()} takes from it)")
        found.append((f"{doc.split('.')[0]}/{doc}.md", "\n".join(lines) + "\n"))
    return sorted(found, key=lambda x: x[0].encode("utf-16-be"))


def example_corpus(spark: SparkSession) -> DataFrame:
    return in_memory(spark, texts())
