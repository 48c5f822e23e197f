"""From raw pages to the tables of chunks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagegrain.operators import atoms, layout
from pagegrain.operators.atoms import ParseOptions
from pagegrain.sources.raw import at_page


def parsed_pages(raw: DataFrame, **flags: bool) -> DataFrame:
    """One row for each page with its ``atoms`` and ``nodes``; nothing is shuffled. Streams may be parsed too.

    ``flags`` are those of ``ParseOptions``.
    """
    pages = atoms.page_atoms(raw, **flags)
    return layout.grouped_nodes(pages) if ParseOptions(**flags).enable_grouping else layout.flat_nodes(pages)


def parse_document(raw: DataFrame, **flags: bool) -> tuple[DataFrame, DataFrame]:
    """The tables of chunks and of pages. Repeated pages give repeated rows: use ``distinct_pages`` first where they may occur."""
    pages = parsed_pages(raw, **flags)
    return layout.chunk_rows(pages, ParseOptions(**flags).enable_grouping), atoms.page_counts(pages)


def parse_page(raw: DataFrame, doc_id: str, number: int, **flags: bool) -> tuple[DataFrame, DataFrame]:
    """As ``parse_document`` for one page of a document, which is all that is read of the payloads.

    A number the document's pages don't reach raises ValueError (``sources.raw.at_page``).
    """
    return parse_document(at_page(raw, number, doc_id), **flags)
