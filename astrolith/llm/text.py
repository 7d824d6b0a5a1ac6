"""Helpers for the corpus operators: Arrow batches of whole texts and word blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are cut into words block by block, so that memory stays bounded.
BLOCK = 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[ \t-\r]")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, body)``: the whole text as UTF-8 bytes; a null text is null."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def own_columns(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def text_hash(body: str | Column) -> Column:
    """A text's MD5; a null text has that of no bytes."""
    return F.unhex(F.md5(F.coalesce(body, F.lit(b""))))


def text_mark(id_col: str, body: str) -> Column:
    """A hash of a row's id and whole text: equal rows share it."""
    return F.xxhash64(id_col, F.md5(F.coalesce(body, F.lit(b""))))


def word_blocks(body: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The whitespace separated words of ``body``, in lists from about ``size`` bytes each."""
    at, n = 0, len(body)
    while at < n:
        end = n
        if n - at > size and (m := _SPACE.search(body, at + size)):
            end = m.start()
        if words := body[at:end].split():
            yield words
        at = end + 1
