"""Chunkers: documents to chunks. Structural groups are ``doc_id * 10000 + group`` within a document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BLANK = re.compile(r"\n\s*\n")


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^(?U)\s+|(?U)\s+$", "")), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Trimmed parts after sentence ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U)\s+"), lambda x: F.regexp_replace(x, r"^(?U)\s+|(?U)\s+$", "")), lambda x: x != "")


def fixed_windows(docs: DataFrame, window_size: int = 200, overlap: int = 50) -> DataFrame:
    """``doc_id, position, text``: windows of tokens; the last ends with the document. Nothing is shuffled."""
    if window_size <= 0 or overlap < 0 or overlap >= window_size:
        raise ValueError("window_size must be above 0 and overlap in [0, window_size)")
    step = window_size - overlap
    last = F.ceil(F.greatest(F.size("t") - window_size, F.lit(0)) / step).cast("int")
    return (
        docs.select("doc_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
        .select("doc_id", "t", F.explode(F.sequence(F.lit(0), last)).alias("position"))
        .select("doc_id", "position", F.array_join(F.slice("t", F.col("position") * step + 1, window_size), " ").alias("text"))
    )


def paragraph_sentence_chunks(docs: DataFrame, max_tokens: int = 200) -> DataFrame:
    """``doc_id, position, text, structural_group``: whole sentences packed greedily, never across paragraphs.

    Packing depends on all that came before, so it runs on Arrow batches, in time linear in the text.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be above 0")

    def pack(text: str):
        for group, paragraph in enumerate(p for p in (x.strip() for x in _BLANK.split(text)) if p):
            held, n = [], 0
            for sentence in (s for s in (x.strip() for x in _SENTENCE.split(paragraph)) if s):
                size = len(sentence.split())
                if held and n + size > max_tokens:
                    yield group, " ".join(held)
                    held, n = [], 0
                held.append(sentence)
                n += size
            if held:
                yield group, " ".join(held)

    def run(batches):
        for batch in batches:
            rows = [(d, k, t, d * 10000 + g if d is not None else None) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (g, t) in enumerate(pack(text or ""))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["doc_id", "position", "text", "structural_group"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, position int, text string, structural_group long")


#: Opens a section in a text under way; a mark that the text itself holds is escaped.
_MARK, _ESCAPED, _CUT = "\x01", "\x01\x03", "\x01\x02"


def section_texts(text: Column) -> Column:
    """Sections of one text: a heading opens one, a blank line closes one. Expressions within the row only, so equal ids never mix."""
    bare = F.trim
    heading = lambda line: line.rlike(r"^\s*#+\s+.+") | line.rlike(r"^\s*\d+[.)]\s*\S") | ((F.length(bare(line)) <= 50) & bare(line).rlike(r"^[A-Z][A-Z0-9\s]{1,50}$"))
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_ESCAPED)), "\n")
    marked = F.transform(lines, lambda line: F.when(bare(line) == "", F.lit(_CUT)).when(heading(line), F.concat(F.lit(_CUT), line)).otherwise(line))
    parts = F.split(F.array_join(marked, "\n"), _CUT)
    whole = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\n+|\n+$", "")), lambda p: p != "")
    return F.transform(whole, lambda p: F.replace(p, F.lit(_ESCAPED), F.lit(_MARK)))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, text`` of every section. Nothing is shuffled; a null or blank text has none."""
    return docs.select("doc_id", F.posexplode(section_texts(F.col("text"))).alias("section", "text"))


def structure_aware_chunks(docs: DataFrame, window_size: int = 200, overlap: int = 50) -> DataFrame:
    """Token windows inside each section; positions run over the document and are unique. Nothing is shuffled."""
    if window_size <= 0 or overlap < 0:
        raise ValueError("window_size must be above 0 and overlap must not be negative")
    step = max(1, window_size - overlap)
    last = lambda t: F.ceil(F.greatest(F.size(t) - window_size, F.lit(0)) / step).cast("int")
    windows = lambda t, k: F.transform(F.sequence(F.lit(0), last(t)), lambda w: F.struct(k.alias("section"), F.array_join(F.slice(t, w * step + 1, window_size), " ").alias("text")))
    split = F.transform(section_texts(F.col("text")), tokens)  # once a section: windows refer to the tokens by name
    every = F.flatten(F.filter(F.transform(split, lambda t, k: F.when(F.size(t) > 0, windows(t, k))), lambda x: x.isNotNull()))
    rows = docs.select("doc_id", F.posexplode(every).alias("position", "w"))
    return rows.select("doc_id", "position", F.col("w.text").alias("text"), (F.col("doc_id") * 10000 + F.col("w.section")).cast("long").alias("structural_group"))
