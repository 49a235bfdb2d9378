"""Sequences, their headers and repeat families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in one piece of a long sequence.
CHUNK = 65_536


def seq_id(header: Column) -> Column:
    return F.get(F.split(header, r"\s+"), F.lit(0))


def header_gene(header: Column) -> Column:
    """Gene of an `id pep place gene:ID.v transcript:ID.v` header, without version."""
    return F.substring_index(F.regexp_extract(header, r"\bgene:(\S+)", 1), ".", 1)


def header_transcript(header: Column) -> Column:
    return F.substring_index(F.regexp_extract(header, r"\btranscript:(\S+)", 1), ".", 1)


def subseq(seq: Column, start: Column, end: Column) -> Column:
    """The closed 1-based interval of a sequence."""
    return F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))


def wrap(seq: Column, width: int = 60) -> Column:
    """The sequence in lines of width."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def family(name: Column) -> Column:
    """A repeat element's name without its trailing number."""
    return F.regexp_replace(name, "-[^-]*$", "")
