"""Identifiers: versions, isoform tags, composed reference ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_version(value: Column) -> Column:
    """Text before the first dot of the first of several values between semicolons."""
    return F.substring_index(F.substring_index(value, ";", 1), ".", 1)


def strip_transcript_tag(value: Column, mode: str = "suffix") -> Column:
    """suffix: a last `.t<digits>`; last: a last part that begins with t; digits: a last part of optional t and digits."""
    pattern = {"suffix": r"\.t\d+$", "last": r"\.t[^.]*$", "digits": r"\.t?\d+$"}[mode]
    return F.regexp_replace(value, pattern, "")


def first_numeric(value: Column, sep: str = ";") -> Column:
    """The first all-digit element of a list, or null."""
    return F.get(F.filter(F.split(value, sep), lambda x: x.rlike("^[0-9]+$")), F.lit(0))


def compose(gene_id: Column, protein: Column, ensembl: Column, uniprot: Column) -> tuple[Column, Column]:
    """(ids, sources), comma-joined in step: the numeric gene id, then the first of protein, Ensembl and UniProt; null if none."""
    has = lambda c: c.isNotNull() & (c != "")
    other = F.when(has(protein), protein).when(has(ensembl), ensembl).when(has(uniprot), uniprot)
    source = F.when(has(protein), "protein_id").when(has(ensembl), "ensembl").when(has(uniprot), "uniprot")
    empty = lambda c: F.when(c != "", c)
    return empty(F.concat_ws(",", F.when(has(gene_id), gene_id), other)), empty(F.concat_ws(",", F.when(has(gene_id), "geneid"), source))


def canonical(value: Column) -> Column:
    """Species key: lower case, up to the first dot."""
    return F.lower(F.substring_index(value, ".", 1))


def unnamed(symbol: Column) -> Column:
    """True for symbols that name nothing: null, empty or LOC followed by anything."""
    return symbol.isNull() | (symbol == "") | symbol.rlike("^LOC")


def named(symbol: Column) -> Column:
    return F.when(~unnamed(symbol), symbol)


def first_of_list(value: Column) -> Column:
    """First element of a comma list."""
    return F.trim(F.get(F.split(value, ","), F.lit(0)))
