"""Attribute strings of annotation records: `key "value";` and `key=value;`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: what a lambda captures is else evaluated for every element."""
    return F.transform(F.array(value), body)[0]


#: A field begins at the text's start or after a semicolon, blanks left out.
_FIELD = r"(?:^|;) *"
#: Key, one blank or =, what values are cleaned of, and a value up to its last character that stays.
_PAIR = _FIELD + r"([^\s=;]+)[\s=][\s\"'=,]*+([^;]*[^;\s\"'=,])"
#: The only field that is not blank.
_LONE = r"^[; ]*+([^;]*[^; ])[; ]*$"


def _clean(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\f\r\"'=,"))


def gene_id(attributes: Column) -> Column:
    """The gene of a record: the first gene_id field, else the last ID field, else a lone field as it is; null otherwise."""
    rest = lambda key: F.regexp_extract_all(attributes, F.lit(f"{_FIELD}{key}([^;]*)"), F.lit(1))
    first, last, lone = F.get(rest("gene_id"), F.lit(0)), F.try_element_at(rest("ID"), F.lit(-1)), F.regexp_extract(attributes, _LONE, 1)
    return let(F.coalesce(_clean(first), _clean(last), _clean(lone)), lambda found: F.when(found != "", found))


def to_map(attributes: Column) -> Column:
    """All attributes as a map; key and value part at the first blank, else the first =; empty values are left out, the last of
    repeated keys wins."""
    part = lambda k: F.regexp_extract_all(attributes, F.lit(_PAIR), F.lit(k))

    def last_wins(p: Column) -> Column:
        keys, values = p["k"], p["v"]
        entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
        kept = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(kept))

    return let(F.struct(part(1).alias("k"), part(2).alias("v")), last_wins)


def isoform_id(attrs: Column) -> Column:
    """protein_id with its version, else transcript_id with its version, else Parent."""
    with_version = lambda m, key: F.when(m[f"{key}_id"].isNotNull(), F.concat_ws(".", m[f"{key}_id"], m[f"{key}_version"]))
    return let(attrs, lambda m: F.coalesce(with_version(m, "protein"), with_version(m, "transcript"), m["Parent"]))


def parsed(records: DataFrame, attributes: str = "attributes") -> DataFrame:
    """records with attrs (map), gene_id and isoform. A generator of one row computes them once, however often they are used."""
    of = let(to_map(F.col(attributes)), lambda m: F.struct(m.alias("attrs"), isoform_id(m).alias("isoform")))
    one = records.select("*", F.inline_outer(F.array(F.struct(of.alias("__of"), gene_id(F.col(attributes)).alias("gene_id")))))
    return one.select(*records.columns, "__of.attrs", "gene_id", "__of.isoform")


#: GFF3 tags and the GTF keys that they become, by feature.
_OWN_KEY = {"gene": "gene_id", "transcript": "transcript_id", "exon": "exon_id", "CDS": "cds_id"}


def gff_feature(feature: Column) -> Column:
    return F.when(feature == "mRNA", "transcript").otherwise(feature)


def untag(value: Column) -> Column:
    """Identifiers without the tags that GFF3 writers put on them, a transcript number before them included."""
    return F.regexp_replace(F.regexp_replace(value, r"^(?:mRNA|cds|gene)\.", ""), r"(?:\.t1)?\.(?:exon|cds)\d*$", "")


def gff_to_gtf(feature: Column, attributes: Column, gene: Column) -> Column:
    """A GTF attribute string: own id under the feature's key, the name, the transcript of exons and CDS, and the gene."""
    return let(to_map(attributes), lambda m: _gtf_string(feature, m, gene))


def _gtf_string(feature: Column, m: Column, gene: Column) -> Column:
    kind = gff_feature(feature)
    own = None
    for k, key in _OWN_KEY.items():
        own = F.when(kind == k, F.lit(key)) if own is None else own.when(kind == k, F.lit(key))
    pair = lambda key, value: F.when(value.isNotNull(), F.concat(key, F.lit(' "'), value, F.lit('"')))
    return F.concat(
        F.concat_ws(
            "; ",
            F.when(kind != "gene", pair(F.lit("gene_id"), untag(gene))),
            F.when(kind.isin("exon", "CDS"), pair(F.lit("transcript_id"), untag(m["Parent"]))),
            pair(own, untag(m["ID"])),
            pair(F.lit("gene_name"), m["Name"]),
        ),
        F.lit(";"),
    )
