"""Benchmark decontamination: template canonicalisation, hash-joined template windows, slot consistency.

Numbers, names and units become typed placeholders that still carry their value; a window of five template tokens is
hashed without the values, and once more with its names as plain words: in copies that changed case, or whose white space hides
a name, names are plain. Windows of the corpus are joined with those of the benchmark by hash; what an item shares with a
region of a document is measured in covered item tokens, and the placeholders' values must map onto each other one way.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import stash

#: Production parameters: tokens per window, least share of an item's tokens, least share of consistent slots, how far
#: apart (in tokens) windows of one region may drift, benchmark windows that may be broadcast.
WINDOW = 5
LEAST_SHARE = 0.8
LEAST_CONSISTENT = 0.8
DRIFT = 64
WIDTHS = tuple(1 << k for k in range(DRIFT.bit_length()))
BROADCAST_WINDOWS = 1_000_000

#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr hrs ms kb mb gb tb w kw mw v a hz khz mhz ghz "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds "
    "liter liters second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent "
    "dollar dollars euro euros cent cents"
)
NUMBER = r"([0-9]+)(?:[.,]([0-9]+))?(?:[.,:/][0-9]+)*"
NAME = r"(?=\p{Lu})(?<=[\p{Ll},;]\s{1,16})(\p{Lu}\p{Ll}+)"
UNIT = r"(?<=_)\s*\b(" + "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u))) + r")\b"


def tokens(text: Column) -> Column:
    """Template tokens: lower-case words; 0num<value>, 0name<value>, 0unit<value> for what is replaced."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, NAME, " 0name$1 ")
    # digits of placeholders are not numbers: a name's 0 is followed by a letter and stands alone otherwise
    t = F.when(t.rlike("[0-9](?!name)"), F.regexp_replace(F.regexp_replace(t, r"(?<![0-9A-Za-z])" + NUMBER + r"(?!name)", " 0num$1_$2_ "), r"(?i)" + UNIT, " 0unit$1 ")).otherwise(t)
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")


def template(token: Column) -> Column:
    """The token without its value."""
    slot = token.startswith("0num") | token.startswith("0name") | token.startswith("0unit")
    return F.when(~token.startswith("0"), token).when(slot, F.regexp_extract(token, "^0(?:num|name|unit)", 0)).otherwise(token)


def plain(token: Column) -> Column:
    """The token's template, but a name as the word it is."""
    return F.when(token.startswith("0name"), F.substring(token, 6, 1 << 30)).otherwise(template(token))


def windows(table: DataFrame, keys: list[str], window: int = WINDOW, slots: bool = False) -> DataFrame:
    """keys, n_tokens, place, h: one row per window, two where it holds names; with slots also the valued placeholders inside it,
    in order (of the form with plain names those that are no names).

    The outer form of explode: the inner one adds a filter on the array, which is pushed below and computes all of it again.
    """
    valued = table.select(*keys, tokens(F.col("text")).alias("tok"))
    held = valued.select(*keys, *(["tok"] if slots else []), F.transform("tok", template).alias("tmpl"), F.transform("tok", plain).alias("plain"))
    starts = F.when(F.size("tmpl") >= window, F.sequence(F.lit(0), F.size("tmpl") - window)).otherwise(F.array().cast("array<int>"))
    h = lambda form, i: F.xxhash64(*(F.get(F.col(form), i + k) for k in range(window)))
    inside = lambda i, kinds: F.filter(F.slice("tok", i + 1, F.lit(window)), lambda w: w.rlike(f"^0(?:{kinds})"))
    if slots:
        forms = lambda i: F.array_distinct(F.array(F.struct(h("tmpl", i).alias("h"), inside(i, "num|name|unit").alias("slots")), F.struct(h("plain", i).alias("h"), inside(i, "num|unit").alias("slots"))))
    else:
        forms = lambda i: F.array_distinct(F.array(F.struct(h("tmpl", i).alias("h")), F.struct(h("plain", i).alias("h"))))
    hashed = held.select(*keys, F.size("tmpl").alias("n_tokens"), F.transform(starts, forms).alias("hs"))
    each = hashed.select(*keys, "n_tokens", F.posexplode_outer("hs").alias("place", "xs")).where("xs is not null")
    return each.select(*keys, "n_tokens", "place", F.explode_outer("xs").alias("x")).select(*keys, "n_tokens", "place", "x.*")


def covered(places: Column, window: int = WINDOW) -> Column:
    """Tokens in the union of windows that start at the places (sorted)."""
    each = F.transform(places, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(places, i - 1))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE, least_consistent: float = LEAST_CONSISTENT
) -> DataFrame:
    """doc_id, text_key, item_id, n_tokens, covered_tokens, share, consistency: one row per document and item it contains.

    share is the part of the item's template tokens that five-token windows of one region of the document cover.
    consistency is the part of the same region's slot observations in which an item's value meets the value it mostly meets:
    1 where the item has no slots or was re-parameterised throughout. One region that passes both is enough, whatever else
    the document holds; regions are bands of diagonals of 1 to DRIFT tokens' width.
    Null and empty texts, and items under five tokens, have no windows and never match. Rows with equal doc_id and text are one
    document; equal items are reported each.
    """
    of_items = stash(windows(benchmark.select("item_id", "text"), ["item_id"], window, slots=True), "benchmark-windows")
    small = of_items.count() <= BROADCAST_WINDOWS
    # a checked size decides; beyond it both sides are shuffled by hash, and AQE splits hot hashes
    sent = lambda df: F.broadcast(df) if small else df
    b = of_items.select("item_id", "n_tokens", F.col("place").alias("at"), "h")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    d = windows(keyed, ["doc_id", "text_key"], window).drop("n_tokens")
    key = ["doc_id", "text_key", "item_id"]
    hits = d.join(sent(b), "h")
    shift = F.col("place") - F.col("at")
    regions = F.array(*(F.struct(F.lit(o).alias("o"), F.floor((shift + o) / F.lit(DRIFT)).alias("r")) for o in (0, DRIFT // 2)))
    held = hits.select(*key, "n_tokens", "at", F.explode(regions).alias("region"))
    per = held.groupBy(*key, "region").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_set("at")).alias("places"))
    shares = per.groupBy(*key).agg(F.max("n_tokens").alias("n_tokens"), F.max(covered(F.col("places"), window)).alias("covered_tokens"))
    found = stash(
        shares.select(
            *key, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("covered_tokens").cast("long").alias("covered_tokens"),
            (F.col("covered_tokens") / F.col("n_tokens")).alias("share"),
        ).where(F.col("share") >= least_share),
        "benchmark-hits",
    )
    # slots are looked at again only where an item that has some was found
    slotted = of_items.where(F.size("slots") > 0).select("item_id").distinct().withColumnRenamed("item_id", "s_item_id")
    of_slotted = F.col("item_id").eqNullSafe(F.col("s_item_id"))
    free = found.join(slotted, of_slotted, "left_anti").withColumn("consistency", F.lit(1.0))
    suspects = found.join(slotted, of_slotted, "left_semi").select(*key)
    few = suspects.count() <= BROADCAST_WINDOWS
    sus = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    texts = suspects.select(F.col("doc_id").alias("s_doc_id"), F.col("text_key").alias("s_text_key")).distinct()
    again = keyed.join(sus(texts), F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_key") == F.col("s_text_key")), "left_semi").distinct()
    valued = of_items.select("item_id", "n_tokens", F.col("place").alias("at"), "h", F.col("slots").alias("item_slots"))
    met = windows(again, ["doc_id", "text_key"], window, slots=True).drop("n_tokens").join(sent(valued), "h")
    met = met.join(sus(suspects.withColumnsRenamed({k: f"s_{k}" for k in key})), _same(key), "left_semi")
    # one row per hit and region that it lies in; regions at all widths, as copies may follow each other closer than DRIFT
    bands = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(o).alias("o"), F.floor((shift + o) / F.lit(w)).alias("r")) for w in WIDTHS for o in sorted({0, w // 2})))
    seen = stash(met.select(*key, "n_tokens", "at", shift.alias("shift"), bands.alias("bands"), F.arrays_zip("item_slots", "slots").alias("xs")), "benchmark-slots")
    each = seen.select(*key, "n_tokens", "at", "xs", F.explode("bands").alias("region"))
    whole = stash(
        each.groupBy(*key, "region").agg(F.max("n_tokens").cast("long").alias("n_tokens"), covered(F.sort_array(F.collect_set("at")), window).cast("long").alias("covered_tokens"))
        .withColumn("share", F.col("covered_tokens") / F.col("n_tokens")).where(F.col("share") >= least_share),
        "benchmark-regions",
    )
    place = [*key, "region"]
    within = each.join(whole.select(*place).withColumnsRenamed({k: f"s_{k}" for k in place}), _same(place), "left_semi")
    slots = (
        within.select(*place, F.explode("xs").alias("x"))
        .groupBy(*place, F.col("x.item_slots").alias("v"), F.col("x.slots").alias("w")).agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*place, "v").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
        .groupBy(*place).agg((F.sum("most") / F.sum("all")).alias("consistency"))
    )
    judged = whole.join(slots.withColumnsRenamed({k: f"s_{k}" for k in place}), _same(place), "left")
    passed = judged.withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= least_consistent)
    best = passed.groupBy(*key).agg(F.max(F.struct("covered_tokens", "consistency", "n_tokens", "share")).alias("m"))
    return free.unionByName(best.select(*key, "m.n_tokens", "m.covered_tokens", "m.share", "m.consistency"))


def _same(names: list[str]) -> Column:
    """Null-safe equality of the columns with those of the other side, named s_<column>."""
    return functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in names))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with their own columns."""
    bad = stash(matches(docs, benchmark).select("doc_id", "text_key").distinct(), "contaminated").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return docs.join(bad, on, "left_anti")


