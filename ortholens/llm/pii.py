"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Protected entities are what the fixed patterns match. How much of an entity's information a term discloses is estimated
from the corpus: PMI(term; entity) over IC(entity). Everything is counted in distinct texts: those that hold the term, those
that mention the entity, those that hold the term among the CONTEXT_WORDS terms on either side of a mention. Terms at or over
`generalise` are replaced by their class, terms at or over `remove` are removed, wherever they stand in a text that mentions
the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import bare, let, settled, spans, spans_text, stash

#: The contract's patterns. A match can only begin where a run begins or where the last match ended, so runs are possessive
#: and anchored there: the same matches, in linear time. Chains of fewer than 12 digits hold no longer chain.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2}\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

TERM = r"[\p{L}\p{N}]+"
KINDS = ("email", "ip", "card", "phone", "term")
#: Production parameters: words to either side of a mention, distinct contexts that a term must share with an entity (with
#: fewer nothing can be estimated), disclosed shares of information, candidate terms that may be broadcast.
CONTEXT_WORDS = 8
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
BROADCAST_TERMS = 200_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits' check sum holds: every second digit from the right doubled, less 9 if over 9."""
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(t: Column) -> Column:
    """All spans of the fixed patterns, with what they matched, sorted by start and kind."""
    n = lambda s: F.length(digits(s["hit"]))
    return F.sort_array(
        F.concat(
            spans(t, EMAIL, "email", 0),
            F.filter(spans(t, IP, "ip", 1), lambda s: s["hit"].rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")),
            F.filter(spans(t, CARD, "card", 2), lambda s: n(s).between(12, 19) & luhn(digits(s["hit"]))),
            F.filter(spans(t, PHONE, "phone", 3), lambda s: n(s).between(9, 15)),
        )
    )


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, entity, terms: one row per match of a fixed pattern, with the terms beside it.

    Terms are lower-cased words, at most CONTEXT_WORDS to either side, up to the next match.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    found = settled(docs.select("doc_id", t.alias("t")).select("doc_id", "t", base_spans(F.col("t")).alias("base")), F.size("base") > 0)
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))
    between = lambda begin, end: F.substring(F.col("t"), begin + 1, F.greatest(F.lit(0), end - begin))
    sides = F.transform(
        "base",
        lambda s, i: F.struct(
            s.alias("s"), F.when(i > 0, F.get("base", i - 1)["end"]).otherwise(0).alias("from"),
            F.coalesce(F.get("base", i + 1)["start"], F.length("t")).alias("to"),
        ),
    )
    each = found.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_key"), "t", F.explode_outer(sides).alias("x"))
    before, after = words(between(F.col("x.from"), F.col("x.s.start"))), words(between(F.col("x.s.end"), F.col("x.to")))
    near = F.concat(F.slice(F.reverse(before), 1, CONTEXT_WORDS), F.slice(after, 1, CONTEXT_WORDS))
    return each.select("doc_id", "text_key", F.concat_ws(":", F.col("x.s.kind"), F.lower("x.s.hit")).alias("entity"), near.alias("terms"))


def disclosing(docs: DataFrame, found: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """entity, term, disclosed, action: what the corpus says about terms beside protected entities.

    The unit is the distinct text, so copies of a document are one witness. A term that shares fewer than min_contexts distinct
    contexts with an entity is not judged.
    """
    beside = found.select("text_key", "entity", F.xxhash64("terms").alias("context"), F.explode(F.array_distinct("terms")).alias("term"))
    # distinct contexts: copies of a text have equal ones, and each one of a text counts
    contexts = beside.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    judged = stash(contexts.where(F.col("contexts") >= min_contexts).select("entity", "term"), "pii-judged")
    texts = beside.join(judged, ["entity", "term"], "left_semi").select("entity", "term", "text_key").distinct()
    pairs = texts.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    per_entity = found.select("entity", "text_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    # a term's texts are at least those whose contexts hold it; with more than this many it cannot reach the threshold
    n_texts = max(docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).distinct().count(), 1)
    at_least = beside.select("term", "text_key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("at_least"))
    most = F.col("both") * F.pow(F.lit(float(n_texts)) / F.col("of_entity"), F.lit(1 - generalise))
    candidates = stash(
        pairs.join(per_entity, "entity").join(at_least, "term").where(F.col("at_least") <= F.ceil(most)).drop("at_least"), "pii-candidates"
    )
    terms = stash(candidates.select("term").distinct(), "pii-terms")
    n_terms = terms.count()
    if n_terms == 0:
        frequency = terms.select("term", F.lit(1).cast("long").alias("of_term"))
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        held = docs.select(F.md5(text.cast("binary")).alias("text_key"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("ts"))
        said = held.select("text_key", F.explode_outer("ts").alias("term"))
        # a checked size decides whether the candidates are sent to the scan; only rows of candidates are shuffled then
        known = said.join(F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms, "term", "left_semi")
        frequency = known.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    n = F.lit(float(n_texts))
    pmi = F.log(F.col("both") * n / (F.col("of_term") * F.col("of_entity")))
    ic = -F.log(F.least(F.col("of_entity") / n, F.lit(1.0)))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return (
        candidates.join(frequency, "term")
        .select("entity", "term", share.alias("disclosed"))
        .where(F.col("disclosed") >= generalise)
        .select("*", F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise").alias("action"))
    )


def added_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, added, removed: the terms to sanitise, by document and text; only documents that have some.

    A term is looked for in the whole text of every document that mentions an entity it discloses; what touches a fixed span
    stays as it is.
    """
    found = stash(mentions(docs), "pii-mentions")
    told = disclosing(docs, found)
    of_doc = found.select("doc_id", "text_key", "entity").distinct().join(told, "entity")
    wanted = stash(
        of_doc.groupBy("doc_id", "text_key").agg(
            F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("gone")
        ),
        "pii-wanted",
    )
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", t.alias("t"), F.md5(t.cast("binary")).alias("text_key")).withColumnsRenamed({"doc_id": "__id", "text_key": "__tk"})
    met = keyed.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tk") == F.col("text_key"))).drop("__id", "__tk").dropDuplicates(["doc_id", "text_key"])
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    all_ = met.select("doc_id", "text_key", "terms", "gone", base_spans(F.col("t")).alias("base"), spans(F.col("t"), TERM, "term", 4).alias("ts"))
    hit = all_.select("doc_id", "text_key", "gone", F.filter("ts", lambda s: F.array_contains("terms", F.lower(s["hit"])) & free(s)).alias("hit"))
    gone = F.filter("hit", lambda s: F.array_contains("gone", F.lower(s["hit"])))
    return stash(hit.select("doc_id", "text_key", bare(F.col("hit")).alias("added"), bare(gone).alias("removed")), "pii-added")


def find(docs: DataFrame, keep_cols: tuple[str, ...] = ("doc_id",), extra: dict[str, Column] | None = None) -> DataFrame:
    """keep_cols, n_email, n_ip, n_card, n_phone, base, found, removed: one row per input row.

    Null text is empty: no spans. Overlapping matches of different kinds are all kept. Repeated rows each get the same
    spans. `removed` holds those of kind term that are taken out rather than replaced by their class.
    """
    added = added_spans(docs).withColumnsRenamed({"doc_id": "__id", "text_key": "__tk"})
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep_cols, F.col("doc_id").alias("__doc"), t.alias("__t"), *(c.alias(k) for k, c in (extra or {}).items())).select(
        *keep_cols, "__doc", *(extra or {}), F.md5(F.col("__t").cast("binary")).alias("__key"), base_spans(F.col("__t")).alias("__b")
    )
    n = lambda k: F.size(F.filter("__b", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counted = base.select(*keep_cols, "__doc", *(extra or {}), "__key", *(n(k) for k in KINDS[:4]), bare(F.col("__b")).alias("base"))
    joined = counted.join(added, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__tk")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return joined.select(
        *keep_cols, *(extra or {}), *(f"n_{k}" for k in KINDS[:4]), "base",
        F.sort_array(F.concat("base", F.coalesce("added", none))).alias("found"), F.coalesce("removed", none).alias("removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of find()."""
    return find(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans")
    )


def term_class(term: Column) -> Column:
    """What a term is generalised to: number, code (letters and digits), name (capitalised) or word."""
    return (
        F.when(term.rlike(r"^\p{N}+$"), "[number]").when(term.rlike(r"\p{N}"), "[code]").when(term.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    )


def redact(text: Column, found: Column, removed: Column) -> Column:
    """The text with each fixed span replaced by [kind], terms by their class, removed terms by nothing; what overlaps is
    replaced once."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        kind = F.when(s["kind"] == "term", term_class(own)).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        put = F.when(F.array_contains(removed, s), F.lit("")).otherwise(kind)
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], gap, put).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        )

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) > 0, let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data and disclosing terms replaced in text; other columns as they are, n_chars anew if there."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    found = find(docs, keep_cols=(), extra={"__row": row})
    new = F.when(F.size("found") == 0, F.col("__row.text")).otherwise(redact(F.col("__row.text"), F.col("found"), F.col("removed")))
    done = found.select("__row", new.alias("__new"))
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.col("__new").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("__new") == F.col("__row.text"), F.col("__row.n_chars")).otherwise(F.length("__new")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("__row")[c].alias(c))
    return done.select(*cols)
