"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order models over single characters are trained from labelled strings; a candidate token is a secret if the mean
log-likelihood ratio of its transitions exceeds a threshold. The trained ratios are one array literal, so scoring is a
plain expression inside the scan: no user function, no join, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import bare, let, spans, spans_text

#: Fixed patterns of the contract, as kind, pattern.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: a run that is too short has no longer match inside it, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/"
CANDIDATE = r"[A-Za-z0-9_+/-]{16,}"
#: Production parameters: documents that ordinary identifiers are drawn from (expected number), random strings made,
#: least mean log-likelihood ratio per transition.
FIT_DOCUMENTS = 2_000
RANDOM_STRINGS = 6_000
THRESHOLD = 0.5
#: Weight of the overall distribution in each row of transitions, in observations.
PRIOR = 2.0
#: No single transition decides: ratios are held within this.
LIMIT = 3.0


def random_strings(spark, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled examples of random strings: digests in hexadecimal, in base 64, and in base 64 without its signs."""
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, F.regexp_replace(b64, "=", "")).otherwise(F.regexp_replace(b64, "[=+/]", "")).alias("token")
    )


def ordinary_identifiers(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Labelled examples of identifiers, from the words of a hash sample of about fit_documents rows: alone, joined, and with
    what ordinary names carry: dates, counters, versions, paths, record numbers in groups."""
    n = max(docs.count(), 1)
    part = min(1.0, fit_documents / n)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(part * (1 << 20)))).select(F.coalesce("text", F.lit("")).alias("t"))
    said = chosen.select(F.explode_outer(F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}(?:[_ /-][A-Za-z]{3,}){0,3}"), F.lit(0))).alias("token")).where("token is not null")
    x = F.pmod(F.xxhash64("token"), F.lit(1 << 40))
    number = lambda k, digits: F.lpad(F.pmod(F.shiftright(x, k), F.lit(10**digits)).cast("string"), digits, "0")
    low = F.pmod(F.shiftright(x, 3), F.lit(1000)).cast("string")
    date = F.concat_ws("-", F.concat(F.lit("20"), number(5, 2)), F.lpad((F.pmod(x, F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(F.shiftright(x, 7), F.lit(28)) + 1).cast("string"), 2, "0"))
    word = F.lower(F.translate("token", " ", "_"))
    group = F.sha2("token", 256)
    uuid = F.concat_ws("-", *(F.substring(group, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = F.array(
        F.translate("token", " ", "_"), F.translate("token", " ", "_"), F.concat_ws("-", word, date), F.concat_ws("-", word, F.lpad(low, 5, "0")),
        F.concat_ws("/", date, word), F.concat_ws("_", word, low), F.concat_ws("/", F.lit("part-00000"), date, F.lpad(low, 6, "0")), uuid,
    )
    return said.select(F.get(kinds, F.pmod(F.shiftright(x, 11), F.lit(8)).cast("int")).alias("token"))


def transition_counts(tokens: DataFrame, label: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    return tokens.where(F.length("token") >= 2).select(F.explode(pairs).alias("pair")).groupBy("pair").count().select(F.lit(label).alias("label"), "pair", "count")


def train(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each transition; row-major over ALPHABET and one place for the rest.

    What reaches the driver is at most one count per pair of characters of the alphabet and label.
    """
    known = F.col("pair").rlike("^[A-Za-z0-9_+/-]{2}$")
    counted = transition_counts(random_strings(docs.sparkSession), "random").unionByName(
        transition_counts(ordinary_identifiers(docs, fit_documents), "ordinary")
    )
    seen = {(r["label"], r["pair"]): r["count"] for r in counted.where(known).collect()}
    size = len(ALPHABET)

    def logs(label: str) -> list[list[float]]:
        # each row is smoothed by what follows any character, so that characters a label never uses stay unlikely
        any_ = [sum(seen.get((label, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET]
        whole = sum(any_)
        out = []
        for a in ALPHABET:
            row = [seen.get((label, a + b), 0) + PRIOR * any_[k] / whole for k, b in enumerate(ALPHABET)]
            total = sum(row)
            out.append([math.log(x / total) for x in row])
        return out

    r, o = logs("random"), logs("ordinary")
    return [round(max(-LIMIT, min(LIMIT, r[i][j] - o[i][j])), 4) for i in range(size) for j in range(size)]


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    at = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def mean(p: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.get(table, F.get(p, i) * len(ALPHABET) + F.get(p, i + 1)))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(steps)

    return let(at, mean)


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_cols, n_assign, n_access, n_hex, n_random, found: array<struct<start, rank, kind, end>>, one row per input row.

    Null text is empty and has no span. Repeated rows are each scanned. The model adds spans of kind `random`, each a token
    of 16 or more characters that no fixed pattern touches; fixed spans stay whatever the model says.
    """
    ratios = train(docs) if ratios is None else ratios
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(*keep_cols, text.alias("__text"))
    t = F.col("__text")
    raw = held.select(
        *keep_cols,
        F.filter(spans(t, ASSIGN, "assign", 0, (2,)), lambda s: F.length(s["g2"]) >= 6).alias("__a"),
        spans(t, ACCESS, "access", 1).alias("__k"), spans(t, HEX, "hex", 2).alias("__h"), spans(t, CANDIDATE, "random", 3).alias("__r"),
    )
    fixed = raw.select(*keep_cols, bare(F.col("__a")).alias("__a"), bare(F.col("__k")).alias("__k"), bare(F.col("__h")).alias("__h"), "__r")
    both = fixed.select("*", F.concat("__a", "__k", "__h").alias("__f"))
    free = F.filter("__r", lambda s: ~F.exists("__f", lambda f: (f["start"] < s["end"]) & (f["end"] > s["start"])) & (likelihood_ratio(s["hit"], ratios) >= threshold))
    return both.select(
        *keep_cols, F.size("__a").cast("long").alias("n_assign"), F.size("__k").cast("long").alias("n_access"), F.size("__h").cast("long").alias("n_hex"),
        F.sort_array("__f").alias("fixed"), bare(F.when(F.size("__r") > 0, free).otherwise(F.col("__r"))).alias("added"),
    ).select(
        *keep_cols, "n_assign", "n_access", "n_hex", F.size("added").cast("long").alias("n_random"), "fixed",
        F.sort_array(F.concat("fixed", "added")).alias("found"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of scan()."""
    return scan(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("fixed")), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"), "n_random"
    )
