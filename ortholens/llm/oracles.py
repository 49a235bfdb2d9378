"""DuckDB SQL for the corpus queries whose rows SQL can express."""

from ortholens.llm.quality_rules import STOP_WORDS
from ortholens.llm.secrets import ASSIGN

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))

def _op13(rounds: int = 6) -> str:
    """The rounds written out; all values here are whole and far below 2^53, so that DOUBLE sums are exact."""
    far = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    assigned = f"SELECT i, pos, k, d FROM (SELECT i, p.pos, k, {far} AS d FROM p JOIN c{{r}} c ON c.pos = p.pos) QUALIFY row_number() OVER (PARTITION BY i, pos ORDER BY d, k) = 1"
    ctes = [
        """x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)) AS e
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        "p AS MATERIALIZED (SELECT i, pos, e[pos * len(e) // 8 + 1 : (pos + 1) * len(e) // 8] AS v FROM x, range(8) r(pos))",
        "c0 AS MATERIALIZED (SELECT pos, i - 1 AS k, v AS c FROM p WHERE i <= 16)",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS MATERIALIZED ({assigned.format(r=r)})")
        ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.pos, c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT pos, k, list(f ORDER BY q) AS c FROM
 (SELECT pos, k, q, floor(sum(v[q]) / count(*)) AS f FROM a{r} JOIN p USING (i, pos), range(1, 9) s(q) GROUP BY ALL) GROUP BY ALL) m ON m.pos = c.pos AND m.k = c.k)""")
    ctes.append(f"a{rounds} AS MATERIALIZED ({assigned.format(r=rounds)})")
    ctes.append(f"""e AS (SELECT i, string_agg(format('{{:02x}}', k), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i)""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(c[q]::BIGINT::VARCHAR, ',' ORDER BY pos, k, q)) FROM c{rounds}, range(1, 9) s(q)) AS codebooks_sha256 FROM x JOIN e USING (i)"""


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM r, (VALUES (0), (1), (2)) AS v(o)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
             len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id),
q AS (SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars,
             coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_ratio,
             coalesce(n_stop_words::DOUBLE / nullif(n_words, 0), 0) AS stop_word_ratio,
             coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_words::DOUBLE / nullif(n_lines, 0), 0) AS words_per_line,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words >= 50 AND mean_word_chars BETWEEN 2 AND 14 AND symbol_ratio <= 0.04
        AND stop_word_ratio >= 0.04 AND dup_line_ratio <= 0.5 AND words_per_line >= 3) AS kept,
       n_stop_words, n_lines, mean_word_chars, symbol_ratio, stop_word_ratio, dup_line_ratio, words_per_line
FROM q
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS cap FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS left_words,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_words / left_weight AS share FROM l),
t AS (SELECT source, source_size, cap, weight,
             coalesce(least(cap, weight * (SELECT arg_min(share, cap / weight) FROM f WHERE share * weight <= cap)), cap) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR), d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_word
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (greatest(0, least(size, floor(target)::BIGINT - begin_word))
        + greatest(0, least(size, floor(target)::BIGINT - begin_word - source_size))
        + greatest(0, least(size, floor(target)::BIGINT - begin_word - 2 * source_size)))::BIGINT AS taken
FROM p
"""

OP11 = """
WITH x AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.i <> c.i WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, coalesce(sum(n), 0) + any_value(v) AS m FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // m.m::HUGEINT AS p
      FROM m JOIN k USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT l.lang, l.term, 1 + 1000000000::HUGEINT * (l.n::HUGEINT + 1) // (sum(l.n) OVER (PARTITION BY l.lang) + v)::HUGEINT AS q FROM l JOIN v USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT 'pair' AS part, a.lang, a.source, a.item, coalesce(f.value, 0)::BIGINT AS value FROM a LEFT JOIN f USING (lang, source, item)
      UNION ALL SELECT 'term', p.lang, p.source, p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

OP10 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS intact
FROM f
"""



def _spans(kind: str, rank: int, pattern: str, test: str, groups: str = "[]") -> str:
    """DuckDB: the matches of a pattern with their offsets, from the lengths of matches and of the gaps between them."""
    hits = f"regexp_extract_all(t, '{pattern}', 0)"
    return f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit, g2, b AS s, b + length(hit) AS e FROM (
  SELECT doc_id, hits[i] AS hit, g[i] AS g2,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS b
  FROM (SELECT doc_id, {hits} AS hits, string_split_regex(t, '{pattern}') AS gaps, {groups} AS g,
               unnest(range(1, len({hits}) + 1)) AS i FROM d)) WHERE {test}"""


def _quote(x: str) -> str:
    return x.replace("'", "''")


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT"
    f" WHEN {_DIGITS}[-i]::INT > 4 THEN 2 * {_DIGITS}[-i]::INT - 9 ELSE 2 * {_DIGITS}[-i]::INT END)) % 10 = 0"
)

OP8_BASE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join((
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT)) <= 255"),
        _spans("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ))
    + """)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS base_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
)

_ASSIGN = _quote(ASSIGN)
OP9_BASE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join((
        _spans("assign", 0, _ASSIGN, "length(g2) >= 6", f"regexp_extract_all(t, '{_ASSIGN}', 2)"),
        _spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 20"),
        _spans("hex", 2, "[0-9a-f]{4,}", "length(hit) >= 24"),
    ))
    + """)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS base_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
)

ORACLES = {"op10_warc": OP10, "op11_exact_top_k": OP11, "op12_source_divergence": OP12, "op13_vector_codes": _op13(), "op5_source_mixing": OP5, "op7_quality_rules": OP7}
