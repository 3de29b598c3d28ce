"""DuckDB twins of the queries that SQL can express.

Not here: sharding (random draws), context-tree scores and toxicity (models), SentencePiece ids and fingerprint hashes (functions that
SQL lacks), main texts. Tests hold those against brute force, the public library or held-out labels.
"""

from __future__ import annotations

from terrapanel.llm import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _matched(pattern: str, group: int, least: int, kind: str, rank: int, source: str = "doc") -> str:
    """Rows (doc_id, row_no, start, rank, stop, kind, value) of the matches whose group is long enough."""
    p = _quoted(pattern)
    return f"""
        SELECT doc_id, row_no, CAST(gap_sum + done AS BIGINT) AS start, {rank} AS rank,
               CAST(gap_sum + done + length(whole) AS BIGINT) AS stop, '{kind}' AS kind, whole AS value
        FROM (SELECT doc_id, row_no, whole[i] AS whole, part[i] AS part,
                     list_sum(list_transform(gap[1:i], lambda x: length(x))) AS gap_sum,
                     coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS done
              FROM (SELECT doc_id, row_no, regexp_split_to_array(text, {p}) AS gap,
                           regexp_extract_all(text, {p}, 0) AS whole, regexp_extract_all(text, {p}, {group}) AS part
                    FROM {source} WHERE regexp_matches(text, {p})), unnest(range(1, len(whole) + 1)) AS t(i))
        WHERE length(part) >= {least}"""


def _blanked(source: str, spans: str) -> str:
    """The texts of a source with spaces in place of all spans."""
    return f"""
        SELECT doc_id, s.row_no, CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend(text, l), lambda t, x:
                 substr(t, 1, CAST(split_part(x, ':', 1) AS BIGINT))
                 || repeat(' ', CAST(split_part(x, ':', 2) AS BIGINT) - CAST(split_part(x, ':', 1) AS BIGINT))
                 || substr(t, CAST(split_part(x, ':', 2) AS BIGINT) + 1)) END AS text
        FROM {source} s LEFT JOIN (SELECT row_no, list(start || ':' || stop) AS l FROM {spans} GROUP BY row_no) b USING (row_no)"""


def _hot(kind: secrets.EntropyKind, rank: int, source: str, pattern: str | None = None, test: str = "true") -> str:
    """Hot spans of a kind; `pattern` and `test` stand in for patterns that look around."""
    value = "lower(value)" if kind.fold else "value"
    allowed = " OR ".join(f"regexp_matches(value, {_quoted(p)})" for p in secrets.ALLOW_LIST)
    return f"""
        SELECT doc_id, row_no, CAST(start + min(i) AS BIGINT) AS start, {rank} AS rank,
               CAST(start + max(i) + {kind.window} AS BIGINT) AS stop, '{kind.name}' AS kind
        FROM (SELECT c.*, i, list_aggregate(string_split(substr({value}, CAST(i + 1 AS BIGINT), {kind.window}), ''), 'entropy') AS bits
              FROM (SELECT * FROM ({_matched(pattern or kind.candidate, 0, kind.window, kind.name, rank, source)}) m
                    WHERE NOT ({allowed}) AND {test}) c,
                   unnest(range(0, length(value) - {kind.window} + 1)) AS t(i))
        WHERE bits >= {kind.bits} - 1e-12 GROUP BY doc_id, row_no, start"""


def _has(*classes: str) -> str:
    return " AND ".join(f"regexp_matches(value, '{c}')" for c in classes)


_JOINED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
_HEX, _WIDE = secrets.ENTROPY_KINDS

_LOWER_WORD, _UPPER_WORD, _MIXED_WORD = secrets.WORD_KINDS
# Whole words of letters and digits; a word of one class holds nothing else.
_WORD = "[A-Za-z0-9]{16,}"

SECRETS = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_matched(k.pattern, k.group, k.least, k.name, i) for i, k in enumerate(secrets.BASE_KINDS))}),
left0 AS MATERIALIZED (SELECT * FROM ({_blanked("doc", "base")}) WHERE regexp_matches(text, '[A-Za-z0-9+/_=-]{{16,}}')),
narrow AS MATERIALIZED ({_hot(_HEX, 3, "left0")}),
holder AS MATERIALIZED (SELECT * FROM ({_matched(secrets.PART, 0, 1, "holder", 0, "left0")})
                        WHERE regexp_matches(value, {_quoted(secrets.HOLDER)})),
left1 AS MATERIALIZED ({_blanked("left0", "holder")}),
wide AS MATERIALIZED (SELECT * FROM ({_hot(_WIDE, 4, "left1")}) w WHERE NOT EXISTS (
  SELECT 1 FROM narrow b WHERE b.row_no = w.row_no AND b.start < w.stop AND w.start < b.stop)),
known AS MATERIALIZED (SELECT * FROM narrow UNION ALL SELECT * FROM wide),
left2 AS MATERIALIZED ({_blanked("left1", "known")}),
rest AS MATERIALIZED ({_hot(_WIDE, 4, "left2")}),
left3 AS MATERIALIZED ({_blanked("left2", "rest")}),
word AS MATERIALIZED (
  {_hot(_LOWER_WORD, 5, "left3", _WORD, _has("^[a-z0-9]+$", "[a-z]", "[0-9]"))} UNION ALL
  {_hot(_UPPER_WORD, 6, "left3", _WORD, _has("^[A-Z0-9]+$", "[A-Z]", "[0-9]"))} UNION ALL
  {_hot(_MIXED_WORD, 7, "left3", _WORD, _has("[A-Z]", "[a-z]", "[0-9]"))}),
counted AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, {_JOINED} AS spans FROM base GROUP BY row_no),
everything AS (SELECT row_no, {_JOINED} AS spans FROM (
  SELECT row_no, start, rank, stop, kind FROM base UNION ALL SELECT row_no, start, rank, stop, kind FROM known
  UNION ALL SELECT row_no, start, rank, stop, kind FROM rest UNION ALL SELECT row_no, start, rank, stop, kind FROM word) GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(c.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM doc LEFT JOIN counted c USING (row_no) LEFT JOIN everything e USING (row_no)
"""

_TWENTY = "CAST('0x' || substr(sha1(data), CAST(5 * s + 1 AS BIGINT), 5) AS BIGINT)"
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_TWENTY} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH page AS (SELECT page_id, url, coalesce(html, '') AS data FROM pages),
first AS (SELECT data, arg_min(struct_pack(page_id := page_id, url := url), (page_id IS NULL, page_id, url)) AS f
          FROM page GROUP BY data)
SELECT page_id, CAST(strlen(data) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda s: {_LETTERS}), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM f.page_id AND url IS NOT DISTINCT FROM f.url THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN NOT (page_id IS NOT DISTINCT FROM f.page_id AND url IS NOT DISTINCT FROM f.url) THEN f.page_id END AS refers_to
FROM page JOIN first USING (data)
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_lowered("text")}, {_ALNUM}) AS w
              FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
        FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all({_lowered("text")}, {_ALNUM}) AS w FROM documents),
found AS (SELECT row_no, i, n, item_id FROM (
            SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM doc, (SELECT DISTINCT n FROM win) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i))
          JOIN win USING (n, k)),
hit AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM found) GROUP BY row_no),
named AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT row_no, item_id FROM found) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (row_no) LEFT JOIN named USING (row_no)
"""

_SPACED = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all({_lowered("text")}, {_SPACED}) AS w FROM documents),
sets AS (SELECT doc_id, row_no, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
           ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
members AS MATERIALIZED (SELECT row_no, len(s) AS n, unnest(s) AS k FROM sets),
links AS MATERIALIZED (
  SELECT a.row_no AS a, b.row_no AS b FROM members a JOIN members b ON a.k = b.k AND a.row_no <> b.row_no
  WHERE 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n
  GROUP BY a.row_no, b.row_no, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT row_no AS a, row_no AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS row_no, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.row_no = r.b GROUP BY r.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN least USING (row_no)
"""

ORACLES: dict[str, str] = {
    "op1_secret_scans": SECRETS,
    "op3_warc": WARC,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op6_minhash_near_dedup": NEAR_DUPLICATES,
}
