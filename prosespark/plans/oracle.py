"""DuckDB SQL of the queries, written apart from the engine: rows of lines and matches instead of arrays and folds."""

from __future__ import annotations

import re

from prosespark.functions import fixed
from prosespark.plans.queries import DECLARED, FEEDBACK_GENRES, FEEDBACK_METRICS, PATHS, SEASONED

WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*".replace("'", "''")
_ABBR = "|".join(re.escape(x) for x in sorted(fixed.ABBREVIATIONS, key=lambda x: (-len(x), x)))
_TLD = "|".join(sorted(fixed.TLDS, key=lambda x: (-len(x), x)))
_BODY, _LAST = r"[^\s<>()\[\]]", r"[^\s<>()\[\].,:;!?}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def folded(c: str) -> str:
    """Accented letters as x: RE2's word boundary knows ASCII only."""
    return f"regexp_replace({c}, '[À-ÖØ-öø-ÿĀ-ſ]', 'x', 'g')"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WORD}'))"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def without_urls(c: str) -> str:
    c = f"regexp_replace({c}, {q(rf'(?i)\bhttps?://{_BODY}*{_LAST}')}, ' ', 'g')"
    c = f"regexp_replace({c}, {q(rf'(?i)\bwww\.{_BODY}*{_LAST}')}, ' ', 'g')"
    bare = rf"(?i)(^|[^\w@.])(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{_TLD})(?:[:/?#]{_BODY}*{_LAST}|[/#])?"
    return f"regexp_replace({c}, {q(bare)}, '\\1 ', 'g')"


def split_sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?])(\\s)', '\\1' || chr(31) || '\\2', 'g')"
    glue = rf"(?i)(^|[^A-Za-z.])(\.*(?:{_ABBR})\.*\s*[.!?]+)"
    return f"string_split(regexp_replace({marked}, {q(glue)} || chr(31), '\\1\\2', 'g'), chr(31))"


BASE = f"""WITH s AS ({SEASONED}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM s WHERE text IS NOT NULL),
marked AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM lines),
blocks AS (SELECT doc_id, block, min(n) AS line_start, max(n) AS line_end, string_agg({trimmed("line")}, ' ' ORDER BY n) AS raw FROM marked WHERE trim(line) <> '' GROUP BY doc_id, block),
cleaned AS (SELECT doc_id, line_start, line_end, {trimmed(without_urls("raw"))} AS text FROM blocks),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS unit_idx, line_start, line_end, text FROM cleaned WHERE text <> ''),
pieces AS (SELECT doc_id, unit_idx, line_start, line_end, unnest(p) AS piece, unnest(range(0, len(p))) AS k FROM (SELECT *, {split_sentences("text")} AS p FROM units)),
sents AS (SELECT doc_id, unit_idx, line_start, line_end, {trimmed("piece")} AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY unit_idx, k) - 1 AS sent_idx FROM pieces WHERE {trimmed("piece")} <> ''),
counted AS (SELECT doc_id, sent_idx, {words("sentence")} AS n FROM sents),
wc AS (SELECT s.doc_id, coalesce(sum({words("u.text")}), 0) AS n_words, count(u.doc_id) AS n_units FROM s LEFT JOIN units u USING (doc_id) GROUP BY 1)
"""


def alternation(ws: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(re.escape(w).replace(r"\-", "-").replace(r"\ ", " ") for w in sorted(ws, key=lambda x: (-len(x), x))) + r")\b"


def hits(patterns: list[tuple[str, str]], low: bool = False) -> str:
    """Matches summed over a document's units; patterns are (flags, pattern)."""
    text = folded("lower(u.text)" if low else "u.text")
    one = " + ".join(f"len(regexp_extract_all({text}, {q(f + p)}))" for f, p in patterns)
    return f"SELECT s.doc_id, coalesce(sum({one}), 0)::BIGINT AS c FROM s LEFT JOIN units u USING (doc_id) GROUP BY 1"


def rate(c: str = "c") -> str:
    return f"CASE WHEN n_words > 0 THEN round(1000.0::DOUBLE * {c} / n_words, 3) ELSE 0.0::DOUBLE END"


NEGPAR = [("(?i)", "|".join(fixed.NEGATIVE_PARALLELISM))]
HITS = {
    "negative_parallelism": hits(NEGPAR),
    "rule_of_three": hits([("", fixed.RULE_OF_THREE)]),
    "vague_attribution": hits([("", alternation(fixed.VAGUE_ATTRIBUTION))], True),
    "stock_lexical_clusters": hits([("", alternation(v)) for v in fixed.STOCK_CLUSTERS.values()] + [("", p) for p in fixed.DUALITY_TEMPLATES], True),
    "generic_diction": hits([("", alternation(fixed.BUZZWORDS)), ("", alternation(fixed.INTENSIFIERS))], True),
    "adjective_requirements": hits([("(?i)", rf"\b(?:{'|'.join(fixed.REQUIREMENT_MODALS)})\s+(?:{'|'.join(fixed.REQUIREMENT_VERBS)})\s+(?:(?:{'|'.join(fixed.REQUIREMENT_DEGREES)})\s+)?(?:{'|'.join(fixed.REQUIREMENT_ADJECTIVES)})\b")]),
    "transition_clusters": "SELECT s.doc_id, count(x.doc_id)::BIGINT AS c FROM s LEFT JOIN (SELECT doc_id FROM sents WHERE regexp_matches(lower(sentence), " + q(rf"^(?:{'|'.join(fixed.TRANSITION_OPENERS)})(?:\P{{L}}|$)") + ")) x USING (doc_id) GROUP BY 1",
}
RATES = {"negative_parallelism", "transition_clusters"}
FLAGS = {"negative_parallelism": f"c >= {fixed.NEGATIVE_PARALLELISM_FLAG}", "transition_clusters": "c > 0", "generic_diction": f"c >= {fixed.GENERIC_DICTION_FLAG}", "adjective_requirements": "c >= 1"}


def phrase(metric: str) -> str:
    return f"{BASE}, h AS ({HITS[metric]}) SELECT h.doc_id, c AS count, {rate() if metric in RATES else 'NULL::DOUBLE'} AS rate, {FLAGS.get(metric, 'NULL::BOOLEAN')} AS soft_flag FROM h JOIN wc USING (doc_id)"


def contains_any(tokens: str, names: tuple[str, ...]) -> str:
    return f"list_has_any({tokens}, [{', '.join(map(q, names))}])"


STRUCTURE = f"""structure AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '{WORD}')) AS n,
    len(list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda w: replace(lower(w), '’', '''')), lambda w: w IN ({", ".join(map(q, fixed.FIRST_PERSON))}))) AS fp,
    {" + ".join(f"(contains(lower(text), {q(m)}))::INT" for m in fixed.PRD_MARKERS)} AS prd,
    len(regexp_extract_all({folded("text")}, {q("(?i)" + fixed.STRONG_MODALS)})) AS modals,
    regexp_extract_all({folded("text")}, {q("(?i)" + fixed.MARKETING)}) AS market
  FROM s),
classified AS (
  SELECT doc_id, CASE WHEN fp >= 3 AND fp >= 0.05::DOUBLE * n THEN 'personal' WHEN prd >= 2 THEN 'prd' WHEN modals >= 3 THEN 'spec'
    WHEN n > 0 AND len(market) >= 8 AND len(market) >= 0.008::DOUBLE * n AND len(list_distinct(list_transform(market, lambda x: lower(x)))) >= 4 THEN 'marketing' END AS g
  FROM structure)
"""
CLASSES = "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in fixed.METRIC_CLASS.items()) + ") AS c(metric, cls)"


def strip_pairs() -> str:
    """(genre, metric) that are stripped."""
    kept = [f"(genre = {q(g)} AND cls IN ({', '.join(map(q, cs))}))" for g, cs in fixed.GENRE_KEEPS.items() if cs]
    genres = "(VALUES " + ", ".join(f"({q(g)})" for g in fixed.GENRE_KEEPS) + ") AS g(genre)"
    return f"SELECT genre, metric, cls, CASE WHEN cls IN ({', '.join(map(q, fixed.ALWAYS_KEPT))}) OR {' OR '.join(kept)} THEN 'keep' ELSE 'strip' END AS recommendation FROM {genres}, {CLASSES}"


def numbers(c: str, quantity: bool) -> str:
    # the parts of a match are told apart again in the match itself
    m = "m"
    value = f"replace(replace(replace(replace({m}, '≤', '<='), '≥', '>='), '−', '-'), ',', '')"
    if not quantity:
        return f"SELECT doc_id, regexp_replace({value}, '\\s+', '', 'g') AS atom FROM (SELECT doc_id, unnest(regexp_extract_all({c}, {q(fixed.NUMBER)})) AS m FROM s)"
    bare = f"regexp_replace(regexp_replace({value}, '\\s*(?:%|[A-Za-z]{{1,12}})$', ''), '\\s+', '', 'g')"
    return f"SELECT doc_id, {bare} || '|' || lower(regexp_extract(m, '(%|[A-Za-z]{{1,12}})$', 1)) AS atom FROM (SELECT doc_id, unnest(regexp_extract_all({c}, {q(fixed.QUANTITY)})) AS m FROM s)"


def found(pattern: str, flags: str = "", post: str = "m") -> str:
    return f"SELECT doc_id, {post} AS atom FROM (SELECT doc_id, unnest(regexp_extract_all({folded('text')}, {q(flags + pattern)})) AS m FROM s)"


def _phrase(ws: tuple[str, ...], space: str) -> str:
    return r"\b(?:" + "|".join(space.join(re.escape(w).replace(r"\-", "-") for w in p.split(" ")) for p in ws) + r")\b"


_SP, _LOW = r"regexp_replace(m, '\s+', ' ', 'g')", "lower(m)"
_SPLOW = r"regexp_replace(lower(m), '\s+', ' ', 'g')"
_CITES = found(fixed.CITATION, "", _SP)
_URLS = found(fixed.URL, "(?i)", "regexp_replace(m, '[.,;:]+$', '')")
ATOMS = {
    "number": numbers("text", False),
    "date": found(fixed.DATE, "", _SP),
    "url": _URLS,
    "citation": _CITES,
    "threshold": found(fixed.THRESHOLD, "(?i)", _LOW),
    "buzzword": found(_phrase(tuple(sorted(fixed.BUZZWORDS, key=lambda x: (-len(x), x))), " "), "(?i)", _LOW),
    "borrowed_authority": found(_phrase(tuple(sorted(fixed.VAGUE_ATTRIBUTION, key=lambda x: (-len(x), x))), r"\s+"), "(?i)", _SPLOW),
    "quantity": numbers("text", True),
    "modality": found(_phrase(fixed.MODALS, r"\s+"), "(?i)", _SPLOW),
    "negation": found(fixed.NEGATION, "(?i)", _LOW),
    "condition": found(fixed.CONDITION, "(?i)", _SPLOW),
    "proper_noun": None,
    "cross_ref": f"{_CITES} UNION ALL {_URLS}",
}
CLAIMS = ("number", "date", "url", "citation", "threshold", "buzzword", "borrowed_authority")
SEASON = f"WITH s AS ({SEASONED})"


def claims_of(source: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {q(k)} AS category, atom FROM ({ATOMS[k]})".replace("FROM s", f"FROM {source}") for k in CLAIMS)


_N = "octet_length(encode(s.text))"
_TAIL = "octet_length(encode(string_split(s.text, chr(10) || chr(10))[-1]))"
#: The added paragraph is ASCII, so its edits can be made on characters from the end.
CASES = f"""{SEASON}, sized AS (SELECT doc_id, text, length(text) AS n_chars, {_N} AS n, {_TAIL} AS tail FROM s),
cases AS (SELECT *, n - tail AS start, n_chars - tail AS cstart, doc_id % 10 AS kind FROM sized),
edit_rows AS (
  SELECT doc_id, 0 AS edit_idx, CASE kind WHEN 0 THEN n - 2 WHEN 3 THEN n WHEN 5 THEN start + 10 WHEN 6 THEN n - 8 WHEN 1 THEN start WHEN 2 THEN start WHEN 4 THEN start ELSE start + 5 END AS a,
    CASE kind WHEN 0 THEN n + 5 WHEN 1 THEN n WHEN 2 THEN start WHEN 3 THEN n WHEN 4 THEN start + 4 WHEN 5 THEN start + 20 WHEN 6 THEN n - 1 ELSE start + 6 END AS b,
    CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 23 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 1 END AS len FROM cases
  UNION ALL SELECT doc_id, 1, CASE kind WHEN 4 THEN n - 4 ELSE start END, CASE kind WHEN 4 THEN n ELSE start + 1 END, CASE kind WHEN 4 THEN 4 ELSE 1 END FROM cases WHERE kind IN (4, 6))"""
SPLICED = f"""{CASES}, r AS (SELECT doc_id, kind, CASE kind
  WHEN 1 THEN left(text, cstart) WHEN 2 THEN left(text, cstart) || 'Now. ' || substr(text, cstart + 1) WHEN 3 THEN text || ' It can save 99% of it.'
  WHEN 4 THEN left(text, cstart) || 'A ' || substr(text, cstart + 5, n_chars - 4 - cstart - 4) || 'all.'
  WHEN 5 THEN left(text, cstart + 10) || 'plain' || substr(text, cstart + 21)
  WHEN 6 THEN left(text, cstart) || 'W' || substr(text, cstart + 2, n_chars - 8 - cstart - 1) || 'robust' || right(text, 1)
  WHEN 0 THEN NULL ELSE left(text, cstart + 5) || '_' || substr(text, cstart + 7) END AS rev FROM cases)
SELECT doc_id, CASE WHEN kind = 0 THEN 'out_of_bounds' ELSE '' END AS problems, octet_length(encode(rev))::BIGINT AS n_bytes, sha256(rev) AS sha FROM r"""
LOCALITY = f"""{CASES}, ranges AS (SELECT doc_id, start AS s, n - 4 AS t FROM cases WHERE doc_id % 2 = 1)
SELECT e.doc_id, e.edit_idx::BIGINT AS edit_idx, e.a::BIGINT AS a, e.b::BIGINT AS b, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = e.doc_id AND r.s <= e.a AND e.b <= r.t) AS ok FROM edit_rows e"""

FEEDBACK = f"""SELECT event_id, [{", ".join(map(q, ("discard", "edit", "apply")))}][event_id % 3 + 1] AS user_action, [{", ".join(map(q, FEEDBACK_GENRES))}][user_id % {len(FEEDBACK_GENRES)} + 1] AS genre,
  [{", ".join(map(q, FEEDBACK_METRICS))}][event_id % {len(FEEDBACK_METRICS)} + 1] AS metric, CASE WHEN event_id % 5 = 0 THEN 'keep' ELSE 'strip' END AS recommendation FROM events"""
OVERLAY = f"""WITH f AS ({FEEDBACK}) SELECT genre, cls AS metric_class, sum(CASE user_action WHEN 'discard' THEN 1.0::DOUBLE WHEN 'edit' THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END) AS score
FROM f JOIN {CLASSES} USING (metric) WHERE recommendation = 'strip' GROUP BY 1, 2 HAVING score >= {fixed.MIN_EVIDENCE}::DOUBLE"""

RUNS = f"""per AS (SELECT u.doc_id, u.unit_idx, u.line_start, u.line_end, count(x.doc_id) AS n FROM units u LEFT JOIN sents x USING (doc_id, unit_idx) GROUP BY ALL),
islands AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_idx) - row_number() OVER (PARTITION BY doc_id, n ORDER BY unit_idx) AS island FROM per),
runs AS (SELECT doc_id, n AS sentences_each, count(*) AS paragraphs, min(line_start) AS line_start, max(line_end) AS line_end FROM islands WHERE n >= 1 GROUP BY doc_id, n, island HAVING count(*) >= {fixed.RUN_MIN})"""
OPENERS = f"""toks AS (SELECT doc_id, sent_idx, line_start, line_end, list_transform(regexp_extract_all(sentence, '{WORD}'), lambda w: replace(lower(w), '’', '''')) AS w FROM sents),
openers AS (SELECT doc_id, sent_idx, line_start, line_end, k, array_to_string(w[1:k], ' ') AS prefix FROM toks, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= 2 AND len(w) >= k),
gaps AS (SELECT *, CASE WHEN sent_idx - lag(sent_idx) OVER w <= {fixed.OPENER_GAP} THEN 0 ELSE 1 END AS new FROM openers WINDOW w AS (PARTITION BY doc_id, k, prefix ORDER BY sent_idx)),
sessions AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k, prefix ORDER BY sent_idx) AS session FROM gaps),
clusters AS (SELECT doc_id, k AS prefix_len, prefix, count(*) AS sentences, arg_min(line_start, sent_idx) AS line_start, arg_max(line_end, sent_idx) AS line_end FROM sessions GROUP BY doc_id, k, prefix, session HAVING count(*) >= {fixed.OPENER_MIN})"""

DISTRIBUTION = f"""{BASE}, g AS (SELECT doc_id, count(*) AS n, min(n) AS lo, max(n) AS hi, quantile_cont(n, [0.10, 0.25, 0.5, 0.75, 0.90]) AS p, sum(n)::DOUBLE / count(*) AS mean, sum(n * n)::DOUBLE / count(*) AS sq FROM counted GROUP BY 1)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, lo::BIGINT AS min_words, p[1]::DOUBLE AS p10, p[2]::DOUBLE AS p25, p[3]::DOUBLE AS median, p[4]::DOUBLE AS p75, p[5]::DOUBLE AS p90, hi::BIGINT AS max_words, round(mean, 3) AS mean, round(sqrt(greatest(0.0::DOUBLE, sq - mean * mean)), 3) AS sd
FROM s LEFT JOIN g USING (doc_id)"""
DISPERSION = f"""{BASE}, steps AS (SELECT doc_id, n, abs(n - lag(n) OVER (PARTITION BY doc_id ORDER BY sent_idx)) AS step FROM counted),
g AS (SELECT doc_id, count(*) AS c, quantile_cont(n, 0.25)::DOUBLE AS a, quantile_cont(n, 0.5)::DOUBLE AS m, quantile_cont(n, 0.75)::DOUBLE AS b, sum(n)::DOUBLE / count(*) AS mean, sum(n * n)::DOUBLE / count(*) AS sq, quantile_cont(step, 0.5)::DOUBLE AS d FROM steps GROUP BY 1)
SELECT s.doc_id, coalesce(c, 0)::BIGINT AS n_sentences, CASE WHEN c > 1 THEN round((b - a) / nullif(m, 0), 3) END AS iqr_over_median, CASE WHEN c > 1 THEN round(sqrt(greatest(0.0::DOUBLE, sq - mean * mean)) / nullif(mean, 0), 3) END AS cov, CASE WHEN c > 1 THEN d END AS median_adjacent_diff
FROM s LEFT JOIN g USING (doc_id)"""
PUNCTUATION = f"""{BASE}, h AS (SELECT s.doc_id, coalesce(sum(len(regexp_extract_all(u.text, '—')) + len(list_filter(regexp_extract_all(u.text, '-+'), lambda x: length(x) = 2))), 0)::BIGINT AS em, coalesce(sum(len(regexp_extract_all(u.text, ';'))), 0)::BIGINT AS semicolons FROM s LEFT JOIN units u USING (doc_id) GROUP BY 1),
r AS (SELECT h.*, n_words, {rate("em")} AS a, {rate("semicolons")} AS b FROM h JOIN wc USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, em AS em_dash, semicolons AS semicolon, a AS em_dash_per_1k, b AS semicolon_per_1k, a > {fixed.EM_DASH_PER_1K} OR b > {fixed.SEMICOLON_PER_1K} AS soft_flag FROM r"""
LINE_STARTS = f"""{SEASON}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM s)
SELECT doc_id, n::BIGINT AS line, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM l
UNION ALL SELECT doc_id, len(string_split(text, chr(10))) + 1, octet_length(encode(text))::BIGINT FROM s WHERE text IS NOT NULL"""
GENRES = f"""{SEASON}, {STRUCTURE} SELECT doc_id, coalesce(g, '{fixed.FALLBACK_GENRE}') AS genre, CASE WHEN g IS NULL THEN 'low' ELSE 'medium' END AS genre_confidence, CASE WHEN g IS NULL THEN 'fallback' ELSE 'structure' END AS genre_reason FROM classified"""
ADJECTIVES = f"""{BASE}, {STRUCTURE}, h AS ({HITS["adjective_requirements"]}) SELECT h.doc_id, c AS count, c >= 1 AS soft_flag FROM h JOIN classified USING (doc_id) WHERE g = 'prd'"""
NEW_CLAIMS = f"""WITH s AS ({SEASONED}), o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rev AS ({claims_of("s")}), orig AS ({claims_of("o")})
SELECT DISTINCT doc_id, category, atom FROM rev WHERE atom <> '2019' AND NOT EXISTS (SELECT 1 FROM orig WHERE orig.doc_id = rev.doc_id AND orig.category = rev.category AND orig.atom = rev.atom)"""
FIRST, SECOND = ("i", "we", "me", "us", "my", "our", "mine", "ours", "i'm", "we're", "we'll", "i'll", "i've", "we've", "i'd", "we'd"), ("you", "your", "yours", "you're", "you'll", "you've", "you'd", "yourself")
VOICES = f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations),
f AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w, list_filter(list_transform({split_sentences("text")}, lambda x: {trimmed("x")}), lambda x: x <> '') AS sents FROM t),
g AS (SELECT *, len(w) AS n, len(sents) AS k, list_transform(w, lambda x: lower(x)) AS low FROM f),
h AS (SELECT *, len(list_filter(low, lambda x: x IN ({", ".join(map(q, FIRST))}))) AS one, len(list_filter(low, lambda x: x IN ({", ".join(map(q, SECOND))}))) AS two FROM g)
SELECT doc_id, CASE WHEN n > 0 THEN round(len(list_filter(w, lambda x: contains(x, '''') OR contains(x, '’')))::DOUBLE / n, 4) ELSE 0.0::DOUBLE END AS contraction_rate,
  CASE WHEN k > 0 THEN round(list_sum(list_transform(sents, lambda x: {words("x")}))::DOUBLE / k, 4) ELSE 0.0::DOUBLE END AS mean_sentence_len,
  CASE WHEN n = 0 THEN 'none' WHEN one = 0 AND two = 0 THEN 'third' WHEN one >= two THEN 'first' ELSE 'second' END AS person_lean,
  round(len(regexp_extract_all(text, '!'))::DOUBLE / greatest(1, k), 4) AS exclamation_rate, round(len(regexp_extract_all(text, '\\?'))::DOUBLE / greatest(1, k), 4) AS question_rate,
  round(len(regexp_extract_all(text, '—| -- '))::DOUBLE / greatest(1, k), 4) AS em_dash_rate, round(len(regexp_extract_all(text, ';'))::DOUBLE / greatest(1, k), 4) AS semicolon_rate, n::BIGINT AS sample_words FROM h"""
POINTS = f"""{BASE}, mean AS (SELECT doc_id, round(round(sum(n)::DOUBLE / count(*), 3), 1) AS value FROM counted GROUP BY 1),
label AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1),
size AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM s),
points AS (SELECT ['transition_clusters', 'negative_parallelism', 'rule_of_three'][doc_id % 3 + 1] AS metric, value, quality = 0 AS positive, lang AS genre, CASE WHEN w < 150 THEN 'short' WHEN w < 600 THEN 'medium' ELSE 'long' END AS length,
  CASE WHEN doc_id % 3 = 2 THEN 'rule_of_three' ELSE 'synthetic_cadence' END AS tell, doc_id AS item_id FROM mean JOIN label USING (doc_id) JOIN size USING (doc_id)),
fitted AS (SELECT * FROM points WHERE item_id % 4 <> 0),
vals AS (SELECT DISTINCT metric, value FROM fitted),
cuts AS (SELECT metric, min(value) - 1e-9::DOUBLE AS t FROM vals GROUP BY 1 UNION ALL SELECT metric, max(value) + 1e-9::DOUBLE FROM vals GROUP BY 1
  UNION ALL SELECT metric, (value + nxt) / 2 FROM (SELECT metric, value, lead(value) OVER (PARTITION BY metric ORDER BY value) AS nxt FROM vals) WHERE nxt IS NOT NULL),
scored AS (SELECT c.metric, t, count(*) FILTER (positive AND value >= t) AS tp, count(*) FILTER (NOT positive AND value >= t) AS fp, count(*) FILTER (positive AND value < t) AS fn, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg FROM cuts c JOIN fitted USING (metric) GROUP BY 1, 2),
ranked AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, row_number() OVER (PARTITION BY metric ORDER BY coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, t) AS r FROM scored),
fit AS (SELECT metric, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(t, 6) END AS threshold, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(f1, 6) END AS f1, n_pos, n_neg, CASE WHEN n_pos = 0 OR n_neg = 0 THEN 'insufficient_labels' END AS reason FROM ranked WHERE r = 1)
"""
STRATA = f"""{POINTS}, flags AS (SELECT p.*, p.value >= f.threshold AS flagged FROM points p LEFT JOIN fit f USING (metric) WHERE item_id % 4 = 0),
cells AS (SELECT CASE WHEN grouping(tell) = 0 THEN 'tell' WHEN grouping(genre) = 0 THEN 'genre' WHEN grouping(length) = 0 THEN 'length' ELSE 'overall' END AS axis,
  CASE WHEN grouping(tell) = 0 THEN tell WHEN grouping(genre) = 0 THEN genre WHEN grouping(length) = 0 THEN length ELSE 'all' END AS stratum,
  count(*) AS n, count(*) FILTER (flagged IS NULL) AS abstained, count(*) FILTER (flagged AND positive) AS tp, count(*) FILTER (flagged AND NOT positive) AS fp, count(*) FILTER (NOT flagged AND positive) AS fn
  FROM flags GROUP BY GROUPING SETS ((), (tell), (genre), (length)))
SELECT axis, stratum, n, abstained, round(abstained::DOUBLE / n, 4) AS abstention_rate, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall FROM cells"""
JUDGED = """WITH base AS (SELECT DISTINCT user_id AS case_id FROM events), grid AS (SELECT case_id, t.trial, s.side, d.dim FROM base, range(3) t(trial), (VALUES ('candidate'), ('baseline')) s(side), range(9) d(dim)),
trials AS (SELECT *, (case_id * 7 + trial * 3 + dim * 5) % 2 + CASE WHEN side = 'candidate' AND case_id % 3 > 1 THEN 1 ELSE 0 END AS score FROM grid),
med AS (SELECT case_id, dim, median(score) FILTER (side = 'candidate') AS c, median(score) FILTER (side = 'baseline') AS b FROM trials GROUP BY 1, 2),
v AS (SELECT case_id, sum(c) >= sum(b) AND bool_and(c >= b - 1) AND bool_or(c > b) AS beat FROM med GROUP BY 1),
e AS (SELECT case_id, count(DISTINCT trial) AS n_trials, bool_or(score NOT IN (0, 1, 2)) AS errored FROM trials GROUP BY 1)
SELECT case_id::BIGINT AS case_id, n_trials, errored OR n_trials < 3 AS errored, beat AND NOT (errored OR n_trials < 3) AS beat FROM e JOIN v USING (case_id)"""
_GATES = """WITH r AS (SELECT user_id % 40 AS fixture, event_type AS gate, count(*) AS n FROM events GROUP BY 1, 2),
ranked AS (SELECT fixture, gate, [2, 0, 1][(n + fixture) % 3 + 1] AS a, [2, 0, 1][(n * 2 + fixture) % 3 + 1] AS b FROM r)"""
COMPARED = f"""{_GATES} SELECT fixture::BIGINT AS fixture, count(*) FILTER (a > b) AS gates_better, count(*) FILTER (a < b) AS gates_worse, CASE WHEN count(*) FILTER (a < b) > 0 THEN 'LOSES' WHEN count(*) FILTER (a > b) > 0 THEN 'BEATS' ELSE 'TIES' END AS verdict FROM ranked GROUP BY 1"""
ACCEPTED = f"""{_GATES} SELECT fixture::BIGINT AS fixture, count(*) AS n_gates, CASE WHEN min(a) = 0 THEN 'FAIL' WHEN min(a) = 1 THEN 'INCOMPLETE' ELSE 'PASS' END AS state FROM ranked GROUP BY 1"""
FEEDBACK_PROBLEMS = """SELECT event_id, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'schema_version' END, CASE WHEN k % 17 = 0 THEN 'finding_id_empty' END, CASE WHEN k % 7 <> 0 AND k % 13 = 0 THEN 'ts_not_iso' END, CASE WHEN k % 7 = 0 THEN 'ts_without_time' END,
  CASE WHEN k % 19 = 0 THEN 'genre' END, CASE WHEN k % 23 = 0 THEN 'recommendation' END, CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN 'replacement_not_base64' END, CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'replacement_not_allowed' END,
  CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'alternative_not_allowed' END, CASE WHEN k % 29 = 0 THEN 'reason' END) AS problems FROM (SELECT event_id, event_id AS k FROM events)"""


def _has(pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({folded('seg')}, {q(flags + pattern)})"


def _n(pattern: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all({folded('seg')}, {q(flags + pattern)}))"


_MODAL = _phrase(fixed.MODALS, r"\s+")
CHECKS = f"""segs AS (SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS k FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])(\\s+)', '\\1' || chr(31) || '\\2', 'g'), '(\\n[ \\t]*\\n)', chr(31) || '\\1', 'g'), chr(31)) AS p FROM s)),
placed AS (SELECT doc_id, k, {trimmed("piece")} AS seg, coalesce(sum(octet_length(encode(piece))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + octet_length(encode(piece)) - octet_length(encode(regexp_replace(piece, '^\\s+', ''))) AS start_byte FROM segs),
checked AS (SELECT *, regexp_matches(seg, '\\d') AS number, {_has(_MODAL)} AS modal, {_has(fixed.NEGATION)} AS neg, {_has(fixed.CONDITION)} AS cond, {_has(fixed.CITATION, "")} OR {_has(fixed.URL)} AS refs, {_has(fixed.DEFINED_TERM)} AS term FROM placed WHERE seg <> ''),
regions AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS region_idx FROM checked WHERE number OR modal OR neg OR cond OR refs OR term)"""
REGIONS = f"""{SEASON}, {CHECKS} SELECT doc_id, region_idx, start_byte::BIGINT AS start_byte, (start_byte + octet_length(encode(seg)))::BIGINT AS end_byte,
concat_ws(',', CASE WHEN number THEN 'numbers,units' END, CASE WHEN modal THEN 'modality' END, CASE WHEN neg THEN 'negation' END, CASE WHEN cond THEN 'conditions' END, CASE WHEN refs THEN 'cross_refs' END, CASE WHEN term THEN 'defined_terms' END) AS checks FROM regions"""
_SIZES = {"number_or_quantity": f"len(regexp_extract_all(seg, {q(fixed.QUANTITY)}))", "normative_statement": f"{_n(_MODAL)} + {_n(fixed.NEGATION)}", "condition": _n(fixed.CONDITION), "cross_reference": f"{_n(fixed.CITATION, '')} + {_n(fixed.URL)}", "defined_term": "1"}
_FLAG = {"numbers": "number", "units": "number", "modality": "modal", "negation": "neg", "conditions": "cond", "cross_refs": "refs", "defined_terms": "term"}
ENTRIES = f"{SEASON}, {CHECKS} " + " UNION ALL ".join(
    f"SELECT doc_id, 'e' || region_idx || '_{c}' AS entry_id, '{k}' AS kind, start_byte::BIGINT AS start_byte, (start_byte + octet_length(encode(seg)))::BIGINT AS end_byte, sha256(seg) AS text_hash, '{p}' AS preservation, {n}::BIGINT AS confidence, ({_SIZES[k]})::BIGINT AS n_extracted FROM regions WHERE {_FLAG[c]}"
    for c, (k, p, n) in fixed.CHECK_KIND.items()
)


def _unit_hit(metric: str, patterns: list[tuple[str, str]], low: bool) -> str:
    text = folded("lower(text)" if low else "text")
    return f"SELECT doc_id, '{metric}' AS metric, line_start, line_start AS line_end FROM units WHERE " + " OR ".join(f"regexp_matches({text}, {q(f + p)})" for f, p in patterns)


_ADJECTIVE = rf"\b(?:{'|'.join(fixed.REQUIREMENT_MODALS)})\s+(?:{'|'.join(fixed.REQUIREMENT_VERBS)})\s+(?:(?:{'|'.join(fixed.REQUIREMENT_DEGREES)})\s+)?(?:{'|'.join(fixed.REQUIREMENT_ADJECTIVES)})\b"
#: Caps on locations don't show: a unit counts once whatever its number of matches.
LOCATED = " UNION ALL ".join([
    _unit_hit("negative_parallelism", NEGPAR, False),
    _unit_hit("rule_of_three", [("", fixed.RULE_OF_THREE)], False),
    _unit_hit("vague_attribution", [("", alternation(fixed.VAGUE_ATTRIBUTION))], True),
    _unit_hit("stock_lexical_clusters", [("", alternation(v)) for v in fixed.STOCK_CLUSTERS.values()] + [("", p) for p in fixed.DUALITY_TEMPLATES], True),
    _unit_hit("generic_diction", [("", alternation(fixed.BUZZWORDS)), ("", alternation(fixed.INTENSIFIERS))], True),
    "SELECT doc_id, 'transition_clusters', line_start, line_start FROM sents WHERE regexp_matches(lower(sentence), " + q(rf"^(?:{'|'.join(fixed.TRANSITION_OPENERS)})(?:\P{{L}}|$)") + ")",
    "SELECT doc_id, 'paragraph_sentence_count_runs', line_start, line_end FROM runs",
    "SELECT doc_id, 'repeated_openers', line_start, line_end FROM clusters",
    f"SELECT u.doc_id, 'adjective_requirements', u.line_start, u.line_start FROM units u JOIN classified USING (doc_id) WHERE g = 'prd' AND regexp_matches({folded('u.text')}, {q('(?i)' + _ADJECTIVE)})",
])
RANGES = f"""{BASE}, {STRUCTURE}, {RUNS}, {OPENERS}, located AS ({LOCATED}), advice AS ({strip_pairs()}),
diag AS (SELECT l.* FROM located l JOIN classified c USING (doc_id) JOIN advice a ON a.metric = l.metric AND a.genre = coalesce(c.g, '{fixed.FALLBACK_GENRE}') WHERE a.recommendation = 'strip'),
starts AS (SELECT doc_id, n AS line, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lines),
sizes AS (SELECT doc_id, octet_length(encode(text)) AS size, len(string_split(text, chr(10))) AS last FROM s),
hit AS (SELECT DISTINCT u.doc_id, a.b AS start_byte, CASE WHEN u.line_end >= z.last THEN z.size ELSE e.b END AS end_byte FROM units u JOIN sizes z USING (doc_id) JOIN starts a ON a.doc_id = u.doc_id AND a.line = u.line_start LEFT JOIN starts e ON e.doc_id = u.doc_id AND e.line = u.line_end + 1
  WHERE EXISTS (SELECT 1 FROM diag d WHERE d.doc_id = u.doc_id AND NOT (u.line_end < d.line_start OR u.line_start > d.line_end))),
gaps AS (SELECT *, CASE WHEN start_byte > max(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM hit),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start_byte) AS i FROM gaps)
SELECT doc_id, min(start_byte)::BIGINT AS start_byte, max(end_byte)::BIGINT AS end_byte FROM islands GROUP BY doc_id, i"""
RANGES = RANGES.replace("islands AS (SELECT *, sum(new)", "merged AS (SELECT *, sum(new)").replace("FROM islands GROUP BY doc_id, i", "FROM merged GROUP BY doc_id, i").replace("gaps AS (SELECT *, CASE WHEN start_byte", "apart AS (SELECT *, CASE WHEN start_byte").replace("AS i FROM gaps)", "AS i FROM apart)")


#: An edit strictly around an offset maps it nowhere; edits that end before it shift it.
STATUSES = f"""{CASES}, {CHECKS}, r AS (SELECT g.doc_id, g.region_idx, g.start_byte AS x, g.start_byte + octet_length(encode(g.seg)) AS y FROM regions g),
maps AS (SELECT r.doc_id, r.region_idx, c.kind, x, y, sum(CASE WHEN b <= x THEN len - (b - a) ELSE 0 END) AS dx, sum(CASE WHEN b <= y THEN len - (b - a) ELSE 0 END) AS dy, bool_or(a < x AND b > x) AS in_x, bool_or(a < y AND b > y) AS in_y,
  bool_or(b > a AND a <= x AND b >= y) AS gone, bool_or(b > x AND a < y) AS hit FROM r JOIN cases c USING (doc_id) JOIN edit_rows e USING (doc_id) GROUP BY ALL)
SELECT doc_id, region_idx, CASE WHEN kind > 0 AND NOT in_x THEN x + dx END::BIGINT AS rev_start, CASE WHEN kind > 0 AND NOT in_y THEN y + dy END::BIGINT AS rev_end,
  CASE WHEN kind = 0 THEN 'invalid_script' WHEN gone THEN 'deleted' WHEN in_x OR in_y THEN 'ambiguous' WHEN hit THEN 'modified' ELSE 'unchanged' END AS status FROM maps"""
ADVISED = f"""{BASE}, {STRUCTURE}, {RUNS}, {OPENERS}, located AS ({LOCATED}), advice AS ({strip_pairs()}), told AS (SELECT doc_id, coalesce(g, '{fixed.FALLBACK_GENRE}') AS genre FROM classified)"""
FLAGGED = PUNCTUATION.removeprefix(BASE).removeprefix(", ").replace("h AS (", "pcounts AS (").replace("FROM h JOIN", "FROM pcounts JOIN").replace("SELECT h.*", "SELECT pcounts.*").replace("r AS (SELECT", "prates AS (SELECT").replace("FROM r", "FROM prates")
_PC, _PF = FLAGGED.rsplit("\nSELECT ", 1)
STATUS = f"""{ADVISED}, {_PC}, flags AS (SELECT {_PF}), live AS (SELECT DISTINCT doc_id, metric FROM located UNION SELECT doc_id, 'punctuation_rates' FROM flags WHERE soft_flag)
SELECT s.doc_id, CASE WHEN count(l.metric) > 0 THEN 'flagged' ELSE 'clean' END AS audit_status, coalesce(bool_or(a.recommendation = 'strip'), false) AS has_strip
FROM s JOIN told t USING (doc_id) LEFT JOIN live l USING (doc_id) LEFT JOIN advice a ON a.metric = l.metric AND a.genre = t.genre GROUP BY 1"""
LEARNED = f"""{ADVISED}, keeps AS (SELECT genre, metric_class FROM ({OVERLAY})),
spots AS (SELECT DISTINCT u.doc_id, l.metric, u.line_start, u.line_end FROM located l JOIN units u ON u.doc_id = l.doc_id AND u.line_end >= l.line_start AND u.line_start <= l.line_end),
judged AS (SELECT t.genre, p.metric, CASE WHEN a.recommendation = 'strip' AND EXISTS (SELECT 1 FROM keeps k WHERE k.genre = t.genre AND k.metric_class = a.cls) THEN 'keep' ELSE a.recommendation END AS recommendation
  FROM spots p JOIN told t USING (doc_id) JOIN advice a ON a.metric = p.metric AND a.genre = t.genre)
SELECT genre, metric, recommendation, count(*) AS n FROM judged GROUP BY ALL"""
_TABLE = lambda t: "CASE metric " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in t.items()) + " END"


def _counts(metric: str, eligible: str, soft: str = "NULL::BOOLEAN") -> str:
    return f"SELECT doc_id, {q(metric)} AS metric, {eligible} AS eligible, c AS n, {soft} AS soft FROM ({HITS[metric]}) JOIN sizes_of USING (doc_id)"


_METRICS = " UNION ALL ".join([
    *(f"SELECT doc_id, {q(m)} AS metric, n_sents AS eligible, n_sents AS n, NULL::BOOLEAN AS soft FROM sizes_of" for m in ("sentence_length_distribution", "sentence_length_dispersion")),
    "SELECT doc_id, 'punctuation_rates', n_words, em_dash + semicolon, soft_flag FROM flags",
    "SELECT doc_id, 'bold_label_density', n_units, 0, NULL FROM sizes_of",
    *(_counts(m, "n_words" if m in RATES else "n_units", FLAGS.get(m, "NULL::BOOLEAN")) for m in HITS if m != "adjective_requirements"),
    f"SELECT a.* FROM ({_counts('adjective_requirements', 'n_units', 'c >= 1')}) a JOIN told USING (doc_id) WHERE genre = 'prd'",
    "SELECT z.doc_id, 'paragraph_sentence_count_runs', any_value(n_units), count(r.doc_id), count(r.doc_id) > 0 FROM sizes_of z LEFT JOIN runs r USING (doc_id) GROUP BY 1",
    "SELECT z.doc_id, 'repeated_openers', any_value(n_sents), count(c.doc_id), count(c.doc_id) > 0 FROM sizes_of z LEFT JOIN clusters c USING (doc_id) GROUP BY 1",
])
TOTALS = f"""{ADVISED}, {_PC}, flags AS (SELECT {_PF}), sizes_of AS (SELECT wc.*, (SELECT count(*) FROM sents x WHERE x.doc_id = wc.doc_id) AS n_sents FROM wc), every AS ({_METRICS})
SELECT metric, {_TABLE(fixed.METRIC_CLASS)} AS metric_class, {_TABLE(fixed.METRIC_CONFIDENCE)} AS confidence, {_TABLE(fixed.METRIC_VERSION)} AS metric_version, count(*) AS n_docs, sum(n)::BIGINT AS total, sum(eligible)::BIGINT AS eligible, count(*) FILTER (soft) AS n_soft FROM every GROUP BY 1"""
_REV = SPLICED.rsplit("\nSELECT doc_id, CASE WHEN kind = 0", 1)[0]
CLAIM_GATE = f"""{_REV}, after_ AS (SELECT doc_id, rev AS text FROM r WHERE rev IS NOT NULL), new_ AS ({claims_of("after_")}), old_ AS ({claims_of("s")})
SELECT DISTINCT doc_id, category, atom FROM new_ WHERE NOT EXISTS (SELECT 1 FROM old_ WHERE old_.doc_id = new_.doc_id AND old_.category = new_.category AND old_.atom = new_.atom)"""
_FALSE = ENTRIES.split(CHECKS, 1)[1].strip()
LEDGER_PROBLEMS = f"""{SEASON}, {CHECKS}, e AS ({_FALSE}), k AS (SELECT *, (doc_id + start_byte) % 9 AS k FROM e), f AS (SELECT doc_id, k, CASE WHEN k = 6 THEN 'e' ELSE entry_id END AS entry_id FROM k),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, entry_id) AS same FROM f)
SELECT doc_id, entry_id, CASE k WHEN 1 THEN 'text_hash_mismatch' WHEN 2 THEN 'bad_confidence' WHEN 3 THEN 'bad_kind' WHEN 4 THEN 'bad_preservation' ELSE 'out_of_bounds' END AS problem FROM g WHERE k BETWEEN 1 AND 5
UNION ALL SELECT doc_id, entry_id, 'duplicate_id' FROM g WHERE same > 1"""


def _extracted(check: str, kind: str, flag: str) -> str:
    parts = {"number_or_quantity": [("", "quantity")], "normative_statement": [("modals:", "modality"), ("neg:", "negation")], "condition": [("", "condition")], "cross_reference": [("cites:", "citation"), ("urls:", "url")]}
    if kind == "defined_term":
        return f"SELECT doc_id, 'e' || region_idx || '_{check}' AS entry_id, trim(regexp_replace(seg, '\\s+', ' ', 'g')) AS atom FROM regions WHERE {flag}"
    # the extractors read s(doc_id, text): here a row a region, known by its place
    return " UNION ALL ".join(f"SELECT g.doc_id, 'e' || g.region_idx || '_{check}' AS entry_id, '{tag}' || x.atom AS atom FROM ({ATOMS[name]}) x JOIN regions g ON x.doc_id = g.doc_id * 1000000 + g.region_idx WHERE g.{flag}".replace("FROM s)", "FROM segs_of)") for tag, name in parts[kind])


EXTRACTED = f"""{SEASON}, {CHECKS}, segs_of AS (SELECT doc_id * 1000000 + region_idx AS doc_id, seg AS text FROM regions), every AS ({" UNION ALL ".join(_extracted(c, k, _FLAG[c]) for c, (k, _, _) in fixed.CHECK_KIND.items())})
SELECT doc_id, entry_id, atom, count(*) AS n FROM every GROUP BY ALL"""
PROPER = f"""SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g'), {q(fixed.PROPER_NOUN)})) AS atom FROM s"""
_TEXT_OR_NULL = lambda names: "[" + ", ".join("NULL" if x is None else q(x) for x in names) + "]"
_PATH_CASES = " ".join(f"WHEN list_has_any(tokens, [{', '.join(map(q, names))}]) THEN {q(g)}" for g, names in fixed.PATH_TOKENS)
_ALIASES = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.GENRE_ALIASES.items())
TOLD = f"""{SEASON}, {STRUCTURE}, t AS (SELECT doc_id, g, lower(trim({_TEXT_OR_NULL(DECLARED)}[doc_id % {len(DECLARED)} + 1])) AS said, string_split_regex(lower({_TEXT_OR_NULL(PATHS)}[(doc_id // 7) % {len(PATHS)} + 1]), '[/\\\\._\\-\\s]+') AS tokens FROM classified),
u AS (SELECT doc_id, CASE said {_ALIASES} END AS a, CASE {_PATH_CASES} END AS b, g FROM t)
SELECT doc_id, coalesce(a, b, g, '{fixed.FALLBACK_GENRE}') AS genre, CASE WHEN a IS NOT NULL THEN 'high' WHEN coalesce(b, g) IS NOT NULL THEN 'medium' ELSE 'low' END AS genre_confidence,
  CASE WHEN a IS NOT NULL THEN 'declared' WHEN b IS NOT NULL THEN 'path' WHEN g IS NOT NULL THEN 'structure' ELSE 'fallback' END AS genre_reason FROM u"""
PARSED = """SELECT doc_id, 0::BIGINT AS idx, doc_id AS start_byte, doc_id + 3 AS end_byte, '' AS replacement, CASE doc_id % 3 WHEN 1 THEN sha256('abc') WHEN 2 THEN 'ab' END AS preimage_sha256 FROM documents
UNION ALL SELECT doc_id, 1, 0, 1, CASE WHEN doc_id % 4 <> 0 THEN doc_id::VARCHAR END, NULL FROM documents"""
EQUAL = """SELECT doc_id, doc_id % 3 = 2 AS same, doc_id % 3 <> 1 AS alike FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {
        "e1_parsed_scripts": PARSED,
        "e7_region_status": STATUSES,
        "e9_equal_material": EQUAL,
        "f6_audit_status": STATUS,
        "m14_metric_totals": TOTALS,
        "c9_learned_findings": LEARNED,
        "l4_extracted_atoms": EXTRACTED,
        "l6_ledger_problems": LEDGER_PROBLEMS,
        "l10_claim_gate": CLAIM_GATE,
        "g1_told_genres": TOLD,
        "a_proper_noun_atoms": f"{SEASON} SELECT doc_id, atom, count(*) AS n FROM ({PROPER}) GROUP BY ALL",
        "x1_text_units": f"{BASE} SELECT doc_id, unit_idx, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, length(text)::BIGINT AS n_chars, sha256(text) AS sha FROM units",
        "x7_sentences": f"{BASE} SELECT doc_id, sent_idx, unit_idx, {words('sentence')}::BIGINT AS n_words, sha256(sentence) AS sha FROM sents",
        "x9_line_starts": LINE_STARTS,
        "m1_sentence_length_distribution": DISTRIBUTION,
        "m2_sentence_length_dispersion": DISPERSION,
        "m3_punctuation_rates": PUNCTUATION,
        "m4_negative_parallelism": phrase("negative_parallelism"),
        "m5_rule_of_three": phrase("rule_of_three"),
        "m6_paragraph_runs": f"{BASE}, {RUNS} SELECT doc_id, sentences_each, paragraphs, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM runs",
        "m8_repeated_openers": f"{BASE}, {OPENERS} SELECT doc_id, prefix_len::BIGINT AS prefix_len, prefix, sentences, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM clusters",
        "m9_transition_clusters": phrase("transition_clusters"),
        "m10_vague_attribution": phrase("vague_attribution"),
        "m11_stock_clusters": phrase("stock_lexical_clusters"),
        "m12_generic_diction": phrase("generic_diction"),
        "m13_adjective_requirements": ADJECTIVES,
        "m17_recommendations": f"SELECT genre, metric, recommendation FROM ({strip_pairs()})",
        "g4_genres": GENRES,
        **{f"a_{k}_atoms": f"{SEASON} SELECT doc_id, atom, count(*) AS n FROM ({v}) GROUP BY 1, 2" for k, v in ATOMS.items() if v},
        "a15_new_claims": NEW_CLAIMS,
        "l2_invariant_regions": REGIONS,
        "l3_ledger_entries": ENTRIES,
        "i6_authorized_ranges": RANGES,
        "e3_spliced": SPLICED,
        "l7_locality": LOCALITY,
        "c5_thresholds": f"{POINTS} SELECT * FROM fit",
        "c6_strata": STRATA,
        "c2_split_disjointness": "SELECT DISTINCT concat_ws('/', source, lang) AS source_family FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT DISTINCT concat_ws('/', source, lang) FROM documents WHERE doc_id % 5 <> 0",
        "c8_overlay": OVERLAY,
        "c10_voice_features": VOICES,
        "h4_judged": JUDGED,
        "h6_gate_comparison": COMPARED,
        "h2_acceptance": ACCEPTED,
        "v1_feedback_problems": FEEDBACK_PROBLEMS,
    }
