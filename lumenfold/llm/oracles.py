"""DuckDB statements that give the rows of those queries which SQL can express."""

from __future__ import annotations

from . import audit as _audit
from . import resampling as _resampling
from .decontam import WINDOW as ITEM_WINDOW
from .minhash import PERCENT
from .quality import STOP_WORDS, THRESHOLDS, WINDOW
from .repeats import LENGTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_BLANK}'), lambda x: x <> '')"


def quality() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    metric = {
        "n_words": "CAST(n_words AS DOUBLE)",
        "chars_per_word": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
        "stop_ratio": "CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END",
        "ellipsis_line_ratio": "CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END",
    }
    tests = []
    for r in THRESHOLDS:
        bounds = [f"{metric[r.metric]} < {r.low}::DOUBLE"] * (r.low is not None) + [f"{metric[r.metric]} > {r.high}::DOUBLE"] * (r.high is not None)
        tests.append(f"CASE WHEN ({' OR '.join(bounds)}) AND n_words >= {r.least_words} THEN '{r.name}' END")
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_words("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM (SELECT rid, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW}))),
    r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY rid),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS BIGINT) AS n_bullet_lines, CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS BIGINT) AS n_ellipsis_lines FROM t LEFT JOIN r USING (rid)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL), ',') AS broken FROM m)
    SELECT *, NOT base_failed AND broken = '' AS kept FROM f"""


def near_duplicates() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, least(doc_id, coalesce(c.least, doc_id)) = doc_id AS kept FROM s LEFT JOIN c USING (doc_id)"""


def contamination() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    k = ITEM_WINDOW
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least({k}, len(w)) AS n, array_to_string(w[i : i + least({k}, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {k - 2}))) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)"""


def repeats() -> str:
    n = LENGTH
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS win FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1})) AS i FROM d WHERE len(h) >= {2 * n})),
    c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM w) WHERE first < doc_id),
    s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + {n} THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM s),
    r AS (SELECT doc_id, run, min(i) AS a, max(i) + {n} AS b FROM g GROUP BY doc_id, run),
    k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
    t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM k GROUP BY doc_id),
    x AS (SELECT k.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)"""


def audit() -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, [len(w) < {_audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < {_audit.LEAST_DISTINCT} * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > {_audit.MOST_CAPITALS} * length(t), regexp_matches(t, '{_audit.SYMBOLS}'), coalesce(least < doc_id, false)] AS fails FROM w),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    x AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS k),
    o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
    r AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda i: fails[ascii(filter_order[i]) - 64])), 6) AS first FROM f LEFT JOIN l USING (doc_id), o),
    c AS (SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (first < step AND fails[ascii(filter_order[step]) - 64]) AS redundant,
        count(*) FILTER (fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
        FROM r JOIN s USING (filter_order) GROUP BY part, filter_order, step)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM c"""


def resampling() -> str:
    """CRC-32 by its rule: a table of 256 entries, each a byte divided eight times, folded over a word's bytes."""
    r = _resampling
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS k),
    d AS (SELECT doc_id, {words} AS w FROM documents), e AS (SELECT unnest(w) AS word FROM d), b AS (SELECT unnest({words}) AS word FROM benchmark),
    h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM e UNION SELECT word FROM b)),
    c AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, y: xor(k[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % {r.BUCKETS} AS bucket FROM h, k),
    s AS (SELECT bucket, count(*) AS s FROM e JOIN c USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (word) GROUP BY bucket),
    n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS big_s, (SELECT coalesce(sum(t), 0) FROM t) AS big_t),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + {r.BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + {r.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), n),
    u AS (SELECT row_number() OVER () AS rid, doc_id, w FROM d), v AS (SELECT rid, sum(gain) AS weight FROM (SELECT rid, unnest(w) AS word FROM u) JOIN c USING (word) JOIN g USING (bucket) GROUP BY rid),
    z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{r.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM u LEFT JOIN v USING (rid)),
    q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= {r.LEAST_WORDS} AS eligible FROM z),
    p AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS i, count(*) FILTER (eligible) OVER () AS total FROM q)
    SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND i <= {r.PER_CENT} * total // 100 THEN i END AS rank FROM p"""
