"""SQL of the queries that SQL can express. The others (token ids, xxHash fingerprints, crc32 folds, gear
hashes) have no counterpart in it and are tested against brute force.
"""

from __future__ import annotations

from .op01_quality import LINE_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, NGRAM_LIMITS
from .op12_secrets import LEAST_ACCESS, LEAST_ASSIGN, LEAST_HEX, LEAST_RUN, LIVE_DIGITS, LIVE_DISTINCT, LIVE_LENGTH, LIVE_LETTERS, OWNERS, PLACEHOLDER, REPOSITORIES

WORD = r"[^\x20\x09-\x0D]+"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality() -> str:
    lengths = (3, *NGRAM_LIMITS)
    ctes = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)",
        f"w AS (SELECT r, unnest(regexp_extract_all(text, '{WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM d)",
        "words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r)",
        f"l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)",
        f"l2 AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS later, list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x))) AS chars FROM l)",
        "lines AS (SELECT r, count(*) FILTER (later AND chars > 0) AS n_dup_lines, coalesce(sum(chars) FILTER (later AND chars > 0), 0) AS dup_line_chars FROM l2 GROUP BY r)",
    ]
    for n in lengths:
        gram = " || ' ' || ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i)" if k else "word" for k in range(n))
        ctes += [
            f"g{n} AS (SELECT r, i, {gram} AS gram FROM w)",
            f"m{n} AS (SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS again FROM g{n})",
            f"c{n} AS (SELECT r, i, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM m{n})",
            f"s{n} AS (SELECT c.r, count(*) AS n, sum(length(word)) AS chars FROM c{n} c JOIN w ON w.r = c.r AND w.i = c.i WHERE inside GROUP BY c.r)",
        ]
    grams = ", ".join(f"CAST(coalesce(s{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)
    over = " OR ".join([f"dup_line_chars > {LINE_LIMIT} * word_chars", *(f"dup_{n}gram_chars > {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())])
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.r = d.r" for n in lengths)
    ctes.append(
        f"""f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, n_dup_lines,
    coalesce(s3.n, 0) AS n_repeat_words, CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {grams} FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN lines ON lines.r = d.r {joins})"""
    )
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT *, {failed} AS base_failed, NOT {failed} AND NOT ({over}) AS kept FROM f"


LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
o AS (SELECT k.*, h.key IS NOT NULL AND coalesce(k.doc_id <> h.keeper, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY r"""

TOP_K = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.r, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10"""


def _mixing() -> str:
    order = "doc_id NULLS FIRST, digest, nth"
    place = f"('0x' || substr(md5('mix:' || repeat || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || nth), 1, 13))::BIGINT / {float(16**13)!r}"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS nth FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST) AS n FROM w),
lv AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, round(CASE WHEN cap <= level * weight THEN cap ELSE weight * (SELECT arg_min(level, n) FROM lv WHERE NOT cap <= level * weight) END, 6) AS target FROM lv),
e AS (SELECT d.*, source_size, target, unnest([0, 1]) AS repeat FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE target > 0),
p AS (SELECT *, {place} AS place FROM e),
v AS (SELECT *, (repeat * source_size + sum(size) OVER (PARTITION BY source, repeat ORDER BY place, {order} ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS time FROM p),
c AS (SELECT r, sum(size) OVER (ORDER BY time, {order}, repeat ROWS UNBOUNDED PRECEDING) AS upto FROM v),
n AS (SELECT r, count(*) AS takes FROM c WHERE upto <= (SELECT round(sum(target), 3) FROM t) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(takes, 0) * size AS BIGINT) AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n USING (r)"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [(assign, 2, LEAST_ASSIGN), ("AKIA[A-Z0-9]+", 0, LEAST_ACCESS), ("[0-9a-f]{16,}", 0, LEAST_HEX), ("[A-Za-z0-9_]{20,}", 0, LEAST_RUN)]
    found = " UNION ALL ".join(f"SELECT r, doc_id, source, {k} AS kind, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS v FROM d" for k, (p, g, _) in enumerate(patterns))
    least = " ".join(f"WHEN {k} THEN {n}" for k, (_, _, n) in enumerate(patterns))
    sizes = lambda c, end: f"coalesce(list_sum(list_transform({c}[1:{end}], lambda x: length(x))), 0)"
    kept_chars = lambda c: f"length(regexp_replace(v, '[^{c}]', '', 'g'))"
    live = f"length(v) >= {LIVE_LENGTH} AND {kept_chars('A-Za-z')} >= {LIVE_LETTERS} AND {kept_chars('0-9')} >= {LIVE_DIGITS} AND len(list_distinct(string_split(v, ''))) >= {LIVE_DISTINCT} AND NOT regexp_matches(lower(v), '{PLACEHOLDER.pattern.decode()}')"
    names = "['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT r, doc_id, source, kind, CAST({sizes('p', 'i')} + {sizes('m', 'i - 1')} AS BIGINT) AS start, length(m[i]) AS size, v[i] AS v FROM each),
kept AS (SELECT *, start + size AS stop, start + size - length(v) AS v_start FROM placed WHERE length(v) >= CASE kind {least} END),
wide AS (SELECT v, count(*) AS repositories, count(DISTINCT coalesce('s' || source, '')) AS owners FROM (SELECT DISTINCT v, source, doc_id FROM kept) GROUP BY v),
judged AS (SELECT r, v_start AS start, stop, owners <= {OWNERS} AND repositories <= {REPOSITORIES} AS narrow, {live} AS live FROM (SELECT DISTINCT r, v_start, stop, v FROM kept) JOIN wide USING (v)),
spans AS (SELECT r, kind, start, stop FROM kept WHERE kind < 3 UNION ALL SELECT r, 3, start, stop FROM judged WHERE narrow AND live),
texts AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
    string_agg({names}, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg({names}, ',' ORDER BY start, kind, stop) AS spans FROM spans GROUP BY r),
copied AS (SELECT r, count(*) FILTER (NOT narrow) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (r) LEFT JOIN copied USING (r)"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    ctes = [
        "x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL) ORDER BY h LIMIT {k})",
    ]
    for i in range(rounds + 1):
        ctes += [
            f"f{i} AS (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS far FROM x, c{i})",
            f"a{i} AS (SELECT * FROM f{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, k) = 1)",
        ]
        if i < rounds:
            ctes += [
                f"m{i} AS (SELECT k, d, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS e FROM (SELECT k, unnest(v) AS e, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY k, d)",
                f"c{i + 1} AS (SELECT k, coalesce(n, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(e ORDER BY d) AS n FROM m{i} GROUP BY k) USING (k))",
            ]
    last = f"a{rounds}"
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} USING (k)"""


ORACLE_SQL = {"op1_quality_rules": _quality(), "op4_line_dedup": LINES, "op7_top_k": TOP_K, "op9_mixing": _mixing(), "op12_secret_scan": _secrets(), "op13_centroid_clusters": _clusters()}
