"""SQL of the operators on integer codes, importance resampling and URLs."""

from __future__ import annotations

from .url_filter import BINS, HELD_OUT, ORDER, REACH, STRENGTH, Rule

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t"


def _crc(text: str) -> str:
    """Unsigned CRC of a text's UTF-8 bytes, with the table ``t`` at hand."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1]), 4294967295), 4294967295)".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = ""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (SELECT vec_id, label, part, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e
FROM (SELECT p.*, c.e, {far} AS d FROM p JOIN c{i} c USING (part)) GROUP BY 1, 2, 3)"""
        if i < rounds:
            steps += f""", m{i} AS (SELECT part, e, list(floor(s / n)::BIGINT ORDER BY j) AS v FROM (SELECT part, e, j, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, e))"""
    last = rounds
    return f"""WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM q, range({parts}) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {entries})){steps},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{last}),
f AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""


def importance_resampling(percent: int = 10, min_words: int = 20, buckets: int = 10_000, seed: int = 2024) -> str:
    words = f"regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"
    return f"""WITH crc AS ({_CRC_TABLE}), d AS (SELECT doc_id, unnest({words}) AS w FROM documents), b AS (SELECT unnest({words}) AS w FROM benchmark),
k AS MATERIALIZED (SELECT w, {_crc("w")} % {buckets} AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM d JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN x USING (doc_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {min_words}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {min_words} AND r <= {percent} * n // 100 THEN r END AS rank FROM z"""


def url_filter(rules: list[Rule]) -> str:
    """For URLs in ASCII."""
    quoted = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    fit = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in quoted) + " END"
    part = lambda i: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')"
    levels = ""
    for k in range(1, ORDER + 2):
        q = {c: f"q.p{c}" if k > 1 else "1 / 256::DOUBLE" for c in "ar"}
        p = {c: f"({c} + {STRENGTH}::DOUBLE * {q[c]}) / (N{c} + {STRENGTH}::DOUBLE)" for c in "ar"}
        join = f"JOIN l{k - 1} q ON q.g = substr(x.g, 2)" if k > 1 else ""
        levels += f""", l{k} AS MATERIALIZED (SELECT *, floor(1e6 * ln(pa / pr))::BIGINT AS d FROM (SELECT x.g, {p["a"]} AS pa, {p["r"]} AS pr, {"q.d" if k > 1 else "0"} AS shorter FROM stats x {join} WHERE len(x.g) = {k}))"""
    model = " UNION ALL ".join(f"SELECT g, d - shorter AS gain FROM l{k}" for k in range(1, ORDER + 2))
    most, step = BINS * REACH, 1_000_000 // BINS
    return f"""WITH crc AS ({_CRC_TABLE}), u AS (SELECT page_id, coalesce(url, '') AS url, translate({part(1)}, '{_UP}', '{_LOW}') AS host, {part(2)} AS path FROM pages),
j AS MATERIALIZED (SELECT *, {fit(lambda r: r.text)} AS rule, {fit(lambda r: r.verdict)} AS decided, url <> '' AND {_crc("url")} % {HELD_OUT} = 0 AS test FROM u, crc),
w AS (SELECT DISTINCT url, repeat(chr(2), {ORDER}) || url || chr(3) AS x FROM j),
runs AS MATERIALIZED (SELECT url, substr(x, (i - k)::INT, (k + 1)::INT) AS g, count(*) AS n FROM (SELECT url, x, unnest(range({ORDER + 1}, len(x) + 1)) AS i FROM w), range({ORDER + 1}) r(k) GROUP BY 1, 2),
counts AS (SELECT g, sum(CASE WHEN decided = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN decided = 'block' THEN n ELSE 0 END) AS r FROM j JOIN runs USING (url) WHERE decided IS NOT NULL AND NOT test GROUP BY 1),
stats AS MATERIALIZED (SELECT *, sum(a) OVER c AS Na, sum(r) OVER c AS Nr FROM counts WINDOW c AS (PARTITION BY substr(g, 1, len(g) - 1), len(g))){levels},
model AS ({model}), total AS (SELECT url, sum(n * gain) AS total FROM runs JOIN model USING (g) GROUP BY 1),
both_ AS (SELECT count(DISTINCT decided) = 2 AS two FROM j WHERE decided IS NOT NULL AND NOT test),
s AS MATERIALIZED (SELECT j.*, CASE WHEN two THEN floor(coalesce(total, 0) / (octet_length(encode(url)) + 1))::BIGINT ELSE 0 END AS score FROM j LEFT JOIN total USING (url), both_),
bins AS (SELECT greatest(-{most}, least({most}, floor(score / {step}))) AS bin, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS r FROM s WHERE decided IS NOT NULL AND test GROUP BY 1),
edge AS (SELECT e, round(sum(a) FILTER (bin >= e) / sum(a) + coalesce(sum(r) FILTER (bin < e), 0) / sum(r), 12) AS good FROM range(-{most}, {most} + 1) t(e), bins GROUP BY 1),
cut AS (SELECT coalesce((SELECT e * {step} FROM edge WHERE good IS NOT NULL AND (SELECT sum(a) > 0 AND sum(r) > 0 FROM bins) ORDER BY good DESC, abs(e), e LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= CASE WHEN two THEN least ELSE 0 END THEN 'allow' ELSE 'block' END) AS verdict FROM s, cut, both_"""
