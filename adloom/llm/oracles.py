"""SQL (DuckDB) for the corpus queries that SQL can express."""

from __future__ import annotations

from adloom.llm.secrets import ACCESS, ALLOW, ASSIGN, CLASSES, HEX, KINDS, SCALE, entropy_limit

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    """name: doc_id, hit, start_at, end_at of a pattern's matches."""
    p = _quoted(pattern)
    return f"""{name}_parts AS (SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS hit, unnest(string_split_regex(t, {p})) AS gap, unnest(range(len(string_split_regex(t, {p})))) AS i FROM docs WHERE regexp_matches(t, {p})),
{name} AS (SELECT doc_id, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS end_at, end_at - length(hit) AS start_at FROM {name}_parts QUALIFY hit IS NOT NULL)"""


def _windows(no: int, name: str, alphabet: str, window: int, bits: float) -> str:
    run = "[" + alphabet.replace("-", r"\-") + f"]{{{window},}}"
    listed = "|".join(f"(?:{a})" for a in ALLOW)
    allow, whole = _quoted(listed), _quoted(f"^(?:{listed})$")
    return f"""{_matches(name, run)},
{name}_w AS (SELECT doc_id, start_at, hit, unnest(range(length(hit) - {window} + 1)) AS w FROM {name} WHERE NOT regexp_matches(hit, {whole})),
{name}_c AS (SELECT doc_id, start_at, w, substr(hit, w + k, 1) AS ch, count(*) AS c FROM (SELECT *, unnest(range(1, {window} + 1)) AS k FROM {name}_w WHERE NOT regexp_matches(substr(hit, w + 1, {window}), {allow})) GROUP BY ALL),
{name}_h AS (SELECT doc_id, start_at + w AS s FROM {name}_c GROUP BY doc_id, start_at, w HAVING sum(round(c * log2(c) * {SCALE})::BIGINT) <= {entropy_limit(window, bits)}),
{name}_g AS (SELECT doc_id, s, sum((s > coalesce(p, -1000000) + {window})::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM {name}_h)),
{name}_s AS (SELECT doc_id, {no} AS kind_no, min(s) AS start_at, max(s) + {window} AS end_at FROM {name}_g GROUP BY doc_id, island)"""


_NAMED = "SELECT doc_id, 0 AS kind_no, start_at, end_at FROM assign_m WHERE length(regexp_extract(hit, {}, 2)) >= 6 UNION ALL SELECT doc_id, 1, start_at, end_at FROM access_m UNION ALL SELECT doc_id, 2, start_at, end_at FROM hex_m".format(_quoted(ASSIGN))
_KIND = "(" + str(list(KINDS)) + ")[kind_no + 1]"
_LIST = f"string_agg({_KIND} || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no, end_at)"

OP1 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_matches("assign_m", ASSIGN)},
{_matches("access_m", ACCESS)},
{_matches("hex_m", HEX)},
{", ".join(_windows(3 + i, f"class{i}", *c[1:]) for i, c in enumerate(CLASSES))},
spans AS ({_NAMED} {" ".join(f"UNION ALL SELECT doc_id, kind_no, start_at, end_at FROM class{i}_s" for i in range(len(CLASSES)))}),
per AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS b, count(*) FILTER (kind_no = 2) AS c, {_LIST} FILTER (kind_no < 3) AS base, {_LIST} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (doc_id)"""

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY ALL"""

OP3 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d"""

OP6 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, {LOWER.format(f"trim(line, {SPACES})")} AS key FROM l),
common AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> last_doc AS gone FROM k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

#: Seats one by one by highest quotients; positions from one running sum per source.
OP8 = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(concat_ws('|', '42', doc_id)) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap, ceil(source_size / 16)::BIGINT AS blocks FROM s),
v AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT *, least(cap, weight * (SELECT min_by(lvl, ratio) FROM v WHERE ratio >= lvl)) AS target, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey FROM v),
q AS (SELECT skey, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, skey, k) AS r FROM (SELECT skey, target, unnest(range(floor(target / 16)::BIGINT + 50)) AS k FROM t WHERE target > 0)),
won AS (SELECT skey, count(*) * 16 AS words FROM q WHERE r <= (SELECT round(sum(source_size) / 16.0) FROM s) GROUP BY skey),
g AS (SELECT t.*, CASE WHEN source_size > 0 THEN least(3, floor(coalesce(words, 0) / source_size))::BIGINT ELSE 0 END AS passes,
  CASE WHEN passes < 3 AND source_size > 0 THEN least(blocks, round((coalesce(words, 0) - passes * source_size) * blocks::DOUBLE / source_size)::BIGINT) ELSE 0 END AS rest FROM t LEFT JOIN won USING (skey)),
sh AS (SELECT skey, rest, shard, least(16384, blocks - shard * 16384) AS in_shard FROM (SELECT *, unnest(range((blocks + 16383) // 16384)) AS shard FROM g WHERE blocks > 0)),
sq AS (SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY in_shard / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT *, unnest(range(in_shard)) AS k FROM sh)),
quota AS (SELECT sh.skey, sh.shard, in_shard, count(sq.r) FILTER (sq.r <= rest) AS quota, list_filter([1000003, 1299709, 1500007, 1618033, 2000003, 15485863], lambda p: p % in_shard <> 0)[1] AS prime FROM sh LEFT JOIN sq ON sq.skey = sh.skey AND sq.shard = sh.shard GROUP BY ALL),
pos AS (SELECT d.*, g.source_size, g.target, g.passes, g.skey, coalesce(sum(size) OVER (PARTITION BY g.skey ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_word
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
b AS (SELECT *, unnest(range(at_word // 16, (at_word + size - 1) // 16 + 1)) AS j FROM pos WHERE size > 0),
hit AS (SELECT b.doc_id, sum(least((j + 1) * 16, at_word + size) - greatest(j * 16, at_word)) AS extra FROM b JOIN quota u ON u.skey = b.skey AND u.shard = j // 16384
  WHERE quota >= in_shard OR (coalesce(prime, 1000003) * (j - u.shard * 16384) + 42 * 7919 + u.shard * 104729) % in_shard < quota GROUP BY b.doc_id)
SELECT doc_id, size, source_size, target, (passes * size + coalesce(extra, 0))::BIGINT AS taken FROM pos LEFT JOIN hit USING (doc_id)"""

OP11 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

OP13 = f"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM q, (SELECT unnest([1, 2, 3, 4]) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
cuts AS (SELECT lang, size, phrase, w, f AS a, unnest(range(1, size)) AS k FROM c WHERE size > 1),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))),
h AS (SELECT lang, phrase, max(f) AS longer FROM sub GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score FROM low JOIN n ON n.lang = low.lang LEFT JOIN h ON h.lang = low.lang AND h.phrase = low.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""

ORACLES = {"op1_secret_scan": OP1, "op2_ngram_jaccard": OP2, "op3_exact_dedup": OP3, "op6_line_dedup": OP6, "op8_mixing": OP8, "op11_hard_negatives": OP11, "op13_phrases": OP13}
