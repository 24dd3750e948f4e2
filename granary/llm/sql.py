"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from granary.llm.pii import CONTEXT, CONTEXT_WEIGHT, IBAN_LENGTHS, KINDS, MIN_SCORE
from granary.llm.quality import MAX_HOST_RATE, RULES, SURE
from granary.llm.topk import SCALE, TOP

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

def _host_rules() -> str:
    """Per host: shrunk failure rates of each rule and the verdict; the prior by moments over all hosts."""
    sums = ", ".join(f"sum(CAST(({rule}) AS INTEGER)) AS f_{r}" for r, rule in RULES.items())
    moments = ", ".join(f"sum(f_{r}) / CAST(sum(n) AS DOUBLE) AS m_{r}, sum(f_{r} * f_{r} / CAST(n AS DOUBLE)) AS q_{r}" for r in RULES)
    excess = ", ".join(f"m_{r}, CASE WHEN k > 1 AND m_{r} * (1 - m_{r}) > 0 AND n > k THEN (k / (k - 1.0) * (q_{r} - n * m_{r} * m_{r}) / n - m_{r} * (1 - m_{r}) * k / n) / (m_{r} * (1 - m_{r}) * (1 - k / n)) END AS x_{r}" for r in RULES)
    strength = ", ".join(f"m_{r}, CASE WHEN x_{r} > 0 THEN least(1e6, greatest(2.0, 1 / x_{r} - 1)) ELSE 1e6 END AS s_{r}" for r in RULES)
    prior = ", ".join(f"greatest(m_{r}, 1e-9) * s_{r} AS a_{r}, greatest(1 - m_{r}, 1e-9) * s_{r} AS b_{r}" for r in RULES)
    rates = ", ".join(f"(f_{r} + a_{r}) / (n + a_{r} + b_{r}) AS rate_{r}, n + a_{r} + b_{r} AS t_{r}" for r in RULES)
    bad = " OR ".join(f"rate_{r} - {SURE} * sqrt(rate_{r} * (1 - rate_{r}) / (t_{r} + 1)) > {MAX_HOST_RATE}" for r in RULES)
    return f"""h AS (SELECT source, count(*) AS n, {sums} FROM f WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, {moments} FROM h),
e AS (SELECT {excess} FROM a), z AS (SELECT {strength} FROM e), p AS (SELECT {prior} FROM z), u AS (SELECT source, {rates} FROM h, p),
v AS (SELECT *, {bad} AS bad FROM u)"""


#: Words, repeated windows of eight, repeated lines and the host verdicts with their fitted priors.
QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 7)) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM k, range(0, 8) x(o) WHERE n > 1 GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, {RULES["short"]} OR {RULES["repeats"]} AS base_failed FROM m),
{_host_rules()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept, {", ".join(f"round(rate_{r}, 9) AS rate_{r}" for r in RULES)} FROM f LEFT JOIN v ON f.source = v.source"""


def _spans(kind: str, rank: int, pattern: str, test: str) -> str:
    """Rows (doc_id, s, rank, e, kind, score, v, t) of one kind; places and what stands beside come from the text between matches."""
    _, _, score, more, less = KINDS[kind]
    beside = rf"lower(right(g, {CONTEXT}) || chr(10) || left(h, {CONTEXT}))"
    hits, gaps = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    return rf"""SELECT doc_id, CAST(s AS BIGINT) AS s, {rank} AS rank, CAST(s + length(v) AS BIGINT) AS e, '{kind}' AS kind, v, t,
 least(100, greatest(0, {score} + CASE WHEN regexp_matches({beside}, '\b(?:{more})') THEN {CONTEXT_WEIGHT} ELSE 0 END - CASE WHEN regexp_matches({beside}, '\b(?:{less})') THEN {CONTEXT_WEIGHT} ELSE 0 END)) AS score FROM (
 SELECT doc_id, t, v, g, h, sum(length(g)) OVER o + coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
 FROM (SELECT doc_id, t, unnest({hits}) AS v, unnest(list_slice({gaps}, 1, len({hits}))) AS g, unnest(list_slice({gaps}, 2, len({hits}) + 1)) AS h, unnest(range(0, len({hits}))) AS i FROM d)
 WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {test}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) ELSE (CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) * 2) // 10 + (CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) * 2) % 10 END)) % 10 = 0"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_MOD = "list_reduce(list_prepend(0, list_transform(range(1, length(a) + 1), lambda i: ascii((substr(a, 5) || substr(a, 1, 4))[i]))), lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1"

#: All kinds of personal data; the two added ones last.
PII = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
 UNION ALL {_spans("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(v, '{_OCTET}(?:\.{_OCTET}){{3}}')")}
 UNION ALL {_spans("card", 2, r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
 UNION ALL {_spans("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
x AS (SELECT doc_id, s, rank, e, kind, score FROM (SELECT *, replace(v, ' ', '') AS a FROM ({_spans("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "true")})) WHERE {_MOD} AND contains('{IBAN_LENGTHS}', substr(a, 1, 2) || length(a)) AND score >= {MIN_SCORE}),
y AS (SELECT doc_id, s, rank, e, kind, score FROM ({_spans("ssn", 5, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "true")})
 WHERE NOT regexp_matches(substr(t, s, 1), '[0-9-]') AND NOT regexp_matches(substr(t, e + 1, 1), '[0-9-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND score >= {MIN_SCORE}),
al AS (SELECT doc_id, s, rank, e, kind, score FROM b UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans,
 coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN al ON d.doc_id = al.doc_id GROUP BY d.doc_id"""

#: Exact inner products of integer vectors.
TOPK = f"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""

#: Token shares, the exponent by 48 halvings, budgets, and block permutations by md5.
MIX = r"""WITH RECURSIVE d AS (SELECT doc_id, source, md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) / CAST((SELECT sum(tokens) FROM d) AS DOUBLE) AS share FROM d GROUP BY 1),
c AS (SELECT count(*) AS k, sum(tokens) AS total FROM s WHERE tokens > 0),
q1 AS (SELECT ln(sum(share)) - sum(share * ln(share)) / sum(share) AS e1, max(share / tokens) / sum(share) * (SELECT total FROM c) AS r1 FROM s WHERE tokens > 0),
be(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
  (SELECT ln(sum(power(share, (lo + hi) / 2))) - sum(power(share, (lo + hi) / 2) * ln(power(share, (lo + hi) / 2))) / sum(power(share, (lo + hi) / 2)) FROM s WHERE tokens > 0) >= 0.98 * ln((SELECT k FROM c)) AS ok FROM be WHERE i < 48)),
ae AS (SELECT CASE WHEN (SELECT k FROM c) < 2 OR (SELECT e1 FROM q1) >= 0.98 * ln((SELECT k FROM c)) THEN 1.0 ELSE (SELECT lo FROM be WHERE i = 48) END AS a),
ra AS (SELECT max(power(share, a) / tokens) / sum(power(share, a)) * (SELECT total FROM c) AS r FROM s, ae WHERE tokens > 0),
br(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
  (SELECT max(power(share, (lo + hi) / 2) / tokens) / sum(power(share, (lo + hi) / 2)) * (SELECT total FROM c) FROM s WHERE tokens > 0) > 4.0 AS ok FROM br WHERE i < 48)),
al AS (SELECT CASE WHEN (SELECT k FROM c) < 2 THEN 1.0 WHEN (SELECT r FROM ra) > 4.0 THEN CASE WHEN (SELECT r1 FROM q1) <= 4.0 THEN (SELECT lo FROM br WHERE i = 48) + power(2.0, -48) ELSE 1.0 END ELSE (SELECT a FROM ae) END AS a),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN power(share, a) ELSE 0 END AS w FROM s, al),
n AS (SELECT source, tokens AS al, CAST(floor(w / (SELECT sum(w) FROM p) * (SELECT total FROM c) + 1e-6) AS BIGINT) AS budget, greatest(1, CAST(ceil(tokens / 2000000.0) AS BIGINT)) AS blocks FROM p),
b AS (SELECT d.*, al, budget, CAST('0x' || substr(key, 1, 15) AS BIGINT) % blocks AS block FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
pb AS (SELECT source, block, sum(tokens) AS t, any_value(budget) AS budget, any_value(al) AS al FROM b GROUP BY 1, 2),
ep AS (SELECT *, unnest(range(1, 1 + CASE WHEN al > 0 THEN greatest(1, CAST(ceil(budget / CAST(al AS DOUBLE)) AS BIGINT)) ELSE 1 END)) AS epoch FROM pb),
st AS (SELECT *, (epoch - 1) * al - t + sum(t) OVER (PARTITION BY source, epoch ORDER BY md5('mix/' || coalesce(source, '') || '/' || epoch || '/' || block), block ROWS UNBOUNDED PRECEDING) AS start FROM ep),
tk AS (SELECT * FROM st WHERE start < budget OR t = 0),
rw AS (SELECT b.doc_id, b.source, b.tokens, tk.epoch, tk.start + tk.t <= tk.budget AS whole, tk.start + sum(b.tokens) OVER (PARTITION BY b.source, b.block, tk.epoch ORDER BY md5('mix/' || tk.epoch || '/' || b.key)) AS en, tk.budget FROM b JOIN tk ON b.source IS NOT DISTINCT FROM tk.source AND b.block = tk.block)
SELECT doc_id, source, tokens AS n_tokens, CAST(epoch AS INTEGER) AS epoch FROM rw WHERE whole OR en <= budget"""

SQL = {"op2_pii": PII, "op3_quality": QUALITY, "op6_mixing": MIX, "op8_topk": TOPK}
