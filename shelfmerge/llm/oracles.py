"""DuckDB texts for the operators that SQL can express."""

from __future__ import annotations

from shelfmerge.llm import chat_format, knn_join, link_graph
from shelfmerge.llm import decontaminate as dc

MARK = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))"


def escaped(c: str) -> str:
    return f"regexp_replace({c}, '{MARK}', '\\1\\\\\\2\\3', 'g')"


OP1 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length({escaped("role")}) + length({escaped("text")}) + CASE WHEN role = 'assistant' THEN 20 ELSE 33 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
assert len("<s>[ROLE][/ROLE]</s>") == 20 and "[ROLE]" in chat_format.TEMPLATE

OP2 = """WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to, coalesce(url, '') AS url FROM p LEFT JOIN f ON f.d = p.d"""

OP5 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({knn_join.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % {knn_join.EVERY} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {knn_join.K}"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def op6() -> str:
    rest = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(link_graph.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for h, p, v in rules) + " END"
    href = link_graph.HREF.replace("'", "''")
    rounds, k = [], link_graph.DAMPING
    for n in range(link_graph.ROUNDS):
        rounds.append(
            f"r{n + 1} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT dst AS host, {k} * t * fw AS t, 0.0 AS d FROM l JOIN r{n} ON src = host "
            f"UNION ALL SELECT src, 0.0, {k} * d * bw FROM l JOIN r{n} ON dst = host UNION ALL SELECT host, (1 - {k}) * t, (1 - {k}) * d FROM r0) GROUP BY host)"
        )
    return f"""WITH p AS (SELECT page_id, html, {low(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS v FROM p),
e AS (SELECT host AS src, {low("unnest(regexp_extract_all(html, '" + href + "', 1))")} AS dst FROM p),
c AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM e WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
l AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS fw, n / sum(n) OVER (PARTITION BY dst) AS bw FROM c),
a AS (SELECT host, count(*) FILTER (WHERE v = 'allow') AS a, count(*) FILTER (WHERE v = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
r0 AS (SELECT host, a / greatest(1, (SELECT sum(a) FROM a)) AS t, b / greatest(1, (SELECT sum(b) FROM a)) AS d FROM a WHERE a > 0 OR b > 0),
{", ".join(rounds)},
bad AS (SELECT host FROM r{link_graph.ROUNDS} WHERE round(d, 12) > round(t, 12) AND EXISTS (SELECT 1 FROM c))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
W = dc.WINDOW
OP8 = f"""WITH dw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({low("text")}, '{WORD}'), []) AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({low("text")}, '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, {W} AS l, array_to_string(w[p:p + {W - 1}], ' ') AS s FROM bw, unnest(range(1, len(w) - {W - 2})) t(p) WHERE len(w) >= {W}
UNION SELECT item, len(w), array_to_string(w, ' ') FROM bw WHERE len(w) BETWEEN 1 AND {W - 1}),
lens AS (SELECT DISTINCT l FROM win),
dwin AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS s FROM dw, lens, unnest(range(1, len(w) - l + 2)) t(p)),
hit AS (SELECT DISTINCT r, p, dwin.l, item FROM dwin JOIN win ON win.s = dwin.s AND win.l = dwin.l),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + l)) t(q) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN its ON its.r = dw.r"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low("text")}, '{TERM}') AS t FROM documents),
l AS (SELECT doc_id, r, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
b AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all({low("text")}, '{TERM}') AS t FROM benchmark),
asked AS (SELECT DISTINCT q, term FROM (SELECT q, unnest(t) AS term FROM b)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN l USING (r), c GROUP BY q, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
(SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN l USING (r) WHERE score > 0) JOIN b USING (q) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op2_warc": OP2, "op5_knn_join": OP5, "op6_url_filter": op6(), "op8_decontamination": OP8, "op13_ranked_search": OP13}
