"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

from voxmend.llm.mixing import BLOCK_WORDS, GOLDEN, LOW_BITS, MAX_EPOCHS, RING, SEED, WEIGHTS
from voxmend.llm.quality import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_PERCENT
from voxmend.llm.urls import RULES

_WORD = r"[^\x20\x09-\x0D]+"


def quality() -> str:
    sizes = [3, *NGRAM_LIMITS]
    grams = ", ".join(
        f"CASE WHEN count(*) OVER a{n} = {n} THEN string_agg(word, ' ') OVER a{n} END AS g{n}" for n in sizes
    )
    windows = ", ".join(f"a{n} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in sizes)
    found = ", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1) AS f{n}" for n in sizes)
    inside = ", ".join(f"bool_or(f{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    sums = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n}), 0)::DOUBLE / greatest(sum(length(word)), 1) AS dup_{n}gram_share" for n in NGRAM_LIMITS)
    shares = ", ".join(f"coalesce(dup_{n}gram_share, 0) AS dup_{n}gram_share" for n in NGRAM_LIMITS)
    good = " AND ".join(f"dup_{n}gram_share <= {limit}" for n, limit in NGRAM_LIMITS.items())
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d), unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (SELECT doc_id, i, word, {grams} FROM w WINDOW {windows}),
f AS (SELECT doc_id, i, word, {found} FROM g),
c AS (SELECT doc_id, word, {inside} FROM f),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, k, ls[k] AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS u(k)),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l WHERE regexp_matches(line, '{_WORD}')),
x AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM r WHERE nth > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS dup_line_share, {shares}
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN x ON d.doc_id = x.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_share <= {LINE_LIMIT} AND {good} AS kept FROM b"""


def rules() -> str:
    def case(column: int) -> str:
        tried = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
        value = {0: lambda r: r[1] + r[2], 1: lambda r: r[0]}[column]
        return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in tried) + " END"

    def parts(url: str) -> str:
        upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return (
            rf"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{upper}', '{small}') AS host, coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, "
            rf"coalesce(regexp_extract({url}, '(?s)^[^?#]*(\?[^#]*)', 1), '') AS query"
        )

    href = r"""regexp_replace(regexp_replace(regexp_extract(canonical, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 0), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g')"""
    content = r"""regexp_extract(regexp_replace(regexp_replace(regexp_extract(refresh, '(?is)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 0), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g'), '(?is)url\s*=\s*["'']?([^"'']+)', 1)"""
    node = "CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END"
    return rf"""WITH RECURSIVE tags AS (SELECT url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS canonical,
  regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS refresh FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
said AS (SELECT url, trim(replace(unnest([{href}, {content}]), '&amp;', '&')) AS target FROM tags),
split AS (SELECT url, target, {parts('url')} FROM said),
links AS (SELECT url AS from_url, CASE WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || host || target WHEN contains(target, '://') THEN target END AS to_url FROM split),
ends AS (SELECT n, url, host, path, {node} AS node FROM (SELECT n, url, {parts('url')} FROM (SELECT row_number() OVER () AS n, unnest([from_url, to_url]) AS url FROM links WHERE to_url IS NOT NULL))),
edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ends a JOIN ends b ON a.n = b.n WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
votes AS (SELECT node, {case(1)} AS v FROM ends),
blocked AS (SELECT DISTINCT reach.a AS node FROM reach WHERE EXISTS (SELECT 1 FROM reach r JOIN votes ON votes.node = r.b WHERE r.a = reach.a AND v = 'block')
  AND NOT EXISTS (SELECT 1 FROM reach r JOIN votes ON votes.node = r.b WHERE r.a = reach.a AND v = 'allow')),
p AS (SELECT page_id, host, path, {node} AS node FROM (SELECT page_id, {parts('url')} FROM pages))
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN p.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


def mix() -> str:
    low, block = 1 << LOW_BITS, BLOCK_WORDS
    return rf"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
w AS (SELECT *, {list(WEIGHTS)}[(sid % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight, (source_size * {MAX_EPOCHS})::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS w_left
  FROM w WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_left <= rest * weight AS capped FROM v),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE (max(total) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target FROM c),
r AS (SELECT *, round(coalesce(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / nullif(sum(target) OVER (), 0), 0) * {RING})::BIGINT AS hi FROM t),
ring AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, CASE WHEN source_size > 0 THEN (source_size + {block - 1}) // {block} END AS blocks FROM r),
slots AS (SELECT ((i % {low}) * {GOLDEN} + (i // {low}) * {GOLDEN * low % RING}) % {RING} AS x FROM range((SELECT (coalesce(sum(source_size), 0)::BIGINT + {block - 1}) // {block} FROM s)) AS u(i)),
n AS (SELECT sid, least(count(*), any_value(blocks) * {MAX_EPOCHS}) AS n FROM slots JOIN ring ON lo <= x AND x < hi GROUP BY sid),
placed AS (SELECT d.doc_id, d.size, ring.source_size, ring.target, n.n, blocks, (sum(d.size) OVER (PARTITION BY ring.sid ORDER BY h, mark ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM sized d JOIN ring ON d.source IS NOT DISTINCT FROM ring.source LEFT JOIN n ON n.sid = ring.sid)
SELECT doc_id, size, source_size, target, coalesce((n // blocks) * size + greatest(0, least(start + size, (n % blocks) * {block}) - start), 0)::BIGINT AS taken FROM placed"""


SQL = {"op10_golden_mix": mix(), "op2_repetition_rules": quality(), "op9_redirect_rules": rules()}
