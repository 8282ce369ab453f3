"""DuckDB text of the queries, over the same tables."""

from __future__ import annotations

from voxmend.functions import prompts as P


#: The letters beyond ASCII that the tables have, and as many punctuation marks, of which a normal form has none.
LETTERS, MARKS = "éèêíóñçüäößÉÈÊÍÓÑÇÜÄÖ", "!\"#%&()*,-./:;?@[]_{}"


#: A pronunciation table: letter to syllable.
SYLLABLES = {"a": "e", "é": "e", "è": "e", "ê": "e", "í": "i", "ó": "o", "x": "e"}


def sounded(text: str) -> str:
    """A normal form with its letters' syllables, of one letter each, in their place."""
    return f"translate({text}, '{''.join(SYLLABLES)}', '{''.join(SYLLABLES.values())}')"


def ascii(text: str) -> str:
    """A normal form letter by letter in ASCII, if it has no other letters than these."""
    return f"translate({text}, '{LETTERS}', '{MARKS}')"


def lev(a: str, b: str) -> str:
    """Edit distance of normal forms in code points. DuckDB's own counts bytes, so it is taken of ASCII stand-ins; where a text
    has other letters, by rows of the table as lists."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[-1] + 1, prev[j] + (CASE WHEN ch = substr({b}, j, 1) THEN 0 ELSE 1 END))), [prev[1] + 1])"
    slow = f"list_reduce(string_split({a}, ''), lambda prev, ch: {row}, range(0, length({b}) + 1))[-1]"
    plain = f"strlen({ascii(a)}) = length({a}) AND strlen({ascii(b)}) = length({b})"
    return f"(CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) WHEN {plain} THEN levenshtein({ascii(a)}, {ascii(b)}) ELSE {slow} END)"


def rate(d: str, r: str, p: str) -> str:
    return f"(CASE WHEN length({r}) = 0 THEN (CASE WHEN length({p}) = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE ELSE {d}::DOUBLE / length({r}) END)"


NORM = r"regexp_replace(text, '[\p{P}\s]+', '', 'g')"
SENTENCE = r"regexp_replace(parts[k], '[\p{P}\s]+', '', 'g')"
EV = rf"""
pieces AS (SELECT doc_id, lang, source, string_split_regex(coalesce(text, ''), '[.!?\n]+') AS parts FROM documents),
r AS (SELECT coalesce(doc_id::VARCHAR, '') || '-' || (k - 1) AS id, lang, source, {SENTENCE} AS reference, coalesce(doc_id, 0) + k - 1 AS t, (2 + (coalesce(doc_id, 0) + k - 1) % 7) AS p FROM pieces, unnest(range(1, len(parts) + 1)) AS u(k)),
v AS (SELECT *, substr(reference, 1, p - 1) || 'x' || substr(reference, p + 1) AS sb, substr(reference, 1, p - 1) || substr(reference, p + 1) AS dl,
  substr(reference, 1, p) || 'e' || substr(reference, p + 1) AS ins, reverse(reference) AS rv FROM r),
w AS (SELECT *, list_filter(CASE t % 6 WHEN 0 THEN [reference, sb, dl] WHEN 1 THEN [sb, reference, reference, dl] WHEN 2 THEN [dl, sb, ins, reference]
  WHEN 3 THEN [ins, dl, dl] WHEN 4 THEN [rv, reference, reference] ELSE ['', '  ', sb, reference] END, lambda h: trim(h) <> '') AS nbest FROM v),
ev AS MATERIALIZED (SELECT id, t AS turn, lang, source, reference, nbest, coalesce(nbest[1], '') AS top1 FROM w)"""


def minimal(a: str, b: str, source: str) -> str:
    """CTEs m1 to m: rows of source with f and t, the minimal edit from a to b (null: none)."""
    return f"""
m1 AS (SELECT *, length({a}) AS la, length({b}) AS lb, least(length({a}), length({b})) AS lm, {ascii(a)} AS aa, {ascii(b)} AS bb FROM {source}),
m2 AS (SELECT *, coalesce(list_min(list_filter(range(1, lm + 1), lambda i: substr(aa, i, 1) <> substr(bb, i, 1))) - 1, lm) AS px,
  coalesce(list_min(list_filter(range(1, lm + 1), lambda i: substr(aa, la - i + 1, 1) <> substr(bb, lb - i + 1, 1))) - 1, lm) AS sx0 FROM m1),
m3 AS (SELECT *, least(sx0, lm - px) AS sx FROM m2),
m4 AS (SELECT *, (la - sx = px) AS bare FROM m3),
m5 AS (SELECT *, CASE WHEN bare AND px > 0 THEN px - 1 ELSE px END AS lf, CASE WHEN bare AND px = 0 THEN 1 ELSE 0 END AS more FROM m4),
m6 AS (SELECT *, substr({a}, lf + 1, la - sx + more - lf) AS f0, substr({b}, lf + 1, lb - sx + more - lf) AS t0 FROM m5),
m AS (SELECT * EXCLUDE (la, lb, lm, aa, bb, px, sx0, sx, bare, lf, more, f0, t0), CASE WHEN {a} <> {b} AND f0 <> '' THEN f0 END AS f, CASE WHEN {a} <> {b} AND f0 <> '' THEN t0 END AS t FROM m6)"""


HYPS = f"""
hyp AS (SELECT id, reference, top1, nbest, i, CASE WHEN len(nbest) = 0 THEN top1 ELSE nbest[i] END AS h FROM ev, unnest(range(1, greatest(len(nbest), 1) + 1)) AS u(i)),
rated AS (SELECT *, {lev("h", "reference")} AS d FROM hyp),
best AS (SELECT id, any_value(reference) AS reference, any_value(top1) AS top1, min(d) AS distance, arg_min(i, d * 100 + i) - 1 AS idx, arg_min(h, d * 100 + i) AS text FROM rated GROUP BY id)"""
RULE = f"""
tries AS (SELECT ev.*, i, nbest[i] AS h FROM ev, unnest(range(2, len(nbest) + 1)) AS u(i)),
fits AS (SELECT id, min(i) AS i FROM tries WHERE top1 <> '' AND h <> '' AND len(list_filter(nbest, lambda x: x = h)) >= 2 AND {lev("top1", "h")} = 1 GROUP BY id),
chosen AS (SELECT ev.*, coalesce(nbest[fits.i], top1) AS candidate FROM ev LEFT JOIN fits USING (id)), {minimal("top1", "candidate", "chosen")},
ruled AS (SELECT *, CASE WHEN f IS NULL THEN top1 ELSE substr(top1, 1, strpos(top1, f) - 1) || t || substr(top1, strpos(top1, f) + length(f)) END AS prediction FROM m)"""
EDITS = f"""
{minimal("top1", "reference", "ev")},
given AS (SELECT *, substr(top1, 1, 3) AS a, substr(top1, 4, 2) AS b, substr(top1, 6, 3) AS c FROM m),
two AS (SELECT id, turn, reference, nbest, top1,
  CASE turn % 5 WHEN 0 THEN (CASE WHEN f IS NULL THEN [] ELSE [{{'f': f, 't': t}}] END) WHEN 1 THEN [{{'f': a, 't': 'zqj'}}] WHEN 2 THEN [{{'f': a, 't': b}}, {{'f': '¤¤', 't': a}}]
  WHEN 3 THEN [{{'f': b, 't': ''}}, {{'f': c, 't': ''}}] ELSE [{{'f': a, 't': a}}, {{'f': '', 't': b}}] END AS e FROM given),
each AS (SELECT id, nbest, top1, i, e[i].f AS f, e[i].t AS t FROM two, unnest(range(1, len(e) + 1)) AS u(i)),
early AS (SELECT *, CASE WHEN f = '' THEN 'empty_span' WHEN f = t THEN 'identity_edit:' || f
  WHEN len(list_filter(list_concat([top1], nbest), lambda s: contains(s, f))) = 0 THEN 'from_not_supported:' || f END AS r1 FROM each),
late AS (SELECT *, sum(CASE WHEN r1 IS NULL THEN greatest(length(f), length(t)) ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS changed FROM early),
said AS (SELECT id, i, coalesce(r1, CASE WHEN changed > 12 THEN 'too_many_changed_chars'
  WHEN t <> '' AND len(list_filter(list_concat([top1], nbest), lambda s: s <> '' AND contains(s, t))) = 0 THEN 'to_not_supported:' || t END) AS reason FROM late),
against AS (SELECT id, list(reason ORDER BY i) FILTER (reason IS NOT NULL) AS listed, string_agg(reason, '|' ORDER BY i) FILTER (reason IS NOT NULL) AS reasons FROM said GROUP BY id),
checked AS (SELECT two.*, coalesce(against.reasons, '') AS reasons, listed, e[1].f AS f1, e[1].t AS t1, e[2].f AS f2, e[2].t AS t2 FROM two LEFT JOIN against USING (id)),
step1 AS (SELECT *, CASE WHEN f1 IS NULL THEN NULL WHEN f1 = '' THEN 'empty_from' WHEN strpos(top1, f1) = 0 THEN 'missing_from:' || f1 END AS j1 FROM checked),
step2 AS (SELECT *, CASE WHEN f1 IS NULL OR j1 IS NOT NULL THEN top1 ELSE substr(top1, 1, strpos(top1, f1) - 1) || t1 || substr(top1, strpos(top1, f1) + length(f1)) END AS x1 FROM step1),
step3 AS (SELECT *, CASE WHEN f2 IS NULL THEN NULL WHEN f2 = '' THEN 'empty_from' WHEN strpos(x1, f2) = 0 THEN 'missing_from:' || f2 END AS j2 FROM step2),
applied AS (SELECT *, CASE WHEN f2 IS NULL OR j2 IS NOT NULL THEN x1 ELSE substr(x1, 1, strpos(x1, f2) - 1) || t2 || substr(x1, strpos(x1, f2) + length(f2)) END AS x2,
  concat_ws('|', j1, j2) AS rejected, (CASE WHEN f1 IS NOT NULL AND j1 IS NULL THEN 1 ELSE 0 END + CASE WHEN f2 IS NOT NULL AND j2 IS NULL THEN 1 ELSE 0 END) AS n FROM step3),
safe AS (SELECT *, reasons = '' AND rejected = '' AS ok, CASE WHEN reasons <> '' THEN reasons ELSE rejected END AS why, CASE WHEN reasons <> '' THEN listed ELSE list_filter([j1, j2], lambda x: x IS NOT NULL) END AS whys FROM applied),
fixed AS (SELECT *, CASE WHEN ok THEN x2 ELSE top1 END AS prediction FROM safe),
analyzed AS (SELECT id, whys, reference, {lev("prediction", "reference")} AS pd, {lev("top1", "reference")} AS bd, ok FROM fixed),
status AS (SELECT *, pd - bd AS delta, CASE WHEN pd < bd THEN 'improved' WHEN pd > bd THEN 'worsened' ELSE 'unchanged' END AS status FROM analyzed)"""
SHOWN = "CASE WHEN f IS NULL THEN '' ELSE f || '>' || t || ':{reason}' END"
NUMBERED = "list_transform(nbest, lambda h, i: i::VARCHAR || '. ' || h)"
PINYIN = "list_transform(nbest, lambda h: array_to_string(string_split(h, ''), ' '))"
BLOCK = f"""array_to_string(list_concat(CASE WHEN trim(top1) <> '' THEN ['ASR: ' || top1] ELSE [] END,
  CASE WHEN len(nbest) > 0 THEN list_concat(['N-best:'], {NUMBERED}) ELSE [] END,
  CASE WHEN len(nbest) > 0 THEN list_concat(['Pinyin:'], list_transform({PINYIN}, lambda h, i: i::VARCHAR || '. ' || h)) ELSE [] END), chr(10))"""
OUTPUT = """'{"edits":[' || CASE WHEN f IS NULL THEN '' ELSE '{"from":"' || f || '","to":"' || t || '","reason":"middle_span_replace"}' END || ']}'"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GOLD = minimal("top1", "reference", "ev")
EVALUATE = f"""SELECT {{by}}count(*) AS samples, sum(n)::BIGINT AS reference_chars, sum(pd)::BIGINT AS edits, sum(bd)::BIGINT AS baseline_edits,
  count(*) FILTER (pd < bd) AS improved_samples, count(*) FILTER (pd > bd) AS worsened_samples, count(*) FILTER (pd = bd) AS unchanged_samples,
  round(sum(pd)::DOUBLE / sum(n), 9) AS cer, round(sum(bd)::DOUBLE / sum(n), 9) AS baseline_cer
FROM (SELECT source, length(reference) AS n, {lev("prediction", "reference")} AS pd, {lev("top1", "reference")} AS bd FROM ruled WHERE reference <> '') {{group}}"""
LADDER = f"CASE WHEN reference = '' OR top1 = '' THEN 'empty_text' WHEN {rate(lev('top1', 'reference'), 'reference', 'top1')} > 0.8 THEN 'baseline_cer_too_high' WHEN f IS NOT NULL AND greatest(length(f), length(t)) > 24 THEN 'too_many_changed_chars' ELSE 'kept' END"
STRICT = f"""CASE WHEN reference = '' OR top1 = '' THEN 'empty_text' WHEN {rate(lev('top1', 'reference'), 'reference', 'top1')} > 0.8 THEN 'baseline_cer_too_high' WHEN f IS NULL THEN 'empty_edits'
  WHEN greatest(length(f), length(t)) > 2 THEN 'too_many_changed_chars' WHEN t <> '' AND len(list_filter(nbest, lambda s: contains(s, t))) = 0 THEN 'verifier:to_not_supported:' || t ELSE 'kept' END"""
RATED = f"rated_rows AS (SELECT *, {rate('d', 'reference', 'top1')} AS x FROM (SELECT *, {lev('top1', 'reference')} AS d FROM m))"


def rank_at(p: float) -> str:
    return f"(SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM rated_rows) WHERE k = round_even((n - 1) * {p}, 0)::BIGINT + 1)"


SOUND_RULE = f"""
tries AS (SELECT ev.*, i, nbest[i] AS h FROM ev, unnest(range(2, len(nbest) + 1)) AS u(i)),
rated AS (SELECT *, {lev(sounded("top1"), sounded("h"))} AS units, {lev("top1", "h")} AS chars FROM tries WHERE top1 <> '' AND h <> ''),
fits AS (SELECT id, arg_min(i, chars * 100 + i) AS i FROM rated WHERE units = 0 AND chars BETWEEN 1 AND 2 GROUP BY id)"""
ASKED = f"trim({quoted(P.INSTRUCTION)} || chr(10) || chr(10) || {BLOCK}, chr(10) || ' ')"
TURNS = "(SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS ms FROM conversations GROUP BY conv_id)"
REPLY = """'{"from":"' || a || '","to":"' || b || '","reason":"r"}'"""

SQL: dict[str, str] = {
    "normalize_text": rf"SELECT doc_id, {NORM} AS norm FROM documents",
    "edit_distance_pairs": f"WITH {EV}, {HYPS} SELECT id, i - 1 AS idx, d AS distance FROM rated WHERE len(nbest) > 0",
    "cer_per_record": f"WITH {EV} SELECT id, d AS distance, length(reference) AS reference_chars, round({rate('d', 'reference', 'top1')}, 9) AS cer FROM (SELECT *, {lev('top1', 'reference')} AS d FROM ev)",
    "corpus_cer": f"WITH {EV}, {RULE} " + EVALUATE.replace("{by}", "").replace("{group}", ""),
    "corpus_cer_by_source": f"WITH {EV}, {RULE} " + EVALUATE.replace("{by}", "source, ").replace("{group}", "GROUP BY source"),
    "oracle_nbest": f"WITH {EV}, {HYPS} SELECT id, text, idx, distance FROM best",
    "oracle_topk": f"WITH {EV}, {HYPS} SELECT id, arg_min(h, d * 100 + i) AS text, arg_min(i, d * 100 + i) - 1 AS idx, min(d) AS distance FROM rated WHERE i <= 2 GROUP BY id",
    "baseline_predictions": f"WITH {EV}, {HYPS} SELECT id, top1, text AS best, idx FROM best",
    "baseline_report": f"""WITH {EV}, {HYPS}, b AS (SELECT *, {lev('top1', 'reference')} AS bd FROM best WHERE reference <> '')
SELECT count(*) AS samples, sum(length(reference))::BIGINT AS reference_chars, 0::BIGINT AS oracle_top_k, sum(bd)::BIGINT AS top1_edits, round(sum(bd)::DOUBLE / sum(length(reference)), 9) AS top1_cer,
  sum(distance)::BIGINT AS oracle_edits, round(sum(distance)::DOUBLE / sum(length(reference)), 9) AS oracle_cer, count(*) FILTER (distance = 0) AS oracle_exact_samples,
  round(count(*) FILTER (distance = 0)::DOUBLE / count(*), 9) AS oracle_exact_rate, count(*) FILTER (text <> top1) AS oracle_changed_samples FROM b""",
    "oracle_index_counts": f"WITH {EV}, {HYPS} SELECT idx AS oracle_index, count(*) AS samples FROM best WHERE reference <> '' GROUP BY idx",
    "candidate_support": f"WITH {EV}, {HYPS} SELECT id, i - 1 AS idx, CASE WHEN h = '' THEN 0 ELSE len(list_filter(nbest, lambda x: x = h)) END AS support FROM hyp WHERE len(nbest) > 0",
    "rule_candidate": f"WITH {EV}, {RULE} SELECT id, candidate FROM chosen",
    "rule_edits": f"WITH {EV}, {RULE} SELECT id, {SHOWN.format(reason='rule_nbest_same_pinyin')} AS edits FROM ruled",
    "rule_corrected": f"WITH {EV}, {RULE} SELECT id, true AS accepted, prediction, '' AS reasons FROM ruled",
    "minimal_edit": f"WITH {EV}, {GOLD} SELECT id, {SHOWN.format(reason='middle_span_replace')} AS edits FROM m",
    "validate_edits": f"WITH {EV}, {EDITS} SELECT id, reasons = '' AS ok, reasons FROM checked",
    "apply_edits": f"WITH {EV}, {EDITS} SELECT id, x2 AS text, n::BIGINT AS applied, rejected FROM applied",
    "safe_apply": f"WITH {EV}, {EDITS} SELECT id, ok AS accepted, prediction, why AS reasons, CASE WHEN ok THEN len(e) ELSE 0 END::BIGINT AS applied FROM fixed",
    "sft_records": f"""WITH {EV}, {GOLD} SELECT id, source, lang AS split, {quoted(P.TASK)} AS task, {quoted(P.INSTRUCTION)} AS instruction, top1 AS asr_top1, array_to_string(nbest, '|') AS nbest,
  array_to_string({PINYIN}, '|') AS pinyin, {SHOWN.format(reason='middle_span_replace')} AS edits, reference FROM m""",
    "filter_reasons": f"WITH {EV}, {GOLD} SELECT {LADDER} AS filter_reason, count(*) AS records FROM m GROUP BY 1",
    "filter_strict": f"WITH {EV}, {GOLD} SELECT id, {STRICT} AS filter_reason FROM m",
    "filter_kept": f"WITH {EV}, {GOLD} SELECT id, reference FROM m WHERE {LADDER} = 'kept'",
    "split_field": "SELECT CASE WHEN coalesce(lang, '') = '' THEN 'unknown' ELSE lang END AS split, count(*) AS records FROM documents GROUP BY 1",
    "split_hash": """SELECT doc_id, CASE WHEN k <= floor(n * 0.9) THEN 'train' WHEN k <= floor(n * 0.9) + floor(n * 0.05) THEN 'dev' ELSE 'test' END AS bucket
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('23:' || doc_id), doc_id) AS k, count(*) OVER ()::DOUBLE AS n FROM documents)""",
    "first_n": "SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100",
    "dataset_stats": f"""WITH {EV}, {GOLD}, {RATED} SELECT count(*) AS samples, count(*) FILTER (f IS NULL) AS empty_edits, round(count(*) FILTER (f IS NULL)::DOUBLE / count(*), 9) AS empty_edit_rate,
  round(avg(len(nbest)), 9) AS avg_nbest_size, round(avg(length(reference)), 9) AS avg_reference_chars, round(avg(length(top1)), 9) AS avg_asr_chars, round(avg(x), 9) AS avg_baseline_cer,
  round(avg(CASE WHEN f IS NULL THEN 0 ELSE 1 END), 9) AS avg_edit_count, round(avg(CASE WHEN f IS NULL THEN 0 ELSE greatest(length(f), length(t)) END), 9) AS avg_changed_chars,
  round(any_value({rank_at(0.5)}), 9) AS p50_baseline_cer, round(any_value({rank_at(0.9)}), 9) AS p90_baseline_cer FROM rated_rows""",
    "cer_percentiles": f"WITH {EV}, {GOLD}, {RATED} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round({rank_at(p)}, 9) AS value" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)),
    "analysis_status": f"WITH {EV}, {EDITS} SELECT status, count(*) AS samples FROM status GROUP BY status",
    "analysis_topk": f"""WITH {EV}, {EDITS} SELECT status, rank, id, delta AS delta_edits FROM
(SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'worsened' THEN -delta ELSE delta END, id) AS rank FROM status) WHERE rank <= 20""",
    "reason_counts": f"WITH {EV}, {EDITS} SELECT reason, count(*) AS n FROM (SELECT unnest(whys) AS reason FROM status) GROUP BY reason",
    "correction_rates": f"""WITH {EV}, {EDITS} SELECT count(*) AS samples, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS fallbacks, count(*) FILTER (bd = 0 AND delta > 0) AS overcorrected,
  round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS acceptance_rate, round(count(*) FILTER (NOT ok)::DOUBLE / count(*), 9) AS fallback_rate FROM status""",
    "input_block": f"WITH {EV} SELECT id, {BLOCK} AS block FROM ev",
    "chat_export": f"""WITH {EV}, {GOLD} SELECT id, {quoted(P.CHAT_SYSTEM)} AS told, trim({quoted(P.INSTRUCTION)} || chr(10) || chr(10) || {BLOCK}, chr(10) || ' ') AS asked, {OUTPUT} AS answered FROM m""",
    "prompt_export": f"""WITH {EV}, {GOLD} SELECT trim({quoted(P.INSTRUCTION)} || chr(10) || chr(10) || {BLOCK}, chr(10) || ' ') AS prompt, {OUTPUT} AS completion FROM m""",
    "query_response_export": f"""WITH {EV}, {GOLD} SELECT trim({quoted(P.QUERY_HEADER)} || chr(10) || array_to_string({NUMBERED}, chr(10)), chr(10) || ' ') AS query, {OUTPUT} AS response FROM m""",
    "chat_template": f"SELECT conv_id, array_to_string(list_concat(list_transform(ms, lambda x: '<' || x.role || '>' || chr(10) || x.text), ['<assistant>' || chr(10)]), chr(10)) AS text FROM {TURNS}",
    "infer_messages": f"""SELECT conv_id, n::BIGINT AS n, CASE WHEN n > 0 THEN ms[n].role ELSE '' END AS last_role, array_to_string(list_concat(list_transform(ms[1:n], lambda x: '<' || x.role || '>' || chr(10) || x.text), ['<assistant>' || chr(10)]), chr(10)) AS prompt
FROM (SELECT *, CASE WHEN ms[-1].role = 'assistant' THEN len(ms) - 1 ELSE len(ms) END AS n FROM {TURNS})""",
    "infer_prompts": f"""WITH {EV} SELECT id, '<system>' || chr(10) || {quoted(P.CHAT_SYSTEM)} || chr(10) || '<user>' || chr(10) || {ASKED} || chr(10) || '<assistant>' || chr(10) AS prompt FROM ev""",
    "teacher_prompts": f"""WITH {EV} SELECT id, {quoted(P.TEACHER_SYSTEM)} AS told, {quoted(P.TEACHER_HEADER)} || chr(10) || chr(10) || {BLOCK} || chr(10) || chr(10) || {quoted(P.TEACHER_FOOTER)} AS asked FROM ev""",
    "sound_units": f"""WITH {EV} SELECT id, array_to_string(CASE WHEN top1 = '' THEN [] ELSE string_split({sounded("top1")}, '') END, ' ') AS sounds FROM ev""",
    "sound_rule_candidate": f"WITH {EV}, {SOUND_RULE} SELECT ev.id, coalesce(nbest[fits.i], top1) AS candidate FROM ev LEFT JOIN fits ON ev.id = fits.id",
    "sound_checks": f"""WITH {EV}, e AS (SELECT *, substr(top1, 1, 3) AS f, CASE WHEN turn % 4 = 0 THEN 'qzq' ELSE translate(substr(top1, 1, 3), 'aeiouéèê', 'éaèuiexe') END AS t FROM ev)
SELECT id, CASE WHEN f = '' THEN 'empty_span' WHEN f = t THEN 'identity_edit:' || f WHEN len(list_filter(list_concat([top1], nbest), lambda s: contains(s, t))) = 0 AND {sounded("f")} <> {sounded("t")} THEN 'to_not_supported:' || t ELSE '' END AS reasons FROM e""",
    "training_texts": f"SELECT substr(array_to_string(list_transform(ms, lambda x: '<' || x.role || '>' || chr(10) || x.text), chr(10)), 1, 16384) AS text FROM {TURNS}",
    "teacher_dry_run": f"""WITH {EV} SELECT id, 'dry' AS teacher_model, '{{"edits": []}}' AS model_output, 0::BIGINT AS edits, 0::BIGINT AS warnings FROM ev""",
    "parse_model_output": f"""WITH n AS (SELECT doc_id, substr(norm, 1, length(norm) // 2) AS a, substr(norm, length(norm) // 2 + 1) AS b FROM (SELECT doc_id, {NORM} AS norm FROM documents)), s AS (SELECT doc_id, a || '>' || b || ':r' AS one FROM n)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN one WHEN 1 THEN one WHEN 2 THEN one || '|' || one WHEN 3 THEN one || '|' || one ELSE '' END AS edits,
  CASE doc_id % 6 WHEN 4 THEN 'edits must be a list or an object with an edits list|no_valid_json_edits' WHEN 5 THEN 'no_valid_json_edits' ELSE '' END AS warnings FROM s""",
    "manifest_join": "SELECT d.doc_id::VARCHAR AS id, coalesce('/audio/q' || l.quality || '.wav', '/data/' || d.doc_id || '.wav') AS audio, d.source AS reference FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
}
SQL["baseline_report_exact"] = SQL["baseline_report"]
SQL["prepared_split"] = f"WITH {EV} SELECT id, reference, top1 AS asr_top1 FROM ev WHERE lang = 'fr' ORDER BY id LIMIT 50"
SQL["manifest_existing"] = f"SELECT id, audio = '/audio/q1.wav' AS there FROM ({SQL['manifest_join']})"
