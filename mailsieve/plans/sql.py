"""The queries in DuckDB's SQL, written apart from the columns wherever the two languages allow it."""

from __future__ import annotations

from ..operators import disclaimer, html, preprocess, reply, score, signature
from ..sources.threads import HTML_SQL, THREADS_SQL

FACTORS = ("length", "noise", "quality", "readability", "completeness")

# The same in SQL. Its expressions are RE2's: white space and word characters are spelled out, and what would be a look-ahead is put back.
_S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_SET = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def _re2(pattern: str, flags: str) -> str:
    out = pattern.replace(r"[\d\s\-+()]", rf"[\d{_SET}\-+()]").replace(r"[^\w\s.,;:!?'\"-]", rf"[^\p{{L}}\p{{M}}\p{{N}}_{_SET}.,;:!?'\"-]")
    out = out.replace(r"\S", f"[^{_SET}]").replace(r"\Z", r"\z") if "[^" not in pattern else out.replace(r"\Z", r"\z")
    return f"(?{flags})" + out.replace("'", "''") if rf"{_SET}" in out and r"\s*" not in out and r"\s+" not in out else f"(?{flags})" + out.replace(r"\s*", f"{_S}*").replace(r"\s+", f"{_S}+").replace("'", "''")


def _sub(text: str, pattern: str, flags: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{_re2(pattern, flags)}', '{to}', 'g')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_S}+|{_S}+$', '', 'g')"


def _chain(text: str, patterns, flags: str = "is") -> str:
    for p in patterns:
        text = _sub(text, p.replace(r"(?=\n\n|\Z)", r"(\n\n|\z)"), flags, r"\1" if "(?=" in p else "")
    return text


def _plain(text: str) -> str:
    """ASCII stand-ins, so that word borders fall where they do in Unicode."""
    spaced = rf"regexp_replace({text}, '[\x{{85}}\p{{Z}}]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({spaced}, '[^\x{{00}}-\x{{7f}}\p{{L}}\p{{M}}\p{{N}}]', '#', 'g'), '[^\x{{00}}-\x{{7f}}]', 'x', 'g')"


def _counts(patterns) -> str:
    return ", ".join(f"len(regexp_extract_all({'p' if chr(92) + 'b' in p else 't'}, '{_re2(p, 'im')}'))" for p in patterns)


def _score_sql(key: str, source: str) -> str:
    n, q = len(score.NOISE), len(score.QUALITY)
    noise, quality = (" + ".join(f"least({c}[{i + 1}] * {each}::DOUBLE, {most}::DOUBLE)" for i in range(k)) for c, k, each, most in (("n", n, 0.05, 0.2), ("q", q, 0.03, 0.1)))
    return rf"""a AS (SELECT {key}, {_strip("coalesce(text, '')")} AS t FROM {source}), b AS (SELECT *, {_plain('t')} AS p, length(t) AS l FROM a),
c AS (SELECT *, [{_counts(score.NOISE)}] AS n, [{_counts(score.QUALITY)}] AS q FROM b),
d AS (SELECT *, CASE WHEN l < 10 THEN 0.1::DOUBLE WHEN l < 50 THEN 0.6::DOUBLE WHEN l < 200 THEN 0.9::DOUBLE WHEN l > 10000 THEN greatest(0.5::DOUBLE, 1.0::DOUBLE - (l - 10000) / 50000) ELSE 1.0::DOUBLE END AS f1,
  greatest(0::DOUBLE, 1::DOUBLE - (0::DOUBLE + {noise})) AS f2, least(1::DOUBLE, 0.5::DOUBLE + (0::DOUBLE + {quality})) AS f3,
  CASE WHEN len(regexp_extract_all(p, '[^a-zA-Z0-9_\s\x1c-\x1f.,;:!?''"-]')) / l > 0.1 THEN 0.6::DOUBLE WHEN len(list_filter(regexp_split_to_array(p, '[\s\x1c-\x1f]+'), lambda w: w <> '')) / l < 0.1 THEN 0.7::DOUBLE ELSE 1::DOUBLE END AS f4,
  CASE WHEN NOT regexp_matches(right(t, 50), '[.!?]') THEN 0.7::DOUBLE WHEN regexp_matches(left(t, 1), '[,.;:!?]') THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS f5 FROM c),
s AS (SELECT *, f1 * 0.2::DOUBLE + f2 * 0.3::DOUBLE + f3 * 0.2::DOUBLE + f4 * 0.15::DOUBLE + f5 * 0.15::DOUBLE AS total FROM d)"""


def _threads(select: str) -> str:
    return f"WITH threads AS ({THREADS_SQL}) {select}"


_TOTAL = "CASE WHEN t = '' THEN 0::DOUBLE ELSE round_even(greatest(0::DOUBLE, least(1::DOUBLE, total)), 3) END AS score, t <> '' AND total >= 0.85::DOUBLE AS is_reliable"


def _diagnostics(column: str, patterns) -> str:
    each = ", ".join("CASE WHEN {c}[{i}] > 0 THEN concat('{p}: ', {c}[{i}], ' matches') END".format(c=column, i=i + 1, p=p.replace("'", "''")) for i, p in enumerate(patterns))
    return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), '; ')"


def _attribution(text: str, patterns) -> str:
    return _chain(text, patterns)


def _squeeze(text: str) -> str:
    lines = rf"string_split(regexp_replace(replace({text}, chr(0), ''), '\r\n?', chr(10), 'g'), chr(10))"
    each = rf"""list_transform({lines}, lambda x: {_strip(f"regexp_replace(x, '{_S}+', ' ', 'g')")})"""
    return _strip(rf"regexp_replace(array_to_string({each}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _preprocessed(select: str, source: str = "threads", key: str = "conv_id", more: str = "") -> str:
    """Over p (conv_id, text, error): the threads, all of them plain, after preprocessing."""
    text = _strip(_chain(_squeeze(f"nfc_normalize({_chain('content', preprocess.ATTRIBUTIONS)})"), preprocess.DISCLAIMERS))
    found = f"SELECT {key}, text, CASE WHEN text = '' THEN '{preprocess.EMPTY}' END AS error FROM (SELECT {key}, {text} AS text FROM {source})"
    return f"WITH threads AS ({THREADS_SQL}), p AS MATERIALIZED ({found}){more} {select}"


#: One letter of a word, and a line end as str.splitlines() has it.
_W = r"[\p{L}\p{M}\p{N}_]"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_LF = "chr(10)"


def _visible(source: str, name: str, text: str) -> str:
    """Adds a column, the visible fragments of the text, by a fold over the lines, the last first; a header empties what was gathered below it."""
    line = f"""{{'t': x, 'h': (starts_with(x, 'On') AND ends_with(x, 'wrote:') AND length(x) > 7) OR regexp_matches(x, '^\\*?(From|Sent|To|Subject):\\*? .'), 'q': starts_with(x, '>'),
    'w': starts_with(x, 'On') AND ends_with(x, 'wrote:') AND length(x) > 7, 'b': NOT regexp_matches(x, '[^{_SET}]'), 'g': regexp_matches({_strip('x')}, '^(--|__|-{_W})|^Sent from my {_W}{_S}*{_W}{_S}*{_W}'), 'o': false, 'out': '', 'seen': false, 'e': false}}"""
    begin = "{'t': '', 'h': false, 'q': false, 'w': false, 'b': true, 'g': false, 'o': false, 'out': '', 'seen': false, 'e': false}"
    ended = "(s.o AND x.b AND s.g)"
    hidden = f"(NOT (s.seen AND NOT s.h) AND (s.q OR s.h OR {ended} OR s.b))"
    below = "CASE WHEN s.o AND s.h THEN '' ELSE s.out END"
    step = f"""CASE WHEN s.o AND NOT {ended} AND NOT x.e AND (s.h = x.h AND s.q = x.q OR s.q AND (x.w OR x.b))
      THEN {{'t': concat(x.t, {_LF}, s.t), 'h': s.h, 'q': s.q, 'w': false, 'b': s.b AND x.b, 'g': x.g, 'o': true, 'out': s.out, 'seen': s.seen, 'e': false}}
      ELSE {{'t': x.t, 'h': x.h, 'q': x.q, 'w': false, 'b': x.b, 'g': x.g, 'o': NOT x.e,
        'out': CASE WHEN NOT s.o OR {hidden} OR s.b THEN {below} WHEN ({below}) = '' THEN {_strip('s.t')} ELSE concat({_strip('s.t')}, {_LF}, {_LF}, {below}) END,
        'seen': CASE WHEN s.o THEN s.seen AND NOT s.h OR NOT {hidden} ELSE s.seen END, 'e': false}} END"""
    head = f"concat(left(b, 4), string_split(concat(substring(b, 5), 'wrote:'), 'wrote:')[1], 'wrote:')"
    ruled = f"flatten(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] <> '' AND i < len(l) AND regexp_matches(l[i + 1], '^ ?[_-]{{7}}') THEN [l[i], ''] ELSE [l[i]] END))"
    first = f"{_strip(f'string_split({_strip(text)}, {_LF})[1]')}"
    return f"""(SELECT * EXCLUDE (v), CASE WHEN v <> '' THEN v WHEN length({first}) <= 20 AND NOT contains({first}, 'On ') THEN {first} ELSE '' END AS {name} FROM (
  SELECT * EXCLUDE (l), list_reduce(list_append(list_transform(list_reverse({ruled}), lambda x: {line}), {begin.replace("'e': false", "'e': true")}), lambda s, x: {step}, {begin}).out AS v FROM (
  SELECT * EXCLUDE (u, b), string_split(CASE WHEN b <> '' THEN replace(u, {head}, replace({head}, {_LF}, '')) ELSE u END, {_LF}) AS l FROM (
  SELECT *, regexp_extract(regexp_extract(u, '(?s)^(.*)wrote:', 1), '(?s)^.*(On{_S}.+)$', 1) AS b FROM (SELECT *, replace({text}, concat(chr(13), {_LF}), {_LF}) AS u FROM {source})))))"""


def _block(source: str, text: str) -> str:
    """Adds body and found: the signature block at the end of the text."""
    phone = f"(?i)^(?:sent from my[{_SET},!\\p{{L}}\\p{{M}}\\p{{N}}_]*$|sent from Mailbox for iPhone|sent (?:[^{_SET}]* )?from my BlackBerry|Enviado desde mi (?:{_W}+ ){{0,2}}BlackBerry)"
    begins = f"(?i)^(?:{_S}*-+{_S}*[a-z .]*|thanks[{_SET},!]*|regards[{_SET},!]*|cheers[{_SET},!]*|best[ a-z]*[{_SET},!]*)$"
    kind = f"CASE WHEN length({_strip('r[i]')}) > {signature.LONGEST_LINE} THEN 'l' WHEN regexp_matches({_strip('r[i]')}, '^-+[^-]') THEN 'd' ELSE 'c' END"
    return f"""(SELECT * EXCLUDE (k, y, r, z, a, d, i), {_strip(f"CASE WHEN i IS NULL THEN y ELSE array_to_string(r[1 : i - 1], {_LF}) END")} AS body, k IS NOT NULL OR i IS NOT NULL AS found FROM (
  SELECT *, list_min(list_filter(z[len(z) + 1 - CASE WHEN a = 0 THEN CASE WHEN d = 1 THEN 1 ELSE 0 END WHEN d < 2 THEN a + d WHEN a = 1 THEN 1 ELSE a - 1 END :], lambda i: regexp_matches(r[i], '{begins}'))) AS i FROM (
  SELECT * EXCLUDE (m), length(regexp_extract(m, '^c*')) AS a, length(regexp_extract(regexp_replace(m, '^c*', ''), '^d*')) AS d FROM (
  SELECT *, reverse(array_to_string(list_transform(z, lambda i: {kind}), '')) AS m FROM (
  SELECT * EXCLUDE (f), CASE WHEN len(f) > 1 THEN f[greatest(2, len(f) - {signature.MOST_LINES - 1}) :] ELSE [] END AS z FROM (
  SELECT *, list_filter(range(1, len(r) + 1), lambda i: regexp_matches(r[i], '[^{_SET}]')) AS f FROM (
  SELECT *, regexp_split_to_array(y, '{_ENDS}') AS r FROM (
  SELECT * EXCLUDE (p), CASE WHEN k IS NULL THEN {_strip(text)} ELSE left({_strip(text)}, CASE WHEN k > 1 THEN length(array_to_string(p[1 : k - 1], {_LF})) + 1 ELSE 0 END) END AS y FROM (
  SELECT *, list_min(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '{phone}'))) AS k FROM (SELECT *, string_split({text}, {_LF}) AS p FROM {source}))))))))))"""


def _folded(text: str) -> str:
    """Without quoted lines and the blank lines right after them."""
    return f"""CASE WHEN contains({text}, '>') THEN list_reduce(list_transform(string_split({text}, chr(10)), lambda x: {{'q': false, 'n': 0, 't': x}}),
      lambda s, x: CASE WHEN regexp_matches(x.t, '^{_S}*>') OR s.q AND NOT regexp_matches(x.t, '[^{_SET}]') THEN {{'q': true, 'n': s.n, 't': s.t}} ELSE {{'q': false, 'n': s.n + 1, 't': CASE WHEN s.n = 0 THEN x.t ELSE concat(s.t, chr(10), x.t) END}} END,
      {{'q': false, 'n': 0, 't': ''}}).t ELSE {text} END"""


def _collapsed(text: str) -> str:
    return _sub(text, r"\n{3,}", "s", "\n\n")


def _cut_at_lines(source: str, name: str, text: str) -> str:
    return rf"""(SELECT * EXCLUDE (l, s, n), array_to_string(CASE WHEN n IS NULL THEN l ELSE l[1 : n - 1] END, chr(10)) AS {name} FROM (
  SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: s[i] IN ('--', '—', '__') OR regexp_matches(s[i], '(?i)^(Best|Regards|Cheers|Thanks|Thank you|Sincerely|Yours truly),?{_S}*$')
    AND i < len(l) AND s[i + 1] <> '' AND length(s[i + 1]) < 60 AND NOT regexp_matches(s[i + 1], '^[a-z]'))), list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{_DEVICE}')))) AS n
  FROM (SELECT *, list_transform(l, lambda x: {_strip('x')}) AS s FROM (SELECT *, string_split({text}, chr(10)) AS l FROM {source}))))"""


def _cut_at_pattern(text: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches({text}, '{p}') THEN regexp_replace(regexp_replace({text}, '{p}(?s:.*)', ''), '{_S}+\z', '')" for p in (_re2(x, "im") for x in signature.PATTERNS)) + f" ELSE {text} END"


def _without_device_lines(text: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, '{_DEVICE}')), chr(10))"


def _by_position(source: str, name: str, text: str) -> str:
    separators = " ".join(f"WHEN regexp_matches(right(b, 100), '{s}') THEN concat(left(b, greatest(length(b) - 100, 0)), regexp_replace(right(b, 100), '(?s){s}.*', ''))" for s in disclaimer.SEPARATORS)
    return rf"""(SELECT * EXCLUDE (b), CASE WHEN b IS NULL THEN {text} ELSE {_strip(f"CASE {separators} ELSE b END")} END AS {name}
  FROM (SELECT *, CASE WHEN regexp_matches({text}, '{_HEADER}') THEN regexp_replace({text}, '{_HEADER}(?s:.*)', '') END AS b FROM {source}))"""


def _cleaned(source: str) -> str:
    """CTEs up to cleaned (column t: the text, then t1, t2, t3 after each step, m1, m2, m3 whether it counts as modified) over a source with a text column."""
    steps = [
        ("c0", f"SELECT *, coalesce(text, '') AS t FROM {source}"),
        ("c1", f"SELECT *, {_strip(_collapsed(_chain(_folded('v0'), reply.PATTERNS)))} AS t1 FROM {_visible('c0', 'v0', 't')}"),
        ("c2", f"SELECT * FROM {_block('c1', 't1')}"),
        ("c3", f"SELECT *, {_strip(_without_device_lines('p1'))} AS p2 FROM (SELECT *, {_cut_at_pattern('p0')} AS p1 FROM {_cut_at_lines('c2', 'p0', 't1')})"),
        ("c4", f"SELECT *, CASE WHEN found THEN body ELSE {_strip(_collapsed('p2'))} END AS t2, found OR length(p2) < length(t1) AS m2 FROM c3"),
        ("c5", f"SELECT *, {_strip(_collapsed(_chain('t2', disclaimer.PHRASES)))} AS q FROM c4"),
        ("cleaned", f"SELECT *, t1 <> t AS m1, length(t3) < length(t2) AS m3 FROM {_by_position('c5', 't3', 'q')}"),
    ]
    return ", ".join(f"{name} AS MATERIALIZED ({select})" for name, select in steps)


_DEVICE = _re2(signature.DEVICE.replace(r"\A", "^"), "i").replace(r"\w", r"[\p{L}\p{M}\p{N}_]")
_HEADER = _re2(disclaimer.HEADER, "i")
SQL = {
    "score_factors": f"WITH {_score_sql('doc_id', 'documents')} SELECT doc_id, " + ", ".join(f"CASE WHEN t <> '' THEN round_even(f{i + 1}, 3) END AS {f}_score" for i, f in enumerate(FACTORS)) + " FROM s",
    "score_total": f"WITH {_score_sql('doc_id', 'documents')}, r AS (SELECT doc_id, {_TOTAL} FROM s) SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'High' WHEN score >= 0.6::DOUBLE THEN 'Medium' ELSE 'Low' END AS band FROM r",
    "score_threads": f"WITH threads AS (SELECT conv_id, content AS text FROM ({THREADS_SQL})), {_score_sql('conv_id', 'threads')} SELECT conv_id, {_TOTAL} FROM s",
    "noise_diagnostics": f"WITH threads AS (SELECT conv_id, content AS text FROM ({THREADS_SQL})), {_score_sql('conv_id', 'threads')} SELECT conv_id, {_diagnostics('n', score.NOISE)} AS noise, {_diagnostics('q', score.QUALITY)} AS quality FROM s",
    "sniff_html": f"SELECT page_id, coalesce(regexp_matches(html, '{_re2(html.SNIFF, 'i').replace(chr(92) + 's', _S)}'), false) AS is_html FROM pages",
    "html_native_text": rf"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace({"".join("regexp_replace(" for _ in html.REMOVED)}h{"".join(f", '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')" for t in html.REMOVED)}, '(?is)<hr\b[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS n FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(n, lambda x: {_strip('x')}), lambda x: x <> ''), ' ') AS text FROM c""",
    "normalize_text": f"SELECT doc_id, {_squeeze('nfc_normalize(text)')} AS text FROM documents",
    "empty_gate": f"SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^{_SET}]') THEN '{preprocess.EMPTY}' END AS error FROM documents",
    "preprocess_threads": _preprocessed("SELECT conv_id, text, error FROM p"),
    "mime_body": _threads("SELECT conv_id, content AS text, CAST(NULL AS VARCHAR) AS html FROM threads"),
    "extract_llm": _preprocessed(f"""SELECT conv_id, error IS NULL AS success, CASE WHEN error IS NULL THEN 'llm' ELSE '' END AS flow_used, 'LLM Agent' AS flow_label,
  least(1::DOUBLE, length(m) / 1000::DOUBLE) AS confidence, m AS latest_message, error FROM (SELECT *, {_strip("string_split(text, chr(10) || chr(10))[1]")} AS m FROM p)"""),
    "agent_event_rows": _preprocessed(f"""SELECT conv_id, CAST(i AS INTEGER) AS seq, CASE WHEN error IS NOT NULL THEN 'error' WHEN i BETWEEN 1 AND n THEN 'token' WHEN i = n + 6 THEN 'done' WHEN i IN (0, n + 2, n + 4) THEN 'start' ELSE 'agent_done' END AS type,
  CASE WHEN error IS NOT NULL OR i BETWEEN 1 AND n OR i = n + 6 THEN NULL WHEN i IN (0, n + 1) THEN 'extraction' WHEN i IN (n + 2, n + 3) THEN 'cleanup' ELSE 'confidence' END AS agent,
  CASE WHEN i BETWEEN 1 AND n THEN concat(w[i], ' ') END AS text, error AS message, CASE WHEN error IS NULL AND i = n + 6 THEN array_to_string(w, ' ') END AS latest_message,
  CASE WHEN error IS NULL AND i = n + 6 THEN least(1::DOUBLE, length(array_to_string(w, ' ')) / 1000::DOUBLE) END AS confidence
FROM (SELECT *, len(w) AS n, unnest(range(0, CASE WHEN error IS NULL THEN len(w) + 7 ELSE 1 END)) AS i
  FROM (SELECT *, list_filter(regexp_split_to_array(string_split(text, chr(10) || chr(10))[1], '{_S}+'), lambda x: x <> '') AS w FROM p))"""),
    "preview": _threads("SELECT conv_id, replace(left(content, 120), chr(10), ' ') AS content_preview FROM threads"),
    "history_topk": "SELECT event_id AS id, replace(left(coalesce(props, ''), 120), chr(10), ' ') AS content_preview FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "sse_events": """SELECT event_id, concat('data: {"type":"token"', CASE WHEN event_type IS NULL THEN '' ELSE concat(',"text":"', event_type, '"') END, '}', chr(10), chr(10)) AS line FROM events""",
    "azure_urls": "SELECT page_id, CASE WHEN suffix(u, '.com/') THEN concat(u, 'openai/v1/') ELSE u END AS url FROM (SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/') AS u FROM pages)",
    "strip_attribution": _threads(f"SELECT conv_id, {_chain('content', preprocess.ATTRIBUTIONS)} AS text FROM threads"),
    "preprocess_disclaimers": _threads(f"SELECT conv_id, {_strip(_chain('content', preprocess.DISCLAIMERS))} AS text FROM threads"),
    "provider_list": """SELECT name, name IN ('anthropic', 'gemini') AS available, name IN ('anthropic', 'gemini') AS configured, name = 'anthropic' AS is_default, count(conv_id) AS turns
FROM (VALUES ('openai'), ('azure_openai'), ('anthropic'), ('gemini')) AS p(name)
LEFT JOIN (SELECT conv_id, CASE (conv_id + turn) % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'azure_openai' WHEN 2 THEN 'azure_openai' WHEN 3 THEN 'anthropic' WHEN 4 THEN 'gemini' END AS name FROM conversations) USING (name) GROUP BY name""",
    "agent_confidence": """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN CAST(concat('0.', n) AS DOUBLE) WHEN 2 THEN round(CAST(concat('0.', n) AS DOUBLE), 3) WHEN 4 THEN 0.5::DOUBLE ELSE round(CASE WHEN n > 1 THEN least(1::DOUBLE, n / 100) ELSE n END, 3) END AS confidence
FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)""",
    "agent_messages": f"SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN t WHEN turn % 4 = 2 THEN {_strip('t')} ELSE {_strip("concat('{\"other\": 1} ', t)")} END AS message FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)",
    "agent_validation": """SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN n <= 100 ELSE n > 100 END AS is_valid, CASE WHEN turn % 3 = 0 THEN concat(t, '|b') ELSE 'Could not parse structured validation' END AS issues,
  CASE WHEN turn % 3 = 0 THEN left(t, 20) ELSE '' END AS suggested_fix FROM (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations)""",
    "agent_traces": _preprocessed(f"""SELECT conv_id, iterations, CAST(i AS INTEGER) AS seq, agent, agent <> 'validation' OR n <= 120 AS success, CASE WHEN agent IN ('extraction', 'cleanup') THEN left(m, 200) END AS output_preview,
  CASE WHEN agent = 'validation' THEN n <= 120 END AS is_valid, CASE WHEN agent = 'validation' THEN CASE WHEN n <= 120 THEN '' ELSE 'long' END END AS issues, CASE WHEN agent = 'validation' THEN CASE WHEN n <= 120 THEN '' ELSE 'shorten it' END END AS suggested_fix,
  CASE WHEN agent = 'confidence' THEN least(1::DOUBLE, n / 1000::DOUBLE) END AS confidence
FROM (SELECT *, CASE WHEN i = 0 THEN 'extraction' WHEN i = 2 * iterations + 1 THEN 'confidence' WHEN i % 2 = 1 THEN 'cleanup' ELSE 'validation' END AS agent
  FROM (SELECT *, unnest(range(0, 2 * iterations + 2)) AS i FROM (SELECT *, length(m) AS n, CAST(CASE WHEN length(m) <= 120 THEN 1 ELSE 2 END AS INTEGER) AS iterations FROM (SELECT *, {_strip("string_split(text, chr(10) || chr(10))[1]")} AS m FROM p WHERE error IS NULL))))"""),
    "extract_event_errors": _threads(f"SELECT conv_id, CAST(0 AS INTEGER) AS seq, 'error' AS type, CASE WHEN regexp_matches(content, '[^{_SET}]') THEN 'no provider' ELSE '{preprocess.EMPTY}' END AS message FROM threads"),
    "sig_lines": _threads(f"SELECT conv_id, text FROM {_cut_at_lines('threads', 'text', 'content')}"),
    "reply_headers": _threads(f"SELECT conv_id, {_strip(_collapsed(_chain('content', reply.PATTERNS)))} AS text FROM threads"),
    "blockquote_fold": _threads(f"SELECT conv_id, {_folded('content')} AS text FROM threads"),
    "device_lines": _threads(f"SELECT conv_id, {_without_device_lines('content')} AS text FROM threads"),
    "disclaimer_phrases": _threads(f"SELECT conv_id, {_strip(_collapsed(_chain('content', disclaimer.PHRASES)))} AS text FROM threads"),
    "disclaimer_position": _threads(f"SELECT conv_id, text FROM {_by_position('threads', 'text', 'content')}"),
    "sig_patterns": _threads(f"SELECT conv_id, {_cut_at_pattern('content')} AS text FROM threads"),
    "visible_fragments": _threads(f"SELECT conv_id, text FROM {_visible('threads', 'text', 'content')}"),
    "signature_block": _threads(f"SELECT conv_id, body, found FROM {_block('threads', 'content')}"),
}
# The same, but the tree knows all named references: the pages hold these two besides the basic five.
_MORE = SQL["html_native_text"].replace("replace(x, '&lt;', '<')", "replace(replace(replace(x, '&lt;', '<'), '&copy;', '©'), '&middot;', '·')")
SQL["html_tree_plain"] = f"SELECT page_id, text, CAST(NULL AS VARCHAR) AS error FROM ({_MORE})"


def _answered(select: str, source: str = "threads", key: str = "conv_id") -> str:
    """Over r: rows after preprocessing, cleaning and scoring, texts t3, with score and is_reliable."""
    scored = _score_sql(key, f"(SELECT {key}, t3 AS text FROM cleaned)")
    return _preprocessed(select, source, key, f", {_cleaned('p')}, {scored}, r AS (SELECT c.*, u.score, u.is_reliable FROM cleaned c JOIN (SELECT {key}, {_TOTAL} FROM s) u USING ({key}))")


def _response(flow: str, label: str, key: str = "conv_id") -> str:
    named = f", CASE WHEN error IS NULL THEN {label} ELSE 'LLM Agent' END AS flow_label" if label else ""
    return f"""SELECT {key}, error IS NULL AS success, CASE WHEN error IS NULL THEN {flow} ELSE '' END AS flow_used{named}, CASE WHEN error IS NULL THEN score ELSE 0::DOUBLE END AS confidence,
  CASE WHEN error IS NULL THEN t3 ELSE '' END AS latest_message, error FROM r"""


_AUTO = "CASE WHEN is_reliable THEN 'non_llm (auto mode)' ELSE 'non_llm (auto mode, llm failed)' END"
SQL["extract_non_llm"] = _answered(_response("'non_llm'", "'Deterministic'"))
SQL["extract_auto_no_provider"] = _answered(_response(_AUTO, "'Deterministic'"))
SQL["extract_documents"] = _answered(_response("'non_llm'", "", "doc_id"), "(SELECT doc_id, coalesce(text, '') AS content FROM documents)", "doc_id")
SQL["event_rows"] = _answered("""SELECT conv_id, CAST(i AS INTEGER) AS seq, CASE WHEN error IS NOT NULL THEN 'error' WHEN i = 0 THEN 'start' WHEN i = 1 THEN 'token' ELSE 'done' END AS type, CASE WHEN error IS NULL AND i = 0 THEN 'non_llm' END AS agent,
  CASE WHEN error IS NULL AND i = 1 THEN t3 END AS text, error AS message, CASE WHEN error IS NULL AND i = 2 THEN t3 END AS latest_message, CASE WHEN error IS NULL AND i = 2 THEN score END AS confidence
FROM (SELECT *, unnest(range(0, CASE WHEN error IS NULL THEN 3 ELSE 1 END)) AS i FROM r)""")
SQL["pipeline_metadata"] = f"""WITH threads AS (SELECT conv_id, content AS text FROM ({THREADS_SQL})), {_cleaned("threads")}, {_score_sql("conv_id", "(SELECT conv_id, t3 AS text FROM cleaned)")}
SELECT conv_id, t3 AS text, array_to_string(list_filter([CASE WHEN m1 THEN 'reply_removal' END, CASE WHEN m2 THEN 'signature_removal' END, CASE WHEN m3 THEN 'disclaimer_removal' END, 'confidence_scoring'], lambda x: x IS NOT NULL), ',') AS steps,
  CAST(length(c.t) AS INTEGER) AS original_length, CAST(length(t1) AS INTEGER) AS after_reply_removal_length, CAST(length(t2) AS INTEGER) AS after_signature_removal_length, CAST(length(t3) AS INTEGER) AS after_disclaimer_removal_length,
  CASE WHEN length(c.t) > 0 THEN round_even((length(c.t) - length(t3)) / length(c.t)::DOUBLE, 3) ELSE 0::DOUBLE END AS reduction_ratio, score, is_reliable
FROM cleaned c JOIN (SELECT conv_id, {_TOTAL} FROM s) u USING (conv_id)"""
SQL["mime_bytes"] = _threads(r"SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN regexp_replace(content, '[^\x00-\x{ff}]', '?', 'g') ELSE content END AS text, CAST(NULL AS VARCHAR) AS html, CAST(NULL AS VARCHAR) AS error FROM threads")
# Tags are numbered and nested by a running depth. Between a quoted tag and its end a sum over marks is above 0; what no tag outside parts is one text.
SQL["html_quotes"] = rf"""WITH h AS ({HTML_SQL}),
t AS (SELECT conv_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS x FROM h)),
k AS (SELECT *, CASE WHEN starts_with(x, '</') THEN -1 WHEN regexp_matches(x, '^<[a-z]') AND NOT starts_with(x, '<hr') THEN 1 ELSE 0 END AS step,
  regexp_matches(x, '(?i)^<[a-z]+[^>]* class="[^"]*(reply|forward|quote|original)') OR regexp_matches(x, '^<[a-z]+[^>]* class="([^"]* )?gmail_(attr|extra)[ "]') AS quoted FROM t),
d AS (SELECT *, sum(step) OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM k),
q AS (SELECT d.conv_id, d.i AS a, min(e.i) AS b FROM d JOIN d e ON e.conv_id = d.conv_id AND e.i > d.i AND e.step = -1 AND e.depth = d.depth - 1 WHERE d.quoted GROUP BY d.conv_id, d.i),
m AS (SELECT conv_id, a AS i, 1 AS mark FROM q UNION ALL SELECT conv_id, b + 1, -1 FROM q),
s AS (SELECT d.*, coalesce(sum(m.mark), 0) AS mark FROM d LEFT JOIN m ON m.conv_id = d.conv_id AND m.i = d.i GROUP BY ALL),
o AS (SELECT *, sum(mark) OVER (PARTITION BY conv_id ORDER BY i) AS inside FROM s),
n AS (SELECT *, sum(CASE WHEN step <> 0 AND inside = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS node FROM o),
g AS (SELECT conv_id, node, string_agg(x, '' ORDER BY i) AS x FROM n WHERE inside = 0 AND NOT starts_with(x, '<') GROUP BY conv_id, node),
c AS (SELECT conv_id, node, {_strip("replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS x FROM g)
SELECT conv_id, coalesce(text, '') AS text, CAST(NULL AS VARCHAR) AS error FROM h LEFT JOIN (SELECT conv_id, string_agg(x, ' ' ORDER BY node) AS text FROM c WHERE x <> '' GROUP BY conv_id) USING (conv_id)"""
