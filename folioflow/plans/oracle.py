"""DuckDB SQL that gives the same rows as the registered queries, from the same tables.

Each text is written from the rules, not from the Spark plans: the chunker here is a plain
fold, blocks are groups of spans, and quotas are window functions.
"""

from __future__ import annotations

from html.entities import html5

from folioflow.config import NOT_HTTPS_MESSAGE, REFUSED_MESSAGES
from folioflow.functions import html
from folioflow.functions.chat import instruction
from folioflow.operators.reports import KEPT_KINDS
from folioflow.plans.inputs import CONFIG, DEFAULTS, JOB_RULES, LANGUAGE_CODES
from folioflow.sources.readers import HTML_LOOSE

# Same characters as the strip helper, spelled for DuckDB.
_SPACES = "||".join(
    f"chr({c})"
    for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
_SPACE_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


SPANS = """
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents),
sp AS (
  SELECT doc_id, line_idx, doc_id + line_idx // 4 AS b, unnest(string_split(line, ', ')) AS span,
         generate_subscripts(string_split(line, ', '), 1) - 1 AS span_no FROM l),
spans AS (
  SELECT doc_id,
    CAST(line_idx // 20 AS INT) AS page_num,
    CAST((line_idx % 20) // 4 AS INT) AS block_no,
    CAST(line_idx % 4 AS INT) AS line_no,
    CAST(span_no AS INT) AS span_no,
    CAST(CASE WHEN b % 11 = 0 THEN 1 ELSE 0 END AS INT) AS block_type,
    CASE WHEN b % 13 = 0 THEN left(span, 2) WHEN b % 17 = 0 THEN ' ' ELSE span END AS text,
    CAST(72 + 40 * span_no AS DOUBLE) AS x0,
    CAST(72 + h * (line_idx % 20) AS DOUBLE) AS y0,
    CAST(72 + 40 * span_no + 5 * length(span) AS DOUBLE) AS x1,
    CAST(72 + h * (line_idx % 20) + 10 + doc_id % 3 AS DOUBLE) AS y1,
    CASE (doc_id + line_idx + span_no) % 7
      WHEN 0 THEN 'Times-Bold' WHEN 1 THEN 'ABCDEF+Custom' ELSE 'helvetica' END AS font,
    CAST(10 + (doc_id + span_no) % 3 AS DOUBLE) AS size
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 18 END AS h FROM sp) s
  WHERE NOT (b % 13 = 0 AND (line_idx % 4 > 0 OR span_no > 0))),
page_list AS (
  SELECT doc_id, CAST(line_idx // 20 AS INT) AS page_num FROM l GROUP BY ALL),
page_total AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n_pages FROM page_list)
"""

BLOCKS = f"""{SPANS},
folded AS (
  SELECT doc_id, page_num, block_no,
    {_strip("string_agg(text, ' ' ORDER BY line_no, span_no)")} AS text,
    string_agg(concat_ws(',', x0::INT, y0::INT, x1::INT, y1::INT), ';' ORDER BY line_no, span_no) AS bboxes,
    min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(size) AS size
  FROM spans WHERE block_type = 0 GROUP BY ALL),
font_counts AS (
  SELECT doc_id, page_num, block_no, font,
    row_number() OVER (PARTITION BY doc_id, page_num, block_no ORDER BY count(*) DESC, font) AS place
  FROM spans WHERE block_type = 0 GROUP BY doc_id, page_num, block_no, font),
blocks AS (
  SELECT f.*, c.font FROM folded f JOIN font_counts c USING (doc_id, page_num, block_no)
  WHERE c.place = 1 AND f.text <> ''),
routed AS (
  SELECT *, CASE WHEN page_num IN (1) THEN 'skipped_page' WHEN length({_strip('text')}) < 3 THEN 'short'
                 ELSE 'translate' END AS route FROM blocks)
"""


def _chunked(source: str, keys: str, out: str = "chunks", size: int = 1000) -> str:
    """CTEs that cut ``source(keys…, text)`` into ``out(keys…, chunk_no, text)``."""
    words = f"string_split_regex({_strip('p')}, '{_SPACE_RUN}')"
    strip_cur = _strip("a.cur")
    blank = "[]::STRUCT(t VARCHAR, f BOOLEAN, cur VARCHAR, o VARCHAR[])[]"
    return f"""
{out}_parts AS (
  SELECT {keys}, text,
    CASE WHEN length(text) <= {size} THEN [] ELSE
    string_split(replace(replace(replace(text, '. ', '.|'), '! ', '!|'), '? ', '?|'), '|') END AS parts
  FROM {source}),
{out}_tokens AS (
  SELECT {keys}, text, coalesce(flatten(list_transform(parts, lambda p:
    CASE WHEN length(p) <= {size} THEN [{{'t': p, 'f': false, 'cur': '', 'o': []::VARCHAR[]}}]
         WHEN {_strip('p')} = '' THEN [{{'t': NULL, 'f': true, 'cur': '', 'o': []::VARCHAR[]}}]
         ELSE list_transform({words}, lambda w, i: {{'t': w, 'f': i = 1, 'cur': '', 'o': []::VARCHAR[]}}) END)), {blank}) AS toks
  FROM {out}_parts),
{out}_folded AS (
  SELECT {keys}, text, list_reduce(toks, lambda a, x:
    CASE WHEN NOT x.f AND length(a.cur) + length(x.t) <= {size}
      THEN {{'t': NULL, 'f': false, 'cur': a.cur || x.t || ' ', 'o': a.o}}
      ELSE {{'t': NULL, 'f': false, 'cur': coalesce(x.t || ' ', ''),
            'o': CASE WHEN a.cur <> '' THEN list_append(a.o, {strip_cur}) ELSE a.o END}} END,
    {{'t': NULL, 'f': false, 'cur': '', 'o': []::VARCHAR[]}}) AS a
  FROM {out}_tokens),
{out}_lists AS (
  SELECT {keys}, CASE WHEN length(text) <= {size} THEN [text]
    WHEN a.cur <> '' THEN list_append(a.o, {strip_cur}) ELSE a.o END AS pieces
  FROM {out}_folded),
{out} AS (
  SELECT {keys}, CAST(generate_subscripts(pieces, 1) - 1 AS INT) AS chunk_no, unnest(pieces) AS text
  FROM {out}_lists)
"""


_ANSWER = "CASE WHEN length(text) % 17 = 1 THEN ' ' WHEN length(text) % 17 <> 0 THEN '[es] ' || translate(text, 'aeiou0', 'eioua1') END"


def _translated(source: str = "chunks", out: str = "done") -> str:
    """CTE with ``translated`` and ``status`` for every chunk of ``source``."""
    return f"""
{out} AS (
  SELECT *,
    CASE WHEN {_strip('text')} = '' OR {_strip('answer')} = '' OR answer IS NULL THEN text ELSE {_strip('answer')} END AS translated,
    CASE WHEN {_strip('text')} = '' THEN 'blank' WHEN answer IS NULL THEN 'failed'
         WHEN {_strip('answer')} = '' THEN 'empty' ELSE 'translated' END AS status
  FROM (SELECT *, {_ANSWER} AS answer FROM {source}) q)
"""


_KEY = f"sha256('{CONFIG.source_lang}' || chr(31) || '{CONFIG.target_lang}' || chr(31) || '{CONFIG.model}' || chr(31) || text)"
_BK = "doc_id, page_num, block_no"

_WORK = f"""
work AS (SELECT {_BK}, text FROM routed WHERE route = 'translate'),
{_chunked('work', _BK)}, {_translated()},
rejoined AS (
  SELECT {_BK}, string_agg(translated, ' ' ORDER BY chunk_no) AS translated,
    CAST(count(*) AS INT) AS n_chunks, CAST(count(*) FILTER (status IN ('failed', 'empty')) AS INT) AS n_failed
  FROM done GROUP BY ALL)
"""

_PARTS = f"""
parts AS (
  SELECT doc_id, page_num, block_no, coalesce(j.translated, r.text) AS t, coalesce(n_chunks, 0) AS c, coalesce(n_failed, 0) AS f
  FROM routed r LEFT JOIN rejoined j USING ({_BK})),
page_text AS (
  SELECT doc_id, page_num, coalesce(string_agg(t, chr(10) ORDER BY block_no), '') AS t, count(block_no) AS b,
    coalesce(sum(c), 0) AS c, coalesce(sum(f), 0) AS f
  FROM page_total LEFT JOIN parts USING (doc_id, page_num) GROUP BY doc_id, page_num),
docs AS (
  SELECT doc_id, string_agg(t, chr(10) ORDER BY page_num) AS translated, CAST(count(*) AS INT) AS n_pages,
    CAST(sum(b) AS INT) AS n_blocks, CAST(sum(c) AS INT) AS n_chunks, CAST(sum(f) AS INT) AS n_failed
  FROM page_text GROUP BY doc_id)
"""

_BLOCK_WORK = f"{BLOCKS}, {_WORK}"
_DOCS = f"{_BLOCK_WORK}, {_PARTS}"

_FONT = "CASE WHEN font IN ('helvetica', 'Times-Bold') THEN font ELSE 'helvetica' END"

_REPLACED = f"{_BLOCK_WORK}, replaced AS (SELECT b.*, j.translated FROM blocks b JOIN rejoined j USING ({_BK}))"


def _edit(op: str, no: str, box: str = "x0, y0, x1, y1", text: str = "translated") -> str:
    filled = text != "NULL"
    return (
        f"SELECT {_BK}, CAST({no} AS INT) AS edit_no, '{op}' AS op, {box}, CAST({text} AS VARCHAR) AS text, "
        f"{_FONT if filled else 'CAST(NULL AS VARCHAR)'} AS font, "
        f"{'round(size, 6)' if filled else 'CAST(NULL AS DOUBLE)'} AS size, "
        f"CAST({'0' if filled else 'NULL'} AS VARCHAR) AS align"
    )


_PROGRESS = f"""{SPANS},
progress AS (
  SELECT doc_id, page_num + 1 AS page, n_pages AS total,
    CAST(least(round_even((page_num + 1)::DOUBLE / n_pages * 100, 0), 100) AS INT) AS percent
  FROM page_total)
"""

_JOBS = """
jobs AS (
  SELECT page_id AS job_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS source_lang, 'es' AS target_lang,
    CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 7 = 0 THEN 'x' || html ELSE html END AS content,
    CASE WHEN page_id % 10 = 0 THEN 'x' WHEN page_id % 11 = 0 THEN '200000' ELSE strlen(html)::VARCHAR END AS declared,
    CASE WHEN page_id % 19 <> 0 THEN 1 + page_id % 5 END AS n_pages,
    page_id % 12 <> 5 AS has_key,
    CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN ' ' ELSE 'https://llm.example.com/v1' END AS base_url
  FROM pages)
"""

_LANGS = ", ".join(f"'{c}'" for c in JOB_RULES.languages)

# Hosts among the job endpoints are plain names, so scheme and local names decide.
_ADMIT = f"""{_JOBS},
judged AS (
  SELECT job_id, CASE
    WHEN source_lang NOT IN ({_LANGS}) OR target_lang NOT IN ({_LANGS}) THEN 'language'
    WHEN NOT has_key THEN 'credentials'
    WHEN has_key AND trim(base_url) <> '' AND NOT starts_with(lower(base_url), 'https://') THEN 'url'
    WHEN regexp_full_match(declared, '[0-9]+') AND declared::HUGEINT > {JOB_RULES.max_declared} THEN 'declared_length'
    WHEN strlen(content) = 0 THEN 'empty'
    WHEN NOT starts_with(content, '<!DOCTYPE') THEN 'magic'
    WHEN strlen(content) > {JOB_RULES.max_bytes} THEN 'size'
    WHEN n_pages IS NULL THEN 'unreadable'
    WHEN n_pages > {JOB_RULES.max_pages} THEN 'pages'
    ELSE 'admitted' END AS verdict
  FROM jobs)
"""

_ENDPOINTS = """
e AS (
  SELECT page_id, url, page_id % 256 AS n, (page_id * 16777259) % 4294967296 AS v FROM pages),
endpoints AS (
  SELECT page_id, n, v, page_id % 15 AS form, CASE page_id % 15
    WHEN 0 THEN url WHEN 1 THEN url
    WHEN 2 THEN 'https://10.' || n || '.0.1/v1'
    WHEN 3 THEN 'https://user:pw@' || n || '.20.30.40:8443/'
    WHEN 4 THEN 'https://' || v || '/'
    WHEN 5 THEN 'https://0x' || lower(format('{:x}', v)) || '/'
    WHEN 6 THEN 'https://' || n || '.258/'
    WHEN 7 THEN 'https://0' || format('{:o}', n) || '.0.0.1/'
    WHEN 8 THEN 'https://[::ffff:' || n || '.1.1.1]/'
    WHEN 9 THEN 'https://[2001:4860:4860::' || lower(format('{:x}', n)) || ']/'
    WHEN 10 THEN 'https://[fe80::' || lower(format('{:x}', n)) || ']:443/'
    WHEN 11 THEN 'https%3A%2F%2FHost' || n || '.internal%2Fv1'
    WHEN 12 THEN 'https://LOCALHOST:' || n || '/'
    WHEN 13 THEN 'https://' || n || '.1.1.999/'
    ELSE 'ftp://a' || n || '.example.com/' END AS endpoint
  FROM e),
addressed AS (
  SELECT *, CASE form
    WHEN 3 THEN n * 16777216 + 20 * 65536 + 30 * 256 + 40
    WHEN 4 THEN v WHEN 5 THEN v
    WHEN 6 THEN n * 16777216 + 258
    WHEN 7 THEN n * 16777216 + 1
    WHEN 8 THEN n * 16777216 + 65793 END AS ip
  FROM endpoints),
screened AS (
  SELECT page_id, endpoint, CASE
    WHEN form < 2 THEN CASE WHEN starts_with(endpoint, 'https://') THEN 'allowed' ELSE 'not_https' END
    WHEN form = 14 THEN 'not_https'
    WHEN form IN (2, 10, 11, 12) THEN 'not_allowed'
    WHEN form IN (9, 13) THEN 'allowed'
    WHEN ip // 16777216 IN (0, 10, 127) OR ip // 16777216 >= 224
      OR ip // 4194304 = 401 OR ip // 65536 IN (43518, 49320) OR ip // 1048576 = 2753
      OR (ip // 256 IN (12582912, 12582914, 12989284, 13303668) AND ip NOT IN (3221225481, 3221225482))
      OR ip // 131072 = 25353
      THEN 'not_allowed'
    ELSE 'allowed' END AS verdict
  FROM addressed)
"""


def _quota_ranks() -> str:
    return """
ranked AS (
  SELECT event_id, event_type AS client, ts,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS in_hour,
    row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS in_day
  FROM events)
"""


_VERDICTS = f"""WITH {_quota_ranks()}
SELECT event_id, client, in_hour <= 5 AS within_hour, in_day <= 20 AS within_day, in_hour <= 5 AND in_day <= 20 AS allowed
FROM ranked"""

_DOC_TEXT = "doc_text AS (SELECT doc_id, text FROM documents)"
_DOC_CHUNKS = f"{_DOC_TEXT}, {_chunked('doc_text', 'doc_id')}"
_LANG_CHUNKS = f"lang_text AS (SELECT doc_id, lang, source, text FROM documents), {_chunked('lang_text', 'doc_id, lang, source')}"

_NAME = "regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1)"


def _events(limit: int) -> str:
    """CTE and query of all events of ``docs`` and ``page_total``."""
    return f"""{_PROGRESS.replace(SPANS + ',', '')}
        SELECT doc_id, page AS seq, '{{"type":"progress","page":' || page || ',"total":' || total || ',"percent":' || percent || '}}' AS event FROM progress
        UNION ALL SELECT doc_id, n_pages + 1, CASE WHEN strlen(translated) > {limit}
          THEN '{{"type":"error","message":"Translated PDF is too large to return."}}'
          ELSE '{{"type":"done","filename":"doc' || doc_id || '_translated.pdf","pdf_b64":"' || base64(encode(translated)) || '"}}' END
        FROM docs"""


# Uploads of the service: pages of 20 lines, a block per line, every seventh length is not readable.
_SERVICE = f"""{_ADMIT.replace("WHEN n_pages IS NULL THEN 'unreadable'", "WHEN strlen(content) % 7 = 0 THEN 'unreadable'")
    .replace(f"WHEN n_pages > {JOB_RULES.max_pages}", f"WHEN (len(string_split(content, chr(10))) + 19) // 20 > {JOB_RULES.max_pages}")},
l AS (
  SELECT job_id AS doc_id, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_idx FROM jobs JOIN judged USING (job_id) WHERE verdict = 'admitted'),
page_list AS (SELECT doc_id, CAST(line_idx // 20 AS INT) AS page_num FROM l GROUP BY ALL),
page_total AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n_pages FROM page_list),
routed AS (
  SELECT doc_id, CAST(line_idx // 20 AS INT) AS page_num, CAST(line_idx % 20 AS INT) AS block_no, {_strip('line')} AS text,
    CASE WHEN line_idx // 20 = 1 THEN 'skipped_page' WHEN length({_strip('line')}) < 3 THEN 'short' ELSE 'translate' END AS route
  FROM l WHERE {_strip('line')} <> ''),
{_WORK}, {_PARTS}"""


def _json_text(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _html_blocks() -> str:
    """Pages cut at every edge of a block element: edges become marks, the text between two marks is a block."""
    rest = r"""(\s([^>"'']|"[^"]*"|''[^'']*'')*|/)?>"""
    marked = f"regexp_replace(h, '(?i)<(/?)({html.BLOCKS}){rest}', chr(1) || '\\1\\2' || chr(2), 'g')"
    silent = "(?is)<script\\b.*?(</script\\s*>|\\z)|<style\\b.*?(</style\\s*>|\\z)|<!--.*?(-->|\\z)|<[!?][^>]*(>|\\z)"
    names = "MAP {" + ", ".join(f"'{n}': '{t.replace(chr(39), chr(39) * 2)}'" for n, t in html5.items() if n.endswith(";")) + "}"
    inline = f"regexp_replace(regexp_replace(t, '(?i)</?br{rest}', ' ', 'g'), '(?i)</?[a-z][a-z0-9:-]*{rest}', '', 'g')"
    # a text is cut at "&": what begins a piece, up to ";", is looked up or taken as a number
    meant = """CASE WHEN i = 1 THEN p
      WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INT)) || substr(p, strpos(p, ';') + 1)
      WHEN names[substr(p, 1, strpos(p, ';'))] IS NOT NULL THEN names[substr(p, 1, strpos(p, ';'))] || substr(p, strpos(p, ';') + 1)
      ELSE '&' || p END"""
    return f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '{silent}', ' ', 'g'), '</?[A-Za-z][^>]*\\z', ' ') AS h FROM pages),
        m AS (SELECT page_id, unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) - 1 AS n FROM c),
        b AS (SELECT page_id, n, CASE WHEN n = 0 OR starts_with(piece, '/') OR starts_with(lower(piece), 'hr' || chr(2)) THEN '{HTML_LOOSE}'
            ELSE lower(split_part(piece, chr(2), 1)) END AS tag, CASE WHEN n = 0 THEN piece ELSE substr(piece, strpos(piece, chr(2)) + 1) END AS t FROM m),
        e AS (SELECT {names} AS names),
        x AS (SELECT page_id, CAST(n AS INT) AS block_no, tag, {_strip(f"regexp_replace(array_to_string(list_transform(string_split({inline}, '&'), lambda p, i: {meant}), ''), '{_SPACE_RUN}', ' ', 'g')")} AS text
          FROM b, e)
        SELECT * FROM x WHERE text <> ''"""


ORACLE = {
    "scan_documents": "SELECT doc_id, lang, source, text FROM documents",
    "spans_flatten": f"WITH {SPANS} SELECT * FROM spans",
    "decode_spans": f"""WITH {SPANS} SELECT doc_id, CAST(line_idx // 20 AS INT) AS page_num,
        CAST(line_idx % 20 AS INT) AS block_no, CAST(0 AS INT) AS line_no, line AS text FROM l""",
    "write_translated": f"""WITH {_DOCS} SELECT doc_id, translated,
        CASE WHEN doc_id % 2 = 0 THEN 'Spanish' ELSE 'French' END AS target_lang FROM docs""",
    "progress_ndjson": f"""WITH {_PROGRESS} SELECT doc_id, page,
        '{{"type":"progress","page":' || page || ',"total":' || total || ',"percent":' || percent || '}}' AS event FROM progress""",
    "payload_b64": """SELECT page_id, '{"type":"done","filename":"page.' || page_id || '_translated.pdf","pdf_b64":"'
        || base64(encode(html)) || '"}' AS event, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages""",
    "compacted_rows": "SELECT * FROM documents",
    "admit": f"WITH {_ADMIT} SELECT job_id, verdict FROM judged",
    "admit_report": f"WITH {_ADMIT} SELECT verdict, count(*) AS n FROM judged GROUP BY verdict",
    "upload_precheck": f"""SELECT page_id AS job_id, 'upload' || page_id || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.html' END AS name,
        CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 0 THEN 'type' WHEN strlen(html) > {JOB_RULES.max_bytes} THEN 'size'
          WHEN page_id % 19 = 0 THEN 'unreadable' WHEN 1 + page_id % 5 > {JOB_RULES.max_pages} THEN 'pages' ELSE 'admitted' END AS verdict
        FROM pages""",
    "lang_allowed": f"""SELECT doc_id, lang, CASE lang {' '.join(f"WHEN '{c}' THEN '{n}'" for c, n in LANGUAGE_CODES.items())} END AS language
        FROM documents WHERE lang IN ({_LANGS})""",
    "lang_rejected": f"SELECT doc_id, lang FROM documents WHERE lang NOT IN ({_LANGS})",
    "url_screen": f"WITH {_ENDPOINTS} SELECT page_id, endpoint, verdict FROM screened",
    "url_screen_report": f"WITH {_ENDPOINTS} SELECT verdict, count(*) AS n FROM screened GROUP BY verdict",
    "output_cap": """SELECT page_id, CAST(strlen(html) AS BIGINT) AS out_bytes,
        CASE WHEN strlen(html) > 4000 THEN 'too_large' ELSE 'done' END AS status FROM pages""",
    "job_routing": f"""WITH j AS (
        SELECT page_id AS job_id, page_id % 3 = 0 AS has_key,
          CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS base_url,
          CASE WHEN page_id % 5 = 0 THEN 'own' ELSE '' END AS model FROM pages)
        SELECT job_id, CASE WHEN has_key THEN 'caller' ELSE 'server' END AS route,
          CASE WHEN has_key THEN coalesce(nullif(base_url, ''), '{DEFAULTS.caller.base_url}') ELSE '{DEFAULTS.server.base_url}' END AS eff_base_url,
          CASE WHEN has_key THEN coalesce(nullif(model, ''), '{DEFAULTS.caller.model}') ELSE '{DEFAULTS.server.model}' END AS eff_model
        FROM j""",
    "output_names": f"""WITH n AS (
        SELECT page_id, {_NAME} AS name, len(string_split({_NAME}, '.')) > 1 AS dotted FROM pages),
        s AS (SELECT *, CASE WHEN dotted THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem,
          CASE WHEN dotted THEN regexp_extract(name, '\\.[^.]*$') ELSE '' END AS suffix FROM n)
        SELECT page_id, stem || '_translated' || suffix AS translated_name, stem || '_compressed' || suffix AS compressed_name,
          CASE WHEN name = '' THEN 'document' ELSE stem END || '_translated.pdf' AS download_name FROM s""",
    "doc_pages": f"WITH {SPANS} SELECT doc_id, page_num, n_pages FROM page_total",
    "page_counts": f"WITH {SPANS} SELECT doc_id, CAST(count(*) AS INT) AS n_pages FROM page_list GROUP BY doc_id",
    "blocks": f"WITH {BLOCKS} SELECT {_BK}, text, bboxes, font, round(size, 6) AS size FROM blocks",
    "blocks_from_spans": f"WITH {BLOCKS} SELECT {_BK}, text, bboxes, font, round(size, 6) AS size FROM blocks",
    "block_bbox": f"WITH {BLOCKS} SELECT {_BK}, x0, y0, x1, y1 FROM blocks",
    "block_font": f"WITH {BLOCKS} SELECT {_BK}, font FROM blocks",
    "resolve_fonts": f"WITH {SPANS} SELECT {_BK}, line_no, span_no, font, {_FONT} AS resolved FROM spans",
    "skip_pages": f"WITH {SPANS} SELECT doc_id, page_num, page_num IN (1) AS skipped FROM page_list",
    "blank_pages": f"""WITH {BLOCKS} SELECT doc_id, page_num FROM page_list p
        WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_num = p.page_num)""",
    "route_blocks": f"WITH {BLOCKS} SELECT {_BK}, route FROM routed",
    "block_batches": f"""WITH {BLOCKS} SELECT {_BK},
        CAST((row_number() OVER (PARTITION BY doc_id, page_num ORDER BY block_no) - 1) // 2 AS INT) AS batch_no FROM blocks""",
    "chunks": f"WITH {_DOC_CHUNKS} SELECT doc_id, chunk_no, text, length(text) > 1000 AS over_limit FROM chunks",
    "chunk_stats": f"""WITH {_LANG_CHUNKS} SELECT lang, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars,
        CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest,
        count(*) FILTER (length(text) > 1000) AS n_over FROM chunks GROUP BY lang""",
    "build_requests": f"""WITH {_DOC_CHUNKS} SELECT doc_id, chunk_no, {_json_text(f'''{{'model': 'stand-in', 'messages': [
        {{'role': 'system', 'content': '{instruction(CONFIG.source_lang, CONFIG.target_lang)}'}},
        {{'role': 'user', 'content': 'Text to translate: ' || text}}]}}''')} AS request FROM chunks""",
    "parse_responses": f"""SELECT conv_id, turn, CASE
        WHEN (conv_id + turn) % 11 = 0 OR (conv_id + turn) % 13 = 0 OR (conv_id + turn) % 7 = 0 THEN NULL
        ELSE nullif({_strip('text')}, '') END AS answer FROM conversations""",
    "translate_fallback": f"WITH {_DOC_CHUNKS}, {_translated()} SELECT doc_id, chunk_no, translated, status FROM done",
    "translate_distinct": f"WITH {_DOC_CHUNKS}, {_translated()} SELECT doc_id, chunk_no, translated, status FROM done",
    "glossary_translate": f"""WITH {_DOC_CHUNKS},
        g AS (SELECT lower(array_to_string(list_slice(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), 1, 1 + item_id % 4), ' ')) AS phrase,
          min('<' || item_id || '>') AS translation FROM benchmark GROUP BY 1 HAVING phrase <> ''),
        w AS (SELECT doc_id, chunk_no, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws,
          string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS gs FROM chunks),
        p AS (SELECT doc_id, chunk_no, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'i': i,
            'g': [gs[i + 1], gs[i + 2], gs[i + 3]], 'w': [lower(ws[i]), lower(ws[i + 1]), lower(ws[i + 2]), lower(ws[i + 3])]}})) AS p FROM w),
        s AS (SELECT doc_id, chunk_no, p.i AS i, n, array_to_string(list_slice(p.w, 1, n), ' ') AS phrase FROM p, (SELECT unnest(range(1, 5)) AS n)
          WHERE p.w[n] IS NOT NULL AND len(list_filter(list_slice(p.g, 1, n - 1), lambda x: {_strip('x')} <> '')) = 0),
        h AS (SELECT doc_id, chunk_no, list({{'i': i, 'e': i + n, 't': translation, 'o': ''}} ORDER BY i, n DESC) AS hs FROM s JOIN g USING (phrase) GROUP BY ALL),
        -- 'o' is what is written so far, 'e' the first word that is not
        r AS (SELECT doc_id, chunk_no, text, ws, gs, list_reduce(list_prepend({{'i': 0, 'e': 1, 't': '0', 'o': ''}}, hs), lambda a, x:
          CASE WHEN x.i < a.e THEN a ELSE {{'i': 0, 'e': x.e, 't': (a.t::INT + 1)::VARCHAR,
            'o': a.o || array_to_string(list_transform(range(a.e, x.i), lambda k: gs[k] || ws[k]), '') || gs[x.i] || x.t}} END) AS f
          FROM w JOIN h USING (doc_id, chunk_no))
        SELECT doc_id, chunk_no, coalesce(f.o || array_to_string(list_transform(range(f.e, len(w.ws) + 1), lambda k: w.gs[k] || w.ws[k]), '') || w.gs[len(w.ws) + 1], w.text) AS answer,
          CAST(coalesce(f.t::INT, 0) AS INT) AS n_terms FROM w LEFT JOIN r USING (doc_id, chunk_no)""",
    "memory_misses": f"""WITH {_LANG_CHUNKS} SELECT {_KEY} AS chunk_key, text, count(*) AS copies FROM chunks
        GROUP BY text HAVING count(*) FILTER (lang = 'en') = 0""",
    "rejoin_blocks": f"WITH {_BLOCK_WORK} SELECT * FROM rejoined",
    "translated_pages": f"""WITH {_DOCS} SELECT doc_id, page_num, t AS translated, CAST(b AS INT) AS n_blocks,
        CAST(c AS INT) AS n_chunks, CAST(f AS INT) AS n_failed FROM page_text""",
    "translated_docs": f"WITH {_DOCS} SELECT * FROM docs",
    "translated_docs_service": f"WITH {_DOCS} SELECT * FROM docs",
    "translate_corpus": f"""WITH {_LANG_CHUNKS}, {_translated()}
        SELECT doc_id, lang, string_agg(translated, ' ' ORDER BY chunk_no) AS translated, CAST(count(*) AS INT) AS n_chunks,
          CAST(count(*) FILTER (status IN ('failed', 'empty')) AS INT) AS n_failed, 'admitted' AS verdict
        FROM done WHERE lang IN ({_LANGS}) GROUP BY doc_id, lang
        UNION ALL SELECT doc_id, lang, NULL, 0, 0, 'language' FROM documents WHERE lang NOT IN ({_LANGS})""",
    "decode_outcomes": """WITH d AS (
        SELECT doc_id, strlen(text) % 7 AS r, CAST((len(string_split(text, chr(10))) + 19) // 20 AS INT) AS n FROM documents)
        SELECT doc_id, CASE r WHEN 0 THEN 'unreadable' WHEN 1 THEN 'no_pages' ELSE 'translated' END AS status,
          CASE WHEN r < 2 THEN 0 ELSE n END AS n_pages, r < 2 AS without_text FROM d""",
    "outcome_causes": f"""WITH {_LANG_CHUNKS}, {_translated()} SELECT lang, status,
        CASE WHEN status = 'failed' THEN 'RuntimeError' END AS cause, count(*) AS n FROM done GROUP BY ALL""",
    "job_events": f"WITH {_DOCS}, {_events(6000)}",
    "intake_files": f"""SELECT 'up/' || page_id || CASE WHEN page_id % 9 = 4 THEN '.txt' ELSE '.html' END AS path,
        CASE WHEN page_id % 9 = 2 THEN 'empty' WHEN page_id % 9 = 4 THEN 'magic' WHEN page_id % 9 = 5 THEN 'missing'
          WHEN strlen(html) + CAST(page_id % 9 = 3 AS INT) > {JOB_RULES.max_bytes} THEN 'size' WHEN page_id % 9 = 3 THEN 'magic'
          WHEN starts_with(html, '<!DOCTYPE') THEN 'admitted' ELSE 'magic' END AS verdict FROM pages""",
    "quota_large": """WITH r AS (
        SELECT event_id, event_type AS client,
          row_number() OVER (PARTITION BY event_type, date_trunc('month', ts) ORDER BY event_id) <= 1500 AS ok FROM events)
        SELECT event_id, client, ok AS within_day, ok AS allowed FROM r""",
    "html_blocks": _html_blocks(),
    "layout_collisions": f"""WITH {BLOCKS} SELECT b.doc_id, b.page_num, b.block_no, CAST(count(e.block_no) AS INT) AS n_earlier
        FROM blocks b LEFT JOIN blocks e ON e.doc_id = b.doc_id AND e.page_num = b.page_num AND e.block_no < b.block_no
          AND e.x0 < b.x1 AND b.x0 < e.x1 AND e.y0 < b.y1 AND b.y0 < e.y1 GROUP BY ALL""",
    "overflow_report": f"""WITH {_REPLACED} SELECT {_BK},
        coalesce(ceil(length(translated) * size * 0.5::DOUBLE / nullif(x1 - x0, 0)) * size * 1.2::DOUBLE > y1 - y0, true) AS overflow FROM replaced""",
    "preservation_audit": f"""WITH {_LANG_CHUNKS}, {_translated()},
        outs AS (SELECT doc_id, string_agg(translated, ' ' ORDER BY chunk_no) AS o FROM done GROUP BY doc_id),
        p(kind, re) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in KEPT_KINDS.items())}),
        s AS (SELECT doc_id, lang, kind, unnest(regexp_extract_all(text, re)) AS t FROM documents, p),
        o AS (SELECT doc_id, kind, unnest(regexp_extract_all(o, re)) AS t FROM outs, p),
        sc AS (SELECT doc_id, lang, kind, t, count(*) AS n FROM s GROUP BY ALL),
        oc AS (SELECT doc_id, kind, t, count(*) AS n FROM o GROUP BY ALL),
        l AS (SELECT sc.doc_id, sc.lang, kind, sum(sc.n) AS n, sum(greatest(sc.n - coalesce(oc.n, 0), 0)) AS lost
          FROM sc LEFT JOIN oc USING (doc_id, kind, t) GROUP BY ALL)
        SELECT d.lang, p.kind, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS n_pieces, CAST(coalesce(sum(l.lost), 0) AS BIGINT) AS n_lost,
          count(*) FILTER (l.lost > 0) AS n_rows_with_loss
        FROM documents d CROSS JOIN p LEFT JOIN l ON l.doc_id = d.doc_id AND l.kind = p.kind GROUP BY d.lang, p.kind""",
    "outcome_report": f"WITH {_LANG_CHUNKS}, {_translated()} SELECT lang, status, count(*) AS n FROM done GROUP BY lang, status",
    "outcome_rollup": f"""WITH {_LANG_CHUNKS}, {_translated()} SELECT lang, source, status,
        CAST(grouping_id(lang, source, status) AS INT) AS level, count(*) AS n FROM done GROUP BY ROLLUP (lang, source, status)""",
    "observed_outcomes": f"""WITH {_LANG_CHUNKS}, {_translated()} SELECT count(*) AS n_chunks,
        count(*) FILTER (status IN ('failed', 'empty')) AS n_failed, count(*) AS n_written FROM done""",
    "line_report": f"""WITH {_REPLACED},
        s AS (SELECT {_BK}, string_split_regex({_strip('translated')}, '{_SPACE_RUN}') AS ws, greatest(CAST(floor((x1 - x0) / (size * 0.5::DOUBLE)) AS INT), 1) AS m,
          greatest(CAST(floor((y1 - y0) / (size * 1.2::DOUBLE)) AS INT), 0) AS n_room FROM replaced),
        -- every word takes its letters one by one: the line each letter of a word comes to
        f AS (SELECT {_BK}, n_room, list_reduce(list_prepend({{'w': 0, 'line': 0, 'used': 0, 'lost': 0}}, list_transform(ws, lambda w: {{'w': length(w), 'line': 0, 'used': 0, 'lost': 0}})),
          lambda a, x: CASE WHEN a.used + (a.used > 0)::INT + x.w <= m
            THEN {{'w': 0, 'line': a.line, 'used': a.used + (a.used > 0)::INT + x.w, 'lost': a.lost + CASE WHEN a.line >= n_room THEN x.w ELSE 0 END}}
            ELSE {{'w': 0, 'line': a.line + (a.used > 0)::INT + (x.w - 1) // m, 'used': (x.w - 1) % m + 1,
              'lost': a.lost + len(list_filter(range(x.w), lambda i: a.line + (a.used > 0)::INT + i // m >= n_room))}} END) AS r FROM s)
        SELECT {_BK}, n_room, CAST(r.line + 1 AS INT) AS n_lines, CAST(r.lost AS INT) AS n_lost FROM f""",
    "edit_survival": f"""WITH {BLOCKS},
        c AS (SELECT b.doc_id, b.page_num, b.block_no, greatest(b.x0, e.x0)::INT AS l, least(b.x1, e.x1)::INT AS r, greatest(b.y0, e.y0)::INT AS t, least(b.y1, e.y1)::INT AS u
          FROM routed b JOIN routed e ON e.doc_id = b.doc_id AND e.page_num = b.page_num AND e.block_no <> b.block_no AND e.route = 'translate'
            AND (e.block_no > b.block_no OR b.route <> 'translate') AND e.x0 < b.x1 AND b.x0 < e.x1 AND e.y0 < b.y1 AND b.y0 < e.y1),
        rows AS (SELECT *, unnest(range(t, u)) AS y FROM c),
        cells AS (SELECT doc_id, page_num, block_no, y, unnest(range(l, r)) AS x FROM rows),
        covered AS (SELECT doc_id, page_num, block_no, count(DISTINCT (x, y)) AS n FROM cells GROUP BY ALL),
        times AS (SELECT doc_id, page_num, block_no, count(*) AS k FROM c GROUP BY ALL)
        SELECT b.doc_id, b.page_num, b.block_no, CAST(coalesce(k, 0) AS INT) AS n_clearing,
          round(CASE WHEN (b.x1 - b.x0) * (b.y1 - b.y0) > 0 THEN coalesce(n, 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) ELSE 0 END, 6) AS cleared
        FROM blocks b LEFT JOIN times USING ({_BK}) LEFT JOIN covered USING ({_BK})""",
    "event_fragments": f"""WITH e AS (WITH {_DOCS}, {_events(6000)})
        SELECT doc_id, event->>'type' AS type, CAST(event->>'page' AS INT) AS page, CAST(event->>'total' AS INT) AS total,
          CAST(event->>'percent' AS INT) AS percent, event->>'filename' AS filename, event->>'pdf_b64' AS pdf_b64, event->>'message' AS message FROM e""",
    "size_report": f"""WITH {_LANG_CHUNKS}, {_translated()},
        outs AS (SELECT doc_id, string_agg(translated, ' ' ORDER BY chunk_no) AS o FROM done GROUP BY doc_id),
        t AS (SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS in_bytes, CAST(sum(strlen(o)) AS BIGINT) AS out_bytes
              FROM documents JOIN outs USING (doc_id) GROUP BY lang, source)
        SELECT *, round(in_bytes / 1048576, 6) AS in_mb, round(out_bytes / 1048576, 6) AS out_mb,
          round(in_bytes / 1048576 - out_bytes / 1048576, 6) AS saved_mb,
          round((in_bytes - out_bytes) / nullif(in_bytes, 0) * 100, 6) AS reduction_pct FROM t""",
    "edit_plan_preserve": f"WITH {_REPLACED} {_edit('redact', '0')} FROM replaced",
    "edit_plan_free": f"""WITH {_REPLACED},
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY {_BK} ORDER BY line_no, span_no) - 1 AS no,
            NULL AS translated FROM spans JOIN (SELECT {_BK} FROM replaced) USING ({_BK})),
        totals AS (SELECT {_BK}, count(*) AS n FROM numbered GROUP BY ALL)
        {_edit('redact', 'no', text='NULL')} FROM numbered
        UNION ALL {_edit('insert', 'n')} FROM replaced JOIN totals USING ({_BK})""",
    "progress": f"WITH {_PROGRESS} SELECT * FROM progress",
    "quota": _VERDICTS,
    "quota_model_list": """WITH ranked AS (
        SELECT event_id, event_type AS client,
          row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS in_minute FROM events)
        SELECT event_id, client, in_minute <= 30 AS within_minute, in_minute <= 30 AS allowed FROM ranked""",
    "quota_admitted": f"WITH {_quota_ranks()} SELECT event_id, client FROM ranked WHERE in_hour <= 5 AND in_day <= 20",
    "quota_report": f"""WITH {_quota_ranks()} SELECT client, count(*) AS n_requests, count(*) FILTER (in_hour > 5) AS over_hour,
        count(*) FILTER (in_day > 20) AS over_day, count(*) FILTER (in_hour <= 5 AND in_day <= 20) AS n_admitted
        FROM ranked GROUP BY client""",
    "stream_intake": f"WITH {_ADMIT} SELECT job_id, verdict FROM judged",
    "stream_progress": f"WITH {_PROGRESS} SELECT doc_id, 'progress' AS type, page, total, percent FROM progress",
    "stream_translate": f"""WITH {_DOC_CHUNKS}, {_translated()}
        SELECT {_KEY} AS chunk_key, count(*) AS copies, translated, status FROM done GROUP BY text, translated, status""",
    "stream_quota": _VERDICTS,
    "stream_over_limit": """SELECT event_type AS client, date_trunc('hour', ts) AS period, count(*) AS n FROM events
        GROUP BY ALL HAVING count(*) > 5""",
}
for _name in ("preserve", "free"):
    ORACLE[f"edit_plan_service_{_name}"] = ORACLE[f"edit_plan_{_name}"]
ORACLE["stream_documents"] = ORACLE["translated_docs_service"]
ORACLE["stream_documents_parts"] = f"WITH {_DOCS} SELECT *, 'translated' AS status FROM docs"
ORACLE["stream_events"] = ORACLE["job_events"]
ORACLE["stream_translate_parts"] = ORACLE["stream_translate"]
_REFUSED = " ".join(f"WHEN '{v}' THEN '{m}'" for v, m in REFUSED_MESSAGES.items() if v != "url")
ORACLE["stream_service"] = f"""WITH {_SERVICE}, {_events(2000)}
    UNION ALL SELECT job_id, 1, '{{"type":"error","message":"' || CASE verdict WHEN 'url' THEN '{NOT_HTTPS_MESSAGE}' {_REFUSED} END || '"}}'
    FROM judged WHERE verdict <> 'admitted'"""
