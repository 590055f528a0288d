"""DuckDB SQL of the same files and results, told independently: by code points and by arithmetic."""

from __future__ import annotations

from ..functions.formats import TEXT
from ..schemas import DOMAIN
from . import fixtures as fx



def _spans(told: str) -> list[tuple[int, int]]:
    """Code point ranges of a text in hexadecimal."""
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in told.split())]


# Code points, told here apart from the tables of the code that the SQL is to judge.
_HIDDEN = _spans("00AD 034F 061C 115F 1160 17B4 17B5 180B-180E 200B-200F 202A-202E 2060-206F FE00-FE0F FEFF FFF9-FFFB E0000-E007F E0100-E01EF E000-F8FF F0000-FFFFD 100000-10FFFD")
_BLANK = _spans("00A0 1680 2000-200A 202F 205F 3000")
_PICTURES = _spans("1F000-1FAFF 2600-27BF 2300-23FF 00A9 00AE 203C 2049 2122 2139")
_SCRIPTS = _spans("0590-08FF 0900-0DFF 1780-18AF")
_BESIDE = [(_spans("180B-180D"), _spans("1800-18AF")), (_spans("17B4 17B5"), _spans("1780-17FF")), (_spans("115F 1160"), _spans("1100-11FF"))]


def chars(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in value) or "''"


def within(column: str, ranges: list[tuple[int, int]]) -> str:
    return "(" + " OR ".join(f"{column} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def choose(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def planted(traces: list[str]) -> str:
    trace = choose(f"(doc_id // 16) % {len(traces)}", [chars(x) for x in traces])
    at = "(1 + doc_id % greatest(length(text), 1))"
    ext = choose("doc_id % 16", [f"'{x}'" for x in TEXT])
    return f"ftext AS (SELECT doc_id, lang, {ext} AS ext, substr(text, 1, {at}) || {trace} || substr(text, {at} + 1) AS text FROM documents)"


def judged(source: str, name: str, key: str = "doc_id", column: str = "text") -> str:
    """Each code point of a text with its neighbours, and whether it counts."""
    keep = [
        f"(c IN (8205, 65039) AND p IS NOT NULL AND ({within('p', _PICTURES)} OR (c = 8205 AND n IS NOT NULL AND ({within('n', _PICTURES)} OR p = 65039))))",
        *[f"(c IN (8204, 8205) AND {within('p', [s])} AND {within('n', [s])})" for s in _SCRIPTS],
        *[f"({within('c', m)} AND p IS NOT NULL AND n IS NOT NULL AND ({within('p', b)} OR {within('n', b)}))" for m, b in _BESIDE],
    ]
    return f"""{name}_s AS (SELECT {key}, string_split({column}, '') AS cs FROM {source}),
{name}_c AS (SELECT {key}, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM {name}_s),
{name}_n AS (SELECT {key}, ch, i, unicode(ch) AS c, lag(unicode(ch)) OVER w AS p, lead(unicode(ch)) OVER w AS n FROM {name}_c WHERE ch <> '' WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name} AS (SELECT {key}, ch, i, {within('c', _HIDDEN)} AND NOT coalesce({' OR '.join(keep)}, false) AS inv, {within('c', _BLANK)} AS sp FROM {name}_n)"""


def cleaned(source: str, name: str, key: str = "doc_id") -> str:
    return f"{name} AS (SELECT {key}, coalesce(string_agg(CASE WHEN inv THEN '' WHEN sp THEN ' ' ELSE ch END, '' ORDER BY i), '') AS text FROM {source} GROUP BY {key})"


TEXT_FINDINGS = f"""text_found AS (
  SELECT doc_id, 'unicode' AS category, 'privacy' AS severity, count(*) AS count FROM j WHERE inv GROUP BY doc_id
  UNION ALL SELECT doc_id, 'unicode_space', 'informational', count(*) FROM j WHERE sp AND NOT inv GROUP BY doc_id)"""
HTML_META = r"""(?is)<meta\b[^>]*(?:name|property)\s*=\s*["''](?:generator|author|ai[_-]?(?:generated|model)|c2pa)["''][^>]*>"""
HTML_DATA = r"""(?is)\sdata-(?:ai|llm|model|c2pa)[\w-]*\s*=\s*(?:"[^"]*"|''[^'']*'')"""
SVG = r"(?is)<metadata\b[^>]*>.*?</metadata\s*>"


def pages(hidden: bool) -> str:
    name = f"'<meta na' || chr(8203) || 'me=\"generator\" content=\"x\">'" if hidden else "'<meta name=\"generator\" content=\"x\">'"
    return f"fhtml AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {name} ELSE '' END || CASE WHEN page_id % 5 = 0 THEN replace(html, '<body', '<body data-ai-model=''m''') ELSE html END AS html FROM pages)"


SVGS = """fsvg AS (SELECT doc_id, '<svg>' || CASE WHEN doc_id % 3 = 0 THEN '<METADATA id="1">' || text || '</metadata >' ELSE '' END || '<text>' || text || '</text></svg>' AS text FROM documents)"""
FRONT = "'---' || chr(10) || 'title: t' || chr(10) || {a} || {b} || '---' || chr(10)"
MARKDOWNS = (
    "fmd AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN text ELSE "
    + FRONT.format(a="CASE WHEN doc_id % 2 = 0 THEN 'Generator: g' || chr(10) ELSE '' END", b="CASE WHEN doc_id % 3 = 0 THEN '  ai_model : m' || chr(10) ELSE '' END")
    + " || text END AS text, CASE WHEN doc_id % 5 = 4 THEN text ELSE " + FRONT.format(a="CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN chr(10) ELSE '' END", b="''") + " || text END AS bare, "
    "CASE WHEN doc_id % 5 = 4 THEN 0 ELSE (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT END AS n FROM documents)"
)


def layout(name: str) -> str:
    """Parts of each container by arithmetic: ``doc_id, k, kind, trace, size``."""
    rows = []
    for k, (kind, trace, every, fixed, times) in enumerate(fx.CONTAINERS[name][1]):
        heads, size = "1", f"{fixed} + {times} * p"
        if name == "jpeg":  # a segment holds 65,000 bytes of payload
            heads = "greatest(1, (p + 64999) // 65000)"
            size = f"{fixed} * {heads} + {times} * p"
        elif name == "gif" and times:  # a byte more before each block of 255
            size += " + (p + 254) // 255"
        size = f"({size}) + ({size}) % 2" if name in fx.PADDED else size
        rows.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {repr(trace) if trace else 'NULL'} AS trace, {size} AS size, {heads} AS heads, p FROM sized WHERE doc_id % {every} = 0")
    return "sized AS (SELECT doc_id, strlen(coalesce(text, '')) AS p FROM documents),\nparts AS (" + "\nUNION ALL ".join(rows) + ")"


def container_findings(name: str) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{{}}'" for k in DOMAIN)
    category, label, severity = ("CASE trace " + names.format(*[v[i] for v in DOMAIN.values()]) + " END" for i in range(3))
    return f"WITH {layout(name)} SELECT doc_id, {category} AS category, {label} AS label, {severity} AS severity, CAST(sum(heads) AS BIGINT) AS count FROM parts WHERE trace IS NOT NULL GROUP BY ALL"


def container_clean(name: str) -> str:
    before, after, times = fx.AROUND[name]
    kept = "true" if name == "iso" else "trace IS NULL OR trace = 'profile'"
    extra = 8 if name == "iso" else 0
    return f"""WITH {layout(name)} SELECT doc_id, CAST({before} + {after} + {times} * any_value(p) + {extra} + coalesce(sum(size) FILTER (WHERE {kept}), 0) AS BIGINT) AS output_size,
  CAST(coalesce(sum(heads) FILTER (WHERE trace IS NOT NULL AND trace <> 'profile'), 0) AS BIGINT) AS removed, true AS success FROM parts GROUP BY doc_id"""


PNG_SEGMENTS = f"""WITH {layout('png')} SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS idx, kind, CAST(8 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(8 + sum(size) OVER w AS BIGINT) AS stop, trace IS NOT NULL AS private FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""
