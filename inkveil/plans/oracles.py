"""The same results as the registered queries give, in SQL for DuckDB."""

from __future__ import annotations

from inkveil.functions import fixed
from inkveil.functions.fixed import RE2, spelled
from inkveil.plans import derived

DOCS = "SELECT doc_id, 1 AS page, text FROM documents"
SOURCES = "SELECT source AS doc_id, doc_id AS page, text FROM documents"
_S = f"[{fixed.WS}]"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_S}+'), lambda w: w <> '')"


def _key(value: str) -> str:
    return f"lower(regexp_replace(regexp_replace({value}, '^{_S}+|{_S}+$', '', 'g'), '{_S}+', ' ', 'g'))"


_LOCAL, _DOMAIN = "split_part(v, '@', 1)", "split_part(v, '@', 2)"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER) ELSE (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER)) % 10 END)) % 10 = 0"
_PLAIN = "replace(v, ' ', '')"
_TURNED = f"list_transform(string_split(concat(substr({_PLAIN}, 5), substr({_PLAIN}, 1, 4)), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END)"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(array_to_string({_TURNED}, ''), ''), lambda c: CAST(c AS INTEGER))), lambda a, b: (a * 10 + b) % 97) = 1"
_LENGTHS = "MAP {" + ", ".join(f"'{k}': {n}" for k, n in fixed.IBAN_LENGTHS.items()) + "}"
_GROUPS = "len(list_filter(string_split(v, ':'), lambda g: g <> ''))"
VALID = {
    "email": rf"length({_LOCAL}) <= 64 AND length({_DOMAIN}) <= 254 AND NOT regexp_matches({_LOCAL}, '^\.|\.$|\.\.') AND NOT regexp_matches({_DOMAIN}, '^[.-]|-$|-\.|\.-|\.\.')",
    "ipv4": rf"regexp_full_match(v, '(?:{_OCTET}\.){{3}}{_OCTET}')",
    "ipv6": f"NOT regexp_matches(v, '^:[^:]') AND NOT contains(v, ':::') AND ((NOT contains(v, '::') AND {_GROUPS} = 8) OR (len(string_split(v, '::')) = 2 AND {_GROUPS} <= 7))",
    "card": f"regexp_matches({_DIGITS}, '{fixed.BRANDS}') AND {_LUHN}",
    "iban": f"coalesce({_LENGTHS}[substr({_PLAIN}, 1, 2)], 0) = length({_PLAIN}) AND {_MOD97}",
    "ssn": f"substr({_DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({_DIGITS}, 1, 1) <> '9' AND substr({_DIGITS}, 4, 2) <> '00' AND substr({_DIGITS}, 6) <> '0000'",
    "birth": f"regexp_matches(substr(text, CAST(greatest(e - length(v) - 40, 0) + 1 AS BIGINT), CAST(least(e - length(v), 40) AS BIGINT)), '{_q(spelled(fixed.BIRTH_WORDS, RE2))}')",
    "": "true",
}
#: A value of four characters or more with a digit, said without a lookahead: the digit comes first,
#: within, or only last. Matches are as long as they can be, whichever way it is.
_V, _A = "[A-Z0-9:/-]", "[A-Z0-9]"
_IDENTIFIER = rf"[0-9]{_V}{{2,}}{_A}|{_A}{_V}+[0-9]{_V}*{_A}|{_A}{_V}*[0-9]{_V}+{_A}|{_A}{_V}{{2,}}[0-9]"
_SEPARATORS = f"[{fixed.WS}:#().]*"


def _labelled(labels: str) -> str:
    return rf"(?i)\b(?:{labels})\b{_SEPARATORS}(?:(?:no|num|number)\b\.?{_SEPARATORS})?({_IDENTIFIER})"


#: rank, pat, type, pattern, valid, group
DETECTORS = [
    (1, 1, "Email", fixed.EMAIL, "email", 0), (2, 1, "IP Address", fixed.IPV4, "ipv4", 0), (2, 2, "IP Address", fixed.IPV6, "ipv6", 0),
    (3, 1, "Credit Card", fixed.CARD, "card", 0), (4, 1, "IBAN", fixed.IBAN, "iban", 0), (5, 1, "SSN", fixed.SSN, "ssn", 0),
    (6, 1, "Date of Birth", fixed.DATE, "birth", 0), (6, 2, "Date of Birth", fixed.BIRTH_YEAR, "", 1),
    (7, 1, "Passport", _labelled(fixed.PASSPORT_LABELS), "", 1), (8, 1, "Visa", _labelled(fixed.VISA_LABELS), "", 1),
    (9, 1, "Case Number", _labelled(fixed.CASE_LABELS), "", 1), (9, 2, "Case Number", fixed.COURT_CASE, "", 0), (9, 3, "Case Number", fixed.AGENCY_CASE, "", 0),
    (10, 1, "License Plate", _labelled(fixed.PLATE_LABELS), "", 1), (11, 1, "ID Number", _labelled(fixed.ID_LABELS), "", 1),
    (12, 1, "Person", fixed.TITLED, "", 1), (13, 1, None, fixed.DATE, "", 0), (14, 1, "Phone", r"(?:^|[^A-Za-z0-9_+(.-])((?:" + fixed.PHONE + "))", "", 1),
]


def _candidates(pages: str, kinds: list) -> str:
    out = []
    for rank, pat, kind, pattern, valid, group in DETECTORS:
        if kind not in kinds:
            continue
        p = _q(spelled(pattern, RE2))
        name = f"'{kind}'" if kind else "CAST(NULL AS VARCHAR)"
        out.append(
            f"SELECT doc_id, page, {rank} AS rank, {pat} AS pat, {name} AS type, CAST(e - length(v) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, v AS value FROM ("
            f"SELECT doc_id, page, text, vs[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) AS e FROM ("
            f"SELECT doc_id, page, text, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS g FROM ({pages}) pg"
            f") m, unnest(range(1, len(w) + 1)) t(i)) f WHERE {VALID[valid]}"
        )
    return " UNION ALL ".join(out)


def _matches(pages: str, kinds: list[str]) -> str:
    return f"SELECT doc_id, page, type, s, e, value FROM ({_candidates(pages, kinds)}) c"


def _claims(pages: str, kinds: list) -> str:
    """CTEs that end in `claims`: the accepted candidates, the first to claim a span winning."""
    return f"""cand AS ({_candidates(pages, kinds)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY rank, pat, s) AS k FROM cand),
walk AS (
  SELECT doc_id, page, k, true AS ok, [{{'s': s, 'e': e}}] AS acc FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.k, len(list_filter(w.acc, lambda a: n.s < a.e AND n.e > a.s)) = 0,
    CASE WHEN len(list_filter(w.acc, lambda a: n.s < a.e AND n.e > a.s)) = 0 THEN list_append(w.acc, {{'s': n.s, 'e': n.e}}) ELSE w.acc END
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k + 1),
claims AS (SELECT n.* FROM numbered n JOIN walk w ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k WHERE w.ok)"""


ALL_KINDS = [d[2] for d in DETECTORS]


def _entities(pages: str) -> str:
    """CTEs that end in `ents`: doc_id, type, value, value_key, page, ord."""
    return f"""{_claims(pages, ALL_KINDS)},
keyed AS (SELECT *, {_key('value')} AS value_key FROM claims WHERE type IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value_key ORDER BY page, rank, pat, s) AS n FROM keyed),
ents AS (SELECT doc_id, type, value, value_key, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, rank, pat, s) AS ord FROM firsts WHERE n = 1)"""


def _located(values: str, pages: str, name: str = "found") -> str:
    """A CTE of the whole-word matches of values without white space runs: doc_id, value, page, s, e."""
    before = "CASE WHEN ps[i] <> '' THEN right(ps[i], 1) WHEN i = 1 THEN '' ELSE right(v, 1) END"
    after = "CASE WHEN ps[i + 1] <> '' THEN left(ps[i + 1], 1) WHEN i + 1 = len(ps) THEN '' ELSE left(v, 1) END"
    return f"""{name} AS (
  SELECT doc_id, value, page, CAST(place AS INTEGER) AS s, CAST(place + length(value) AS INTEGER) AS e FROM (
    SELECT doc_id, value, page, list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(v) AS place FROM (
      SELECT v.doc_id, v.value, p.page, lower(v.value) AS v, string_split(lower(p.text), lower(v.value)) AS ps
      FROM (SELECT DISTINCT doc_id, value FROM ({values}) x) v JOIN ({pages}) p ON p.doc_id = v.doc_id WHERE contains(lower(p.text), lower(v.value))) y,
    unnest(range(1, len(ps))) t(i) WHERE NOT regexp_matches({before}, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches({after}, '[\\p{{L}}\\p{{N}}_]')) z)"""


_ISLANDS = """ordered AS (SELECT DISTINCT doc_id, page, s, e FROM found),
marked AS (SELECT *, max(e) OVER (PARTITION BY doc_id, page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ordered),
grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT doc_id, page, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e FROM grouped GROUP BY doc_id, page, island)"""


def _redacted(pages: str, mask: str = "repeat('█', sp.e - sp.s)") -> str:
    """CTEs from `spans` to `redacted`: the pages with their spans blacked out."""
    return f"""pieces AS (
  SELECT sp.doc_id, sp.page, sp.s, sp.e, substr(d.text, coalesce(lag(sp.e) OVER w, 0) + 1, sp.s - coalesce(lag(sp.e) OVER w, 0)) || {mask} AS piece
  FROM spans sp JOIN ({pages}) d ON d.doc_id = sp.doc_id AND d.page = sp.page WINDOW w AS (PARTITION BY sp.doc_id, sp.page ORDER BY sp.s)),
joined AS (SELECT doc_id, page, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last, CAST(count(*) AS INTEGER) AS n FROM pieces GROUP BY doc_id, page),
redacted AS (SELECT d.doc_id, d.page, coalesce(j.n, 0) AS n_redacted, coalesce(j.head || substr(d.text, j.last + 1), d.text) AS redacted_text FROM ({pages}) d LEFT JOIN joined j ON j.doc_id = d.doc_id AND j.page = d.page)"""


_REDACTED = f"{_entities(DOCS)}, {_located('SELECT doc_id, value FROM ents', DOCS)}, {_ISLANDS}, {_redacted(DOCS)}"
_SUMMARY = "summary AS (SELECT doc_id, value, list_sort(list_distinct(list(page))) AS pages, count(*) AS count FROM found GROUP BY doc_id, value)"
_GROUPS_CTE = """grps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS group_order FROM ents)"""


def _stats(pages: str) -> str:
    count = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]'))"
    return f"SELECT doc_id, page, CAST({count} AS BIGINT) AS char_count, CAST(0 AS DOUBLE) AS image_coverage, {count} >= 20 AS has_text, false AS scanned FROM ({pages}) p"


def _chunks(pages: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, page, CAST(k AS INTEGER) AS chunk, array_to_string(ws[k * {step} + 1 : k * {step} + {size}], ' ') AS chunk_text
FROM (SELECT doc_id, page, {_words("coalesce(text, '')")} AS ws FROM ({pages}) p) x, unnest(range(0, 1 + CAST(greatest(ceil((len(ws) - {size}) / {step}.0), 0) AS BIGINT))) t(k) WHERE len(ws) > 0"""


def _stitched(text: str, pattern: str, change, i: str) -> str:
    """Every match of the pattern in the text changed, the gaps between them as they are."""
    hits, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    return f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda {i}: {gaps}[{i}] || coalesce({change(f'{hits}[{i}]')}, '')), '')"


def _cleaned(text: str) -> str:
    line = "line"
    for pattern in fixed.NOISE:
        line = f"regexp_replace({line}, '{spelled(pattern, RE2)}', '', 'g')"
    run, word = _q(spelled(fixed.CAPS_RUN, RE2)), _q(fixed.CAPS_WORD)
    titled = _stitched("bare", run, lambda r: _stitched(r, word, lambda w: f"(substr({w}, 1, 1) || lower(substr({w}, 2)))", "k"), "i")
    return f"""SELECT doc_id, 1 AS page, coalesce(string_agg(done, chr(10) ORDER BY n) FILTER (WHERE regexp_matches(done, '[a-zA-Z]{{2,}}')), '') AS cleaned FROM (
  SELECT doc_id, n, {titled} AS done FROM (SELECT doc_id, n, {line} AS bare FROM (SELECT doc_id, unnest(string_split(coalesce({text}, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) AS n FROM documents) a) b) c GROUP BY doc_id"""


_AREA = "greatest(least(x1, 612.0) - greatest(x0, 0.0), 0.0) * greatest(least(y1, 792.0) - greatest(y0, 0.0), 0.0) / (612.0 * 792.0)"
_IMAGE_STATS = f"""istats AS (
  SELECT p.doc_id, p.page, CAST(len(regexp_extract_all(p.text, '[\\p{{L}}\\p{{N}}]')) AS BIGINT) AS char_count, least(coalesce(a.area, 0.0), 1.0) AS image_coverage, coalesce(a.largest, 0.0) AS largest
  FROM ({derived.IMAGE_PAGES}) p LEFT JOIN (SELECT doc_id, page, sum({_AREA}) AS area, max({_AREA}) AS largest FROM ({derived.IMAGES}) i GROUP BY doc_id, page) a ON a.doc_id = p.doc_id AND a.page = p.page)"""
_INVENTORY = f"""iraw AS (
  SELECT i.doc_id, i.page, i.idx, greatest(x1 - x0, y1 - y0) >= 40 AS big, (x1 - x0) * (y1 - y0) / (612.0 * 792.0) >= 0.9 AS covers,
    coalesce(length(regexp_replace(p.text, '\\s', '', 'g')) >= 20, false) AS text_layer
  FROM ({derived.IMAGES}) i LEFT JOIN ({derived.IMAGE_PAGES}) p ON p.doc_id = i.doc_id AND p.page = i.page),
inventory AS (
  SELECT doc_id, page, idx, page || ':' || idx AS id, covers AND NOT text_layer AS full_page, big, covers, text_layer
  FROM (SELECT *, bool_or(covers AND text_layer) OVER (PARTITION BY doc_id, page) AS hid FROM iraw) x WHERE big AND NOT hid)"""

_HREF = r"""(?i)<a\s[^>]*?href=("[^"]*"|''[^'']*'')"""
_ANCHOR = r"""(?is)<a\s[^>]*?href=("[^"]*"|''[^'']*'')[^>]*>(.*?)</a>"""


def _unlinked(html: str) -> str:
    """Every anchor with a scheme becomes what it holds."""
    change = lambda a: f"(CASE WHEN regexp_matches(regexp_extract({a}, '{_ANCHOR}', 1), '^.[a-zA-Z][a-zA-Z0-9+.-]*:') THEN regexp_extract({a}, '{_ANCHOR}', 2) ELSE {a} END)"
    return _stitched(html, _ANCHOR, change, "i")


_OWN_AREA = "greatest(least(i.x1, coalesce(b.x1, 612.0)) - greatest(i.x0, 0.0), 0.0) * greatest(least(i.y1, coalesce(b.y1, 792.0)) - greatest(i.y0, 0.0), 0.0) / (coalesce(b.x1, 612.0) * coalesce(b.y1, 792.0))"
_BOUNDED = f"""istats AS (
  SELECT p.doc_id, p.page, CAST(len(regexp_extract_all(p.text, '[\\p{{L}}\\p{{N}}]')) AS BIGINT) AS char_count, least(coalesce(a.area, 0.0), 1.0) AS image_coverage, coalesce(a.largest, 0.0) AS largest
  FROM ({derived.IMAGE_PAGES}) p LEFT JOIN (SELECT i.doc_id, i.page, sum({_OWN_AREA}) AS area, max({_OWN_AREA}) AS largest FROM ({derived.IMAGES}) i LEFT JOIN ({derived.BOUNDS}) b ON b.doc_id = i.doc_id AND b.page = i.page GROUP BY i.doc_id, i.page) a ON a.doc_id = p.doc_id AND a.page = p.page)"""
_HITS = f"""SELECT doc_id, page, 0 AS pos, person AS value FROM ({derived.NAMES}) n
UNION ALL SELECT doc_id, page, 3, 'BADGE  id ' || (90000 + k) FROM ({derived.NAMES}) n"""


def _without(html: str, start: str, end: str, i: str) -> str:
    """The text without what stands from each `start` to the next `end`, by splitting it."""
    parts = f"string_split({html}, '{start}')"
    return f"(list_first({parts}) || array_to_string(list_transform({parts}[2:], lambda {i}: substr({i}, instr({i}, '{end}') + {len(end)})), ''))"


#: The given pages hold comments, scripts and metadata, in small letters, and no other hidden content.
_STRIPPED = _without(_without(_without("html", "<!--", "-->", "x"), "<script", "</script>", "y"), "<meta", ">", "z")
_KINDS = "list_filter([CASE WHEN contains(html, '<meta') THEN 'metadata' END, CASE WHEN contains(html, '<script') THEN 'scripts' END, CASE WHEN contains(html, '<!--') THEN 'comments' END], lambda x: x IS NOT NULL)"
_TYPES = "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.TAG_TYPES.items()) + "}[tag], tag)"
_CUSTOM = """custom AS (SELECT source AS doc_id, regexp_extract(arg_min(text, doc_id), '[A-Za-z]{3,}', 0) AS value FROM documents GROUP BY source)"""
_LOOP = f"""listed AS (SELECT *, type || ':' || lower(value) AS key FROM ({derived.LISTED}) l),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS rn FROM listed),
streaks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, key, rn - total ORDER BY pos) AS streak FROM counted),
loops AS (SELECT doc_id, page, arg_min(key, pos) AS key, min(pos) AS pos FROM streaks WHERE streak >= 3 OR total >= 6 GROUP BY doc_id, page)"""
_WANT = r"""want AS (
  SELECT doc_id, lower(value) AS v FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS value FROM documents
    UNION ALL SELECT doc_id, regexp_extract(text, '[A-Za-z]{2,}', 0) FROM documents) x WHERE value <> '')"""
_EVAL = f"""{_REDACTED}, {_WANT},
{_located('SELECT doc_id, v AS value FROM want', 'SELECT doc_id, page, redacted_text AS text FROM redacted', 'left_over')},
caught AS (SELECT w.doc_id, count(*) AS n_expected, count(*) FILTER (WHERE l.value IS NOT NULL) AS n_missed FROM want w LEFT JOIN (SELECT DISTINCT doc_id, value FROM left_over) l ON l.doc_id = w.doc_id AND l.value = w.v GROUP BY w.doc_id),
dets AS (SELECT DISTINCT doc_id, value_key AS d FROM ents),
nd AS (SELECT doc_id, count(*) AS n_detected, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.doc_id = dets.doc_id AND (contains(w.v, dets.d) OR contains(dets.d, w.v)))) AS n_false FROM dets GROUP BY doc_id),
evals AS (
  SELECT d.doc_id, coalesce(c.n_expected, 0) AS n_expected, coalesce(c.n_missed, 0) AS n_missed, CASE WHEN c.n_expected > 0 THEN (c.n_expected - c.n_missed) / c.n_expected ELSE 0.0 END AS catch_rate, coalesce(nd.n_detected, 0) AS n_detected, coalesce(nd.n_false, 0) AS n_false,
    CASE WHEN nd.n_detected > 0 THEN nd.n_false / nd.n_detected ELSE 0.0 END AS false_positive_rate FROM documents d LEFT JOIN caught c ON c.doc_id = d.doc_id LEFT JOIN nd ON nd.doc_id = d.doc_id)"""


def oracle_sql() -> dict[str, str]:
    r = "WITH RECURSIVE "
    source_summary = f"{_entities(SOURCES)}, {_located('SELECT doc_id, value FROM ents', SOURCES)}, {_SUMMARY}"
    return {
        "detect_email": _matches(DOCS, ["Email"]),
        "detect_ip": _matches(DOCS, ["IP Address"]),
        "detect_card": _matches(DOCS, ["Credit Card"]),
        "detect_phone": _matches(DOCS, ["Phone"]),
        "detect_ssn": _matches(derived.NOTES, ["SSN"]),
        "detect_iban": _matches(derived.NOTES, ["IBAN"]),
        "detect_birth": _matches(derived.NOTES, ["Date of Birth"]),
        "detect_labelled_ids": _matches(derived.NOTES, ["Passport", "Visa", "Case Number", "License Plate", "ID Number"]),
        "detect_titled": _matches(derived.NOTES, ["Person"]),
        "detect_ipv6": _matches(derived.NOTES, ["IP Address"]),
        "note_entities": f"{r}{_claims(derived.NOTES, ALL_KINDS)} SELECT doc_id, page, rank, pat, type, s, e, value FROM claims WHERE type IS NOT NULL",
        "claimed_entities": f"{r}{_claims(DOCS, ALL_KINDS)} SELECT doc_id, page, rank, pat, type, s, e, value FROM claims WHERE type IS NOT NULL",
        "first_seen_entities": f"{r}{_entities(SOURCES)} SELECT * FROM ents",
        "surnames": f"""WITH firsts AS (SELECT *, {_key('value')} AS k, row_number() OVER (PARTITION BY doc_id, {_key('value')} ORDER BY page, ord) AS n FROM ({derived.PEOPLE}) p),
base AS (SELECT doc_id, value, k, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS ord FROM firsts WHERE n = 1),
names AS (SELECT doc_id, page, ord, list_filter(string_split_regex(replace(value, ',', ' '), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{fixed.NAME_SUFFIXES}')) AS ws FROM base),
last AS (SELECT doc_id, page, ord, regexp_replace(ws[len(ws)], '[^\\p{{L}}''’-]', '', 'g') AS value FROM names WHERE len(ws) >= 2),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY ord) AS n FROM last WHERE length(value) >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = last.doc_id AND b.k = lower(last.value))),
top AS (SELECT doc_id, max(ord) AS top FROM base GROUP BY doc_id)
SELECT doc_id, value, page, ord FROM base
UNION ALL SELECT o.doc_id, o.value, o.page, CAST(t.top + row_number() OVER (PARTITION BY o.doc_id ORDER BY o.ord) AS BIGINT) FROM one o JOIN top t ON t.doc_id = o.doc_id WHERE o.n = 1""",
        "match_summary": f"{r}{source_summary} SELECT doc_id, value, pages, count FROM summary",
        "group_entities": f"{r}{_entities(SOURCES)}, {_GROUPS_CTE} SELECT doc_id, value_key, type, value, true AS approved, page AS first_page, group_order FROM grps",
        "review_list": f"""{r}{source_summary}, {_GROUPS_CTE},
lst AS (SELECT g.doc_id, g.type, g.value, s.pages, s.count, row_number() OVER (PARTITION BY g.doc_id ORDER BY s.pages[1], g.group_order) AS place FROM grps g JOIN summary s ON s.doc_id = g.doc_id AND s.value = g.value),
led AS (SELECT *, min(place) OVER (PARTITION BY doc_id, type) AS lead FROM lst)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY lead) AS INTEGER) AS category_order, CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY place) AS INTEGER) AS item_order, type, value, true AS approved, pages, count FROM led""",
        "category_rollup": f"""{r}{_entities(SOURCES)} SELECT doc_id, type, count(*) AS n, count(*) FILTER (WHERE length(value) % 2 = 0) AS n_approved,
CASE WHEN bool_and(length(value) % 2 = 0) THEN 'all' WHEN NOT bool_or(length(value) % 2 = 0) THEN 'none' ELSE 'mixed' END AS state FROM ents GROUP BY doc_id, type""",
        "redaction_spans": f"{r}{_entities(DOCS)}, {_located('SELECT doc_id, value FROM ents', DOCS)}, {_ISLANDS} SELECT * FROM spans",
        "redacted_documents": f"{r}{_REDACTED} SELECT * FROM redacted",
        "stored_redactions": f"""{r}{_entities(DOCS)}, {_located('SELECT doc_id, value FROM ents', DOCS)}, {_ISLANDS}, {_redacted(DOCS, "CASE WHEN (SELECT source FROM documents x WHERE x.doc_id = sp.doc_id) = 'src3' THEN '-' ELSE repeat('█', sp.e - sp.s) END")}
SELECT r.doc_id, d.source, r.n_redacted, r.redacted_text FROM redacted r JOIN documents d ON d.doc_id = r.doc_id""",
        "report_history": f"SELECT x.run, x.model, has_text, count(*) AS pages, CAST(sum(char_count) AS BIGINT) AS chars FROM ({_stats(DOCS)}) s, (VALUES ('r1', 'again'), ('r2', 'second')) x(run, model) GROUP BY 1, 2, 3",
        "expected_values": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, value, 'person' AS type FROM ({derived.PEOPLE}) p",
        "page_stats": _stats(DOCS),
        "any_text_docs": f"SELECT doc_id FROM ({_stats(DOCS)}) s WHERE has_text",
        "image_page_stats": f"WITH {_IMAGE_STATS} SELECT doc_id, page, char_count, round(image_coverage, 9) AS image_coverage, char_count >= 20 AS has_text, char_count >= 20 AND largest >= 0.9 AS scanned FROM istats",
        "image_only_pages": f"""WITH {_IMAGE_STATS}, l AS (SELECT doc_id, list_sort(list(page)) AS pages FROM istats WHERE char_count < 20 AND image_coverage >= 0.05 GROUP BY doc_id)
SELECT doc_id, pages, CASE WHEN len(pages) = 1 THEN 'Page ' || pages[1] ELSE 'Pages ' || array_to_string(pages[1:len(pages) - 1], ', ') || ' and ' || pages[len(pages)] END AS listed FROM l""",
        "scanned_pages": f"WITH {_IMAGE_STATS} SELECT doc_id, list_sort(list(page)) AS pages FROM istats WHERE char_count >= 20 AND largest >= 0.9 GROUP BY doc_id",
        "image_inventory": f"WITH {_INVENTORY} SELECT * FROM inventory",
        "image_page_removal": f"""WITH {_INVENTORY}, gone AS (SELECT DISTINCT doc_id, page FROM inventory WHERE full_page AND doc_id % 2 = 0),
x AS (SELECT p.doc_id, p.page, g.page IS NOT NULL AS gone FROM ({derived.IMAGE_PAGES}) p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.page = p.page),
y AS (SELECT *, bool_and(gone) OVER (PARTITION BY doc_id) AS error FROM x) SELECT doc_id, page, NOT gone OR error AS kept, error FROM y""",
        "reconstructed_text": f"""WITH RECURSIVE raw AS ({derived.LINES}), lines AS (SELECT doc_id, page, ord, x, CAST(y AS DOUBLE) AS y, trim(text) AS text, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM raw),
walk AS (
  SELECT doc_id, page, k, x, ord, text, y AS a, [y] AS acc FROM lines WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.k, n.x, n.ord, n.text, coalesce(list_filter(w.acc, lambda a: abs(a - n.y) <= 4)[1], n.y), CASE WHEN len(list_filter(w.acc, lambda a: abs(a - n.y) <= 4)) > 0 THEN w.acc ELSE list_append(w.acc, n.y) END
  FROM walk w JOIN lines n ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k + 1),
rws AS (SELECT doc_id, page, a, string_agg(text, ' ' ORDER BY x, ord) AS t FROM walk GROUP BY doc_id, page, a)
SELECT doc_id, page, string_agg(t, chr(10) ORDER BY a) AS text FROM rws GROUP BY doc_id, page""",
        "chunked_documents": _chunks(DOCS, 200, 30),
        "cleaned_documents": _cleaned("text"),
        "value_keys": f"SELECT doc_id, sha256({_key('text')}) AS key FROM documents",
        "conversation_chunks": _chunks("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations", 50, 10),
        "conversation_stats": _stats("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations"),
        "link_inventory": f"""WITH l AS (SELECT page_id AS doc_id, substr(u[i], 2, length(u[i]) - 2) AS url, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS u FROM pages) x, unnest(range(1, len(u) + 1)) t(i))
SELECT doc_id, url, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AS is_external, [1] AS pages, count(*) AS count, 1 AS first_page, min(pos) AS first_pos FROM l GROUP BY doc_id, url""",
        "removal_reports": f"""WITH k AS (SELECT page_id AS doc_id, {_KINDS} AS kinds FROM pages)
SELECT doc_id, kinds, CASE WHEN len(kinds) = 0 THEN 'No personal details found.' WHEN len(kinds) = 1 THEN 'Removed: ' || kinds[1] || '.' ELSE 'Removed: ' || array_to_string(kinds[1:len(kinds) - 1], ', ') || ' and ' || kinds[len(kinds)] || '.' END AS sentence FROM k""",
        "stripped_pages": f"SELECT page_id AS doc_id, {_STRIPPED} AS html FROM pages",
        "stripped_forms": f"""SELECT doc_id, html, list_filter([CASE WHEN k % 3 = 0 THEN 'comments' END, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'attachments' END, 'alternative text', 'form data'], lambda x: x IS NOT NULL) AS kinds FROM ({derived.SEEN}) s""",
        "html_pii": _matches("SELECT page_id AS doc_id, 1 AS page, html AS text FROM pages", ["Email", "IP Address", "Credit Card", "Phone"]),
        "grouped_tokens": f"""WITH RECURSIVE t AS (SELECT *, CASE WHEN substr(tag, 2, 1) = '-' THEN substr(tag, 1, 1) ELSE 'I' END AS prefix, CASE WHEN substr(tag, 2, 1) = '-' THEN substr(tag, 3) ELSE tag END AS name,
  row_number() OVER (PARTITION BY doc_id, page, chunk ORDER BY idx) AS k FROM ({derived.TOKENS}) x),
walk AS (
  SELECT *, 1 AS grp, prefix <> 'S' AS is_open FROM t WHERE k = 1
  UNION ALL
  SELECT t.*, w.grp + CASE WHEN w.is_open AND w.name = t.name AND t.prefix NOT IN ('B', 'S') AND t.idx = w.idx + 1 THEN 0 ELSE 1 END,
    CASE WHEN w.is_open AND w.name = t.name AND t.prefix NOT IN ('B', 'S') AND t.idx = w.idx + 1 THEN t.prefix <> 'E' ELSE t.prefix <> 'S' END
  FROM walk w JOIN t ON t.doc_id = w.doc_id AND t.page = w.page AND t.chunk = w.chunk AND t.k = w.k + 1)
SELECT doc_id, page, chunk, CAST(grp AS INTEGER) AS grp, arg_min(name, idx) AS tag, replace(string_agg(piece, ' ' ORDER BY idx), ' ##', '') AS word, round(avg(score), 9) AS score FROM walk GROUP BY doc_id, page, chunk, grp""",
        "reply_entities": f"""WITH c AS (SELECT doc_id, page, regexp_extract_all(head || tail, '\\{{[^{{}}]*\\}}') AS raw FROM ({derived.REPLIES}) r),
o AS (SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS pos, raw[i] AS j FROM c, unnest(range(1, len(raw) + 1)) t(i)),
v AS (SELECT doc_id, page, pos, CASE WHEN json_valid(j) AND json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.value') = 'VARCHAR' THEN j END AS j FROM o)
SELECT doc_id, page, pos, j ->> '$.type' AS type, trim(j ->> '$.value') AS value FROM v WHERE j IS NOT NULL AND length(trim(j ->> '$.value')) >= 2""",
        "assembled_replies": f"SELECT doc_id, page, CASE WHEN k % 3 = 0 THEN head ELSE head || tail END AS content, CASE WHEN k % 3 <> 0 THEN 'stop' END AS stop_reason, CASE WHEN k % 3 = 0 THEN 'lost' END AS error FROM ({derived.REPLIES}) r",
        "run_flags": f"SELECT doc_id, CAST(1 AS BIGINT) AS pages, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS incomplete, k % 3 = 0 AS failed, k % 6 <> 0 AS model_used, k % 6 = 0 AS fell_back FROM ({derived.REPLIES}) r",
        "repeat_loops": f"WITH {_LOOP} SELECT * FROM loops",
        "deduped_reply": f"""WITH {_LOOP}, b AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.page, s.key ORDER BY s.pos) AS n FROM streaks s LEFT JOIN loops l ON l.doc_id = s.doc_id AND l.page = s.page WHERE l.pos IS NULL OR s.pos <= l.pos)
SELECT doc_id, page, pos, type, value FROM b WHERE n = 1""",
        "reply_reasons": f"""WITH l AS (SELECT *, list(CASE WHEN type = 'Organization' THEN lower(value) END) OVER (PARTITION BY doc_id, page) AS orgs FROM ({derived.LISTED}) x),
n AS (SELECT doc_id, CAST(1 + floor((page - 1) / 500) AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY text) AS text FROM ({derived.NOTES}) y GROUP BY 1, 2)
SELECT l.doc_id, l.page, l.pos, l.type, l.value, CASE WHEN NOT regexp_matches(n.text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || l.value || '(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'not found in page text' WHEN type = 'Miscellaneous' THEN NULL WHEN value = lower(value) THEN 'all lowercase'
  WHEN type = 'Person' AND NOT contains(value, ' ') AND length(value) < 3 THEN 'single-word person too short' WHEN type = 'Person' AND len(list_filter(orgs, lambda o: contains(o, lower(value)))) > 0 THEN 'part of an organization name' END AS reason
FROM l JOIN n ON n.doc_id = l.doc_id AND n.page = l.page""",
        "model_thresholds": f"""WITH t AS (SELECT regexp_replace(tag, '^[A-Z]-', '') AS tag, count(*) AS n FROM ({derived.TOKENS}) x GROUP BY 1)
SELECT tag, n, {_TYPES} AS type, m AS model, CAST(CASE WHEN {_TYPES} = 'Person' THEN CASE m WHEN 'other' THEN 0.7 ELSE 0.5 END WHEN {_TYPES} IN ('Organization', 'Location') THEN CASE m WHEN 'accurate' THEN 0.9 WHEN 'small' THEN 0.75 ELSE 0.85 END ELSE CASE m WHEN 'other' THEN 0.6 ELSE 0.4 END END AS DOUBLE) AS min_score FROM t, unnest(['accurate', 'small', 'other']) x(m)""",
        "decided_entities": f"{r}{_entities(SOURCES)} SELECT doc_id, value_key, length(value) % 3 <> 0 AS approved FROM ents",
        "custom_entities": f"""{r}{_entities(SOURCES)}, {_CUSTOM}, {_located("SELECT * FROM custom WHERE value <> ''", SOURCES)}
SELECT f.doc_id, 'Custom' AS type, f.value, min(f.page) AS page, true AS approved FROM found f WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = f.doc_id AND e.value_key = lower(f.value)) GROUP BY f.doc_id, f.value""",
        "classified_hits": f"""{r}{_entities(SOURCES)}, {_CUSTOM},
hits AS (SELECT doc_id, upper(value) AS value FROM ents WHERE ord % 2 = 1 UNION ALL SELECT * FROM custom WHERE value <> '' UNION ALL SELECT doc_id, 'no such value' FROM custom),
h AS (SELECT doc_id, {_key('value')} AS value_key, min(value) AS value FROM hits GROUP BY 1, 2)
SELECT h.doc_id, h.value_key, h.value, CASE WHEN e.value_key IS NULL THEN 'add' WHEN length(e.value) % 2 = 0 THEN 'skip' ELSE 'approve' END AS action FROM h LEFT JOIN ents e ON e.doc_id = h.doc_id AND e.value_key = h.value_key""",
        "unapplied_changes": f"""{r}{_entities(SOURCES)}, own AS (SELECT doc_id, bool_or(doc_id = 'src3') AS changed FROM ents GROUP BY doc_id),
ids AS (SELECT DISTINCT source AS doc_id FROM documents WHERE source = 'src5' AND lang = 'en')
SELECT coalesce(o.doc_id, i.doc_id) AS doc_id, coalesce(o.changed, false) OR i.doc_id IS NOT NULL AS changed FROM own o FULL OUTER JOIN ids i ON i.doc_id = o.doc_id""",
        "kept_links": "SELECT page_id AS doc_id, url FROM pages WHERE page_id % 2 <> 0 AND regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:')",
        "reviewable_documents": f"""WITH {_INVENTORY} SELECT page_id AS doc_id, page_id IN (SELECT doc_id FROM inventory) OR len(list_filter(regexp_extract_all(html, '{_HREF}', 1), lambda u: regexp_matches(substr(u, 2), '^[a-zA-Z][a-zA-Z0-9+.-]*:'))) > 0 AS reviewable FROM pages""",
        "tagged_entities": f"""{r}{_claims(derived.NOTES, ALL_KINDS)}, w AS (
  SELECT p.doc_id, p.page, regexp_replace(p.value, ', Jr.$| MD$', '') AS v, n.text FROM ({derived.PEOPLE}) p JOIN ({derived.NOTES}) n ON n.doc_id = p.doc_id AND n.page = p.page WHERE (40 + p.ord % 6 * 10) / 100 >= 0.7)
SELECT doc_id, page, 'Person' AS type, v AS value FROM w WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = w.doc_id AND c.page = w.page AND instr(text, v) - 1 < c.e AND instr(text, v) - 1 + length(v) > c.s)""",
        "tagger_only": f"""WITH w AS (SELECT p.doc_id, p.page, regexp_replace(p.value, ', Jr.$| MD$', '') AS v FROM ({derived.PEOPLE}) p WHERE (40 + p.ord % 6 * 10) / 100 >= 0.7),
f AS (SELECT doc_id, arg_min(v, page) AS value, lower(v) AS value_key, min(page) AS page FROM w GROUP BY doc_id, lower(v))
SELECT doc_id, 'Person' AS type, value, value_key, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS ord FROM f""",
        "bounded_image_inventory": f"""WITH sized AS (
  SELECT i.doc_id, i.page, i.idx, greatest(i.x1 - i.x0, i.y1 - i.y0) >= 40 AS big, (i.x1 - i.x0) * (i.y1 - i.y0) >= 0.9 * (coalesce(b.x1, 612.0) * coalesce(b.y1, 792.0)) AS covers, length(replace(p.text, ' ', '')) >= 20 AS text_layer
  FROM ({derived.IMAGES}) i JOIN ({derived.IMAGE_PAGES}) p ON p.doc_id = i.doc_id AND p.page = i.page LEFT JOIN ({derived.BOUNDS}) b ON b.doc_id = i.doc_id AND b.page = i.page)
SELECT doc_id, page, idx, page || ':' || idx AS id, covers AND NOT text_layer AS full_page, big, covers, text_layer FROM (SELECT *, bool_or(covers AND text_layer) OVER (PARTITION BY doc_id, page) AS hid FROM sized) x WHERE big AND NOT hid""",
        "bounded_page_stats": f"""WITH {_BOUNDED} SELECT doc_id, page, char_count, round(image_coverage, 9) AS image_coverage, char_count >= 20 AS has_text, char_count >= 20 AND largest >= 0.9 AS scanned FROM istats""",
        "unlinked_pages": """SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN '<a class="own" href="' || url || '">this page</a>' || html || '<a class="own" href="' || url || '">this page</a>' ELSE 'this page' || html || 'this page' END AS html FROM pages""",
        "instruction_hits": _HITS,
        "merged_hits": f"""{r}{_entities(derived.NOTES)}, h AS (SELECT doc_id, {_key('value')} AS value_key, min(page) AS page FROM ({_HITS}) x GROUP BY 1, 2)
SELECT e.doc_id, e.value_key, e.type, NULL AS source, length(e.value) % 2 = 0 OR h.page IS NOT NULL AS approved FROM ents e LEFT JOIN h ON h.doc_id = e.doc_id AND h.value_key = e.value_key
UNION ALL SELECT doc_id, value_key, 'Custom', 'ai', true FROM h WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = h.doc_id AND e.value_key = h.value_key)""",
        "changed_by_hits": f"""{r}{_entities(derived.NOTES)}, h AS (SELECT DISTINCT doc_id, {_key('value')} AS value_key FROM ({_HITS}) x)
SELECT h.doc_id, count(*) FILTER (WHERE e.value IS NULL OR length(e.value) % 2 = 1) AS changes FROM h LEFT JOIN ents e ON e.doc_id = h.doc_id AND e.value_key = h.value_key GROUP BY h.doc_id""",
        "rerun_notes": f"""{r}{_entities(derived.CARDS)}, shown AS (SELECT * FROM ({derived.CARDS}) c UNION ALL SELECT doc_id, 2, 'scan of a plate' FROM ({derived.CARDS}) c WHERE doc_id % 5 = 1),
vals AS (SELECT doc_id, value FROM ents WHERE type NOT IN ('Person', 'Phone') UNION SELECT doc_id, 'plate' FROM shown UNION SELECT k, person FROM ({derived.NAMES}) n WHERE k % 2 = 0),
{_located('SELECT * FROM vals', 'SELECT * FROM shown')}, {_ISLANDS}, {_redacted('SELECT * FROM shown')} SELECT * FROM redacted""",
        "claimed_values": f"""{r}{_claims(derived.NOTES, ALL_KINDS)}, v AS (SELECT *, CASE page % 3 WHEN 0 THEN '2020' WHEN 1 THEN CAST(89999 + page AS VARCHAR) ELSE '12' END AS value FROM ({derived.NOTES}) n),
o AS (SELECT doc_id, page, value, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(value)) = value)) - 1 AS s FROM v),
f AS (SELECT doc_id, page, value, EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = o.doc_id AND c.page = o.page AND o.s < c.e AND o.s + length(o.value) > c.s) AS ok FROM o)
SELECT v.doc_id, v.page, v.value, coalesce((SELECT bool_and(ok) FROM f WHERE f.doc_id = v.doc_id AND f.page = v.page), false) AS claimed FROM v""",
        "snapped_words": f"SELECT doc_id, page, CASE WHEN k % 4 = 3 THEN 'Nobody Here' ELSE person END AS word FROM ({derived.NAMES}) n",
        "cleaned_people": f"SELECT doc_id, page, CASE WHEN k % 3 = 2 THEN 'Ann Lee' ELSE person END AS value FROM ({derived.NAMES}) n",
        "chat_entities": f"""{r}{_entities(derived.CARDS)}, top AS (SELECT doc_id, max(ord) AS top FROM ents GROUP BY doc_id), n AS (SELECT k AS doc_id, person FROM ({derived.NAMES}) x)
SELECT doc_id, type, value, page, true AS approved, ord FROM ents
UNION ALL SELECT n.doc_id, 'Person', person, 1, true, top + 1 FROM n JOIN top t ON t.doc_id = n.doc_id WHERE n.doc_id % 4 = 3
UNION ALL SELECT n.doc_id, 'Person', split_part(person, ' ', 2), 1, true, top + CASE WHEN n.doc_id % 4 = 3 THEN 2 ELSE 1 END FROM n JOIN top t ON t.doc_id = n.doc_id""",
        "scored_chunks": f"""WITH c AS ({_chunks("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations", 50, 10)}), w AS (SELECT doc_id, page, chunk, string_split(chunk_text, ' ') AS ws FROM c)
SELECT doc_id, page, chunk, CAST(i - 1 AS INTEGER) AS idx, 'B-WORD' AS tag, ws[i] AS piece FROM w, unnest(range(1, len(ws) + 1)) t(i) WHERE regexp_matches(ws[i], '^[A-Z]')""",
        "fallback_entities": f"""{r}{_claims(derived.CARDS, ALL_KINDS)}
SELECT doc_id, type, value FROM claims WHERE type IS NOT NULL AND doc_id % 3 = 0
UNION ALL SELECT doc_id, 'Person', person FROM (SELECT k AS doc_id, person FROM ({derived.NAMES}) n) x WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'Org', c_mktsegment FROM (SELECT c_custkey AS doc_id, c_mktsegment FROM customer) x WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'Id', 'K' || doc_id FROM (SELECT c_custkey AS doc_id FROM customer) x WHERE doc_id % 3 <> 0""",
        "evaluated_rollup": f"""{r}{_EVAL}, typed AS (
  SELECT d.doc_id, d.source, 'Email' AS type, lower(unnest(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+'))) AS v FROM documents d
  UNION ALL SELECT doc_id, source, 'Word', lower(regexp_extract(text, '[A-Za-z]{{2,}}', 0)) FROM documents),
rs AS (
  SELECT t.source, t.type, 1 AS a, CASE WHEN l.value IS NULL THEN 0 ELSE 1 END AS b, 0 AS c, 0 AS d FROM typed t LEFT JOIN (SELECT DISTINCT doc_id, value FROM left_over) l ON l.doc_id = t.doc_id AND l.value = t.v WHERE t.v <> ''
  UNION ALL SELECT s.source, e.type, 0, 0, 1, CASE WHEN NOT EXISTS (SELECT 1 FROM want w WHERE w.doc_id = e.doc_id AND (contains(w.v, e.d) OR contains(e.d, w.v))) THEN 1 ELSE 0 END FROM (SELECT doc_id, value_key AS d, min(type) AS type FROM ents GROUP BY 1, 2) e JOIN documents s ON s.doc_id = e.doc_id),
g AS (SELECT source, type, CAST(grouping_id(source, type) AS INTEGER) AS level, CAST(sum(a) AS BIGINT) AS n_expected, CAST(sum(b) AS BIGINT) AS n_missed, CAST(sum(c) AS BIGINT) AS n_detected, CAST(sum(d) AS BIGINT) AS n_false FROM rs GROUP BY CUBE (source, type))
SELECT *, CASE WHEN n_expected > 0 THEN (n_expected - n_missed) / n_expected ELSE 0.0 END AS catch_rate, CASE WHEN n_detected > 0 THEN n_false / n_detected ELSE 0.0 END AS false_positive_rate FROM g""",
        "model_flags": f"""WITH c AS ({_chunks("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations", 50, 10)})
SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE contains(chunk_text, 'x')) AS failed, CAST(0 AS BIGINT) AS skipped, NOT bool_or(contains(chunk_text, 'x')) AS model_used, bool_or(contains(chunk_text, 'x')) AS fell_back,
  CASE WHEN bool_or(contains(chunk_text, 'x')) THEN 'ValueError: no model for x' END AS error FROM c GROUP BY doc_id""",
        "fallback_conversations": f"""WITH c AS ({_chunks("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations", 50, 10)}), b AS (SELECT doc_id, bool_or(contains(chunk_text, 'x')) AS bad FROM c GROUP BY doc_id),
w AS (SELECT c.doc_id, c.page, c.chunk, unnest(string_split(chunk_text, ' ')) AS value FROM c JOIN b ON b.doc_id = c.doc_id WHERE NOT bad)
SELECT * FROM w WHERE regexp_matches(value, '^[A-Z]')
UNION ALL SELECT c.doc_id, c.page, c.chunk, split_part(chunk_text, ' ', 1) FROM c JOIN b ON b.doc_id = c.doc_id WHERE bad""",
        "evaluated_documents": f"{r}{_EVAL} SELECT * FROM evals",
        "evaluated_corpus": f"""{r}{_EVAL}, t AS (SELECT count(*) AS documents, CAST(sum(n_expected) AS BIGINT) AS n_expected, CAST(sum(n_missed) AS BIGINT) AS n_missed, CAST(sum(n_detected) AS BIGINT) AS n_detected, CAST(sum(n_false) AS BIGINT) AS n_false FROM evals)
SELECT *, (n_expected - n_missed) / n_expected AS catch_rate, CASE WHEN n_detected > 0 THEN n_false / n_detected ELSE 0.0 END AS false_positive_rate FROM t""",
    }
