"""SQL that Spark and DuckDB read alike: inputs derived from the given tables for the operators
that the texts hold no material for."""

_PERSON = "concat(CASE k % 3 WHEN 0 THEN 'Alan' WHEN 1 THEN 'Mary' ELSE 'Ines' END, ' ', CASE k % 5 WHEN 0 THEN 'Stone' WHEN 1 THEN concat('O', chr(39), 'Hara') WHEN 2 THEN 'Vega' WHEN 3 THEN 'Lindqvist' ELSE 'Marsh' END)"
_NOTE = f"""concat(
  CASE k % 4 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'Judge ' WHEN 2 THEN 'Dr ' ELSE 'the ' END, {_PERSON},
  ' was born on ', cast(1 + k % 12 as string), '/', cast(1 + k % 28 as string), '/', cast(1950 + k % 50 as string),
  '. SSN ', lpad(cast(k % 1000 as string), 3, '0'), '-', lpad(cast(k % 100 as string), 2, '0'), '-', lpad(cast((k * 7) % 10000 as string), 4, '0'),
  '; passport no: AB', cast(100000 + k as string), ', visa # V-', cast(5000 + k as string), ', case 1:21-cr-', cast(10000 + k as string), '-ABC',
  ', plate: KX-', cast(700 + k as string), ', badge id ', cast(90000 + k as string), ', agency file 12-2020-', cast(1000000 + k as string), '-QX', '; case file no. ', cast(30000 + k as string), '; serial badge ', cast(4000 + k as string),
  '. IBAN ', CASE k % 3 WHEN 0 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 1 THEN 'DE89 3704 0044 0532 0130 00' ELSE 'GB82 WEST 1234 5698 7654 33' END,
  ', host ', CASE k % 3 WHEN 0 THEN 'fe80::1' WHEN 1 THEN '2001:db8:0:0:0:0:2:1' ELSE '2001:db8::2::1' END,
  ', paid on January ', cast(1 + k % 28 as string), ', 2020, year of birth ', cast(1950 + k % 50 as string), ', call (212) 555-', lpad(cast(k % 10000 as string), 4, '0'), '.')"""

#: (doc_id, page, text): a note for each customer, its nation as the document.
NOTES = f"SELECT cast(c_nationkey as bigint) AS doc_id, cast(k + 1 as int) AS page, {_NOTE} AS text FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"
#: (doc_id, value, ord): a person of each note, some with a suffix or a comma.
PEOPLE = f"SELECT cast(c_nationkey as bigint) AS doc_id, cast(k + 1 as int) AS page, k AS ord, concat({_PERSON}, CASE k % 4 WHEN 0 THEN ', Jr.' WHEN 1 THEN ' MD' ELSE '' END) AS value FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"
#: (doc_id, page, text): the same notes, each a document.
CARDS = f"SELECT cast(k as bigint) AS doc_id, 1 AS page, {_NOTE} AS text FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"
#: (doc_id, page, k, content): what a chat model finds in a note by an instruction: strings, and others.
FOUND = f"""SELECT cast(c_nationkey as bigint) AS doc_id, cast(k + 1 as int) AS page, k, concat('["', {_PERSON}, '", 5, "S", "BADGE  id ', cast(90000 + k as string), '", {{"a": "Alan"}}, "no such thing"]') AS content FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"""
#: (doc_id, page, k, person): names as the notes have them.
NAMES = f"SELECT cast(c_nationkey as bigint) AS doc_id, cast(k + 1 as int) AS page, k, {_PERSON} AS person FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"
#: Tagged tokens: a line item is a token of its order's only page.
TOKENS = """SELECT l_orderkey AS doc_id, 1 AS page, 1 AS chunk, i AS idx,
  CASE WHEN k % 11 = 0 THEN 'PERSON' ELSE concat(CASE k % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'I' END, CASE k % 2 WHEN 0 THEN '-PERSON' ELSE '-LOCATION' END) END AS tag,
  d AS score, CASE k % 3 WHEN 0 THEN concat('##', cast(k as string)) ELSE concat('w', cast(k as string)) END AS piece
  FROM (SELECT l_orderkey, l_linenumber AS i, max(l_partkey) AS k, max(l_discount) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""
#: (doc_id, page, pos, type, value): entities as a chat model lists them, repeats and all.
LISTED = f"""SELECT cast(c_nationkey as bigint) AS doc_id, cast(1 + floor(k / 500) as int) AS page, cast(k as int) AS pos,
  CASE k % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Miscellaneous' ELSE 'Person' END AS type,
  CASE k % 7 WHEN 0 THEN 'SHOUT AND VEGA' WHEN 1 THEN 'lower case' WHEN 2 THEN 'Jo' WHEN 3 THEN 'Vega' ELSE {_PERSON} END AS value
  FROM (SELECT c_nationkey, c_custkey AS k FROM customer) c"""
#: (doc_id, page, content): replies with good, coerced and broken objects.
REPLIES = f"""SELECT cast(k as bigint) AS doc_id, 1 AS page, concat('[{{"type": "Person", "value": " ', {_PERSON}, ' "}}, {{"type": 1, "value": "x1"}}, {{"type": "Org", "value": "', m, '"}}, {{"type": "Org", "value": "y"}}, {{oops}}, {{"type": "Id", "value": "K', cast(k as string), '"') AS head,
  CASE k % 3 WHEN 0 THEN '' ELSE '}}]' END AS tail, k FROM (SELECT c_custkey AS k, c_mktsegment AS m FROM customer) c""".replace("}}]", "}]")
#: Layout lines: a line item stands at (quantity, 100 * tax) on its order's page.
LINES = "SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS ord, max(l_quantity) AS x, round(max(l_tax) * 100) AS y, concat(' part ', cast(max(l_partkey) as string)) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber"
#: Images: a line item is an image; every third page has text.
IMAGES = """SELECT o AS doc_id, p AS page, i AS idx, CASE WHEN q > 45 THEN 0.0 ELSE q END AS x0, 0.0 AS y0, CASE WHEN q > 45 THEN 612.0 ELSE 2 * q + 10 * d END AS x1, CASE WHEN q > 45 THEN 792.0 ELSE q + 1 END AS y1
  FROM (SELECT l_orderkey AS o, 1 + l_linenumber % 2 AS p, l_linenumber AS i, CAST(max(l_quantity) AS DOUBLE) AS q, CAST(max(l_discount) * 10 AS DOUBLE) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""
#: Bounds of every other page.
BOUNDS = "SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, 0.0 AS x0, 0.0 AS y0, 50.0 AS x1, 100.0 AS y1 FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, 1 + l_linenumber % 2"
IMAGE_PAGES = "SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, CASE WHEN l_orderkey % 3 = 0 THEN 'This page has a text layer of its own' ELSE 'few' END AS text FROM lineitem GROUP BY l_orderkey, 1 + l_linenumber % 2"
#: Pages with hidden content in all spellings, by part of the market; what a reader sees is SEEN.
_SEEN = ["concat('<p class=\"a\">Order ', cast(k as string), ' is open</p>')", "concat('<b data-x=\" title=kept \">5 < 6 title=\"kept\"', '</b>')", "concat('<img src=', chr(39), 'a.png', chr(39), '>')", "'<a href=x>end</a>'"]
_UNSEEN = [
    "concat('<form action=x><textarea name=n rows=2>SSN ', cast(k as string), ' <b>bold</b></textarea>')", "concat('<select><option value=1>', m, '</option><option>b</option></select>')", "concat('<BUTTON type=submit>Send ', m, '</BUTTON></form>')",
    "concat('<input value=\"a > b ', m, '\"/>')", "concat('<object data=f.pdf><p>inner ', m, '</p><object>deep</object></object>')", "concat('<embed src=', chr(39), m, '>', chr(39), '>')", "concat('<!-- ', m, ' <p>no</p> -->')",
]
FORMS = f"""SELECT k AS doc_id, concat({_SEEN[0]}, {_UNSEEN[0].replace("<form action=x>", "")}, {_UNSEEN[3]}, {_SEEN[1]}, CASE WHEN k % 2 = 0 THEN concat({_UNSEEN[1]}, {_UNSEEN[4]}) ELSE '' END,
  replace(replace({_SEEN[2]}, '>', concat(' alt=', chr(39), m, chr(39), '>')), '<img ', concat('<img title=', lower(left(m, 3)), ' ')), CASE WHEN k % 3 = 0 THEN concat({_UNSEEN[2].replace("</form>", "")}, {_UNSEEN[5]}, {_UNSEEN[6]}) ELSE '' END, replace({_SEEN[3]}, '<a ', concat('<a TITLE = "', m, '" '))) AS html
  FROM (SELECT cast(c_custkey as bigint) AS k, c_mktsegment AS m FROM customer) c"""
SEEN = f"SELECT k AS doc_id, concat({', '.join(_SEEN)}) AS html, k FROM (SELECT cast(c_custkey as bigint) AS k FROM customer) c"
