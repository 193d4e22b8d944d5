"""Queries over marketplace pages: scopes, evidence, invitations, labels, buy boxes and whole analyses.

The SQL builds its own element table: pages are cut into tags and texts, and a recursive walk keeps the stack of
open elements, so that "inside" is membership of that stack where the queries compare intervals.
"""

from __future__ import annotations

from shelfline.functions import elements as E
from shelfline.functions import purchase as P
from shelfline.operators import pages as G
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _dealt(values) -> str:
    return "[" + ", ".join(map(_lit, values)) + "][page_id % " + str(len(values)) + " + 1]"


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_BLOCK = f"replace(replace(replace(replace(replace({_dealt(A.MARKET_BLOCKS)}, '{{n}}', CAST(page_id AS VARCHAR)), '{{p}}', CAST(page_id % 900 + 100 AS VARCHAR)), '{{t}}', {_TITLE}), '{{a}}', lpad(CAST(page_id AS VARCHAR), 8, '0')), '{{e}}', lpad(CAST(page_id * 10 AS VARCHAR), 13, '4'))"
_WHERE = _dealt(A.DELIVERIES)
_GLOW = f"CASE WHEN {_WHERE} <> '' THEN '<div id=\"nav-global-location-slot\"><span id=\"glow-ingress-line2\">' || {_WHERE} || '</span></div>' ELSE '' END"
_DATA = "CASE WHEN page_id % 2 = 0 THEN '<script type=\"application/ld+json\">{\"@type\":\"Product\"}</script>' ELSE '' END"
S.ADAPTERS["market_pages"] = f"""SELECT page_id, 'https://' || {_dealt(A.MARKET_HOSTS)} || '/dp/B0' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS url,
  replace(replace(html, '<nav>', {_GLOW} || {_DATA} || '<nav>'), '<article>', {_BLOCK} || '<article>') AS html FROM pages"""

_VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr')"


def _attribute(name: str) -> str:
    return f"regexp_extract(tok, '\\s{name}=\"([^\"]*)\"', 1)"


def _plain(text: str) -> str:
    for entity, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"trim(regexp_replace(regexp_replace({text}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


def _fits(step: E.Step, e: str) -> str:
    tests = [f"{e}.tag = {_lit(step.tag)}"] if step.tag else []
    for name, how, value in step.tests:
        held = f'{e}."{name}"'
        if how == ".":
            tests.append(f"list_contains(string_split({held}, ' '), {_lit(value)})")
        else:
            tests.append(f"contains({held}, {_lit(value)})" if how == "*=" else f"{held} = {_lit(value)}")
    return " AND ".join(tests)


def _hits(name: str, source: str, selectors) -> str:
    """A CTE with (page_id, k, selector, n, anc) of every element of `source` that a selector finds."""
    each = []
    for k, s in enumerate(selectors):
        *above, own = E.steps(s)
        where = _fits(own, "e")
        if above:
            where += f" AND EXISTS (SELECT 1 FROM {source} a WHERE a.page_id = e.page_id AND list_contains(e.anc, a.n) AND {_fits(above[0], 'a')})"
        each.append(f"SELECT e.page_id, {k} AS k, {_lit(s)} AS selector, e.n, e.anc FROM {source} e WHERE {where}")
    return f"{name} AS ({' UNION ALL '.join(each)})"


_IS_NOISE = " OR ".join(f"({_fits(E.steps(s)[0], 'e')})" for s in G.NOISE)
#: The walk is called walk_rec, which makes the WITH a recursive one.
TABLES = f"""tokens AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS t FROM market_pages),
walk_rec(page_id, i, n, said, ns, tags, kind, tok, tag) AS (
  SELECT page_id, 0, 0, 0, CAST([] AS INT[]), CAST([] AS VARCHAR[]), '', '', '' FROM tokens
  UNION ALL
  SELECT page_id, i + 1, CASE WHEN kind IN ('open', 'raw') THEN n + 1 ELSE n END, CASE WHEN kind = 'text' AND {_plain("tok")} <> '' THEN said + 1 ELSE said END,
    CASE WHEN kind = 'open' AND tag NOT IN {_VOID} THEN list_append(ns[1:left_open], n + 1) ELSE ns[1:left_open] END,
    CASE WHEN kind = 'open' AND tag NOT IN {_VOID} THEN list_append(tags[1:left_open], tag) ELSE tags[1:left_open] END, kind, tok, tag
  FROM (SELECT *, CASE WHEN kind = 'open' AND tag = 'li' THEN coalesce(list_min(list_filter(range(1, len(tags) + 1), lambda j: tags[j] = 'li' AND j > coalesce(list_max(list_filter(range(1, len(tags) + 1), lambda b: tags[b] IN ('ul', 'ol'))), 0))) - 1, len(tags))
      WHEN kind = 'close' THEN coalesce(list_max(list_filter(range(1, len(tags) + 1), lambda j: tags[j] = tag)) - 1, len(tags)) ELSE len(tags) END AS left_open
    FROM (SELECT w.page_id, w.i, w.n, w.said, w.ns, w.tags, x.t[w.i + 1] AS tok, lower(regexp_extract(x.t[w.i + 1], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
        CASE WHEN NOT starts_with(x.t[w.i + 1], '<') THEN 'text' WHEN starts_with(x.t[w.i + 1], '<!') THEN 'none' WHEN starts_with(x.t[w.i + 1], '</') THEN 'close'
          WHEN regexp_matches(x.t[w.i + 1], '^<(script|style)') THEN 'raw' ELSE 'open' END AS kind
      FROM walk_rec w JOIN tokens x ON x.page_id = w.page_id AND w.i < len(x.t)))),
elements AS (
  SELECT page_id, n, tag, CASE WHEN kind = 'open' AND tag NOT IN {_VOID} THEN ns[1:len(ns) - 1] ELSE ns END AS anc, {", ".join(f'{_attribute(a)} AS "{a}"' for a in E.ATTRIBUTES)}
  FROM walk_rec WHERE kind IN ('open', 'raw')),
texts AS (SELECT page_id, said - 1 AS at_text, {_plain("tok")} AS said, lower(strip_accents({_plain("tok")})) AS folded, ns AS holders FROM walk_rec WHERE kind = 'text' AND {_plain("tok")} <> ''),
noise AS (SELECT page_id, n, tag, anc, id, class FROM elements e WHERE {_IS_NOISE}),
alive AS (SELECT e.* FROM elements e WHERE NOT EXISTS (SELECT 1 FROM noise z WHERE z.page_id = e.page_id AND (z.n = e.n OR list_contains(e.anc, z.n)))),
kept_texts AS (SELECT t.* FROM texts t WHERE NOT EXISTS (SELECT 1 FROM noise z WHERE z.page_id = t.page_id AND list_contains(t.holders, z.n)))"""


def _described(e: str) -> str:
    classes = f"list_filter(string_split({e}.class, ' '), lambda c: c <> '')"
    return f"CASE WHEN {e}.id <> '' THEN {e}.tag || '#' || {e}.id ELSE array_to_string(list_concat([{e}.tag], {classes}[1:2]), '.') END"


PLACED = f"""placed AS (SELECT e.page_id, e.n, CASE WHEN e.id <> '' OR a.n IS NULL THEN {_described('e')} ELSE {_described('a')} || ' > ' || {_described('e')} END AS place
  FROM elements e LEFT JOIN elements a ON a.page_id = e.page_id AND list_contains(e.anc, a.n) AND (a.id <> '' OR a.class <> '')
  QUALIFY row_number() OVER (PARTITION BY e.page_id, e.n ORDER BY a.n DESC NULLS LAST) = 1)"""
DECISIVE = [*G.BUY, *G.STOCK, *G.PRICE]
_LABEL_OF = "[" + ", ".join(_lit(label) for label, _ in G.SCOPES) + "]"
SCOPED = f"""{_hits('met', 'alive', [s for _, s in G.SCOPES])},
{_hits('decisive', 'alive', DECISIVE)},
cand AS (SELECT m.page_id, row_number() OVER (PARTITION BY m.page_id ORDER BY m.k, m.n) - 1 AS place, {_LABEL_OF}[m.k + 1] AS label, m.selector, m.n,
  coalesce((SELECT string_agg(selector, ', ' ORDER BY k) FROM (SELECT DISTINCT k, selector FROM decisive d WHERE d.page_id = m.page_id AND list_contains(d.anc, m.n))), '') AS material FROM met m),
taken AS (SELECT page_id, min(place) AS place FROM cand WHERE material <> '' GROUP BY page_id),
scoped AS (SELECT p.page_id, c.n, coalesce(c.label, {_lit(G.WHOLE)}) AS label FROM market_pages p LEFT JOIN taken t ON t.page_id = p.page_id LEFT JOIN cand c ON c.page_id = p.page_id AND c.place = t.place)"""


def _sql(ctes: str, select: str) -> tuple[str, str]:
    return with_ctes("market_pages", ctes, select)


_SCOPE_SQL = f"""SELECT c.page_id, CAST(c.place AS INTEGER) AS place, c.label, c.selector, {_described('e')} AS identifier, c.material, coalesce(c.place = t.place, false) AS retained,
  CASE WHEN c.place = t.place THEN {_lit(G.HELD)} || c.material WHEN c.material <> '' THEN {_lit(G.TAKEN)} ELSE {_lit(G.NOTHING)} END AS reason
FROM cand c JOIN alive e ON e.page_id = c.page_id AND e.n = c.n LEFT JOIN taken t ON t.page_id = c.page_id
UNION ALL SELECT p.page_id, CAST((SELECT count(*) FROM cand c WHERE c.page_id = p.page_id) AS INTEGER), {_lit(G.WHOLE)}, 'html', 'html', '', true, {_lit(G.FALLBACK)}
FROM market_pages p WHERE p.page_id NOT IN (SELECT page_id FROM taken)"""


@query(*_sql(f"{TABLES},\n{SCOPED}", _SCOPE_SQL))
def page_scopes(spark, d):
    return G.scope_trace(A.market_pages(spark, d), "page_id")


MENTIONED = tuple(dict.fromkeys((*P.INVITATION, *P.PREORDER, *P.ADD_TO_CART, *P.BUY_NOW, *P.NOTIFY_ME, *P.OUT_OF_STOCK, *P.UNAVAILABLE, *P.COMING_SOON)))
_WORDS = f"unnest([{', '.join(map(_lit, MENTIONED))}])"
_TEXT_OF = "(SELECT string_agg(x.said, ' ' ORDER BY x.at_text) FROM {t} x WHERE x.page_id = {e}.page_id AND list_contains(x.holders, {e}.n))"


@query(*_sql(f"{TABLES},\n{PLACED}", f"""SELECT t.page_id, CAST(t.at_text AS INTEGER) AS "at", w.marker, p.place AS carrier, substr({_TEXT_OF.format(t="kept_texts", e="p")}, 1, 120) AS excerpt
FROM kept_texts t JOIN (SELECT {_WORDS} AS marker) w ON contains(t.folded, w.marker) JOIN placed p ON p.page_id = t.page_id AND p.n = t.holders[-1]"""))
def mention_carriers(spark, d):
    return G.mentions(A.market_pages(spark, d), "page_id", MENTIONED)


_INVITES = f"(SELECT unnest([{', '.join(map(_lit, P.INVITATION))}]) AS marker)"
MARKS = f"""{PLACED},
marks AS (SELECT DISTINCT e.page_id, e.n, e.anc, w.marker FROM elements e JOIN {_INVITES} w ON contains(lower(strip_accents(e."aria-label")), w.marker) OR (e.tag = 'input' AND contains(lower(strip_accents(e.value)), w.marker))
    OR EXISTS (SELECT 1 FROM texts t WHERE t.page_id = e.page_id AND t.holders[-1] = e.n AND contains(t.folded, w.marker))),
fates AS (SELECT m.page_id, m.n, p.place, m.marker, CASE WHEN z.n IS NOT NULL THEN 'noise' WHEN s.n IS NULL OR list_contains(m.anc, s.n) THEN 'scope' ELSE 'outside' END AS fate,
    coalesce({_described('z')}, '') AS lost_with
  FROM marks m JOIN placed p ON p.page_id = m.page_id AND p.n = m.n JOIN scoped s ON s.page_id = m.page_id
  LEFT JOIN noise z ON z.page_id = m.page_id AND (z.n = m.n OR list_contains(m.anc, z.n))
  QUALIFY row_number() OVER (PARTITION BY m.page_id, m.n, m.marker ORDER BY z.n) = 1)"""


@query(*_sql(f"{TABLES},\n{SCOPED},\n{MARKS}", "SELECT page_id, n, place, marker, fate, lost_with FROM fates"))
def invitation_marks(spark, d):
    return G.invitation_marks(A.market_pages(spark, d), "page_id")


_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_READABLE = "(length(text) BETWEEN 2 AND 60 AND NOT regexp_matches(text, '^[A-Za-z0-9+/=_-]{16,}$') AND NOT regexp_matches(text, '^[0-9a-fA-F]{12,}$') AND regexp_matches(text, '[A-Za-zÀ-ÿ]') AND regexp_matches(lower(text), '[aeiouyàâäéèêëîïôöùûü]'))"


def _offered(limit: str = "") -> str:
    """CTEs of what a scope offers; the SQL of buy_boxes, which reads no labels, is left with the limit that it had on them."""
    return f"""ours AS (SELECT e.* FROM alive e JOIN scoped s ON s.page_id = e.page_id WHERE s.n IS NULL OR list_contains(e.anc, s.n)),
own_text AS (SELECT o.page_id, o.n, coalesce({_TEXT_OF.format(t="kept_texts", e="o")}, '') AS text FROM alive o),
stock_at AS (SELECT d.page_id, d.k, d.selector, d.n, t.text FROM decisive d JOIN ours o ON o.page_id = d.page_id AND o.n = d.n JOIN own_text t ON t.page_id = d.page_id AND t.n = d.n
  WHERE d.k BETWEEN {len(G.BUY)} AND {len(G.BUY) + len(G.STOCK) - 1} AND t.text <> ''),
buys AS (SELECT d.page_id, d.k, d.selector, d.n FROM decisive d JOIN ours o ON o.page_id = d.page_id AND o.n = d.n WHERE d.k < {len(G.BUY)}
  QUALIFY row_number() OVER (PARTITION BY d.page_id, d.k ORDER BY d.n) = 1),
controls AS (SELECT o.*, t.text, row_number() OVER (PARTITION BY o.page_id, o.tag = 'input' ORDER BY o.n) AS place FROM ours o JOIN own_text t ON t.page_id = o.page_id AND t.n = o.n WHERE o.tag IN ('a', 'button', 'input')),
said_labels AS (
  SELECT b.page_id, 1 AS part, b.k AS a, 0 AS b, coalesce(nullif(o.value, ''), nullif(o."aria-label", ''), t.text) AS text, b.selector FROM buys b JOIN ours o ON o.page_id = b.page_id AND o.n = b.n JOIN own_text t ON t.page_id = b.page_id AND t.n = b.n
  UNION ALL SELECT page_id, CASE WHEN c.tag = 'input' THEN 3 ELSE 2 END, c.n, x.b, x.text, {_described('c')} FROM controls c,
    LATERAL (SELECT unnest([0, 1]) AS b, unnest(CASE WHEN c.tag = 'input' THEN [c.value, c."aria-label"] ELSE [c."aria-label", c.text] END) AS text) x WHERE {limit}(c.tag <> 'input' OR lower(c.type) IN ('submit', 'button'))
  UNION ALL SELECT page_id, 4, k, n, text, selector FROM stock_at)"""


@query(*_sql(f"{TABLES},\n{SCOPED},\n{_offered()}", f"""SELECT page_id, kept, CAST(place - 1 AS INTEGER) AS place, text, selector FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, kept ORDER BY part, a, b) AS place FROM (
    SELECT *, {_READABLE} AS kept FROM (SELECT page_id, part, a, b, {_CLEAN.format('text')} AS text, selector FROM said_labels) WHERE text <> ''
    QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY part, a, b) = 1))"""))
def page_labels(spark, d):
    return G.action_labels(A.market_pages(spark, d), "page_id")


_SELLER_STOP = "'(?i)\\s{2,}|[|•/]|Expédié par|Expéditeur|Vendu par|Vendeur|Ships from|Sold by|Dispatched from|Livré par'"


def _after(words: tuple[str, ...]) -> str:
    said = []
    for w in words:
        tail = f"regexp_replace(regexp_extract(merchant, '(?is){w.replace('e', '[eé]')}(.*)$', 1), '^[ :•|\\n\\t-]+', '')"
        parts = f"list_filter(regexp_split_to_array(regexp_split_to_array({tail}, {_SELLER_STOP})[1], '\\s+'), lambda x: x <> '')"
        said.append(f"nullif(substr(array_to_string(list_filter({parts}, lambda x, i: i = 1 OR lower(x) <> lower({parts}[i - 1])), ' '), 1, 80), '')")
    return f"coalesce({', '.join(said)})"


def _first(name: str, scope: bool) -> str:
    """The first text, else value, that the selectors of hits `name` find, in order of selectors."""
    where = f"{name} h JOIN alive o ON o.page_id = h.page_id AND o.n = h.n JOIN own_text t ON t.page_id = h.page_id AND t.n = h.n" + (" JOIN ours u ON u.page_id = h.page_id AND u.n = h.n" if scope else "")
    said = f"coalesce(nullif(t.text, ''), {_CLEAN.format('o.value')})"
    return f"(SELECT page_id, arg_min(text, k) AS text FROM (SELECT h.page_id, h.k, {said} AS text FROM {where} QUALIFY row_number() OVER (PARTITION BY h.page_id, h.k ORDER BY h.n) = 1) WHERE text <> '' GROUP BY page_id)"


_BOX = f"""{_hits('price_at', 'alive', G.PRICE)},
{_hits('title_at', 'alive', G.TITLE)},
{_hits('merchant_at', 'alive', G.MERCHANT)},
{_hits('variation_at', 'alive', G.VARIATION)},
merchants AS (SELECT page_id, coalesce(string_agg(text, ' ' ORDER BY k, n) FILTER (mine), string_agg(text, ' ' ORDER BY k, n)) AS merchant FROM (
  SELECT h.page_id, h.k, h.n, t.text, u.n IS NOT NULL AS mine FROM merchant_at h JOIN own_text t ON t.page_id = h.page_id AND t.n = h.n LEFT JOIN ours u ON u.page_id = h.page_id AND u.n = h.n WHERE t.text <> '') GROUP BY page_id),
editions AS (SELECT page_id, arg_min(v, n) AS edition FROM (SELECT o.page_id, o.n, trim(regexp_extract(t.text, '[:‎](.*)$', 1)) AS v FROM alive o JOIN own_text t ON t.page_id = o.page_id AND t.n = o.n
  WHERE o.tag IN ('tr', 'li') AND regexp_matches(lower(strip_accents(t.text)), '^({"|".join(G.EDITION)})')) WHERE v <> '' GROUP BY page_id)"""
_BOX_SQL = f"""SELECT s.page_id, s.label AS scope_label, CASE WHEN regexp_matches(price, '\\d{{1,4}}([ ]?\\d{{3}})*[.,]\\d{{2}}') THEN replace(replace(regexp_extract(price, '\\d{{1,4}}(?:[ ]?\\d{{3}})*[.,]\\d{{2}}'), ' ', ''), '.', ',') || ' €' END AS price,
  CASE WHEN contains(price, '€') THEN 'EUR' WHEN contains(price, '$') THEN 'USD' WHEN contains(price, '£') THEN 'GBP' END AS currency, b.selector AS buy_selector,
  {_after(G.SOLD_BY)} AS seller, {_after(G.SHIPPED_BY)} AS shipped_by, substr(n.note, 1, 120) AS stock_note, substr(v.text, 1, 80) AS variation, substr(e.edition, 1, 80) AS edition, t.text AS page_title
FROM scoped s LEFT JOIN (SELECT coalesce(a.page_id, z.page_id) AS page_id, coalesce(a.text, z.text) AS price FROM {_first('price_at', True)} a FULL JOIN {_first('price_at', False)} z ON z.page_id = a.page_id) p ON p.page_id = s.page_id
LEFT JOIN (SELECT page_id, arg_min(selector, k) AS selector FROM buys GROUP BY page_id) b ON b.page_id = s.page_id
LEFT JOIN merchants m ON m.page_id = s.page_id LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY k, n) AS note FROM stock_at GROUP BY page_id) n ON n.page_id = s.page_id
LEFT JOIN {_first('variation_at', False)} v ON v.page_id = s.page_id LEFT JOIN editions e ON e.page_id = s.page_id LEFT JOIN {_first('title_at', False)} t ON t.page_id = s.page_id"""


@query(*_sql(f"{TABLES},\n{SCOPED},\n{_offered('c.place <= 200 AND ')},\n{_BOX}", _BOX_SQL))
def buy_boxes(spark, d):
    return G.buy_boxes(A.market_pages(spark, d), "page_id")


@query()
def invitation_probes(spark, d):
    return G.invitation_probes(A.market_pages(spark, d), "page_id")


@query()
def page_analyses(spark, d):
    return G.analysed(A.market_pages(spark, d), "page_id")
