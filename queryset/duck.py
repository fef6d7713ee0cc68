"""SQL building blocks of the oracle: the same operators, written for DuckDB.

``CTES`` are named sub-queries; :func:`sql` puts those a query needs in front of it.
"""

from __future__ import annotations

import itertools
import re

from pagescout import settings as S
from queryset import corpus as C

_names = (f"v{i}" for i in itertools.count())


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, body) -> str:
    name = next(_names)
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def words(items: list[str]) -> str:
    return lit("|".join(items))


# --- URLs -------------------------------------------------------------------------------

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
SHAPE = rf"(?s)^(?:({SCHEME}):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
BAD_ESCAPE = r"%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
GOOD_AUTHORITY = (
    r"^(?://(?:.*@)?(?:\[[^\[\]@]*\]|[A-Za-z0-9\-_.~!$&'()*+,;=<>\"\x{80}-\x{10FFFF}]*)(?::[0-9]*)?)?$"
)
PLAIN = r"^[A-Za-z0-9\-_.~$&+,/:;=@]*$"
ENCODED = r"^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]]|%[0-9A-Fa-f]{2})*$"


def parts(url: str) -> str:
    return f"regexp_extract({url}, {lit(SHAPE)}, ['scheme', 'authority', 'path', 'query', 'fragment'])"


def host_of(p: str) -> str:
    return f"lower(url_decode(regexp_replace(substr({p}.authority, 3), '^.*@', '')))"


def opaque(p: str) -> str:
    return f"({p}.scheme <> '' AND {p}.authority = '' AND {p}.path <> '' AND NOT starts_with({p}.path, '/'))"


def valid(url: str, p: str) -> str:
    return (
        rf"(NOT regexp_matches({url}, '[\x00-\x1f\x7f]')"
        f" AND ({opaque(p)} OR NOT regexp_matches({p}.path, {lit(BAD_ESCAPE)}))"
        f" AND NOT regexp_matches({p}.fragment, {lit(BAD_ESCAPE)})"
        f" AND regexp_matches({p}.authority, {lit(GOOD_AUTHORITY)})"
        f" AND NOT ({p}.scheme = '' AND {p}.authority = '' AND regexp_matches({p}.path, '^[^/]*:')))"
    )


def is_valid(url: str) -> str:
    return let(parts(url), lambda p: valid(url, p))


def url_host(url: str) -> str:
    return let(parts(url), lambda p: f"CASE WHEN {valid(url, p)} THEN {host_of(p)} END")


def encode(text: str) -> str:
    out = f"url_encode({text})"
    for char in "$&+,/:;=@":
        out = f"replace({out}, '%{ord(char):02X}', '{char}')"
    return out


def encode_path(path: str) -> str:
    return f"CASE WHEN regexp_matches({path}, {lit(PLAIN)}) THEN {path} ELSE {encode(path)} END"


def escape_path(path: str) -> str:
    return (
        f"CASE WHEN regexp_matches({path}, {lit(ENCODED)}) THEN {path} "
        f"ELSE {let(f'url_decode({path})', encode_path)} END"
    )


def fold(path: str) -> str:
    kept = (
        f"list_reduce(list_transform(list_filter(string_split({path}, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s]), "
        "lambda acc, x: CASE WHEN x[1] <> '..' THEN list_concat(acc, x) "
        "WHEN len(acc) > 0 AND acc[len(acc)] <> '..' THEN acc[1:len(acc) - 1] "
        f"WHEN starts_with({path}, '/') THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"
    )
    return let(
        f"array_to_string({kept}, '/')",
        lambda t: f"CASE WHEN starts_with({path}, '/') AND {t} <> '' THEN '/' || {t} ELSE {t} END",
    )


def clean_path(path: str) -> str:
    def cleaned(d: str) -> str:
        return let(
            f"replace({fold(d)}, chr(92), '/')",
            lambda c: f"CASE WHEN {c} = {d} AND regexp_matches({path}, {lit(ENCODED)}) THEN {path} "
            f"ELSE {encode_path(c)} END",
        )

    return let(f"url_decode({path})", cleaned)


def params(query: str) -> str:
    pieces = f"string_split(regexp_replace({query}, '^[?]', ''), '&')"
    kept = (
        f"list_filter({pieces}, lambda s: s <> '' AND NOT contains(s, ';') AND NOT regexp_matches(s, {lit(BAD_ESCAPE)})"
        f" AND NOT regexp_matches(split_part(s, '=', 1), {lit(BAD_ESCAPE)}))"
    )
    return (
        f"list_transform({kept}, lambda s, i: {{'k': url_decode(replace(split_part(s, '=', 1), '+', ' ')), 'pos': i, "
        "'v': url_decode(replace(regexp_replace(s, '^[^=]*=?', ''), '+', ' '))})"
    )


def sorted_query(query: str) -> str:
    pair = "replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')"
    text = f"array_to_string(list_transform(list_sort({params(query)}), lambda x: {pair}), '&')"
    return (
        f"CASE WHEN {query} IN ('', '?') THEN '' ELSE "
        + let(text, lambda t: f"CASE WHEN {t} = '' THEN '' ELSE '?' || {t} END")
        + " END"
    )


def authority_text(p: str) -> str:
    host = let(
        host_of(p),
        lambda h: rf"CASE WHEN regexp_matches({h}, '[^\x00-\x7f]') THEN {encode(h)} ELSE {h} END",
    )
    return (
        f"CASE WHEN {p}.authority = '' THEN '' ELSE '//' || regexp_extract({p}.authority, '^//(.*@)', 1) || {host} END"
    )


def normal(url: str) -> str:
    def text(p: str) -> str:
        return (
            f"CASE WHEN NOT {valid(url, p)} THEN lower({url}) ELSE concat("
            f"CASE WHEN {p}.scheme = '' THEN '' ELSE lower({p}.scheme) || ':' END, {authority_text(p)}, "
            f"CASE WHEN {opaque(p)} THEN {p}.path ELSE {clean_path(f'{p}.path')} END, {sorted_query(f'{p}.query')}) END"
        )

    return f"CASE WHEN {url} IS NOT NULL THEN {let(parts(url), text)} END"


def normal_no_query(url: str) -> str:
    def text(p: str) -> str:
        return (
            f"CASE WHEN NOT {valid(url, p)} THEN lower({url}) ELSE concat("
            f"CASE WHEN {p}.scheme = '' THEN 'https' ELSE lower({p}.scheme) END, ':', "
            f"CASE WHEN {p}.scheme = '' AND {p}.authority = '' AND {p}.path <> '' THEN '//' ELSE {authority_text(p)} END, "
            f"CASE WHEN {opaque(p)} THEN {p}.path ELSE {escape_path(f'{p}.path')} END) END"
        )

    return let(parts(url), text)


def product_url(url: str) -> str:
    return f"regexp_matches(lower({url}), {words(S.PRODUCT_URL_PATTERNS)})"


def product_param(url: str) -> str:
    test = f"lambda x: regexp_matches(lower(x.k), {words(S.PRODUCT_PARAM_WORDS)})"
    return let(
        parts(url),
        lambda p: f"({valid(url, p)} AND len(list_filter({params(f'{p}.query')}, {test})) > 0)",
    )


def product_sitemap(url: str) -> str:
    return f"regexp_matches(lower({url}), {words(S.PRODUCT_SITEMAP_WORDS)})"


SPACES = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def dots(path: str) -> str:
    kept = (
        f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda s: [s]), lambda acc, x: "
        "CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, "
        "CAST([] AS VARCHAR[]))"
    )
    tail = rf"CASE WHEN regexp_matches({path}, '/[.][.]?$') AND len(kept) > 0 THEN '/' ELSE '' END"
    folded = let(kept, lambda k: f"'/' || array_to_string({k}, '/') || {tail.replace('kept', k)}")
    return f"CASE WHEN starts_with({path}, '/') AND contains({path}, '/.') THEN {folded} ELSE {path} END"


def literals(values) -> str:
    return ", ".join(lit(v) for v in values)


def starts(text: str, prefixes) -> str:
    return " OR ".join(f"starts_with({text}, {lit(p)})" for p in prefixes)


def judged(source: str, base: str, href: str, keep: str) -> str:
    """SELECT with ``abs_url``, ``reject_reason`` and ``dst`` of a link on a page."""
    elsewhere = "(r.scheme <> '' OR length(r.authority) > 2)"
    prefix, scheme = starts("h", S.INVALID_LINK_PREFIXES), starts("h", S.NON_HTTP_PREFIXES)
    assets, schemes = literals(S.ASSET_EXTENSIONS), literals(S.HTTP_SCHEMES)
    merged = (
        f"CASE WHEN {elsewhere} OR starts_with(r.path, '/') THEN r.path WHEN r.path = '' THEN b.path "
        "ELSE CASE WHEN regexp_extract(b.path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(b.path, '^(.*/)', 1) END || r.path END"
    )
    return f"""
    SELECT *, {normal("target")} AS dst FROM (
      SELECT *, CASE WHEN reject_reason IS NULL THEN abs_url END AS target FROM (
        SELECT *, CASE WHEN h IN ('', '#') OR {prefix} THEN 'invalid_link' WHEN {scheme} THEN 'invalid_scheme'
          WHEN abs_url IS NULL THEN 'unparsable_link' WHEN a_scheme NOT IN ({schemes}) THEN 'invalid_scheme'
          WHEN a_host <> b_host THEN 'external_domain'
          WHEN lower(regexp_extract(url_decode(a_path), '([.][^./]*)$', 1)) IN ({assets}) THEN 'non_html_resource'
          END AS reject_reason
        FROM (SELECT *, CASE WHEN ok THEN concat(CASE WHEN a_scheme = '' THEN '' ELSE a_scheme || ':' END, a_authority,
                {escape_path("a_path")}, CASE WHEN a_query = '?' THEN '' ELSE a_query END) END AS abs_url
          FROM (SELECT *, {dots("merged")} AS a_path
            FROM (SELECT *, {valid("h", "r")} AND {valid("base", "b")} AS ok, {host_of("b")} AS b_host,
                CASE WHEN r.scheme = '' THEN lower(b.scheme) ELSE lower(r.scheme) END AS a_scheme,
                CASE WHEN {elsewhere} THEN {host_of("r")} ELSE {host_of("b")} END AS a_host,
                CASE WHEN {elsewhere} THEN r.authority ELSE b.authority END AS a_authority,
                CASE WHEN NOT {elsewhere} AND r.path = '' AND r.query = '' THEN b.query ELSE r.query END AS a_query,
                {merged} AS merged
              FROM (SELECT *, {parts("h")} AS r, {parts("base")} AS b
                FROM (SELECT {keep}, {base} AS base, trim({href}, {SPACES}) AS h FROM {source})))))))"""


# --- HTML -------------------------------------------------------------------------------

REST = r"""[^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*>"""
CLEAN = "(?is)<!--.*?-->|" + "|".join(
    rf"(<{n}(?:\s[^>]*)?>).*?</{n}\s*>" for n in ("script", "style", "title")
)
CLASSES = "|".join(S.BREADCRUMB_CLASSES)
CRUMB = rf"""<(div|ol|nav)\s[^>]*class=(?:"(?:[^"]* )?(?:{CLASSES})(?: [^"]*)?"|'(?:[^']* )?(?:{CLASSES})(?: [^']*)?'|(?:{CLASSES})[\s>])"""


def attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)[\s/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    return entities(f"trim(regexp_extract({tag}, {lit(pattern)}, 1), chr(34) || chr(39))")


def entities(text: str) -> str:
    """The references that the derived pages use, in one pass over what follows each ``&``."""
    known = {"lt;": 60, "gt;": 62, "quot;": 34, "nbsp;": 160, "amp;": 38, "eacute;": 233, "#38;": 38, "#150;": 8211, "copy": 169}
    cases = " ".join(f"WHEN starts_with(s, '{n}') THEN chr({c}) || substr(s, {len(n) + 1})" for n, c in known.items())
    rest = f"list_transform(string_split({text}, '&')[2:], lambda s: CASE {cases} ELSE '&' || s END)"
    return f"(string_split({text}, '&')[1] || array_to_string({rest}, ''))"


def bare(text: str) -> str:
    return entities(f"regexp_replace({text}, {lit('(?s)</?[a-zA-Z]' + REST)}, '', 'g')")


def tags_named(name: str) -> str:
    return rf"list_filter(tags, lambda t: regexp_matches(t, '(?i)^<{name}[\s/>]'))"


def crumb_text() -> str:
    """Text of the first breadcrumb element, up to its balanced close tag."""
    opened = f"regexp_extract(html, {lit('(?is)' + CRUMB + '.*$')}, 0)"

    def balanced(rest: str) -> str:
        name = f"regexp_extract({rest}, '^<([a-z]+)', 1)"
        pieces = rf"list_filter(string_split(regexp_replace({rest}, '(</?' || {name} || '[\s>])', chr(1) || '\1', 'g'), chr(1)), lambda s: s <> '')"
        rows = (
            f"list_transform({pieces}, lambda s: {{'d': CASE WHEN starts_with(s, '</') THEN -1 ELSE 1 END, 'done': FALSE, 't': s}})"
        )
        step = (
            "lambda acc, x: CASE WHEN acc.done THEN acc WHEN acc.d + x.d <= 0 THEN {'d': 0, 'done': TRUE, 't': acc.t} "
            "ELSE {'d': acc.d + x.d, 'done': FALSE, 't': acc.t || x.t} END"
        )
        return f"list_reduce({rows}, {step}).t"

    return let(opened, lambda r: f"CASE WHEN {r} = '' THEN '' ELSE {bare(balanced(r))} END")


def signal_columns() -> dict[str, str]:
    metas = tags_named("meta")
    og = f"list_filter({metas}, lambda t: {attr('t', 'property')} = 'og:type')[1]"
    phrases = words(S.PRODUCT_PHRASES)

    def blocks(name: str) -> str:
        return f"regexp_extract_all(marked, {lit(f'(?is)<{name}[ />].*?</{name}>')}, 0)"

    ld = r"""(?is)<script type="application/ld\+json">(.*?)</script>"""
    return {
        "sig_url_pattern": product_url("url_key"),
        "sig_meta": f"(coalesce(lower({attr(og, 'content')}) = 'product', FALSE) OR len(list_filter({metas}, lambda t: "
        f"contains(lower({attr('t', 'name')}), 'product') OR contains(lower({attr('t', 'property')}), 'product'))) > 0)",
        "sig_breadcrumb": f"regexp_matches(lower({crumb_text()}), {words(S.BREADCRUMB_WORDS)})",
        "sig_query_param": product_param("url_key"),
        "sig_anchor_text": f"(len(list_filter(list_concat({blocks('a')}, {blocks('button')}), lambda s: "
        f"regexp_matches(lower({bare('s')}), {phrases}))) > 0)",
        "sig_structured_data": f"(len(list_filter(regexp_extract_all(html, {lit(ld)}, 1), lambda s: "
        rf"""contains(lower(regexp_replace(s, '\s', '', 'g')), '"@type":"product"'))) > 0)""",
        "sig_canonical": f"coalesce({product_url('canonical')}, FALSE)",
        "sig_anchor_density": f"anchor_density > {S.DENSE_ANCHOR_SHARE}",
    }


_SCORE = " + ".join(f"CASE WHEN sig_{n} THEN {w} ELSE 0 END" for n, w in S.SIGNAL_WEIGHTS.items())
_CANONICAL = f"list_filter({tags_named('link')}, lambda t: {attr('t', 'rel')} = 'canonical')[1]"
_FRAME = r"len(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<(html|head|body)[\s/>]')))"
_HREFS = (
    rf"list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?is)^<a[\s/].*[\s/]href[\s/>=]') OR "
    rf"regexp_matches(t, '(?is)^<a\s+href=')), lambda t: {attr('t', 'href')})"
)

# --- robots -----------------------------------------------------------------------------

_PATTERN = (
    r"'^' || replace(regexp_replace(regexp_replace(path, '[$]$', ''), '([.+?^$|()\[\]{}\\])', '\\\1', 'g'), '*', '.*')"
    " || CASE WHEN path LIKE '%$' THEN '$' ELSE '' END"
)


def target_of(url: str) -> str:
    return let(
        parts(url),
        lambda p: f"CASE WHEN {p}.path = '' THEN '/' ELSE {escape_path(f'{p}.path')} END || {p}.query",
    )


def verdict(source: str, keep: str) -> str:
    """SELECT adding ``host``, ``allowed`` and ``delay_s`` to rows with a ``url``."""
    token = S.USER_AGENT_TOKEN
    return f"""
    SELECT {keep}, host,
      CASE WHEN policy = 'disallow_all' THEN FALSE ELSE coalesce(best % 2 = 1, TRUE) END AS allowed,
      coalesce(delay, {S.CRAWL_DELAY_SECONDS}) AS delay_s
    FROM (
      SELECT u.*, p.policy, d.delay_s AS delay,
        (SELECT max(2 * r.path_len + CASE WHEN r.allow THEN 1 ELSE 0 END) FROM rules r
          JOIN chosen c ON c.host = r.host AND c.agent = r.agent
          WHERE r.host = u.host AND regexp_matches(u.target, r.pattern)) AS best
      FROM (SELECT *, {url_host("url")} AS host, {target_of("url")} AS target FROM {source}) u
      LEFT JOIN policy p ON p.host = u.host
      LEFT JOIN chosen c ON c.host = u.host
      LEFT JOIN delays d ON d.host = c.host AND d.agent = c.agent)"""


_TOKEN = lit(S.USER_AGENT_TOKEN.lower())
_STATUS = "CASE WHEN status BETWEEN 200 AND 299 THEN 'parse' WHEN status BETWEEN 500 AND 599 THEN 'disallow_all' ELSE 'allow_all' END"

# --- sitemaps ---------------------------------------------------------------------------

_URLSET = r"""regexp_matches(body, '<(s:)?urlset[\s>]') AND regexp_matches(body, '</(s:)?urlset>\s*$')"""


def urlset_locs(keep: str, source: str) -> str:
    return (
        rf"SELECT {keep}, replace(trim(unnest(regexp_extract_all(body, '(?s)<(?:s:)?loc>(.*?)</(?:s:)?loc>', 1))), '&amp;', '&') AS loc "
        f"FROM {source} WHERE {_URLSET}"
    )


def _round(n: int) -> dict[str, str]:
    """The crawl, unrolled: frontier, visited and scored rows of one depth."""
    first = "arg_min({'url': url, 'depth': depth, 'domain': domain, 'src': src}, {'depth': depth, 'domain': domain, 'src': coalesce(src, ''), 'url': url})"
    seen = " ".join(f"AND url_key NOT IN (SELECT url_key FROM visit{i})" for i in range(n))
    out = {
        f"new{n}": f"SELECT url_key, {first} AS f FROM front{n} WHERE TRUE {seen} GROUP BY url_key",
        f"go{n}": f"SELECT url_key, f.url AS url, f.depth AS depth, f.domain AS domain, f.src AS src FROM new{n}",
        f"ask{n}": verdict(f"go{n}", "url_key, url, depth, domain, src"),
        f"visit{n}": f"SELECT a.url_key, a.url, a.depth, a.domain, a.src, a.allowed, a.allowed AND f.url_key IS NOT NULL AS fetched, "
        f"CASE WHEN a.allowed THEN f.score END AS score, coalesce(a.allowed AND f.is_product, FALSE) AS is_product "
        f"FROM ask{n} a LEFT JOIN facts f ON f.url_key = a.url_key",
    }
    if n < S.MAX_DEPTH:
        links = (
            f"SELECT l.dst AS url, v.depth + 1 AS depth, v.domain, l.dst AS url_key, v.url_key AS src FROM visit{n} v "
            f"JOIN facts f ON f.url_key = v.url_key JOIN judged l ON l.page_id = f.page_id "
            "WHERE v.fetched AND NOT v.is_product AND l.dst IS NOT NULL"
        )
        if n == 0:
            links += (
                f" UNION ALL SELECT loc AS url, 1 AS depth, domain, {normal('loc')} AS url_key, NULL AS src FROM listed"
                " WHERE domain IN (SELECT domain FROM visit0 WHERE allowed)"
            )
        out[f"front{n + 1}"] = links
    return out


def listed(seeds: str) -> dict[str, str]:
    return {
        "maps": f"SELECT *, {normal('url')} AS map_key FROM sitemaps",
        "probes": f"SELECT DISTINCT domain, {normal('probe')} AS map_key FROM (SELECT domain, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') || unnest([{', '.join(lit(p) for p in S.SITEMAP_PATHS)}]) AS probe FROM {seeds})",
        "documents": "SELECT p.domain, s.url AS sitemap_url, s.body FROM probes p JOIN maps s ON s.map_key = p.map_key AND s.status = 200",
        "index_locs": r"SELECT * FROM (SELECT domain, sitemap_url, trim(unnest(regexp_extract_all(body, '(?s)<sitemap>\s*<loc>(.*?)</loc>', 1))) AS loc FROM documents WHERE contains(body, '<sitemapindex'))"
        f" WHERE {product_sitemap('loc')}",
        "child_keys": f"SELECT DISTINCT domain, {normal('loc')} AS map_key FROM index_locs",
        "child_docs": "SELECT DISTINCT i.domain, s.url AS sitemap_url, s.body FROM child_keys i JOIN maps s ON s.map_key = i.map_key",
        "children": urlset_locs("domain, sitemap_url", "child_docs"),
        "plain": urlset_locs("domain, sitemap_url", f"(SELECT * FROM documents WHERE NOT contains(body, '<sitemapindex') AND {product_sitemap('sitemap_url')})"),
        "listed": "SELECT domain, loc FROM children UNION SELECT domain, loc FROM plain",
    }


CTES: dict[str, str] = {
    **C.SQL,
    "keyed": f"SELECT *, {normal('url')} AS url_key FROM web",
    "marked": f"SELECT *, regexp_replace(html, {lit(CLEAN)}, {lit(chr(92) + '1' + chr(92) + '2' + chr(92) + '3')}, 'g') AS marked FROM keyed",
    "tagged": f"SELECT *, regexp_extract_all(marked, {lit('(?s)<[a-zA-Z]' + REST)}, 0) AS tags FROM marked",
    "features": f"SELECT *, {attr(_CANONICAL, 'href')} AS canonical, "
    f"len({tags_named('a')}) / (len(tags) - {_FRAME} + 3) AS anchor_density FROM tagged",
    "flags": "SELECT page_id, url, status, url_key, anchor_density, "
    + ", ".join(f"{sql} AS {name}" for name, sql in signal_columns().items())
    + " FROM features",
    "scored": f"SELECT *, score >= {S.PRODUCT_THRESHOLD} AS is_product FROM (SELECT *, {_SCORE} AS score FROM flags)",
    "hrefs": f"SELECT page_id, status, url_key AS src, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, status, url_key, {_HREFS} AS h FROM tagged)",
    "judged": judged("hrefs", "src", "href", "page_id, status, src, pos, href"),
    "facts": "SELECT url_key, min(page_id) AS page_id, arg_min(score, page_id) AS score, arg_min(is_product, page_id) AS is_product FROM scored WHERE status = 200 GROUP BY url_key",
    "products": f"SELECT DISTINCT {url_host('url_key')} AS domain, url_key AS url FROM scored WHERE status = 200 AND is_product",
    "policy": f"SELECT host, {_STATUS} AS policy FROM robots",
    "raw_lines": r"SELECT host, pos, regexp_replace(line, '#.*$', '') AS line FROM (SELECT host, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT host, string_split_regex(body, '\r\n|\r|\n') AS l FROM robots WHERE status BETWEEN 200 AND 299))",
    "lines": "SELECT host, pos, field, value, group_no FROM (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS group_no FROM (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY pos), '') <> 'user-agent' AS starts FROM (SELECT host, pos, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(line, '^[^:]*:?', '')) AS value FROM raw_lines) WHERE field IN ('user-agent', 'allow', 'disallow', 'crawl-delay'))) WHERE group_no > 0",
    "agents": "SELECT DISTINCT host, group_no, lower(value) AS agent FROM lines WHERE field = 'user-agent'",
    "rules": f"SELECT DISTINCT l.host, a.agent, l.field = 'allow' AS allow, l.value AS path, length(l.value) AS path_len, {_PATTERN.replace('path', 'l.value')} AS pattern FROM lines l JOIN agents a ON a.host = l.host AND a.group_no = l.group_no WHERE l.field IN ('allow', 'disallow') AND l.value <> ''",
    "delays": "SELECT l.host, a.agent, max(try_cast(l.value AS DOUBLE)) AS delay_s FROM lines l JOIN agents a ON a.host = l.host AND a.group_no = l.group_no WHERE l.field = 'crawl-delay' AND try_cast(l.value AS DOUBLE) > 0 GROUP BY l.host, a.agent",
    "chosen": f"SELECT host, CASE WHEN max(CASE WHEN agent = {_TOKEN} THEN 1 ELSE 0 END) = 1 THEN {_TOKEN} ELSE '*' END AS agent FROM agents WHERE agent IN ({_TOKEN}, '*') GROUP BY host",
    "seed_rows": f"SELECT url, 0 AS depth, domain, {normal('url')} AS url_key, NULL AS src FROM (SELECT url, {url_host('url')} AS domain FROM seeds) WHERE domain IS NOT NULL",
    **listed("seed_rows"),
    "front0": "SELECT url, depth, domain, url_key, CAST(src AS VARCHAR) AS src FROM seed_rows",
    **{k: v for n in range(S.MAX_DEPTH + 1) for k, v in _round(n).items()},
    "visited": " UNION ALL ".join(f"SELECT * FROM visit{n}" for n in range(S.MAX_DEPTH + 1)),
}

_ORDER = list(CTES)
_USES = {
    name: [o for o in _ORDER if o != name and re.search(rf"\b{o}\b", text)] for name, text in CTES.items()
}


def sql(select: str) -> str:
    """The query with the sub-queries it uses, directly or through others, in front."""
    needed: set[str] = set()

    def add(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in _USES[name]:
                if re.search(rf"(?:FROM|JOIN)\s+{other}\b", CTES[name]):
                    add(other)

    for name in _ORDER:
        if re.search(rf"(?:FROM|JOIN)\s+{name}\b", select):
            add(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _ORDER if n in needed)
    return f"WITH {ctes} {select}" if ctes else select
