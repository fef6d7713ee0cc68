"""HTML features as Column expressions.

A page is read with a few linear regular-expression passes instead of a parser, so the work
stays in the JVM next to the scan. All quantifiers over attributes are possessive: a broken
page of any length costs one pass and no stack.

Where this differs from a full HTML5 tree: implied end tags are not modelled, and a misplaced
close tag ends an element.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html import unescape
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions.urls import any_of, matches_product_url

# --- fixed values: elements whose content is text, and elements without content ----------
_RAW_TEXT = "script|style|title|textarea|noscript|iframe|xmp|noembed|noframes"
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
# -------------------------------------------------------------------------------------------

_COMMENT = r"<!--(?:-?>|.*?--!?>|.*\z)"
# Rest of a start tag after its name, quoted values with ">" included.
_TAG_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
_START_TAG = "<[a-zA-Z]" + _TAG_REST
_ANY_TAG = "(?s)</?[a-zA-Z]" + _TAG_REST
_RAW_ELEMENT = rf"(<({_RAW_TEXT})(?=[\s/>]){_TAG_REST})(.*?)(</\2(?=[\s/>])[^>]*+>|\z)"
_LD_JSON = "application/ld+json"


def markup(html: Column) -> Column:
    """The page without comments and without the text of scripts, styles and the like.

    One pass over the text: whichever of the two starts first wins, as in a tokenizer. The
    start tags stay, since they count as elements.
    """
    return F.regexp_replace(html, rf"(?is){_COMMENT}|{_RAW_ELEMENT}", "$1$4")


def start_tags(marked: Column) -> Column:
    """All start tags of :func:`markup` text, in document order."""
    return F.regexp_extract_all(marked, F.lit(f"(?s){_START_TAG}"), F.lit(0))


def tags_named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def _attribute_start(name: str, tag: str = r"[a-zA-Z][^\s/>]*+") -> str:
    """Match of a start tag up to the given attribute name; other attributes are stepped over."""
    other = (
        rf"(?:[\s/]++(?!{name}[\s/>=])[^\s/>=]++"
        r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
    )
    return rf"<{tag}{other}[\s/]++{name}(?=[\s/>=])"


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^{_attribute_start(name)}")


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of a start tag, ``""`` when it has none.

    One match gives the value without its quotes: lambdas compute again what is named twice in them. An unquoted
    value may not start with a quote, and loses one at its end.
    """
    quoted = r"""(?<=")[^"]*(?=")|(?<=')[^']*(?=')"""
    plain = r"""(?<!["'])[^\s>"'][^\s>]*?(?=["']?(?:[\s>]|\z))"""
    pattern = rf"""(?is)^{_attribute_start(name)}(?:\s*+=\s*+["']?+({quoted}|{plain}))?"""
    return decode_entities(F.regexp_extract(tag, pattern, 1), tag)


# Names that need no semicolon, the longest first, as one may begin another.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Numbers that HTML5 reads as the characters of an older code page.
_REMAPPED = {str(c): unescape(f"&#{c};") for c in (0, *range(0x80, 0xA0)) if unescape(f"&#{c};")}


def _table(entries: dict[str, str]) -> Column:
    """A constant map; as JSON it is one small expression until the optimizer evaluates it."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string, string>")


def decode_entities(text: Column, source: Column | None = None) -> Column:
    """Text with all HTML5 character references replaced, in one pass: what a reference gives is not read again.

    ``source`` is what the text was cut from, where looking for ``&`` there costs less than the text.
    """
    pieces = F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_reference(piece)))
    return F.when((text if source is None else source).contains("&"), F.array_join(pieces, "")).otherwise(text)


def _reference(piece: Column) -> Column:
    """Text that followed ``&``, with the reference at its start turned into characters."""
    return F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substr(piece, F.lit(5)))).when(
        piece.startswith("#"), _numeric_reference(piece)
    ).otherwise(_named_reference(piece))


def _numeric_reference(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^#([xX][0-9A-Fa-f]+|[0-9]+)", 1)
    significant = F.regexp_replace(digits, "^[xX]?0*(?=.)", "")
    code = F.when(
        digits.rlike("^[xX]"), F.conv(F.substr(significant, F.lit(1), F.lit(8)), 16, 10)
    ).otherwise(F.substr(significant, F.lit(1), F.lit(10))).try_cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    old = F.try_element_at(_table(_REMAPPED), code.cast("string"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    rest = F.regexp_replace(F.substr(piece, F.length(digits) + 2), "^;", "")
    return F.when(
        digits != "",
        F.concat(F.coalesce(F.when(code < 0xA0, old), F.when(valid, char), F.lit("\ufffd")), rest),
    ).otherwise(F.concat(F.lit("&"), piece))


def _named_reference(piece: Column) -> Column:
    name = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0)
    bare = F.regexp_extract(piece, f"^(?:{_BARE_NAMES})", 0)
    full = F.when(name != "", F.try_element_at(_table({n: c for n, c in html5.items() if n.endswith(";")}), name))
    short = F.when(bare != "", F.try_element_at(_table({n: c for n, c in html5.items() if not n.endswith(";")}), bare))
    return F.coalesce(
        F.concat(full, F.substr(piece, F.length(name) + 1)),
        F.concat(short, F.substr(piece, F.length(bare) + 1)),
        F.concat(F.lit("&"), piece),
    )


def element_text(content: Column) -> Column:
    """Text of a piece of markup: tags out, references decoded, nothing put in between."""
    return decode_entities(F.regexp_replace(content, _ANY_TAG, ""), content)


# --- H9 anchors -------------------------------------------------------------------------


def anchor_hrefs(tags: Column) -> Column:
    """H9: href of every ``a`` element that has one, in document order, decoded."""
    return hrefs_of(link_tags(tags))


def link_tags(tags: Column) -> Column:
    """The start tags of the ``a`` elements that have a href."""
    return F.filter(tags, lambda t: t.rlike(rf"(?is)^{_attribute_start('href', 'a')}"))


def hrefs_of(links: Column) -> Column:
    """The decoded href of each of :func:`link_tags`."""
    return F.transform(links, lambda t: attribute(t, "href"))


def _element_pieces(marked: Column, name: str) -> Column:
    """``<name ...>content`` of every element, up to its close tag or the next such element."""
    return F.regexp_extract_all(
        marked,
        F.lit(rf"(?is)<{name}(?=[\s/>]){_TAG_REST}(?:[^<]++|<(?!/?{name}[\s/>]))*+"),
        F.lit(0),
    )


def anchors(marked: Column) -> Column:
    """``ARRAY<STRUCT<href, rel, text>>`` of the links of a page."""
    linked = F.filter(_element_pieces(marked, "a"), lambda t: has_attribute(t, "href"))
    return F.transform(
        linked,
        lambda t: F.struct(
            attribute(t, "href").alias("href"),
            attribute(t, "rel").alias("rel"),
            F.trim(element_text(t), F.lit(" \t\r\n\xa0")).alias("text"),
        ),
    )


def is_next_link(rel: Column, text: Column) -> Column:
    """The link leads to the next page of a list, by ``rel`` or by its text."""
    return F.lower(rel).rlike(r"(?:^|\s)next(?:\s|$)") | F.lower(text).rlike(
        r"^next(?: page)?[\s>»›→]*$"
    )


# --- H1-H6 signals ----------------------------------------------------------------------


def meta_facts(tags: Column) -> Column:
    """``ARRAY<STRUCT<property, name, content>>`` of the ``meta`` elements."""
    return F.transform(
        tags_named(tags, "meta"),
        lambda t: F.struct(
            attribute(t, "property").alias("property"),
            attribute(t, "name").alias("name"),
            attribute(t, "content").alias("content"),
        ),
    )


def meta_signal(metas: Column) -> Column:
    """H1: ``og:type`` is product, or a meta name or property contains the word.

    ``metas`` comes from :func:`meta_facts`; of several ``og:type`` the first counts.
    """
    og = F.filter(metas, lambda m: m["property"] == "og:type")
    return F.coalesce(F.lower(F.get(og, F.lit(0))["content"]) == "product", F.lit(False)) | F.exists(
        metas,
        lambda m: F.lower(m["name"]).contains("product")
        | F.lower(m["property"]).contains("product"),
    )


def _crumb_tag() -> str:
    token = rf"(?-i:{any_of(S.BREADCRUMB_CLASSES)})"
    return (
        rf"{_attribute_start('class')}\s*+=\s*+"
        rf"""(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'|{token}[\s/>])"""
    )


def _bits(tags_of: Callable[[str], list[str]], tag: Column) -> Column:
    """One bit for each element of ``S.IMPLIED_ENDS`` that has the tag in its list."""
    bits: dict[str, int] = {}
    for bit, name in enumerate(S.IMPLIED_ENDS):
        for one in tags_of(name):
            bits[one] = bits.get(one, 0) | 1 << bit
    entries = F.create_map(*[F.lit(x) for entry in bits.items() for x in entry])
    return F.coalesce(F.element_at(entries, tag), F.lit(0))


def _is_crumb(tag: Column) -> Column:
    """Whether a tag has one of the breadcrumb classes; most tags do not even contain a part of their names."""
    names = [c for c in S.BREADCRUMB_CLASSES if not any(o != c and o in c for o in S.BREADCRUMB_CLASSES)]
    hint = reduce(or_, [tag.contains(name) for name in names])
    return hint & tag.rlike(rf"(?is)^{_crumb_tag()}")


def breadcrumb_pieces(html: Column, tags: Column) -> Column:
    """The page from each tag to the next, with its place, the tag's name, whether it closes, and whether a breadcrumb element starts; NULL without one."""
    pieces = F.transform(
        F.regexp_extract_all(_text_kept(html), F.lit("</?[a-zA-Z](?:[^<]++|<(?!/?[a-zA-Z]))*+"), F.lit(0)),
        lambda p, i: F.struct(
            p.alias("text"),
            i.alias("at"),
            F.lower(F.regexp_extract(p, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
            p.startswith("</").alias("closes"),
            (_is_crumb(p) & ~p.rlike(rf"(?i)^<(?:{_VOID})[\s/>]")).alias("crumb"),
        ),
    )
    return F.when(F.exists(tags, _is_crumb), pieces)


def _with_rules(pieces: Column) -> Column:
    """Tags with three bit sets over ``S.IMPLIED_ENDS``: the element that starts, those the tag ends, those it must be closed for before they end."""
    rules = S.IMPLIED_ENDS

    def with_bits(p: Column) -> Column:
        behind = _bits(lambda n: [n, *rules[n][1], *rules[n][2]], p["name"])
        return F.struct(
            p["at"].alias("at"), p["name"].alias("name"), p["closes"].alias("closes"), p["crumb"].alias("crumb"),
            F.when(p["closes"], behind).otherwise(_bits(lambda n: rules[n][0], p["name"])).alias("ends"),
            _bits(lambda n: rules[n][1], p["name"]).alias("nests"),
            _bits(lambda n: [n], p["name"]).alias("own"),
        )

    return F.transform(pieces, with_bits)


def breadcrumb_spans(pieces: Column) -> Column:
    """First piece and number of pieces of every breadcrumb element that is in no other.

    One fold over the tags counts those of the open element's name and passes over all others. It holds numbers
    only, so a page costs what its length asks for. An element whose end tag may be left out (``S.IMPLIED_ENDS``) ends where
    HTML ends it: before the next of its kind, or where the element around it ends. Any other that is never
    closed reaches to the end.
    """
    optional = F.exists(pieces, lambda p: p["crumb"] & p["name"].isin(*S.IMPLIED_ENDS))
    return F.when(optional, _spans(_with_rules(pieces), True)).otherwise(_spans(pieces, False))


def _spans(pieces: Column, rules: bool) -> Column:
    """:func:`breadcrumb_spans`, with implied ends only on the pages that have use for them."""
    numbers = ["depth", "from", *(["rule", "level"] if rules else [])]
    start = F.struct(
        *[F.lit(0).alias(n) for n in numbers], F.lit("").alias("name"),
        F.array().cast("array<struct<from: int, n: int>>").alias("spans"),
    )

    def step(acc: Column, p: Column) -> Column:
        inside, turn = acc["depth"] > 0, F.when(p["closes"], -1).otherwise(1)
        same, opens, more = inside & (p["name"] == acc["name"]), ~inside & p["crumb"], []
        depth = F.when(same, acc["depth"] + turn).when(inside, acc["depth"]).otherwise(p["crumb"].cast("int"))
        ends = inside & (depth == 0)
        if rules:
            rule, level = acc["rule"], acc["level"]
            implied = (rule != 0) & (level == 0) & (rule.bitwiseAND(p["ends"]) != 0)
            ends = F.when(rule != 0, implied).otherwise(ends)
            # What ends one breadcrumb element by its start may be the next.
            opens = p["crumb"] & (~inside | implied)
            depth = F.when(opens, 1).when(implied, 0).when(rule != 0, acc["depth"]).otherwise(depth)
            rule = F.when(opens, p["own"]).when(implied, 0).otherwise(rule)
            level = F.when(opens, 0).when(acc["rule"].bitwiseAND(p["nests"]) != 0, F.greatest(level + turn, F.lit(0))).otherwise(level)
            more = [rule.alias("rule"), level.alias("level")]
        span = F.array(F.struct(acc["from"].alias("from"), (p["at"] - acc["from"]).alias("n")))
        after = F.struct(
            depth.alias("depth"),
            F.when(opens, p["at"]).otherwise(acc["from"]).alias("from"),
            *more,
            F.when(opens, p["name"]).otherwise(acc["name"]).alias("name"),
            F.when(ends, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )
        return after if rules else F.when(p["crumb"] | (p["name"] == acc["name"]), after).otherwise(acc)

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["from"].alias("from"), (F.size(pieces) - acc["from"]).alias("n")))
        return F.when(acc["depth"] > 0, F.concat(acc["spans"], last)).otherwise(acc["spans"])

    return F.aggregate(pieces, start, step, finish)


def breadcrumb_texts(pieces: Column, spans: Column) -> Column:
    """Text of every breadcrumb element; what is nested in one is part of its text."""
    return F.transform(
        spans,
        lambda s: element_text(F.array_join(F.transform(F.slice(pieces, s["from"] + 1, s["n"]), lambda p: p["text"]), "")),
    )


def breadcrumb_signal(texts: Column) -> Column:
    """H2: the text of the breadcrumb elements names a product, item or detail page."""
    return F.coalesce(
        F.lower(F.array_join(texts, "")).rlike(any_of(S.BREADCRUMB_WORDS)), F.lit(False)
    )


def _text_kept(html: Column) -> Column:
    """The page without comments, script text kept but with no ``<`` left in it."""
    pieces = F.split(
        F.regexp_replace(html, rf"(?is){_COMMENT}|{_RAW_ELEMENT}", "$1\x01$3\x01$4"), "\x01"
    )
    # Odd pieces (counted from 0) are script and style text; a comment leaves two marks too.
    return F.array_join(
        F.transform(
            pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, "<", " ")).otherwise(p)
        ),
        "",
    )


def anchor_text_signal(marked: Column) -> Column:
    """H3: the text of a link or button contains one of the product phrases."""
    phrases = any_of(S.PRODUCT_PHRASES)
    return F.exists(
        F.concat(_element_pieces(marked, "a"), _element_pieces(marked, "button")),
        lambda piece: F.lower(element_text(piece)).rlike(phrases),
    )


def structured_data_signal(html: Column) -> Column:
    """H4: a JSON-LD script declares the type product, white space and case ignored.

    The signal counts. Giving it weight 0 restores a score without structured data.
    """
    scripts = F.regexp_extract_all(
        html, F.lit(rf"(?is){_COMMENT}|<script(?=[\s/>]){_TAG_REST}.*?(?:</script|\z)"), F.lit(0)
    )

    def declares(script: Column) -> Column:
        text = F.lower(F.regexp_replace(script, r"\s", ""))
        return (
            ~script.startswith("<!--")
            & (attribute(script, "type") == _LD_JSON)
            & (text.contains('"@type":"product"') | text.contains("'@type':'product'"))
        )

    return F.when(html.contains(_LD_JSON), F.exists(scripts, declares)).otherwise(False)


def canonical_href(tags: Column) -> Column:
    """Href of the first canonical link, NULL when the page has none."""
    links = F.filter(
        tags, lambda t: t.rlike(r"(?i)^<link[\s/]") & (attribute(t, "rel") == "canonical")
    )
    first = F.transform(F.slice(links, 1, 1), lambda t: F.when(has_attribute(t, "href"), attribute(t, "href")))
    return F.get(first, F.lit(0))


def canonical_signal(href: Column) -> Column:
    """H5: the canonical link, as written, matches a product pattern."""
    return F.coalesce(matches_product_url(href), F.lit(False))


def anchor_share(tags: Column) -> Column:
    """A4: share of ``a`` elements among all elements.

    ``html``, ``head`` and ``body`` exist once in every parsed page, written or not.
    """
    frame = F.size(F.filter(tags, lambda t: t.rlike(r"(?i)^<(?:html|head|body)[\s/>]")))
    return F.size(tags_named(tags, "a")) / (F.size(tags) - frame + 3)


def anchor_density_signal(share: Column) -> Column:
    """H6: more than 30 percent of the elements are links."""
    return share > S.DENSE_ANCHOR_SHARE
