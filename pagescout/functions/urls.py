"""URL operators.

``parse_url`` is not used: it fails the job on characters that are common in real links and
loses the port. Each part of a URL is one anchored regular expression. Operators that need
intermediate results add them as columns step by step (``with_...``), so that every step is
generated code and nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions.steps import settle

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_ESC = r"%[0-9A-Fa-f]{2}"
_HOST = (
    r"(?:\[[^\[\]@]*\]"
    r"|(?!\[)(?:[A-Za-z0-9\-_.~!$&'()*+,;=<>\"\[\]\x{80}-\x{10FFFF}]|%[89A-Fa-f][0-9A-Fa-f])*+)"
)
_PATH_CHARS = rf"(?:[^?#%]++|{_ESC})*+"
# What a URL parser accepts: no control characters, complete escapes, a sound host and port,
# and no colon in the first segment of a URL without scheme.
_VALID = (
    r"(?s)^(?=[^\x00-\x1f\x7f]*+\z)(?:"
    rf"(?:{_SCHEME}:)?//(?:[^/?#]*@)?{_HOST}(?::[0-9]*)?(?:/{_PATH_CHARS})?"
    rf"|{_SCHEME}:(?:/(?!/){_PATH_CHARS})?"
    rf"|{_SCHEME}:[^/?#][^?#]*"
    rf"|(?!//)(?![^/?#]*:){_PATH_CHARS}"
    rf")(?:\?[^#]*)?(?:#(?:[^%]++|{_ESC})*+)?\z"
)
# URLs that normalization leaves as they are: the common case, settled by one match.
_NORMAL_FORM = (
    r"^https?://[a-z0-9.\-]+(?::[0-9]+)?"
    r"(?:/[A-Za-z0-9_~$&+,:;=@\-][A-Za-z0-9_~$&+,:;=@.\-]*+)*+\z"
)
_PLAIN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@]*+\z"
_NEEDS_NO_FOLD = r"^(?!.*//)(?!.*(?:^|/)\.{1,2}(?:/|\z))[A-Za-z0-9\-_.~$&+,/:;=@]*+\z"
_ENCODED_PATH = rf"^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]]++|{_ESC})*+\z"
# Characters that a path keeps although form encoding escapes them.
_PATH_KEEPS = {
    "%7E": "~", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",",
    "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@",
}
_SPACES = " \t\n\r\x0b\x0c\x85\xa0\u2002\u2003\u2009\u3000"


def any_of(words: list[str]) -> str:
    """Regex alternation of plain words or patterns."""
    return "|".join(words)


# --- U1 parts ---------------------------------------------------------------------------


def is_valid_url(url: Column) -> Column:
    """Whether the text can be read as an absolute or relative URL."""
    return url.rlike(_VALID)


def url_scheme(url: Column) -> Column:
    """Lower-cased scheme without colon, ``""`` when missing."""
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def url_authority(url: Column) -> Column:
    """Host with port and user info, led by ``//``; ``""`` when missing."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?(//[^/?#]*)", 1)


def url_host_text(url: Column) -> Column:
    """Lower-cased host with port, without user info; ``""`` when missing."""
    raw = F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//(?:[^/?#]*@)?([^/?#]*)", 1)
    return F.lower(_decoded(raw))


def url_host(url: Column) -> Column:
    """Lower-cased host with port; NULL for text that is no URL."""
    return F.when(is_valid_url(url), url_host_text(url))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, rf"(?s)^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """Query with its ``?``, so that an empty one differs from a missing one."""
    return F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)


def url_fragment(url: Column) -> Column:
    """Fragment with its ``#``."""
    return F.regexp_extract(url, r"(?s)^[^#]*(#.*)", 1)


def with_url_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds ``valid, scheme, authority, host, path, query, fragment``."""
    col = F.col(url)
    return df.withColumns(
        {
            f"{prefix}valid": is_valid_url(col),
            f"{prefix}scheme": url_scheme(col),
            f"{prefix}authority": url_authority(col),
            f"{prefix}host": url_host_text(col),
            f"{prefix}path": url_path(col),
            f"{prefix}query": url_query(col),
            f"{prefix}fragment": url_fragment(col),
        }
    )


# --- U2 normalize -----------------------------------------------------------------------


def with_normal_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds the key under which a URL is compared.

    Lower-cases scheme and host, drops fragment and bare ``?``, cleans the path, sorts the
    query parameters by name. The root of a site has one key, without a slash, and a second
    application changes nothing. Text that is no URL is lower-cased.
    """
    col = F.col(url)
    is_normal = col.rlike(_NORMAL_FORM)
    path, decoded, cleaned = f"_{out}_path", f"_{out}_decoded", f"_{out}_cleaned"
    steps = (
        df.withColumn(path, F.when(~is_normal, url_path(col)))
        .withColumn(decoded, F.when(~F.col(path).rlike(_NEEDS_NO_FOLD), _decoded(F.col(path))))
        .withColumn(cleaned, F.replace(_fold_dots(F.col(decoded)), F.lit("\\"), F.lit("/")))
        .withColumn(
            out,
            F.when(is_normal, col)
            .when(~is_valid_url(col), F.lower(col))
            .otherwise(
                F.concat(
                    F.lower(F.regexp_extract(col, rf"^({_SCHEME}:)", 1)),
                    _authority_text(col),
                    _path_text(col, F.col(path), F.col(decoded), F.col(cleaned)),
                    sorted_query(url_query(col)),
                )
            ),
        )
        .drop(path, decoded, cleaned)
    )
    return settle(steps, out)


def _is_opaque(url: Column) -> Column:
    """A scheme followed by text without slash, as in ``mailto:``."""
    return url.rlike(rf"^{_SCHEME}:[^/?#]")


def _path_text(url: Column, path: Column, decoded: Column, cleaned: Column) -> Column:
    """Cleaned path. A path that needed no cleaning keeps its own escapes."""
    return (
        F.when(_is_opaque(url), path)
        .when(decoded.isNull(), F.regexp_replace(path, "/$", ""))
        .when((cleaned == decoded) & path.rlike(_ENCODED_PATH), path)
        .otherwise(_encode_path(cleaned))
    )


def _authority_text(url: Column) -> Column:
    before_host = F.regexp_extract(url, rf"^(?:{_SCHEME}:)?(//(?:[^/?#]*@)?)", 1)
    host = url_host_text(url)
    return F.concat(
        before_host, F.when(host.rlike(r"[^\x00-\x7f]"), _percent_encode(host)).otherwise(host)
    )


def _fold_dots(path: Column) -> Column:
    """Path without doubled slashes, ``.``, ``..`` and trailing slash; the root is ``""``."""
    rooted = path.startswith("/")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(stack: Column, seg: Column) -> Column:
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(".."))
        return (
            F.when(seg != "..", F.concat(stack, F.array(seg)))
            .when(top != "..", F.slice(stack, F.lit(1), F.size(stack) - 1))
            .when(rooted, stack)
            .otherwise(F.concat(stack, F.array(seg)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    text = F.array_join(kept, "/")
    return F.when(rooted, F.rtrim(F.concat(F.lit("/"), text), F.lit("/"))).otherwise(text)


def _decoded(text: Column) -> Column:
    """Percent escapes resolved, ``+`` kept; text with broken escapes stays as it is."""
    return F.when(
        text.contains("%"),
        F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text),
    ).otherwise(text)


def _percent_encode(text: Column) -> Column:
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in _PATH_KEEPS.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _encode_path(path: Column) -> Column:
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(_percent_encode(path))


def escape_path(path: Column) -> Column:
    """Path with every character escaped that may not stand in a URL; valid paths unchanged."""
    return F.when(path.rlike(_ENCODED_PATH), path).otherwise(_encode_path(_decoded(path)))


def escape_rule_path(path: Column) -> Column:
    """A robots rule path in the escaping of URLs, its wild cards kept."""
    return F.when(
        path.rlike(r"[^\x00-\x7f]"), F.replace(_percent_encode(path), F.lit("%2A"), F.lit("*"))
    ).otherwise(path)


def query_params(query: Column) -> Column:
    """``ARRAY<STRUCT<k, pos, v>>`` of the decoded parameters, in order of appearance.

    ``query`` may carry its leading ``?``. Parameters with a broken escape or a ``;`` are
    left out. An array and not a map, since a name may repeat.
    """
    pieces = F.split(F.regexp_replace(query, r"^\?", ""), "&")

    def pair(piece: Column, pos: Column) -> Column:
        return F.struct(
            F.try_url_decode(F.substring_index(piece, "=", 1)).alias("k"),
            pos.alias("pos"),
            F.try_url_decode(F.regexp_replace(piece, r"(?s)^[^=]*=?", "")).alias("v"),
        )

    return F.filter(
        F.transform(F.filter(pieces, lambda p: (p != "") & ~p.contains(";")), pair),
        lambda kv: kv["k"].isNotNull() & kv["v"].isNotNull(),
    )


def sorted_query(query: Column) -> Column:
    """The query with its parameters sorted by name, order of equal names kept."""
    text = F.array_join(
        F.transform(
            F.sort_array(query_params(query)),
            lambda kv: F.concat(F.lit("&"), F.url_encode(kv["k"]), F.lit("="), F.url_encode(kv["v"])),
        ),
        "",
    )
    fixed = F.replace(F.replace(text, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(query.isin("", "?"), "").otherwise(F.regexp_replace(fixed, "^&", "?"))


def normalize_url_no_query(url: Column) -> Column:
    """``https`` where the scheme is missing, no fragment, no query, host lower-cased.

    The path stays as it is, trailing slash included, apart from escaping.
    """
    scheme, path, authority = url_scheme(url), url_path(url), url_authority(url)
    slashes = F.when((scheme == "") & (authority == "") & (path != ""), "//").otherwise(
        _authority_text(url)
    )
    text = F.concat(
        F.when(scheme == "", "https").otherwise(scheme),
        F.lit(":"),
        slashes,
        F.when(_is_opaque(url), path).otherwise(escape_path(path)),
    )
    return F.when(is_valid_url(url), text).otherwise(F.lower(url))


# --- U4, U5, U10 predicates -------------------------------------------------------------


def matches_product_url(url: Column) -> Column:
    """U4: some product pattern occurs anywhere in the lower-cased URL."""
    return F.lower(url).rlike(any_of(S.PRODUCT_URL_PATTERNS))


def has_product_param(url: Column) -> Column:
    """Some decoded query parameter name contains a product word."""
    words = any_of(S.PRODUCT_PARAM_WORDS)
    return F.when(
        url.contains("?") & is_valid_url(url),
        F.exists(query_params(url_query(url)), lambda kv: F.lower(kv["k"]).rlike(words)),
    ).otherwise(False)


def url_looks_like_product(url: Column) -> Column:
    """U4 or U5: product-like by pattern or by query parameter."""
    return matches_product_url(url) | has_product_param(url)


def is_product_sitemap(url: Column, strict: bool = False) -> Column:
    """Sitemap URL contains a product word.

    Every URL with the word "sitemap" passes, because "item" is part of it. That is harmless
    for the result, as the listed pages are scored later. ``strict`` looks at the last path
    segment only and with the word "sitemap" removed.
    """
    text = F.lower(url)
    if strict:
        text = F.replace(F.substring_index(text, "/", -1), F.lit("sitemap"), F.lit(""))
    return text.rlike(any_of(S.PRODUCT_SITEMAP_WORDS))


# --- U6-U9 links ------------------------------------------------------------------------


def trim_space(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.trim(text, F.lit(_SPACES))


def with_base_parts(df: DataFrame, base: str) -> DataFrame:
    """Adds the parts of a page URL that resolving its links needs, as ``base_*``."""
    return with_url_parts(df, base, "base_").drop("base_fragment")


BASE_COLUMNS = [f"base_{p}" for p in ("valid", "scheme", "authority", "host", "path", "query")]
_REF = [f"_ref_{p}" for p in ("valid", "scheme", "authority", "host", "path", "query", "fragment")]


def with_resolved_url(df: DataFrame, href: str) -> DataFrame:
    """Adds the meaning of a link on a page with ``base_*`` parts (RFC 3986, 5.3).

    ``abs_url`` is the absolute URL without fragment, NULL when either side is no URL;
    ``abs_scheme``, ``abs_host`` and ``abs_path`` are its parts. ``_href`` is the trimmed link.
    """
    df = with_url_parts(df.withColumn("_href", trim_space(F.col(href))), "_href", "_ref_")
    scheme, authority, host = F.col("_ref_scheme"), F.col("_ref_authority"), F.col("_ref_host")
    path, query = F.col("_ref_path"), F.col("_ref_query")
    elsewhere = (scheme != "") | (F.length(authority) > 2)
    same_page = ~elsewhere & (path == "")
    folder = F.regexp_extract("base_path", "(?s)^(.*/)", 1)
    merged = (
        F.when(elsewhere | path.startswith("/"), path)
        .when(same_page, F.col("base_path"))
        .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    )
    df = df.withColumns(
        {
            "abs_scheme": F.when(scheme == "", F.col("base_scheme")).otherwise(scheme),
            "abs_host": F.when(elsewhere, host).otherwise(F.col("base_host")),
            "_authority": F.when(elsewhere, authority).otherwise(F.col("base_authority")),
            "_merged": merged,
            "_query": F.when(same_page & (query == ""), F.col("base_query")).otherwise(query),
        }
    ).withColumn("abs_path", remove_dot_segments(F.col("_merged")))
    text = F.concat(
        F.when(F.col("abs_scheme") == "", "").otherwise(F.concat("abs_scheme", F.lit(":"))),
        F.col("_authority"),
        F.when(_is_opaque(F.col("_href")), F.col("abs_path")).otherwise(escape_path(F.col("abs_path"))),
        F.when(F.col("_query") == "?", "").otherwise(F.col("_query")),
    )
    resolved = df.withColumn("abs_url", F.when(F.col("base_valid") & F.col("_ref_valid"), text))
    return settle(
        resolved.drop(*_REF, "_authority", "_merged", "_query"),
        "_href", "abs_scheme", "abs_host", "abs_path", "abs_url",
    )


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` of a rooted path, keeping a trailing slash."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda stack, seg: F.when(seg == ".", stack)
        .when(seg == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .otherwise(F.concat(stack, F.array(seg))),
    )
    folded = F.concat(
        F.lit("/"),
        F.array_join(kept, "/"),
        F.when(path.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), "/").otherwise(""),
    )
    return F.when(path.startswith("/") & path.contains("/."), folded).otherwise(path)


def link_prefix_reason(href: Column) -> Column:
    """U7, first half: reason to reject a trimmed link by how it starts, else NULL.

    The prefixes are case-sensitive; other spellings are caught by the scheme test.
    """
    return F.when(
        href.isin("", "#") | _starts_with_any(href, S.INVALID_LINK_PREFIXES), F.lit("invalid_link")
    ).when(_starts_with_any(href, S.NON_HTTP_PREFIXES), F.lit("invalid_scheme"))


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | text.startswith(prefix)
    return test


def scheme_reason() -> Column:
    """U7, second half: the resolved link must be http or https."""
    return F.when(~F.col("abs_scheme").isin(S.HTTP_SCHEMES), F.lit("invalid_scheme"))


def host_reason() -> Column:
    """U8: the resolved link must stay on the same host and port."""
    return F.when(F.col("abs_host") != F.col("base_host"), F.lit("external_domain"))


def path_extension(path: Column) -> Column:
    """Lower-cased extension of the last path segment, dot included."""
    return F.lower(F.regexp_extract(_decoded(path), r"(\.[^./]*)$", 1))


def asset_reason() -> Column:
    """The resolved link must not point to an image, archive, style sheet or the like."""
    return F.when(
        path_extension(F.col("abs_path")).isin(S.ASSET_EXTENSIONS), F.lit("non_html_resource")
    )


def with_link_target(df: DataFrame, href: str) -> DataFrame:
    """Adds ``reject_reason`` and ``dst`` of a link on a page with ``base_*`` parts.

    ``dst`` is the normalized target and NULL for rejected links. The reasons, in the order
    they are tested: ``invalid_link``, ``invalid_scheme``, ``unparsable_link``,
    ``external_domain``, ``non_html_resource``.
    """
    reason = F.coalesce(
        link_prefix_reason(F.col("_href")),
        F.when(F.col("abs_url").isNull(), F.lit("unparsable_link")),
        scheme_reason(),
        host_reason(),
        asset_reason(),
    )
    judged = with_resolved_url(df, href).withColumn("reject_reason", reason)
    accepted = judged.withColumn("_target", F.when(F.col("reject_reason").isNull(), F.col("abs_url")))
    narrow = settle(
        accepted.drop("_href", "abs_url", "abs_scheme", "abs_host", "abs_path"),
        "reject_reason", "_target",
    )
    return with_normal_url(narrow, "_target", "dst").drop("_target")


def plain_target(href: Column) -> Column:
    """``dst`` of a link that is a plain path on the page's host, the common case settled by one match; else NULL.

    Joined to the page's site it is in normal form, so resolving and normalizing would leave it as it is.
    """
    target = F.concat("base_scheme", F.lit(":"), "base_authority", F.when(href == "/", "").otherwise(href))
    asset = path_extension(href).isin(S.ASSET_EXTENSIONS)
    return F.when(href.startswith("/") & F.col("base_valid") & target.rlike(_NORMAL_FORM) & ~asset, target)
