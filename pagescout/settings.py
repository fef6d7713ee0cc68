"""Values that define the result of the product search.

Everything in the first block is a FIXED VALUE: the words, patterns, weights and limits
decide which pages count as product pages, so changing one changes results.
"""

# --- fixed values -----------------------------------------------------------------------

# A URL that contains one of these (after lower-casing) looks like a product page.
PRODUCT_URL_PATTERNS = [
    "/product/",
    "/item/",
    "/p/",
    "/prod/",
    r"-prod\d+",
    "/buy/",
    "/shop/",
    r"/product\.html",
]

# A query parameter whose name contains one of these points to a product.
PRODUCT_PARAM_WORDS = ["product", "item", "prod", "sku"]

# A sitemap whose URL contains one of these is worth reading.
PRODUCT_SITEMAP_WORDS = ["product", "item", "prod"]

# Class tokens of a breadcrumb element and the words looked for in its text.
BREADCRUMB_CLASSES = ["breadcrumb", "breadcrumbs", "bc", "breadcrumb-trail"]
BREADCRUMB_WORDS = ["product", "item", "detail"]

# Texts of links and buttons found on product pages.
PRODUCT_PHRASES = [
    "buy now",
    "add to cart",
    "add to bag",
    "view product",
    "product details",
    "shop now",
]

# Link prefixes that are never fetched, and the two schemes that are.
INVALID_LINK_PREFIXES = ["javascript:"]
NON_HTTP_PREFIXES = ["mailto:", "tel:", "data:", "chrome-extension:"]
HTTP_SCHEMES = ["http", "https"]

# File extensions of resources that are not web pages.
ASSET_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".zip", ".tar", ".gz", ".mp3", ".mp4",
    ".avi", ".mov", ".css", ".js", ".svg",
]

# Where the sitemap of a site is looked for.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]

# Weight of each signal, score a product page must reach, anchor share of a dense page.
SIGNAL_WEIGHTS = {
    "url_pattern": 20,
    "meta": 15,
    "breadcrumb": 10,
    "query_param": 10,
    "anchor_text": 10,
    "structured_data": 20,
    "canonical": 10,
    "anchor_density": 5,
}
PRODUCT_THRESHOLD = 50
DENSE_ANCHOR_SHARE = 0.3

# The port a scheme has when none is written.
DEFAULT_PORTS = {"https": 443, "http": 80}

# Fixed values of HTML: elements whose end tag may be left out, start tags that end them, elements inside which
# those start tags do not, and further elements whose end tag ends them.
_ROW_GROUPS = ["tbody", "thead", "tfoot"]
_BLOCKS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "main", "menu",
    "nav", "ol", "pre", "search", "section", "summary", "ul",
]
IMPLIED_ENDS = {
    "li": (["li"], ["ul", "ol", "menu"], []),
    "dt": (["dt", "dd"], ["dl"], []),
    "dd": (["dt", "dd"], ["dl"], []),
    "p": ([*_BLOCKS, "p", "hr", "li", "dt", "dd", "table"], [], [*_BLOCKS, "li", "dt", "dd", "td", "th", "body", "html"]),
    "option": (["option", "optgroup"], ["select", "datalist"], ["optgroup"]),
    "tr": (["tr", *_ROW_GROUPS], ["table"], _ROW_GROUPS),
    "td": (["td", "th", "tr", *_ROW_GROUPS], ["table"], ["tr", *_ROW_GROUPS]),
    "th": (["td", "th", "tr", *_ROW_GROUPS], ["table"], ["tr", *_ROW_GROUPS]),
}

# Crawl limits: link depth, seconds between two fetches of one host, progress interval.
MAX_DEPTH = 3
CRAWL_DELAY_SECONDS = 1.0
MONITOR_SECONDS = 30
MAX_URLS_PER_DOMAIN = 1000

# --- choices of this package ------------------------------------------------------------

# Product token matched against the User-agent lines of robots files.
USER_AGENT_TOKEN = "pagescout"

# A lookup table up to this size is broadcast; a larger one is joined with salted hot keys.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Rows of one key that a single task may receive before the key is split.
ROWS_PER_TASK = 1_000_000
SKETCH_PRECISION = 12
FILTER_BITS = 1 << 27

# URLs of one domain held in a single output array.
URLS_PER_DOCUMENT = 100_000

# Bytes of domains and URLs that the single row of the whole result may hold.
ONE_ROW_BYTES = 256 * 1024 * 1024
