"""Word lists, names and limits that results depend on."""

# User-agent tokens of self-declared bots and non-browser clients.
BOT_TOKENS = [
    "bot",
    "crawler",
    "spider",
    "slurp",
    "curl",
    "wget",
    "python",
    "go-http-client",
    "java/",
    "httpclient",
    "okhttp",
    "libwww",
    "scrapy",
    "headlesschrome",
    "phantomjs",
    "lighthouse",
    "pingdom",
    "uptime",
    "monitor",
]

# User-agent tokens of handheld devices.
MOBILE_TOKENS = ["mobile", "iphone", "android", "ipad"]

# Browser names with their user-agent tokens; the first match wins.
BROWSERS = [
    ("Edge", ["edg/", "edge/"]),
    ("Opera", ["opr/", "opera"]),
    ("Samsung Internet", ["samsungbrowser"]),
    ("Firefox", ["firefox/"]),
    ("Chrome", ["chrome/", "crios/"]),
    ("Safari", ["safari/"]),
]

# Operating systems with their user-agent tokens; the first match wins.
OPERATING_SYSTEMS = [
    ("Windows", ["windows"]),
    ("iOS", ["iphone", "ipad"]),
    ("macOS", ["mac os x", "macintosh"]),
    ("Android", ["android"]),
    ("Linux", ["linux"]),
]

# Path or referrer tokens of CMS vulnerability scans.
SCAN_TOKENS = ["wp-login", "wp-admin", "wp-content", "wp-json", "wp-includes", "xmlrpc.php", "wordpress"]

# File suffixes of static assets (case-sensitive), probe paths and the API prefix.
ASSET_SUFFIXES = [".css", ".js", ".ico", ".png", ".svg", ".jpg", ".webp", ".map", ".woff", ".woff2", ".txt", ".xml"]
PROBE_PATHS = ["/healthz", "/readyz"]
API_PREFIX = "/api"

# Public suffixes of two labels.
TWO_PART_SUFFIXES = [
    "co.uk",
    "org.uk",
    "ac.uk",
    "gov.uk",
    "net.uk",
    "me.uk",
    "co.jp",
    "ne.jp",
    "or.jp",
    "ad.jp",
    "com.au",
    "net.au",
    "org.au",
    "id.au",
    "co.nz",
    "net.nz",
    "org.nz",
    "co.za",
    "com.br",
    "net.br",
    "com.mx",
    "com.ar",
    "com.sg",
    "com.hk",
    "com.cn",
    "com.tw",
    "co.in",
    "co.kr",
    "co.il",
]

# Listing and rollup sizes, retention, salt length.
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
ROLLUP_DAYS = 30
ROLLUP_TOP_N = 10
LATEST_DAYS = 10
RETENTION_DAYS = 90
MIN_SALT_LENGTH = 16
