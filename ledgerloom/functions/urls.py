"""URL functions as Catalyst expressions: no call that can throw on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.binding import let

#: Fixed values of the data model.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "igshid", "yclid", "wickedid", "twclid", "s_cid", "cmpid", "spm", "ref", "ref_src",
)
TWO_PART_SUFFIXES = (
    "co.uk", "com.tw", "co.jp", "com.cn", "com.hk", "com.au", "co.kr", "com.br", "com.mx", "com.sg", "co.in", "co.za", "org.uk", "ne.jp", "or.jp", "com.tr", "co.nz", "com.my", "com.vn", "co.id", "com.ph",
)
NOISE_SEGMENTS = (
    "terms", "terms-of-use", "terms-of-service", "termsofuse", "tos", "privacy", "privacy-policy", "legal", "legal-notice", "legal-notices", "cookie", "cookies", "cookie-policy", "disclaimer", "disclaimers",
    "accessibility", "safe-harbor", "sitemap", "site-map", "careers", "career", "jobs", "about", "about-us", "aboutus", "who-we-are", "our-company", "company-overview", "contact", "contact-us", "contacts",
    "team", "our-team", "our-people", "history", "our-history", "mission", "values", "culture", "diversity", "supplier", "suppliers", "vendors", "login", "log-in", "signin", "sign-in", "register",
    "subscribe", "subscription", "newsletter", "search", "rss", "feed", "feeds", "print", "share", "email-alerts", "alerts", "faq", "faqs", "help", "support",
)
NON_EVENT = r"(?i)\.(xml|rss|atom|css|js|png|jpe?g|gif|svg|ico|woff2?)(\?|#|$)|/(rss|feeds?|atom|sitemap)(/|\.|\?|#|$)|/content/dam/|/sites/[^/]+/files/|/media/documents?/"
ASSET = r"(?i)\.(xml|rss|atom|css|js|png|jpe?g|gif|svg|ico|woff2?)(\?|#|$)|/(rss|feeds?|atom|sitemap)(/|\.|\?|#|$)"
TRACKER = r"(?i)/Tracker\?|/track(er)?/[^/]*\?|//(link|click|ct|email|e|mailer)\.[^/]+/|/(redirect|goto|linkclick)\.(aspx|php|jsp)|doubleclick\.net|/pagead/"
FILINGS = r"(?i)/(sec-filings|edgar|financials/(sec|quarterly|annual|financial-results)|regulatory)"
BINARY_ROUTE = r"(?i)\.(pdf|pptx?|docx?|xlsx?|csv|zip|rar|7z|gz|tgz|mp3|wav|m4a|aac|mp4|mov|avi|mkv|webm|ics|vcs|epub)(\?|#|$)"
DOCUMENT_PATH = r"(?i)/(static-files|content/dam|files/doc_financials|files/doc_downloads)/"
EVENTS_HUB = r"(?i)/(events?|events-and-presentations|events-calendar|ir-calendar|calendar|webcasts?|presentations?|news-and-events|upcoming-events?|investor-events?)(/|\?|#|$|-|\.)"
IR_PATH = r"(?i)/(ir|investor|investors|investor-relations|events?|presentations?|calendar|webcasts?|financial|financials|results|earnings|news-and-events|news-events|shareholders?|stock|reports?|library|quarterly|annual|disclosure|ri|relacoes|relations)(/|\?|#|$|-|_|\.)"
NON_IR_PATH = r"(?i)/(careers?|jobs|legal|privacy|terms|cookie|sitemap|support|help|contact|store|shop|products?|solutions?|blog|login|signin|account|cart|search)(/|\?|#|$|-)"
IR_MATERIAL = r"(?i)\.(pdf|pptx?|docx?|xlsx?|zip|mp[34]|mov|jpe?g|png|gif|svg|css|js)(\?|#|$)"
IR_PLATFORM = r"(?i)\.(gcs-web|q4web|q4inc|irwebsite|investorroom|equisolve|issuerdirect)\.com$"
VIEWER = r"(?i)(pdf-?viewer|/viewer\.(aspx|html?|php)|/web/viewer\.html|officeapps\.live\.com)"
VIEWER_TARGET = "(?:^|&)(?:src|file|url|document|pdf)=([^&]*)"
PDF_EXPORT_PATH, PDF_EXPORT_QUERY = "(?i)/pdf/?$", "(?i)(?:^|&)(?:as[_-]?pdf|format=pdf|type=pdf|download=pdf)(?:=[^&]*)?(?:&|$)"
OPAQUE_DOWNLOAD = "(?i)/static-files/|/resource/download/|/api/asset/|/download/?$"
MARKDOWN_LINK = r"\[([^\]]*)\]\((https?://[^)\s]+)\)"
DASHBOARD_KINDS = ((r"\.pdf(\?|#|$)", "pdf"), (r"\.(mp3|wav|m4a|aac)(\?|#|$)", "audio"), (r"\.(mp4|mov|webm)(\?|#|$)", "video"), (r"\.(pptx?|key)(\?|#|$)", "slides"))
VIDEO_HOSTS = (
    r"(?i)(?:^|\.)(?:youtube\.com|youtu\.be|vimeo\.com|wistia\.com|brightcove\.net|q4inc\.com|webcasts?\.com|veracast\.com|open-exchange\.net|issuerdirect\.com|media-server\.com|on24\.com|choruscall\.com|wsw\.com|"
    r"teletogether\.com|kvgo\.com|metameetings\.net|webinar\.net|irwebmeeting\.com|irwebcasting\.com|summitcast\.com|viavid\.com|webcaster4\.com|webcast-eqs\.com|talkpoint\.com|royalcast\.com|c-conf\.com|vevent\.com|zoom\.us)$"
)
LEAF = r"(?i)/(?:event|press[-_]?release|news[-_]?release|news|article|story|presentation|webcast)[-_]?details?/|/details?/\d|/(?:news|press|events?)[-_]?releases?/\d{4}/|/\d{4}-\d{2}-\d{2}-|/(?:webcast|event)-\d{4}"
YEAR_CONTROL = r"""(?i)(?:<option[^>]*>\s*|<(?:option|button|a|li)[^>]*(?:value|data-year|data-filter)\s*=\s*["']?)(20[0-2][0-9])\b"""
MORE_CONTROL = r"""(?i)(?:load|show|view|see)[\s_-]*more|rel\s*=\s*["']next["']|class\s*=\s*["'][^"']*pagination"""
EXTENSION_KINDS = (("pdf", ("pdf",)), ("pptx", ("pptx", "ppt")), ("docx", ("docx", "doc")), ("xlsx", ("xlsx", "xls")), ("audio", ("mp3", "wav", "m4a", "aac", "flac", "ogg", "opus", "wma")), ("video", ("mp4", "mov", "webm", "mkv", "m4v")))
NON_CONTENT = ("zip", "7z", "rar", "tar", "gz", "ics", "vcs", "ical", "dmg", "exe", "pkg")
CONTENT_TYPES = (
    ("application/pdf", "pdf"), ("presentationml", "pptx"), ("vnd.ms-powerpoint", "pptx"), ("wordprocessingml", "docx"), ("msword", "docx"), ("spreadsheetml", "xlsx"), ("vnd.ms-excel", "xlsx"),
    ("audio/", "audio"), ("video/", "video"), ("text/html", "html"), ("application/xhtml", "html"),
)


def _with_scheme(u: Column) -> Column:
    return F.when(F.lower(u).startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def host(u: Column) -> Column:
    """What stands between :// and the next slash; empty if there is none."""
    return F.coalesce(F.regexp_extract(u, "://([^/]+)", 1), F.lit(""))


def netloc(u: Column) -> Column:
    return F.lower(F.regexp_extract(_with_scheme(u), "://([^/?#]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(_with_scheme(u), "://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(_with_scheme(u), r"://[^?#]*\?([^#]*)", 1)


#: Scheme, host, path and query; the mark that parts them occurs in no address.
_ADDRESS, _MARK = r"(?s)^([^:]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$", "\x01"


def _parts(u: Column) -> Column:
    """scheme, netloc, path and query of an address, read by one match; all empty if it is none."""
    cut = F.split(F.regexp_replace(_with_scheme(u), _ADDRESS, _MARK.join(("$1", "$2", "$3", "$4"))), _MARK)

    def named(c: Column) -> Column:
        part = lambda k: F.when(F.size(c) == 4, F.get(c, F.lit(k))).when(c.isNotNull(), "")
        return F.struct(F.lower(part(0)).alias("scheme"), F.lower(part(1)).alias("netloc"), part(2).alias("path"), part(3).alias("query"))

    return let(cut, named)


def canon_url(u: Column) -> Column:
    """https if no scheme; scheme and host in lower case; no fragment, no trailing slashes; the query stays."""
    return let(_parts(u), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], F.regexp_replace(p["path"], "/+$", ""), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))


def canon_url_media(u: Column) -> Column:
    """As ``canon_url``, with tracking parameters dropped and the rest sorted."""
    kept = lambda q: F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING_PARAMS))), "&")
    base = lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], F.regexp_replace(p["path"], "/+$", ""))
    return let(_parts(u), lambda p: let(kept(p["query"]), lambda k: F.concat(base(p), F.when(k != "", F.concat(F.lit("?"), k)).otherwise(""))))


def registrable_domain(h: Column) -> Column:
    """The last two labels, or three behind a two-part suffix."""
    labels = F.split(F.lower(F.coalesce(h, F.lit(""))), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when((F.size(labels) >= 3) & last(2).isin(*TWO_PART_SUFFIXES), last(3)).when(F.size(labels) >= 2, last(2)).otherwise(labels[0])


def same_site(u: Column, root: Column) -> Column:
    return registrable_domain(netloc(u)) == registrable_domain(netloc(root))


def is_noise_route(u: Column) -> Column:
    return F.exists(F.split(F.lower(path(u)), "/"), lambda s: s.isin(*NOISE_SEGMENTS))


def is_binary_route(u: Column) -> Column:
    return let(path(u), lambda p: p.rlike(BINARY_ROUTE) | p.rlike(DOCUMENT_PATH))


def boosted_score(u: Column, score: Column) -> Column:
    return F.when(path(u).rlike(EVENTS_HUB), F.greatest(score, F.lit(0.95))).otherwise(score)


def extension(u: Column) -> Column:
    return _extension(path(u))


def _extension(path: Column) -> Column:
    tail = F.regexp_extract(path, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(tail, r"\.([^.]*)$", 1))


def unwrap_markdown(u: Column) -> Column:
    t = F.trim(F.coalesce(u, F.lit("")))
    inner = F.regexp_extract(t, f"^{MARKDOWN_LINK}", 2)
    return F.when(inner != "", inner).otherwise(t)


def unwrap_viewer(u: Column) -> Column:
    """A document viewer's target, if it is an absolute address of a known document type; else the url itself."""
    viewer = u.rlike(VIEWER)
    known = [e for _, es in EXTENSION_KINDS for e in es]
    raw = F.regexp_extract(query(u), VIEWER_TARGET, 1)
    target = let(F.try_url_decode(raw), lambda t: F.when(t.rlike("(?i)^https?://") & extension(t).isin(*known), t))
    return F.when(viewer, F.coalesce(target, u)).otherwise(u)


def classify(u: Column) -> Column:
    """html, pdf, pptx, docx, xlsx, audio, video or other, from the address alone."""
    return let(unwrap_viewer(F.trim(F.coalesce(u, F.lit("")))), lambda t: F.when(~t.rlike("(?i)^https?://") | t.rlike(ASSET), "other").otherwise(let(_parts(t), _kind)))


def _kind(p: Column) -> Column:
    def by_extension(ext: Column) -> Column:
        out = F.when(ext.isin(*NON_CONTENT), "other")
        for kind, exts in EXTENSION_KINDS:
            out = out.when(ext.isin(*exts), kind)
        exported = p["path"].rlike(PDF_EXPORT_PATH) | p["query"].rlike(PDF_EXPORT_QUERY)
        return out.when((ext == "") & exported, "pdf").otherwise("html")

    return F.when(F.regexp_replace(p["netloc"], ":.*$", "").rlike(VIDEO_HOSTS), "video").otherwise(let(_extension(p["path"]), by_extension))


def classify_content_type(c: Column, fallback: str = "html") -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(fallback)
    for needle, kind in reversed(CONTENT_TYPES):
        out = F.when(low.contains(needle), kind).otherwise(out)
    return out


def magic_kind(reason: Column) -> Column:
    """The kind that a sniffer's reason for refusing text names: a PDF's mark, or the part folder of an office package."""
    out = F.lit("other")
    for mark, kind in (("ppt/", "pptx"), ("word/", "docx"), ("xl/", "xlsx"), ("%PDF", "pdf")):
        out = F.when(reason.contains(mark), kind).otherwise(out)
    return out


def is_opaque_download(u: Column) -> Column:
    return path(u).rlike(OPAQUE_DOWNLOAD)


def video_id(u: Column) -> Column:
    """The id of a video address in its short, watch, embed, shorts, live or v form; empty if there is none."""
    short = F.regexp_extract(u, r"(?i)^https?://youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#]|$)", 1)
    site = u.rlike(r"(?i)^https?://(?:www\.|m\.)?(?:music\.youtube\.com|youtube\.com|youtube-nocookie\.com)(?:[/?#]|$)")
    watch = F.regexp_extract(query(u), "(?:^|&)v=([A-Za-z0-9_-]{11})(?:&|$)", 1)
    inner = F.regexp_extract(path(u), "/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{11})", 1)
    return F.when(short != "", short).when(site & (watch != ""), watch).when(site, inner).otherwise("")


def should_expand(u: Column, html: Column) -> Column:
    """Whether a page has a year filter (two years or more) or a control for more, unless its address names a single item."""
    years = F.array_distinct(F.regexp_extract_all(html, F.lit(YEAR_CONTROL), 1))
    return ~u.rlike(LEAF) & ((F.size(years) >= 2) | html.rlike(MORE_CONTROL))


def is_public_host(h: Column) -> Column:
    """Whether a host is neither local nor a literal address of a private, loopback or link-local range."""
    private = r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[?(::1|f[cd].*|fe80.*)\]?)$"
    return (F.coalesce(h, F.lit("")) != "") & ~F.regexp_replace(F.lower(h), ":[0-9]+$", "").rlike(private)


def dashboard_kind(u: Column) -> Column:
    low, out = F.lower(F.coalesce(u, F.lit(""))), F.lit("page")
    for pattern, kind in reversed(DASHBOARD_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def is_ir_candidate(u: Column, root: Column) -> Column:
    """Whether an address may be an investor page of the site: its own or on a known platform, the site's root or a path
    that sounds like one, and neither a document nor of a kind of page that never is one."""
    own = same_site(u, root) | netloc(u).rlike(IR_PLATFORM)
    likely = path(u).isin("", "/") | path(u).rlike(IR_PATH)
    return ~u.rlike(IR_MATERIAL) & ~u.rlike(NON_IR_PATH) & own & likely


def resolve(base: Column, ref: Column) -> Column:
    """The absolute address that a reference on a page of address ``base`` stands for; its fragment stays, dots are resolved."""
    return let(_parts(base), lambda b: _joined(b, F.trim(F.coalesce(ref, F.lit("")))))


def _joined(b: Column, ref: Column) -> Column:
    site = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    folder = F.when(b["path"] == "", "/").otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
    own = F.regexp_extract(ref, "^([^?#]*)", 1)
    rest = F.substring(ref, F.length(own) + 1, F.length(ref))
    asked = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise("")
    return (
        F.when(ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), ref))
        .when(own == "", F.concat(site, b["path"], F.when(rest.startswith("?"), rest).otherwise(F.concat(asked, rest))))
        .otherwise(F.concat(site, _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )


def _without_dots(p: Column) -> Column:
    """A path that begins with a slash, with its . and .. segments carried out."""
    segments = F.split(p, "/")
    n = F.size(segments)
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    step = lambda a, s: F.when(s["s"] == "..", up(a)).when(s["s"] == ".", a).otherwise(F.concat(a, F.array(s["s"])))
    kept = F.aggregate(F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (n > 1), "/").otherwise(""))


def clean_urls(urls: Column) -> Column:
    """Unwrapped http(s) addresses that are neither assets nor trackers, each once, in order."""
    bare = F.transform(urls, unwrap_markdown)
    return F.array_distinct(F.filter(bare, lambda u: u.startswith("http") & ~u.rlike(NON_EVENT) & ~u.rlike(TRACKER)))


def primary_url(urls: Column) -> Column:
    return F.get(F.filter(urls, lambda u: u.startswith("http") & ~u.rlike(TRACKER)), F.lit(0))


def event_key(title: Column, date: Column, urls: Column) -> Column:
    """Normalised title and date; without a title the first address's canonical form, or nothing."""
    from ledgerloom.functions.dates import norm_date
    from ledgerloom.functions.text import norm_title

    t = norm_title(title)
    return F.when(t != "", F.concat(t, F.lit("|"), norm_date(date))).otherwise(F.coalesce(canon_url(F.get(urls, F.lit(0))), F.lit("")))
