"""What Catalyst cannot express: Arrow-batched functions on HTML, Unicode forms, byte decoding and fuzzy windows."""

import html as html_lib
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd

from ledgerloom.functions.arrow import arrow
from ledgerloom.functions.urls import MARKDOWN_LINK

SKIPPED = frozenset({"script", "style", "noscript", "svg", "head", "template", "iframe"})
BLOCKS = frozenset({"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "blockquote", "main", "aside"})
#: Where a page's own text stands, what holds text of its own, and what is there on every page of a site.
MAIN = frozenset({"main", "article"})
PARAGRAPHS = frozenset({"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "dd", "dt", "pre"})
FRAME = frozenset({"nav", "header", "footer", "aside"})
#: A tier of the body ladder wins if it finds at least so many characters; the last one wins with any.
BODY_CHARS = 200


class _Inline(HTMLParser):
    """Text in reading order; anchors as [text](absolute address)."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.hidden, self.anchor = base, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self._close_anchor()
            self.anchor = (dict(attrs).get("href") or "", len(self.out))

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "a":
            self._close_anchor()
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def _close_anchor(self):
        if self.anchor is None:
            return
        href, at = self.anchor
        label = " ".join("".join(self.out[at:]).split())
        del self.out[at:]
        try:
            target = urljoin(self.base, href) if href else ""
        except ValueError:
            target = ""
        self.out.append(f" [{label}]({target}) " if target.startswith("http") else label)
        self.anchor = None


def inline_text(page: str | None, base: str | None) -> str:
    p = _Inline(base or "")
    p.feed(page or "")
    p.close()
    p._close_anchor()
    lines = (" ".join(line.split()) for line in "".join(p.out).split("\n"))
    return "\n".join(line for line in lines if line)


class _Part(_Inline):
    """Inline text of what stands inside ``within``, and not inside ``without``."""

    def __init__(self, base: str, within: frozenset[str], without: frozenset[str]):
        super().__init__(base)
        self.within, self.without, self.inside, self.outside = within, without, 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.within
        self.outside += tag in self.without
        if tag != "a" or (self.inside and not self.outside):
            super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.inside -= tag in self.within and self.inside > 0
        self.outside -= tag in self.without and self.outside > 0

    def handle_data(self, data):
        if self.inside and not self.outside:
            super().handle_data(data)


def _lines(parser: _Inline, page: str) -> str:
    parser.feed(page)
    parser.close()
    parser._close_anchor()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def extract_body(page: str | None, base: str | None, thin: bool = False) -> tuple[str, str]:
    """(tier, text) of the first reader that finds enough: main (the page's main part or article), paragraphs (blocks of
    text outside navigation and frames), inline (all text, whatever there is); empty if there is none or the page is thin."""
    if thin or not (page or "").strip():
        return "empty", ""
    for tier, within in (("main", MAIN), ("paragraphs", PARAGRAPHS)):
        body = _lines(_Part(base or "", within, FRAME), page)
        if len(body) >= BODY_CHARS:
            return tier, body
    body = inline_text(page, base)
    return ("inline", body) if body else ("empty", "")


class _Markdown(_Inline):
    """Markdown lines: headings, list items, paragraphs, and each table as a run of pipe rows with a rule row."""

    def __init__(self, base: str):
        super().__init__(base)
        self.cells: list[int] = []  # per open table: -1 before its first row, cells of that row, then -2
        self.inside_cell = False

    def handle_starttag(self, tag, attrs):
        n = len(self.out)
        super().handle_starttag(tag, attrs)
        if self.hidden:
            return
        del self.out[n:]
        if self.cells and tag in ("tr", "td", "th", "table"):
            self._end_cell()
        if tag == "table":
            self.cells.append(-1)
            self.out.append("\n\n")
        elif self.cells and tag == "tr":
            if self.cells[-1] > 0:
                self._rule()
            self.cells[-1] = max(self.cells[-1], 0) if self.cells[-1] != -2 else -2
            self.out.append("\n|")
        elif self.cells and tag in ("td", "th"):
            self.cells[-1] += self.cells[-1] >= 0
            self.inside_cell = True
            self.out.append(" ")
        elif tag in BLOCKS:
            mark = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""
            self.out.append(" " if self.cells else "\n" + ("\n" if tag not in ("li", "br") else "") + mark)

    def _end_cell(self):
        if self.inside_cell:
            self.out.append(" |")
        self.inside_cell = False

    def _rule(self):
        self.out.append("\n|" + "---|" * self.cells[-1])
        self.cells[-1] = -2

    def handle_endtag(self, tag):
        n = len(self.out)
        super().handle_endtag(tag)
        if self.hidden or tag == "a":
            return
        del self.out[n:]
        if self.cells and tag in ("td", "th", "tr", "table"):
            self._end_cell()
        if self.cells and tag == "table":
            if self.cells[-1] > 0:
                self._rule()
            self.cells.pop()
            self.out.append("\n\n")
        elif tag in BLOCKS and tag != "tr":
            self.out.append(" " if self.cells else "\n" if tag == "li" else "\n\n")

    def handle_data(self, data):
        super().handle_data(" ".join(data.split("\n")) if self.cells else data)


def markdown_of(page: str | None, base: str | None) -> str:
    p = _Markdown(base or "")
    p.feed(page or "")
    p.close()
    p._close_anchor()
    lines = [" ".join(line.split()) for line in "".join(p.out).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(line for line in lines if line != "|")).strip()


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.done = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"at": len(self.done) + len(self.open), "rows": [], "head": [], "cell": None})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            t = self.open[-1]
            if not t["rows"]:
                t["rows"].append([])
            t["rows"][-1].append("")
            t["head"].append((len(t["rows"]) - 1, tag == "th"))
            t["cell"] = True

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif tag == "table":
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and self.open[-1]["rows"][-1]:
            self.open[-1]["rows"][-1][-1] += data


def parse_tables(page: str | None) -> list[dict]:
    """Tables in order of their start: index, headers (a first row of header cells only) and rows of text."""
    p = _Tables()
    p.feed(page or "")
    p.close()
    out = []
    for t in sorted(p.done + p.open, key=lambda t: t["at"]):
        rows = [[" ".join(c.split()) for c in r] for r in t["rows"]]
        header = bool(rows) and bool(rows[0]) and all(is_head for r, is_head in t["head"] if r == 0)
        out.append({"table_idx": len(out), "headers": rows[0] if header else [], "rows": rows[1:] if header else rows})
    return out


def grounded(evidence: str | None, source: str | None) -> bool:
    """Whether a window of min(6, n) evidence words stands in the source, exactly or with one word changed; under 3 words never.

    Both are normalised words. A window with one changed word keeps one of its halves, so only places where a
    half occurs are compared.
    """
    e, s = (evidence or "").split(), (source or "").split()
    if len(e) < 3:
        return False
    n = min(6, len(e))
    places: dict[tuple, list[int]] = {}
    a, b = n // 2, n - n // 2
    for i in range(len(s)):
        for size in {a, b}:
            if i + size <= len(s):
                places.setdefault(tuple(s[i : i + size]), []).append(i)
    for at in range(len(e) - n + 1):
        w = e[at : at + n]
        starts = places.get(tuple(w[:a]), []) + [i - a for i in places.get(tuple(w[a:]), [])]
        for i in starts:
            if i >= 0 and i + n <= len(s) and sum(x != y for x, y in zip(w, s[i : i + n], strict=True)) <= 1:
                return True
    return False


def decode(raw: bytes | None, declared: str | None) -> str:
    """Declared charset, then one named in the page's head, then the usual ones; bytes that fit none as Latin-1."""
    raw = raw or b""
    named = re.search(rb"(?i)<meta[^>]+charset=[\"']?\s*([\w-]+)", raw[:4096])
    for charset in (declared, named and named[1].decode("ascii", "ignore"), "utf-8", "shift_jis", "euc_jp"):
        if charset:
            try:
                return raw.decode(charset)
            except (LookupError, UnicodeDecodeError):
                continue
    return raw.decode("latin-1")


def clean_title(t: str | None) -> str:
    s = " ".join(html_lib.unescape(t or "").split())
    s = re.sub(r"(?i)^microsoft (word|powerpoint|excel) - ", "", s)
    return re.sub(r"(?i)\.(docx?|pptx?|xlsx?|pdf)$", "", s).strip()


def split_text(t: str | None, target: int, overlap: int = 0) -> list[str]:
    """ceil(length / target) blocks, each cut at the last line end before its even share; blocks begin ``overlap`` early."""
    t = t or ""
    n = max(1, -(-len(t) // target))
    step, at, out = -(-len(t) // n) if t else 0, 0, []
    while at < len(t):
        end = min(len(t), at + step)
        if end < len(t):
            cut = t.rfind("\n", at + step // 2, end)
            end = cut + 1 if cut > 0 else end
        out.append(t[max(0, at - overlap) : end])
        at = end
    return out or [""]


def tag_links(t: str | None) -> tuple[str, dict[str, str]]:
    """[a](url) as [a](Ln), numbered by first appearance and reused per address; and what each number stands for."""
    known: dict[str, str] = {}

    def put(m: re.Match) -> str:
        return f"[{m[1]}]({known.setdefault(m[2], f'L{len(known) + 1}')})"

    out = re.sub(MARKDOWN_LINK, put, t or "")
    return out, {ref: url for url, ref in known.items()}


def overlap_join(pieces: list[str], least: int = 20) -> str:
    """Pieces end to end; where one starts with what the text ends with, the repeat is cut."""
    out = ""
    for p in pieces:
        for n in range(min(len(out), len(p)), least - 1, -1):
            if out.endswith(p[:n]):
                p = p[n:]
                break
        out += p
    return out


@arrow("string")
def html_inline(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([inline_text(p, b) for p, b in zip(page, base, strict=True)])


@arrow("struct<tier:string,body:string>")
def body_udf(page: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_body(p, b) for p, b in zip(page, base, strict=True)], columns=["tier", "body"])


@arrow("string")
def markdown_udf(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([markdown_of(p, b) for p, b in zip(page, base, strict=True)])


@arrow("array<struct<table_idx:int,headers:array<string>,rows:array<array<string>>>>")
def html_tables(page: pd.Series) -> pd.Series:
    return page.map(parse_tables)


@arrow("string")
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@arrow("boolean")
def grounded_udf(evidence: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([grounded(e, s) for e, s in zip(evidence, source, strict=True)])


@arrow("string")
def decode_udf(raw: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([decode(r, d) for r, d in zip(raw, declared, strict=True)])


@arrow("string")
def clean_title_udf(t: pd.Series) -> pd.Series:
    return t.map(clean_title)


@arrow("array<string>")
def split_text_udf(t: pd.Series, target: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([split_text(x, int(n), int(o)) for x, n, o in zip(t, target, overlap, strict=True)])


@arrow("struct<text:string,refs:map<string,string>>")
def tag_links_udf(t: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tag_links(x) for x in t], columns=["text", "refs"])


@arrow("string")
def overlap_join_udf(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda p: overlap_join(list(p)))
