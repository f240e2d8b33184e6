"""URLs, identifiers, HTML: column expressions where they suffice, batched Python where a tree is needed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import trimmed

#: fixed values: query names that only track
TRACKING = (
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "gad_source", "msclkid", "twclid", "ttclid", "li_fat_id", "yclid", "igshid", "igsh", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "__hstc", "__hssc", "__hsfp", "hsctatracking", "mkt_tok", "elqtrackid", "elqtrack", "elqaid", "elqat", "elqcampaignid", "_ga", "_gl", "_branch_match_id",
    "oly_anon_id", "oly_enc_id", "vero_id", "vero_conv", "wickedid", "s_kwcid", "ef_id", "s_cid", "smid", "smtyp", "cmp", "cmpid", "ncid", "ocid", "xtor", "at_medium", "at_campaign",
    "ref_src", "ref_url", "__twitter_impression", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source", "action_object_map", "action_type_map", "action_ref_map",
    "guccounter", "guce_referrer", "guce_referrer_sig", "usqp", "amp_js_v", "amp_gsa", "amp_ct", "amp_tf", "aoh",
)
TRACKING_PREFIX = "utm_"
#: public suffixes of two labels under which anyone may register; ``suffix_rules`` reads the whole public list
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.br", "gov.br", "net.br", "org.br", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.za", "co.za", "gov.za", "org.za", "co.kr", "go.kr", "or.kr",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.mx", "gob.mx", "org.mx", "com.ar", "com.tr", "gov.tr", "com.sg", "edu.sg", "com.hk", "com.tw", "co.il", "com.ua", "github.io", "blogspot.com",
)
#: fixed values: parameters that only ask for the AMP form, with the values that do
AMP = {"amp": ("", "1", "true"), "outputtype": ("amp",)}
MOBILE = ("m.", "amp.", "mobile.")


def is_tracking(name: str) -> bool:
    return name.lower().startswith(TRACKING_PREFIX) or name.lower() in TRACKING


def is_tracking_column(name: Column) -> Column:
    return F.lower(name).startswith(TRACKING_PREFIX) | F.lower(name).isin(*TRACKING)


def _no_dots(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out[1:] and out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out) or "/"


def canonical(url: str | None) -> str | None:
    """One spelling of a URL; applying it again changes nothing. None for what is not http(s)."""
    for _ in range(8):  # a wrapper's target may itself be wrapped
        try:
            u = urlsplit((url or "").strip())
            port = u.port
        except ValueError:
            return None
        if u.scheme.lower() not in ("http", "https") or not u.hostname:
            return None
        pairs = parse_qsl(u.query, keep_blank_values=True)
        target = next((v for k, v in pairs if k in ("url", "u", "q") and u.path in ("/url", "/l.php") and v.startswith("http")), None)
        if not target:
            break
        url = target
    host = u.hostname.lower()
    try:
        host = host.encode("idna").decode("ascii")
    except UnicodeError:
        pass
    for prefix in MOBILE:
        if host.startswith(prefix) and host.count(".") >= 2:
            host = host[len(prefix) :]
            break
    if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    path = _no_dots(quote(unquote(u.path), safe="/:@!$&'()*+,;=~-._")) if u.path else "/"
    for ending in ("/amp", "/amp/"):
        if path.endswith(ending) and len(path) > len(ending):
            path = path[: -len(ending)] or "/"
            break
    kept = sorted((p for p in pairs if not is_tracking(p[0]) and p[1].lower() not in AMP.get(p[0].lower(), ())), key=lambda p: p[0])
    return urlunsplit((u.scheme.lower(), host, path, urlencode(kept), ""))


@F.pandas_udf(T.StringType())
def canonicalize_url(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(canonical)


def canonical_simple(url: Column) -> Column:
    """The same by built-in functions for URLs without escapes, wrappers, ports or dot segments."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when(F.regexp_count(host, F.lit(r"\.")) >= 2, F.regexp_replace(host, r"^(m|amp|mobile)\.", "")).otherwise(host)
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    names = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~is_tracking_column(F.regexp_extract(p, "^([^=]*)", 1)))
    kept = F.array_join(F.array_sort(names), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def suffix_rules(text: str) -> dict[str, tuple[str, ...]]:
    """Plain rules, wildcards and exceptions of the public suffix list in its published format."""
    out: dict[str, list[str]] = {"plain": [], "wild": [], "except": []}
    for line in text.splitlines():
        rule = line.split("//")[0].strip().lower()
        if rule:
            kind = "except" if rule[0] == "!" else "wild" if rule.startswith("*.") else "plain"
            out[kind].append(rule.removeprefix("!").removeprefix("*."))
    return {k: tuple(v) for k, v in out.items()}


def registrable_by_rules(host: str | None, rules: dict[str, tuple[str, ...]]) -> str | None:
    """One label more than the longest public suffix of a host; None for addresses, empty labels and bare suffixes."""
    labels = (host or "").lower().rstrip(".").split(".")
    if "" in labels or ":" in host or labels[-1].isdigit():
        return None
    tails = [".".join(labels[i:]) for i in range(len(labels))] + [""]
    size = next((len(labels) - i - 1 for i, t in enumerate(tails[:-1]) if t in rules["except"]), None)
    if size is None:
        size = max((len(labels) - i for i in range(len(labels)) if tails[i] in rules["plain"] or tails[i + 1] and tails[i + 1] in rules["wild"]), default=1)
    return tails[len(labels) - size - 1] if size < len(labels) else None


def registrable_domain(host: Column) -> Column:
    """The part of a host that someone registered: one label more than the public suffix."""
    labels = F.split(F.lower(host), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*SUFFIXES), three).otherwise(two)


def doi(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)), r"[.,;)]+$", "")


def arxiv(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)arxiv(?:\.org/abs/|:)\s*([0-9]{4}\.[0-9]{4,5})", 1)


def pmid(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(?:pmid:?\s*|pubmed/)([0-9]{5,9})", 1)


def plain_title(html: Column) -> Column:
    """The text of a page's first plain title element, null where it is empty; of references only the three with a semicolon are read, as others are cut ones."""
    text = trimmed(F.regexp_replace(F.regexp_extract(html, "<title>([^<]*)</title>", 1), r"[\t\n\f\r ]+", " "))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.nullif(text, F.lit(""))


def content_kind(body: Column) -> Column:
    """The kind of a binary by its first bytes."""
    head = F.hex(F.substring(body, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("1F8B"), "gzip")
        .when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg")
        .when(F.lower(F.substring(F.decode(F.substring(body, 1, 64), "UTF-8"), 1, 15)).rlike("^<(!doctype html|html)"), "html").otherwise("unknown")
    )


#: parts of a page that are not its main text, and the least main text that counts
AROUND = {"nav", "header", "footer", "aside", "form", "menu"}
MAIN = {"main", "article"}
LEAST_MAIN = 200
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "pre", "section", "article", "main", "header", "footer", "nav", "ul", "ol", "table", "tr", "body", "figcaption", "dd", "dt"}
DROPPED = {"script", "style", "noscript", "template", "title", "head"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr"}


class _Page(HTMLParser):
    """Text of leaf blocks, meta values, JSON-LD, and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.dropped, self.blocks, self.meta, self.ld, self.title, self.canonical = 0, [], {}, [], "", None
        self.keep: str | None = None
        self.inside: list[str] = []  # open parts of AROUND and MAIN
        self.where: list[tuple[bool, bool]] = []  # of each block, whether it is in a main part, and around it

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name and "content" in a:
                self.meta.setdefault(name.lower(), a["content"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href")
        elif tag in ("title",) or tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.keep = "title" if tag == "title" else "ld"
        if tag in AROUND or tag in MAIN:
            self.inside.append(tag)
        if tag in DROPPED and tag != "head":
            self.dropped += 1
        elif tag in BLOCKS:
            if self.open:
                self.open[-1][2] = True
            self.open.append([tag, [], False])
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")

    def handle_endtag(self, tag):
        self.keep = None if tag in ("title", "script") else self.keep
        if tag in DROPPED and tag != "head":
            self.dropped = max(0, self.dropped - 1)
        elif tag in BLOCKS:
            while self.open:
                name, parts, inner = self.open.pop()
                text = " ".join("".join(parts).split())
                if text and not inner:
                    self.blocks.append(text)
                    self.where.append((any(x in MAIN for x in self.inside), any(x in AROUND for x in self.inside)))
                if name == tag:
                    break
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def main_blocks(self) -> list[str]:
        """Blocks of the main part; where they are short, those that are not around it; where these are short, the longer of both."""
        marked = [b for b, (main, around) in zip(self.blocks, self.where, strict=True) if main and not around]
        if sum(map(len, marked)) >= LEAST_MAIN:
            return marked
        return max([b for b, (_, around) in zip(self.blocks, self.where, strict=True) if not around], marked, key=lambda x: sum(map(len, x)))

    def handle_data(self, data):
        if self.keep == "title":
            self.title += data
        elif self.keep == "ld":
            self.ld.append(data)
        if not self.dropped and self.open:
            self.open[-1][1].append(data)


def json_nodes(value) -> Iterator[dict]:
    """Every object inside a JSON value, outermost first."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from json_nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from json_nodes(v)


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.open:
        page.handle_endtag(page.open[-1][0])
    nodes = []
    for text in page.ld:
        try:
            nodes += json_nodes(json.loads(text))
        except ValueError:
            continue
    paid = any(str(n.get("isAccessibleForFree", "")).lower() == "false" for n in nodes)
    first = lambda *names: next((page.meta[n].strip() for n in names if page.meta.get(n, "").strip()), None)
    return {
        "text": "\n".join(page.blocks), "title": first("og:title") or " ".join(page.title.split()) or None, "author": first("author", "article:author"),
        "published": first("article:published_time", "date"), "canonical": page.canonical, "paywalled": paid, "types": [str(n["@type"]) for n in nodes if "@type" in n],
        "visible_chars": sum(len(b) for b in page.blocks), "blocks": len(page.blocks), "main": "\n".join(page.main_blocks()),
    }


PAGE = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in ("text", "title", "author", "published", "canonical")), T.StructField("paywalled", T.BooleanType()),
     T.StructField("types", T.ArrayType(T.StringType())), T.StructField("visible_chars", T.IntegerType()), T.StructField("blocks", T.IntegerType()), T.StructField("main", T.StringType())]
)


@F.pandas_udf(PAGE)
def page_content(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Leaf-block text, metadata with fallbacks, paywall flag and JSON-LD types of HTML pages."""
    names = PAGE.names
    for batch in batches:
        yield pd.DataFrame([read_page(x) for x in batch], columns=names)
