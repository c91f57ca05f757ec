"""HTML to structured text, on the standard library's parser.

The parser reports tags as they come; the small tree built here closes what HTML lets authors
leave open (paragraphs, list items, table cells, void elements).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from sparkcorpus.functions.arrow import arrow

#: Subtrees that hold no content, by tag and by role.
NOISE = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "nav", "footer", "aside", "form", "button", "input", "select", "textarea")
NOISE_ROLES = ("navigation", "banner", "contentinfo", "search")
#: What a fetched page loses besides.
PAGE_NOISE_TAGS = ("header",)
PAGE_NOISE_CLASSES = ("nav", "menu", "sidebar", "comment", "advertisement")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("p", "div", "section", "article", "blockquote", "figure", "figcaption", "ul", "ol", "dl", "dt", "dd")
CONTENT_CLASSES = ("content", "article", "post", "entry-content", "article-content", "post-content", "main-content")
#: A start tag closes these open ones, up to the named container.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "thead": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
ENDS_PARAGRAPH = {*BLOCKS, "h1", "h2", "h3", "h4", "h5", "h6", "table", "pre", "hr", "nav", "footer", "aside", "form", "header", "main"} - {"figcaption"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def flat(self) -> str:
        """Its text as a reader sees it: white space collapsed."""
        return " ".join("".join(c if isinstance(c, str) else (" " if c.tag in ("br", *BLOCKS) else "") + c.text() for c in self.children).split())

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root", {}, None)

    def close_until(self, tags: tuple, stops: tuple) -> None:
        n, last = self.open, None
        while n is not self.root and n.tag not in stops:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.open = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self.close_until(("p",), ("table", "td", "th", "button"))
        if tag in CLOSES:
            self.close_until(*CLOSES[tag])
        node = Node(tag, dict(attrs), self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open.tag == tag and tag in ("svg", "path"):
            self.open = self.open.parent

    def handle_endtag(self, tag):
        n = self.open
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.open = n.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    bodies = b.root.find("body")
    if bodies:
        return bodies[0]
    for head in b.root.find("head"):
        head.parent.children.remove(head)
    return b.root


def prune(node: Node, page: bool = False) -> Node:
    def noise(n: Node) -> bool:
        return (
            n.tag in NOISE
            or n.attrs.get("role") in NOISE_ROLES
            or n.attrs.get("aria-hidden") == "true"
            or page
            and (n.tag in PAGE_NOISE_TAGS or any(c in PAGE_NOISE_CLASSES for c in n.classes()))
        )

    node.children = [c if isinstance(c, str) else prune(c, page) for c in node.children if isinstance(c, str) or not noise(c)]
    return node


def table_text(table: Node) -> str:
    heads = [r for t in table.find("thead") for r in t.find("tr")] or table.find("tr")
    head = heads[0] if heads else None
    names = [c.flat() for c in head.find("th", "td")] if head else []
    body = [r for t in table.find("tbody") for r in t.find("tr")] or [r for r in table.find("tr") if r is not head]
    out = ["**" + c.flat() + "**" for c in table.find("caption")[:1] if c.flat()]
    rows = []
    for r in body:
        cells = [(i, c.flat()) for i, c in enumerate(r.find("th", "td"))]
        line = "；".join(f"{names[i] if i < len(names) and names[i] else f'列{i + 1}'}：{v}" for i, v in cells if v)
        rows += [f"- {line}"] * bool(line)
    return "\n".join(out + (rows or ["- " + "；".join(names)] * bool(names)))


def render(node: Node, out: list[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif re.fullmatch("h[1-6]", c.tag):
            out.append("\n\n" + "#" * int(c.tag[1]) + " ")
            render(c, out)
            out.append("\n\n")
        elif c.tag in BLOCKS:
            out.append("\n\n")
            render(c, out)
            out.append("\n\n")
        elif c.tag == "li":
            out.append("\n- ")
            render(c, out)
        elif c.tag == "table":
            out.append(f"\n\n{table_text(c)}\n\n")
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "hr":
            out.append("\n\n---\n\n")
        elif c.tag == "pre":
            out.append(f"\n\n```\n{c.text().strip()}\n```\n\n")
        elif c.tag == "code":
            out.append(f"`{c.text().strip()}`")
        else:
            render(c, out)


def tidy(text: str) -> str:
    text = text.replace(" ", " ").replace("　", " ")
    text = re.sub(r"[ \t\x0b\f]+\n", "\n", text)
    text = re.sub(r"[ \t]{2,}", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_text(html: str | None, page: bool = False) -> str:
    """The text of a document; with `page`, of the content part of a fetched page."""
    if not html or not html.strip():
        return ""
    body = prune(parse(html), page)
    out: list[str] = []
    render(content_root(body) if page else body, out)
    return tidy("".join(out))


def content_root(body: Node) -> Node:
    """The first of article, main, role=main and an element of a content class or id; else all."""
    nodes = list(body.walk())
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.attrs.get("id") == "content" or any(c in CONTENT_CLASSES for c in n.classes())):
        found = next((n for n in nodes if test(n)), None)
        if found is not None:
            return found
    return body


def title_of(html: str | None) -> str:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    return " ".join(m.group(1).split()) if m else ""


@arrow("string")
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(to_text)


@arrow("string")
def page_to_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: to_text(h, page=True)[:60_000])


#: Where three kinds of result pages keep their hits (tag, class of the item; tag, class of the snippet).
RESULT_PAGES = {"so": (("li", "res-list"), ("p", "res-desc")), "bing": (("li", "b_algo"), ("p", None)), "sogou": (("div", "vrwrap"), ("p", None))}


def search_hits(html: str | None, backend: str, most: int = 10) -> list[dict]:
    """(title, url, snippet) of a result page; one hit a URL."""
    (tag, cls), (snip, snip_cls) = RESULT_PAGES[backend]
    out, seen = [], set()
    for item in [n for n in parse(html or "").walk() if n.tag == tag and cls in n.classes()]:
        link = next((a for h in item.find("h2", "h3") for a in h.find("a") if a.attrs.get("href")), None)
        if link is None:
            continue
        url = link.attrs.get("data-mdurl") or link.attrs["href"]
        if not url.startswith("http") or url in seen:
            continue
        seen.add(url)
        text = next((p.flat() for p in item.find(snip) if snip_cls is None or snip_cls in p.classes()), "")
        out.append({"title": link.flat(), "url": url, "snippet": text})
    return out[:most]


def hits_column(backend: str, most: int = 10):
    @arrow("array<struct<title:string,url:string,snippet:string>>")
    def hits(html: pd.Series) -> pd.Series:
        return html.map(lambda h: search_hits(h, backend, most))

    return hits
