"""HTML: an element tree over the standard library's parser, with text, tables, images and meta data."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Elements without content worth keeping.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "svg", "form", "button", "input")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("attrs", "items", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.items = name, attrs or {}, []

    def walk(self):
        """All elements below, in document order."""
        stack = [x for x in reversed(self.items) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.items) if isinstance(x, Node)]

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def strings(self) -> list[str]:
        """Stripped texts below that are not empty; those of scripts, styles and templates don't count."""
        out, stack = [], [iter(self.items)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, Node):
                if x.name not in SILENT:
                    stack.append(iter(x.items))
            elif x.strip():
                out.append(x.strip())
        return out

    def without(self, names: frozenset[str]) -> None:
        stack = [self]
        while stack:
            node = stack.pop()
            node.items = [x for x in node.items if not (isinstance(x, Node) and x.name in names)]
            stack += [x for x in node.items if isinstance(x, Node)]


class _Builder(HTMLParser):
    """Unclosed elements stay open; an end tag closes up to the nearest open element of its name, or nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open, self.fresh = [self.root], True

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)
        self.fresh = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self.fresh = True
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        items = self.open[-1].items
        if self.fresh or not items or isinstance(items[-1], Node):
            items.append(data)
        else:
            items[-1] += data
        self.fresh = False

    def handle_comment(self, data):
        self.fresh = True

    def handle_decl(self, decl):
        self.fresh = True

    def unknown_decl(self, data):
        self.fresh = True

    def handle_pi(self, data):
        self.fresh = True


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def select(root: Node, selector: str) -> Node | None:
    """The first element for a selector of tag, #id and .class parts, with descendants after blanks."""
    found = [root]
    for part in selector.split():
        name = re.match(r"[\w-]*", part)[0].lower()
        ids, classes = re.findall(r"#([\w-]+)", part), re.findall(r"\.([\w-]+)", part)
        found = [n for f in found for n in f.walk() if (not name or n.name == name) and all(n.attrs.get("id") == i for i in ids) and set(classes) <= set(n.attrs.get("class", "").split())]
    return found[0] if found else None


def meta(root: Node) -> dict[str, str]:
    out = {}
    if titles := root.find("title"):
        out["title"] = "".join(titles[0].strings()) if len(titles[0].items) < 2 else " ".join(titles[0].strings())
    for m in root.find("meta"):
        key = m.attrs.get("name") or m.attrs.get("property")
        if key and m.attrs.get("content"):
            out[key] = m.attrs["content"]
    return out


def tables(root: Node) -> list[list[list[str]]]:
    """Cells by row by table; a nested table's rows are part of both tables."""
    found = [[["".join(c.strings()) for c in r.find("td", "th")] for r in t.find("tr")] for t in root.find("table")]
    return [rows for t in found if (rows := [r for r in t if r])]


def images(root: Node, base: str = "") -> list[dict[str, str]]:
    out = []
    for i in root.find("img"):
        if src := i.attrs.get("src", ""):
            out.append({"src": urljoin(base, src) if base and not src.startswith("http") else src, "alt": i.attrs.get("alt", "")})
    return out


def parse(html: str, url: str = "", selector: str | None = None, drop: tuple[str, ...] = (), with_tables: bool = True, with_images: bool = False) -> dict:
    root = tree(html)
    about = meta(root)
    if selector and (own := select(root, selector)):
        root = own
    root.without(frozenset((*DROPPED, *drop)))
    body = next(iter(root.find("body")), root)
    text = "\n".join(body.strings())
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n\s*\n\s*\n+", "\n\n", text))
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    found = tables(root) if with_tables else []
    about |= {"paragraphs_count": str(len(paragraphs)), "tables_count": str(len(found))}
    return {"text": text, "paragraphs": paragraphs, "tables": found, "images": images(root, url) if with_images else [], "metadata": about}
