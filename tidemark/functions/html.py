"""A small reader of HTML for extraction: elements with classes, attributes and text, by the standard library's parser."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def walk(self):
        """The elements below, in document order, without recursion."""
        stack = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.parts))
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in ("script", "style"):
                stack.extend(reversed(p.parts))
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.parts.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def read(html: str) -> Node:
    r = _Reader()
    r.feed(html)
    r.close()
    return r.root


def absolute(base: str | None, href: str | None) -> str | None:
    if not href:
        return None
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def first_text(v) -> str | None:
    while isinstance(v, list):
        v = v[0] if v else None
    return (v.strip() or None) if isinstance(v, str) else None


def event_nodes(value, keys=("@graph", "itemListElement", "item"), named: bool = False) -> list[dict]:
    """Objects of a JSON-LD value whose type names an event, however deep under the given keys."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            kind = v.get("@type")
            kind = " ".join(map(str, kind)) if isinstance(kind, list) else str(kind or "")
            if "event" in kind.lower() and (v.get("name") or not named):
                out.append(v)
            stack.extend(v[k] for k in reversed(keys) if v.get(k))
    return out


def place(v) -> tuple[str | None, str | None]:
    """Venue and address of a location: a string, a list or an object."""
    while isinstance(v, list):
        v = v[0] if v else None
    if isinstance(v, str):
        return v or None, None
    if not isinstance(v, dict):
        return None, None
    a = v.get("address")
    if isinstance(a, dict):
        a = ", ".join(filter(None, (first_text(a.get(k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode"))))
    return first_text(v.get("name")), a if isinstance(a, str) and a else None


def price_of(v) -> str | None:
    """Price of the first offer: Free for 0 and for an empty text, with $ for US dollars."""
    v = v[0] if isinstance(v, list) and v else v
    if not isinstance(v, dict):
        return None
    p = v.get("price", v.get("lowPrice")) if v.get("price") is not None else v.get("lowPrice")
    if p is None:
        return None
    try:
        if isinstance(p, str) and not p.strip() or float(p) == 0:
            return "Free"
    except (TypeError, ValueError):
        pass
    return f"{'$' if first_text(v.get('priceCurrency')) == 'USD' else ''}{p}"


def json_values(raw: str) -> list:
    """The JSON values of a script; several in a row are read one by one, and what can't be read is left out."""
    out, decoder, at = [], json.JSONDecoder(), 0
    while at < len(raw):
        m = re.compile(r"[\[{]").search(raw, at)
        if not m:
            break
        try:
            v, at = decoder.raw_decode(raw, m.start())
            out.append(v)
        except ValueError:
            at = m.end()
    return out


def json_ld(root: Node, base: str | None, strict: bool = True) -> list[dict]:
    """Records of a page's JSON-LD. `strict`: a script that is not one JSON value is skipped, else salvaged."""
    out = []
    for n in root.walk():
        if n.tag == "script" and (n.attrs.get("type") or "").lower() == "application/ld+json":
            raw = "".join(p for p in n.parts if isinstance(p, str))
            try:
                values = [json.loads(raw)]
            except ValueError:
                values = [] if strict else json_values(raw)
            for v in values:
                for e in event_nodes(v) if strict else event_nodes(v, ("@graph", "itemListElement", "item", "subEvent", "mainEntity"), True):
                    venue, address = place(e.get("location"))
                    start = first_text(e.get("startDate"))
                    out.append({"title": first_text(e.get("name")), "date": start, "start_time": start, "end_time": first_text(e.get("endDate")), "venue": venue, "address": address, "description": first_text(e.get("description")), "image_url": absolute(base, first_text(e.get("image"))), "source_url": absolute(base, first_text(e.get("url"))) or base, "price": price_of(e.get("offers"))})
    return out


def _prop(node: Node, name: str) -> Node | None:
    return next((n for n in node.walk() if n.attrs.get("itemprop") == name), None)


def _strip(n: Node | None) -> str | None:
    return (n.text().strip() or None) if n is not None else None


def microdata(root: Node, base: str | None) -> list[dict]:
    out = []
    for el in root.walk():
        if "schema.org/Event" in (el.attrs.get("itemtype") or ""):
            title = _strip(_prop(el, "name")) or _strip(next((n for n in el.walk() if n.tag in ("h1", "h2", "h3")), None))
            if not title:
                continue
            s = _prop(el, "startDate")
            start = (s.attrs.get("content") or s.attrs.get("datetime") or _strip(s)) if s is not None else None
            img, a = _prop(el, "image"), next((n for n in el.walk() if n.tag == "a"), None)
            out.append({"title": title, "date": start, "start_time": start, "venue": _strip(_prop(el, "location")), "description": _strip(_prop(el, "description")), "image_url": absolute(base, img.attrs.get("src")) if img is not None else None, "source_url": (absolute(base, a.attrs.get("href")) if a is not None else None) or base})
    return out


#: What looks like a listing entry, and like a date.
ENTRY_CLASSES = frozenset(("event", "event-item", "events-list-item", "eventitem"))
ENTRY_PARTS = ("event-card", "calendar-event")
DATE_LIKE = re.compile(r"\b(\d{4}-\d{2}-\d{2}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}|\d{1,2}/\d{1,2}(/\d{2,4})?)\b", re.I)


def is_entry(n: Node, tag: str | None = None) -> bool:
    """An element that looks like a listing entry; `tag` asks for elements of that name instead."""
    if tag:
        return n.tag == tag
    return bool(ENTRY_CLASSES & set(n.classes())) or any(p in (n.attrs.get("class") or "") for p in ENTRY_PARTS)


def heuristic(root: Node, base: str | None, tag: str | None = None) -> list[dict]:
    out, seen = [], set()
    for el in root.walk():
        if not is_entry(el, tag):
            continue
        inside = list(el.walk())
        head = next((n for n in inside if n.tag in ("h1", "h2", "h3", "h4") or "title" in (n.attrs.get("class") or "")), None)
        a, img = (next((n for n in inside if n.tag == t), None) for t in ("a", "img"))
        title = _strip(head) or _strip(a)
        if not title or len(title) > 200 or title.lower() in seen:
            continue
        seen.add(title.lower())
        text = " ".join(el.text().split())
        m = DATE_LIKE.search(text)
        out.append({"title": title, "date": m[0] if m else None, "description": text[:500], "image_url": absolute(base, img.attrs.get("src")) if img is not None else None, "source_url": (absolute(base, a.attrs.get("href")) if a is not None else None) or base})
    return out
