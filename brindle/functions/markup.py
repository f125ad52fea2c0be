"""HTML as visible lines, as Markdown and as cleaned HTML.

A page is rendered as a browser would show it: a tree builder with implied end tags
and visibility rules yields every visible line with its kind (heading, text, list
item, table row, code, button), the links in it and the block it stands in. Text that
was turned into Markdown before is read into the same lines.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without visible text, elements of a place, block elements and what ends them unasked.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "select", "option", "textarea"}
ASIDE = {"nav", "aside", "footer", "header"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "header", "main", "nav", "ol", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "button", "dt", "dd", "caption", "summary"}
IMPLIED = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Words in class names and ids of elements beside the body.
CLASS_WORDS = re.compile(r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|breadcrumbs?|top-?bar|masthead|side-?bar|col-(?:right|left|side)|related|widget|footer|page-bottom|bottom-bar|cookies?|consent|banner|promo|share|social|newsletter)(?:$|[\s_-])", re.IGNORECASE)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\w[^>]*>|</?([a-zA-Z][\w-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_HEADING = re.compile(r"(#{1,6})\s+")
_BOLD = re.compile(r"\*\*[^*]+\*\*$")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_BEGUN_LINK = re.compile(r"(.*?)\[([^\[\]]+)\]?(?:\((\S*))?$")
_ENDED_LINK = re.compile(r"([^()\[\]]*)\]?\((https?:\S*)\)$")
_SPACES = re.compile(r"\s+")
_LINK = re.compile(r"\[([^\[\]]*)\]\(([^()\s]*)\)")


@dataclass
class Line:
    """A visible line: its number in the source, its text and what is known of its place."""

    no: int
    text: str = ""
    kind: str = "text"
    block: int = 0
    aside: bool = False
    links: list[tuple[str, str]] = field(default_factory=list)

    @property
    def link_only(self) -> bool:
        rest = self.text
        for text, _ in self.links:
            rest = rest.replace(text, "", 1)
        return bool(self.links) and not re.sub(r"[\W_]", "", rest)


def render(page: str) -> list[Line]:
    """The visible lines of an HTML page, one for each source line that shows anything (a table row's cells are joined by ` | `)."""
    lines: dict[int, Line] = {}
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
    hidden: list[str] = []
    kind, row, blocks, no, href, link = "text", 0, 0, 0, None, ""
    for m in _TOKEN.finditer(page):
        token, name = m.group(), m.group(1)
        start, no = no, no + token.count("\n")
        if name is None:
            if hidden or token[:1] == "<" and token[1:2] == "!":
                continue
            for k, part in enumerate(token.split("\n")):
                text = entities.unescape(part)
                if not text.strip():
                    if start + k in lines and part and not lines[start + k].text.endswith(" "):
                        lines[start + k].text += " "
                    continue
                line = lines.setdefault(start + k, Line(start + k, "", kind, stack[-1][1], stack[-1][2]))
                if row and line.text and line.kind == "row":
                    line.text = line.text.rstrip() + " | "
                    row = 0
                line.text += _SPACES.sub(" ", text)
                if kind != "text" and line.kind == "text":
                    line.kind = kind
                if href is not None:
                    link += text
            continue
        name, closing = name.lower(), token[1] == "/"
        if hidden:
            if closing and name == hidden[-1]:
                hidden.pop()
            elif not closing and name == hidden[-1] and not token.endswith("/>"):
                hidden.append(name)
            elif name == "body":
                hidden.clear()
            if hidden:
                continue
            if name in HIDDEN:
                continue
        attributes = {} if closing or not m.group(2) else {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m.group(2) or "")}
        if not closing and (name in HIDDEN or "hidden" in attributes or _UNSEEN.search(attributes.get("style", ""))):
            if name not in {"img", "input", "br", "hr", "meta", "link"}:
                hidden.append(name)
            continue
        if name == "a":
            if closing or href is not None:
                if href is not None and start in lines and link.strip():
                    lines[start].links.append((_SPACES.sub(" ", link).strip(), href))
                href, link = None, ""
            if not closing:
                href, link = attributes.get("href", ""), ""
        if name in LEAVES:
            if closing:
                kind = "row" if any(s[0] == "tr" for s in stack) else "text"
            else:
                kind = {"p": "text", "pre": "code"}.get(name, name if name[0] == "h" or name == "button" else "li" if name == "li" else "text")
        if name in BLOCKS:
            if closing:
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                if ends := IMPLIED.get(name):
                    while stack[-1][0] in ends:
                        stack.pop()
                blocks += name not in {"tr", "td", "th", "tbody", "thead", "tfoot"} or (name == "td" and stack[-1][0] == "tr" and not row)
                shows_body = stack[-1][2] is False and name in {"main", "article"}
                marked = name in ASIDE or bool(CLASS_WORDS.search(" ".join([attributes.get("class", ""), attributes.get("id", "")])))
                if attributes.get("role") in {"navigation", "banner", "contentinfo", "complementary"}:
                    marked = True
                stack.append((name, blocks, (stack[-1][2] or marked) and not shows_body))
                if name in {"td", "th"}:
                    row = 1
            if not stack:
                stack.append(("#page", 0, False))
            kind = "row" if stack[-1][0] in {"td", "th", "tr"} else "text"
            if name == "tr":
                row = 0
    for line in lines.values():
        line.text = line.text.strip()
    return [lines[n] for n in sorted(lines) if lines[n].text]


def read_markdown(text: str) -> list[Line]:
    """The lines of a page that was turned into Markdown."""
    out = []
    for no, raw in enumerate(text.split("\n")):
        t = raw.strip()
        if not t:
            continue
        kind = "text"
        if t[0] == "#" and (m := _HEADING.match(t)):
            kind, t = f"h{len(m.group(1))}", t[m.end() :]
        elif t[0] == "*" and _BOLD.match(t):
            kind, t = "h2", t[2:-2]
        elif m := _ITEM.match(t):
            kind, t = "li", t[m.end() :]
        elif t.startswith("|"):
            kind = "row"
        elif raw.startswith("    ") or t.startswith("```"):
            kind = "code"
        links = []
        if "[" in t or "](" in t:
            links = _LINK.findall(t)
            t = _LINK.sub(r"\1", t)
            if half := _BEGUN_LINK.match(t):
                links, t = [*links, (half.group(2), half.group(3) or "")], half.group(1) + half.group(2)
            elif not out and (half := _ENDED_LINK.match(t)):
                links, t = [(half.group(1), half.group(2))], half.group(1)
        out.append(Line(no, t.strip(), kind, 0, False, links))
    return out


def site_name(page: str) -> str:
    """What the page's title has behind its last bar: the name of the site."""
    m = re.search(r"<title[^>]*>([^<]*)", page, re.IGNORECASE)
    parts = re.split(r"\s[|–—]\s", entities.unescape(m.group(1)).strip()) if m else []
    return parts[-1].strip() if len(parts) > 1 else ""


def as_text(lines: list[Line]) -> str:
    """Rendered text: headings and blocks apart, list items marked, cells of neighbouring rows aligned."""
    out: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.kind == "row":
            rows = []
            while i < len(lines) and lines[i].kind == "row":
                rows.append([c.strip() for c in lines[i].text.strip("| ").split("|")])
                i += 1
            widths = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
            out.append("\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows))
            continue
        items = line.kind == "li" and i and lines[i - 1].kind == "li"
        text = "- " + line.text if line.kind == "li" else "#" * int(line.kind[1]) + " " + line.text if re.match(r"h\d", line.kind) else line.text
        if items:
            out[-1] += "\n" + text
        else:
            out.append(text)
        i += 1
    return "\n\n".join(out)


def looks_like_html(text: str) -> bool:
    return bool(re.search(r"<(?:!doctype|html|body|div|p|table|main)\b", text, re.IGNORECASE))


class _Markdown(HTMLParser):
    """Writes Markdown while a page is read: blocks are paragraphs apart, rows of a table are lines of cells."""

    QUIET = {"script", "style", "noscript", "template"}
    MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.links = base, [], {}
        self.quiet, self.pre, self.lists = 0, False, []
        self.anchor: tuple[str, int] | None = None
        self.cells, self.rows = None, 0

    def _apart(self, lines: int = 2) -> None:
        self.out.append("\n" * lines)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in self.QUIET:
            self.quiet += 1
        if self.quiet:
            return
        if tag == "a":
            self._end_link()
            self.anchor = ((given.get("href") or "").strip(), len(self.out))
        elif tag == "img":
            src = (given.get("src") or "").strip()
            self.out.append(f"![{given.get('alt') or ''}]({src if src.startswith(('data:', '#')) else urljoin(self.base, src)})" if src else "")
        elif tag == "br":
            self._apart(1)
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self._apart(0 if len(self.lists) > 1 else 2)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + mark)
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag in self.MARKS and not self.pre:
            self.out.append(self.MARKS[tag])
        elif tag == "table":
            self.rows = 0
            self._apart()
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cells = [] if self.cells is None else self.cells
            self.cells.append(len(self.out))
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in BLOCKS or tag == "p":
            self._apart()

    def handle_endtag(self, tag):
        if tag in self.QUIET:
            self.quiet = max(self.quiet - 1, 0)
            return
        if self.quiet:
            return
        if tag == "a":
            self._end_link()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._apart(1 if self.lists else 2)
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in self.MARKS and not self.pre:
            self.out.append(self.MARKS[tag])
        elif tag == "tr" and self.cells:
            ends = [*self.cells[1:], len(self.out)]
            row = [_SPACES.sub(" ", "".join(self.out[a:b])).strip() for a, b in zip(self.cells, ends)]
            del self.out[self.cells[0] :]
            self.rows += 1
            self.out.append("\n| " + " | ".join(row) + " |" + ("\n|" + " --- |" * len(row) if self.rows == 1 else ""))
            self.cells = None
        elif tag == "table" or tag in BLOCKS and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot") or tag == "p" or tag[0] == "h" and tag[1:].isdigit():
            self._apart()

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data if self.pre else _SPACES.sub(" ", data))

    def _end_link(self) -> None:
        if self.anchor is None:
            return
        href, at = self.anchor
        self.anchor = None
        text = _SPACES.sub(" ", "".join(self.out[at:])).strip()
        target = _target(href, self.base)
        del self.out[at:]
        if target:
            self.links.setdefault(target, text)
        self.out.append(f"[{text}]({target})" if target else text)

    def text(self) -> str:
        self._end_link()
        lines = [line.rstrip() if line.startswith("  ") else line.strip() for line in "".join(self.out).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _target(href: str, base: str) -> str:
    """A link's address made absolute; '' where it leads to no page."""
    if not href or href.startswith(("#", "mailto:", "javascript:")):
        return ""
    try:
        target = urljoin(base, href)
        return target if urlsplit(target).scheme in ("http", "https") else ""
    except ValueError:
        return ""


def markdown(page: str, base: str) -> tuple[str, list[tuple[str, str]]]:
    """(Markdown, links): headings with `#`, `-` lists, tables, images, links made absolute; links that lead to no page become their text.

    The links are (address, text), each address once, with its first text.
    """
    writer = _Markdown(base or "")
    writer.feed(page)
    writer.close()
    return writer.text(), list(writer.links.items())


_ADDRESSED = re.compile(r"(<(a|img)\b[^<>]*?\b(?:href|src)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)", re.IGNORECASE)
_QUIET = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)


def clean_html(page: str, base: str) -> str:
    """HTML without scripts, styles and the like, its links and images made absolute; `data:` and `#` addresses stay."""

    def absolute(m: re.Match) -> str:
        given = entities.unescape(m.group(3).strip("\"'")).strip()
        if m.group(2).lower() == "a":
            new = _target(given, base) or given
        else:
            new = given if given.startswith(("data:", "#")) else urljoin(base, given)
        return f'{m.group(1)}"{entities.escape(new)}"'

    return _ADDRESSED.sub(absolute, _QUIET.sub("", page))


def page_content(html: Column, base: Column, raw: bool = False) -> Column:
    """STRUCT<text, links> of each page: Markdown, or cleaned HTML with `raw`; the links are the same. Null for null."""

    @F.pandas_udf("text string, links array<struct<url: string, anchor: string>>")
    def content(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = []
        for page, at in zip(pages, bases):
            if page is None:
                rows.append((None, None))
                continue
            text, links = markdown(page, at or "")
            rows.append((clean_html(page, at or "") if raw else text, [{"url": u, "anchor": t} for u, t in links]))
        return pd.DataFrame(rows, columns=["text", "links"])

    return content(html, base)
