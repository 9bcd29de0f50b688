"""Leaf blocks of an HTML page: the runs of text between block-level tags, with what their ancestors are.

The parser is lenient and linear in the page's length: missing end tags are implied, stray ones ignored, and
inline tags other than links, those of formulas and drawings among them, leave no trace. An element hands its features down to its children, so no block
walks up the tree.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|</?[a-zA-Z][^<>]*+\Z",  # a quote that is never closed ends with its tag
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Elements whose content is no markup; none of it is text of the page, but for that of LITERAL.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp", "plaintext")}
LITERAL = {"xmp", "plaintext"}
#: Controls of forms and templates: no text of the page, and no break in the text around them.
SKIPPED = {"template", "select", "button", "datalist"}
BLOCK = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup ins legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = {"article", "aside", "footer", "form", "header", "main", "nav"}
#: A start tag ends an open element of these kinds, unless one of the bounds is open inside it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}


@dataclass(frozen=True)
class Context:
    """What a block inherits: features of all ancestors and of the innermost that has a name or is a section, the section
    (the last two, as a path), whether its text is left out, the label of training pages."""

    names: frozenset[str] = frozenset()
    near: frozenset[str] = frozenset({"near:none"})
    inner: str = "body"
    skip: bool = False
    main: bool = False


@dataclass
class Block:
    text: str
    tag: str
    linked: float  # share of its characters in links
    context: Context


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _inside(parent: Context, tag: str, attrs: str) -> Context:
    new = {f"in:{tag}"} if tag in BLOCK and tag != "div" else set()
    own = {f"near:{tag}"} if tag in SECTIONS else set()
    inner, skip, main = (f"{parent.inner.rpartition('>')[2]}>{tag}" if tag in SECTIONS else parent.inner), parent.skip or tag in SKIPPED, parent.main
    if attrs.strip():
        a = _attributes(attrs)
        words = [w.lower() for key in ("class", "id") for w in NAME.findall(a.get(key, ""))]
        new |= {f"name:{w}" for w in words}
        own |= {f"near:{w}" for w in words}
        if role := a.get("role"):
            new.add(f"role:{role.lower()}")
            own.add(f"near:{role.lower()}")
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            new.add("hidden")
        main = {"1": True, "0": False}.get(a.get("data-main", ""), main)
    if not own and new <= parent.names and (skip, main) == (parent.skip, parent.main):
        return parent
    return Context(parent.names | new, frozenset(own) or parent.near, inner, skip, main)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones; character references are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, Context]] = [("body", Context())]
    open_at: dict[str, list[int]] = {}  # of each tag the places of its open elements in the stack
    parts: list[str] = []
    linked, link = 0, 0  # characters in links; depth of the open link's block, 0 without one
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            if text := " ".join(html.unescape(raw).split()):
                out.append(Block(text, stack[-1][0], min(1.0, linked / max(1, len(raw.strip()))), stack[-1][1]))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal link
        open_at[stack.pop()[0]].pop()
        link = 0 if len(stack) < link else link

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][1].skip:
            parts.append(text)
            linked += len(text.strip()) if link else 0

    def push(tag: str, attrs: str) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, _inside(stack[-1][1], tag, attrs)))

    def innermost(tags: set[str]) -> int:
        return max((places[-1] for t in tags if (places := open_at.get(t))), default=0)

    def close(tags: set[str], bounds: set[str]) -> None:
        while (k := innermost(tags)) > innermost(bounds):
            while len(stack) > k:
                pop()

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        ends, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if not ends and tag in RAW:
            end = RAW[tag].search(page, at)
            content = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag in LITERAL:
                flush()
                push("pre", attrs)
                add(html.escape(content))
                flush()
                pop()
        elif tag == "a":
            link = 0 if ends else len(stack)
        elif tag == "br":
            add(" ")
        elif tag == "hr":
            flush()
        elif tag == "body" and not ends:
            stack[0] = ("body", _inside(stack[0][1], tag, attrs))
        elif tag in BLOCK or tag in SKIPPED:
            if tag in BLOCK:
                flush()
            if ends:
                if open_at.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif not (tag in SKIPPED and attrs.rstrip().endswith("/")):
                if tag in BLOCK and open_at.get("p"):
                    close({"p"}, {"table", "td", "th"} - {tag})
                if tag in IMPLIED:
                    close(*IMPLIED[tag])
                push(tag, attrs)
    add(page[at:])
    flush()
    return out
