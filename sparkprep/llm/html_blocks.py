"""Leaf blocks of raw HTML: text between block-level tags, with its tag path."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?<=/>)"  # closed by itself
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object)(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
                    "strong sub sup time tt u var br wbr img".split())
#: Opening one of these ends an open element of the same kind.
_ALONE = frozenset("p li dt dd tr td th option".split())


def _parts(attrs: str) -> list[str]:
    out: list[str] = []
    for m in _NAMED.finditer(attrs):
        out += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return out


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order.  ``path``: tags and parts of class, id and
    role names from the outside in; ``linked``: characters inside links.  Scripts,
    styles, comments and markup are left out, character references decoded, white
    space folded.  Unclosed and stray tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    pieces: list[str] = []
    linked = 0
    path: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal pieces, path, linked
        if path is not None:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(path, text, linked))
        pieces, path, linked = [], None, 0

    def add(text: str) -> None:
        nonlocal path, linked
        if not text:
            return
        if path is None and not text.isspace():
            path = tuple(x for tag, names in stack for x in (tag, *names))
        pieces.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            pieces.append(" ")
        if tag not in _INLINE:
            flush()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag not in _INLINE and tag not in _VOID:
            # a new block ends an open paragraph; some elements end their own kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (tag in _ALONE and stack[i][0] == tag):
                    del stack[i:]
                    break
                if stack[i][0] not in _INLINE:
                    break
        if tag not in _VOID:
            stack.append((tag, _parts(m["attrs"] or "")))
    add(page[at:])
    flush()
    return out
