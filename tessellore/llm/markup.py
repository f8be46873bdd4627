"""Documents with residues of HTML, wiki, LaTeX and doc-hub markup as clean structured text.

A text is cut into flat blocks: fenced code as it stands, and the stretches between blank lines; a
construct that runs over blank lines (a comment, template, table, environment or hub block) holds its
block together. Every block is measured as it stands in the source, before anything is converted: its
number of words, the share of them that stand in links of any syntax, and its number of marks that could
begin a construct. A decision tree, trained on the small labelled table below, looks at these figures of
the block and at words and link density of its neighbours and tells three classes: plain content, which
is passed on as it is; content with markup, in which the constructs of the four families are looked for
and converted, so that headings, lists, tables, code and formulas stay (as Markdown) and the rest of the
markup goes; and boilerplate (navigation, legal lines, reading aids), of which only headings, code and
formulas are kept. The families of a text are those found in its blocks.

Defined results: null and blank texts give no blocks and the clean text ""; a fence that is not
closed runs to the end of the text, as does an unclosed comment; an unreadable block body is kept as
code; repeated rows are cleaned alike. Only the named columns are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "wiki", "latex", "block")

# The element names of HTML, current and obsolete.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button "
    "canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe "
    "img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol "
    "optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr "
    "track tt u ul var video wbr".split()
)
# The behaviour switches of MediaWiki.
MAGIC = (
    "NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY "
    "NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC START END INDEX NOINDEX STATICREDIRECT DISAMBIG NOGLOBAL ARCHIVEDTALK NOTALK"
).split()

ATTRIBUTES = r"""(?:\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|\{[^{}<>]*\}|[^\s"'=<>`{}]+))?)*\s*/?"""
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9.]*)({ATTRIBUTES})>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype\b[^<>]*>|<\?xml\b[^<>]*\?>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
BLOCK_TAG = re.compile(r"(?<!\\)\[/?block(?::[\w-]+)?\]", re.I)

LINK = re.compile(r"\[\[(?=[^\s\[\]])(?![\d\s,.-]*\]\])([^\[\]\n]+)\]\]")
EXTERNAL = re.compile(r"(?<!\[)\[((?:https?|ftp)://[^\s\[\]]+)[^\S\n]+([^\[\]\n]+)\](?!\()")
TEMPLATE = re.compile(r"\{\{(?!\s*[a-z]+[A-Z_.]\w*\s*\}\})((?:[^{}]|\{\{[^{}]*\}\}|\{(?!\{)|\}(?!\}))*)\}\}")
CALL_CUT_OFF = re.compile(r"\{\{(?:#\w+:|Infobox\b|[A-Z]\w*\|)")
HEADING = re.compile(r"^[ ]{0,3}(={2,6})[^\S\n]*([^=\s](?:[^\n]*?[^=\s])?)[^\S\n]*\1[^\S\n]*$|^(=)[^\S\n]+([^=\n]*[^=\s])[^\S\n]+=[^\S\n]*$", re.M)
WIKI_TABLE = re.compile(r"^[^\S\n]*(?:\{\|[^\n]*|\|\}(?!\}))", re.M)
QUOTES = re.compile(r"(?<!')('{5}|'{2,3})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
MAGIC_WORD = re.compile(rf"__(?:{'|'.join(MAGIC)})__", re.I)
SIGNATURE = re.compile(r"(?<!~)~{3,5}(?!~)")

COMMAND = re.compile(r"(?<![\\\w:])\\[A-Za-z]{2,}\*?(?!\w*\\\w)")
WRAPPED = re.compile(r"~?(?<![\\\w:])\\[A-Za-z]{2,}\*?(?!\w*\\\w)(?:\[[^\[\]\n]*\])?\{([^{}]*)\}")
ENVIRONMENT = re.compile(r"(?<!\\)\\(?:begin|end)\s*\{[A-Za-z]+\*?\}", re.I)
DISPLAY = re.compile(r"(?<![\\$])\$\$(?!\$)((?:[^$\n]|\n(?!\s*\n))+?)\$\$(?!\$)|(?<!\\)\\\[((?:[^\n]|\n(?!\s*\n))+?)\\\]")
INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\w$])|(?<!\\)\\\(((?:[^\n])+?)\\\)")
OPERATOR = re.compile(r"[\\^_=<>+*/(){}|]")

FENCE = re.compile(r"^(?:[ ]{0,3}|[ ]*(?:>[ ]?)+)(`{3,}|~{3,})([^\n]*)$", re.M)
CODE_SPAN = re.compile(r"(?<![\\`])(`+)(?!`)((?:[^`\n]|\n(?!\s*\n)|(?!\1(?!`))`+)*?[^`])\1(?!`)")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)")
TRIGGER = re.compile(r"[<&\[{=\\$]|''|__|~~~")
WORDS = re.compile(r"\w+")
HIDDEN = "\x01"


# --- finding constructs ----------------------------------------------------------------------------


def split_code(text: str) -> list[tuple[bool, int, int]]:
    """(is fenced code, start, end) of the text's stretches."""
    out, at, open_ = [], 0, None
    for m in FENCE.finditer(text):
        mark, info = m[1], m[2]
        if open_ is None:
            if mark[0] == "`" and "`" in info:
                continue
            if m.start() > at:
                out.append((False, at, m.start()))
            open_, at = mark, m.start()
        elif mark[0] == open_[0] and len(mark) >= len(open_) and not info.strip():
            out.append((True, at, m.end()))
            open_, at = None, m.end()
    if at < len(text):
        out.append((open_ is not None, at, len(text)))
    return out


def hide_spans(text: str) -> str:
    """The text with its inline code made unreadable, length unchanged."""
    return CODE_SPAN.sub(lambda m: HIDDEN * len(m[0]), text) if "`" in text else text


def is_element(name: str) -> bool:
    """Whether a tag's name is an HTML element's: mixed case is left to components."""
    return name.lower() in ELEMENTS and (name.islower() or name.isupper())


def is_component(m: re.Match, whole: str | None = None) -> bool:
    """Whether a tag is a component's: capital initial, and no type argument or placeholder (which ``whole`` closes nowhere)."""
    closing, name, attributes = m.groups()
    if not name[0].isupper() or is_element(name):
        return False
    if closing:
        return True
    before = m.string[m.start() - 1] if m.start() else " "
    if before.isalnum() or before == "_":
        return False
    return not (len(name) > 1 and name.isupper() and not attributes.strip(" /") and f"</{name}>" not in (m.string if whole is None else whole))


def is_entity(m: re.Match) -> bool:
    return m[0][1] == "#" or m[0][1:] in html.entities.html5


def is_formula(m: re.Match) -> bool:
    """Whether what stands in the delimiters looks like mathematics, not like amounts or prose."""
    inside = (m[1] if m[1] is not None else m[2]).strip()
    return bool(inside) and (len(inside) <= 2 and inside.isalnum() and not inside.isdigit() or bool(OPERATOR.search(inside)) and HIDDEN not in inside)


def families_of(text: str, whole: str | None = None) -> set[str]:
    """The families that have a construct in a block, from which code is hidden already; ``whole`` is the block's text."""
    found = set()
    if not TRIGGER.search(text):
        return found
    if "<" in text:
        if COMMENT.search(text):
            found.add("html")
        for m in TAG.finditer(text):
            if is_element(m[2]):
                found.add("html")
            elif is_component(m, whole):
                found.add("block")
    if "html" not in found and "&" in text and any(is_entity(m) for m in ENTITY.finditer(text)):
        found.add("html")
    if "[" in text and BLOCK_TAG.search(text):
        found.add("block")
    if (
        ("[" in text and (LINK.search(text) or EXTERNAL.search(text)))
        or ("{" in text and (TEMPLATE.search(text) or CALL_CUT_OFF.search(text)))
        or ("=" in text and HEADING.search(text))
        or ("|" in text and WIKI_TABLE.search(text))
        or ("''" in text and QUOTES.search(text))
        or ("__" in text and MAGIC_WORD.search(text))
        or ("~~~" in text and SIGNATURE.search(text))
    ):
        found.add("wiki")
    if ("\\" in text and (COMMAND.search(text) or ENVIRONMENT.search(text))) or (
        ("$" in text or "\\" in text) and (any(is_formula(m) for m in DISPLAY.finditer(text)) or any(is_formula(m) for m in INLINE.finditer(text)))
    ):
        found.add("latex")
    return found


# --- converting ------------------------------------------------------------------------------------


class Kept:
    """Code and formulas put aside while the rest of a text is converted."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, text: str) -> str:
        self.parts.append(text)
        return f"\x02{len(self.parts) - 1}\x03"

    def back(self, text: str, before: int | None = None) -> str:
        """Kept things may hold kept things, all put aside before them."""
        if "\x02" not in text:
            return text
        most = len(self.parts) if before is None else before
        return re.sub("\x02(\\d+)\x03", lambda m: self.back(self.parts[int(m[1])], int(m[1])) if int(m[1]) < most else m[0], text)


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in cells) + " |"


def _grid(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n\n" + "\n".join([_row(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(_row, rows[1:])]) + "\n\n"


def _hub_block(kind: str, body: str, kept: Kept) -> str:
    """A doc-hub block from its JSON body."""
    if kind == "html":
        return "\n\n" + body + "\n\n"
    try:
        data = json.loads(body)
    except (ValueError, RecursionError):
        data = None
    if not isinstance(data, dict):
        return "\n\n" + kept.put("```\n" + body.strip() + "\n```") + "\n\n" if body.strip() else "\n\n"
    said = lambda key: str(data.get(key) or "").strip()
    if kind == "code":
        codes = [c for c in data.get("codes") or [] if isinstance(c, dict)]
        return "".join("\n\n" + kept.put(f"```{c.get('language') or ''}\n{c.get('code') or ''}\n```") for c in codes) + "\n\n"
    if kind == "api-header":
        return f"\n\n## {said('title')}\n\n"
    if kind == "callout":
        return "\n\n> " + "\n> ".join(x for x in (said("title"), *said("body").split("\n")) if x) + "\n\n"
    if kind == "parameters" and isinstance(data.get("data"), dict):
        cells: dict[int, dict[int, str]] = {}
        for key, value in data["data"].items():
            row, _, column = str(key).partition("-")
            if column.isdigit() and (row.isdigit() or row == "h"):
                cells.setdefault(-1 if row == "h" else int(row), {})[int(column)] = str(value)
        return _grid([[r.get(i, "") for i in range(max(r) + 1)] for _, r in sorted(cells.items())])
    if kind == "image":
        images = [i.get("image") for i in data.get("images") or [] if isinstance(i, dict)]
        words = [str(x) for i in images if isinstance(i, list) for x in i[1:2] if x] + [str(i["caption"]) for i in data.get("images") or [] if isinstance(i, dict) and i.get("caption")]
        return "\n\n" + "\n".join(words) + "\n\n"
    return "\n\n" + "\n".join(x for x in (said("title"), said("url"), said("body")) if x) + "\n\n"


HUB_BLOCK = re.compile(r"\[block:([\w-]+)\](.*?)\[/block\]", re.I | re.S)
DROPPED = re.compile(r"<(script|style|noscript|template|svg)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.I | re.S)
TABLE = re.compile(r"<table\b[^<>]*>(.*?)</table\s*>", re.I | re.S)
CELL = re.compile(r"<t[dh]\b[^<>]*>(.*?)(?=<t[dhr]\b|</t[dhr]\s*>|</table|\Z)", re.I | re.S)
ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.I | re.S)
TITLE = re.compile(r"<(h[1-6])\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
ENV = re.compile(r"\\begin\s*\{([A-Za-z]+)(\*?)\}(.*?)\\end\s*\{\1\2\}", re.S | re.I)
SECTION = re.compile(r"\\((?:sub)*)section\*?\s*\{([^{}]*)\}")
MATHS = {"equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "split", "cases", "matrix", "pmatrix", "bmatrix", "array", "aligned"}
WIKI_GRID = re.compile(r"^[^\S\n]*\{\|[^\n]*\n(.*?)^[^\S\n]*\|\}", re.M | re.S)


def _element(m: re.Match) -> str:
    closing, name = m[1], m[2].lower()
    if not is_element(m[2]):
        return m[0] if not is_component(m) else "\n" if m.string[m.end() : m.end() + 1] == "\n" else ""
    if name in ("br", "hr"):
        return "\n" if name == "br" else "\n\n"
    if name == "li":
        return "" if closing else "\n- "
    if name in ("dt", "dd"):
        return "" if closing else "\n- " if name == "dt" else ": "
    if name == "img":
        alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", m[3])
        return next((g for g in alt.groups() if g is not None), "") if alt else ""
    if name in ("sup", "sub"):
        return "" if closing else "^" if name == "sup" else "_"
    inline = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "time", "tt", "u", "var", "wbr"}
    return "" if name in inline else "\n\n" if name in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "details", "blockquote") else "\n"


def _environment(kept: Kept):
    def convert(m: re.Match) -> str:
        name, body = m[1].lower(), m[3]
        if name in MATHS:
            return "\n\n" + kept.put("$$" + body.strip() + "$$") + "\n\n"
        if name in ("itemize", "enumerate", "description"):
            return "\n\n" + re.sub(r"\s*\\item\b(?:\s*\[([^\[\]]*)\])?\s*", lambda i: "\n- " + (i[1] + ": " if i[1] else ""), body).strip() + "\n\n"
        if name in ("tabular", "longtable"):
            body = re.sub(r"^\s*\{[^{}]*\}", "", body)
            rows = [re.sub(r"\\[hc]line\b(?:\{[^{}]*\})?", "", r) for r in re.split(r"\\\\", body)]
            return _grid([re.split(r"(?<!\\)&", r) for r in rows if r.strip()])
        if name in ("verbatim", "lstlisting"):
            return "\n\n" + kept.put("```\n" + body.strip("\n") + "\n```") + "\n\n"
        return "\n\n" + body + "\n\n"

    return convert


def _template(m: re.Match) -> str:
    inner = TEMPLATE.sub(_template, m[1])
    name, *arguments = [x.strip() for x in inner.split("|")]
    if name.startswith("#"):
        return arguments[0] if arguments else ""
    named = [re.match(r"([\w ]+?)\s*=\s*(.*)", a, re.S) for a in arguments]
    if any(named):
        return "\n\n" + "\n".join(f"- {n[1]}: {n[2]}" if n else f"- {a}" for n, a in zip(named, arguments)) + "\n\n"
    return " ".join(arguments[:1])


def _wiki_grid(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m[1].split("\n"):
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            continue
        elif line[:1] in ("|", "!"):
            rows[-1] += [c.rpartition("|")[2] if re.match(r"\s*\w+\s*=", c) else c for c in re.split(r"\|\||!!", line[1:])]
        elif line and rows[-1]:
            rows[-1][-1] += " " + line
    return _grid(rows)


def _html_table(m: re.Match) -> str:
    rows = [[TAG.sub("", c).strip() for c in CELL.findall(r)] for r in re.split(r"<tr\b[^<>]*>", m[1], flags=re.I)]
    return _grid(rows)


def repeated(pattern: re.Pattern, replacement, text: str) -> str:
    """Text with the pattern replaced until there is none; every pass must remove a level of nesting."""
    n = 1
    while n:
        text, n = pattern.subn(replacement, text)
    return text


def convert(text: str, kept: Kept) -> str:
    """Text outside fenced code with all constructs converted; kept parts stay put aside."""
    if "`" in text:
        text = CODE_SPAN.sub(lambda m: kept.put(m[0]), text)
    if not TRIGGER.search(text):
        return text
    if "[" in text:
        text = HUB_BLOCK.sub(lambda m: _hub_block(m[1].lower(), m[2], kept), text)
        text = BLOCK_TAG.sub("\n\n", text)
    if "$" in text or "\\" in text:
        text = DISPLAY.sub(lambda m: kept.put("$$" + (m[1] if m[1] is not None else m[2]).strip() + "$$") if is_formula(m) else m[0], text)
        text = INLINE.sub(lambda m: kept.put("$" + (m[1] if m[1] is not None else m[2]).strip() + "$") if is_formula(m) else m[0], text)
    if "\\" in text:
        text = repeated(ENV, _environment(kept), text)
        text = SECTION.sub(lambda m: "\n\n" + "#" * (2 + len(m[1]) // 3) + " " + m[2].strip() + "\n\n", text)
        text = re.sub(r"\\footnote\s*\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"~?\\(?:ref|cite|label|eqref|pageref)\s*\{([^{}]*)\}", lambda m: "" if "label" in m[0][:6] else f" [{m[1]}]", text)
        text = repeated(WRAPPED, r"\1", text)
        text = ENVIRONMENT.sub("", text)
        text = COMMAND.sub("", text)
    if "<" in text:
        text = DROPPED.sub("", COMMENT.sub("", text))
        text = PRE.sub(lambda m: "\n\n" + kept.put("```\n" + html.unescape(TAG.sub("", m[1])).strip("\n") + "\n```") + "\n\n", text)
        text = TABLE.sub(_html_table, text)
        text = ANCHOR.sub(r"\1", text)
        text = TITLE.sub(lambda m: "\n\n" + "#" * int(m[1][1]) + " " + TAG.sub("", m[2]).strip() + "\n\n", text)
        text = TAG.sub(_element, text)
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]) if is_entity(m) else m[0], text)
    if "{" in text:
        text = WIKI_GRID.sub(_wiki_grid, text)
        text = repeated(TEMPLATE, _template, text)
    if "[" in text:
        text = LINK.sub(lambda m: "" if re.match(r"(?i)category:", m[1]) else m[1].rpartition("|")[2] if "|" in m[1] else re.sub(r"^(?:File|Image):.*", "", m[1]), text)
        text = EXTERNAL.sub(r"\2", text)
        text = re.sub(r"^#REDIRECT\s*", "", text, flags=re.M | re.I)
    if "=" in text:
        text = HEADING.sub(lambda m: "\n\n" + "#" * len(m[1] or m[3]) + " " + (m[2] or m[4]).strip() + "\n\n", text)
    if "''" in text:
        text = QUOTES.sub(r"\2", text)
    if "__" in text:
        text = MAGIC_WORD.sub("", text)
    if "~~~" in text:
        text = SIGNATURE.sub("", text)
    return text


# --- blocks and the tree ---------------------------------------------------------------------------


@dataclass
class Block:
    """A flat block of the clean text: what it is, its text, and whether it is kept."""

    kind: str  # prose, heading, list, table, code, formula, quote
    text: str
    content: bool = True


def kind_of(text: str) -> str:
    first = text.lstrip()[:4]
    if first[:1] == "#" and re.match(r"#{1,6}\s", text.lstrip()):
        return "heading"
    if re.match(r"(?:[-*+]|\d+[.)])\s", text.lstrip()):
        return "list"
    if first[:1] == "|":
        return "table"
    if first[:1] == ">":
        return "quote"
    if first[:2] == "$$":
        return "formula"
    return "prose"


#: What may hold a block together over blank lines: (how it begins, how it ends), in lower case.
HOLDING = (
    ("<!--", "-->"), ("{{", "}}"), ("{|", "|}"), ("[block:", "[/block]"), ("\\begin{", "\\end{"),
    *((f"<{name}", f"</{name}") for name in ("pre", "table", "script", "style", "noscript", "template", "svg", "ul", "ol", "dl")),
)
OPENING = re.compile("|".join(re.escape(a) for a, _ in HOLDING), re.I)


def flat_blocks(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The blocks between blank lines of text[start:end], together where a construct is open."""
    low, dead = None, set()  # dead: constructs that are closed nowhere behind
    gaps = [m.span() for m in BLANK.finditer(text, start, end)]
    at, i = start, 0
    while at < end:
        stop, after = gaps[i] if i < len(gaps) else (end, end)
        i += 1
        if stop < end and OPENING.search(text, at, stop):
            low = low or text.lower()
            checked = False
            while not checked and stop < end:
                checked = True
                for opens, closes in HOLDING:
                    if opens in dead or low.count(opens, at, stop) <= low.count(closes, at, stop):
                        continue
                    found = low.find(closes, stop, end)
                    if found < 0:
                        dead.add(opens)
                        continue
                    while stop <= found:
                        stop, after = gaps[i] if i < len(gaps) else (end, end)
                        i += 1
                    checked = False
        if stop > at:
            yield at, stop
        at = after


def linked_words(text: str) -> int:
    """How many words of a block stand in links of any syntax."""
    count = 0
    if "](" in text:
        count += sum(len(WORDS.findall(m[1])) for m in MD_LINK.finditer(text))
    if "<a" in text or "<A" in text:
        count += sum(len(WORDS.findall(TAG.sub(" ", m[1]))) for m in ANCHOR.finditer(text))
    if "[[" in text:
        count += sum(len(WORDS.findall(m[1].rpartition("|")[2])) for m in LINK.finditer(text))
    if "[http" in text:
        count += sum(len(WORDS.findall(m[2])) for m in EXTERNAL.finditer(text))
    return count


def measured(text: str) -> tuple[int, float, int]:
    """Words, link density and marks of a block as it stands in the source."""
    marks = len(TRIGGER.findall(text))
    if not marks:
        return len(WORDS.findall(text)), 0.0, 0
    seen = TAG.sub(" ", text) if "<" in text else text
    seen = MD_LINK.sub(r"\1", seen) if "](" in seen else seen
    words = len(WORDS.findall(seen))
    return words, min(1.0, linked_words(text) / words) if words else 0.0, marks


PLAIN, MARKED, BOILERPLATE = 0, 1, 2
#: The labelled table, from blocks of documentation pages and of the menus and legal lines around them.
#: Words and link density of the block before; words, link density and marks of the block; words and link
#: density of the block after; the class.
LABELLED = """
0 0.0   40 0.0 0    35 0.0   plain
18 0.0  28 0.0 0    60 0.0   plain
60 0.0  90 0.0 0    0 0.0    plain
44 0.0  31 0.0 0    0 0.0    plain
50 0.0  14 0.0 0    50 0.1   plain
22 0.1  12 0.0 0    30 0.0   plain
20 0.1  7 0.0 0     25 0.0   plain
30 0.0  4 0.0 0     40 0.0   plain
60 0.0  2 0.0 0     20 0.0   plain
18 0.0  1 0.0 0     33 0.0   plain
0 0.0   9 0.0 0     0 0.0    plain
0 0.0   3 0.0 0     25 0.2   plain
2 0.0   0 0.0 0     12 0.0   plain
3 1.0   30 0.0 0    2 1.0    plain
7 1.0   16 0.0 0    9 0.9    plain
0 0.0   40 0.0 1    35 0.0   marked
18 0.0  28 0.0 2    60 0.0   marked
35 0.0  28 0.05 4   60 0.0   marked
60 0.0  90 0.1 12   0 0.0    marked
44 0.0  18 0.1 1    31 0.0   marked
50 0.0  14 0.2 3    50 0.0   marked
22 0.0  12 0.0 1    30 0.0   marked
8 0.0   11 0.0 6    20 0.1   marked
20 0.1  10 0.1 2    25 0.0   marked
30 0.0  7 0.0 1     40 0.0   marked
40 0.0  4 0.25 2    35 0.0   marked
25 0.0  4 0.0 1     60 0.0   marked
60 0.0  2 0.0 1     20 0.0   marked
18 0.0  1 0.0 1     33 0.0   marked
12 0.0  0 0.0 1     30 0.0   marked
0 0.0   9 0.0 1     0 0.0    marked
0 0.0   3 0.0 2     25 0.0   marked
33 0.0  5 0.2 2     0 0.0    marked
70 0.0  45 0.3 9    22 0.0   marked
15 0.0  20 0.35 5   15 0.0   marked
29 0.0  3 0.33 1    41 0.0   marked
14 0.0  0 0.0 2     0 0.0    marked
1 0.0   1 1.0 1     14 0.0   marked
14 0.0  1 1.0 1     13 0.0   marked
1 0.0   2 0.5 1     3 1.0    marked
5 0.9   22 0.1 3    4 1.0    marked
2 0.8   41 0.1 1    3 1.0    marked
4 1.0   19 0.0 1    3 1.0    marked
0 0.0   2 1.0 2     1 1.0    boilerplate
2 1.0   2 1.0 2     3 1.0    boilerplate
3 1.0   3 1.0 3     30 0.0   boilerplate
0 0.0   6 0.9 6     40 0.0   boilerplate
40 0.0  5 1.0 5     0 0.0    boilerplate
5 1.0   4 0.75 3    4 1.0    boilerplate
30 0.0  8 0.8 4     6 1.0    boilerplate
6 1.0   12 0.7 9    2 1.0    boilerplate
0 0.0   15 0.95 20  8 1.0    boilerplate
25 0.0  30 0.9 40   5 1.0    boilerplate
12 0.6  9 0.67 6    12 0.6   boilerplate
50 0.0  18 0.85 16  0 0.0    boilerplate
0 0.0   25 0.8 24   10 0.9   boilerplate
35 0.0  3 1.0 3     28 0.0   boilerplate
14 0.0  10 1.0 8    14 0.0   boilerplate
9 0.8   4 0.75 4    3 1.0    boilerplate
4 1.0   2 1.0 4     4 1.0    boilerplate
3 1.0   2 0.0 0     2 1.0    boilerplate
5 0.9   1 0.0 0     4 1.0    boilerplate
2 1.0   3 0.0 0     6 0.8    boilerplate
4 0.8   4 0.0 0     5 0.9    boilerplate
8 1.0   3 0.0 0     3 0.7    boilerplate
"""
CLASSES = ("plain", "marked", "boilerplate")


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = [line.split() for line in LABELLED.strip().split("\n")]
    return np.array([[float(x) for x in r[:-1]] for r in rows]), np.array([CLASSES.index(r[-1]) for r in rows])


def impurity(labels: np.ndarray) -> float:
    """The Gini impurity, times the number of labels."""
    shares = np.bincount(labels, minlength=len(CLASSES)) / max(1, len(labels))
    return len(labels) * float((shares * (1 - shares)).sum())


def train(features: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """A binary tree by the Gini impurity: (feature, threshold, left, right), or the class of a leaf."""
    leaf = (int(np.bincount(labels, minlength=len(CLASSES)).argmax()),)
    if depth == 0 or len(np.unique(labels)) == 1 or len(labels) < 2 * least:
        return leaf
    best = None
    for f in range(features.shape[1]):
        for t in np.unique(features[:, f])[:-1]:
            left = features[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            cost = impurity(labels[left]) + impurity(labels[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float((t + features[~left, f].min()) / 2))
    if best is None or best[0] >= impurity(labels) - 1e-12:
        return leaf
    left = features[:, best[1]] <= best[2]
    return (best[1], best[2], train(features[left], labels[left], depth - 1, least), train(features[~left], labels[~left], depth - 1, least))


def predict(tree: tuple, features: tuple[float, ...]) -> int:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def blocks_of(text: str | None, tree: tuple) -> tuple[list[Block], set[str]]:
    """The blocks of a text's clean form and the families of markup found in it."""
    if text is None or not text.strip():
        return [], set()
    kept, out, found = Kept(), [], set()
    text = text.replace("\x01", " ").replace("\x02", " ").replace("\x03", " ") if any(c in text for c in "\x01\x02\x03") else text
    source = [(code, *span) for code, a, b in split_code(text) for span in ([(a, b)] if code else flat_blocks(text, a, b))]
    figures = [measured(text[a:b]) if not code else (len(WORDS.findall(text[a:b])), 0.0, 0) for code, a, b in source]
    nothing, tags = (0, 0.0, 0), text if "</" in text else ""
    for i, (code, a, b) in enumerate(source):
        if code:
            out.append(Block("code", text[a:b].strip("\n")))
            continue
        before, after = figures[i - 1] if i else nothing, figures[i + 1] if i + 1 < len(source) else nothing
        what = predict(tree, (*before[:2], *figures[i], *after[:2]))
        part = text[a:b]
        if what == PLAIN:
            _append(out, part, True)
            continue
        found |= families_of(hide_spans(part), tags)
        for piece in BLANK.split(convert(part, kept)):
            _append(out, kept.back(piece.strip("\n").rstrip()), what != BOILERPLATE)
    return out, found


def _append(out: list[Block], text: str, content: bool) -> None:
    """Add a block of the clean text, if there is anything in it; of boilerplate only what is worth keeping."""
    text = text.strip("\n").rstrip()
    if not text:
        return
    kind = "code" if text.startswith("```") else kind_of(text)
    out.append(Block(kind, text if kind == "code" else re.sub(r"\n{2,}", "\n", text), content or kind in ("heading", "code", "formula")))


def _clean(tree: tuple):
    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["body"]:
                blocks, found = blocks_of(text, tree)
                kept = [b for b in blocks if b.content]
                kinds = [b.kind for b in kept]
                rows.append((
                    [f for f in FAMILIES if f in found], "\n\n".join(b.text for b in kept), len(blocks), len(blocks) - len(kept),
                    *(kinds.count(k) for k in ("heading", "list", "table", "code", "formula")),
                ))
            out = pd.DataFrame(rows, columns=["families", "clean_text", "blocks", "dropped", "headings", "lists", "tables", "codes", "formulas"])
            out.insert(0, "row_id", batch["row_id"].astype("Int64").to_numpy() if batch["row_id"].isna().any() else batch["row_id"].to_numpy())
            out.insert(0, "tbl", batch["tbl"].to_numpy())
            yield out

    return clean


CLEAN_SCHEMA = "tbl string, row_id bigint, families array<string>, clean_text string, blocks int, dropped int, headings int, lists int, tables int, codes int, formulas int"


def clean_texts(df: DataFrame) -> DataFrame:
    """The clean text of each ``body`` (df has tbl, row_id, body), its families and block counts."""
    tree = train(*labelled())
    return df.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "body").mapInPandas(_clean(tree), CLEAN_SCHEMA)


def found_families(cleaned: DataFrame) -> DataFrame:
    """One row per text and family found in it."""
    return cleaned.select("tbl", "row_id", F.explode("families").alias("family"))
