"""Articles in HTML, Markdown, wiki or LaTeX markup to clean text that keeps headings, lists, code blocks and formulas.

An article is read once, line by line. What must not be read as markup (comments, scripts, styles, code, formulas, escaped
marks) is set aside by one left-to-right scan; the lines are then fed to the standard library's streaming HTML parser,
whose events give each line's tags and text, while the marks of the other notations are read at the line's start. Each
line's ratio of text to tags is smoothed with a Gaussian and the lines are clustered by a threshold between two means. Lines
below it that are mostly tags make up the regions that aren't content: their text is left out, and so are their headings and list items if nothing but
links stands in them (menus, crumbs, footers). Code blocks and formulas, and elements with words of their own, are content wherever they stand.

Defined results
    * null, empty and blank contents: empty text and no elements. Unmarked text stays as it is, with line ends unified.
    * elements left open at the end of a text (a cut article) count; a formula counts once it is closed.
    * tags written as entities count as tags if the whole article is written so.
    * '$' opens a formula if no space follows it, and closes it if no space precedes and no digit follows.
    * articles are read where they lie, whole; null ids keep their row in the texts and give no elements; repeated rows
      give the same rows again; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import spread

KINDS = ("heading", "list_item", "code_block", "formula")
#: Width of the Gaussian in lines; text characters a tag under which a line can be set aside.
SIGMA, SPARSE = 1.0, 8.0
_CODE, _MATH, _TEXT, _END = "\ue001", "\ue002", "\ue003", "\ue004"
_HELD = re.compile(f"([{_CODE}{_MATH}{_TEXT}])(\\d+){_END}")

_LATEX = re.compile(r"\\(?:(?:sub)*section\*?\{|chapter\*?\{|paragraph\{|begin\{|item\b|textbf\{|textit\{|texttt\{|emph\{|footnote\{|label\{|href\{)")
_TAGS = re.compile(r"<(?:/?(?:h[1-6]|p|div|ul|ol|li|pre|span|br|b|em|a|img|table|html|body|style|script|code)\b[^<>]*|!--)", re.I)
_WIKI = re.compile(r"^={2,6}[^=\n].*?={2,6}[ \t]*$|'''|(?<!')''(?!')[^'\n]+''(?!')|\{\{[^{}\n]*\}\}|\[\[[^\[\]\n]*\]\]|<ref\b|<nowiki|<syntaxhighlight|\[https?://\S+ [^\]\n]+\]|^[:*#]+<math>", re.M)
_MARKDOWN = re.compile(r"^#{2,6} |^#{1,6} .* #+[ \t]*$|^(?:```|~~~)|\*\*\w|~~\w|`[^`\n]+`|\]\([^()\s]+\)|<https?://|^\S.*\n(?:={3,}|-{3,})[ \t]*$|^[-+] |^\d+[.)] |\\[*$_#]", re.M)
_HASHES = re.compile(r"^#\s*\S.*\n#\s*\S", re.M)

_MATHS = r"(?P<math><math\b.*?</math\s*>|\$\$(?=[^$]).+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$(?![\s$])(?:[^$\n\\]|\\.)*?(?<![\s\\])\$(?!\d))"
_SCAN = {
    "markdown": re.compile(
        r"(?P<drop><!--.*?(?:-->|\Z)|<(?P<s>script|style)\b.*?(?:</(?P=s)\s*>|\Z))|(?P<code><pre\b.*?(?:</pre\s*>|\Z)|^[ ]{0,7}(?P<f>`{3,}|~{3,})[^`\n]*(?:\n|\Z)(?:.*?^[ ]{0,7}(?P=f)[`~]*[ \t]*$|.*\Z))"
        r"|(?P<text><code\b[^>]*>.*?</code\s*>|(?P<t>`+)(?!`)(?:(?!\n\s*\n).)+?(?<!`)(?P=t)(?!`)|\\[^\w\s\[\]()])|" + _MATHS,
        re.S | re.M | re.I,
    ),
    "wiki": re.compile(
        r"(?P<drop><!--.*?(?:-->|\Z)|<(?P<s>script|style|ref)\b[^>]*?(?:/>|>.*?(?:</(?P=s)\s*>|\Z)))|(?P<code><(?P<c>pre|syntaxhighlight|source)\b.*?(?:</(?P=c)\s*>|\Z))|(?P<text><nowiki>.*?</nowiki>|<code\b[^>]*>.*?</code\s*>)|" + _MATHS,
        re.S | re.M | re.I,
    ),
    "latex": re.compile(
        r"(?P<code>\\begin\{(?P<c>verbatim\*?|Verbatim|lstlisting|minted|alltt)\}.*?(?:\\end\{(?P=c)\}|\Z))|(?P<math>\\begin\{(?P<m>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}.*?\\end\{(?P=m)\}|\$\$(?=[^$]).+?\$\$|(?<!\\)\\\[.+?\\\]|(?<!\\)\\\(.+?\\\)|(?<!\\)\$(?!\s)(?:[^$\n\\]|\\.)*?(?<![\s\\])\$(?!\d))"
        r"|(?P<text>\\verb\*?(?P<v>[^\w\s*]).*?(?P=v)|\\[$%#&_{}])|(?P<drop>%[^\n]*)",
        re.S | re.M,
    ),
}
_LIST = {"markdown": re.compile(r"\s*(?:[-+*]|(\d{1,9})[.)])\s+(?=\S)"), "wiki": re.compile(r"[:;]*[*#][*#:;]*\s*(?=\S)"), "latex": re.compile(r"\s*\\item\b\s*(?:\[[^\]]*\])?\s*")}
_ATX = re.compile(r" {0,3}#{1,6}[ \t]+(?=[^\s#])")
_RULE = re.compile(r"\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_EQUALS = re.compile(r"(={1,6})\s*([^=\s].*?)\s*\1\s*$")
_SECTION = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\{")
_UNDERLINE = re.compile(r" {0,3}(?:={2,}|-{2,})[ \t]*$")
_BRACES = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{|[{}]")


_IMAGE, _LINK, _STRUCK = re.compile(r"!\[[^\]]*\]\([^()]*\)"), re.compile(r"\[([^\[\]]*)\]\([^()]*\)"), re.compile(r"~~(.+?)~~ ?")
_EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w*])|(?<![\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\3(?![\w_])")
_NO_TAG, _ADDRESS, _BLANKS = re.compile(r"<(?![a-zA-Z/!])|<(?=https?://)"), re.compile(r"<https?://[^<>\s]*>"), re.compile(r"[ \t\u00a0]+")


class _Line(HTMLParser):
    """Text, tags and elements of the lines as they are fed."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.begin()

    def begin(self):
        self.tags, self.linked, self.marks, self.parts = 0, 0, [], []

    def reset(self):
        super().reset()
        self.within = 0  # open links

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.marks.append("heading")
        elif tag == "li":
            self.marks.append("list_item")
        elif tag in ("p", "div", "br", "td", "tr", "th"):
            self.parts.append(" ")
        if tag == "a":
            self.within = 1
        elif tag in ("p", "div", "li", "ul", "ol", "table", "body"):
            self.within = 0  # a link that was never closed

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.within = 0

    def handle_data(self, data):
        self.parts.append(data)
        if self.within:
            self.linked += len(data.strip())

    def handle_entityref(self, name):
        self.parts.append(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.parts.append(html.unescape(f"&#{name};"))

    def set_cdata_mode(self, elem, **kw):
        """Scripts and styles are gone already; a stray opening tag mustn't swallow the rest."""


def notation(text: str) -> str:
    """Which reading a text needs: 'markdown' (with HTML), 'wiki' or 'latex'."""
    if _LATEX.search(text) and not _TAGS.search(text):
        return "latex"
    wiki = len(_WIKI.findall(text))
    if wiki or _HASHES.search(text):
        if wiki > len(_MARKDOWN.findall(_SCAN["wiki"].sub("", text))) or not wiki and not _MARKDOWN.search(text) and not _TAGS.search(text):
            return "wiki"
    return "markdown"


def _unwrapped(text: str) -> str:
    """Without the commands around their arguments, however deep; what isn't closed stays."""
    opened: list[tuple[int, int] | None] = []
    gone: list[tuple[int, int]] = []
    for m in _BRACES.finditer(text):
        if m.group() != "}":
            opened.append(m.span() if m.group() != "{" else None)
        elif opened and (command := opened.pop()):
            gone += [command, m.span()]
    out, at = [], 0
    for a, b in sorted(gone):
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def _inline(text: str, kind: str) -> str:
    """Without the marks of emphasis, links and notes."""
    if kind == "latex":
        text = re.sub(r"\\(?:footnote|label|ref|cite)\{[^{}]*\}", "", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", text)
        return _unwrapped(text).replace("~", " ").replace("\\\\", " ")
    if kind == "wiki":
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
        text = re.sub(r"\[https?://\S+ ([^\]]+)\]", r"\1", text)
        return re.sub(r"'{2,5}", "", text)
    if "](" in text:
        text = _LINK.sub(r"\1", _IMAGE.sub("", text))
    if "~~" in text:
        text = _STRUCK.sub("", text)
    return _EMPHASIS.sub(lambda m: m.group(2) or m.group(4), text) if "*" in text or "_" in text else text


def _payload(source: str, kind: str) -> str:
    """What a code block or formula holds."""
    source = re.sub(r"\A(?:<pre\b[^>]*>\s*(?:<code\b[^>]*>)?|<(?:syntaxhighlight|source)\b[^>]*>|\s*(?:`{3,}|~{3,})[^\n]*|\\begin\{[^}]*\}(?:\[[^\]]*\])?)\n?|(?:(?:</code\s*>)?\s*</(?:pre|syntaxhighlight|source)\s*>|\s*(?:`{3,}|~{3,})\s*|\\end\{[^}]*\})\Z", "", source, flags=re.I) if kind == _CODE else re.sub(r"</?m(?:ath|text)\b[^>]*>|\A(?:\$\$?|\\[\[(])|(?:\$\$?|\\[\])])\Z|\\(?:begin|end)\{[^}]*\}", "", source, flags=re.I)
    return html.unescape(source).strip("\n" if kind == _CODE else None)


def elements(text: str | None) -> list[tuple[list[str], str, int, int]]:
    """The lines of an article as (elements in reading order, text, tags, letters within links); the text is prefixed by the first element's mark."""
    if not text or not text.strip():
        return []
    text = re.sub("[\ue001-\ue004]", "", text.replace("\r\n", "\n").replace("\r", "\n"))
    if re.search(r"&lt;/?[a-zA-Z]", text) and not re.search(r"<[a-zA-Z/!]", text):
        text = html.unescape(text)
    kind = notation(text)
    held: list[str] = []

    def aside(m: re.Match) -> str:
        what = next(x for x in ("drop", "code", "text", "math") if m.groupdict().get(x) is not None)
        if what == "drop":
            return ""
        held.append(m.group())
        mark = {"code": _CODE, "math": _MATH, "text": _TEXT}[what]
        return f"{mark}{len(held) - 1}{_END}"

    text = _SCAN[kind].sub(aside, text)
    out: list[tuple[list[str], str, int, int]] = []
    parser, before = _Line(), ""  # before: what the line above is: '', 'text', 'list', 'other'
    for line in text.split("\n"):
        marks: list[str] = []
        body = line
        if not line.strip():
            before = ""
            out.append(([], "", 0, 0))
            continue
        item = _LIST[kind].match(line)
        if kind == "markdown":
            if before == "text" and _UNDERLINE.match(line) and out:
                out[-1] = (["heading", *out[-1][0]], "# " + out[-1][1], *out[-1][2:])
                before = "other"
                continue
            if _RULE.match(line):
                before = "other"
                continue
            if m := _ATX.match(line):
                marks, body = ["heading"], re.sub(r"\s+#+\s*$", "", line[m.end() :])
            elif item and not (before == "text" and item.group(1) not in (None, "1")):
                marks, body = ["list_item"], line[item.end() :]
        elif kind == "wiki":
            if m := _EQUALS.match(line):
                marks, body = ["heading"], m.group(2)
            elif item:
                marks, body = ["list_item"], line[item.end() :]
        else:
            body = _SECTION.sub(lambda m: marks.append("heading") or "{", line)
            body = re.sub(r"\\item\b\s*(?:\[[^\]]*\])?", lambda m: marks.append("list_item") or " ", body)
            body = body.replace("<", "&lt;")
        parser.begin()
        if "<" in body or "&" in body or parser.rawdata:
            parser.feed((_NO_TAG.sub("&lt;", body) if "<" in body else body) + "\n")
        else:
            parser.handle_data(body)
        shown = "".join(parser.parts)
        marks += parser.marks
        for m in _HELD.finditer(shown) if _END in shown else ():
            if m.group(1) != _TEXT:
                marks.append("code_block" if m.group(1) == _CODE else "formula")
        shown = _inline(_ADDRESS.sub("", shown) if "<http" in shown else shown, kind)

        def back(m: re.Match) -> str:
            source = held[int(m.group(2))]
            if m.group(1) == _TEXT:
                return html.unescape(re.sub(r"<[^>]*>", "", source)) if source[0] == "<" else source.strip("`") if source[0] == "`" else source[1:]
            payload = _payload(source, m.group(1))
            return f"\n```\n{payload}\n```\n" if m.group(1) == _CODE else f"${payload}$"

        shown = _BLANKS.sub(" ", shown).strip(" {}\n" if kind == "latex" and marks[:1] == ["heading"] else " \n")
        shown = (_HELD.sub(back, shown) if _END in shown else shown).strip("\n")
        if marks[:1] == ["heading"]:
            shown = "# " + shown
        elif marks[:1] == ["list_item"]:
            shown = "- " + shown
        out.append((marks, shown, parser.tags, parser.linked))
        before = "list" if item and marks else "other" if marks or parser.tags and not shown else "list" if before == "list" else "text"
    return out


def content(lines: list[tuple[list[str], str, int, int]]) -> list[bool]:
    """Which lines are content: by the smoothed ratio of text to tags, parted at the middle of two means."""
    if not any(n for _, _, n, _ in lines):
        return [True] * len(lines)  # without tags nothing is mostly tags
    ratios = [len(t) / max(1, n) for _, t, n, _ in lines]
    reach = math.ceil(3 * SIGMA)
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * SIGMA * SIGMA))
    smooth = np.convolve(ratios, weights)[reach:-reach] / np.convolve(np.ones(len(ratios)), weights)[reach:-reach]
    order = np.sort(smooth)
    total = np.concatenate([[0.0], np.cumsum(order)])
    low, high, n_low = order[0], order[-1], -1
    while True:  # until the parts stay as they are
        n = int(np.searchsorted(order, (low + high) / 2, "right"))
        if n in (n_low, 0, len(order)):
            break
        n_low, low, high = n, total[n] / n, (total[-1] - total[n]) / (len(order) - n)
    part = (low + high) / 2
    return [not (s <= part and n and len(t) < SPARSE * n and _empty_of_words(marks, t, linked)) for (marks, t, n, linked), s in zip(lines, smooth.tolist())]


def _empty_of_words(marks: list[str], text: str, linked: int) -> bool:
    """Whether a sparse line has no element, or only headings and items that are links."""
    if not marks:
        return True
    return linked > 0 and not {"code_block", "formula"} & set(marks) and len(re.sub(r"^[#-] |\W+", "", text)) <= linked


def clean(text: str | None) -> tuple[str, list[str]]:
    """The clean text of an article and its elements in reading order."""
    lines = elements(text)
    kept = [x for x, good in zip(lines, content(lines)) if good]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x[1] for x in kept)).strip("\n"), [m for x in kept for m in x[0]]


def _over(df: DataFrame, key: str, text: str, rows, fields: str) -> DataFrame:
    kind = df.schema[key].dataType

    def work(batches):
        for batch in batches:
            out = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in rows(i, t.as_py())]
            cols = list(zip(*out)) if out else [[] for _ in range(1 + len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols[1:], types))], names=[key, *names])

    names, types = zip(*((x.split()[0], {"string": pa.string(), "int": pa.int32()}[x.split()[1]]) for x in fields.split(", ")))
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(work, f"`{key}` {kind.simpleString()}, {fields}")


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, kind_no) of each element, numbered from 1 for each article and kind in reading order."""

    def rows(i, t):
        seen = dict.fromkeys(KINDS, 0)
        for kind in clean(t)[1] if i is not None else ():
            seen[kind] += 1
            yield kind, seen[kind]

    return _over(df, key, text, rows, "kind string, kind_no int")


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clean_text) of each article."""
    return _over(df, key, text, lambda i, t: [(clean(t)[0],)], "clean_text string")
