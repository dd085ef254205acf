"""Markup residue in texts: finding it with a tree-structured graphical model, and turning it into clean text.

A scan takes every stretch that may be markup, real or not, as a node; a stretch inside another one is its child, so
the nodes of a text form a tree. Each node is literal text, markup, or enclosed: part of the code, formula or comment
around it. What a stretch itself shows is told by a logistic model over its features; what a node of one type is inside
a node of another type in each of its states is told by pair potentials, estimated for each pair of types and smoothed
towards what holds for all pairs. Both are trained from labelled pages when the operator is built, which takes a moment.
Sum-product messages go from the leaves up, so that children are evidence of what their parent is, and from the root
down; a node whose marginal of being markup is above one half is markup.

The labelled pages are lines written for this purpose (``PAGES``) and pages made of them (``made_pages``): with other
words and numbers, and within headings, emphasis, tables, environments, code and comments.

Defined cases: null, empty and blank texts have no markup; the clean text of a null text is null.
Texts of any length are read whole. Repeated rows come out repeatedly.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.plans.runtime import spread

# The elements of HTML, and the LaTeX environments that hold formulas or code.
ELEMENTS = set(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
CLOSED_ENVIRONMENTS = set("equation align gather multline eqnarray math displaymath alignat flalign verbatim lstlisting comment".split())

#: Node types with the kind of markup they belong to; the second value tells that what is inside belongs to the node alone.
TYPES = {
    "html_code": ("html", True), "html_comment": ("html", True), "html_tag": ("html", False), "html_reference": ("html", False),
    "fence": ("markdown", True), "code_span": ("markdown", True), "heading": ("markdown", False), "underlined": ("markdown", False),
    "pipe_table": ("markdown", False), "link": ("markdown", False), "definition": ("markdown", False), "strong": ("markdown", False), "emphasis": ("markdown", False),
    "wiki_link": ("wiki", False), "template": ("wiki", False), "wiki_heading": ("wiki", False), "quotes": ("wiki", False), "brace_table": ("wiki", False),
    "display": ("latex", True), "inline": ("latex", True), "environment": ("latex", False), "closed_environment": ("latex", True), "command": ("latex", False),
}

NAME = r"[A-Za-z][A-Za-z0-9]*"
PATTERNS = {
    "fence": r"^[ ]{0,3}(?P<fm>`{3,}|~{3,})[^`\n]*\n(?P<fence_in>(?s:.*?)\n)??[ ]{0,3}(?P=fm)[`~]*[ \t\r]*$",
    "html_comment": r"<!--(?P<comment_in>(?s:.*?))-->",
    "html_code": r"<(?P<hc>pre|code|script|style)\b[^<>]*>(?P<hc_in>(?s:.*?))</(?P=hc)\s*>",
    "closed_environment": r"\\begin\{(?P<ce>" + "|".join(sorted(CLOSED_ENVIRONMENTS)) + r")(?P<star>\*?)\}(?P<ce_in>(?s:.*?))\\end\{(?P=ce)(?P=star)\}",
    "environment": r"\\begin\{(?P<en>[A-Za-z]+\*?)\}(?P<en_in>(?s:.*?))\\end\{(?P=en)\}",
    "display": r"\$\$(?P<d1>(?:[^$\\]|\\(?s:.))+?)\$\$|\\\[(?P<d2>(?:(?!\n[ \t\r]*\n)(?s:.))+?)\\\]",
    "brace_table": r"^[ \t]*\{\|(?P<bt_in>(?s:.*?))^[ \t]*\|\}",
    "pipe_table": r"^[^\n|]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*$(?P<pt_in>(?:\n[^\n]*\|[^\n]*)*)",
    "heading": r"^[ ]{0,3}#{1,6}(?P<h_in>[^#\n][^\n]*)$",
    "wiki_heading": r"^(?P<we>={1,6})(?!=)(?P<wh_in>[^\n]*?[^=\n])={1,6}[ \t\r]*$",
    "underlined": r"^[ ]{0,3}(?P<u_in>[^\s|>#=`~-][^\n|]*?)[ \t\r]*\n[ ]{0,3}(?:=+|-{2,})[ \t\r]*$",
    "definition": r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*$",
    "code_span": r"(?<!`)(?P<ct>`+)(?!`)(?P<cs_in>(?:(?!\n[ \t\r]*\n)(?s:.))+?)(?<!`)(?P=ct)(?!`)",
    "inline": r"\\\((?P<i1>(?:(?!\n[ \t\r]*\n)(?s:.))+?)\\\)|(?<![\\$])\$(?=[^\s$])(?P<i2>[^$\n]*?[^\s$\\])\$(?![\d$])",
    "html_tag": r"</?" + NAME + r"(?:\s[^<>]*|/)?>|<[^<>\n]*>",
    "html_reference": r"&(?:\#[0-9]+|\#[xX][0-9A-Fa-f]+|" + NAME + r");",
    "command": r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?P<c_in>(?:[^{}\n]|\{[^{}\n]*\})*)\}",
    "template": r"\{\{(?P<t_in>[^{}]*?)\}\}",
    "wiki_link": r"\[\[(?P<wl_in>[^\n]*?)\]\]",
    "link": r"!?\[(?P<l_in>[^\[\]\n]*)\](?:\((?:<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))*)(?:[ ]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)|\[[^\[\]\n]*\])",
    "quotes": r"(?<!')(?P<q>'{2,5})(?!')(?P<q_in>[^'\n]+(?:'[^'\n]+)*)(?P=q)(?!')",
    "strong": r"(?P<s>\*\*|(?<!\w)__)(?=[^\s*_])(?P<s_in>(?:(?!\n[ \t\r]*\n)(?s:.))+?)(?<=[^\s])(?P=s)(?![*_])",
    "emphasis": r"(?<![*_\\])(?P<e>\*|(?<!\w)_)(?=[^\s*_])(?P<e_in>(?:(?!\n[ \t\r]*\n)[^*_])+?)(?<=[^\s])(?P=e)(?![*_])",
}
#: Those that take whole lines are tried at line starts only, the others at their first signs only.
LINES = ("fence", "brace_table", "pipe_table", "heading", "wiki_heading", "underlined", "definition")
SCAN = re.compile("^(?:" + "|".join(f"(?P<{k}>{PATTERNS[k]})" for k in LINES) + r")|(?=[<&\\$`{!\[*_'])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k not in LINES) + ")", re.M)
INNER = {"fence": "fence_in", "html_comment": "comment_in", "html_code": "hc_in", "closed_environment": "ce_in", "environment": "en_in", "brace_table": "bt_in", "pipe_table": "pt_in", "heading": "h_in", "wiki_heading": "wh_in", "underlined": "u_in", "code_span": "cs_in", "command": "c_in", "template": "t_in", "wiki_link": "wl_in", "link": "l_in", "quotes": "q_in", "strong": "s_in", "emphasis": "e_in"}
#: What every stretch that SCAN finds holds.
LINE_STARTS = re.compile(r"[<&\\$`{\[*_']|^[ \t]{0,3}[#=~|]|\n[ ]{0,3}[=-]|\|", re.M)


@dataclass
class Node:
    type: str
    begin: int
    end: int
    inner: tuple[int, int]
    features: tuple[str, ...]
    match: re.Match | None = None
    children: list[Node] = field(default_factory=list)
    p: float = 0.0  # marginal of being markup
    below: tuple[float, ...] = ()
    messages: list[tuple[float, ...]] = field(default_factory=list)


DEFINITION = re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S", re.M)
BLANK = re.compile(r"\s")


@dataclass
class Context:
    """What features need to know of a text beyond the stretch: found once, or further on from the last stretch."""

    text: str
    defined: bool | None = None
    at: int = 0
    word: int = 0

    def has_definitions(self) -> bool:
        if self.defined is None:
            self.defined = bool(DEFINITION.search(self.text))
        return self.defined

    def word_start(self, begin: int) -> int:
        """Where the unbroken word around a place begins."""
        if begin < self.at:
            self.at = self.word = 0
        for m in BLANK.finditer(self.text, self.at, begin):
            self.word = m.end()
        self.at = begin
        return self.word


def sign_class(c: str) -> str:
    return "edge" if not c else "blank" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else "low line" if c == "_" else "bracket" if c in "()[]{}<>" else "sign"


def features(kind: str, context: Context, m: re.Match, inner: tuple[int, int]) -> tuple[str, ...]:
    """What a stretch shows besides its type: what stands around and in it, and signs of its type or against it."""
    text = context.text
    s, begin, end = m.group(), m.start(), m.end()
    before, behind = text[begin - 1 : begin], text[end : end + 1]
    out = [kind]
    add = lambda name, holds: out.append(f"{kind}:{name}") if holds else None
    held = text[inner[0] : inner[1]] if inner[0] >= 0 else s
    head = held[:200].split()
    out += [f"before {sign_class(before)}", f"behind {sign_class(behind)}", f"words {min(len(head), 3)}"]
    add("numbers in it", bool(head) and all(w.strip(".,%$") .isdigit() for w in head))
    add("signs of code in it", any(c in held[:200] for c in "=;{}"))
    if kind == "html_tag":
        tag = re.match(r"</?([A-Za-z][A-Za-z0-9]*)(.*)>\Z", s, re.S)
        add("no name", not tag)
        add("unknown", bool(tag) and tag.group(1).lower() not in ELEMENTS)
        rest = re.sub(r"\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", "", tag.group(2)) if tag else ""
        add("loose words", bool(tag) and rest.strip(" \t\r\n/") != "")
    elif kind == "html_reference":
        add("unknown", s[1] != "#" and s[1:] not in html5)
    elif kind == "heading":
        add("no blank", not m.group("h_in")[:1].isspace() or not m.group("h_in").strip())
    elif kind == "underlined":
        add("key", bool(re.match(r"[\w-]+:(\s|$)", m.group("u_in"))))
        add("list item", bool(re.match(r"(?:[-*+]|\d+[.)])\s", m.group("u_in"))))
    elif kind == "wiki_heading":
        add("no blank, one sign", len(m.group("we")) == 1)
    elif kind == "link":
        add("reference", s.endswith("]"))
        add("reference without definitions", s.endswith("]") and not context.has_definitions())
        add("call", before.isalnum() or before == "]")
    elif kind == "definition":
        add("number only", bool(re.match(r"\s*\[\d+\]:", s)))
        add("no target", not re.search(r"\]:[ \t]*(?:<|/|\.|#|[a-z]+:|\S*\.\w+)", s))
    elif kind == "wiki_link":
        add("brackets inside", "[" in m.group("wl_in") or "]" in m.group("wl_in"))
        add("empty", not m.group("wl_in").strip(" |"))
        add("numbers", bool(re.fullmatch(r"[\d\s.,;-]*", m.group("wl_in"))))
    elif kind == "template":
        add("empty", not m.group("t_in").strip())
        add("numbers", bool(re.fullmatch(r"[\d\s.,;-]*", m.group("t_in"))))
    elif kind == "inline" and s[0] == "$":
        body = m.group("i2")
        add("money", bool(re.match(r"[\d.,]+(?:[\s/-]|\Z)", body)) and not re.search(r"[\\^_={}+]", body))
        add("plain words", not re.search(r"[\\^_={}+*/<>-]", body) and len(body.split()) > 1)
        add("shell", bool(re.match(r"[A-Z_]{2,}\b", body)))
        add("within a word", before.isalnum() or behind.isalpha())
    elif kind == "command":
        add("path", before == "\\" or bool(re.match(r"[A-Za-z]:|\\", text[context.word_start(begin) : begin][:2])))
    elif kind in ("strong", "emphasis"):
        mark = m.group("s" if kind == "strong" else "e")
        add("low line within a word", mark[0] == "_" and (before.isalnum() or behind.isalnum() or before == "_" or behind == "_"))
        add("file name", mark[0] == "_" and bool(re.match(r"\.\w|[(/\\=]", text[end : end + 2])) or before in ("/", "\\", "."))
        add("sum", mark[0] == "*" and (before.isdigit() or behind.isdigit()))
        add("code signs", bool(re.search(r"[=;{}()]\s|\w\(", m.group("s_in" if kind == "strong" else "e_in"))) and mark[0] == "_")
    elif kind == "quotes":
        add("within a word", before.isalnum() and behind.isalnum())
    elif kind == "pipe_table":
        rule = s.split("\n")[1]
        add("thin rule", "|" not in rule)
    return tuple(out)


def tree(text: str) -> list[Node]:
    """The nodes of a text, with those inside them, however deep."""
    out: list[Node] = []
    context = Context(text)
    open_ = [(0, len(text), out)]
    while open_:
        begin, end, nodes = open_.pop()
        if not LINE_STARTS.search(text, begin, end):
            continue
        at = begin
        while m := SCAN.search(text, at, end):
            if m.end() == m.start():
                at = m.end() + 1
                continue
            kind = next(k for k in PATTERNS if m.group(k) is not None)
            group = INNER.get(kind)
            inner = m.span(group) if group else (-1, -1)
            if kind == "display":
                inner = m.span("d1") if m.group("d1") is not None else m.span("d2")
            elif kind == "inline":
                inner = m.span("i1") if m.group("i1") is not None else m.span("i2")
            node = Node(kind, m.start(), m.end(), inner, features(kind, context, m, inner), m)
            if inner[0] >= 0 and inner[1] - inner[0] > 1:
                open_.append((*inner, node.children))
            nodes.append(node)
            at = m.end()
    return out


def all_of(nodes: list[Node]) -> list[Node]:
    """The nodes and those inside them, each before its children."""
    out = list(nodes)
    for n in out:
        out += n.children
    return out


# Labelled pages. In each the stretches between the marks 〔 and 〕 are markup, everything else that looks like it is literal.
PAGES = [
    "〔<div>〕text〔</div>〕 and 〔<br/>〕 or 〔<br>〕 then 〔<a href=\"https://x.invalid/1\">〕link〔</a>〕 &c", "〔<TABLE>〕〔<TR>〕〔<TD>〕cell〔</TD>〕〔</TR>〕〔</TABLE>〕", "〔<span\n  style=\"color: red\"\n>〕red〔</span>〕 〔<h4>〕title〔</h2>〕",
    "〔<p class=x>〕one〔</p>〕〔<input disabled=\"\"/>〕〔<img src='a.png' alt=\"b\"/>〕", "size < 39 and time > 62, vector<float> v, <unset> or <your name> or <T>", "if a <b and c> d then <3 and x<y or y>z stay; Map<String> List<int>",
    "see <placeholder> and <none> and <id> for <agent>", "〔<!-- a <b>note</b> &amp; $x$ -->〕 text 〔<!-- **x** [[y]] -->〕", "A 〔&amp;〕 B 〔&nbsp;〕 C 〔&#8211;〕 D 〔&#x2014;〕 E 〔&lt;〕em〔&gt;〕 F", "AT&T; R&D; a && b &unknownthing; x &foo;",
    "〔<pre>x = **y** &amp; [[z]]</pre>〕", "〔<code>a_b_c $x$ {{y}}</code>〕 words",
    "〔# Title〕\n\ntext\n\n〔## Second part〕\n\n#12 is an issue\n\n#tag and #9 timestamp\n", "〔Heading\n=======〕\n\ntext\n\n〔Other\n-----〕\n\nmore text\n", "title: x\n---\n\n- item\n----\n", "〔```python\nx = a_b * c_d # comment\n# heading\n**y** <div> {{z}} [[w]] $x$\n```〕\ntext",
    "〔~~~\n\\section{a} {{ b }}\n~~~〕\n", "use 〔`<td>`〕 and 〔`a_b`〕 and 〔`**x**`〕 here", "〔**bold words**〕 and 〔__strong too__〕 and 〔*slanted words*〕 and 〔_also so_〕 end", "〔**one**〕, (〔_two_〕) \"〔*three*〕\" 〔*x*〕.",
    "a_b_c and some_long_name_here, 7 * 3 * 2, 2*3*4 = 24, x_i and y_i", "see __init__.py and /a/_b_/c and _d_(x) or lib/__main__.py", "〔[text](/a/b.md)〕 and 〔![image](img-1.png)〕 and 〔[t](http://x.invalid \"title\")〕", "a[0](x) and f[1][2] and cells [1][2] and note [16] stay",
    "〔[words here][r6]〕\n\n〔[r1]: /owner.md〕\n", "〔[two words][r1]〕 text\n\n〔[r1]: https://x.invalid/a〕\n", "〔| a | b |\n| --- | ---: |\n| 1 | 2 |〕\n\n", "a | b | c\nd | e | f\n\n| 1 | 2 |\n", "x | y\n---\n",
    "〔[[page name]]〕 and 〔[[page#part|label]]〕 end", "x = [[1, 2], [3, 4]] and [[0]] and [[1,2]]", "〔{{template}}〕 and 〔{{name|key=24}}〕 and 〔{{ spaced }}〕", "set {{}} or {{1, 2}} or {a} {agent}", "〔== Heading ==〕\n\n〔=== Unequal ==〕\n\n", "a == b\n\n=x=\n\n==========\n",
    "〔'''bold'''〕 and 〔''slanted words''〕 and 〔'''''both'''''〕", "the team's 'a' and 'b', it''s rock''n''roll", "〔{| class=\"grid\"\n|-\n| a || b\n|}〕\n", "〔\\section{title}〕 and 〔\\textbf{bold words}〕 and 〔\\emph{x}〕: 〔\\cite{key2020}〕",
    "〔\\begin{itemize}\n\\item one\n\\item two \n\\end{itemize}〕", "〔\\begin{equation}\nb = \\frac{w}{54}\n\\end{equation}〕", "〔\\begin{verbatim}\n**x** <b> [[y]]\n\\end{verbatim}〕", "〔$$\na = r^{2}\n$$〕\n\n〔\\[ m^2 + s^2 \\leq 74 \\]〕\n\n〔\\( m < x \\)〕", "〔$b_{i} = \\sum_j z_j$〕 and 〔$x$〕 and 〔$a+b$〕 and 〔$\\alpha$〕 and 〔$n^2$〕 and 〔$x = 5$〕",
    "costs $2 to $94 per unit, $5-$9, US$5 and CA$7, $10/$20", "echo $HOME && ls $PWD or $HOME:$PATH or $FOO-$BAR", "C:\\exports\\parser\\2001 and C:\\dir\\name{x} and \\\\host\\share{a}", "paid $5 and then$ or a $b c$d", "between $3 and 4$ there", "price $30,$40$",
    # The same kinds of stretches once more, and twice, with other words around them.
    "Open the 〔<em>〕meeting〔</em>〕 room, 〔<hr>〕 then 〔<img src=\"b.png\">〕 here", "〔<ul>〕\n〔<li>〕first〔</li>〕\n〔<li id=\"n2\">〕second〔</li>〕\n〔</ul>〕", "〔<H3 class=\"t\">〕Market news〔</H3>〕", "line one〔<br />〕line two〔<BR>〕line three",
    "weight < 70 kg and height > 2 m", "call f<int, string>(x) or List<Item> or Dict<K, V> now", "write <your answer> or <name of the person> below", "send it to <someone> at <no address> or <T>", "p < q, q > r, and <, > alone", "results (n<5) and (m>3) differ", "type <enter key> or <space bar>, then <value a, value b>",
    "Fish 〔&amp;〕 Chips, 5 〔&gt;〕 3, 〔&copy;〕 2020, 〔&#169;〕 too, 〔&#xA9;〕", "〔&quot;〕quoted〔&quot;〕 and 〔&nbsp;〕 gap", "Q&A; B&B; salt & pepper; &nosuchname; here", "M&M; and &also; then &x;", "〔<!-- hidden -->〕 shown 〔<!-- # not a heading -->〕",
    "〔<pre>\nplain <b>text</b>\n</pre>〕", "〔<code>x < y</code>〕 and 〔<code>[[page]]</code>〕", "〔<script>if (a < b) { c(\"<b>\") }</script>〕 text", "〔<style>p { color: red }</style>〕 text",
    "〔### Third level〕\ntext below", "〔# One〕\n〔## Two〕\n", "#5 was fixed, #hashtag and #nothing", "#1\n#2\n", "#include <stdio.h>\n", "〔Summary\n===〕\nwords", "〔A longer heading here\n---〕\nwords below", "author: me\ndate: now\n---\ntext", "status: open\n---\n", "* one\n* two\n---\n", "1. first\n2. second\n----\n",
    "〔```\ncode here\n```〕", "〔```json\n{\"a\": \"<b>\"}\n```〕\nmore", "〔~~~~\n$x$ and [[y]]\n~~~~〕", "type 〔`ls -l`〕 now", "〔`x = {{y}}`〕, 〔``a ` b``〕 and 〔`$PATH`〕", "It is 〔**very**〕 important", "〔__Note__〕: read 〔*this*〕 and 〔_that_〕", "(〔**a b c**〕) and 〔*x y*〕!",
    "my_file_name.txt and other_file_name", "5 * 6 * 7 and 8*9*10 here", "_x or y_ z, f(a_b, c_d) and (a * b) * c", "/usr/_local_/bin and \\_not_ this", "see __main__.py and __all__(x) and a.__dict__", "v = _a_ = 3 and x._name_ here", "__len__ = 3; __x__(y); _tmp_.log", "run a_b_c(d); x = y_z_; done",
    "read 〔[the guide](guide.md)〕 and 〔![](p.png)〕", "〔[a b](<c d.md>)〕 and 〔[wiki](x_(y)_z)〕", "〔[home][h]〕 or [h]\n\n〔[h]: /index.md〕\n", "〔[top][]〕\n\n〔[top]: ./a.md〕\n", "x[1](2) and y[i][j] and words[a][b] of z", "table [3][4] and call g[0](z)", "as shown [1] and [2][3] there", "[2]: see there\n[7]: other\n", "[note]: words without target\n",
    "〔a | b\n--- | ---\n1 | 2〕\n", "〔| one | two | three |\n|:--|:-:|--:|\n| x | y | z |〕\n", "p | q\nr | s\n", "left | right\n----\n", "use 〔[[Main Page]]〕 and 〔[[a/b#c]]〕", "〔[[image.png|thumb]]〕", "grid = [[5, 6], [7, 8]], m = [[9]], [[0.5]]", "[[a[0], b[1]]] and [[ ]]",
    "〔{{cite web}}〕 and 〔{{info|a=1|b=2}}〕", "〔{{main}}〕", "y = {{}} and s = {{ }} and {{3}}", "{{1}, {2}} or {{4, 5}}", "〔=== Part three ===〕\n", "〔= Title =〕\n", "=a=\n", "x = y = z\n", "=b= c\n=q=\n", "so 〔''he''〕 and 〔'''she'''〕 left", "rock''n''roll and it''s y''s", "a''b''c and 'single' words",
    "〔{|\n! h\n|-\n| c\n|}〕\n", "〔\\emph{word}〕 and 〔\\ref{fig}〕", "〔\\subsection{A part}〕\ntext", "〔\\sqrt{2}〕 of it and 〔\\cite[p. 4]{key}〕", "〔\\begin{center}\nwords\n\\end{center}〕", "〔\\begin{align}\nx &= y\n\\end{align}〕", "〔\\begin{lstlisting}\n$x$ <b>\n\\end{lstlisting}〕",
    "〔$$ E = m c^2 $$〕", "〔\\[ a + b = c \\]〕 and 〔\\( x \\)〕", "so 〔$y$〕 and 〔$x_1 + x_2$〕 and 〔$\\beta$〕 and 〔$k = 3$〕", "let 〔$n \\to \\infty$〕 and 〔$f(x)$〕", "it costs $5 or $6 and $7,50", "from $10 to $20 per day", "between $30 and $40$ now", "US$9 and A$3, $2/$4, $8-$12", "cd $HOME; echo $USER and $PATH$ more", "put $A and B$ there, $one two$", "D:\\data\\new{x} and E:\\tmp\\set{y}", "\\\\server\\share{z} and C:\\a\\b{c}", "a$b c$d and x$y$z", "paid $5 〔<b>〕now〔</b>〕 and then$ or never", "from $7 〔**today**〕 to the end$ of it", "put $A 〔[x](y.md)〕 and so$ on",
]


def labelled(page: str) -> tuple[str, set[tuple[int, int]]]:
    """The page without its marks, and the stretches that are markup."""
    text, stretches, open_ = [], set(), []
    for c in page:
        if c == "〔":
            open_.append(len(text))
        elif c == "〕":
            stretches.add((open_.pop(), len(text)))
        else:
            text.append(c)
    return "".join(text), stretches


#: Words and frames of made pages; {} stands for the page inside, and what isn't marked is literal or enclosed.
FILLERS = "turbine archive chapter valve label ledger parcel threshold glossary station paper meeting window market river garden".split()
FRAMES = [
    "〔# {}〕\n\ntext", "- {}\n- other", "〔**{}**〕", "〔<p>〕{}〔</p>〕", "〔<li>〕〔<b>〕{}〔</b>〕〔</li>〕", "〔\\begin{{quote}}\n{}\n\\end{{quote}}〕", "〔\\textbf{{{}}}〕", "〔| {} | b |\n| --- | --- |\n| 1 | 2 |〕", "〔== {} ==〕\n", "〔''{}''〕", "〔[[page|{}]]〕", "〔{{{{name|{}}}}}〕", "(see {}) and more",
    "〔```\n{}\n```〕", "〔<!-- {} -->〕", "〔<pre>{}</pre>〕", "〔`{}`〕", "〔\\begin{{verbatim}}\n{}\n\\end{{verbatim}}〕", "〔<code>{}</code>〕", "〔$$ x = {} $$〕", "〔{{|\n| {} || b\n|}}〕\n",
]
CLOSING = re.compile("```|<!--|<pre|`|verbatim|<code|[$]{2}")
WORD = re.compile(r"(?<![\\<&/{\w$.-])[a-z]{4,}(?![\w>};=(/.:-])")
NUMBER = re.compile(r"(?<![\w#&$\\\[{/.,-])\d{1,2}(?![\w}\]/.,:-])")


def fits(page: str) -> bool:
    """Whether every marked stretch of a page is a node."""
    text, stretches = labelled(page)
    return stretches <= {(n.begin, n.end) for n in all_of(tree(text))}


def made_pages(pages: list[str], many: int = 6, seed: int = 1) -> list[str]:
    """Further labelled pages: every page ``many`` times with other words and numbers, one part of them inside a frame."""
    rng, out = random.Random(seed), []
    for page in pages:
        for k in range(many):
            new = NUMBER.sub(lambda m: str(rng.randrange(1, 99)), WORD.sub(lambda m: rng.choice(FILLERS) if rng.random() < 0.7 else m.group(), page))
            if k:
                frame = rng.choice(FRAMES)
                inside = new.strip("\n")
                new = frame.format(re.sub("[〔〕]", "", inside) if CLOSING.search(frame) else inside)
            if fits(new):
                out.append(new)
    return out


LITERAL, MARKUP, ENCLOSED = range(3)
STATES = (LITERAL, MARKUP, ENCLOSED)
#: How many nodes what holds for all pairs of types counts against those of one pair.
SMOOTHING = 4.0


@dataclass(frozen=True)
class Model:
    """Logistic weights of features; share of markup among free nodes of a type; and what a child of a type is, by the type and state of its parent."""

    weights: dict[str, float]
    bias: float
    share: dict[str, float]
    pairs: dict[tuple[str, int, str], tuple[float, ...]]
    general: dict[tuple[bool, int], tuple[float, ...]]
    edges: bool = True

    def evidence(self, n: Node) -> tuple[float, ...]:
        """How likely its features are in each state, against all nodes of its type."""
        z = max(-30.0, min(30.0, self.bias + sum(self.weights.get(f, 0.0) for f in n.features)))
        p, share = 1 / (1 + math.exp(-z)), self.share.get(n.type, 0.5)
        return (1 - p) / (1 - share), p / share, 1.0

    def child(self, parent: str, state: int, type_: str) -> tuple[float, ...]:
        if not self.edges:
            parent, state = "", LITERAL
        found = self.pairs.get((parent, state, type_))
        if found is None:
            share = self.share.get(type_, 0.5)
            inside = self.general[bool(parent) and TYPES[parent][1], state][ENCLOSED]
            found = self.pairs[parent, state, type_] = ((1 - share) * (1 - inside), share * (1 - inside), inside)
        return found


def train(pages: list[str] | None = None, edges: bool = True) -> Model:
    """The model of labelled pages, by default all of ``PAGES`` and what is made of them. Without ``edges`` every node is judged alone."""
    samples: Counter = Counter()
    pairs: dict[tuple[str, int, str], list[float]] = {}
    general = {(own, state): [0.01, 0.01, 0.01] for own in (False, True) for state in STATES}
    for page in PAGES + made_pages(PAGES) if pages is None else pages:
        text, stretches = labelled(page)
        open_ = [("", LITERAL, n) for n in tree(text)]
        while open_:
            parent, above, n = open_.pop()
            own = bool(parent) and TYPES[parent][1]
            state = ENCLOSED if above == ENCLOSED or (own and above == MARKUP) else MARKUP if (n.begin, n.end) in stretches else LITERAL
            pairs.setdefault((parent, above, n.type), [0.0] * 3)[state] += 1
            general[own, above][state] += 1
            if state != ENCLOSED:
                samples[n.features, state == MARKUP] += 1
            open_ += [(n.type, state, c) for c in n.children]
    names = sorted({f for fs, _ in samples for f in fs})
    x = np.array([[f in fs for f in names] for fs, _ in samples], float)
    y = np.array([real for _, real in samples], float)
    weight = np.sqrt(np.array(list(samples.values()), float))
    weight /= weight.sum()
    w, b = np.zeros(len(names)), 0.0
    for _ in range(3000):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= x.T @ error * 4 + 0.0003 * w
        b -= error.sum()
    found: dict[str, list[float]] = {}
    for (_, _, kind), c in pairs.items():
        seen = found.setdefault(kind, [1.0, 1.0])
        seen[0] += c[LITERAL]
        seen[1] += c[MARKUP]
    share = {kind: seen[1] / sum(seen) for kind, seen in found.items()}
    shares = {k: tuple(v / sum(c) for v in c) for k, c in general.items()}
    model = Model(dict(zip(names, w.tolist())), float(b), share, {}, shares, edges)
    known = {}
    for key, c in pairs.items():
        back = model.child(*key)
        known[key] = tuple((n + SMOOTHING * q) / (sum(c) + SMOOTHING) for n, q in zip(c, back))
    model.pairs.clear()
    model.pairs.update(known)
    return model


def infer(nodes: list[Node], model: Model) -> None:
    """Marginals of all nodes: messages up from the leaves, then down from the root."""
    every = all_of(nodes)
    for n in reversed(every):
        belief = model.evidence(n)
        n.messages = []
        for c in n.children:
            m = tuple(sum(t * b for t, b in zip(model.child(n.type, state, c.type), c.below)) for state in STATES) if model.edges else (1.0, 1.0, 1.0)
            n.messages.append(m)
            belief = tuple(b * x for b, x in zip(belief, m))
            total = sum(belief)
            belief = tuple(b / total for b in belief)
        n.below = belief
    down = {id(n): model.child("", LITERAL, n.type) for n in nodes}
    for n in every:
        belief = tuple(b * m for b, m in zip(n.below, down.pop(id(n))))
        total = sum(belief)
        n.p = belief[MARKUP] / total
        for c, m in zip(n.children, n.messages):
            rest = [b / max(x, 1e-300) for b, x in zip(belief, m)]
            total = sum(rest)
            ties = [model.child(n.type, state, c.type) for state in STATES]
            down[id(c)] = tuple(sum(rest[state] / total * ties[state][child] for state in STATES) for child in STATES)


def parsed(text: str, model: Model) -> list[Node]:
    nodes = tree(text)
    infer(nodes, model)
    return nodes


def kinds(nodes: list[Node]) -> set[str]:
    return {TYPES[n.type][0] for n in all_of(nodes) if n.p > 0.5}


def render(text: str, begin: int, end: int, nodes: list[Node]) -> str:
    """The stretch with its markup turned into plain structure."""
    done: dict[int, str] = {}

    def joined(begin: int, end: int, nodes: list[Node]) -> str:
        out, at = [], begin
        for n in nodes:
            out += [text[at : n.begin], done.pop(id(n))]
            at = n.end
        return "".join([*out, text[at:end]])

    for n in reversed(all_of(nodes)):
        inner = joined(*n.inner, n.children) if n.inner[0] >= 0 else ""
        done[id(n)] = clean_node(text, n, inner) if n.p > 0.5 else text[n.begin : n.inner[0]] + inner + text[n.inner[1] : n.end] if n.inner[0] >= 0 else text[n.begin : n.end]
    return joined(begin, end, nodes)


def clean_node(text: str, n: Node, inner: str) -> str:
    """Headings become '# ', lists '- ', tables pipe rows, code fences or spans, formulas stay between dollars."""
    s, m = text[n.begin : n.end], n.match
    raw = text[n.inner[0] : n.inner[1]] if n.inner[0] >= 0 else ""
    if n.type == "html_tag":
        name, closing = re.match(r"</?([A-Za-z0-9]+)", s).group(1).lower(), s[1] == "/"
        if re.fullmatch("h[1-6]", name):
            return "\n\n" if closing else "\n\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return " |" if closing else " "
        if name == "tr":
            return "" if closing else "\n|"
        return "\n" if name in ("br", "p", "div", "table", "ul", "ol", "section", "article", "blockquote", "hr") else ""
    if n.type == "html_reference":
        return html.unescape(s)
    if n.type == "html_code":
        return {"pre": "\n```\n" + html.unescape(raw).strip("\n") + "\n```\n", "code": f"`{html.unescape(raw)}`"}.get(m.group("hc").lower(), "")
    if n.type in ("html_comment", "definition", "template"):
        return ""
    if n.type in ("fence", "code_span", "heading", "pipe_table"):
        return s
    if n.type == "underlined":
        return ("# " if s.rstrip()[-1] == "=" else "## ") + inner
    if n.type == "wiki_heading":
        return "#" * len(m.group("we")) + " " + inner.strip()
    if n.type == "wiki_link":
        return inner.rsplit("|", 1)[-1]
    if n.type == "brace_table":
        rows = [r for r in re.split(r"^\|-[^\n]*\n", inner, flags=re.M)[1:]]
        return "\n".join("| " + " | ".join(c.strip() for c in re.split(r"\|\||!!|\n[|!]", r.strip().lstrip("|!"))) + " |" for r in rows if r.strip())
    if n.type in ("display", "closed_environment"):
        name = m.group("ce") or ""
        return f"```\n{raw.strip()}\n```" if name in ("verbatim", "lstlisting") else "" if name == "comment" else f"$${raw.strip()}$$"
    if n.type == "inline":
        return f"${raw.strip()}$"
    if n.type == "environment":
        return re.sub(r"\\item\b[ \t]*", "- ", inner)
    if n.type == "command":
        name = re.match(r"\\([A-Za-z]+)", s).group(1)
        level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(name)
        return "#" * level + " " + inner if level else "" if name in ("cite", "label", "ref", "index", "begin", "end", "usepackage", "documentclass") else inner
    return inner


def cleaned(text: str, nodes: list[Node]) -> str:
    out = render(text, 0, len(text), nodes).replace("\r\n", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", out, flags=re.M)).strip()


def apply(df: DataFrame, key: str, text: str, clean: bool = False) -> DataFrame:
    """(key, markup) for each kind in each text, or (key, clean_text, kinds) of every row with ``clean``."""
    model = train()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, second = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = parsed(t, model) if t else []
                if clean:
                    keys.append(k)
                    first.append(None if t is None else cleaned(t, nodes))
                    second.append(sorted(kinds(nodes)))
                else:
                    for x in sorted(kinds(nodes)):
                        keys.append(k)
                        first.append(x)
            cols = [pa.array(keys, batch.schema.types[0]), pa.array(first, pa.string())] + ([pa.array(second, pa.list_(pa.string()))] if clean else [])
            yield pa.RecordBatch.from_arrays(cols, names=["key", "clean_text", "kinds"] if clean else ["key", "markup"])

    out = spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"key {kind}, " + ("clean_text string, kinds array<string>" if clean else "markup string"))
    return out.withColumnRenamed("key", key)
