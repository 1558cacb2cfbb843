"""Text helpers: stripping, title case, transliteration and HTML to markdown."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import is_ascii

_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
# Every character Python counts as white space.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(c) for c in range(0x2000, 0x200b)))
# What ends a line where Python splits a text into lines.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_BREAK = rf"(?:\r\n|[{BREAKS}])"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    """Trim all white space at both ends (``trim`` alone only takes blanks)."""
    return F.btrim(text, F.lit(_SPACES))


# Upper-case digraphs and their title-case forms.
_UPPER_DIGRAPHS, _TITLE_DIGRAPHS = "\u01c4\u01c7\u01ca\u01f1", "\u01c5\u01c8\u01cb\u01f2"


def title_case(text: Column) -> Column:
    """Capital after every character without case, the rest lower (unlike ``initcap``)."""
    def titled(word: Column) -> Column:
        upper = F.upper(F.substring(word, 1, 1))  # may be two letters
        return F.concat(
            F.translate(F.substring(upper, 1, 1), _UPPER_DIGRAPHS, _TITLE_DIGRAPHS),
            F.lower(F.substring(upper, 2, 2)), word.substr(F.lit(2), F.length(word)))

    words = F.split(F.lower(text), f"(?<![{_CASED}])(?=[{_CASED}])")
    return F.array_join(F.transform(words, titled), "")


# ASCII look-alikes of characters that survive compatibility decomposition.
LOOKALIKES = {
    "¡": "i",
    "❶": "1",
    "❷": "2",
    "❸": "3",
    "❹": "4",
    "❺": "5",
    "❻": "6",
    "❼": "7",
    "❽": "8",
    "❾": "9",
    "❿": "10",
    "➀": "1",
    "➁": "2",
    "➂": "3",
    "➃": "4",
    "➄": "5",
    "➅": "6",
    "➆": "7",
    "➇": "8",
    "➈": "9",
    "➉": "10",
    "➊": "1",
    "➋": "2",
    "➌": "3",
    "➍": "4",
    "➎": "5",
    "➏": "6",
    "➐": "7",
    "➑": "8",
    "➒": "9",
    "➓": "10",
    "Α": "A",
    "Æ": "AE",
    "Β": "B",
    "Ð": "D",
    "Μ": "M",
    "×": "x",
    "æ": "ae",
    "Œ": "OE",
    "œ": "oe",
    "ƒ": "f",
    "ɑ": "a",
    "ɡ": "g",
    "ʻ": "'",
    "‘": "'",
    "ν": "v",
    "ο": "o",
    "ρ": "p",
    "а": "a",
    "б": "6",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "у": "y",
    "х": "x",
    "ѕ": "s",
    "і": "i",
    "ј": "j",
    "ѵ": "v",
    "ӕ": "ae",
    "։": ":",
    "৪": "8",
    "৭": "q",
    "੧": "q",
    "ଃ": "8",
    "୨": "9",
    "ᵫ": "ue",
    "‐": "-",
    "‒": "-",
    "–": "-",
    "—": "--",
    "―": "--",
    "’": "'",
    "“": '"',
    "”": '"',
    "′": "'",
    "⁄": "/",
    "∕": "/",
    "≤": "<=",
    "≥": ">=",
    "★": "*",
    "Ꜳ": "AA",
    "ꜳ": "aa",
    "·": "*",
    "•": "*",
    "▪": "*",
    "▫": "*",
    "◦": "*",
    '\u0302': "^",
    '\u0311': "^",
}
# Zero-width separators that become a blank.
BLANKS = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"]

_TABLE = str.maketrans({**LOOKALIKES, **dict.fromkeys(BLANKS, " ")})


@F.pandas_udf(T.StringType())
def _transliterate(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: unicodedata.normalize("NFKD", t).translate(_TABLE), na_action="ignore")


def to_ascii(text: Column) -> Column:
    """Decompose and swap look-alikes; characters with no ASCII form stay.

    Only rows with a non-ASCII character travel to Python.
    """
    return F.coalesce(_transliterate(F.when(~is_ascii(text), text)), text)


def drop_non_ascii(text: Column) -> Column:
    return bind(text, lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(t, r"[^\x00-\x7f]", "")))


class _Markdown(HTMLParser):
    """Markdown of one HTML fragment: headings, paragraphs, emphasis, links, lists, tables, quotes."""

    SKIP = {"script", "style", "title"}
    BLOCK = {"p", "div", "article", "section", "header", "footer", "nav", "body", "html", "dl"}
    EMPHASIS = {"b": "__", "strong": "__", "i": "_", "em": "_", "code": "`"}
    # What an opening tag ends, up to which enclosing tag, where end tags are left out.
    ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tr": ({"tr"}, {"table"}),
            "p": ({"p"}, {"div", "li", "td", "th", "blockquote", "body"})}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.frames: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.skipping = 0

    def put(self, piece: str):
        self.frames[-1][2].append(piece)

    def inside(self, tag: str) -> bool:
        return any(frame[0] == tag for frame in self.frames)

    def end_open(self, tag: str):
        """Close the element that a new ``tag`` ends, if it is open."""
        ended, limits = self.ENDS.get(tag, ((), ()))
        for frame in reversed(self.frames):
            if frame[0] in limits:
                return
            if frame[0] in ended:
                while self.close_frame() not in ended:
                    pass
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipping += 1
        elif not self.skipping:
            self.end_open(tag)
            if tag == "br":
                self.put("  \n")
            elif tag == "hr":
                self.put("\n\n---\n\n")
            elif tag == "img":
                found = dict(attrs)
                self.put(f"![{found.get('alt') or ''}]({found.get('src') or ''})")
            elif tag not in ("meta", "link", "input", "head"):
                self.frames.append((tag, dict(attrs), []))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping and self.inside(tag):
            while self.close_frame() != tag:
                pass

    def handle_data(self, data):
        if self.skipping:
            return
        if self.inside("pre"):
            self.put(data)
            return
        squeezed = " ".join(data.replace("\r", "\n").replace("\n", " ").split(" "))
        while "  " in squeezed:
            squeezed = squeezed.replace("  ", " ")
        self.put(squeezed.replace("*", r"\*").replace("_", r"\_"))

    def close_frame(self) -> str:
        tag, attrs, pieces = self.frames.pop()
        self.put(self.render(tag, attrs, "".join(pieces)))
        return tag

    def render(self, tag, attrs, body) -> str:
        text = body.strip()
        if tag in self.EMPHASIS or tag == "a":
            return self.inline(tag, attrs, body, text)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return f"\n\n{'#' * int(tag[1])} {' '.join(text.split())}\n\n" if text else ""
        if tag == "li":
            lines = text.split("\n")
            bullet = "\x00" + "\n".join([lines[0]] + ["  " + ln if ln else ln for ln in lines[1:]])
            return bullet + "\n"
        if tag in ("ul", "ol"):
            nested = self.inside("li")
            marks = (f"{n}. " if tag == "ol" else "* " for n in range(1, body.count("\x00") + 1))
            head, *items = body.split("\x00")
            listed = head.strip() + "".join(next(marks) + item for item in items)
            return ("\n" if nested else "\n\n") + listed + ("" if nested else "\n")
        if tag in ("td", "th"):
            return f" {' '.join(text.split())} |"
        if tag == "tr":
            return f"|{body.strip(chr(10))}\n" if text else ""
        if tag == "table":
            rows = [line.strip() for line in text.split("\n") if line.strip()]
            if not rows:
                return ""
            rule = "|" + " --- |" * (rows[0].count("|") - 1)
            return "\n\n" + "\n".join([rows[0], rule, *rows[1:]]) + "\n\n"
        if tag == "dt":
            return f"\n{text}\n" if text else ""
        if tag == "dd":
            return f": {text}\n" if text else ""
        if tag == "blockquote":
            quoted = "\n".join("> " + line for line in self.squeezed(text).split("\n"))
            return f"\n\n{quoted}\n\n" if text else ""
        if tag == "pre":
            inner = body.strip("\n")
            return f"\n\n```\n{inner}\n```\n\n" if inner else ""
        if tag in self.BLOCK:
            return f"\n\n{text}\n\n" if text else ""
        return body

    def inline(self, tag, attrs, body, text) -> str:
        if not text or (tag == "code" and self.inside("pre")):
            return body
        lead = " " if body[:1].isspace() else ""
        tail = " " if body[-1:].isspace() else ""
        if tag == "a":
            href = attrs.get("href")
            title = (attrs.get("title") or href or "").replace('"', r"\"")
            return f'{lead}[{text}]({href} "{title}"){tail}' if href else body
        mark = self.EMPHASIS[tag]
        return f"{lead}{mark}{text}{mark}{tail}"

    def result(self) -> str:
        while len(self.frames) > 1:
            self.close_frame()
        return self.squeezed("".join(self.frames[0][2]).replace("\x00", "* ")).strip()

    @staticmethod
    def squeezed(text: str) -> str:
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
        return text


def _to_markdown(html: str) -> str:
    if not html:
        return html
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return parser.result()


@F.pandas_udf(T.StringType())
def _html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(_to_markdown, na_action="ignore")


def html_to_markdown(html: Column) -> Column:
    """Markdown of an HTML column; null stays null and empty stays empty."""
    return _html_to_markdown(html)
