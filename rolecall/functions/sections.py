"""Headers, sections and section labels of cleaned descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import fold, is_ascii, search_folded
from .text import BREAKS as _BREAKS
from .text import bind, strip

MARK = "###"
# Every character that ends a line of text.
_LINE = f"^[^{_BREAKS}]*"

# Section labels with the wording that selects them; the first match wins.
LABEL_RULES = [
    ("TRAVEL", r"\b(?:travel|work flexibility)\b"),
    ("NOTICE", r"\b(?:equal (?:opportunit(?:y|ies)|employ(?:ment|ee))|eeoc?|eoe|accommodations?|accessibility|candidate data|privacy polic(?:y|ies)|notices?|discl(?:aimer|osure)s?|(?:our|culture) commitment|commit(?:ted|ment)(?: to)|disabilit(?:y|ies)|discrimination|veterans?|inclusi(?:ve|on)|diversity|recruit(?:ing|ment|ers)|unsolicited|agencies|fair chance|los angeles county|county of los angeles|drug|your rights?|fraud(?:ulent)|statements|recent awards)\b"),
    ("PROCESS", r"\b(?:appl(?:y(?:ing)?|ication)|interview|expression of interest|(?:u\.s\.|multiple|number of) positions)\b"),
    ("COMPENSATION", r"\$|\b(?:salary|pay|compensation|benefits?|perks?|rewards?|we offer|in it for you|retirement|pto|stipend|time[-\s]off|company vehicle|relocat(?:e|ion)|you(?:'ed|'ll| will) (?:love|like))\b"),
    ("COMPANY", r"\b(?:nyse|nasdaq|about (?:(?:the|our) (?:company|team|organization|group)|us)|our (?:values|culture|purpose)|(?:<!your )mission|who we are|why join|join us|company overview|team description)\b"),
    ("CLASSIFICATION", r"(?:\A(?:job|business|career|functional) (?:area|family|level|segment|unit|stream)|\b(?:(?:sub)?category|reports? to|division))\b"),
    ("ELIGIBILITY", r"\b(?:eligibility|screenings?|clearances?|citizenship|(?:work|employment) authorization|ead|visa|sponsorship|(?:eligibility|special) requirements?|itar|export control(?:led)?|conditions of (?:employ|appoint)ment|e\-verify|foreign national)\b"),
    ("IDENTIFIER", r"\b(?:(?:job|req(?:uisition)?|position) (?:id|code|number)|\#.+)\b"),
    ("MODEL", r"\b(?:remote(?:ly)?|(?:work(?:place)?|job) (?:model|mode|schedules?|arrangement|options?)|flexible working|schedule for this position|workplace type|hybrid|onsite|commute|type|shift|duration|hour(?:s|ly)|flsa)\b"),
    ("ENVIRONMENT", r"\b(?:work(?:ing)? environment|work(?:ing) conditions|physical demands)\b"),
    ("PREFERRED", r"\b(?:prefer(?:red|ences?)?|desir(?:ed|able)|(?:nice|good)(?:[-\s]?to[-\s]?| if you )haves?|(?:to|you) stand out|sets? you apart|bonus|extra credit|accelerators|competitive edge|even better|keywords)\b"),
    ("REQUIRED", r"\b(?:require(?:d|ments?)|qualifications?|must[-\s]?haves?|need to (?:see|have|succeed)|you(?:'ll| will)? (?:bring|need|have)|must have|compentenc(?:y|ies)|mandatory|minimum|basic)\b|\bmin\.\s"),
    ("QUALIFICATIONS", r"\b(?:skills?|abilit(?:y|ies)?|knowledge|background|credentials?|academic|education|certifications?|experience|expertise|proficienc(?:y|ies)|we(?:'re| are)? (?:look(?:ing)? for|seeking)|who you are|the person|tech stack|collaboration|we value|competencies|ideal candidate)\b"),
    ("RESPONSIBILITIES", r"\b(?:(?:responsib|accountab)(?:le|ility|ilities)|duties|you will|will you do|you'll .*?(?:do(?:ing)?|work(ing)? on|build(?:ing)?|achieve|get to|gain|grow|learn)|impact|your mission|day in the life|(?:essential|job) functions|\d0 days|purpose|the challenge|percentage of time|projects?)\b"),
    ("DESCRIPTION", r"\b(?:description|summary|overview|introduction|role|opportunity|position)\b"),
    ("TITLE", r"\b(?:title|develop(?:er|ment)|engineer(?:ing))\b"),
    ("DETAILS", r"\b(?:(?:other|additional|general)(?: important)? information|details|logistics|recruiter)\b"),
    ("COMPANY", r"\b(?:about \w+|compan(?:y|ies)|department|team|organization|employer|program|missions?|culture|values|who (?:are we|we are|will you)|our (?:vision|people)|working with us|learn more|what we(?: do|\'re doing))\b"),
    ("LOCATION", r"\b(?:locations?|city|state|province|\, [A-Z]{2})\b"),
    ("DESCRIPTION", r"\b(?:job|work)\b"),
    ("DATE", r"\b(?:date|posted on)\b"),
    ("NOTES", r"\b(?:notes?)\b"),
    ("LINK", r"\b(?:https?|www)\b"),
]


def _header_text(line: Column) -> Column:
    return strip(F.replace(line, F.lit(MARK), F.lit("")))


def extract_headers(text: Column) -> Column:
    """Array of the lines holding a header marker, without it."""
    lines = F.split(text, rf"\r\n|[{_BREAKS}]", -1)
    return F.transform(F.filter(lines, lambda ln: ln.contains(MARK)), _header_text)


def _first_label(header: Column) -> Column:
    text, folded = header["text"], header["folded"]

    def first(ascii_text: bool) -> Column:
        chain = F
        for name, pattern in LABEL_RULES:
            chain = chain.when(search_folded(folded, text, pattern, ascii_text), F.lit(name))
        return chain.otherwise(F.lit(""))

    return F.when(is_ascii(text), first(True)).otherwise(first(False))


def label(header: Column) -> Column:
    """Label of a header line, empty when no rule fits."""
    text = _header_text(header)
    both = F.struct(text.alias("text"), fold(text).alias("folded"))
    return F.when(header.isNotNull(), bind(both, _first_label))


def split_sections(text: Column) -> Column:
    """Array of ``struct<header, body>`` in text order; empty text has no section.

    Blocks of text each start at a header line but perhaps the first. The cut takes the line break
    before a header, which stripping would drop anyway. In texts with newlines alone, these are looked
    for in simpler, much faster ways.
    """
    def section(block: Column, first: Column) -> Column:
        headed = first.contains(MARK)
        rest = block.substr(F.length(first) + 1, F.length(block))
        return F.struct(
            F.when(headed, strip(first)).otherwise(F.lit("")).alias("header"),
            strip(F.when(headed, rest).otherwise(block)).alias("body"),
        )

    def cut(at: str, first_line: Callable[[Column], Column]) -> Column:
        blocks = F.filter(F.split(text, at, -1), lambda _: text != "")  # only empty text makes a single empty block
        return F.transform(blocks, lambda block: bind(first_line(block), lambda first: section(block, first)))

    return F.when(
        text.rlike(f"[{_BREAKS[2:]}]"),
        cut(rf"(?:\r\n|[{_BREAKS}])(?=[^{_BREAKS}]*{MARK})", lambda block: F.regexp_extract(block, _LINE, 0)),
    ).otherwise(cut(rf"\n(?=[^\n]*{MARK})", lambda block: F.substring_index(block, "\n", 1)))


def sections(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per section: the kept columns, ``section``, ``header``, ``label``, ``body``."""
    exploded = df.select(*keep, F.posexplode(split_sections(F.col(text))).alias("section", "_s"))
    return exploded.select(
        *keep, "section", F.col("_s.header").alias("header"),
        label(F.col("_s.header")).alias("label"), F.col("_s.body").alias("body"))
