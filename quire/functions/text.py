"""Scalar text operators as SQL expressions of a dialect ``d``.

White space is that of Unicode: both engines get the code points themselves, as their own classes differ.
"""

from __future__ import annotations

SPACES = r" \t\n\r\f\x0B\x1c-\x1f" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = f"[{SPACES}]"
#: Roman numerals as page numbers, and number tokens around a running header.
ROMAN = r"M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
LEADING_NUMBER = r"(?i)^\s*([ivxlcdm]{1,7}|[0-9]{1,4})\b[\s|:.\-–—]*"
TRAILING_NUMBER = r"(?i)[\s|:.\-–—]*\b([ivxlcdm]{1,7}|[0-9]{1,4})\s*$"
TRAILING_JUNK = r"\s+[^\w\s]{1,3}$"
#: Words that open a chapter title.
CHAPTER_WORDS = ("CHAPITRE", "CHAPTER", "CAPÍTULO", "CAPITULO", "CAPITOLO", "KAPITEL", "HOOFDSTUK")
CLOSERS = "\"')]»”’"
ENDINGS = r"[.!?:;…]$"


def strip(d, x):
    return d.replace(x, f"^{WS}+|{WS}+$", "")


def normalise(d, x):
    """single spaces, trimmed, lower case; digits stay."""
    return f"lower({strip(d, d.replace(x, WS + '+', ' '))})"


def strip_number(d, x, start=r"\b", end=r"\b"):
    """without a number token before or after, and without trailing signs. ``start`` and ``end`` are the token's edges:
    before an accented letter Java sees no edge, DuckDB does."""
    leading, trailing = LEADING_NUMBER.replace(r"\b", end), TRAILING_NUMBER.replace(r"\b", start)
    return strip(d, d.replace(d.replace(d.replace(d.replace(x, leading, ""), trailing, ""), TRAILING_JUNK, ""), r"\s+", " "))


def upper_words(d, x):
    """F4"""
    return d.upper(strip(d, d.replace(x, WS + "+", " ")))


def letters(d, x):
    """number of letters."""
    return f"cast(length({d.replace(x, r'[^\p{L}]', '')}) as bigint)"


def n_words(d, x):
    return d.count(x, f"[^{SPACES}]+")


def join_hyphen(d, a, b):
    """glue after a single closing hyphen, else one space."""
    return f"case when {a} like '%-' and {a} not like '%--' then concat(substring({a}, 1, length({a}) - 1), {b}) else concat({a}, ' ', {b}) end"


#: Fixed value: a word broken by a hyphen and white space.
HYPHEN_GAP = rf"([A-Za-zÀ-ÖØ-öø-ÿ])-{WS}+([A-Za-zÀ-ÖØ-öø-ÿ])"


def close_hyphens(d, x):
    """F9"""
    return d.replace(x, HYPHEN_GAP, "$1-$2")


def file_name(d, x):
    """a title as a file name of at most 120 characters."""
    clean = d.replace(d.replace(x, r'[<>:"/\\|?*\x00-\x1f]', ""), f"{WS}+", " ")
    edge = lambda s: d.replace(s, r'^[ ".]+|[ ".]+$', "")
    return edge(f"substring({edge(clean)}, 1, 120)")


def title_words(d, x):
    """F11"""
    return strip(d, d.replace(x, "[_-]+", " "))


def is_number_line(d, x):
    """a bare page number, arabic or roman."""
    return f"({d.like(x, '^[0-9]{1,4}$')} or (length({x}) between 1 and 7 and {d.like(x, '(?i)^' + ROMAN + '$')}))"


def candidate_shape(d, x):
    """A line short enough for a running header."""
    return f"({strip(d, x)} <> '' and length({strip(d, x)}) <= 80 and {n_words(d, x)} <= 6)"


#: How a footnote starts.
NOTE_WORD = r"(?i)^\s*(note|notes|remarque|source|sources|voir aussi|see also|ibid|op\. cit)[.: ]"
NOTE_MARK = r"^\s*(\[[0-9]{1,3}\]|\([0-9]{1,3}\)|[0-9]{1,3}[.)]\s|[¹²³⁰-₟]+)"


def is_note(d, x):
    """P4"""
    return f"({strip(d, x)} <> '' and {n_words(d, x)} <= 60 and ({d.like(x, NOTE_WORD)} or ({d.like(x, NOTE_MARK)} and {n_words(d, x)} <= 40)))"


def is_unfinished(d, x):
    """P5: a paragraph that stops within a sentence."""
    t = d.replace(x, rf"""{WS}*["')\]»”’]*{WS}*$""", "")
    return f"(case when {t} = '' then false when {t} like '%-' and {t} not like '%--' then true when {d.like(t, ENDINGS)} then false else {n_words(d, t)} > 12 end)"


def is_continuation(d, x):
    """A paragraph that takes up a sentence."""
    t = d.replace(x, f"^{WS}+", "")
    return f"({d.like(t, r'^\p{Ll}')} or {d.like(t, r'^[)\]»]')} or ({d.like(t, '^[0-9]')} and {n_words(d, t)} > 12))"


#: Fixed value: blocks of figures and signs only.
IGNORABLE = r"^[\s0-9.,;:|·•\-–—()\[\]ivxlcdmIVXLCDM]{0,12}$"


def is_skippable(d, x):
    """A block that a split paragraph may reach over."""
    t = strip(d, x)
    digits = f"length({d.replace(t, '[^0-9]', '')})"
    return (
        f"({t} = '' or {d.like(t, IGNORABLE)} or {is_note(d, x)} or ({n_words(d, t)} <= 12 and not {d.like(t, ENDINGS)})"
        f" or ({d.count(t, ' : ')} >= 2 and {d.count(t, ' ; ')} >= 1) or {digits} >= greatest(4, length({t}) * 0.12))"
    )


#: Headings that stay headings.
KEEP_HEADING = r"(?i)^chapter\s+[0-9]|^context\.|^conclusion|^training exercises|^table\s+[0-9]|^table of contents|^foundation for|^[0-9]+(\.[0-9]+)?[.\s]"


def should_demote(d, x):
    """A heading that reads like a sentence."""
    t = strip(d, x)
    return f"(not {d.like(t, KEEP_HEADING)} and ({d.like(t, r'^\p{Ll}')} or ({d.like(t, '[.!?]$')} and {n_words(d, t)} > 3)))"


def typography(d, x, target):
    """signs as the target language (a column or literal) sets them."""
    flat = d.replace(d.replace(x, f"[{chr(0xA0)}{chr(0x202F)}{chr(0x2009)}]", " "), " +([:;?!])", "$1")
    english = d.replace(d.replace(flat, r"«\s*", "“"), r"\s*»", "”")
    other = d.replace(d.replace(flat, r"«\s+", "«"), r"\s+»", "»")
    german = d.replace(other, '„([^„“”"]*)[“”]', "«$1»")
    return f"case {target} when 'fr' then {x} when 'en' then {english} when 'de' then {german} else {other} end"


def swiss(d, x):
    """F26"""
    return f"replace(replace({x}, 'ß', 'ss'), 'ẞ', 'SS')"


def final_period(d, out, source):
    """no closing full stop that the source does not have."""
    s = d.replace(source, f"{WS}+$", "")
    t = d.replace(out, f"{WS}+$", "")
    return f"case when {s} <> '' and not {d.like(s, '[.!?…:;]$')} and {t} like '%.' and {t} not like '%..' then concat(substring({t}, 1, length({t}) - 1), substring({out}, length({t}) + 1)) else {out} end"


def duration(d, seconds):
    """F41"""
    h, m, s = d.div(seconds, "3600"), d.div(f"({seconds}) % 3600", "60"), f"(({seconds}) % 60)"
    two = lambda v: f"lpad(cast({v} as varchar(10)), 2, '0')"
    return f"case when {h} > 0 then concat(cast({h} as varchar(20)), 'h', {two(m)}) when {m} > 0 then concat(cast({m} as varchar(20)), ' min ', {two(s)}, ' s') else concat(cast({s} as varchar(20)), ' s') end"


def render(d, kind, text):
    """K3: a segment as Markdown."""
    nl = d.newline()
    return f"concat(case {kind} when 'title' then concat('# ', {text}) when 'heading' then concat('## ', {text}) when 'bullet' then concat('- ', {text}) when 'restricted' then concat('> ', replace({text}, {nl}, concat({nl}, '> '))) else {text} end, {nl})"
