"""Text predicates, styling and clean-up as column expressions.

All functions return null for null input unless stated otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of fonts and characters.
SUPERSCRIPT, ITALIC, SERIF, MONO, BOLD = 1, 2, 4, 8, 16
CHAR_STRIKE, CHAR_UNDERLINE, CHAR_SYNTHETIC, CHAR_BOLD, CHAR_FILLED, CHAR_STROKED = 1, 2, 4, 8, 16, 32

# Code points that count as white, and bullet characters.
WHITE_CLASS = "\\x00-\\x20\\xA0\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
BULLETS = ("*", "-", ">", "o", "¶", "·", "‐", "‑", "‒", "–", "—", "―", "†", "‡", "•", "−", "∙", "", "", "�")
#: white space in the sense of trimming: also line and paragraph separators and the BOM
TRIM_CLASS = "\\t\\n\\x0B\\f\\r \\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def is_white(c: Column) -> Column:
    """Nothing but white code points; the empty text is white."""
    return ~c.rlike(f"[^{WHITE_CLASS}]")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{TRIM_CLASS}]+|[{TRIM_CLASS}]+$", "")


def starts_with_bullet(c: Column) -> Column:
    """A bullet alone, or a bullet and a space."""
    first = F.substring(c, 1, 1)
    bullet = first.isin(*BULLETS) | ((first >= "■") & (first <= "◿"))
    return bullet & ((F.length(c) == 1) | (F.substring(c, 2, 1) == " "))


def pack_color(*components: Column) -> Column:
    """Components 0..1 (one gray or three RGB) as 0xRRGGBB; any other number gives 0."""
    if len(components) == 1:
        components = components * 3
    if len(components) != 3:
        return F.lit(0)
    r, g, b = (F.floor(c * 255 + 0.5).cast("int") for c in components)
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def font_flags(italic: Column, serif: Column, mono: Column, bold: Column) -> Column:
    bits = [(italic, ITALIC), (serif, SERIF), (mono, MONO), (bold, BOLD)]
    return sum((F.when(c, b).otherwise(0) for c, b in bits), F.lit(0))


def is_bold(flags: Column, char_flags: Column) -> Column:
    return (flags.bitwiseAND(BOLD) != 0) | (char_flags.bitwiseAND(CHAR_BOLD) != 0)


def is_italic(flags: Column) -> Column:
    return flags.bitwiseAND(ITALIC) != 0


def is_mono(flags: Column) -> Column:
    return flags.bitwiseAND(MONO) != 0


def inline_style(text: Column, bold: Column, italic: Column, mono: Column, link: Column | None = None) -> Column:
    """Markdown of one span: code innermost, then bold, then italic; a space follows.

    A link replaces the text by ``[text](uri)`` before styling.
    """
    t = trim_all(text)
    if link is not None:
        t = F.when(link.isNotNull(), F.concat(F.lit("["), t, F.lit("]("), link, F.lit(")"))).otherwise(t)
    t = F.when(mono, F.concat(F.lit("`"), t, F.lit("`"))).otherwise(t)
    t = F.when(bold, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    t = F.when(italic, F.concat(F.lit("_"), t, F.lit("_"))).otherwise(t)
    return F.concat(t, F.lit(" "))


def heading_style(text: Column, prefix: Column, bold: Column, italic: Column, mono: Column) -> Column:
    """A whole heading line: code, then italic, then bold outermost, after its prefix."""
    t = F.when(mono, F.concat(F.lit("`"), text, F.lit("`"))).otherwise(text)
    t = F.when(italic, F.concat(F.lit("_"), t, F.lit("_"))).otherwise(t)
    t = F.when(bold, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    return F.concat(prefix, t)


def bullet_text(text: Column, x0: Column, left: Column, size: Column, width: Column) -> Column:
    """List item: the bullet becomes ``- ``, double spaces one; indented by the distance from the
    left in mean character widths (half the size where there is no width)."""
    n = F.length(text)
    per = F.when((n > 0) & (width > 0), width / n).otherwise(size / 2)
    indent = F.greatest(F.lit(0), F.floor((x0 - left) / per + 0.5)).cast("int")
    rest = F.regexp_replace(F.substr(text, F.lit(2)), "^ +", "")
    return F.concat(F.repeat(F.lit(" "), indent), F.lit("- "), F.replace(rest, F.lit("  "), F.lit(" ")))


def code_indent(text: Column, x0: Column, left: Column, size: Column) -> Column:
    n = F.greatest(F.lit(0), F.floor((x0 - left) / (size * 0.5))).cast("int")
    return F.concat(F.repeat(F.lit(" "), n), text)


def clean_block(c: Column) -> Column:
    """Once each, in this order: space before a line end, double space, triple line end."""
    c = F.replace(c, F.lit(" \n"), F.lit("\n"))
    c = F.replace(c, F.lit("  "), F.lit(" "))
    return F.replace(c, F.lit("\n\n\n"), F.lit("\n\n"))


def clean_page(c: Column) -> Column:
    """Comma after a space, hyphen at a line end, leading line ends, NUL."""
    c = F.replace(c, F.lit(" ,"), F.lit(","))
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.regexp_replace(c, "^\\n+", "")
    return F.replace(c, F.lit("\x00"), F.lit("�"))


def join_cell_lines(c: Column) -> Column:
    """Lines of a cell in one: a hyphen between letters stays and takes the next line on."""
    c = F.regexp_replace(c, "(?<=\\p{L}-)\\n(?=\\p{L})", "")
    return F.regexp_replace(c, "\\n", " ")


def escape_cell(c: Column) -> Column:
    """Escape ``|`` and a backslash before ``|`` or at the end."""
    return F.regexp_replace(c, "\\\\(?=\\\\*(\\||\\z))|\\|", "\\\\$0")


def strip_leaders(c: Column) -> Column:
    """Leader runs of three or more become a space; spaces squeezed, blank lines dropped."""
    c = F.regexp_replace(c, "[.·…•_][ \\t]*[.·…•_][ \\t]*[.·…•_][.·…•_ \\t]*", " ")
    lines = F.transform(F.split(c, "\\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def looks_broken(c: Column) -> Column:
    """Text that no reader would take for right: empty, with replacement, private-use or control
    characters, or four and more characters of which under half are letters or digits. The
    script of single letters is judged by ``stray_letter``."""
    solid = F.regexp_replace(c, f"[{TRIM_CLASS}]", "")
    known = F.length(F.regexp_replace(solid, "[^\\p{L}\\p{N}]", ""))
    odd = c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{FFFD}\\x{E000}-\\x{F8FF}]")
    return (F.length(solid) == 0) | odd | ((F.length(solid) >= 4) & (known * 2 < F.length(solid)))


_CASED = (("Latin", "IsLatin"), ("Cyrillic", "IsCyrillic"), ("Greek", "IsGreek"))


def stray_letter(c: Column) -> Column:
    """A word of three and more letters with one small letter of a script its two neighbours do
    not share, the first letter aside."""
    hit = F.lit(False)
    for _, a in _CASED:
        for _, b in _CASED:
            if a != b:
                hit = hit | c.rlike(f"(?<=\\p{{{b}}})(?=\\p{{Ll}})\\p{{{a}}}(?=\\p{{{b}}})|(?<=\\p{{{b}}}{{2}})(?=\\p{{Ll}})\\p{{{a}}}(?!\\p{{L}})")
    return hit


# Latin letters that print as Cyrillic ones.
TWINS = dict(zip("ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху", strict=True))
_WORD = re.compile(r"[^\W\d_]+")


def fix_homoglyphs(text: str | None) -> str | None:
    """Latin twins inside Cyrillic words become Cyrillic.

    A mixed word is mended if all its Latin letters have twins. A word of nothing but twins is
    taken for Cyrillic only with a small letter in it and in a text whose Cyrillic words outnumber
    its other Latin words. A capital between small letters becomes small.
    """
    if not text or text.isascii() and not any(c in TWINS for c in text):
        return text
    cyr = lambda c: "Ѐ" <= c <= "ӿ"
    words = _WORD.findall(text)
    cyrillic = sum(any(map(cyr, w)) for w in words)
    other = sum(not any(map(cyr, w)) and not all(c in TWINS for c in w) for w in words)

    def mend(m: re.Match) -> str:
        w = m[0]
        latin = [c for c in w if not cyr(c) and c.isalpha()]
        if not latin or not all(c in TWINS for c in latin):
            return w
        if len(latin) == len(w) and not (any(c.islower() for c in w) and cyrillic > other):
            return w
        new = "".join(TWINS.get(c, c) for c in w)
        if len(new) > 2 and new[-1].islower():
            new = new[0] + "".join(c.lower() if c.isupper() and new[i].islower() else c for i, c in enumerate(new[1:]))
        return new

    return _WORD.sub(mend, text)


def plausibility(c: Column) -> Column:
    """(good - bad / 2) / total over blank-separated tokens: good are numbers and runs of two and
    more letters, punctuation around them aside; 0 for a text without tokens."""
    tokens = F.filter(F.split(c, f"[{TRIM_CLASS}]+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, "^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$", ""))
    good = F.size(F.filter(bare, lambda t: t.rlike("^(\\p{N}[\\p{N}.,:/-]*|\\p{L}{2,}([-'’]\\p{L}+)*)$")))
    n = F.size(tokens)
    return F.when(n > 0, (good - (n - good) * 0.5) / n).otherwise(0.0)
