"""One form for texts that print alike but differ in their characters.

Method: compatibility normalisation (NFKC), full case folding, mapped white space and removal
of default-ignorable characters, once per distinct value of each Arrow batch.

Two forms are made, the second from the first:

* ``visible``: ignorable characters removed, white space mapped to U+0020, look-alike letters
  mapped, canonical composition, and only those compatibility forms undone that print alike
  (width and no-break variants). Equal ``visible`` means equal print.
* ``canonical``: NFKC and full case folding of ``visible``, the form for tolerant comparison.

``same_print_pairs`` groups by ``canonical`` and then checks ``visible`` exactly, because
accent, case, raised digits, dashes and fractions print differently.

Defined results for unusual input: null gives null and is in no pair; an empty text equals
texts of nothing but invisible characters and spaces; spaces U+0020 at either end are ignored
in comparisons; equal code points are no pair; repeated rows of an id count once, the newest
text counts; ids with a null group are compared among themselves; further columns are ignored.

Scale: forms are computed in a narrow pass; only 64-bit hashes travel. Rows are joined only in
groups that hold more than one distinct text, with texts in the key, so a hot document spreads
over its texts; the output is the listed pairs themselves. ``print_classes`` gives one row per
id instead.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that print as a Latin letter in common faces, and that letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
}

# Ranges of default-ignorable code points (property Default_Ignorable_Code_Point)
# and of white space that prints as a space.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
SPACES = ((0x09, 0x09), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _class(ranges) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_IGNORABLE = re.compile(_class(IGNORABLE) + "+")
_SPACES = re.compile(_class(SPACES))
_TABLE = str.maketrans(LOOK_ALIKES)
_PRINT_TAGS = ("<wide>", "<narrow>", "<noBreak>")
_variants: dict[str, str] = {}


def _undo(c: str) -> str:
    if c not in _variants:
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        _variants[c] = "".join(chr(int(x, 16)) for x in rest.split()) if tag in _PRINT_TAGS else c
    return _variants[c]


#: letters whose singleton or symbol form prints the same: ohm, kelvin and angstrom fall to NFC; micro does not
_SAME_SYMBOL = {0xB5: 0x3BC}


def visible_form(text: str) -> str:
    if text.isascii():
        return text.replace("\t", " ").strip(" ")
    text = _IGNORABLE.sub("", text)
    text = "".join(map(_undo, text))
    text = _SPACES.sub(" ", text).translate(_SAME_SYMBOL)
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_TABLE))
    return text.strip(" ")


def canonical_form(text: str) -> str:
    """From the visible form, so that equal visible forms have equal canonical ones."""
    if text.isascii():
        return text.casefold()
    n = unicodedata.normalize("NFKC", text).casefold()
    return _IGNORABLE.sub("", unicodedata.normalize("NFKC", n)).strip(" ")


def _safe(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


_FORMS = T.StructType([T.StructField("visible", T.StringType()), T.StructField("canonical", T.StringType())])


@F.pandas_udf(_FORMS)
def _forms(text: pd.Series) -> pd.DataFrame:
    codes, values = pd.factorize(text)
    v = [_safe(visible_form(x)) for x in values] + [None]
    c = [None if x is None else _safe(canonical_form(x)) for x in v]
    return pd.DataFrame({"visible": [v[i] for i in codes], "canonical": [c[i] for i in codes]})


def with_forms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``visible`` and ``canonical``; input columns of these names are replaced."""
    f = _forms(F.col(text_col).cast("string"))
    return df.withColumn("__f", f).withColumns({"visible": F.col("__f.visible"), "canonical": F.col("__f.canonical")}).drop("__f")


def _keys(df: DataFrame, id_col: str, group_col: str, text_col: str, at_col: str | None) -> DataFrame:
    """id, group and hashes of the canonical form, the visible form and the text itself, one row an id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(text_col).cast("string").alias("t"), (F.col(at_col) if at_col else F.lit(0)).alias("at"))
    rows = rows.filter("id IS NOT NULL AND t IS NOT NULL").withColumn("f", _forms("t"))
    rows = rows.select("id", "at", F.struct("g", F.xxhash64("f.canonical").alias("kc"), F.xxhash64(F.lit("v"), "f.visible").alias("kv"), F.xxhash64(F.trim("t")).alias("kt")).alias("k"))
    return rows.groupBy("id").agg(F.max(F.struct(F.col("at").isNotNull().alias("n"), "at", "k")).alias("m")).select("id", "m.k.*")


def same_print_pairs(df: DataFrame, id_col: str, group_col: str, text_col: str, at_col: str | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of one group whose texts print alike though their code points differ."""
    from pagemill.session import cut

    keys = _keys(df, id_col, group_col, text_col, at_col)
    by = ["g", "kc"]
    mixed = keys.groupBy(*by).agg(F.min("kt").alias("lo"), F.max("kt").alias("hi")).filter("lo <> hi").select(F.col("g").alias("mg"), F.col("kc").alias("mc"))
    rows = cut(keys.join(mixed, F.col("g").eqNullSafe(F.col("mg")) & (F.col("kc") == F.col("mc")), "left_semi"))
    a, b = rows.select([F.col(c).alias(f"{c}_a") for c in rows.columns]), rows.select([F.col(c).alias(f"{c}_b") for c in rows.columns])
    alike = F.col("g_a").eqNullSafe(F.col("g_b")) & (F.col("kc_a") == F.col("kc_b")) & (F.col("kv_a") == F.col("kv_b"))
    return a.join(b, alike & (F.col("kt_a") != F.col("kt_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")


def print_classes(df: DataFrame, id_col: str, group_col: str, text_col: str, at_col: str | None = None) -> DataFrame:
    """One row per id: its group, the class of equal print (hash of the visible form) and the
    number of distinct texts in that class of its group."""
    keys = _keys(df, id_col, group_col, text_col, at_col)
    texts = keys.groupBy("g", "kv", "kt").agg(F.count(F.lit(1)).alias("ids")).groupBy("g", "kv").agg(F.count(F.lit(1)).alias("texts"), F.sum("ids").alias("ids"))
    t = texts.select(F.col("g").alias("tg"), F.col("kv").alias("tv"), "texts", "ids")
    return keys.join(t, F.col("g").eqNullSafe(F.col("tg")) & (F.col("kv") == F.col("tv"))).select("id", F.col("g").alias(group_col), F.col("kv").alias("print_class"), "texts", "ids")
