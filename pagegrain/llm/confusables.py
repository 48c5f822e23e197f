"""Texts that look the same but differ in their characters.

Each text gets its skeleton: it is decomposed, every character is replaced by the
prototype of the look-alike table, and the result is decomposed again. Equal
skeletons read the same in print. What the eye can tell apart stays apart: the
number of blanks, line ends, case, accents, raised and lowered signs.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
import sys
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.runtime import materialize

#: Prototype, then letters of other scripts drawn like it. They go before the public table, which parts some of them.
LOOK_ALIKES = """
A ΑАᎪ
B ΒВᏴ
C СϹᏟ
D Ꭰ
E ΕЕᎬ
F Ϝ
G ԌᏀ
H ΗНᎻ
I ΙІӀ
J ЈͿᎫ
K ΚКᏦ
L Ꮮ
M ΜМϺᎷ
N Ν
O ΟОՕ
P ΡРᏢ
Q Ԛ
S ЅՏᏚ
T ΤТᎢ
U Ս
V ѴᏙ
W ԜᎳ
X ΧХ
Y ΥҮ
Z ΖᏃ
a аαɑ
b Ьᖯ
c сϲ
d ԁᏧ
e еҽ
g ɡց
h һհ
i іιɩ
j јϳ
l ӏ
n ոп
o оοօσ
p рρ
q ԛզ
s ѕ
u υս
v νѵ
w ԝѡ
x х
y уγү
- ‐‑
; ;
' ʹʼ
"""
#: Decomposition tags that change nothing the eye can tell apart.
SAME_LOOK = ("wide", "narrow", "noBreak", "compat", "font", "square", "small", "initial", "medial", "final", "isolated")
#: Characters whose listed decomposition looks different.
KEPT = "ſﬅ"
#: Ranges of characters outside category Cf that print nothing.
UNSEEN = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
#: Ranges of characters of category Cf that print something.
SEEN_FORMATS = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
#: Line ends besides the line feed.
LINE_ENDS = "\x0b\x0c\x85  "


_RARE_ASCII = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


#: The public table of look-alikes as the JVM's Unicode library carries it, and the file it is in.
PUBLIC_TABLE, PUBLIC_JAR = "com/ibm/icu/impl/data/icudata/confusables.cfu", "icu4j*.jar"
#: Signs whose look-alikes among other signs are taken from the public table; quotes and dashes differ to the eye.
SIGNS = ":;,./\\*=~_"


def _public_bytes() -> bytes:
    """The public table's file, from Spark's folder or through the driver's JVM."""
    import pyspark

    for home in filter(None, (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__))):
        for jar in glob.glob(os.path.join(home, "jars", PUBLIC_JAR)):
            return zipfile.ZipFile(jar).read(PUBLIC_TABLE)
    context = pyspark.SparkContext._active_spark_context
    stream = context and context._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(PUBLIC_TABLE)
    if not stream:
        raise RuntimeError("the public table of look-alikes is part of Spark's icu4j library, which isn't found")
    return bytes(stream.readAllBytes())


def public_prototypes() -> dict[int, str]:
    """Characters and their prototypes, as the public table has them (its format is that of its library's data files)."""
    data = _public_bytes()
    data = data[struct.unpack(">H", data[:2])[0] :]
    _, _, _, keys_at, n_keys, values_at, n_values, text_at, n_text = struct.unpack(">9I", data[:36])
    keys = struct.unpack(f">{n_keys}I", data[keys_at : keys_at + 4 * n_keys])
    values = struct.unpack(f">{n_values}H", data[values_at : values_at + 2 * n_values])
    text = data[text_at : text_at + 2 * n_text]
    units = ((k & 0xFFFFFF, v, (k >> 24) + 1) for k, v in zip(keys, values, strict=True))
    return {cp: chr(v) if n == 1 else text[2 * v : 2 * (v + n)].decode("utf-16-be") for cp, v, n in units}


def _drawn_as(cp: int, prototype: str) -> str | None:
    """The prototype that is used for a character of the public table, None to leave it as it is.

    ASCII characters differ from one another, which parts the public classes of l, I,
    1 and of O, 0 and of m, rn; another character goes by its kind. Raised and lowered
    signs stay, and of other signs all but those drawn like SIGNS.
    """
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp < 0x80 or ch in KEPT or unicodedata.decomposition(ch).startswith(("<super>", "<sub>")):
        return None
    if kind[0] in "PSZ" or kind == "Cf":
        return prototype if len(prototype) == 1 and prototype in SIGNS else None
    if kind == "Lm" and all(unicodedata.category(c) in ("Lm", "Sk") for c in prototype):
        return None
    if prototype == "l":
        return "I" if kind in ("Lu", "Lt") else "1" if kind == "Nd" else prototype
    if prototype == "O" and kind == "Nd":
        return "0"
    return prototype.replace("rn", "m")


def _within(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _compat(ch: str) -> str:
    """``ch`` with the decompositions of SAME_LOOK applied, again and again."""
    tag, _, parts = unicodedata.decomposition(ch).partition("> ")
    if not tag.startswith("<") or tag[1:] not in SAME_LOOK or ch in KEPT or (parts.startswith("0020 ") and ch != " "):
        return ch
    return "".join(_compat(chr(int(p, 16))) for p in parts.split())


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """The prototype of each character that isn't its own, by rule and table."""
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xF8FF or 0x32400 <= cp < 0xE0000 or cp > 0xE01EF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if (kind == "Cf" and not _within(cp, SEEN_FORMATS)) or _within(cp, UNSEEN):
            table[cp] = ""
        elif kind == "Zs" or cp in (0x09, 0x2800):
            table[cp] = " "
        elif ch in LINE_ENDS:
            table[cp] = "\n"
        elif (to := _compat(ch)) != ch:
            table[cp] = to
    for cp, prototype in public_prototypes().items():
        if cp not in table and (to := _drawn_as(cp, prototype)) is not None:
            table[cp] = to
    for line in LOOK_ALIKES.strip().split("\n"):
        prototype, others = line.split(" ")
        for ch in others:
            table[ord(ch)] = prototype
    for cp in list(table):  # what a decomposition or a prototype gives may be a look-alike itself
        for _ in range(4):
            to = "".join(table.get(ord(c), c) for c in unicodedata.normalize("NFD", table[cp]))
            if to == table[cp]:
                break
            table[cp] = to
    del table[0x20]
    return {cp: to for cp, to in table.items() if to != chr(cp)}


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """The one form of all texts that look like ``text``. ``table`` is ``prototypes()``, which an executor gets from the driver."""
    if text.isascii() and not _RARE_ASCII.search(text):
        return text
    text = unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table)
    return unicodedata.normalize("NFD", text)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def skeletons(df: DataFrame, key_cols: list[str], text_col: str, with_text: bool = True) -> DataFrame:
    """``key_cols``, the digests ``look`` (of the skeleton) and ``form`` (of the text), and the ``skeleton``.

    One row for each row of ``df`` whose text isn't null; an empty text has the
    empty skeleton. Other columns of ``df`` aren't read. No shuffle.
    """
    names = [*key_cols, "look", "form", *["skeleton"] * with_text]
    table = prototypes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, column = batch.columns
            texts = column.to_pylist()
            seen = [skeleton(t, table) for t in texts]
            look = pa.array([_digest(s) for s in seen], pa.binary())
            form = pa.array([_digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*keys, look, form, *[pa.array(seen, pa.string())] * with_text], names=names)

    source = df.where(F.col(f"`{text_col}`").isNotNull()).select(*key_cols, F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in key_cols), "look binary", "form binary", *["skeleton string"] * with_text])
    return source.mapInArrow(run, schema)


def look_classes(df: DataFrame, group_col: str, id_col: str, text_col: str) -> DataFrame:
    """``group_col, id_col, look, form, n_forms, n_links`` of the rows whose look has several forms.

    A class is the rows of one ``group_col`` with one skeleton; it is kept if its
    texts differ. ``n_links``: rows of the class with another text. Repeats of an id
    count once; rows with a null group, id or text are in no class. Only digests are
    shuffled, never texts; the aggregations combine before the shuffle, so a class
    may hold any share of the rows.
    """
    rows = skeletons(df.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()), [group_col, id_col], text_col, with_text=False)
    rows = materialize(rows.distinct(), "looks")
    return rows.join(_forms(rows, group_col), [group_col, "look", "form"]).select(group_col, id_col, "look", "form", "n_forms", (F.col("n_class") - F.col("n_rows")).alias("n_links"))


def _forms(rows: DataFrame, group_col: str) -> DataFrame:
    """``group_col, look, form, n_rows, n_forms, n_class``: the texts of looks that have several, and how many rows each has."""
    forms = rows.groupBy(group_col, "look", "form").agg(F.count(F.lit(1)).alias("n_rows"))
    looks = forms.groupBy(group_col, "look").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n_rows").alias("n_class")).where("n_forms > 1")
    return forms.join(looks, [group_col, "look"])


def look_alike_pairs(df: DataFrame, group_col: str, id_col: str, text_col: str, block: int = 500) -> DataFrame:
    """``{id_col}_a, {id_col}_b``: pairs of one group that look the same and differ, smaller id first.

    Texts meet, not rows: an equality join on group and skeleton gives the pairs of
    different forms, and each form's ids, in blocks of about ``block``, are put out
    for them. So rows of one text never meet, and a look of any size is spread over
    tasks by pairs of blocks.
    """
    rows = skeletons(df.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()), [group_col, id_col], text_col, with_text=False)
    rows = materialize(rows.distinct(), "looks")
    forms = materialize(_forms(rows, group_col).select(group_col, "look", "form", F.ceil(F.col("n_rows") / block).alias("n_blocks")), "look-forms")
    members = rows.join(forms, [group_col, "look", "form"]).withColumn("block", F.pmod(F.xxhash64(id_col), F.col("n_blocks")))
    blocks = materialize(members.groupBy(group_col, "look", "form", "block").agg(F.collect_list(id_col).alias("ids")), "look-blocks")
    one, other = (blocks.select(group_col, "look", F.col("form").alias(f"form_{s}"), F.col("ids").alias(f"ids_{s}")) for s in "ab")
    near = one.join(other, [group_col, "look"]).where("form_a < form_b").select("ids_a", "ids_b")
    spread = near.repartition(F.xxhash64("ids_a", "ids_b"))
    pairs = spread.select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return pairs.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))
