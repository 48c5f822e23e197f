"""Text quality statistics and the parting of natural prose from lists, tables and junk.

Every text chunk is measured where it lies: figures of its lines and words, its
kind, and the keys of its lines and paragraphs. A document's figures are sums of
its chunks', its repetition comes from the counted keys, and both decide. Only
narrow rows are shuffled, and a document may hold any share of them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.confusables import prototypes, skeleton
from pagegrain.runtime import materialize, once, small_side

KINDS = ("prose", "list", "table", "junk", "boilerplate")
#: Marks that end a sentence or a clause.
SENTENCE_ENDS = ".!?。！？"
CLAUSE_MARKS = ",;:，；：、"
#: Signs that words lose at their edges.
EDGES = ".,;:!?()[]\"'«»"
#: Characters that UTF-8 read in an 8-bit code page leaves behind.
MOJIBAKE = set("ÃÂâ€™œ�¿½ŸµÅ¤¶„†‡ˆ‰")

_LETTERS = re.compile(r"[^\W\d_]+")
_IDEOGRAPHS = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LIST_ITEM = re.compile(r"\s*(?:[-–—•*·◦‣▪●○+]\s+\S|\(\w{1,4}\)\s+\S|\w{1,3}\)\s+\S|\d{1,4}:?\s+\S|[A-Za-z]\.\s+\S)")
_LEADER = re.compile(r"\.{4,}\s*\S{0,6}\s*$|(?:\.\s){4,}")
_COLUMNS = [re.compile(r"\s\|\s?|\|\s"), re.compile(r"\t+"), re.compile(r"(?<=\S) {2,}(?=\S)"), re.compile(r"\s;\s")]
_SEPARATOR = re.compile(r"\s[|;](?=\s)")
_RULE = re.compile(r"([-=_*~.#+^])\1{7,}")
_CODE_WORD = re.compile(r"(?<!\S)[A-Za-z0-9+/=]{24,}(?!\S)")
_MARK = re.compile(f"[{SENTENCE_ENDS}{CLAUSE_MARKS}]")
_SPACE = re.compile(r"\s+")
_SYMBOL = re.compile(r"[^\w\s]|_")
#: A line of this many words isn't taken for a list item.
LONG_ITEM = 16
#: Share of a document's characters in one pair of words from which it isn't prose, if it has so many words.
TOP_GRAM, TOP_GRAM_WORDS = 0.2, 50
#: Documents whose pairs of words are counted are broadcast up to so many, beyond it they are joined by a shuffle.
BROADCAST_DOCS = 200_000


def _junk_share(text: str, words: list[str]) -> float:
    """Share of the characters other than blanks that no language would have."""
    n = len(_SPACE.sub("", text))
    if not n:
        return 0.0
    symbols = len(_SYMBOL.findall(text))
    broken = 0 if text.isascii() else sum(map(MOJIBAKE.__contains__, text))
    long = [w for w in words if len(w) >= 9]
    odd = sum(len(w) for w in long if len(set(w.lower())) <= 4 or (len(w) >= 24 and not _IDEOGRAPHS.search(w) and _odd_case(w)))
    odd += sum(len(w) for w in _CODE_WORD.findall(text) if _odd_case(w) and len(_LETTERS.findall(w)) != 1)
    ruled = sum(m.end() - m.start() for m in _RULE.finditer(text)) if symbols >= 8 else 0
    return max(symbols / n if symbols > 0.3 * n else 0.0, broken / n * 2, odd / n, ruled / n)


def _odd_case(word: str) -> bool:
    return sum(a.islower() and (b.isupper() or b.isdigit()) for a, b in zip(word, word[1:], strict=False)) > len(word) / 12


def _columns(line: str) -> int:
    return max(len(sep.findall(line.strip())) for sep in _COLUMNS)


@dataclass(frozen=True)
class Limits:
    """Where the rules part the kinds. ``fit_limits`` moves those of FITTED by labelled samples."""

    #: Share of characters no language would have, from which a chunk is junk.
    junk_share: float = 0.33
    #: Share of the characters of a table, a list, and both of a mixture.
    half: float = 0.5
    mixed: float = 0.6
    #: Words a chunk must have before missing sentence marks count against it; marks a word that are too many, and words a mark that are.
    soup_words: int = 18
    many_marks: float = 0.55
    few_marks: float = 40.0
    #: Share of common words from which a text of few marks is word soup.
    known: float = 0.25
    #: Share of the characters in lines or paragraphs met before, and in the dominant pair of words, from which a text is boilerplate.
    repeated: float = 0.5
    top_gram: float = 0.3
    #: Words, lines or paragraphs there must be for that.
    gram_words: int = 30
    repeated_parts: int = 3


#: Limits that are fitted, and the factors tried on each.
FITTED = {name: (0.85, 0.9, 1.1, 1.15) for name in ("junk_share", "half", "soup_words", "many_marks", "few_marks", "known")}
#: Labelled samples used for fitting, at most; the table is small and fixed.
MAX_SAMPLES = 10_000


@dataclass(frozen=True)
class Shape:
    """What the rules look at in a chunk."""

    n_lines: int = 0
    total: int = 0
    table: int = 0
    listed: int = 0
    n_items: int = 0
    sure_item: bool = False
    junk: float = 0.0
    n_words: int = 0
    marks: int = 0
    between: int = 0
    known: float = 0.0
    ideographs: bool = False
    repeated: float = 0.0
    top_gram: float = 0.0


def _repeated(parts: list[str], least: int) -> float:
    """Share of the characters in parts that came before; 0 if fewer than ``least`` parts come again."""
    counts = Counter(parts)
    if len(parts) - len(counts) < least - 1:
        return 0.0
    return 1 - sum(map(len, counts)) / max(1, sum(map(len, parts)))


def chunk_shape(text: str, common: frozenset[str], top_gram: int = 0, table: dict[int, str] | None = None) -> Shape:
    """The figures by which ``kind_of`` decides. ``top_gram``: characters of the dominant pair of words."""
    lines = [x for x in skeleton(text.replace("\t", "   "), table).split("\n") if x.strip()]
    if not lines:
        return Shape()
    joined = "\n".join(lines)
    words = _LETTERS.findall(joined)
    items = [x for x in lines if _is_item(x)]
    least = Limits.repeated_parts
    return Shape(
        n_lines=len(lines), total=sum(map(len, lines)), table=sum(len(x) for x in lines if (k := _columns(x)) >= 2 and not x.rstrip().endswith(tuple(SENTENCE_ENDS)) or k >= 3),
        listed=sum(map(len, items)), n_items=len(items), sure_item=len(lines) == 1 == len(items) and _sure_item(items[0]), junk=_junk_share(_SEPARATOR.sub("  ", text), words), n_words=len(words),
        marks=len(_MARK.findall(joined)), between=sum(len(t) == 1 and not t.isalnum() for t in joined.split()), known=sum(w.lower() in common for w in words) / len(words) if words else 0.0, ideographs=bool(_IDEOGRAPHS.search(joined)),
        repeated=max(_repeated(lines, least), _repeated([p for p in text.split("\n\n") if p.strip()], least)) if len(lines) >= least else 0.0, top_gram=top_gram / len(text),
    )


def kind_of(s: Shape, by: Limits = Limits()) -> str:
    """One of KINDS, by combined rules.

    Junk is what no language would write: sign runs, wrongly decoded text, strings
    of few or wildly mixed letters, words strung together without sentences. A
    table has lines of three or more columns, a list short items with a mark or a
    number before them or a leader behind; half of the characters decide.
    Boilerplate is a text that says the same again and again: most of its lines or paragraphs
    came before, or one pair of words covers much of it. All else is prose,
    headings, captions and notices included.
    """
    if not s.n_lines:
        return "prose"
    if s.junk > by.junk_share:
        return "junk"
    if s.n_lines > 1 and s.table >= by.half * s.total and s.table >= s.listed:
        return "table"
    if (s.n_items > 1 or s.sure_item) and s.listed >= by.half * s.total:
        return "list"
    if s.n_lines > 1 and s.table + s.listed >= by.mixed * s.total and min(s.n_items, s.table) > 0:
        return "table" if s.table > s.listed else "list"
    if s.repeated > by.repeated or s.top_gram >= by.top_gram and s.n_words >= by.gram_words:
        return "boilerplate"
    if s.n_words >= by.soup_words and not s.ideographs and (s.marks + s.between > by.many_marks * s.n_words or (s.marks * by.few_marks <= s.n_words and (s.known > by.known or s.n_words > 40))):
        return "junk"
    return "prose"


def chunk_kind(text: str, common: frozenset[str], by: Limits = Limits()) -> str:
    """The kind of one chunk's text."""
    return kind_of(chunk_shape(text, common, _top_gram(_lowered(text.split()))), by)


def fit_limits(samples: list[tuple[str, str]], common: frozenset[str]) -> Limits:
    """The limits with which fewest samples (text, class) get a wrong class, by trying factors of one limit after another.

    A limit moves only for strictly fewer errors, so that those no sample speaks
    about stay as they are.
    """
    shapes = [(chunk_shape(t, common, _top_gram(_lowered(t.split()))), kind) for t, kind in samples]
    wrong = lambda by: sum((k := kind_of(s, by)) != kind and not (k == "boilerplate" and kind == "junk") for s, kind in shapes)
    best, least = Limits(), wrong(Limits())
    for name, factors in FITTED.items():
        value = getattr(best, name)
        for factor in factors:
            tried = replace(best, **{name: type(value)(value * factor)})
            if (n := wrong(tried)) < least:
                best, least = tried, n
    return best


def train(samples: DataFrame, common_words: DataFrame) -> Limits:
    """Limits fitted to at most ``MAX_SAMPLES`` labelled samples (``sample_id, text, text_class``)."""
    rows = samples.where("text is not null and text_class is not null").orderBy("sample_id").limit(MAX_SAMPLES).select("text", "text_class").collect()
    return fit_limits([tuple(r) for r in rows], _words(common_words))


def _words(common_words: DataFrame) -> frozenset[str]:
    """The small fixed table of frequent words."""
    return frozenset(r[0].lower() for r in common_words.select("word").where("word is not null").distinct().collect())


def _is_item(line: str) -> bool:
    if _LEADER.search(line):
        return True
    if not _LIST_ITEM.match(line):
        return False
    return len(line.split()) <= LONG_ITEM and not line.rstrip().endswith((*SENTENCE_ENDS, ","))


def _sure_item(line: str) -> bool:
    """A line that is a list's even if it stands alone."""
    return bool(_LEADER.search(line) or re.match(r"\s*[•·◦‣▪●○]\s", line))


def _lowered(words: list[str]) -> list[str]:
    return [w.strip(EDGES).lower() for w in words]


def _grams(lowered: list[str]) -> Counter[tuple[str, str]]:
    return Counter(zip(lowered, lowered[1:], strict=False))


def _top_gram(lowered: list[str], least: int = 2) -> int:
    """Characters of the dominant pair of words, of those that come at least so often."""
    return max((n * (len(a) + len(b) + 1) for (a, b), n in _grams(lowered).items() if n >= least), default=0)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def chunk_figures(text: str, common: frozenset[str], by: Limits = Limits(), table: dict[int, str] | None = None) -> tuple:
    """The figures of one chunk, in the order of FIGURES, its kind, and its lines and paragraphs (``KEYS``)."""
    words = text.split()
    lowered = _lowered(words)
    lines = [x for x in (y.strip(" ") for y in text.split("\n")) if x]
    paragraphs = [x for x in (y.strip(" ") for y in text.split("\n\n")) if x]
    n_ideographs = len(_IDEOGRAPHS.findall(text)) if not text.isascii() else 0
    grams = _grams(lowered)
    widths = [(n, n * (len(a) + len(b) + 1)) for (a, b), n in grams.items()]
    kind = kind_of(chunk_shape(text, common, max((w for n, w in widths if n > 1), default=0), table), by)
    return (
        len(text), len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), n_ideographs,
        len(lines), sum(x[-1] in SENTENCE_ENDS + ";:,、；：，" for x in lines), sum(map(common.__contains__, lowered)),
        max((w for _, w in widths), default=0), *(len(text) if kind == k else 0 for k in KINDS[1:]), kind,
        [_key(x) for x in lines], [len(x) for x in lines], [_key(x) for x in paragraphs], [len(x) for x in paragraphs],
    )


FIGURES = ["n_chars", "n_words", "word_chars", "n_symbols", "n_ideographs", "n_lines", "n_ended_lines", "n_common", "gram_bound", *(f"{k}_chars" for k in KINDS[1:])]
KEYS = ["line_keys", "line_sizes", "paragraph_keys", "paragraph_sizes"]


def figures(chunks: DataFrame, common_words: DataFrame, by: Limits = Limits(), id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """``id_col, doc_col``, FIGURES, ``kind`` and KEYS of each distinct chunk with text; null texts have no row.

    ``common_words`` is a small fixed table of frequent words. Repeats of an id
    count once; texts aren't shuffled for that.
    """
    common, table = _words(common_words), prototypes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [chunk_figures(t, common, by, table) for t in batch.column(2).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(FIGURES) + 1 + len(KEYS))
            kinds = [pa.int64()] * len(FIGURES) + [pa.string(), *[pa.list_(pa.int64()), pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "doc", *FIGURES, "kind", *KEYS])

    source = once(chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text")), ["id"])
    schema = f"id {source.schema['id'].dataType.simpleString()}, doc {source.schema['doc'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", kind string, " + ", ".join(f"{c} array<{k}>" for c, k in zip(KEYS, ("bigint", "int") * 2, strict=True))
    return source.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "doc": doc_col})


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def repetition(measured: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """``doc_col, repeated_line_share, repeated_paragraph_share, repeated_prose_chars``: what a document says again.

    The shares are of the characters of its lines, and paragraphs (parted by empty lines),
    those met before anywhere in the document; ``repeated_prose_chars`` are those of the larger of both,
    in prose chunks alone. Only keys and lengths are shuffled, combined before; a
    document may hold any share of the rows. Documents without a line have no row.
    """
    parts = None
    for kind in ("line", "paragraph"):
        rows = measured.select(doc_col, F.lit(kind).alias("kind"), (F.col("kind") == "prose").alias("prose"), F.explode(F.arrays_zip(F.col(f"{kind}_keys").alias("key"), F.col(f"{kind}_sizes").alias("size"))).alias("p"))
        rows = rows.select(doc_col, "kind", "prose", "p.key", "p.size")
        parts = rows if parts is None else parts.unionByName(rows)
    counts = parts.groupBy(doc_col, "kind", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("prose").cast("int")).alias("n_prose"))
    again = lambda kind, n: F.sum(F.when(F.col("kind") == kind, F.greatest(F.col(n) - 1, F.lit(0)) * F.col("size")).otherwise(F.lit(0)))
    whole = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.col("size")))
    share = lambda kind: F.coalesce(again(kind, "n") / whole(kind), F.lit(0.0)).alias(f"repeated_{kind}_share")
    return counts.groupBy(doc_col).agg(share("line"), share("paragraph"), F.greatest(again("line", "n_prose"), again("paragraph", "n_prose")).alias("repeated_prose_chars"))


def dominant_grams(chunks: DataFrame, measured: DataFrame, least_share: float, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """``doc_col, top_gram_share``: the share of a document's characters in its dominant pair of words, for those where it is at least ``least_share``.

    The pair that covers most of a document covers no more than the sum of what the
    dominant pairs of its chunks cover (``gram_bound``). Documents whose bound is
    lower are left out before any pair is counted; those of all others are counted
    exactly. Only keys, lengths and counts are shuffled, spread by document and pair.
    """
    likely = measured.groupBy(doc_col).agg(F.sum("gram_bound").alias("bound"), F.sum("n_chars").alias("n_chars")).where((F.col("bound") >= F.col("n_chars") * least_share) & (F.col("n_chars") > 0))
    likely = materialize(likely.select(F.col(doc_col).alias("__doc"), "n_chars"), "gram-documents")
    marks = small_side(likely.select("__doc"), BROADCAST_DOCS)
    texts = once(chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text")), ["id"])
    source = texts.join(marks, F.col("doc").eqNullSafe(F.col("__doc")), "left_semi").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, sizes, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for (a, b), n in _grams(_lowered(text.split())).items():
                    rows.append(i)
                    keys.append(_key(f"{a} {b}"))
                    sizes.append(len(a) + len(b) + 1)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["doc", "key", "size", "n"])

    grams = source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, key bigint, size int, n bigint").groupBy("doc", "key", "size").agg(F.sum("n").alias("n"))
    top = grams.groupBy("doc").agg(F.max(F.when(F.col("n") > 1, F.col("n") * F.col("size")).otherwise(F.lit(0))).alias("chars"))
    shares = top.join(likely, F.col("doc").eqNullSafe(F.col("__doc"))).select(F.col("doc").alias(doc_col), F.least(F.lit(1.0), F.col("chars") / F.col("n_chars")).alias("top_gram_share"))
    return shares.where(F.col("top_gram_share") >= least_share)


def document_statistics(measured: DataFrame, again: DataFrame, grams: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Statistics per document from ``figures``, ``repetition`` and ``dominant_grams``; 0 where there is nothing to divide by.

    ``is_prose``: at most half of the characters are in chunks of lists, tables, junk
    and boilerplate or, in others, in lines or paragraphs that the document has
    said before; and no pair of words covers ``TOP_GRAM`` of a document of ``TOP_GRAM_WORDS``
    words. ``top_gram_share`` is 0 where it is below what ``grams`` was made with.
    """
    sums = measured.groupBy(F.col(doc_col).alias("__doc")).agg(*(F.sum(c).alias(c) for c in FIGURES))
    for more in (again, grams):
        sums = sums.join(more.withColumnRenamed(doc_col, "__d"), F.col("__doc").eqNullSafe(F.col("__d")), "left").drop("__d")
    sums = sums.fillna(0, ["repeated_line_share", "repeated_paragraph_share", "repeated_prose_chars", "top_gram_share"])
    unnatural = reduce(Column.__add__, (F.col(f"{k}_chars") for k in KINDS[1:])) + F.col("repeated_prose_chars")
    chanted = (F.col("top_gram_share") >= TOP_GRAM) & (F.col("n_words") >= TOP_GRAM_WORDS)
    return sums.select(
        F.col("__doc").alias(doc_col), "n_chars", F.col("n_words").alias("word_count"), _ratio("word_chars", "n_words").alias("mean_word_length"), _ratio("n_symbols", "n_chars").alias("symbol_ratio"),
        _ratio("n_ended_lines", "n_lines").alias("ended_line_share"), _ratio("n_common", "n_words").alias("common_word_share"), *(_ratio(f"{k}_chars", "n_chars").alias(f"{k}_share") for k in KINDS[1:]),
        "repeated_line_share", "repeated_paragraph_share", "top_gram_share", ((unnatural * 2 <= F.col("n_chars")) & ~chanted).alias("is_prose"),
    )
