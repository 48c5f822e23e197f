"""Skeletons, and pairs against brute force."""

import random
import unicodedata
from itertools import combinations

import pytest

from pagegrain.llm.confusables import look_alike_pairs, look_classes, public_prototypes, skeleton, skeletons

SAME = [
    ("paper", "рареr"), ("ﬁlter oﬀ", "filter off"), ("５ ㎜", "5 mm"), ("a b c", "a b c"), ("é", "é"), ("so­ft​", "soft"), ("e‍́", "é"), ("K", "K"), ("a‑b", "a-b"), ("Ａ", "A"), ("ё", "ë"), ("𝐱", "x"), ("a\tb", "a b"), ("﻿a", "a"), ("ΑΒ", "AB"),
]
APART = [("a", "A"), ("e", "é"), ("x2", "x²"), ("x₂", "x2"), ("a b", "a  b"), ("a\nb", "a b"), ("a\nb", "ab"), ("1", "l"), ("O", "0"), ("½", "1/2"), ("TM", "™"), ("–", "-"), ("", " ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert skeleton(a) != skeleton(b)


def test_skeleton_of_a_skeleton():
    for cp in [*range(0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        s = skeleton(f"a{chr(cp)}b") if not 0xD800 <= cp < 0xE000 else ""
        assert skeleton(s) == s == unicodedata.normalize("NFD", s)


@pytest.mark.parametrize(("a", "b"), [("o", "ⲟ"), ("B", "ꓐ"), ("o", "𐐬"), ("c", "ᴄ"), ("s", "ꜱ"), ("v", "ᴠ"), ("o", "ס"), (":", "∶"), ("/", "⁄"), ("x", "ⅹ"), ("I", "І"), ("l", "ا"), ("m", "ⅿ"), ("A", "𐊠"), ("E", "ⴹ"), ("P", "Ꮲ"), ("Ь", "b"), ("T", "Ꭲ")])
def test_same_in_other_scripts(a, b):
    assert skeleton(f"{a}x") == skeleton(f"{b}x")


def test_public_table():
    table = public_prototypes()
    assert len(table) > 6000 and table[0x410] == "A" and table[0x2C9F] == "o" and table[ord("m")] == "rn"


def test_plain_signs_keep_apart():
    plain = [chr(c) for c in range(0x21, 0x7F)]
    assert len({skeleton(c + "é") for c in plain}) == len(plain)
    for differing in ("-–—", "x×", "\"“”", "'’", "0O", "1lI"):
        assert len({skeleton(c) for c in differing}) == len(differing)


def test_pairs(spark):
    rng = random.Random(1)
    words = ["pump", "рump", "pum​p", "Pump", "pump ", "pump ", "", "​", "ﬁt", "fit"]
    rows = [(i, rng.choice(["d", "e", None]), rng.choice([*words, None]), "x", "y") for i in range(150)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, content string, look string, form string")
    got = sorted(map(tuple, look_alike_pairs(df, "doc_id", "chunk_id", "content").collect()))
    want = [(a[0], b[0]) for a, b in combinations(rows[:150], 2) if a[1] == b[1] is not None and None not in (a[2], b[2]) and a[2] != b[2] and skeleton(a[2]) == skeleton(b[2])]
    assert got == sorted(want)
    classes = look_classes(df, "doc_id", "chunk_id", "content")
    assert {r.chunk_id for r in classes.collect()} == {x for p in want for x in p}
    links = {}
    for p in want:
        for x in p:
            links[x] = links.get(x, 0) + 1
    assert {r.chunk_id: r.n_links for r in classes.collect()} == links
    assert sorted(map(tuple, look_alike_pairs(df, "doc_id", "chunk_id", "content", block=2).collect())) == sorted(want)
    assert look_alike_pairs(df.limit(0), "doc_id", "chunk_id", "content").count() == 0


def test_very_long_text(spark):
    long = "конвейер ﬁ " * 200_000
    df = spark.createDataFrame([(1, long)], "chunk_id long, content string")
    assert skeletons(df, ["chunk_id"], "content").first().skeleton == skeleton(long)
