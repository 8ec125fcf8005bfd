"""Fill-in-the-middle, the word table and hard negatives against brute force and the library."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import middles, negatives, word_table

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\t\n", "a", " a", "a ", " a b ", "one two  three\n\nfour\tfive ", "日本 ☃ é x", "has <P> inside", "ends <", "<|endoftext|> x  <|endoftext|>y", "x" * 5000, " " * 3000, "word " * 4000, "P> S> M>", "<S", "a\x1cb \x85 c"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    pieces = ["the", " ", "  ", "\n", " ", "é", "don't", "42", "...", "<", "S>", "\U0001f600", "w", "naïve", "\t", "\x0b", "　"]
    made = ["".join(random.choices(pieces, k=random.randint(1, 60))) for _ in range(300)]
    made += ["shared words of a hot group "] * 50
    return list(enumerate([*ODD, *made])) + [(None, "no id  here"), (None, None), (3, "an id twice"), (3, "an id twice"), (-5, "negative id of mine")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", "c", [1], "r", "w", 5) for i, t in rows], "doc_id long, text string, part string, chunk string, ids array<int>, raw string, word string, n int").repartition(5)


def cut_by_hand(doc_id, text):
    """The contract, by regular expressions over code points."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def digests_of_middles(df):
    out = middles.fill_in_middle(df)
    back = middles.restored(F.col("output"), F.col("form"))
    return sorted(map(str, (tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(back, 256)).collect())))


def test_middles(docs, rows):
    got = digests_of_middles(docs)
    assert got == sorted(str((i, *cut_by_hand(i, t))) for i, t in rows)
    forms = [x.split("'")[1] for x in got]
    assert all(forms.count(f) > 5 for f in ("plain", "psm", "spm"))
    assert middles.fill_in_middle(docs.limit(0)).collect() == []


def test_middles_of_long_texts_and_all_ids(spark):
    """Texts of a megabyte, and every document cut, in both orders."""
    long = "word \n" * 200_000 + "é" * 300_000
    table = spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string")
    assert digests_of_middles(table) == sorted(str((i, *cut_by_hand(i, long))) for i in range(6))
    for first in (0, 100):
        out = middles.fill_in_middle(table, rate=100, suffix_first=first, sentinels=("<|a|>", "[b]", "(c)"))
        back = out.select("form", middles.restored(F.col("output"), F.col("form"), ("<|a|>", "[b]", "(c)")).alias("t")).collect()
        assert {r.form for r in back} == {"psm" if first == 0 else "spm"} and {r.t for r in back} == {long}


def test_places_of_ranked_bits():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.randint(1, 300)
        mask = rng.getrandbits(width)
        ones = [width - 1 - k for k in range(width) if mask >> k & 1][::-1]
        for rank in range(len(ones) + 1):
            assert middles.select(mask, width, rank) == (ones + [width])[rank]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_words_are_cut_where_the_library_cuts(library):
    """Every character that either side may take for white space, alone and in runs, between words and at the ends."""
    suspects = [c for c in map(chr, range(1, 0x3100)) if c.isspace() or re.match(r"\s", c)] + ["᠎", "​", "⁠", "﻿", "\x1c", "\x1f", "\x00"]
    for c, d in itertools.product(suspects, [" ", "\n", *suspects[:3], "\x85", "\xa0", "\x1c"]):
        for t in (f"a{c}{d}b", f"a{d}{c}b's", f"{c}{d}", f"x{c}{c}{d}1{d}", f".{c}!{d}{d}é"):
            whole = library.encode(t, add_special_tokens=False).ids
            assert [i for w in word_table.WORDS.findall(t) for i in library.encode(w, add_special_tokens=False).ids] == whole, repr(t)


def test_words_are_cut_at_marks_as_the_library_cuts(library):
    random.seed(11)
    pieces = ["don't", "'s", "'x", "1.5", "e.g.", "é,", "日,", "日本a.", "☃,x", "☃", "foo☃!", ",", "...", "(", ")", "ß-", "²", "½.", "ª,", " ", "  ", "\n", "\u0301,", "a\u0301,", "×,", "Ω;", "<|endoftext|>", "x_y", "#1"]
    for _ in range(3000):
        t = "".join(random.choices(pieces, k=random.randint(1, 12)))
        assert [i for w in word_table.split(t, ["<|endoftext|>"]) for i in library.encode(w, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert "".join(word_table.split(t, [])) == t


@pytest.mark.parametrize("chunk_bytes,chunk_words,buckets", [(1, 10**6, 3), (3000, 10**6, 1), (1 << 20, 7, 40), (1 << 24, 10**6, None)])
def test_word_table(docs, rows, library, chunk_bytes, chunk_words, buckets):
    got = sorted(map(str, (tuple(r) for r in word_table.encode_decode(docs, BPE, chunk_bytes, chunk_words, buckets).collect())))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(str((i, ids, library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_word_table_encodes_each_word_once(spark, docs, rows):
    parts = word_table.written(word_table.cut(docs, BPE, 4, 2000), "t")
    asked = parts.filter("bucket >= 0").repartitionById(4, "bucket").sortWithinPartitions("bucket", "chunk")
    table = word_table.written(word_table.word_ids(asked, BPE), "w")
    distinct = {w for _, t in rows for w in word_table.split(t or "", ["<|endoftext|>"])}
    assert parts.select("chunk").distinct().count() >= 5
    assert table.filter("w IS NOT NULL").select("bucket", "w").distinct().count() == len(distinct)


def test_word_table_of_nothing_and_of_long_texts(spark, docs, library):
    assert word_table.encode_decode(docs.limit(0), BPE).collect() == []
    long = [" ".join(f"w{k % 977}é" for k in range(150_000)), "z" * 60_000, "\n" * 50_000]
    table = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in word_table.encode_decode(table, BPE).collect():
        assert r.ids == library.encode(long[r.doc_id], add_special_tokens=False).ids and r.decoded == long[r.doc_id]


def test_decoding_any_ids(spark, library):
    random.seed(2)
    lists = [None, [], [50256, 50256], [220, 198]] + [[random.randrange(50257) for _ in range(k)] for k in range(1, 60)]
    table = spark.createDataFrame([(k % 40 or None, x, "r", "p") for k, x in enumerate(lists)], "doc_id long, ids array<int>, raw string, pos string")
    got = sorted(map(str, (tuple(r) for r in word_table.decode_ids(table, BPE).collect())))
    assert got == sorted(str((k % 40 or None, library.decode(x or [], skip_special_tokens=False))) for k, x in enumerate(lists))


def test_word_table_refuses_other_tokenizers():
    with pytest.raises(ValueError, match="byte-level"):
        word_table.tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def mined_by_hand(rows, every=50, positives=5, negatives_=3):
    """The contract over Python integers; scores beyond a long count as the nearest one."""
    top = 2**63 - 1
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) if abs(x) < 1e290 else int(x) * 256 for x in v]))
    out = []
    for a, label, v in sound:
        if a % every:
            continue
        scored = [(max(-top - 1, min(top, sum(x * y for x, y in zip(v, w)))), i, other) for i, other, w in sound if len(w) == len(v)]
        for p, pid, _ in sorted((r for r in scored if r[2] == label and r[1] != a), key=lambda r: (-r[0], r[1]))[:positives]:
            inside = sorted((-s, i) for s, i, other in scored if other != label and 50 * p <= 100 * s <= 95 * p)
            out += [(a, pid, k + 1, i, p, -s) for k, (s, i) in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(i, v, label, 1, "d", "p") for i, v, label in rows], "vec_id long, embedding array<double>, label int, block int, data string, part string").repartition(4)
    good = negatives.sound(table)
    return sorted(tuple(r) for r in negatives.hard_negatives(good, good.filter(F.col("vec_id") % 50 == 0), **sizes).collect())


@pytest.mark.parametrize("block_rows,part_rows", [(40, 3), (10_000, 10_000)])
def test_negatives(spark, block_rows, part_rows):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 0.4).tolist(), int(rng.integers(10))) for i in range(600)]
    hot = rows[50][1]
    rows += [(1000 + i, hot, i % 3) for i in range(200)]  # copies of an anchor's vector: ties go by id
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 4, 1), (2002, [math.nan] * 6, 1), (2003, [math.inf] * 6, 1), (2004, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(2050, [0.0] * 6, 3), (2051, [], 3), (2100, [], 3), (2101, [], 4), (2102, [0.5], 4), (2150, [0.5], 4), (2103, [0.4], 5), (2105, [-0.3], 5)]
    got = mined(spark, rows, block_rows=block_rows, part_rows=part_rows)
    assert got == mined_by_hand(rows) and len(got) > 100


def test_negatives_of_repeated_rows_and_huge_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(3))) for i in range(120)]
    rows += rows[:30]  # rows twice, the anchors 0 among them
    rows += [(200 + i, [10.0 ** e, 1.0, 1e-300], i % 3) for i, e in enumerate((5, 8, 15, 40, 200, 307, 308, 9, 7, 6))] + [(300, [-1e200, 1e200, 3.0], 1), (350, [2.0**60, 0.0, 0.0], 1)]
    assert mined(spark, rows, block_rows=64, part_rows=2) == mined_by_hand(rows)


def test_negatives_of_few_rows(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.sound(table), negatives.sound(table)).collect() == []
    for rows in ([(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2), (54, [0.4], 2)]):
        assert mined(spark, rows) == mined_by_hand(rows)


def test_bounds_hold_every_score_and_prune_most():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    f = negatives.VectorFile(np.arange(4000), np.arange(4000) % 10, list(v))
    exact = f.scores(v[0], np.arange(4000))
    low, high = f.bounds(v[0], 0, 4000)
    assert (low <= exact).all() and (exact <= high).all()
    asked = []
    f.scores = lambda q, at: asked.append(len(at)) or f.rows[at] @ q
    f.nearest(v[0], 0, 0, 5)
    f.between(v[0], 0, [negatives.window(s) for s in (9000, 8000)], 3)
    assert asked[0] < 40 and asked[1] < 400


def test_windows_of_scores():
    for p in range(-300, 300):
        first, last = negatives.window(p)
        assert [s for s in range(-400, 400) if 50 * p <= 100 * s <= 95 * p] == list(range(first, last + 1))


