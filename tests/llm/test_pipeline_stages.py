"""The pipeline's stages on null, empty, repeated and very long texts, on clashing columns, and on no rows at all."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import common, shingles

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, __text string, __a long, group string, size int, score double"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    long = "\n".join(line(12) for _ in range(14_000))
    assert len(long) > 1_000_000
    copy = line(80)
    texts = [(1, None), (2, ""), (3, "   \n\n"), (4, copy), (5, copy), (5, copy), (5, line(60)), (None, copy), (None, None), (6, long), (7, long), (8, 'Token = "96d17ded865a61704b5b8dc58aafba7d26a3c1ef" ' + line(50)), (9, "é ☃ 日本 " + line(40))]
    return spark.createDataFrame([(i, t, "en", "s1" if i != 9 else None, len(t or ""), "t", 1, "g", 2, 0.5) for i, t in texts], KIND)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_quality_stage(spark, odd):
    """Only whole rows go, whatever their columns are called; equal texts are judged alike."""
    kept = corpus_pipeline.keep_quality(spark, odd, SF)
    assert kept.columns == odd.columns and rows_of(kept) <= rows_of(odd)
    by_text = defaultdict(set)
    for r in odd.collect():
        by_text[r.text].add(rows_of(kept)[tuple(r)] > 0)
    assert all(len(v) == 1 for v in by_text.values())


def test_near_duplicate_stage(spark, odd):
    """One row of each group stays; rows without a doc_id stay all; a repeated row stands for itself twice."""
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, len(r.text or "")) for r in kept.collect())
    texts = {(r.doc_id, len(r.text or "")) for r in odd.collect()}
    assert [g[1] for g in got if g[0]] == [1, 4, 5, 6, 8, 9] and sum(not g[0] for g in got) == 2
    assert {(i, n) for has, i, n in got if has} <= texts


def test_secret_stage(spark, odd):
    """Rows and other columns stay, and only the secret's place in the text changes."""
    clean = corpus_pipeline.redact_secrets(spark, odd, SF)
    assert clean.columns == odd.columns
    before, after = rows_of(odd.filter("doc_id IS NULL OR doc_id <> 8")), rows_of(clean.filter("doc_id IS NULL OR doc_id <> 8"))
    assert Counter((*k[:4], *k[5:]) for k in before.elements()) == Counter((*k[:4], *k[5:]) for k in after.elements())
    r = clean.filter("doc_id = 8").first()
    assert r.text.startswith('Token = "[SECRET]" ') and r.n_chars == len(r.text)


def test_mix_and_encode_stages(spark, odd):
    import sentencepiece

    mixed = corpus_pipeline.mix_sources(spark, odd, SF)
    assert mixed.columns == odd.columns and set(rows_of(mixed)) <= set(rows_of(odd))
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.encode(spark, odd, SF).collect())
    assert got == Counter((r.doc_id, len(sp.encode(r.text or "")) + 1) for r in odd.collect())


def test_stages_without_rows(spark, odd):
    none = odd.filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.encode(spark, none, SF).count() == 0


def test_recall_of_near_duplicates_on_a_table(spark):
    """Every pair at 0.8 on five-word shingles is in one group, and groups are joined by nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles.shingle_set((r.text or "").encode()) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s.tolist():
            holders[h].append(i)
    shared = Counter()
    for held in holders.values():
        shared.update((a, b) for k, a in enumerate(held) for b in held[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    blank = [i for i, s in sets.items() if not len(s)]
    for a, b in [*links, *zip(blank, blank[1:])]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.doc_id: r.group for r in shingles.near_duplicate_groups(docs).collect()}
    assert len(links) > 50
    assert np.mean([got[a] == got[b] for a, b in links]) >= 0.999
    assert got == {i: find(i) for i in sets}


def shuffled(spark):
    """Bytes that the session's finished stages have written to shuffles."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_duplicates_move_few_texts(spark, tmp_path):
    """Texts like no other stay where they are, also where nothing is small enough for Spark to broadcast by itself."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(2_000)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[3]), (201, texts[4] + " more"), (None, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), SF)
        assert rows_of(kept) == Counter(rows[:150] + rows[152:])
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert 0 < moved < 0.3 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [1, 64, 1 << 28])
def test_maybe_among(spark, monkeypatch, most):
    """No key is missed in a map of any size, and few other rows are taken for keys in a large one."""
    monkeypatch.setattr(common, "MOST_KEY_BITS", most)
    ids = spark.range(20_000).selectExpr("id AS a", "IF(id % 10 = 3, NULL, -id) AS b", "CAST(id AS string) AS text")
    keys = ids.filter("a % 7 = 0 AND b IS NOT NULL").select("a", "b")
    out = common.maybe_among(ids, keys, ["a", "b"], "maybe")
    assert out.columns == ["a", "b", "text", "maybe"] and out.count() == 20_000 and not out.filter("maybe IS NULL").count()
    n, maybe = keys.count(), out.filter("maybe")
    assert maybe.join(keys, ["a", "b"], "left_semi").count() == n
    assert most < 1000 or maybe.count() - n < 0.1 * (20_000 - n)
    assert not common.maybe_among(ids, keys.limit(0), ["a", "b"], "maybe").filter("maybe").count()


@pytest.mark.parametrize("most", [1, 1 << 28])
def test_near_duplicate_stage_with_any_map(spark, odd, monkeypatch, most):
    """However many rows the map takes for keys by chance, the exact join decides."""
    monkeypatch.setattr(common, "MOST_KEY_BITS", most)
    kept = rows_of(corpus_pipeline.drop_near_duplicates(spark, odd, SF))
    assert sorted(str(k[0]) for k in kept.elements()) == ["1", "4", "5", "6", "8", "9", "None", "None"]
