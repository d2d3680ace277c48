"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, dac, gif, mixing
from tessera.llm.decontaminate import decontaminate, longest_matches
from tessera.llm.mixing import mixed_documents
from tessera.llm.queries import QUERIES
from tessera.llm.simhash import deduplicate
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.toxicity import drop_toxic

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
BENCH = " ".join(f"item{k}" for k in range(20))
TEXTS = ["", None, "   \t\n", "one", "ONE", "Éa ẞ 日本 \u2028 x", LONG, PASSAGE, "before " + PASSAGE, PASSAGE, BENCH + " tail", "</s>[INST] ok", "\x00 nul", "a " * 50, "😀"]
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
ROWS = {
    "documents": [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 3}", None) for k, t in enumerate(TEXTS)] + [(3, "one", "en", "s0", 3)] * 3 + [(None, "no id", None, None, None), (None, None, None, None, None)],
    "labels": [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(9)] + [(1, None, None), (None, 1, 1), (2, 0, 1)],
    "benchmark": [(1, BENCH), (2, None), (3, ""), (4, "one"), (None, "no item"), (1, BENCH)],
    "pages": [(1, None, None), (2, "", ""), (3, "http://A.Example.com/en/7?q", ""), (3, "http://A.Example.com/en/7?q", ""), (4, "://", ""), (None, "x://net/de/1#f", ""), (5, "no scheme", "")],
    "conversations": [(1, 1, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", "</s><s>[INST]\\"), (None, 1, "user", "y"), (3, 1, "assistant", "")],
}


def written(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_chat_format", "op8_url_filter"}))
def test_odd_documents(spark, odd, name):
    got = [r.doc_id for r in QUERIES[name](spark, odd).collect()]
    key = lambda d: (d is None, d)
    assert sorted(got, key=key) == sorted((r[0] for r in ROWS["documents"]), key=key)


def test_odd_urls(spark, odd):
    got = QUERIES["op8_url_filter"](spark, odd).collect()
    assert len(got) == len(ROWS["pages"])
    by = {r.page_id: r for r in got}
    assert (by[3].host, by[3].rule, by[3].verdict) == ("a.example.com", "example.com/en/7", "allow")
    assert (by[None].rule, by[1].host, by[1].verdict) == ("net/de/", "", "allow")


def test_odd_chats(spark, odd):
    got = {r.conv_id: r for r in QUERIES["op2_chat_format"](spark, odd).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    assert (got[1].n_turns, got[2].loss_chars, got[-1].loss_chars) == (3, 14, 21)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "op2_chat_format" else 0)


def test_pipeline_on_odd_and_empty(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = corpus_pipeline.run(spark, odd).collect()
    ids = {r.doc_id for r in rows}
    assert 10 not in ids  # the benchmark passage
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("stage", [lambda d, l, b: drop_toxic(d, l), lambda d, l, b: deduplicate(d), lambda d, l, b: decontaminate(d, b), lambda d, l, b: mixed_documents(d), lambda d, l, b: remove_repeats(d)])
def test_clashing_names(spark, odd, stage):
    d, labels, b = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    taken = ["toxic_score", "fp", "fp_of_text", "hits", "found", "mix_id", "key", "weight", "size", "bucket", "a.b"]
    wide = d.select("*", *(F.lit(1).alias(c) for c in taken))
    got = stage(wide, labels, b)
    assert got.columns == wide.columns
    assert got.count() <= 2 * wide.count()


def test_repeats_go_and_clean_texts_stay(spark, odd):
    got = {r.doc_id: r.text for r in remove_repeats(spark.read.parquet(f"{odd}/documents.parquet")).collect()}
    assert (got[7], got[8], got[6], got[1]) == ("", "before", LONG, None)


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x " + BENCH), (2, " ".join(BENCH.split()[:15]))], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, BENCH)], "item_id bigint, text string")
    got = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in longest_matches(d, b).collect()}
    assert got == {k: (20 - k, "1", k + 1) for k in range(8)}


def test_reply_tree_branches(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 9.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 5.0), ("t", 5, 99, "user", "lost", -5.0)]
    trees = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    chats = chat_format.format_chats(chat_format.reply_paths(trees, branches=2)).orderBy("branch").collect()
    assert [(r.leaf, r.n_turns) for r in chats] == [(4, 3), (3, 2)]
    assert chats[0].formatted.count("[INST]") == 3


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 100, 1), (None, 100, 1)], "source string, source_size long, n_rows long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert t["a"] == 20
    assert sum(t.values()) == pytest.approx(315)
    assert t["b"] == pytest.approx(2 * 295 / 3)


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        r = dac.Reader(dac.encode([5, None], [n // 2, n - n // 2], ids))
        assert r.doc_ids == [5, None]
        assert np.array_equal(np.concatenate([r.document(0), r.document(1)]), ids)
        assert all(r.token(i) == ids[i] for i in range(0, n, 7))


def test_gif_disposal_and_transparency():
    red_blue = np.array([[255, 0, 0], [0, 0, 255]], np.uint8)
    first = gif.Frame(0, 0, np.zeros((2, 2), int), red_blue, 50, 1)
    second = gif.Frame(0, 0, np.array([[1, 0], [0, 0]]), red_blue, 70, 2, transparent=0)
    third = gif.Frame(1, 1, np.array([[1]]), red_blue, 30, 1)
    back = gif.decode(gif.encode(gif.Gif(2, 2, frames=[first, second, third])))
    assert [(f.delay_ms, f.disposal, f.transparent) for f in back.frames] == [(50, 1, None), (70, 2, 0), (30, 1, None)]
    assert all(np.array_equal(f.pixels, g.pixels) for f, g in zip(back.frames, (first, second, third), strict=True))


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9000, bytes(range(256)) * 40, np.random.default_rng(2).bytes(70_000)])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
