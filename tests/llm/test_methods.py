"""The operators' own methods: models against plain loops, skew, ties, media rules, and the pipeline stage by stage."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_brute import fingerprint

import corpus_pipeline
from tessera.llm import attention as A
from tessera.llm import gif, mixing, simhash, toxicity, url_filter
from tessera.llm.components import components
from tessera.llm.decontaminate import words_of
from tessera.llm.lm_scoring import PARTS, Coder, speller
from tessera.llm.media_gif import frames, payload_gif
from tessera.llm.queries import QUERIES
from tessera.llm.token_output import default_tokenizer
from tessera.llm.tokenizing import encoder

# The language model.


def ln_by_loops(flat, ids, sizes):
    p, out, begin = A.views(flat.astype(np.float64)), [], 0
    d = A.WIDTH
    for n in sizes:
        doc = [0, *ids[begin : begin + n]]
        for t in range(n):
            first = t // A.SCORED * A.SCORED - A.CONTEXT
            seen = range(max(0, first), t + 1)
            h = {j: (p["E"][doc[j]] + p["P"][j - first]) @ p["W"] for j in seen}
            w = np.exp([h[t][:d] @ h[j][d : 2 * d] / d**0.5 for j in seen])
            g = np.tanh(sum(x * h[j][2 * d : 3 * d] for x, j in zip(w / w.sum(), seen, strict=True)) + h[t][3 * d :])
            g[-1] = 1
            c, k = divmod(doc[t + 1], A.CLASSES)
            z, y = np.exp(p["C"] @ g), np.exp(p["U"][c] @ g)
            out.append(np.log(z[c] / z.sum() * y[k] / y.sum()))
        begin += n
    return np.array(out)


def test_attention_by_loops():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 5, A.SCORED, A.SCORED + 1, 3 * A.SCORED + 7, 60])
    ids = rng.integers(0, A.CLASSES**2, sizes.sum()).astype(np.int32)
    flat = A.initial(np.bincount(ids, minlength=A.CLASSES**2)) + (rng.standard_normal(A.SIZE) * 0.2).astype(np.float32)
    assert A.score(flat, ids, sizes, 0) == pytest.approx(ln_by_loops(flat, ids, sizes), rel=1e-3, abs=1e-4)


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    ids, sizes = rng.integers(0, A.CLASSES**2, 200).astype(np.int32), np.array([1, 70, 129])
    t = A.Trainer(A.initial(np.ones(A.CLASSES**2)))
    table, place = A._tables(t.p)
    t._backward(A.Pass(t.p, table, place, A._wild(t.p, table, place), ids, *A.windows(sizes), 0))
    for k in np.argsort(-np.abs(t.grad))[:400:40]:
        loss = []
        for h in (0.02, -0.02):
            flat = t.flat.copy()
            flat[k] += h
            loss.append(-A.score(flat, ids, sizes, 0).astype(np.float64).mean())
        assert t.grad[k] == pytest.approx((loss[0] - loss[1]) / 0.04, rel=0.05, abs=2e-5)


def test_training_beats_the_counts():
    """Words of two languages that don't mix: what came before tells which one it is."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 30, 100) + 30 * (k % 2) for k in range(400)]
    ids, sizes = np.concatenate(docs).astype(np.int32), np.full(400, 100)
    start = A.initial(np.bincount(ids, minlength=A.CLASSES**2))
    t = A.Trainer(start)
    for _ in range(20):
        t.train(ids[:30_000], sizes[:300], 0, rng)
    before, after = (A.score(f, ids[30_000:], sizes[300:], 0).mean() for f in (start, t.flat))
    assert after > before + 0.4  # ln 2 is all that there is to learn


def test_large_weights_give_probabilities():
    """Both steps of a prediction may be near the largest exp: their product is beyond the largest number."""
    rng = np.random.default_rng(5)
    ids, sizes = rng.integers(0, 10, 100).astype(np.int32), np.array([100])
    flat = A.initial(np.ones(A.CLASSES**2))
    p = A.views(flat)
    p["C"][0, -1] = p["U"][0, :10, -1] = 50
    assert A.score(flat, ids, sizes, 0) == pytest.approx(ln_by_loops(flat, ids, sizes), rel=1e-3, abs=1e-4)


def test_only_weights_that_may_overflow_are_held():
    """Rare ids have biases far below 0, which no exp has to be kept from."""
    counts = np.ones(A.CLASSES**2)
    counts[0] = 1e6
    flat = A.initial(counts)
    p = A.views(flat)
    assert p["C"].min() < -5
    assert A._wild(p, *A._tables(p)) == (False, False)
    p["U"][3, 3, :-1] = 6
    assert A._wild(p, *A._tables(p)) == (False, True)


def test_spellings_are_the_tokenizers():
    spell, whole = speller(default_tokenizer()), encoder(default_tokenizer())
    words = [b"the", "naïve".encode(), "a b".encode(), " ".encode(), b"x" * 500, "日本語".encode(), b"don't,", b"\x00", b"1234567"]
    hashes = np.arange(len(words), dtype=np.uint64) + np.uint64(2**63)
    for _ in range(2):  # new, and kept
        lengths, ids = spell(words, hashes)
        for w, n, end in zip(words, lengths, np.cumsum(lengths), strict=True):
            own = ids[end - n : end]
            assert (own // 2).tolist() == np.frombuffer(whole(" " + w.decode()), "<u4").tolist()
            assert (own % 2).tolist() == [0] * (n - 1) + [1]


def test_rare_subwords_share_one_id():
    counts = {2 * k: 10_000 - k for k in range(A.CLASSES**2)}
    c = Coder(counts, 5)
    assert c.counts.sum() == sum(counts.values()) + 5 and c.counts[0] == 5
    rare = np.flatnonzero(c.ids == A.CLASSES**2 - 1)
    assert 0.99 < np.exp(c.rare[rare]).sum() <= 1  # the rest is set aside for those with an id of their own
    assert max(PARTS) <= 0.5


# Tokens.


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ'sx ,.\n\t09_éß½-"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_is_the_library(text):
    import tokenizers

    whole = test_encoder_is_the_library.__dict__.setdefault("library", tokenizers.Tokenizer.from_file(default_tokenizer()))
    assert np.frombuffer(encoder(default_tokenizer())(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


# Toxicity.


def test_label_model_finds_the_voters(spark):
    rng = np.random.default_rng(6)
    y = rng.random(6000) < 0.3
    rates = [(0.8, 0.05), (0.6, 0.1), (0.5, 0.02), (0.7, 0.3)]
    votes = np.column_stack([rng.random(6000) < np.where(y, a, b) for a, b in rates]).astype(np.float32)
    copies = np.column_stack([votes, votes[:, [3]], votes[:, [3]]])  # the weakest voter three times
    given_ = np.where(rng.random(6000) < 0.1, ~y, y).astype(np.float32)
    for v in (votes, copies):
        p = toxicity.label_model(v, given_)
        assert ((p > 0.5) == y).mean() > max(0.93, (given_ == y).mean())
        for k, (a, b) in enumerate(rates):
            assert (p @ v[:, k] / p.sum(), (1 - p) @ v[:, k] / (1 - p).sum()) == pytest.approx((a, b), abs=0.06)


def test_toxic_rows_are_caught_and_clean_ones_left(spark):
    folder = "/root/testdata/sf0.01"  # a tenth of it has too few toxic rows to learn from
    if not Path(folder).exists():
        pytest.skip(folder)
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, folder).collect() if r.held_out}
    labels = {r.doc_id: r.toxic for r in toxicity.labels_of(spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.doc_id in got}
    toxic, clean = [d for d, t in labels.items() if t], [d for d, t in labels.items() if not t]
    assert toxic and sum(got[d].predicted for d in toxic) >= 0.5 * len(toxic)
    assert sum(got[d].predicted for d in clean) <= 0.02 * len(clean) + 1


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(k, "other") for k in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id bigint, toxic int")
    rows = toxicity.training_sample(docs, labels, 10).collect()
    assert len(rows) == 10


# Near-dedup.


def test_hot_keys_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 30)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (20, 2))})
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    wanted = {x: find(x) for x in prints}
    for run in (simhash.RUN, 4):
        got = {r.node: r.root for r in components(simhash.links_of(df, run=run)).collect()}
        assert {x: got.get(x, x) for x in prints} == wanted
    signed = df.select(F.lit(5).cast("bigint").alias("key"), "fp")
    split = simhash.split_runs(signed, 100).groupBy("key").agg(F.collect_set("fp").alias("fp")).collect()
    assert max(len(r.fp) for r in split) < 200 < len(prints)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (3, 4), (4, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 21)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ties_keep_the_same_row(spark):
    rows = [(1, "  ", "b"), (1, None, "c"), (1, "", "a"), (2, "", "x"), (None, "", "y"), (5, "one two three four", "q"), (5, "one two three four", "p")]
    seen = set()
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(n)
        seen.add(tuple(sorted(map(str, simhash.deduplicate(df).collect()))))
    assert len(seen) == 1
    assert len(seen.pop()) == 2


# Mixing.


@pytest.mark.parametrize("weight", [0.01, 1.0, 50.0])
def test_buckets_are_even_for_any_weight(spark, weight, monkeypatch):
    staged, docs = [], spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    monkeypatch.setattr(mixing, "stage_table", lambda df, name, put=mixing.stage_table: staged.append(put(df, name)) or staged[-1])
    got = mixing.mix(docs, docs.select("doc_id", F.lit(weight).alias("weight")), bucket_rows=500)
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 60_000, rel=0.001)
    buckets = staged[0].groupBy(F.floor(F.log("key") * 40)).count()
    assert buckets.agg(F.max("count")).first()[0] <= 500


# URLs.


def test_columns_of_pages_stay(spark):
    pages = spark.createDataFrame([("http://a.com/en/1", "mine", "own", 7)], "url string, host string, rule string, best int")
    rules = spark.createDataFrame([("block", "com", "/en/")], "action string, host string, path string")
    r = url_filter.judge(pages, rules).first()
    assert (r.host, r.rule, r.best, r.host_, r.rule_, r.verdict) == ("mine", "own", 7, "a.com", "com/en/", "block")


def test_only_short_hashes_join(spark, sf_dir):
    plan = QUERIES["op8_url_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "rule_short" in x]
    assert joins and all("startswith" in x.lower() for x in joins)


# Media.


def test_frames_are_played_by_their_rules(spark):
    colours = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    px = lambda *rows: np.array(rows)
    played = gif.Gif(2, 2, frames=[
        gif.Frame(0, 0, px([0, 0], [0, 0]), colours, 10, 1),  # stays
        gif.Frame(0, 0, px([1, 2]), colours, 20, 3, transparent=2),  # goes back to what was there
        gif.Frame(1, 1, px([2]), colours, 30, 2),  # its box is cleared
        gif.Frame(0, 0, px([1]), colours, 40, 0),
    ])
    r, g, b, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    wanted = [[[r, r], [r, r]], [[g, r], [r, r]], [[r, r], [r, b]], [[g, r], [r, none]]]
    screens = [(s.tolist(), d) for s, d in gif.composite(gif.decode(gif.encode(played)))]
    assert screens == [([[list(c) for c in row] for row in w], d) for w, d in zip(wanted, (10, 20, 30, 40), strict=True)]
    media = spark.createDataFrame([(1, bytearray(gif.encode(played))), (2, bytearray(b"no gif")), (3, None)], "k int, media binary")
    rows = frames(media, key="k").orderBy("k", "frame").collect()
    assert [(x.k, x.frame, x.start_ms) for x in rows] == [(1, 0, 0), (1, 1, 10), (1, 2, 30), (1, 3, 60), (2, None, None)]
    assert rows[-1].error and rows[3].histogram[64] == 1


def test_feature_and_media_by_replay(spark, sf_dir, duck):
    texts = dict(duck.execute("select doc_id, coalesce(\"text\", '') from documents").fetchall())
    for r in QUERIES["op9_media_gif"](spark, sf_dir).collect()[:40]:
        data = texts[r.doc_id].encode()
        data = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        media = payload_gif(data)
        pixels = [gif.decode(media).frames[k].pixels.tobytes() for k in range(len(gif.decode(media).frames))]
        assert b"".join(pixels) == data and len(media) == r.media_bytes
        bins, rows, high = Counter(), len(pixels[0]) // 64, 0
        for own in pixels:  # a last frame of fewer rows leaves the rest of the screen transparent
            bins.update((x >> 6 << 4) | ((x >> 3 & 3) << 2) | (x & 3) for x in ())
            high += 1
            bins.update(own)
            bins["none"] += rows * 64 - len(own)
        assert r.feature.startswith(f"frames={high};")
        table = {k: (int(c[0]) >> 6) << 4 | (int(c[1]) >> 6) << 2 | int(c[2]) >> 6 for k, c in enumerate(gif.decode(media).frames[0].palette)}
        total = [0] * 65
        for k, n in bins.items():
            total[64 if k == "none" else table[k]] += n
        assert r.feature.endswith("bins=" + bytes(n * 255 // sum(total) for n in total).hex())


# The pipeline.


def test_stages_by_brute_force(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, sf_dir), name)
        out[name] = docs.collect()
        assert name == "token_output" or docs.columns == names
    # toxicity: the rows below the threshold of the model that the stage's input gives
    scores = toxicity.with_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")), "s")
    assert {r.doc_id for r in out["toxicity"]} == {r.doc_id for r in scores.where("s < 0.7").collect()}
    # near copies: the smallest doc_id of each component
    prints = {r.doc_id: fingerprint(r.text or "") for r in out["toxicity"]}
    stay, todo = set(), sorted(prints)
    while todo:
        group, queue = {todo[0]}, [todo[0]]
        while queue:
            x = queue.pop()
            near = {d for d in todo if d not in group and (prints[d] ^ prints[x]).bit_count() <= 3}
            group |= near
            queue += near
        stay.add(min(group))
        todo = [d for d in todo if d not in group]
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(stay)
    # benchmark passages
    items = [words_of((t or "").encode()) for (t,) in duck.execute("select \"text\" from benchmark where item_id is not null").fetchall()]
    by_length = {}
    for w in items:
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            by_length.setdefault(n, set()).add(tuple(w[s : s + n]))
    clean = set()
    for r in out["near_dedup"]:
        w, hit = words_of((r.text or "").encode()), set()
        for n, every in by_length.items():
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in every:
                    hit.update(range(s, s + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(r.doc_id)
    assert {r.doc_id for r in out["decontamination"]} == clean
    # the mix: each row as often as the operator says, and near the target
    taken = Counter(r.doc_id for r in out["mixing"])
    assert set(taken) <= clean and max(taken.values()) <= 2
    size = {r.doc_id: len((r.text or "").encode().split()) for r in out["decontamination"]}
    assert sum(size[d] * n for d, n in taken.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    # tokens: the library's, in order
    import tokenizers

    library = tokenizers.Tokenizer.from_file(default_tokenizer())
    at, wanted = 0, []
    for r in sorted(out["mixing"], key=lambda r: (r.doc_id, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out["token_output"]) == sorted(wanted)
