"""The ten queries over their whole tables against SQL twins or brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from conftest import same_rows

from tessera.llm import lm_scoring as lm
from tessera.llm.queries import ORACLES, QUERIES
from tessera.llm.token_output import default_tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, coalesce(\"text\", '') from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_tokens(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    at, wanted = 0, []
    for doc_id, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        wanted.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    got = QUERIES["op1_token_output"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == wanted


def test_toxicity(spark, sf_dir, duck, docs):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()}
    assert sorted(got) == [d for d, _ in docs]
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    labelled = [(got[d], t) for d, t in duck.execute("select doc_id, toxic from labels where toxic is not null").fetchall() if d in got and got[d].held_out]
    right = sum(r.predicted == t for r, t in labelled)
    assert right >= 0.8 * len(labelled)


def test_language_model(spark, sf_dir, docs):
    tokens = {d: [*WORDS.findall(t.translate(LOWER)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op6_lm_scoring"](spark, sf_dir).collect()}
    assert sorted(got) == sorted(tokens)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
        if r.n_known == r.n_tokens:  # half of the mixture is the share that the counts give
            assert r.score >= r.base_score - r.n_tokens * math.log10(2) - 1e-6


def test_language_model_trains_on_every_text(spark, sf_dir, docs, monkeypatch):
    staged = []

    def stage(df, name, put=lm.stage_table):
        out = put(df, name)
        if name == "lm-weights":
            staged.append(out)
        return out

    monkeypatch.setattr(lm, "stage_table", stage)
    learned = [t for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    blocks = lm.Block([[w.encode() for w in WORDS.findall(t.translate(LOWER))] for t in learned])
    lengths, _ = blocks.spelled(lm.speller(default_tokenizer()))
    lm.op6(spark, sf_dir)
    trained = sum(r.tokens for df in staged for r in df.select("tokens").collect())
    assert trained == sum(1 if k == 0 else lengths[k - 1] for k in blocks.flat.tolist())


def fingerprint(text):
    words = WORDS.findall(text.translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    sums = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        sums.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(shingles))


def test_simhash(spark, sf_dir, docs):
    prints = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = QUERIES["op7_simhash"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(d, f"{prints[d]:016x}", find(d)) for d in ids]


def test_media(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op9_media_gif"](spark, sf_dir).collect()}
    assert sorted(got) == [d for d, _ in docs]
    same = {}
    for d, text in docs:
        data = text.encode()
        p = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert same.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
