"""LM scoring: a causal self-attention model on subword ids, mixed with the corpus's word counts.

Words of the lower-cased (A-Z) text are runs without space; each is spelled by
subword ids of a public tokenizer, the last one marked, and a text ends with
an end token. ``attention`` gives the probability of a word's spelling in its
context; the probability of a word is a share of that and, if training texts
have the word, the rest of its share of all training tokens. The end token is
a word of its own that every text has once.

Rows are dealt once by a hash of their own content to buckets of about
BUCKET_BYTES and cut there into blocks of whole documents, each a file in the
shared folder with its numbered words and their spellings. All later passes
read these files by name, so neither file splits nor lost executors change a
block, and the scores of a corpus are the same on any cluster.

Counts: each block sends each distinct word's hash once to the task that sums
its range of hashes and gets the sums back; the same pass counts all subword
ids, which choose the vocabulary and the biases. Weights: every training text
takes part in the gradient steps once. In each of the rounds of SCHEDULE every
block of the round is a learner that starts from the common weights; learners
are averaged by tokens, in two levels and in a fixed order, so what is gathered
grows with the input and the driver gets a square root of it. The model's part
of the mixture is that of PARTS which makes the last round's training words
likeliest, each word left out of its own count; it is at most a half, so that no
text falls more than log10(2) a token below the share that the counts give.

Scoring cuts a text into windows that overlap by ``attention.CONTEXT`` tokens;
each token is scored once, with at least so many tokens before it where the
text has them.

Defined results: null or empty text is its end token alone; without training
texts all counts are 0; repeated rows count each and score alike, and lie in
one bucket, which is read in blocks; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import attention as A
from tessera.llm.common import Files, byte_values, fields, map_arrow, packed, spread, stage_table, table, words_in, workspace
from tessera.llm.tokenizing import byte_chars, encoder
from tessera.llm.token_output import default_tokenizer
from tessera.llm.toxicity import remainder

#: Production parameters.
BUCKET_BYTES, BLOCK_WORDS, RANGE_BYTES = 6_000_000, 1_000_000, 16_000_000
#: Shares, in sixteenths, of the blocks that each round trains on; together all.
SCHEDULE = (1, 3, 4, 8)
#: Parts of the mixture that the model may get.
PARTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
#: Model id 0 is the end token and the start of every text, the last one any marked subword outside the vocabulary.
VOCABULARY = A.CLASSES * A.CLASSES
#: Words laid out as tokens at once.
LAID = 100_000
_CACHE = 2_000_000
#: Subword counts are summed by so many tasks.
_SALTS = 16
#: Ranges that are no hashes: subwords, then the end tokens and the list of blocks.
_ENDS, _LISTED = -1 - _SALTS, -2 - _SALTS
#: What subwords outside the vocabulary have beside their count.
_LEAST = 0.02
#: The split of byte-level tokenizers into pieces. Fixed value.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str):
    """The tokenizer as a table of ranks, if it is byte-level, splits by _PIECES and its ids follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout"):
        return None
    vocab, back = model["vocab"], {c: b for b, c in byte_chars().items()}
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    if merged != sorted(merged) or (merged and merged[0] < 256):
        return None
    import tiktoken

    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places begin[k], begin[k] + 1 ... of n[k] each, one after the other."""
    ends = np.cumsum(n)
    out = np.repeat((begin - (ends - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Speller:
    """Words to marked subwords: twice the id, and one more for the last. Keeps the spellings of so many words, by hash."""

    def __init__(self, path: str):
        ranked = _ranked(path)
        if ranked:
            self.encode = ranked.encode_ordinary
            #: which ids begin with the space that goes before a word
            self.first = np.zeros(ranked.n_vocab, dtype=bool)
            self.first[[i for b, i in ranked._mergeable_ranks.items() if b[:1] == b" "]] = True
        else:
            whole = encoder(path)
            self.encode, self.first = lambda s: np.frombuffer(whole(s), "<u4").tolist(), None
        self.hashes, self.begin, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.first is not None:
            # a space splits pieces, so that words side by side are spelled as each alone
            ids = np.array(self.encode((b" " + b" ".join(words)).decode("utf-8", "replace")), dtype=np.int32)
            begin = np.flatnonzero(self.first[ids])
            if len(begin) == len(words) and begin[0] == 0:
                return np.diff(np.append(begin, len(ids))).astype(np.int32), ids
        every = [self.encode(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([len(x) for x in every], dtype=np.int32), np.array([i for x in every for i in x], dtype=np.int32)

    def __call__(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and marked subwords one after the other. hashes: of the words, in ascending order."""
        at = np.searchsorted(self.hashes, hashes)
        old = at < len(self.hashes)
        old[old] = self.hashes[at[old]] == hashes[old]
        new = np.flatnonzero(~old)
        lengths, begin = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        lengths[old], begin[old] = self.lengths[at[old]], self.begin[at[old]]
        ids = self.ids
        if len(new):
            n, fresh = self._spell([words[k] for k in new.tolist()])
            ends = np.cumsum(n)
            fresh = 2 * fresh
            fresh[ends - 1] += 1
            lengths[new], begin[new] = n, ends - n + len(ids)
            ids = np.concatenate([ids, fresh])
            if len(self.hashes) + len(new) <= _CACHE:
                self.ids = ids
                self.hashes, self.begin, self.lengths = (np.insert(x, at[new], y[new]) for x, y in ((self.hashes, hashes), (self.begin, begin), (self.lengths, lengths)))
        return lengths, ids[ragged(begin, lengths)]


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


class Block:
    """Whole documents as numbers of distinct words, in the order of the words' hashes. Number 0 is the end token."""

    def __init__(self, docs: list[list[bytes]]):
        self._number(np.array([len(d) for d in docs], dtype=np.int64), pa.array([w for d in docs for w in d], pa.binary()))

    @classmethod
    def of(cls, sizes: np.ndarray, words: pa.Array) -> Block:
        """sizes: words of each document; words: of all documents, one after the other."""
        out = cls.__new__(cls)
        out._number(sizes, words)
        return out

    def _number(self, sizes: np.ndarray, words: pa.Array) -> None:
        coded = words.dictionary_encode()
        distinct = byte_values(coded.dictionary)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        self.words, self.hashes = [distinct[k] for k in order.tolist()], hashes[order]
        self.sizes = sizes + 1
        self.flat = np.zeros(int(self.sizes.sum()), dtype=np.int32)
        inner = np.ones(len(self.flat), dtype=bool)
        inner[np.cumsum(self.sizes) - 1] = False
        if len(distinct):
            self.flat[inner] = rank[coded.indices.to_numpy(zero_copy_only=False)]

    def spelled(self, spell: Speller) -> tuple[np.ndarray, np.ndarray]:
        """Of all distinct words: lengths, and marked subwords one after the other. The end token has none here."""
        return spell(self.words, self.hashes)


def in_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[str, pa.Table, Block]]:
    """Blocks with their names and their rows' doc_id and learn, from rows (text, doc_id, learn, bucket) sorted by bucket.

    A block ends with its bucket, or with the row that reaches block_words tokens; batches' borders make no difference.
    """
    bucket, part, held, sizes, words, n = None, 0, [], [], [], 0

    def close() -> tuple[str, pa.Table, Block]:
        return f"{bucket}-{part}", pa.Table.from_batches(held), Block.of(np.concatenate(sizes), pa.concat_arrays(words))

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            own, every = words_in(pc.ascii_lower(rows.column(0)))
            buckets = rows.column(3).to_numpy(zero_copy_only=False)
            ends = np.cumsum(own)
            lo = 0
            while lo < rows.num_rows:
                if buckets[lo] != bucket:
                    if held:
                        yield close()
                    bucket, part, held, sizes, words, n = int(buckets[lo]), 0, [], [], [], 0
                begin = ends[lo] - own[lo]
                same = int(np.searchsorted(buckets, bucket, side="right"))
                full = int(np.searchsorted(ends[lo:same] - begin + np.arange(1, same - lo + 1), block_words - n)) + lo + 1
                hi = min(same, full)
                held.append(rows.slice(lo, hi - lo).select([1, 2]))
                sizes.append(own[lo:hi])
                words.append(every.slice(begin, ends[hi - 1] - begin))
                n += int(ends[hi - 1] - begin) + hi - lo
                if n >= block_words:
                    yield close()
                    part, held, sizes, words, n = part + 1, [], [], [], 0
                lo = hi
    if held:
        yield close()


class Kept:
    """A block's file: rows (doc_id, learn, size), word numbers, lengths and marked subwords of the distinct words."""

    def __init__(self, data: pa.Buffer):
        source = pa.BufferReader(data)
        self.rows, *numbers = [pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(4)]
        self.flat, self.lengths, self.ids = [t.column(0).to_numpy() for t in numbers]
        self.sizes = self.rows.column("size").to_numpy()
        self.learn = self.rows.column("learn").to_numpy()

    @staticmethod
    def parts(rows: pa.Table, b: Block, lengths: np.ndarray, ids: np.ndarray) -> list[pa.Buffer]:
        return [packed(t) for t in (rows.append_column("size", pa.array(b.sizes)), *(pa.table([pa.array(x)], names=["x"]) for x in (b.flat, lengths, ids)))]


def count_words(rows: DataFrame, folder: str, bits: int, tokenizer: str, block_words: int) -> tuple[DataFrame, int, int, int, dict[int, int]]:
    """Write blocks and their words' sums below folder. rows: text, doc_id, learn, bucket.

    Returns the blocks' names, N, V, the number of training texts and marked subword -> count.
    """
    sent_schema = fields("range int, block string, keys binary, counts binary")
    answer_schema = fields("block string, range int, n bigint, total bigint, counts binary")

    def batched(rows_: list[tuple], arrow: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows_), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows_[lo : lo + size], strict=True), arrow, strict=True)], names=arrow.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, files, arrow = speller(tokenizer), Files(f"{folder}/blocks"), to_arrow_schema(sent_schema)
        edges = np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
        for name, kept, b in in_blocks(batches, block_words):
            lengths, ids = b.spelled(spell)
            files.write(name, Kept.parts(kept, b, lengths, ids))
            learn = np.repeat(kept.column("learn").to_numpy(), b.sizes)
            counts = np.bincount(b.flat[learn], minlength=len(b.words) + 1)
            own = counts[1:].astype("<u8")
            cut = np.append(np.searchsorted(b.hashes, edges), len(own))
            # the first range always, so that every block gets an answer
            out = [(r, name, b.hashes[cut[r] : cut[r + 1]].tobytes(), own[cut[r] : cut[r + 1]].tobytes()) for r in range(len(edges)) if not r or cut[r] < cut[r + 1]]
            used, place = np.unique(ids, return_inverse=True)
            sums = np.bincount(place, np.repeat(counts[1:], lengths), len(used)).astype("<u8")
            out.append((-1 - xxhash.xxh3_64_intdigest(name) % _SALTS, name, used.astype("<u8").tobytes(), sums.tobytes()))
            # the end tokens, as a word whose key no hash is compared with
            out.append((_ENDS, name, b"", np.array([counts[0]], "<u8").tobytes()))
            yield from batched(out, arrow, 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(answer_schema)

        def close(number: int, blocks: list[str], keys: list[bytes], counts: list[bytes]) -> Iterator[pa.RecordBatch]:
            c = np.frombuffer(b"".join(counts), "<u8").astype(np.int64)
            if number == _ENDS:
                rows_ = [("", number, int(c.sum() > 0), int(c.sum()), b"")]
            else:
                distinct, place = np.unique(np.frombuffer(b"".join(keys), "<u8"), return_inverse=True)
                sums = np.zeros(len(distinct), dtype=np.int64)
                np.add.at(sums, place, c)
                if number < 0:
                    rows_ = [("", number, 0, 0, distinct.astype("<u8").tobytes() + sums.astype("<u8").tobytes())]
                else:
                    rows_ = [("", number, int((sums > 0).sum()), int(sums.sum()), b"")]
                    ends = np.cumsum([len(x) // 8 for x in keys])[:-1]
                    rows_ += [(b, number, 0, 0, s.tobytes()) for b, s in zip(blocks, np.split(sums[place].astype("<u8"), ends), strict=True)]
            yield from batched(rows_, arrow, 1000)

        number, blocks, keys, counts = None, [], [], []
        for batch in batches:
            for r, b, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if r != number and blocks:
                    yield from close(number, blocks, keys, counts)
                    blocks, keys, counts = [], [], []
                number = r
                blocks.append(b)
                keys.append(k)
                counts.append(c)
        if blocks:
            yield from close(number, blocks, keys, counts)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, arrow = Files(f"{folder}/sums"), to_arrow_schema(answer_schema)

        def close(name: str, parts: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            files.write(name, [parts[r] for r in sorted(parts)])
            yield from batched([(name, _LISTED, 0, 0, b"")], arrow, 1)

        name, parts = "", {}
        for batch in batches:
            sums = batch.filter(pc.equal(batch.column(0), ""))
            if sums.num_rows:
                yield sums
            for b, r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not b:
                    continue
                if b != name and parts:
                    yield from close(name, parts)
                    parts = {}
                name = b
                parts[r] = c
        if parts:
            yield from close(name, parts)

    sent = map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket", "hash", "learn").select("text", "doc_id", "learn", "bucket"), send, sent_schema)
    counted = map_arrow(sent.repartition("range").sortWithinPartitions("range", "block"), count, answer_schema)
    # sums have no block: they are dealt by range, so that no task gets all
    placed = counted.repartition(F.when(F.col("block") == "", F.col("range").cast("string")).otherwise(F.col("block"))).sortWithinPartitions("block", "range")
    sums = stage_table(map_arrow(placed, answer, answer_schema), "lm-sums")
    n = sums.where(f"range >= 0 or range = {_ENDS}").agg(F.sum("total"), F.sum("n"), F.sum(F.when(F.col("range") == _ENDS, F.col("total")))).first()
    subwords: dict[int, int] = {}
    for r in sums.where(f"range between {-_SALTS} and -1").select("counts").collect():  # each at most twice the tokenizer's vocabulary
        for i, c in np.frombuffer(bytes(r.counts), "<i8").reshape(2, -1).T.tolist():
            subwords[i] = subwords.get(i, 0) + c
    return sums.where(f"range = {_LISTED}").select("block"), n[0] or 0, n[1] or 0, n[2] or 0, subwords


class Coder:
    """Marked subwords to model ids. rare: ln of the share of each that has the last model id, else 0."""

    def __init__(self, subwords: dict[int, int], ends: int):
        ranked = sorted((i for i, c in subwords.items() if c), key=lambda i: (-subwords[i], i))
        kept, rest = ranked[: VOCABULARY - 2], ranked[VOCABULARY - 2 :]
        size = max(subwords, default=0) + 1
        self.ids = np.full(size, VOCABULARY - 1, dtype=np.int32)
        self.ids[kept] = np.arange(1, len(kept) + 1)
        outside = sum(subwords[i] for i in rest) + _LEAST * size
        share = np.full(size, _LEAST)
        share[rest] += [subwords[i] for i in rest]
        self.rare = np.log(share / outside)
        self.rare[kept] = 0
        self.counts = np.zeros(VOCABULARY)
        self.counts[0] = ends
        self.counts[1 : len(kept) + 1] = [subwords[i] for i in kept]
        self.counts[-1] = sum(subwords[i] for i in rest)


class Laid:
    """A block's words as tokens of the model."""

    def __init__(self, b: Kept, coder: Coder):
        self.b, self.n = b, np.append(1, b.lengths).astype(np.int32)
        self.begin = np.cumsum(self.n) - self.n
        self.every = np.append(0, coder.ids[b.ids]).astype(np.int32)
        #: what ln p of each distinct word has beside its tokens'
        self.rare = np.add.reduceat(np.append(0.0, coder.rare[b.ids]), self.begin)

    def parts(self, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A few documents at a time (rows: only those): document numbers, word numbers, tokens, first token of each word, tokens of each document."""
        b = self.b
        picked = np.arange(len(b.sizes)) if rows is None else np.flatnonzero(rows)
        sizes, first = b.sizes[picked], (np.cumsum(b.sizes) - b.sizes)[picked]
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // LAID)) + 1).tolist(), len(picked)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if lo == hi:
                continue
            own = sizes[lo:hi]
            flat = b.flat[ragged(first[lo:hi], own)] if rows is not None else b.flat[first[lo] : first[hi - 1] + own[-1]]
            n = self.n[flat]
            yield picked[lo:hi], flat, self.every[ragged(self.begin[flat], n)], np.cumsum(n) - n, np.add.reduceat(n, np.cumsum(own) - own)


def learn_weights(blocks: DataFrame, folder: str, coder: Coder, n: int, ends: int) -> tuple[np.ndarray, float]:
    """The model's weights, and its part of the mixture. blocks: names of the files below folder."""
    spark = blocks.sparkSession
    flat, part = A.initial(coder.counts), PARTS[0]
    schema = fields("block string, tokens double, weights binary, likely binary")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder_, start = shared.value
        files, sums = Files(f"{folder}/blocks"), Files(f"{folder}/sums")
        model_parts = np.array(PARTS)[:, None]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                b = Kept(files.read(name))
                counts = np.append(ends, np.frombuffer(sums.read(name), "<i8"))
                # a word's share of the other tokens
                share = np.maximum(counts - 1, 0) / max(1, n - 1)
                laid, t, rng = Laid(b, coder_), A.Trainer(start), np.random.default_rng(7)
                tokens, likely = 0, np.zeros(len(PARTS))
                for _, words, ids, first, sizes in laid.parts(b.learn):
                    ln = t.train(ids, sizes, 0, rng, wanted=last)
                    tokens += len(ids)
                    if not last:
                        continue
                    own = np.exp(np.add.reduceat(ln, first, dtype=np.float64) + laid.rare[words])
                    likely += np.log(np.maximum(model_parts * own + (1 - model_parts) * share[words], 1e-300)).sum(axis=1)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([float(tokens)]), pa.array([t.flat.tobytes()], pa.binary()), pa.array([likely.tobytes()], pa.binary())], names=schema.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likely, tokens = 0.0, 0.0, 0.0
        for batch in batches:
            for k, w, x in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                total = total + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * k
                likely = likely + np.frombuffer(x.as_buffer())
                tokens += k
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([tokens]), pa.array([total.tobytes()], pa.binary()), pa.array([likely.tobytes()], pa.binary())], names=schema.names)

    # a few rounds; a small corpus has no blocks for some
    ends_of = np.cumsum(SCHEDULE)
    place = F.pmod(F.xxhash64(F.lit("lm"), "block"), F.lit(int(ends_of[-1])))
    dealt_out = blocks.withColumn("round", sum((place >= int(e)).cast("int") for e in ends_of))
    rounds = sorted(r.round for r in dealt_out.select("round").distinct().collect())
    for number in rounds:
        mine, last = dealt_out.where(F.col("round") == number).select("block"), number == rounds[-1]
        shared = spark.sparkContext.broadcast((coder, flat))
        trained = stage_table(map_arrow(spread(mine), train, schema), "lm-weights")
        groups = isqrt(trained.count())
        if not groups:
            continue
        # groups and the order in them follow the blocks' names, so that sums are the same each time
        dealt = trained.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).repartition(groups, "group").sortWithinPartitions("group", "block").drop("group")
        sums = sorted((r.tokens, bytes(r.weights), bytes(r.likely)) for r in map_arrow(dealt, add, schema).collect())
        flat = (sum(np.frombuffer(w) for _, w, _ in sums) / sum(k for k, _, _ in sums)).astype(np.float32)
        part = PARTS[int(np.argmax(sum(np.frombuffer(x) for _, _, x in sums)))]
    return flat, part


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(documents: DataFrame, learn, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, bucket_bytes: int = BUCKET_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score. learn: a condition, true for training rows.

    base_score is that of the word counts alone. Other columns of documents, whatever their names, don't matter.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = documents.sparkSession
    rows = documents.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (total // RANGE_BYTES).bit_length()
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod("hash", F.lit(total // bucket_bytes + 1)))
    folder = workspace(spark, "lm-blocks")
    blocks, n, v, ends, subwords = count_words(rows, folder, bits, tokenizer, block_words)
    coder = Coder(subwords, ends)
    flat, part = learn_weights(blocks, folder, coder, n, ends)
    shared = spark.sparkContext.broadcast((coder, flat))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("learned", T.BooleanType()), *fields(SCORES).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, sums = Files(f"{folder}/blocks"), Files(f"{folder}/sums")
        coder_, weights = shared.value
        for batch in batches:
            for name in batch.column(0).to_pylist():
                b = Kept(files.read(name))
                counts = np.append(ends, np.frombuffer(sums.read(name), "<i8"))
                share = (counts + 0.5) / (n + 0.5 * (v + 1))
                begin = np.cumsum(b.sizes) - b.sizes
                base = np.add.reduceat(np.log10(share)[b.flat], begin)
                known = np.add.reduceat((counts > 0)[b.flat].astype(np.int64), begin)
                with np.errstate(divide="ignore"):
                    own = np.log(np.where(counts > 0, share, 0)) + np.log(1 - part)
                laid, score = Laid(b, coder_), np.zeros(len(b.sizes))
                for docs, words, ids, first, sizes in laid.parts():
                    ln = np.add.reduceat(A.score(weights, ids, sizes, 0), first, dtype=np.float64) + laid.rare[words] + np.log(part)
                    begin_of = np.cumsum(b.sizes[docs]) - b.sizes[docs]
                    score[docs] = np.add.reduceat(np.logaddexp(ln, own[words]), begin_of) / np.log(10)
                columns = [b.rows.column("doc_id").combine_chunks(), pa.array(b.learn), pa.array(b.sizes), pa.array(known), pa.array(np.full(len(score), n)), pa.array(base), pa.array(score)]
                yield from pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches(max_chunksize=10_000)

    return map_arrow(spread(blocks), run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_texts(docs, remainder(F.col("doc_id"), 5) != 1)
    return got.select("doc_id", (~F.col("learned")).alias("held_out"), *(x.split()[0] for x in SCORES.split(", ")))
