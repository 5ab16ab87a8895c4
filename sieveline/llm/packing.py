"""Best-fit packing of tokenized documents by sums of squares.

A document is its token ids and an end id; longer ones are cut into pieces of `size`.
Only (document, piece, length) travels: no text and no ids are shuffled. Pieces are dealt
evenly, by a hash, to shards of about `per_shard`, whose number follows the number of
pieces; equal documents or lengths do not gather in one shard. Within a shard, pieces go
from long to short. Each is placed into that open sequence with room after which the sum
of squares of N(g), the number of open sequences with residual gap g, is smallest; a new
sequence is opened only if none has room. A shard wastes less than a sequence or so.

Tokens are those of a byte-pair vocabulary that splits at white space and at changes
between letters and punctuation, so distinct words are encoded once and kept in a bounded
cache of the worker; `python -m pytest tests/llm/test_packing.py` holds this against
encoding whole texts.

Null and empty texts give one piece: the end id. Null doc_ids and repeated rows are
packed like others, each row on its own; ties of length go by doc_id, piece and checksum.
An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, worker_cache

SIZE, END_ID, PER_SHARD = 4096, 1, 20_000
VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers; punctuation that may end a word (no apostrophe, which starts some pieces).
CACHE = 1_000_000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Words:
    """Token ids of white-space separated chunks, as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        ids = self.tokenizer.get_vocab()
        self.last = np.zeros(max(ids.values()) + 1, bool)
        self.last[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        # Special tokens may stand within or across chunks; some controls are white space to one splitter only.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, special)]))
        self.cache: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Cache words of letters alone: each ends with the one token that ends a word."""
        for i in range(0, len(words), 4096):
            own = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):  # some word is not one word to this vocabulary
                self._chunks(own)
            else:
                raw, at = ids.tobytes(), 0
                for w, e in zip(own, (4 * ends).tolist(), strict=True):
                    self.cache[w], at = raw[at:e], e

    def _chunks(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.cache[c] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Cache new chunks."""
        cache = self.cache
        # Letters with ASCII punctuation behind are two pieces to the vocabulary, and it has no upper case.
        ended = {c: (w.lower() if w.isascii() else w, c[len(w) :]) for c in new if (w := c.rstrip(MARKS)).isalpha()}
        cores, tails = ({p[k] for p in ended.values()}.difference(cache) for k in (0, 1))
        self._words([w for w in cores if w])
        self._chunks([t for t in tails if t])
        cache.update({c: cache[w] + cache[t] if t else cache[w] for c, (w, t) in ended.items()})
        self._chunks([c for c in new if c not in cache])

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        cache[""] = b""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        chunks, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn([c for c in chunks if c not in cache])
        ids = list(map(cache.__getitem__, chunks))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        many = sizes[index]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
        out = flat[np.repeat(starts[index] - before[:-1], many) + np.arange(before[-1])]
        cuts = before[split.offsets.to_numpy()]
        found = [out[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, text in enumerate(texts):
            if self.odd.search(text):
                found[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return found


def words(vocabulary: str) -> Words:
    held = worker_cache("packing")
    if vocabulary not in held:
        held[vocabulary] = Words(vocabulary)
    return held[vocabulary]


def tokenized(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    from .toxicity import pieces as runs

    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def batch(rows: dict) -> dict:
        out: dict = {c.split(" ")[0]: [] for c in schema.split(", ")}
        at, encoder = 0, words(vocabulary)
        for run in runs([t or "" for t in rows["text"]], 4 << 20):
            for ids in encoder.encode(run):
                ids += end
                for k, i in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[i : i + 4 * size]
                    for c, v in zip(out, (rows["doc_id"][at], k, i // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                        out[c].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                at += 1
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), batch, schema)


def place(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces in the order given."""
    count = np.zeros(size + 1, np.int64)  # open sequences by residual gap
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - n changes the sum by 2 - 2 N(g) + 2 N(g - n); a full one is no longer open.
        change = 2 - 2 * count[n:size] + 2 * count[: size - n]
        if n < size:
            change[0] -= 1
            change[count[n:size] == 0] = never
        gap = n + int(change.argmin()) if n < size else size
        if n < size and count[gap]:
            s = open_[gap].pop()
            count[gap] -= 1
        else:
            s, gap, made = made, size, made + 1
        sequence[i], offset[i] = s, size - gap
        if gap > n:
            count[gap - n] += 1
            open_[gap - n].append(s)
    return sequence, offset


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, per_shard: int = PER_SHARD) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    pieces = Scratch(docs.sparkSession, "packing").write(tokenized(docs, size, vocabulary, end_id))
    shards = max(1, -(-pieces.count() // per_shard))

    def shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = place(t["length"].to_numpy(), size)
        own = t["shard"][0].as_py() << 32
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence + own)).append_column("offset", pa.array(offset))

    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long")).groupBy("shard").applyInArrow(shard, PLACED)


def sequences(docs: DataFrame, placed: DataFrame, **settings) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = tokenized(docs, with_ids=True, **settings).dropDuplicates(key)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key]
    rows = placed.alias("p").join(ids.alias("i"), same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
