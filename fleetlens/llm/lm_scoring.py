"""LM scoring with Elias-Fano n-gram tries, one a shard of contexts.

The model is an interpolated bigram model. A trie's first level holds the words
of its shard with their counts, its second the followers of each word with
quantised smoothed probabilities. Words, running sums of counts, pointers
between the levels and followers, made monotone by what their context adds, are
Elias-Fano sequences with packed low bits. A follower is looked up by successor
search between its context's two pointers. A trie is one buffer in
mapped memory; ``train`` stores all of them for ``score_with``.

Documents go to chunks by a hash. A chunk sends each of its different words and
pairs once, with its training counts, to the shard of the first word; the shard
adds them up, builds its trie and answers in the same order; the chunk scores
its texts. Words that lead a large share of all pairs are spread over several
shards. Texts meet once in their chunk, compressed, and never as pairs in rows.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import ASCII_LOWER, chunks, for_group, for_groups, map_batches
from fleetlens.llm._repeats import MIN_ID, distinct, mixed, pack, read_hashes, slices, squeezed, unpack, word_symbols

#: Marks that no word can be: words hold no blanks.
BEGIN, END = b" ", b"\n"
#: Followers are known by 45 bits within their context: of 10 million, one pair or two share a key.
_KEY_BITS = 45
#: Weight of the pair's relative frequency; the rest is the word's.
WEIGHT = 0.7
#: Quantised log10: 1 to 255 for 0 down to -254 / STEPS; 0: not seen.
STEPS = 25
ADD = 0.1
_SENT = "shard int, chunk int, words binary, pairs binary"
_ANSWER = "chunk int, shard int, counts binary, codes binary, n long, v long"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value in as few whole bytes, with room for a read of eight bytes at the end."""
    size = -(-width // 8)
    out = np.zeros(len(values) * size + 8, np.uint8)
    out[: len(values) * size] = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].reshape(-1)
    return out


class EliasFano:
    """A monotone sequence of values below 2**64: low bits packed by bytes, high bits in unary."""

    def __init__(self, lows: np.ndarray, bits: np.ndarray, low_bits: int, n: int) -> None:
        self.bits, self.low_bits, self.n = bits, low_bits, n
        self.mask = np.uint64((1 << low_bits) - 1)
        self.lows = np.ndarray(n, "<u8", lows, strides=(-(-low_bits // 8),)) if low_bits else np.zeros(n, np.uint64)
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = 64 * np.arange(len(bits) + 1) - self.ones

    @staticmethod
    def low_width(n: int, universe: int) -> int:
        return max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """Header, lows and bits of the sequence."""
        n = len(values)
        width = min(EliasFano.low_width(n, universe), 63)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + int(max(universe - 1, 0) >> width) + 2
        bit = np.zeros(-(-size // 64) * 64, np.uint8)
        bit[high + np.arange(n)] = 1
        return [np.array([n, width], np.int64), _packed(values & np.uint64((1 << width) - 1), width), np.packbits(bit, bitorder="little").view(np.uint64)]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th 1 or 0, from 0."""
        before = self.ones if ones else self.zeros
        w = np.searchsorted(before, k, "right") - 1
        word, left, at = self.bits[w] if ones else ~self.bits[w], k - before[w], np.zeros(len(k), np.int64)
        for size in (32, 16, 8, 4, 2, 1):
            part = (word >> at.astype(np.uint64)) & np.uint64((1 << size) - 1)
            inside = np.bitwise_count(part).astype(np.int64)
            over = inside <= left
            left -= np.where(over, inside, 0)
            at += np.where(over, size, 0)
        return w * 64 + at

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | (self.lows[i] & self.mask)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x in [first, last), the whole sequence by default, and whether it is x. x lies below the universe."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & self.mask
        end = self._select(high, False) - high
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        if first is not None:
            begin, end = np.maximum(begin, first), np.minimum(end, last)
        stop = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            mid = (begin[open_] + end[open_]) >> 1
            less = (self.lows[mid] & self.mask) < low[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[begin[open_] < end[open_]]
        found = np.zeros(len(x), bool)
        i = np.flatnonzero(begin < stop)
        found[i] = (self.lows[begin[i]] & self.mask) == low[i]
        return begin, found


class Trie:
    """Words with counts, and their followers with quantised probabilities, in one buffer that can be stored and mapped."""

    def __init__(self, buffer) -> None:
        at = 0

        def read(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        def sequence() -> EliasFano:
            n, width = (int(x) for x in read(np.int64, 2))
            lows = read(np.uint8, n * -(-width // 8) + 8)
            return EliasFano(lows, read(np.uint64, int(read(np.int64, 1)[0])), width, n)

        self.words = sequence()
        self.counts = sequence()
        self.first = sequence()  # where a context's followers begin
        self.followers = sequence()
        self.codes = read(np.uint8, self.followers.n)

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, context: np.ndarray, keys: np.ndarray, pair_counts: np.ndarray, weight: float) -> bytes:
        """words ascending; context (index of a word) and keys ascending together. Counts are kept as running sums, which ascend too."""
        if len(words) >= 1 << (64 - _KEY_BITS):
            raise ValueError("a shard holds more words than its followers' keys leave bits for; take smaller shards")
        out = []

        def write(a: np.ndarray) -> None:
            data = np.ascontiguousarray(a).tobytes()
            out.append(data + bytes(-len(data) % 8))

        def sequence(values: np.ndarray, universe: int) -> None:
            header, lows, bits = EliasFano.encode(values, universe)
            write(header), write(lows), write(np.array([len(bits)])), write(bits)

        sequence(words, 1 << 64)
        sequence(np.concatenate([[0], np.cumsum(counts.astype(np.int64))]), int(counts.sum()) + 1)
        sequence(np.concatenate([[0], np.cumsum(np.bincount(context, minlength=len(words)))]).astype(np.int64), len(keys) + 1)
        sequence((context.astype(np.uint64) << np.uint64(_KEY_BITS)) + keys, max(len(words), 1) << _KEY_BITS)
        ratio = weight * pair_counts / np.maximum(counts[context], 1)
        write(np.clip(1 - np.rint(STEPS * np.log10(np.maximum(ratio, 1e-300))), 1, 255).astype(np.uint8))
        return b"".join(out)

    def count(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, index or -1) of each word."""
        if not self.words.n:
            return np.zeros(len(words), np.int64), np.full(len(words), -1)
        i, found = self.words.successor(words)
        i = np.where(found, i, 0)
        own = (self.counts.access(i + 1) - self.counts.access(i)).astype(np.int64)
        return np.where(found, own, 0), np.where(found, i, -1)

    def code(self, context: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Quantised probability of each follower, searched between its context's pointers; 0 where not seen."""
        out = np.zeros(len(keys), np.uint8)
        ok = np.flatnonzero(context >= 0)
        if len(ok) and self.followers.n:
            c = context[ok].astype(np.int64)
            own, back = np.unique(c, return_inverse=True)
            first, last = self.first.access(own).astype(np.int64)[back], self.first.access(own + 1).astype(np.int64)[back]
            i, found = self.followers.successor((c.astype(np.uint64) << np.uint64(_KEY_BITS)) + keys[ok], first, last)
            out[ok[found]] = self.codes[i[found]]
        return out


def _probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1 - codes.astype(np.float64)) / STEPS), 0.0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _word_values(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, A-Z lower-cased, and how many each text has."""
    parts = [word_symbols([t.translate(ASCII_LOWER) for t in raw[x]]) for x in slices(raw)]
    return np.concatenate([np.zeros(0, np.uint64), *[p.values for p in parts]]), np.concatenate([np.zeros(0, np.int64), *[p.counts for p in parts]])


class Chunk:
    """Different words and pairs of some texts, in an order that doesn't depend on the texts' order."""

    def __init__(self, raw: list[bytes], train: list[bool], shards: int, leaders: dict[int, int]) -> None:
        words, own = _word_values(raw)
        self.sizes = own + 1
        begin = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        values, inside = np.empty(int((self.sizes + 1).sum()), np.uint64), np.ones(int((self.sizes + 1).sum()), bool)
        values[begin], values[begin + self.sizes] = read_hashes([BEGIN, END])
        inside[begin] = inside[begin + self.sizes] = False
        values[inside] = words
        unique, ids = np.unique(values, return_inverse=True)
        token = np.ones(len(ids), bool)
        token[begin] = False
        place = np.flatnonzero(token)
        self.token, before = ids[place], ids[place - 1]
        learned = np.repeat(np.array(train, bool), self.sizes)
        n = len(unique)
        counts = np.bincount(self.token[learned], minlength=n)
        starts = np.bincount(ids[begin[np.array(train, bool)]], minlength=n)
        pairs, self.pair = np.unique(before * n + self.token, return_inverse=True)
        self.before = before
        pair_counts = np.bincount(self.pair[learned], minlength=len(pairs))
        context, keys = pairs // n, (mixed(unique) >> np.uint64(64 - _KEY_BITS))[pairs % n]
        home = (mixed(unique) % np.uint64(shards)).astype(np.int64)
        wide = np.ones(n, np.int64)
        for h, fan in leaders.items():
            i = int(np.searchsorted(unique, np.uint64(h)))
            if i < n and int(unique[i]) == h:
                wide[i] = fan
        pair_shard = (home[context] + (keys % wide[context].astype(np.uint64)).astype(np.int64)) % shards
        # words go to their own shard and to those of their pairs, leaders to all they are spread over, as counts there add up over chunks; sorted by shard and word
        spread = [(home[i] + np.arange(wide[i])) % shards * n + i for i in np.flatnonzero(wide > 1)]
        everyone = np.unique(np.concatenate([home * n + np.arange(n), pair_shard * n + context, *spread]))
        self.entry_shard, entry = everyone // n, everyone % n
        is_begin = unique[entry] == read_hashes([BEGIN])[0]
        self.entry = entry
        self.own = (self.entry_shard == home[entry]) & ~is_begin
        self.order = np.lexsort((keys, context, pair_shard))
        self.pair_shard = pair_shard[self.order]
        self.context_entry = np.searchsorted(everyone, pair_shard[self.order] * n + context[self.order])
        self.home_entry = np.searchsorted(everyone, home * n + np.arange(n))
        self.words, self.word_counts, self.keys, self.pair_counts = unique[entry], (counts + starts)[entry], keys[self.order], pair_counts[self.order]

    def messages(self) -> Iterator[tuple[int, bytes, bytes]]:
        z = zstandard.ZstdCompressor(level=1)
        for s in np.unique(self.entry_shard).tolist():
            a, b = np.searchsorted(self.entry_shard, [s, s + 1])
            x, y = np.searchsorted(self.pair_shard, [s, s + 1])
            low = (self.keys[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            high = (self.keys[x:y] >> np.uint64(32)).astype(np.uint16)
            yield s, pack([self.words[a:b], self.word_counts[a:b].astype(np.int32), self.own[a:b]], z), pack([(self.context_entry[x:y] - a).astype(np.int32), low, high, self.pair_counts[x:y].astype(np.int32)], z)

    def answers(self, shard: np.ndarray, counts: list[bytes], codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: the word's count, its context's count, and the pair's code."""
        entry, code = np.zeros(len(self.entry), np.int64), np.zeros(len(self.keys), np.uint8)
        for s, c, q in zip(shard.tolist(), counts, codes, strict=True):
            a, b = np.searchsorted(self.entry_shard, [s, s + 1])
            x, y = np.searchsorted(self.pair_shard, [s, s + 1])
            entry[a:b], code[x:y] = unpack(c, [np.int64])[0], unpack(q, [np.uint8])[0]
        back = np.empty(len(code), np.uint8)
        back[self.order] = code
        word = entry[self.home_entry]
        return word[self.token], word[self.before], back[self.pair]


def _rows(t: pa.Table) -> tuple[list[int | None], list[bytes], list[bool]]:
    d = zstandard.ZstdDecompressor()
    ids = [None if i == MIN_ID else i for i in t.column("_id").to_pylist()]
    return ids, [b"" if x is None else d.decompress(x) for x in t.column("_text").to_pylist()], [not held_out(i) for i in ids]


def leaders_of(docs: DataFrame, shards: int) -> dict[int, int]:
    """Words that lead over half a shard's share of all pairs, by hash, and over how many shards to spread them: at most four times as many words as shards.

    Batches count all their words and hand on those that reach a quarter of a
    shard's share of the batch; what they leave out is under a quarter of the
    share in all, so that no word of half a share is missed.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            words, own = _word_values([t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()])
            word, times = distinct(np.concatenate([words, np.full(len(own), read_hashes([BEGIN])[0])]))
            n = len(words) + len(own)
            best = times * 4 * shards >= n
            total = np.zeros(int(best.sum()), np.int64)
            total[:1] = n
            yield pa.RecordBatch.from_arrays([pa.array(word[best].view(np.int64)), pa.array(times[best]), pa.array(total)], names=["word", "n", "total"])

    seen = map_batches(docs.select("text"), top, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    seen = seen.persist()
    try:
        total = seen.agg(F.sum("total")).first()[0] or 0
        found = seen.where(F.col("n") * 4 * shards > total).select("word", "n").collect() if total else []  # at most 4 * shards rows
    finally:
        seen.unpersist()
    return {r["word"] % (1 << 64): fan for r in found if (fan := min(shards, 1 + 2 * shards * r["n"] // total)) > 1}


def _asker(n_shards: int, leaders: dict[int, int]):
    def ask(t: pa.Table) -> pa.Table:
        _, raw, train = _rows(t)
        sent = list(Chunk(raw, train, n_shards, leaders).messages())
        chunk = t.column("_chunk")[0].as_py()
        return pa.table({"shard": pa.array([s for s, _, _ in sent], pa.int32()), "chunk": pa.array([chunk] * len(sent), pa.int32()), "words": pa.array([x for _, x, _ in sent], pa.binary()), "pairs": pa.array([x for _, _, x in sent], pa.binary())})

    return ask


def _asked(t: pa.Table) -> list[tuple]:
    """(words, counts, own, context, keys, pair counts) of each chunk's message."""
    out = []
    for a, b in zip(t.column("words").to_pylist(), t.column("pairs").to_pylist(), strict=True):
        context, low, high, n = unpack(b, [np.int32, np.uint32, np.uint16, np.int32])
        out.append((*unpack(a, [np.uint64, np.int32, np.bool_]), context, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), n))
    return out


def _learned(asked: list[tuple], weight: float) -> tuple[list[tuple], bytes, int, int]:
    """The messages, the shard's trie, and the tokens and different words that it holds as their own shard."""
    words, back = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([x[1] for x in asked]), len(words)).astype(np.int64)
    own = np.zeros(len(words), bool)
    own[back[np.concatenate([x[2] for x in asked])]] = True
    base = np.cumsum([0] + [len(x[0]) for x in asked])
    context = np.concatenate([back[o + x[3].astype(np.int64)] for o, x in zip(base, asked, strict=False)])
    keys, n = np.concatenate([x[4] for x in asked]), np.concatenate([x[5] for x in asked])
    seen = np.flatnonzero(n > 0)
    by = seen[np.lexsort((keys[seen], context[seen]))]
    c, k = context[by], keys[by]
    head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])) if len(by) else by
    known = np.flatnonzero(counts > 0)  # the trie has what training has
    place = np.full(len(words), -1)
    place[known] = np.arange(len(known))
    data = Trie.build(words[known], counts[known], place[c[head]], k[head], np.add.reduceat(n[by].astype(np.int64), head) if len(by) else np.zeros(0, np.int64), weight)
    return asked, data, int(counts[own].sum()), int((counts[own] > 0).sum())


def _mapped(data: bytes) -> Trie:
    """A trie over mapped memory of its own, which goes back to the system with it; tasks of a cluster share no folder that can be mapped."""
    level = mmap.mmap(-1, len(data))
    level.write(data)
    return Trie(level)


def _answers(t: pa.Table, asked: list[tuple], data: bytes, n_own: int, v_own: int) -> pa.Table:
    trie, z = _mapped(data), zstandard.ZstdCompressor(level=1)
    out = []
    for x in asked:
        count, at = trie.count(x[0])
        out.append((pack([count], z), pack([trie.code(at[x[3]], x[4])], z)))
    m = t.num_rows
    return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "counts": pa.array([x for x, _ in out], pa.binary()), "codes": pa.array([x for _, x in out], pa.binary()), "n": pa.array([n_own] * m, pa.int64()), "v": pa.array([v_own] * m, pa.int64())})


def _dealt(docs: DataFrame, n_chunks: int) -> DataFrame:
    """Compressed texts with the chunk that each belongs to."""
    keyed = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_ID)).alias("_id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("_chunk"))
    return squeezed(keyed)


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def train(docs: DataFrame, folder: str, weight: float = WEIGHT, shard_bytes: int = 2 << 20, chunk_bytes: int = 8 << 20) -> None:
    """Learns from ``docs`` as ``score`` does and stores the model below ``folder``, which all executors must reach: ``tries``, a row (shard, trie, n, v) a shard, and ``leaders``, the spread words."""
    spark, total = docs.sparkSession, _bytes(docs)
    n_shards, n_chunks = max(1, -(-total // shard_bytes)), max(1, -(-total // chunk_bytes))
    leaders = leaders_of(docs, n_shards)

    def learn(t: pa.Table) -> pa.Table:
        _, data, n, v = _learned(_asked(t), weight)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "trie": pa.array([data], pa.binary()), "n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())})

    tries = _dealt(docs, n_chunks).groupBy("_chunk").applyInArrow(for_group(_asker(n_shards, leaders)), _SENT).groupBy("shard").applyInArrow(for_group(learn), "shard int, trie binary, n long, v long")
    tries.write.parquet(f"{folder}/tries")
    signed = [(int(np.uint64(h).view(np.int64)), fan) for h, fan in leaders.items()]
    spark.createDataFrame([*signed, (None, n_shards)], "word long, fan int").coalesce(1).write.parquet(f"{folder}/leaders")


def score_with(docs: DataFrame, folder: str, weight: float = WEIGHT, chunk_bytes: int = 8 << 20) -> DataFrame:
    """What ``score`` returns, from a model that ``train`` has stored with the same weight; nothing is learned from ``docs``."""
    spark = docs.sparkSession
    rows = spark.read.parquet(f"{folder}/leaders").collect()  # at most four a shard
    n_shards = next(r["fan"] for r in rows if r["word"] is None)
    leaders = {r["word"] % (1 << 64): r["fan"] for r in rows if r["word"] is not None}
    packed = _dealt(docs, max(1, -(-_bytes(docs) // chunk_bytes)))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        data = right.column("trie")[0].as_py() if right.num_rows else _learned([_NOTHING], weight)[1]
        return _answers(left, _asked(left), data, 0, 0)

    tries = spark.read.parquet(f"{folder}/tries")
    asked = packed.groupBy("_chunk").applyInArrow(for_group(_asker(n_shards, leaders)), _SENT)
    answers = asked.groupBy("shard").cogroup(tries.select("shard", "trie").groupBy("shard")).applyInArrow(for_groups(look), _ANSWER).checkpoint()
    n, v = tries.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return _finished(packed, answers, n_shards, leaders, weight, (int(n), int(v)))


#: A message that asks nothing.
_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32))


def score(docs: DataFrame, weight: float = WEIGHT, shard_bytes: int = 2 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Texts whose crc32(doc_id as text) mod 10 isn't 0 are learned from; a null
    doc_id counts as an empty text there, so it is held out. A null text has
    only its end. P(w | h) = weight * c(hw) / c(h) + (1 - weight) * P(w), with
    c(hw) / c(h) quantised to a 25th of a decade, and P(w) alone after a word
    that training lacks; P(w) adds 0.1 to each count. Repeated rows are learned
    as often and come back as often; extra columns are left aside.
    """
    total = _bytes(docs)
    n_shards, n_chunks = max(1, -(-total // shard_bytes)), max(1, -(-total // chunk_bytes))
    leaders = leaders_of(docs, n_shards)
    packed = _dealt(docs, n_chunks)

    answers = packed.groupBy("_chunk").applyInArrow(for_group(_asker(n_shards, leaders)), _SENT).groupBy("shard").applyInArrow(for_group(lambda t: _answers(t, *_learned(_asked(t), weight))), _ANSWER).checkpoint()
    return _finished(packed, answers, n_shards, leaders, weight)


def _totals(answers: DataFrame) -> tuple[int, int]:
    """Training tokens and different words, from each shard's own."""
    per_shard = answers.groupBy("shard").agg(F.first("n").alias("n"), F.first("v").alias("v"))
    n, v = per_shard.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return int(n), int(v)


def _finished(packed: DataFrame, answers: DataFrame, n_shards: int, leaders: dict[int, int], weight: float, trained: tuple[int, int] | None = None) -> DataFrame:
    """Scores of the chunks' texts from the shards' answers."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw, train = _rows(left)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not ids:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        chunk = Chunk(raw, train, n_shards, leaders)
        word, before, code = chunk.answers(right.column("shard").to_numpy(), right.column("counts").to_pylist(), right.column("codes").to_pylist())
        n, v = totals.value
        single = (word + ADD) / (n + ADD * (v + 1))
        both = np.where(before > 0, _probability(code) + (1 - weight) * single, single)
        first = np.cumsum(chunk.sizes) - chunk.sizes
        add = lambda x: np.add.reduceat(x, first)
        columns = [ids, [not x for x in train], chunk.sizes, add((word > 0).astype(np.int64)), np.full(len(ids), n), add(np.log10(single)), add(np.log10(both))]
        return pa.table({m: pa.array(c, k) for m, c, k in zip(names, columns, kinds, strict=True)})

    if trained is None:
        trained = _totals(answers)
    totals = packed.sparkSession.sparkContext.broadcast(trained)
    return packed.groupBy("_chunk").cogroup(answers.select("chunk", "shard", "counts", "codes").groupBy("chunk")).applyInArrow(for_groups(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
