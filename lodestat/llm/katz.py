"""Katz backoff language model of word pairs: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

Texts are tokenised once into chunks (some MB of text each, one row of a stored table). Each chunk asks for what it
needs, once for each distinct word and pair: requests are dealt into buckets by word or history, a bucket sums the
training counts over all chunks and answers every chunk. A word or pair in every document costs a request for each
chunk at most, not one for each time that it occurs, and pairs with a very frequent history are dealt by both words.

A bucket is read whole by one task, and the bucket of a word that all chunks have gets a row from each of them, so
that requests grow with chunks x buckets: about 19 million short rows at 30 GB. Beyond some TB larger chunks and
buckets are needed. The order is two: a word backs off from its pair to its own add-one probability.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, slices, stored

#: Text bytes of a chunk and of a bucket's share.
CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 12_000_000
#: Counts above this are not discounted.
K = 5
#: A word that makes up at least 1 / HOT of all tokens is a frequent history; there are at most HOT of them.
HOT = 2048
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)
END = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    """The lower-cased words, and one end."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    words.append(END)
    return words


def _squeeze(x: np.ndarray | bytes) -> bytes:
    """Compressed; numbers in as few bytes as their largest needs, byte planes apart."""
    import zstandard

    if isinstance(x, np.ndarray):
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        x = bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(x)


def _numbers(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    planes = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _words(b: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b).split(b"\n")


def _ascending(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _chunks(docs: DataFrame) -> DataFrame:
    """docs: (id, t, train). One row for each chunk of documents: ids, train, n (tokens), own numbers of tokens, words."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        fresh = lambda: (defaultdict(), [], [], [], [])
        vocabulary, ids, train, n, runs = fresh()
        vocabulary.default_factory = vocabulary.__len__
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array([(part << 32) | made]), pa.array([ids], pa.list_(kind)), pa.array([train], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([_squeeze(np.concatenate(runs))], pa.binary()), pa.array([_squeeze(b"\n".join(vocabulary))], pa.binary()), pa.array([size])]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "train", "n", "tokens", "words", "bytes"])

        for b in slices(batches):
            kind = b.schema.field(0).type
            for i, t, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = tokens(t)
                runs.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                ids.append(i), train.append(bool(w)), n.append(len(own))
                size += 64 + len(t or "")
                if size >= CHUNK_BYTES:
                    yield flush()
                    made += 1
                    vocabulary, ids, train, n, runs = fresh()
                    vocabulary.default_factory = vocabulary.__len__
                    size = 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, f"chunk long, ids array<{id_type}>, train array<boolean>, n array<long>, tokens binary, words binary, bytes long")


def _flags(train: list[bool], n: list[int]) -> np.ndarray:
    return np.repeat(np.array(train, bool), n)


def _word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, words = _numbers(r["tokens"]), _words(r["words"])
                counts = np.bincount(own[_flags(r["train"], r["n"])], minlength=len(words))
                at = np.array([zlib.crc32(w) % buckets for w in words])
                out = [(k, r["chunk"], _squeeze(b"\n".join(words[i] for i in m.tolist())), _squeeze(counts[m])) for k in np.unique(at).tolist() for m in [np.flatnonzero(at == k)]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "words", "counts"])

    return chunks.select("train", "n", "tokens", "words", "chunk").mapInArrow(run, "bucket int, chunk long, words binary, counts binary")


def _word_answers(requests: DataFrame, buckets: int) -> DataFrame:
    """For each chunk the numbers and training counts of its words, in the order of its request; and each bucket's table (chunk null)."""

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        bucket, total = rows[0]["bucket"], defaultdict(int)
        asked = [_words(r["words"]) for r in rows]
        for r, words in zip(rows, asked, strict=True):
            for w, c in zip(words, _numbers(r["counts"]).tolist(), strict=True):
                total[w] += c
        names = sorted(total, key=lambda w: (-total[w], w))  # frequent words get small numbers, which pack well
        number = {w: i * buckets + bucket for i, w in enumerate(names)}
        out = [(r["chunk"], bucket, None, _squeeze(np.array([number[w] for w in words])), _squeeze(np.array([total[w] for w in words])), None, None) for r, words in zip(rows, asked, strict=True)]
        out.append((None, bucket, _squeeze(b"\n".join(names)), _squeeze(np.array([number[w] for w in names])), _squeeze(np.array([total[w] for w in names])), sum(total.values()), sum(c > 0 for c in total.values())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "bucket", "words", "numbers", "counts", "n", "v"])

    return requests.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, words binary, numbers binary, counts binary, n long, v long")


def _own_words(r: dict, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a chunk's words in its own order, from the answers of all buckets."""
    at = np.array([zlib.crc32(w) % buckets for w in _words(r["words"])])
    number, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for a in answers:
        m = np.flatnonzero(at == a["bucket"])
        number[m], count[m] = _numbers(a["numbers"]), _numbers(a["counts"])
    return number, count


def _pairs(own: np.ndarray, n: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token's pair as one number, (history + 1) * size + word in the chunk's own numbers; history 0 is a document's start."""
    history = np.empty_like(own)
    history[1:] = own[:-1] + 1
    history[np.cumsum(n) - np.array(n)] = 0
    return np.unique(history * size + own, return_inverse=True)


def _bucket_of(h: np.ndarray, w: np.ndarray, count: np.ndarray, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair's request goes: by its history, or by both words if that is frequent (a start always is)."""
    frequent = (h == 0) | (count >= hot)
    x = h.astype(np.uint64) * _MIX + np.where(frequent, w.astype(np.uint64) * _MIX >> np.uint64(7), np.uint64(0))
    return (((x ^ (x >> np.uint64(31))) * _MIX) >> np.uint64(33)).astype(np.int64) % buckets, frequent


def _chunk_pairs(r: dict, answers: list[dict], buckets: int, hot: int) -> dict:
    """A chunk's distinct pairs, in the order in which they are asked for: by bucket, then history and word."""
    number, count = _own_words(r, answers, buckets)
    own = _numbers(r["tokens"])
    distinct, which = _pairs(own, r["n"], len(number))
    left, right = distinct // len(number), distinct % len(number)
    h = np.where(left > 0, number[np.maximum(left - 1, 0)] + 1, 0)
    bucket, _ = _bucket_of(h, number[right], np.where(left > 0, count[np.maximum(left - 1, 0)], 0), hot, buckets)
    order = np.lexsort((number[right], h, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {"own": own, "number": number, "count": count, "which": place[which], "h": h[order], "w": number[right][order], "word_count": count[right][order], "history_count": np.where(left > 0, count[np.maximum(left - 1, 0)], 0)[order], "bucket": bucket[order]}


def _pair_requests(chunks: DataFrame, answers: DataFrame, buckets: int, hot: int) -> DataFrame:
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            c = _chunk_pairs(r, right.to_pylist(), buckets, hot)
            seen = np.bincount(c["which"], weights=_flags(r["train"], r["n"]), minlength=len(c["h"])).astype(np.int64)
            edges = np.flatnonzero(np.diff(c["bucket"], prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(c["h"])], strict=True):
                s = slice(lo, hi)
                frequent = (c["h"][s] == 0) | (c["history_count"][s] >= hot)
                out.append((int(c["bucket"][lo]), r["chunk"], _squeeze(_ascending(c["h"][s])), _squeeze(c["w"][s]), _squeeze(seen[s]), _squeeze(c["word_count"][s]), _squeeze(frequent.astype(np.int64))))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "h", "w", "seen", "word_count", "frequent"])

    some = chunks.select("chunk", "train", "n", "tokens", "words")
    told = answers.where("chunk is not null").select("chunk", "bucket", "numbers", "counts")
    return some.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask, "bucket int, chunk long, h binary, w binary, seen binary, word_count binary, frequent binary")


def _stats(h: np.ndarray, count: np.ndarray, word_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each history of the given distinct pairs (sorted by it): pairs seen 1, 2 ... K times, tokens of more frequent pairs, sum of the words' counts + 1."""
    at, first = np.unique(h, return_index=True)
    some = count > 0
    cols = [(count == r).astype(np.int64) for r in range(1, K + 1)] + [np.where(count > K, count, 0), np.where(some, word_count + 1, 0)]
    return at, np.stack([np.add.reduceat(c, first) for c in cols], axis=1) if len(at) else np.zeros((0, K + 2), np.int64)


def _pair_answers(requests: DataFrame) -> DataFrame:
    """For each chunk its pairs' counts and its rarer histories' statistics; for each bucket (chunk null) its table, and parts for frequent histories."""

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        parts = [(np.cumsum(_numbers(r["h"])), *(_numbers(r[k]) for k in ("w", "seen", "word_count", "frequent"))) for r in rows]
        h, w, seen, word_count, frequent = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w, h))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(seen[order], first)
        count = np.empty(len(h), np.int64)
        count[order] = total[np.cumsum(new) - 1]
        one = order[first]
        by, stats = _stats(h[one], total, word_count[one])
        is_hot = np.zeros(len(by), bool)
        is_hot[np.searchsorted(by, np.unique(h[frequent == 1]))] = True
        out, at = [], 0
        for r, p in zip(rows, parts, strict=True):
            mine = np.unique(p[0][p[4] == 0])
            s = stats[np.searchsorted(by, mine)]
            out.append((r["chunk"], r["bucket"], _squeeze(count[at : at + len(p[0])]), _squeeze(s.T.reshape(-1)), None, None, None, None, None))
            at += len(p[0])
        kept = total > 0
        coc = [int((total == i).sum()) for i in range(1, K + 2)]
        out.append((None, rows[0]["bucket"], _squeeze(total[kept]), None, by[is_hot].tolist(), stats[is_hot].tolist(), coc, _squeeze(_ascending(h[one][kept])), _squeeze(w[one][kept])))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "bucket", "count", "stats", "hot", "hot_stats", "coc", "h", "w"])

    return requests.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, count binary, stats binary, hot array<long>, hot_stats array<array<long>>, coc array<long>, h binary, w binary")


def discounts(coc: list[int]) -> list[float]:
    """Good-Turing discounts of pairs seen 1 to K times, from how many pairs were seen 1 to K + 1 times.

    Where these give no discount between 0 and 1 (few data), half a count is taken off instead.
    """
    out = []
    top = (K + 1) * coc[K] / coc[0] if coc[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * coc[r] / (r * coc[r - 1]) - top) / (1 - top) if coc[r - 1] and top < 1 else -1.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


@dataclass
class Katz:
    """The model's scalars, its frequent histories, and where its tables are."""

    n: int
    v: int
    hot: int
    buckets: int
    discounts: list[float]
    hot_stats: dict[int, list[int]] = field(default_factory=dict)
    words: DataFrame | None = None
    pairs: DataFrame | None = None

    def base(self, count: np.ndarray) -> np.ndarray:
        """The add-one probability of words of these training counts; it sums to 1 over all words and the unknown one."""
        return (count + 1) / (self.n + self.v + 1)

    def backoff(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of statistics: the counts' denominator, and the weight that makes a history's probabilities sum to 1.

        A history without discounted pairs keeps one count more in its denominator for unseen words; one never seen has weight 1.
        """
        stats = stats.reshape(-1, K + 2).astype(float)
        r, d = np.arange(1, K + 1), np.array(self.discounts)
        total, kept = (stats[:, :K] * r).sum(axis=1) + stats[:, K], (stats[:, :K] * r * d).sum(axis=1) + stats[:, K]
        below = np.where((total - kept <= 0) & (total > 0), total + 1, total)
        unseen = 1 - stats[:, K + 1] / (self.n + self.v + 1)
        return below, np.where(total > 0, (1 - kept / np.maximum(below, 1)) / unseen, 1.0)

    def probability(self, pair: np.ndarray, below: np.ndarray, weight: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of pairs of such counts, under histories of such denominators and weights, for words of such counts."""
        d = np.array([1.0, *self.discounts, 1.0])[np.minimum(pair, K + 1)]
        return np.where(pair > 0, d * pair / np.maximum(below, 1), weight * self.base(word))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Katz]:
    """Learn from the rows where train holds; give every row's scores, and the model.

    The rows: id, train, n_tokens, n_known, train_tokens, base_score (add-one), score (log10 probability of the text).
    Null and empty texts are one end token; equal rows stay separate and count as often; without training rows every
    token is unknown. Other columns are not looked at.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = stored(_chunks(chosen), "lm-chunks")
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(4, -(-size // BUCKET_BYTES))
    words = stored(_word_answers(_word_requests(chunks, buckets), buckets), "lm-words")
    n, v = words.where("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    hot = max(1, -(-n // HOT))
    pairs = stored(_pair_answers(_pair_requests(chunks, words, buckets, hot)), "lm-pairs")
    own = pairs.where("chunk is null")
    coc = dict(own.select(F.posexplode("coc")).groupBy("pos").agg(F.sum("col")).collect())
    parts = own.select(F.explode(F.arrays_zip("hot", "hot_stats")).alias("x")).select("x.hot", F.posexplode("x.hot_stats").alias("i", "s")).groupBy("hot", "i").agg(F.sum("s").alias("s"))
    model = Katz(n, v, hot, buckets, discounts([coc.get(i, 0) for i in range(K + 1)]), words=words, pairs=pairs)
    for r in parts.collect():  # K + 2 numbers for each of at most HOT + 1 histories
        model.hot_stats.setdefault(r["hot"], [0] * (K + 2))[r["i"]] = r["s"]
    return _scores(chunks, words, pairs, model).withColumnRenamed("id", id_col), model


def _scores(chunks: DataFrame, words: DataFrame, pairs: DataFrame, model: Katz) -> DataFrame:
    kept = Katz(model.n, model.v, model.hot, model.buckets, model.discounts, model.hot_stats)
    shared = chunks.sparkSession.sparkContext.broadcast(kept)  # at most HOT + 1 short lists
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    answers = words.where("chunk is not null").select("chunk", "bucket", F.col("numbers").alias("a"), F.col("counts").alias("b"), F.lit(0).alias("kind"))
    answers = answers.unionByName(pairs.where("chunk is not null").select("chunk", "bucket", F.col("count").alias("a"), F.col("stats").alias("b"), F.lit(1).alias("kind")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, told = shared.value, right.to_pylist()
        out, kind = [], left.schema.field("ids").type.value_type
        for r in left.to_pylist():
            c = _chunk_pairs(r, [{"bucket": a["bucket"], "numbers": a["a"], "counts": a["b"]} for a in told if a["kind"] == 0], m.buckets, m.hot)
            by_bucket = {a["bucket"]: a for a in told if a["kind"] == 1}
            pair, below, weight = np.zeros(len(c["h"]), np.int64), np.ones(len(c["h"])), np.ones(len(c["h"]))
            edges = np.flatnonzero(np.diff(c["bucket"], prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(c["h"])], strict=True):
                a, h = by_bucket[int(c["bucket"][lo])], c["h"][lo:hi]
                pair[lo:hi] = _numbers(a["a"])
                rare = ~((h == 0) | (c["history_count"][lo:hi] >= m.hot))
                mine, at = np.unique(h[rare], return_inverse=True)
                d, w = m.backoff(_numbers(a["b"]).reshape(K + 2, len(mine)).T)
                below[lo:hi][rare], weight[lo:hi][rare] = d[at], w[at]
                mine, at = np.unique(h[~rare], return_inverse=True)
                if len(mine):
                    d, w = m.backoff(np.array([m.hot_stats.get(x, [0] * (K + 2)) for x in mine.tolist()]))
                    below[lo:hi][~rare], weight[lo:hi][~rare] = d[at], w[at]
            logs = np.log10(m.probability(pair, below, weight, c["word_count"]))[c["which"]]
            count = c["count"][c["own"]]
            first = np.cumsum(r["n"]) - np.array(r["n"])
            sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10(m.base(count)), logs)]
            out.append(pa.table([pa.array(r["ids"], kind), pa.array(r["train"]), pa.array(r["n"]), pa.array(sums[0]), pa.array([m.n] * len(first), pa.int64()), pa.array(sums[1]), pa.array(sums[2])], names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], kind), "train": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})

    some = chunks.select("chunk", "ids", "train", "n", "tokens", "words")
    return some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
