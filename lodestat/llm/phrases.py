"""Collocations by stripes: each prefix keys an associative counter of next words; stripes are merged elementwise.

One structure for each length answers all: a stripe's entries are the phrases that extend its prefix, the empty prefix's
total is the number of words, an entry is the total of the prefix one word longer, and the largest entry that extends a
phrase by a word, to the right (in its own stripe) or to the left, is what may subsume it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words of the longest phrase, least count of a candidate, scale of a score, share of a phrase's count in a longer one that drops it, rows of a language.
LONGEST, LEAST, SCALE, SUBSUMED, BEST = 5, 100, 1000, 100, 2000
#: A null language.
NO_LANG = "und"
#: A task turns what it has seen into stripes at so many different words, or windows of words.
WORDS, WINDOWS = 400_000, 2_000_000
#: Words and stops of a block of coded text, and languages of which a task keeps something at once.
BLOCK_TOKENS, LANGUAGES = 1_000_000, 64
#: Stripes of the empty prefix, and of those that hold a thousandth of all words, are cut into so many by their next words.
PARTS, HOT = 64, 1000
#: Bits of the filter of frequent phrases: at least 32 for each of them, so long as MOST_BITS (16 MB) allows. A wrong hit costs time, never a row.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A stripe: next words with blanks between them, a byte for each count, and eight for each count that is SMALL or more.
STRIPES, SMALL = "lang string, prefix string, part int, next string, few binary, many binary", 255

#: One byte for each stop, which UTF-8 never holds, and blanks for tabs.
_STOP = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z alone), and a byte 255 at each stop."""
    return text.lower().translate(_STOP).replace(b"\xff", b" \xff ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\x00" + word)


class _Words(dict):
    """Numbers of words, from 1 in the order that they are met; a stop is 0."""

    def __init__(self):
        super().__init__({b"\xff": 0})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _phrase_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of the n words from each place on; the same for the same words of a language."""
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * MIX + words[k : len(words) - n + 1 + k]
    return h


def _grouped(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, in order, and the sums of their counts."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(n, first) if len(first) else n


def coded(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, hashes, ids): texts as blocks of numbers, with the words that they stand for and the hashes of these; 0 is a stop. Every text is taken apart once, here."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.encode(F.col(text_col), "utf-8").alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Words, list[np.ndarray]]] = {}

        def block(lang: str) -> pa.RecordBatch:
            words, ids = open_.pop(lang)
            names = pa.array([w.decode("utf-8") for w in words.names], pa.string())
            hashes = np.array([0, *(word_hash(lang, w) for w in words.names[1:])], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([names.to_pylist()], pa.list_(pa.string())), pa.array([hashes.tobytes()], pa.binary()), pa.array([np.concatenate(ids).tobytes()], pa.binary())], names=["lang", "words", "hashes", "ids"])

        for b in batches:
            langs = b.column(0).to_pylist()
            for lo in range(0, b.num_rows, 64):
                by: dict[str, list[bytes]] = {}
                for lang, t in zip(langs[lo : lo + 64], b.column(1).slice(lo, 64).to_pylist()):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    if lang not in open_ and len(open_) == LANGUAGES:
                        yield block(next(iter(open_)))
                    words, ids = open_.setdefault(lang, (_Words(), []))
                    found = tokens(b"\xff".join(some))
                    ids.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    ids.append(np.zeros(1, np.int32))
                    if sum(map(len, ids)) > BLOCK_TOKENS:
                        yield block(lang)
        for lang in list(open_):
            yield block(lang)

    return texts.mapInArrow(run, "lang string, words array<string>, hashes binary, ids binary")


class _Seen:
    """What a task has seen of one language: windows of size words, as numbers of words, with counts."""

    def __init__(self, lang: str, size: int, filters: list[np.ndarray], hot: frozenset[str]):
        self.lang, self.size, self.filters, self.hot = lang, size, filters, hot
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.held: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = self.after = 0

    def add(self, names: pa.Array, hashes: np.ndarray, ids: np.ndarray) -> None:
        use = np.flatnonzero(_holds(self.filters[0], hashes)) if self.filters else np.arange(len(hashes))
        use = use[use > 0]
        if not len(use):
            return
        mine = np.zeros(len(hashes), np.int32)
        mine[use] = [self.words.setdefault(w, len(self.words)) for w in names.take(pa.array(use)).to_pylist()]
        if self.size == 1:
            n = np.bincount(ids, minlength=len(hashes))[use]
            rows, n = mine[use][:, None], n.astype(np.int64)
        else:
            ok = np.ones(max(0, len(ids) - self.size + 1), bool)
            good = mine[ids] > 0
            for k in range(self.size):
                ok &= good[k : len(ok) + k]
            if self.size > 2 and ok.any():  # with two words, both have passed the filter already
                frequent = _holds(self.filters[-1], _phrase_hashes(hashes[ids], self.size - 1))
                ok &= frequent[:-1] & frequent[1:]
            at = np.flatnonzero(ok)
            rows = np.stack([mine[ids[at + k]] for k in range(self.size)], axis=1)
            n = np.ones(len(rows), np.int64)
        self.held.append(rows)
        self.counts.append(n)
        self.n += len(rows)
        if self.n - self.after > WINDOWS:
            self.reduce()

    def reduce(self) -> None:
        rows, n = _grouped(np.concatenate(self.held), np.concatenate(self.counts))
        self.held, self.counts, self.n, self.after = [rows], [n], len(rows), len(rows)

    def full(self) -> bool:
        return len(self.words) > WORDS or self.after > WINDOWS

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """One row for each prefix, or part of one: its next words and their counts."""
        if self.held:
            self.reduce()
            rows, n = self.held[0], self.counts[0]
            names = np.array(list(self.words), object)
            if len(rows):
                head = rows[:, :-1]
                starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(axis=1)])
                which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
                prefixes = np.array([" ".join(names[r]) for r in head[starts]], object)
                cut = np.fromiter((p in self.hot or not p for p in prefixes), bool, len(prefixes))
                part = np.zeros(len(rows), np.int64)
                if cut.any():
                    share = np.array([xxhash.xxh32_intdigest(w) % PARTS for w in self.words])
                    part[cut[which]] = share[rows[cut[which], -1]]
                order = np.lexsort((rows[:, -1], part, which))
                which, part, last, n = which[order], part[order], rows[order, -1], n[order]
                starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (part[1:] != part[:-1])])
                for lo in range(0, len(starts), 20_000):
                    s = starts[lo : lo + 20_000]
                    end = starts[lo + 20_000] if lo + 20_000 < len(starts) else len(last)
                    at, counts = np.r_[s, end] - s[0], n[s[0] : end]
                    words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(names[last[s[0] : end]], pa.string()))
                    large = np.r_[0, np.cumsum(counts >= SMALL)][at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([self.lang] * len(s)), pa.array(prefixes[which[s]], pa.string()), pa.array(part[s], pa.int32()), pc.binary_join(words, " "), _packed(np.minimum(counts, SMALL).astype(np.uint8), at), _packed(counts[counts >= SMALL], large)],
                        names=["lang", "prefix", "part", "next", "few", "many"],
                    )
        self.clear()


def _packed(numbers: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary for each row: the bytes of its numbers, which begin at these places."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * numbers.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all rows."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[1]].view(kind)


def stripes(blocks: DataFrame, size: int, filters: Sequence[np.ndarray] = (), hot: dict[str, set[str]] | None = None) -> DataFrame:
    """(lang, prefix, part, next, few, many): each task's stripes of prefixes of size - 1 words. Filters: of frequent words, and of frequent phrases of size - 1 words."""
    shared = blocks.sparkSession.sparkContext.broadcast(([f.tobytes() for f in filters], {k: frozenset(v) for k, v in (hot or {}).items()}))  # two filters of MOST_BITS at most; at most HOT phrases of a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, often = shared.value
        mine = [np.frombuffer(f, np.uint8) for f in raw]
        seen: dict[str, _Seen] = {}
        for b in batches:
            for i in range(b.num_rows):
                lang = b.column(0)[i].as_py()
                if lang not in seen and len(seen) == LANGUAGES:
                    yield from seen.pop(next(iter(seen))).stripes()
                s = seen.setdefault(lang, _Seen(lang, size, mine, often.get(lang, frozenset())))
                s.add(b.column(1)[i].values, np.frombuffer(b.column(2)[i].as_buffer(), np.uint64), np.frombuffer(b.column(3)[i].as_buffer(), np.int32))
                if s.full():
                    yield from s.stripes()
        for s in seen.values():
            yield from s.stripes()

    return blocks.mapInArrow(run, STRIPES)


_MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("next", pa.string()), ("n", pa.int64())])


def merged(rows: DataFrame) -> DataFrame:
    """(lang, prefix, next, n): all stripes of a prefix added up elementwise. Rows of one prefix and part meet in one task, next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _MERGED.empty_table()  # the last key of a batch may go on in the next one
        for b in batches:
            if not b.num_rows:
                continue
            words = pc.split_pattern(b.column(3), " ")
            n = _unpacked(b.column(4), np.uint8).astype(np.int64)
            n[n == SMALL] = _unpacked(b.column(5), np.int64)
            of = pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy()))
            entries = pa.Table.from_arrays([*(b.column(i).take(of) for i in range(3)), words.flatten(), pa.array(n)], schema=_MERGED)
            sums = pa.concat_tables([held, entries]).group_by(["lang", "prefix", "part", "next"], use_threads=False).aggregate([("n", "sum")]).rename_columns(_MERGED.names)
            last = [b.column(i)[b.num_rows - 1] for i in range(3)]
            open_ = pc.and_(pc.and_(pc.equal(sums["lang"], last[0]), pc.equal(sums["prefix"], last[1])), pc.equal(sums["part"], last[2]))
            held = sums.filter(open_)
            yield from sums.filter(pc.invert(open_)).select(["lang", "prefix", "next", "n"]).to_batches()
        yield from held.select(["lang", "prefix", "next", "n"]).to_batches()

    key = ["lang", "prefix", "part"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "lang string, prefix string, next string, n long")


def frequent_bits(phrases: DataFrame) -> np.ndarray:
    """A bit for the hash of each (lang, phrase): at most MOST_BITS / 8 bytes reach the driver, however many phrases there are."""
    bits = LEAST_BITS
    n = phrases.count()
    while bits < min(MOST_BITS, 32 * n):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = np.array([word_hash(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
                out.append(int(_places(_phrase_hashes(words, len(words)), bits)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["at"])

    at = F.col("at")
    by_word = phrases.select("lang", "phrase").mapInArrow(run, "at long").groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("b"))
    got = by_word.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got["word"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _hot(level: DataFrame, totals: DataFrame) -> dict[str, set[str]]:
    """By language, phrases that hold over 1 / HOT of its words: fewer than HOT for each length."""
    out: dict[str, set[str]] = {}
    for r in level.join(F.broadcast(totals), "lang").where(F.col("a") * HOT > F.col("n")).select("lang", "phrase").collect():  # totals: one row a language
        out.setdefault(r["lang"], set()).add(r["phrase"])
    return out


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): words of each language; and for each length (lang, prefix, next, phrase, a): phrases of at least that count.

    A phrase of that count has a prefix and a suffix of that count, so windows without either are not counted.
    """
    blocks = stored(coded(docs, text_col, lang_col), "coded-texts")
    totals, found, filters, hot = None, [], [], None
    for size in range(1, longest + 1):
        sums = merged(stripes(blocks, size, filters, hot))
        if size == 1:
            sums = stored(sums, "words")
            totals = stored(sums.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        phrase = F.col("next") if size == 1 else F.concat_ws(" ", "prefix", "next")
        level = stored(sums.where(F.col("n") >= least).select("lang", "prefix", "next", phrase.alias("phrase"), F.col("n").alias("a")), "phrases")
        found.append(level)
        if size < longest:
            filters, hot = [*filters[:1], frequent_bits(level)], _hot(level, totals)
    return totals, found


def _looked_up(rows: DataFrame, phrase: str, counts: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """Adds the count of a phrase. Phrases that very many others hold are looked up in a small table, the others by a join on the phrase."""
    small = often.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), F.col("a").alias("__hot"))
    met = rows.join(F.broadcast(small), (F.col("lang") == F.col("__l")) & (F.col(phrase) == F.col("__p")), "left").drop("__l", "__p")
    rest = met.where("__hot is null").drop("__hot").join(counts.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(name)), ["lang", phrase])
    return met.where("__hot is not null").withColumnRenamed("__hot", name).select(*rest.columns).unionByName(rest)


#: Whole numbers of up to 38 digits: a product of two counts never passes them.
_SCORE = f"cast((cast(a * {SCALE} as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as bigint)"


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, best: int = BEST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to longest words, by the lift of their weakest cut.

    Pieces end at ``.,;:!?`` and line ends, words at blanks and tabs; A-Z are lowered. A phrase that a longer one holds, with at
    least subsumed percent of its count there, is dropped. Whole texts of any length are read; null texts have no words;
    a null language is ``und``; repeated rows count each; ties go by count, then by phrase in byte order; an empty table
    gives no rows; other columns are not looked at.
    """
    totals, found = levels(docs, text_col, lang_col, least, longest)
    keep = [x.select("lang", "phrase", "a") for x in found]
    counts = keep[0]
    for x in keep[1:]:
        counts = counts.unionByName(x)
    often = counts.join(F.broadcast(totals), "lang").where(F.col("a") * HOT > F.col("n")).select("lang", "phrase", "a")  # fewer than HOT a length and language
    wider = None  # the largest count among phrases one word longer: subsumption needs no longer ones, whose counts are no larger
    for x in found[2:]:
        to_right = x.select("lang", F.col("prefix").alias("phrase"), "a")
        to_left = x.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
        both = to_right.unionByName(to_left)
        wider = both if wider is None else wider.unionByName(both)
    candidates = None
    for x in keep[1:]:
        candidates = x if candidates is None else candidates.unionByName(x)
    if wider is not None:
        largest = wider.groupBy("lang", "phrase").agg(F.max("a").alias("wider"))
        candidates = candidates.join(largest, ["lang", "phrase"], "left").where(F.col("wider").isNull() | (F.col("wider") * 100 < F.col("a") * subsumed)).drop("wider")
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " ").alias("rest"))
    cut = _looked_up(_looked_up(cuts, "first", counts, often, "l"), "rest", counts, often, "r").join(F.broadcast(totals), "lang")
    scored = cut.withColumn("score", F.expr(_SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    rows = lowest.select("lang", "phrase", *[F.col(f"x.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
