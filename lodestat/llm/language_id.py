"""Language identification by compression: one zstandard raw-content dictionary for each language, the smallest code wins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import slices

#: Bounds of the training sample: documents of each language that are looked at, and bytes of each dictionary, which is made of whole texts.
SAMPLE_DOCS, DICT_BYTES = 256, 110_000
#: There is one dictionary for each label, and all go to every task: more labels than this are an error.
MOST_LABELS = 256
#: Texts are compressed in pieces of this many bytes, so that the dictionary counts all the way through a long text.
PIECE_BYTES = 4096
LEVEL = 6
#: A narrow margin is looked at once more with zstandard's closest search.
CLOSER = 19
#: A text is rejected if the runner-up needs fewer than this share more bytes. Short texts need a clear margin, too.
NARROW = 0.004
NOTHING = "und"
#: The confidence is margin / (margin + HALF): a margin of HALF gives 0.5.
HALF = 0.03


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample of labelled documents: whole texts in the order of their hashes.

    Of a language's SAMPLE_DOCS different texts of smallest hash those are taken that still fit in DICT_BYTES; if none
    does, the shortest one. Null texts and labels take no part, of rows that repeat one is taken, frequent languages
    (all rows counted) come first, an empty table gives no dictionary, other columns are not looked at. More than
    MOST_LABELS labels raise.
    """
    chosen = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = chosen.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language")).alias("h"), F.octet_length(text_col).alias("n"), F.col(text_col).alias("t"))
    different = labelled.groupBy("lang", "h", "n").agg(F.count("*").alias("copies"))  # numbers alone are dealt out, copies as one
    told = different.groupBy("lang").agg(F.sum("copies").alias("rows"), F.count("*").alias("texts"), F.min("h").alias("first")).limit(MOST_LABELS + 1).collect()
    counts = {r["lang"]: r["rows"] for r in told}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return {}
    # Of a frequent language only a thin slice by hash goes into the ranking, of lengths alone.
    share = F.create_map(*[x for r in told for x in (F.lit(r["lang"]), F.lit(min(1.0, 4 * SAMPLE_DOCS / r["texts"])))])
    first = F.create_map(*[x for r in told for x in (F.lit(r["lang"]), F.lit(r["first"]))])
    thin = (F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)) | (F.col("h") == F.element_at(first, F.col("lang")))
    ranked = different.where(thin).select("lang", "h", "n").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= SAMPLE_DOCS)
    wanted: dict[str, set[int]] = {k: set() for k in counts}
    room = dict.fromkeys(counts, DICT_BYTES)
    looked = sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"]))
    for r in looked:
        if r["n"] <= room[r["lang"]]:
            wanted[r["lang"]].add(r["h"])
            room[r["lang"]] -= r["n"]
    for k in counts:
        if not wanted[k]:
            wanted[k].add(min((r["n"], r["h"]) for r in looked if r["lang"] == k)[1])
    texts = {(r["lang"], r["h"]): r["t"] for r in labelled.where(thin).where(F.col("h").isin(sorted({h for v in wanted.values() for h in v}))).select("lang", "h", "t").dropDuplicates(["lang", "h"]).collect()}
    return {k: b" ".join(letters(texts[k, h]) for h in sorted(wanted[k])) for k in sorted(counts, key=lambda k: (-counts[k], k))}


_OTHER = bytes(i if 97 <= i < 123 or i >= 128 else 32 for i in range(256))


def letters(text: str) -> bytes:
    """The text in lower case, with one blank for ASCII other than letters: case, digits and punctuation tell little of a language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_OTHER).split())


class Classifier:
    """Compressors with one dictionary each; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names, self.dictionaries = list(dictionaries), dictionaries

    def _compressors(self, level: int, **more: int) -> list:
        import zstandard as z

        out = []
        for k in self.names:
            raw = z.ZstdCompressionDict(self.dictionaries[k].ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, **more)
            raw.precompute_compress(compression_params=params)
            out.append(z.ZstdCompressor(dict_data=raw, compression_params=params))
        return out

    @cached_property
    def usual(self) -> list:
        return self._compressors(LEVEL)

    @cached_property
    def closer(self) -> list:
        return self._compressors(CLOSER, min_match=3)

    def _sizes(self, data: bytes, compressors: list) -> list[tuple[int, str]]:
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, max(1, len(data)), PIECE_BYTES)]
        return sorted(((sum(len(c.compress(p)) for p in pieces), k) for c, k in zip(compressors, self.names, strict=True)), key=lambda x: (x[0], self.names.index(x[1])))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the confidence and whether the text is rejected."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return NOTHING, 0.0, True
        data = letters(text)
        sizes = self._sizes(data, self.usual)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        if margin < NARROW:
            sizes = self._sizes(data, self.closer)
            margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        return sizes[0][1], margin / (margin + HALF), margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The columns in keep (with inside, the struct of that name alone, whose field text_col is the text: no text goes to Python twice), and lang_pred, score (0 to 1, the margin's confidence), rejected (narrow margin, or no letter).

    Every text is read whole. A null text, one without a letter, and any text if nothing was learned, is ``und`` with score 0 and is
    rejected; ties go to the language of more labels. Rows repeat as in the input, an empty table gives no rows, other
    columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICT_BYTES for each language, but for languages of longer texts alone
    keep = (inside,) if inside else keep
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if inside else [F.col(text_col).alias("t")]))
    schema = StructType([*[chosen.schema[f"k{i}"] for i in range(len(keep))], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in slices(batches):
            texts = b.column(0).field(b.schema.field(0).type.get_field_index(text_col)) if inside else b.column(len(keep))
            found = [c.judge(t) for t in texts.to_pylist()]
            new = [pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
