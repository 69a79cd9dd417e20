"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds; base spans always stay.

Everything that sees texts is made of Spark's own functions: patterns cut a text into parts and hits, whose lengths
give the positions, and the fitted trees are one expression that is evaluated on a row's candidates in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns that the contract names. Possessive where nothing that follows could use what was given
# back; a long run that holds no match is taken whole as a second alternative, so that no text takes quadratic time.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[A-Za-z0-9._%+-]{64,}+",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|[0-9]{64,}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: what may be personal data beyond the base patterns. Each is generous; the trees decide. What they give up: local parts
#: of over 64 and domain labels of over 63 characters (mail has none), domains of over 9 labels, octets of over 3 digits.
CANDIDATES = {
    "email": r"(?i)[a-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}+(?:(?:\x20?\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[a-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}|([\x20.-])[0-9]{2}(?:\1[0-9]{2}){2,4})(?![0-9])",
}
#: The training sample: at most about so many documents, those of smallest hash.
SAMPLE_DOCS, TREES, DEPTH, STEP = 20_000, 8, 3, 0.3
#: A candidate is accepted if its calibrated probability is at least PRECISION; probabilities are calibrated on BINS sums for each kind.
PRECISION, BINS = 0.95, 100
#: Arrays are scanned in runs of so many values, so that a text's work grows in proportion to its hits. Texts are cut in runs of PIECE code points.
RUN, PIECE = 128, 4096
WINDOW = 24
#: Words that often stand before personal data, in the four languages.
CONTEXT = r"(?i)(mail|phone|tel|call|mobile|fax|card|visa|amex|carte|karte|tarjeta|ip|host|server|contact|kontakt|correo|anruf|appel)[^a-z]{0,3}$"

Span = dict[str, Column]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def plain_address(hit: Column) -> Column:
    """A hit with (at), [at], (dot), [dot] and a spoken dot written as @ and a dot; a spoken at only where no dot of its domain is written, as prose has it."""
    spoken = hit.rlike(r"(?i)^[a-z0-9._%+-]+\x20at\x20[^.]*$")
    dotted = F.regexp_replace(hit, r"(?i)\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", ".")
    marked = F.regexp_replace(dotted, r"(?i)\x20?[(\[]at[)\]]\x20?", "@")
    return F.when(spoken, F.regexp_replace(marked, r"(?i)\x20at\x20", "@")).otherwise(marked)


def _luhn(c: Column) -> Column:
    """Whether at most 19 digits pass: from the right, every second one doubled, 9 taken off where that has two digits."""
    each = F.transform(F.regexp_extract_all(F.lpad(_digits(c), 20, "0"), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, F.translate(x, "0123456789", "0246813579")).otherwise(x).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The contract's test of a match."""
    n = F.length(_digits(hit))
    if kind == "email":
        return F.instr(hit, "@") > 0
    if kind == "ip":
        return hit.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(hit)).otherwise(False)
    return (n >= 9) & (n <= 15)


def _may_hold(kind: str, text: Column) -> Column:
    if kind == "email":
        return (F.instr(text, "@") > 0) | text.rlike(r"(?i)[\x20(\[]at[\x20)\]]")
    if kind == "phone base":
        return F.instr(text, "+") > 0
    # What each pattern can't do without: a card's digits may all stand apart, a phone candidate has two together.
    return text.rlike({"card": r"[0-9][\x20-]?[0-9]", "ip": r"[0-9]\.[0-9]", "phone": "[0-9]{2}"}[kind])


_NONE = "cast(array() as array<struct<s:int,e:int,hit:string,before:string,after:string>>)"


def let(value: Column, f) -> Column:  # noqa: ANN001
    """f of value, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, step, zero: int = 0) -> Column:  # noqa: ANN001
    """The state (an int) before each value, going from left to right; in runs, so that no array is copied once for each of many values."""
    none = F.expr("cast(array() as array<int>)")

    def note(a: Column, now: Column) -> Column:
        return F.struct(now.alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))), lambda c: F.slice(v, c * RUN + 1, F.lit(RUN)))
        return let(runs, lambda r: F.flatten(F.zip_with(
            r, F.aggregate(r, F.struct(F.lit(zero).alias("at"), none.alias("out")), lambda a, run: note(a, F.aggregate(run, a["at"], step)), lambda a: a["out"]),
            lambda run, first: F.aggregate(run, F.struct(first.alias("at"), none.alias("out")), lambda a, x: note(a, step(a["at"], x)), lambda a: a["out"]),
        )))

    return let(values, of)


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, hit, before, after): code points, end exclusive, and up to WINDOW characters on each side, no further than the neighbouring match's far end."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def of(b: Column) -> Column:
        gaps, hits = b["gaps"], b["hits"]
        sizes = F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("hit")))
        text_of = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

        def placed(z: Column) -> Column:
            ats = scan(z, lambda at, x: at + x["gap"] + x["hit"])
            return let(F.struct(z.alias("z"), ats.alias("ats")), lambda c: F.transform(hits, lambda h, i: let(F.get(c["ats"], i) + F.get(c["z"], i)["gap"], lambda s: F.struct(
                s.alias("s"), (s + F.length(h)).alias("e"), h.alias("hit"), F.right(F.concat(text_of(hits, i - 1), F.get(gaps, i)), F.lit(WINDOW)).alias("before"),
                F.left(F.concat(F.get(gaps, i + 1), text_of(hits, i + 1)), F.lit(WINDOW)).alias("after"),
            ))))

        return F.when(F.size(hits) > 0, let(sizes, placed)).otherwise(F.expr(_NONE))

    return let(parts, of)


def base_spans(text: Column, kind: str) -> Column:
    hits = F.when(_may_hold("phone base" if kind == "phone" else kind, text), find(text, BASE[kind])).otherwise(F.expr(_NONE))
    return F.filter(hits, lambda x: valid(kind, x["hit"]))


def features(kind: Column, hit: Column, before: Column, after: Column) -> Span:
    """What the trees see of a candidate: its format, and the text on both sides."""
    n, address = F.length(_digits(hit)), F.when(kind == "email", plain_address(hit)).otherwise(hit)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        **{f"is_{k}": flag(kind == k) for k in KINDS},
        "digits": F.when(kind == "phone", n).otherwise(0).cast("double"),
        "luhn": flag(F.when((n >= 12) & (n <= 19), _luhn(hit))), "octets": flag(valid("ip", hit)), "at": flag(F.instr(address, "@") > 0),
        "plus": flag(hit.startswith("+")), "brackets": flag(hit.rlike(r"\([0-9]+\)")), "spaced": flag(address.rlike(r"[\x20-]")), "domain": flag(address.rlike(r"\.[A-Za-z]{2,}$")),
        "context": flag(before.rlike(CONTEXT)), "edge_before": flag(before.rlike(r"(^|[^A-Za-z0-9.])$")), "edge_after": flag(after.rlike(r"^($|[^A-Za-z0-9]|\.($|[^0-9]))")),
        "number_before": flag(before.rlike(r"[0-9]\x20$")), "number_after": flag(after.rlike(r"^\x20[0-9]")),
    }


def _candidates(text: Column, kind: str) -> Column:
    return F.when(_may_hold(kind, text), find(text, CANDIDATES[kind])).otherwise(F.expr(_NONE))


def candidates(text: Column) -> Column:
    """Structs (kind, s, e, hit, before, after) of every kind's candidates; they may overlap."""

    def of(kind: str) -> Column:
        return F.transform(_candidates(text, kind), lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("s", "e", "hit", "before", "after")]))

    return F.concat(*map(of, KINDS))


def _right(kind: str, hit: Column) -> Column:
    """Whether a candidate passes its kind's own test."""
    return plain_address(hit).rlike(r"@[^@]*\.[A-Za-z]{2,}$") if kind == "email" else valid(kind, hit)


def _examples(text: Column, rare: tuple[str, ...] = ()) -> Column:
    """Structs (kind, label, hit, before, after): every base span as a right example, and each of them twice as a wrong one.

    Of kinds in rare the candidates that pass their kind's test stand in for base spans.

    A wrong example is the span glued into a longer word; or spoiled: a card whose check digit is off, an address whose
    first number is too large, a phone number without its last group, a mail address turned into prose.
    """

    def spoiled(kind: str, hit: Column) -> Column:
        if kind == "card":
            last = F.translate(F.right(hit, F.lit(1)), "0123456789", "1234567890")
            return F.concat(F.left(hit, F.length(hit) - 1), last)
        if kind == "ip":
            return F.concat((F.pmod(F.hash(hit), F.lit(700)) + 300).cast("string"), F.regexp_replace(hit, "^[0-9]+", ""))
        if kind == "phone":
            return F.regexp_replace(hit, r"[\x20.-]?[0-9]{2,4}$", "")
        return F.regexp_replace(F.regexp_replace(hit, "@", " at "), r"\.", ". ")

    def of(kind: str) -> Column:
        def three(x: Column) -> Column:
            rows = ((1.0, x["hit"], x["before"], x["after"]), (0.0, x["hit"], F.concat(x["before"], F.lit("a7")), F.concat(F.lit("4d"), x["after"])), (0.0, spoiled(kind, x["hit"]), x["before"], x["after"]))
            return F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), hit.alias("hit"), before.alias("before"), after.alias("after")) for label, hit, before, after in rows])

        return F.flatten(F.transform(F.filter(_candidates(text, kind), lambda x: _right(kind, x["hit"])) if kind in rare else base_spans(text, kind), three))

    return F.concat(*map(of, KINDS))


def isotonic(bins: list[tuple[float, float]]) -> list[float]:
    """The share of right examples in each bin (right, all), made to rise by pooling neighbours; a bin without examples has that of the bin before, the first ones 0."""
    pools: list[tuple[float, float, int]] = []
    for b, (right, total) in enumerate(bins):
        if total:
            pools.append((right, total, b))
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                (r1, t1, first), (r2, t2, _) = pools[-2:]
                pools[-2:] = [(r1 + r2, t1 + t2, first)]
    return [next((r / t for r, t, first in reversed(pools) if first <= b), 0.0) for b in range(len(bins))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """Boosted trees on a bounded sample of the table's own base spans, and a threshold for each kind from all of them.

    There are no labels of personal data. Right examples are what the base patterns find with their tests passed, wrong
    ones the same spans spoiled or glued into longer words, so that the trees learn which format and surroundings base
    spans have, whatever generator proposes a candidate. A kind of which the sample has no base span learns from its
    candidates that pass its own test instead. The trees see four fifths of the sample, by hash; all other
    base spans of the table calibrate the probability, kind by kind, by isotonic regression over BINS sums. A kind
    without such examples takes those of the sample, one without any the sums of all kinds. None if the sample has
    neither. Null texts, empty texts and empty tables have no examples; rows that repeat count as often.
    """
    n = docs.count()
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("pii"))
    sampled = F.pmod(key, F.lit(1 << 30)) < min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30)
    made = features(F.col("kind"), F.col("hit"), F.col("before"), F.col("after"))

    count = lambda k: F.coalesce(F.sum(F.size(base_spans(F.coalesce(F.col(text_col), F.lit("")), k))), F.lit(0)).alias(k)
    met = docs.where(sampled & (F.pmod(key, F.lit(5)) != 0)).agg(*map(count, KINDS)).first()
    rare = tuple(k for k in KINDS if not met[k])

    def of(some: DataFrame) -> DataFrame:
        thin = some.select((sampled & (F.pmod(key, F.lit(5)) != 0)).alias("seen"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        c = thin.select("seen", F.explode(_examples(F.col("t"), rare)).alias("x")).select("seen", "x.*")
        return c.select("label", "kind", "seen", *[v.alias(f"f_{k}") for k, v in made.items()])

    rows = of(docs.where(sampled)).where("seen").repartition(4).cache()
    try:
        if rows.isEmpty():
            return None
        assembled = VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="features").transform(rows)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32).fit(assembled)
        trees = [_tree(t._java_obj.rootNode()) for t in model.trees]
        fitted = {"names": list(made), "trees": trees, "weights": list(model.treeWeights)}
        told = of(docs).withColumn("p", probability(fitted, {k: F.col(f"f_{k}") for k in made}))
        bins = told.groupBy("kind", "seen", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).alias("bin")).agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()  # twice BINS numbers for each kind
    finally:
        rows.unpersist()
    fitted["thresholds"] = {}
    for k in KINDS:
        for wanted in (lambda r: r["kind"] == k and not r["seen"], lambda r: r["kind"] == k, lambda r: True):
            mine = [r for r in bins if wanted(r)]
            if mine:
                break
        sums = [(sum(r["right"] for r in mine if r["bin"] == b), sum(r["all"] for r in mine if r["bin"] == b)) for b in range(BINS)]
        fitted["thresholds"][k] = next((b / BINS for b, good in enumerate(isotonic(sums)) if good >= PRECISION), 2.0)  # 2: none is good enough
    return fitted


def _tree(node) -> list | float:  # noqa: ANN001
    """A fitted tree as nested lists: [feature, threshold, left, right] or a leaf's value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return [node.split().featureIndex(), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())]


def probability(model: dict, have: Span) -> Column:
    """The trees as one expression."""

    def value(t: list | float) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(have[model["names"][t[0]]] <= t[1], value(t[2])).otherwise(value(t[3]))

    margin = reduce(lambda a, b: a + b, [value(t) * w for t, w in zip(model["trees"], model["weights"], strict=True)])
    return 1 / (1 + F.exp(-2 * margin))


def with_spans(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with __base and __all: arrays of (s, o, e, kind), sorted by start and then kind as listed; __all has the method's spans, too.

    A candidate is added if its probability reaches its kind's threshold and no base span overlaps it; of accepted ones that overlap each
    other the first by (start, kind) stays. Callers hand in tables of their own making, without columns of these names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(o: int, kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    out = docs.withColumn("__base", F.array_sort(F.concat(*[of(o, k) for o, k in enumerate(KINDS)])))
    if model is None:
        return out.withColumn("__all", F.col("__base"))
    # One feature vector for each candidate, then trees over it.
    seen = F.transform(candidates(text), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.struct(*[v.alias(k) for k, v in features(x["kind"], x["hit"], x["before"], x["after"]).items()]).alias("f")))
    limit = F.create_map(*[y for k, v in model["thresholds"].items() for y in (F.lit(k), F.lit(float(v)))])
    order = F.create_map(*[y for o, k in enumerate(KINDS) for y in (F.lit(k), F.lit(o))])
    good = F.filter(seen, lambda x: probability(model, {k: x["f"][k] for k in model["names"]}) >= F.element_at(limit, x["kind"]))

    def added(both: Column) -> Column:
        """Candidates (t = 1) that neither end after the next base span's start nor start before the end of what is taken."""
        nexts = F.reverse(scan(F.reverse(both), lambda n, x: F.when(x["t"] == 0, x["s"]).otherwise(n), 2**31 - 1))
        taken = lambda at, x: (x["t"] == 1) & (x["s"] >= at) & (x["e"] <= x["next"])
        step = lambda at, x: F.when(x["t"] == 0, F.greatest(at, x["e"])).when(taken(at, x), x["e"]).otherwise(at)
        known = F.zip_with(both, nexts, lambda x, n: F.struct(*[x[c].alias(c) for c in ("s", "t", "o", "e", "kind")], n.alias("next")))
        at = lambda v: F.zip_with(v, scan(v, step), lambda x, a: F.struct(x.alias("x"), a.alias("at")))
        kept = F.filter(let(known, at), lambda y: taken(y["at"], y["x"]))
        return F.transform(kept, lambda y: F.struct(*[y["x"][c].alias(c) for c in ("s", "o", "e", "kind")]))

    tagged = lambda v, t: F.transform(v, lambda x: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    ordered = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.element_at(order, x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    more = let(ordered, lambda g: F.when(F.size(g) > 0, let(F.array_sort(F.concat(tagged(F.col("__base"), 0), tagged(g, 1))), added)).otherwise(g))
    return out.withColumn("__added", more).withColumn("__all", F.when(F.size("__added") > 0, F.array_sort(F.concat("__base", "__added"))).otherwise(F.col("__base"))).drop("__added")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, base counts by kind, base_sha256, spans (all, as text).

    Null and empty texts have none; rows repeat as in the input; an empty table gives no rows; other columns are not
    looked at. A text's work grows in proportion to its length and its hits, but for the sort of its spans.
    """
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), model, "t")
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in pieces of PIECE code points each."""
    at = lambda p: F.coalesce(F.get(pieces, p), F.lit(""))
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    within = lambda p, a, n: F.substring(at(p), a + 1, n)
    inside = F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    return F.when(first == last, within(first, start - first * PIECE, end - start)).otherwise(F.concat(within(first, start - first * PIECE, F.lit(PIECE)), inside, within(last, F.lit(0), end - last * PIECE)))


def redact(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with every span, overlapping ones together, replaced by the first one's kind in brackets.

    Null texts stay null and texts without spans as they are; rows repeat as in the input; all columns stay, whatever
    their names.
    """
    names = docs.columns
    found = with_spans(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("t")), model, "t")
    text = F.col("t")

    def joined(spans: Column) -> Column:
        ends = scan(spans, lambda at, x: F.greatest(at, x["e"]))
        starts = F.filter(F.zip_with(spans, ends, lambda x, at: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["s"] >= x["at"])  # at: where the last group ends
        parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.array_max(F.transform(spans, lambda x: x["e"])).alias("end"), F.length(text).alias("n"), starts.alias("starts"))
        return let(parts, lambda p: F.concat(F.array_join(F.transform(p["starts"], lambda x: F.concat(_cut(p["pieces"], x["at"], x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""), _cut(p["pieces"], p["end"], p["n"])))

    new = F.when(F.size("__all") > 0, let(F.col("__all"), joined)).otherwise(text)
    return found.select("row", new.alias("new")).select(*[F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])
