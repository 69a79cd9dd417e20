"""Rules around models: which columns may be used, which tests apply where, encoders, and the long table of all tests."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..sources.scratch import stored
from . import calibration, findings, rank

#: Result tables of at most so many rows go through the driver for tail probabilities.
MOST_ROWS = 10_000


def leaks(columns: Sequence[str], forbidden: Collection[str]) -> list[str]:
    """Columns known only after the decision, in order of name."""
    return sorted(set(columns) & set(forbidden))


def assert_no_leakage(columns: Sequence[str], forbidden: Collection[str]) -> None:
    bad = leaks(columns, forbidden)
    if bad:
        raise ValueError(f"columns that are not known at the decision: {bad}")


def aligned(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """df with exactly the given columns, 0 where it has none, and the names that were missing, for the caller to report."""
    missing = [c for c in columns if c not in df.columns]
    return df.select(*keep, *[F.lit(0).alias(c) if c in missing else F.col(c) for c in columns]), missing


@dataclass(frozen=True)
class Encoder:
    """The labels of a column, in order, as learned; others are unseen."""

    column: str
    labels: tuple[str, ...]

    def code(self) -> Column:
        """The label's place; null for unseen and missing ones."""
        place = F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(self.column)) if self.labels else F.lit(0)
        return F.nullif(place - 1, F.lit(-1).cast("long")).cast("int")

    def one_hot(self) -> dict[str, Column]:
        """A 0/1 column for each label; unseen and missing ones are all zeros."""
        return {f"{self.column}_{v}": F.coalesce(F.col(self.column) == v, F.lit(False)).cast("int") for v in self.labels}


def learn_encoder(df: DataFrame, column: str, most: int = 1000) -> Encoder:
    """Labels that occur, sorted; more than most raise, as every one becomes a column."""
    rows = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} labels")
    return Encoder(column, tuple(r["v"] for r in rows))


def resolve(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The first wanted name that is there, in whatever case."""
    there = {c.lower(): c for c in reversed(columns)}
    return next((there[w.lower()] for w in wanted if w.lower() in there), None)


def interval_label(lo: float | None, hi: float | None) -> str:
    """How a bin (lo, hi] is named; None is open."""
    if lo is None:
        return f"<= {hi:g}"
    return f"> {lo:g}" if hi is None else f"({lo:g}, {hi:g}]"


def threshold_text(rule: tuple) -> str:
    """A traffic-light rule in words."""
    kind, green, amber = rule
    if kind == "band":
        return f"Green in {green}; Amber in {amber}"
    sign = ">=" if kind == "high" else "<="
    return f"Green {sign} {green:g}; Amber {sign} {amber:g}"


def gap_light(ratio: Column, green: float = 0.10, amber: float = 0.25) -> Column:
    """How far a ratio is from 1."""
    return calibration.light_low(F.abs(1 - ratio), green, amber)


def beats_light(difference: Column, p: Column, significance: float = 0.05) -> Column:
    """Whether a model beats its benchmark: not at all, or clearly, or only in the sample."""
    return F.when(difference.isNull() | F.isnan(difference), "n/a").when(difference <= 0, "Red").when(F.coalesce(p < significance, F.lit(False)), "Green").otherwise("Amber")


def area_of(test: Column, areas: Sequence[tuple[Sequence[str], str]], other: str) -> Column:
    """The first area one of whose words is a word of the text, or begins one if it has over three letters."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(test), r"[^\p{L}\p{N}]+", " ")), " +")
    hit = lambda w: F.exists(tokens, lambda t: t.startswith(w) if len(w) > 3 else t == w)
    out = F.lit(other)
    for words, area in reversed(areas):
        out = F.when(reduce(lambda a, b: a | b, map(hit, words)), area).otherwise(out)
    return out


def by_prefix(text: Column, patterns: Sequence[tuple[str, Column]], other: Column) -> Column:
    """The value of the first prefix that the text has."""
    for prefix, value in reversed(patterns):
        other = F.when(text.startswith(prefix), value).otherwise(other)
    return other


def fraction_sample(df: DataFrame, row_id: str, share: float, seed: int = 0) -> DataFrame:
    """About that share of the rows, by a digest of their ids: the same rows whatever the partitions."""
    limit = f"{int(share * 16**8):08x}" if share < 1 else "g"
    return df.where(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8) < limit)


def with_digest_share(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """Adds __share: a number between 0 and 1 from a digest of the id, the same however the data lie."""
    return df.withColumn("__share", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32))


def with_tails(table: DataFrame, tails: Mapping[str, Callable[[SparkSession, dict], float | None]]) -> DataFrame:
    """A result table with tail probabilities, which the JVM's survival functions give row by row on the driver; larger tables raise."""
    rows = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no result table")
    spark = table.sparkSession
    made = [(*r, *[f(spark, r.asDict()) for f in tails.values()]) for r in rows]
    return spark.createDataFrame(made, ", ".join([f"`{n}` {t}" for n, t in table.dtypes] + [f"`{n}` double" for n in tails]))


def group_tails(table: DataFrame) -> DataFrame:
    """calibration.by_group with one-sided normal, exact binomial and Jeffreys probabilities of so many bads or more; null unless 0 < mean PD < 1."""
    fits = lambda r: 0 < r["mean_pd"] < 1
    return with_tails(table, {
        "p_normal": lambda s, r: special.normal_sf(s, r["z"]) if fits(r) else None,
        "p_exact": lambda s, r: special.binomial_at_least(s, r["bads"], r["n"], r["mean_pd"]) if fits(r) else None,
        "p_jeffreys": lambda s, r: special.jeffreys(s, r["bads"], r["n"], r["mean_pd"]) if fits(r) else None,
    })


@dataclass(frozen=True)
class Applies:
    """Where a model is tested, and on which of these splits its calibration, too; None: wherever it is tested."""

    splits: tuple[str, ...]
    calibrated: tuple[str, ...] | None = None


def scored(df: DataFrame, models: Mapping[str, Column], rules: Mapping[str, Applies], targets: Mapping[str, Column], default_target: Column, row_id: str, split: str, *keep: str) -> DataFrame:
    """(model, split, id, y, p and keep): one row for each model and row that it is tested on; targets names the splits whose target is another."""
    y = default_target
    for s, t in targets.items():
        y = F.when(F.col(split) == s, t).otherwise(y)
    each = F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in models.items()])
    long = df.select(F.col(split).alias("split"), F.col(row_id).alias("id"), y.alias("y"), *keep, F.explode(each).alias("m")).select("m.*", "split", "id", "y", *keep)
    return long.where(reduce(lambda a, b: a | b, [(F.col("model") == m) & F.col("split").isin(*rules[m].splits) for m in models]))


def battery(long: DataFrame, rules: Mapping[str, Applies], lights: Mapping[str, tuple], development: str, in_sample: Collection[str] = (), group: str | None = None) -> DataFrame:
    """(model, split, test, value, threshold, light): every test of every model on every split that it applies to, grouped and not looped over.

    Discrimination, Brier, deciles and Gini decay against the development split apply everywhere; means, central
    tendency, Hosmer-Lemeshow and, if group is given, the least Jeffreys probability of a group only where rules say so.
    """
    keys = ["model", "split"]
    rows = stored(long, "battery")
    usable = reduce(lambda a, b: a | b, [(F.col("model") == m) & F.col("split").isin(*(r.splits if r.calibrated is None else r.calibrated)) for m, r in rules.items()])
    disc = stored(rank.discrimination(rows, "y", "p", keys), "battery-ranks")
    parts = [findings.long_results(disc, keys, ["auc", "gini", "ks"]), findings.long_results(calibration.brier(rows, "y", "p", keys), keys, ["brier", "brier_skill"])]
    deciles = stored(rank.decile_table(rows, "y", "p", "id", by=keys), "battery-deciles")
    parts.append(findings.long_results(deciles.groupBy(*keys).agg(F.max("ks_at_decile").alias("ks_decile")), keys, ["ks_decile"]))
    parts.append(findings.long_results(rank.inversions(deciles, "decile", "bad_rate", keys).select(*keys, F.col("inversions").cast("double").alias("decile_rank_inversions")), keys, ["decile_rank_inversions"]))
    fit = rows.where(usable)
    tendency = calibration.central_tendency(fit, "y", "p", keys).select(*keys, "mean_pd", F.col("observed").alias("obs_rate"), F.abs("relative_deviation").alias("central_tendency"), F.col("relative_deviation").alias("central_tendency_signed"))
    parts.append(findings.long_results(tendency, keys, ["mean_pd", "obs_rate", "central_tendency", "central_tendency_signed"]))
    hl = calibration.hosmer_lemeshow(fit, "y", "p", "id", by=keys).withColumn("df", F.when(F.col("split").isin(*in_sample), F.col("df") - 2).otherwise(F.col("df")) if in_sample else F.col("df"))
    hl = with_tails(hl.select(*keys, F.col("hl").alias("hl_stat"), F.col("df").cast("int").alias("df")), {"hl_p": lambda s, r: None if r["hl_stat"] is None else special.chi2_sf(s, r["hl_stat"], r["df"])})
    parts.append(findings.long_results(hl, keys, ["hl_stat", "hl_p"]))
    if group is not None:
        tails = group_tails(calibration.by_group(fit.withColumn("__of", F.struct(*keys, group)), "y", "p", "__of").select("__of.*", "n", "bads", "obs_rate", "mean_pd", "z"))
        parts.append(findings.long_results(tails.groupBy(*keys).agg(F.min("p_jeffreys").alias("binomial_group_min_p")), keys, ["binomial_group_min_p"]))
    base = disc.where(F.col("split") == development).select("model", F.col("gini").alias("base"))
    decay = disc.where(F.col("split") != development).join(F.broadcast(base), "model").where("base > 0").select(*keys, ((F.col("base") - F.col("gini")) / F.col("base")).alias("gini_decay"))  # a row for each model
    parts.append(findings.long_results(decay, keys, ["gini_decay"]))
    whole = reduce(DataFrame.unionByName, parts)
    texts = F.create_map(*[x for k, r in lights.items() for x in (F.lit(k), F.lit(threshold_text(r)))])
    return findings.with_lights(whole, lights).select(*keys, F.col("metric").alias("test"), "value", F.coalesce(F.element_at(texts, F.col("metric")), F.lit("")).alias("threshold"), "light")


def train(df: DataFrame, fits: Mapping[str, Callable[[DataFrame], Column]]) -> dict[str, Column]:
    """All models, fitted in the given order on the same rows: each one's probability as a column expression, ready for ``scored``."""
    rows = stored(df, "training")
    return {name: fit(rows) for name, fit in fits.items()}


def evidence(df: DataFrame, template: str, *columns: str) -> Column:
    """A sentence for each row, its numbers from the given columns."""
    return F.format_string(template, *[F.col(c) for c in columns])
