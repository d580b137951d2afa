"""Mixing sources to target weights by Pareto order sampling, as DataFrame operations only.

Source s gets the target min(level * weight, max_copies * size), with the one level at which the
targets add up to the budget: what resharing the excess by weight ends at. Within a source a document
of weight w gets m = min(max_copies, rate * w) expected copies, with the one rate at which the expected
words are the target. floor(m) of them are whole copies for certain; the rest m - floor(m) is the
inclusion probability p of one copy more: documents are ranked by the odds of a seeded uniform number
divided by the odds of p, and taken from the smallest while they fit the words that are left. A last step
fits what the first document too many leaves open: at most `FITTED` documents a source, each the one
whose size is nearest to the words still missing. So realised probabilities differ from p for a constant
number of documents a source, whatever its size.

Weights stand for what a document is worth against others of its source: by default `by_length`, under
which very short documents are drawn less often. They are rounded to a quarter of a power of two, so a
source has a bounded number of weights, and rates are found from the words by source and weight.

A source's running sum goes through buckets of the rank key (window sums within (source, bucket),
prefix sums over the buckets' sums), one for each `ROWS` rows of the table, so a source with a third of
all rows is spread over many tasks and no bucket grows with the input.

Edge cases: null text has size 0 and is never worth a choice, but its row is returned; a null source
is a source of its own, last in order; ties rank by doc_id, then size; repeated rows are decided one
by one; weights that are null, negative or NaN count as 0, and of a source without any other weight all are
equal; sources without words have target 0; an empty table gives an empty result; columns other than
doc_id, source, text (and weight, if named) are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_of, text_of, uniform, word_count

ROWS = 100_000
FITTED = 3


def by_length(size: Column) -> Column:
    """A quarter for documents under 16 words, half under 64, else 1."""
    return F.when(size < 16, 0.25).when(size < 64, 0.5).otherwise(1.0)


def fill_up(df: DataFrame, by: list[str], order: str, budget: Column, cap: Column, slope: Column) -> DataFrame:
    """Adds level: that at which min(cap, level * slope) adds up to the budget within `by`; null if all caps bind. `order` breaks ties of the point where a row's cap binds."""
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    at = F.try_divide(cap, slope.cast("double"))
    before = everything.orderBy(at, F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(cap).over(before), F.lit(0))
    own = F.try_divide(left, (F.sum(slope).over(everything) - F.coalesce(F.sum(slope).over(before), F.lit(0))).cast("double"))
    # the level is that of the first row, by the point where its cap binds, that its cap does not bind; from there on levels only fall
    with_own = df.withColumns({"__own": own, "__at": at})
    return with_own.withColumn("level", F.max(F.when(F.col("__own") <= F.col("__at"), F.col("__own"))).over(everything)).drop("__own", "__at")


def targets(sizes: DataFrame, cycle: tuple = (5, 2, 1), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds weight, target. One row a source, so the windows without keys run over as many rows as there are sources."""
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in cycle]), (place % len(cycle) + 1).cast("int")))
    w = w.withColumns({"cap": F.col("source_size") * max_copies, "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
    w = fill_up(w, [], "source", F.col("budget"), F.col("cap"), F.col("weight"))
    binds = F.col("level").isNull() | (F.col("cap") / F.col("weight").cast("double") <= F.col("level"))
    return w.select("source", "source_size", "weight", F.when(binds, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def decide(docs: DataFrame, cycle: tuple = (5, 2, 1), share: float = 1.0, max_copies: int = 3, seed: int = 11, weight: str | None = None, buckets: int | None = None, fitted: int = FITTED) -> DataFrame:
    """One row per document: doc_id, source, stratum (source as a key), size, u (its number), w, source_size, target, m, copies."""
    size = word_count(text_of())
    own = F.nanvl(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else by_length(size)
    level = F.when(own > 0, F.pow(F.lit(2.0), F.round(F.log2(own) * 4) / 4)).otherwise(0.0)
    rows = cut(docs.select("doc_id", "source", size.alias("size"), level.alias("w"), key_of("source").alias("stratum"), uniform(seed, text="text").alias("u")), "sizes")
    buckets = buckets or max(64, -(-rows.count() // ROWS))

    words = cut(rows.groupBy("stratum", "w").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("rows")), "words")
    goal = targets(words.groupBy("stratum").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).drop("stratum"), cycle, share, max_copies)
    rated = words.drop("source").join(goal.select(key_of("source").alias("stratum"), "source_size", "target"), "stratum")
    some = F.max(F.when(F.col("words") > 0, F.col("w"))).over(Window.partitionBy("stratum")) > 0
    rated = rated.withColumn("worth", F.when(some, F.col("w")).otherwise(1.0))
    rated = fill_up(rated, ["stratum"], "w", F.col("target"), F.col("words") * max_copies, F.when(F.col("words") > 0, F.col("words") * F.col("worth")).otherwise(F.lit(None)))
    m = F.when(F.col("source_size") == 0, 0.0).when(F.col("level").isNull(), F.when(F.col("worth") > 0, float(max_copies)).otherwise(0.0)).otherwise(F.least(F.col("level") * F.col("worth"), F.lit(float(max_copies))))
    # one row a source and weight, of a size the planner knows: it broadcasts that if it's small, so a hot source isn't moved to one task
    p = F.col("m") - F.floor("m")
    levels = F.collect_list(F.when(p > 0, F.struct("rows", (p / (1 - p)).alias("odds")))).over(Window.partitionBy("stratum"))
    goal = cut(rated.withColumn("m", m).select("stratum", "w", "source_size", "target", "m", levels.alias("levels")), "goal")
    odds = F.col("u") / (1 - F.col("u")) / (p / (1 - p))
    # the share of the source that a rank key is expected to exceed: even over the buckets whatever the weights
    share = F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + x["rows"] * (F.col("q") * x["odds"] / (1 + F.col("q") * x["odds"]))) / F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + x["rows"])
    each = rows.join(goal, ["stratum", "w"]).withColumn("whole", F.floor("m").cast("int")).withColumn("q", F.when((p > 0) & (F.col("size") > 0), odds))
    # bucket -1: nothing is left to chance
    each = each.withColumn("at", F.when(F.col("q").isNotNull(), F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")).otherwise(-1)).drop("levels")

    sums = each.groupBy("stratum", "at").agg(F.sum(F.when(F.col("at") >= 0, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    whole = Window.partitionBy("stratum")
    starts = cut(sums.select("stratum", "at", (F.sum("words").over(whole.orderBy("at")) - F.col("words")).alias("before"), (F.col("target") - F.sum("sure").over(whole)).alias("gap")), "starts")
    within = Window.partitionBy("stratum", "at").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    open_ = each.filter("at >= 0").withColumn("running", F.sum("size").over(within)).join(starts, ["stratum", "at"])
    open_ = open_.withColumn("extra", F.when(F.col("before") + F.col("running") <= F.col("gap"), 1).otherwise(0)).drop("running", "before")
    chosen = cut(open_, "ranked")
    spent = cut(chosen.groupBy("stratum").agg(F.first("gap").alias("gap"), F.sum(F.col("size") * F.col("extra")).alias("spent")).select("stratum", (F.col("gap") - F.col("spent")).alias("missing")), "missing")
    key = ["stratum", "q", "size"]
    same_id = F.col("doc_id").eqNullSafe(F.col("__id"))
    picks = None
    for _ in range(fitted):
        left = chosen.filter("extra = 0").join(spent, "stratum").filter(F.abs(F.col("size") - F.col("missing")) < F.col("missing"))
        if picks is not None:
            left = left.join(picks, [*[left[c] == picks[c] for c in key], left["doc_id"].eqNullSafe(picks["__id"])], "left_anti")
        best = left.groupBy("stratum").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "q", "doc_id", "size")).alias("b"))
        pick = cut(best.select("stratum", "b.q", "b.size", F.col("b.doc_id").alias("__id")), "picks")
        spent = cut(spent.join(pick.select("stratum", "size"), "stratum", "left").select("stratum", (F.col("missing") - F.coalesce("size", F.lit(0))).alias("missing")), "missing", instead=spent)
        picks = pick if picks is None else picks.union(pick)
    if picks is not None:
        picked = picks.withColumnsRenamed({c: f"__{c}" for c in key}).withColumn("__pick", F.lit(1))
        met = chosen.join(picked, [*[F.col(c) == F.col(f"__{c}") for c in key], same_id], "left")
        nth = F.row_number().over(Window.partitionBy("__stratum", "__q", "__size", "__id").orderBy("u"))
        twin = met.filter("__pick is not null").withColumn("extra", F.greatest("extra", (nth == 1).cast("int")))
        chosen = twin.select(*chosen.columns).unionByName(met.filter("__pick is null").select(*chosen.columns))
    every = chosen.drop("gap").unionByName(each.filter("at < 0").withColumn("extra", F.lit(0)))
    return every.withColumn("copies", F.col("whole") + F.col("extra")).withColumn("source_size", F.col("source_size").cast("long")).drop("whole", "extra", "q", "at")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, expected (copies)."""
    done = decide(docs, **settings)
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("m").alias("expected"))


def take(docs: DataFrame, seed: int = 11, **settings) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it. Documents without words are in no mix. Rows of one doc_id, source and text share their copies in order of a hash of their columns."""
    keys = ["__id", "__stratum", "__u"]
    decided = cut(decide(docs, seed=seed, **settings).select(key_of("doc_id").alias("__id"), F.col("stratum").alias("__stratum"), F.col("u").alias("__u"), "size", F.col("copies").alias("__copies")), "mix")
    decided = decided.filter("__copies > 0 and size > 0").drop("size")
    rows = docs.withColumns({"__id": key_of("doc_id"), "__stratum": key_of("source"), "__u": uniform(seed, text="text")})
    if not decided.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        nth = lambda *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        decided = decided.withColumn("__nth", nth(F.desc("__copies")))
        rows = rows.withColumn("__nth", nth(F.xxhash64(*docs.columns)))
        keys = [*keys, "__nth"]
    return rows.join(decided, keys).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
