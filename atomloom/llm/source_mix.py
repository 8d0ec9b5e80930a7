"""Operator 6: mix sources to target weights by hash thresholds.

The largest mix is the largest at which the weights hold: a source's budget is
its weight times a common unit, the least of all sources' total / weight, so the
scarcest source is taken whole and the others are cut in proportion.  A source
that has less than TINY_PERCENT of its target share of all tokens doesn't set
the unit (else a nearly empty source would empty the mix): it gives all it has,
and stays below its share.  A level takes a percentage of every budget, so the
weights hold at each level, to within a document.

Each document has a 60-bit hash of its id, and of each source the documents of
the lowest hashes are taken, as many as the budget allows, so a mix of a smaller
budget is a subset of every mix of a larger one; no document is repeated.  The
threshold of each (source, level) comes from a histogram of tokens over hash
buckets: find the bucket in which the budget ends, split only that bucket by
the hash's next bits, and so on, until the hash has no bits left.  Documents
are then filtered by one comparison; they are never sorted or shuffled.

Tokens are whatever ``count`` makes of the documents; by default a text's
space-separated pieces, spaces + 1, which SQL can count too (an empty or null
text has none).  ``unigram_counts`` counts by operator 5's vocabulary.

Defined cases: a null source counts as the empty source; a null doc_id hashes
as the empty string; rows of equal doc_id (repeated rows, null ids) share a
hash and are taken or left together; a document that alone exceeds what is
left of the budget ends its source's selection; an empty table gives an empty
result; a source of weight 0 gives no row; sources without any token don't set
the unit and are kept; other columns, whatever their names, pass through
``select_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, read, require, shielded, sized, unshielded
from .token_count import count_tokens

HASH_BITS = 60
BUCKET_BITS = 12
#: Target weights, whole numbers; sources that aren't named have DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, int] = {"src0": 4}
DEFAULT_WEIGHT = 1
#: Nested mixes, in percent of the largest mix at which the weights hold.
LEVELS: Sequence[int] = (25, 50, 100)
SEED = "mix"
#: So many rows of boundary buckets need no further histograms.
FINISH_ROWS = 1 << 20
#: A source of less than this percentage of its target share doesn't bound the mix.
TINY_PERCENT = 1


def id_hash(doc_id: Column, seed: str = SEED) -> Column:
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def token_count(text: Column) -> Column:
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(F.length(text) > 0, spaces + 1).otherwise(0).cast("bigint")


def _weight(source: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(source == name, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def spaced_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) by spaces."""
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


def unigram_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) by operator 5's vocabulary, counted where the documents are."""
    return count_tokens(docs, carry=("source",)).select("doc_id", "source", "n_tokens")


def _narrow(counted: DataFrame) -> DataFrame:
    return counted.select(
        F.coalesce("source", F.lit("")).alias("mix_source"),
        id_hash(F.col("doc_id")).alias("mix_hash"),
        F.col("n_tokens").alias("mix_tokens"),
    )


def thresholds(
    docs: DataFrame,
    weights: Mapping[str, int] = WEIGHTS,
    default_weight: int = DEFAULT_WEIGHT,
    levels: Sequence[int] = LEVELS,
    count: Callable[[DataFrame], DataFrame] = spaced_counts,
) -> DataFrame:
    """(mix_source, mix_level, mix_below): at level i, 1 for the smallest, a source gives its documents of hash < mix_below."""
    require(docs, "doc_id", "text", "source")
    levels = sorted(int(x) for x in levels)
    # Narrow rows, written once; only histograms are shuffled from here on.
    narrow = cut(_narrow(count(docs)), "mix")
    shift = HASH_BITS - BUCKET_BITS
    top = cut(narrow.groupBy("mix_source", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("mix_tokens").alias("t")))
    weight = _weight(F.col("mix_source"), weights, default_weight)
    total = top.groupBy("mix_source").agg(F.sum("t").alias("total")).withColumn("w", weight).where("w > 0")
    whole = total.agg(F.sum("total").alias("all_tokens"), F.sum("w").alias("all_w"))  # one row
    bound = total.crossJoin(F.broadcast(whole)).where(f"total > 0 and total * all_w * 100 >= all_tokens * w * {TINY_PERCENT}")
    unit = bound.agg(F.coalesce(F.min(F.expr("total div w")), F.lit(0)).alias("unit"))  # one row
    budget = (
        total.crossJoin(F.broadcast(unit))
        .select("mix_source", F.expr("unit * w").alias("b"), F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("i", "percent"))
        .select("mix_source", (F.col("i") + 1).alias("mix_level"), F.expr("b * percent div 100").alias("left"))
    )
    # state: all hashes below base are in; of the bucket from base on, `left` tokens may still come in.
    state = budget.withColumn("base", F.lit(0).cast("bigint"))
    state = cut(_descend(state, top, shift))
    rows = narrow
    discard(top)
    while shift > 0:
        keys = state.where("open").select(F.col("mix_source").alias("k_source"), F.shiftright("base", shift).alias("k_bucket")).distinct()
        # Only the boundary buckets' rows go on; after the first round these are few.
        there = (F.col("mix_source") == F.col("k_source")) & (F.shiftright("mix_hash", shift) == F.col("k_bucket"))
        n = keys.count()
        if not n:
            break
        fewer = cut(rows.join(sized(keys, n, 64), there, "left_semi"), "mix")
        discard(rows)
        rows = fewer
        # Few rows are split by all the bits that are left at once: the result is the same.
        above, shift = shift, 0 if rows.count() <= FINISH_ROWS else max(0, shift - BUCKET_BITS)
        hist = rows.groupBy("mix_source", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("mix_tokens").alias("t"))
        deeper = cut(_descend(state.where("open").drop("open"), hist, shift, above).unionByName(state.where("not open")), "mix")
        discard(state)
        state = deeper
    discard(rows)
    return state.select("mix_source", "mix_level", F.col("base").alias("mix_below"))


def _descend(state: DataFrame, hist: DataFrame, shift: int, above: int | None = None) -> DataFrame:
    """Move each base to the start of the bucket (of ``shift`` low bits) in which its budget ends."""
    hist = hist.select(F.col("mix_source").alias("h_source"), F.col("bucket").alias("h_bucket"), F.col("t").alias("h_t"))
    same = F.col("h_source") == F.col("mix_source")
    end = F.lit(1 << HASH_BITS).cast("bigint")
    if above is not None:
        same &= F.shiftright("h_bucket", above - shift) == F.shiftright("base", above)
        end = F.shiftleft(F.shiftright("base", above) + 1, above)
    running = Window.partitionBy("mix_source", "mix_level").orderBy("h_bucket")
    cum = state.withColumn("end", end).join(hist, same, "left").withColumn("cum", F.sum("h_t").over(running))
    over = F.col("cum") > F.col("left")
    found = cum.groupBy("mix_source", "mix_level").agg(
        F.min(F.when(over, F.shiftleft("h_bucket", shift))).alias("at"),
        F.max("left").alias("had"),
        F.max(F.when(~over, F.col("cum"))).alias("spent"),
        F.max("end").alias("end"),
    )
    # A budget that isn't used up takes the whole range.
    return found.select(
        "mix_source",
        "mix_level",
        (F.col("had") - F.coalesce("spent", F.lit(0))).alias("left"),
        F.coalesce("at", "end").cast("bigint").alias("base"),
        (F.col("at").isNotNull() & F.lit(shift > 0)).alias("open"),
    )


def _joined(docs: DataFrame, limits: DataFrame) -> DataFrame:
    wide = limits.groupBy("mix_source").agg(F.array_sort(F.collect_list(F.struct("mix_level", "mix_below"))).alias("mix_limits"))
    wide = cut(wide)
    wide = sized(wide, wide.count(), 200)
    keyed = docs.withColumns({"mix_hash": id_hash(F.col("doc_id")), "mix_key": F.coalesce("source", F.lit(""))})
    level = F.expr("try_element_at(filter(mix_limits, x -> mix_hash < x.mix_below), 1).mix_level")
    return keyed.join(wide, F.col("mix_key") == F.col("mix_source")).withColumn("mix_in", level).where("mix_in is not null")


def select_documents(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, levels: Sequence[int] = LEVELS, count: Callable[[DataFrame], DataFrame] = spaced_counts) -> DataFrame:
    """The documents of the largest mix, with the columns that ``docs`` has."""
    require(docs, "doc_id", "text", "source")
    plain, back = shielded(docs, "doc_id", "source")
    return unshielded(_joined(plain, thresholds(docs, weights, default_weight, levels, count)), back)


def assign_levels(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, levels: Sequence[int] = LEVELS, count: Callable[[DataFrame], DataFrame] = spaced_counts) -> DataFrame:
    """(doc_id, source, n_tokens, mix_level): the smallest mix that holds each document; documents in no mix are left out."""
    out = _joined(count(docs), thresholds(docs, weights, default_weight, levels, count))
    return out.select("doc_id", "source", "n_tokens", F.col("mix_in").cast("bigint").alias("mix_level"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_levels(read(spark, sf_dir, "documents"))


def _sql(weights: Mapping[str, int], default: int, levels: Sequence[int]) -> str:
    case = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())
    caps = ", ".join(f"b * {p} // 100 AS b{i}" for i, p in enumerate(sorted(levels), 1))
    which = " ".join(f"WHEN cum <= b{i} THEN {i}" for i in range(1, len(levels) + 1))
    last = len(levels)
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS k,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         CAST(CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS BIGINT) AS n_tokens
  FROM documents),
total AS (
  SELECT k, CAST(sum(n_tokens) AS BIGINT) AS total, CASE k {case} ELSE {default} END AS w FROM d GROUP BY k),
share AS (SELECT *, CAST(sum(total) OVER () AS BIGINT) AS all_tokens, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM total WHERE w > 0),
unit AS (SELECT coalesce(min(total // w), 0) AS unit FROM share WHERE total > 0 AND total * all_w * 100 >= all_tokens * w * {TINY_PERCENT}),
part AS (SELECT k, unit * w AS b FROM share, unit),
budget AS (SELECT k, {caps} FROM part),
run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY k ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d)
SELECT doc_id, source, n_tokens, CAST(CASE {which} END AS BIGINT) AS mix_level
FROM run JOIN budget USING (k) WHERE cum <= b{last}
"""


OP6_SQL = _sql(WEIGHTS, DEFAULT_WEIGHT, LEVELS)
