"""Items that appear together: exact pair counts, lift and pointwise mutual information.

Baskets are deduplicated, equal baskets are folded into one weighted basket, ordered pairs are
emitted per basket and counted with map-side combine; chance comes from the marginals.

Items that cannot reach the pair thresholds on their own are dropped before any pair is formed.
This loses nothing (n_ab <= n_a) and bounds a basket: of items with n_a >= n * share there are at
most (mean basket size / share), so no basket grows with the data. Without a share a basket may hold
any number of items: one with more than ``basket_items`` is cut into blocks of about that many by the
items' hash, its pairs are formed block against block, and nothing longer than a block is ever held.

Defined results: null items or baskets are ignored; repeated hits count once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.session import broadcast_up_to, cut


#: Items of a basket that are held in one row.
BASKET_ITEMS = 2000


def pair_counts(hits: DataFrame, basket: str, item: str, min_pair: int = 1, min_share_inv: int | None = None, basket_items: int = BASKET_ITEMS) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n) for item_a < item_b with n_ab >= min_pair and n_ab * min_share_inv >= n."""
    pairs = hits.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct()
    pairs = cut(pairs)
    n = pairs.select("basket").distinct().count()
    least = max(min_pair, ceil(n / min_share_inv) if min_share_inv else 1)
    marginals = cut(pairs.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    kept = marginals.count()
    small = broadcast_up_to(marginals, kept)
    kept_pairs = pairs.join(small.select("item"), "item", "left_semi")
    sizes = kept_pairs.groupBy("basket").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > basket_items)
    has_large = not large.isEmpty()
    baskets = (
        (kept_pairs.join(large, "basket", "left_anti") if has_large else kept_pairs)
        .groupBy("basket")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .where(F.size("items") > 1)
        .groupBy("items")
        .agg(F.count("*").alias("weight"))
    )
    # ordered pairs of one folded basket, built in the JVM one left item at a time
    left = baskets.select("items", "weight", F.posexplode("items").alias("at", "item_a"))
    right = left.select("item_a", "weight", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))
    if has_large:
        right = right.union(_block_pairs(kept_pairs.join(large, "basket"), basket_items))
    counted = right.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= least)
    of = lambda side: small.select(F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"))
    return counted.join(of("a"), "item_a").join(of("b"), "item_b").withColumn("n", F.lit(n).cast("bigint"))


def _block_pairs(items: DataFrame, block_items: int) -> DataFrame:
    """(item_a, weight, item_b) of baskets (basket, item, size) cut into blocks; every two blocks of a basket meet once."""
    block = F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / block_items))
    blocks = items.groupBy("basket", block.alias("block")).agg(F.collect_set("item").alias("items"))
    other = blocks.select("basket", F.col("block").alias("other"), F.col("items").alias("others"))
    # one item against a whole block at a time
    met = blocks.join(other, "basket").where("block <= other").select((F.col("block") == F.col("other")).alias("own"), "others", F.explode("items").alias("x"))
    pairs = met.select("own", "x", F.explode("others").alias("y")).where("x < y OR (NOT own AND x > y)")
    return pairs.select(F.least("x", "y").alias("item_a"), F.lit(1).cast("bigint").alias("weight"), F.greatest("x", "y").alias("item_b"))


def with_chance(pairs: DataFrame) -> DataFrame:
    """Adds lift = n_ab * n / (n_a * n_b) and pmi = log2(lift)."""
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.withColumn("lift", lift).withColumn("pmi", F.log2(lift))


def over_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs with n_ab * n >= times * n_a * n_b, compared exactly."""
    big = lambda c: F.col(c).cast("decimal(18,0)")
    return pairs.where(big("n_ab") * big("n") >= F.lit(times) * (big("n_a") * big("n_b")))
