"""Mixing sources to target weights, in blocks of tokens.

The tokens of each listed source form one stream, cut into blocks of fixed length. The
wanted number of blocks of a source follows from its target share of the whole, bounded by
blocks x max_repeats; unless told otherwise, the whole is the longest at which every source that
has documents reaches its share. Output slots lie in shards; each shard's source counts are drawn from
the multinomial law given the totals, so the totals are met exactly: a binary tree over the shards
splits each node's totals by a draw seeded by the node, so a task reaches its own shard in log2(shards)
steps and the driver sends only the totals. Slot j of a source is
mapped to its block by a pseudorandom permutation of the block numbers, a new one each time
the source starts over, and the blocks are joined by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.llm import bpe
from cinelode.session import cut, parallelism

BLOCK = 512
SEED = 20_240_229
#: Slots of an output shard.
SHARD = 1024
#: Documents of a source are laid out in this many chunks for each shuffle partition.
CHUNKS = 8


def token_lengths(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """(doc_id, source, n): tokens of each document; NULL and '' have none."""
    ids = bpe.encode(documents.withColumn("__key", F.struct("doc_id", "source")), "__key", name=name, folder=folder)
    return ids.select("__key.doc_id", "__key.source", F.size("ids").cast("bigint").alias("n"))


def laid_out(sized: DataFrame, chunks: int) -> DataFrame:
    """(doc_id, source, n, at): where each document begins in its source's stream of tokens.

    The order within a source is pseudorandom. A source of any size is spread over the chunks; only
    the totals of (source, chunk) meet in one window.
    """
    placed = sized.filter("n > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(chunks)))
    totals = placed.groupBy("source", "chunk").agg(F.sum("n").alias("t"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    begins = totals.select(F.col("source").alias("__s"), F.col("chunk").alias("__c"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "chunk").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(begins, (F.col("source") == F.col("__s")) & (F.col("chunk") == F.col("__c")))
        .select("doc_id", "source", "n", (F.col("base") + F.col("within")).alias("at"))
    )


#: Largest total that the exact hypergeometric sampler takes; above it the law's normal limit is rounded, which differs from it by less than one part in 10^4 of a spread.
EXACT_DRAW = 10**9 - 1


def longest(share: list[float], most: list[int]) -> int:
    """The largest whole at which each source with blocks gives its share of what all such sources give."""
    have = [(s, m) for s, m in zip(share, most, strict=True) if s > 0 and m > 0]
    total = sum(s for s, _ in have)
    return min((int(m * total / s) for s, m in have), default=0)


def planned(targets: pd.DataFrame, tokens: dict[str, int], block: int, total_blocks: int | None) -> pd.DataFrame:
    """One row for each listed source: its blocks, the slots wanted and the slots given.

    targets: source, target_share, max_repeats, one row for each source; bad or missing shares count as 0,
    missing repeats as 1. With ``total_blocks`` wanted slots are the share of that number, given ones what the source has. Without it, the whole
    is the longest at which all sources that have documents reach their shares; a source without any can't be met at any length,
    so the others share what it leaves in proportion.
    """
    t = targets.dropna(subset=["source"]).drop_duplicates("source").sort_values("source").reset_index(drop=True)
    share = pd.to_numeric(t["target_share"], errors="coerce").fillna(0).clip(lower=0)
    t["target_share"] = share / share.sum() if share.sum() else share
    t["max_repeats"] = pd.to_numeric(t["max_repeats"], errors="coerce").fillna(1).clip(lower=0).astype("int64")
    t["tokens"] = [int(tokens.get(s, 0)) for s in t["source"]]
    t["blocks"] = -(-t["tokens"] // block)
    most = t["blocks"] * t["max_repeats"]
    if total_blocks is None:
        there = t["target_share"].where(most > 0, 0.0)
        whole = longest(t["target_share"].tolist(), most.tolist())
        exact = there / there.sum() * whole if there.sum() else there
    else:
        exact = t["target_share"] * total_blocks
    wanted = np.floor(exact).astype("int64")
    rest = (exact - wanted).sort_values(ascending=False, kind="stable").index[: int(round(exact.sum())) - int(wanted.sum())]
    wanted.loc[rest] += 1
    t["wanted"] = wanted
    if total_blocks is None:
        # A source without documents would have its share of the same whole.
        t.loc[most == 0, "wanted"] = (t["target_share"] * int(wanted.sum())).round().astype("int64")
    t["given"] = np.minimum(t["wanted"], most)
    return t


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return from good + bad are good, for totals of any size."""
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    if low >= high:
        return low
    if total <= EXACT_DRAW:
        return int(rng.hypergeometric(good, bad, n))
    # Whole numbers of any size in the mean, so no total loses its last digits.
    mean = n * good // total
    spread = (n / total * good * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return min(max(mean + round(float(rng.standard_normal()) * spread), low), high)


def split(given: list[int], n: int, key: tuple[int, ...]) -> list[int]:
    """Source counts of a node's first ``n`` slots, given its totals: one hypergeometric draw after another."""
    rng = np.random.default_rng(key)
    out, left, need = [], sum(given), n
    for g in given:
        x = hypergeometric(rng, g, left - g, need)
        out.append(x)
        left, need = left - g, need - x
    return out


def shards_of(given: list[int], shard: int) -> int:
    return -(-sum(given) // shard)


def drawn(given: list[int], shard: int, low: int, high: int, seed: int = SEED) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, counts, counts of all shards before it) of the shards ``low`` to ``high`` - 1.

    The walk goes down the tree over all shards, into nodes that touch the range only. All shards have ``shard`` slots but the last.
    """
    stack = [(0, shards_of(given, shard), list(given), [0] * len(given))]
    while stack:
        a, b, totals, before = stack.pop()
        if b <= low or a >= high or a >= b:
            continue
        if b - a == 1:
            yield a, totals, before
            continue
        mid = (a + b) // 2
        left = split(totals, (mid - a) * shard, (seed, a, b))
        right = [t - x for t, x in zip(totals, left, strict=True)]
        stack.append((mid, b, right, [p + x for p, x in zip(before, left, strict=True)]))
        stack.append((a, mid, left, before))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each ``j`` in a keyed pseudorandom permutation of 0 .. n-1.

    Four Feistel rounds over the next even number of bits; values outside walk on until they are inside.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64), 1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, open_ = j.astype(np.uint64), np.ones(len(j), dtype=bool)
    limit = n.astype(np.uint64)
    k = key.astype(np.uint64)
    while open_.any():
        left, right = x[open_] >> half[open_], x[open_] & mask[open_]
        for r in range(4):
            with np.errstate(over="ignore"):
                h = (right + k[open_] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[open_])
        x[open_] = left << half[open_] | right
        open_ = x >= limit
    return x.astype(np.int64)


def slots(spark: SparkSession, plan: pd.DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, repeat): every output slot with the block that fills it.

    Each task draws the counts of its own shards; the driver sends one number for each source.
    """
    sources, blocks, given = plan["source"].tolist(), plan["blocks"].to_numpy(), [int(x) for x in plan["given"]]
    n_shards = shards_of(given, shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            # The numbers of a batch are a range.
            for s, c, b in drawn(given, shard, int(ids[0]), int(ids[-1]) + 1, seed) if len(ids) else ():
                c, b = np.asarray(c, np.int64), np.asarray(b, np.int64)
                which = np.repeat(np.arange(len(c)), c)
                j = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(b, c)
                n = blocks[which]
                again = j // n
                block = permuted(j % n, n, which * 1_000_003 + again + seed)
                order = np.random.default_rng([seed, int(s)]).permutation(len(which))
                yield pd.DataFrame({"shard": int(s), "slot": order, "source": [sources[w] for w in which], "block": block, "repeat": again + 1})

    return spark.range(0, n_shards, 1, max(1, min(parallelism(spark), n_shards))).mapInPandas(run, "shard bigint, slot bigint, source string, block bigint, repeat bigint")


def _plan(documents: DataFrame, targets: DataFrame, block: int, total_blocks: int | None) -> tuple[pd.DataFrame, DataFrame]:
    """The plan and the documents' places. The targets are one row for each source (refused beyond 100,000)."""
    wanted = targets.select("source", "target_share", "max_repeats").limit(100_001).toPandas()
    if len(wanted) > 100_000:
        raise ValueError("too many sources")
    listed = documents.select("doc_id", "source", "text").join(F.broadcast(targets.select("source").filter("source is not null").distinct()), "source", "left_semi")
    sized = cut(token_lengths(listed))
    tokens = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    return planned(wanted, tokens, block, total_blocks), sized


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total_blocks: int | None = None) -> DataFrame:
    """The mixed output: shard, slot, source, block, repeat, n_tokens, docs.

    docs: array of (doc_id, from_token, to_token) that make up the block, in order. No block, and so no
    document, is used more than max_repeats times. A source that is too small gives what it has; the others
    keep their number of blocks (see :func:`report`). Empty texts have no tokens and are in no block; unlisted and
    NULL sources are left out; no documents or no targets give no rows. ``total_blocks`` sets the length, see :func:`planned`.
    """
    plan, sized = _plan(documents, targets, block, total_blocks)
    spark = documents.sparkSession
    spans = laid_out(sized, CHUNKS * parallelism(spark))
    number = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)))
    cutup = spans.withColumn("block", number).select("source", "block", "doc_id", *_span(block))
    filled = cutup.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("order", "doc_id", "from_token", "to_token"))).alias("docs"))
    docs = F.transform("docs", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["from_token"].alias("from_token"), x["to_token"].alias("to_token")))
    return slots(spark, plan).join(filled, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "n_tokens", docs.alias("docs"))


def _span(block: int) -> list[Column]:
    low, high = F.col("block") * block, (F.col("block") + 1) * block
    return [
        F.greatest(F.col("at"), low).alias("order"),
        (F.greatest(F.col("at"), low) - F.col("at")).alias("from_token"),
        (F.least(F.col("at") + F.col("n"), high) - F.col("at")).alias("to_token"),
    ]


def report(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total_blocks: int | None = None) -> DataFrame:
    """Per listed source: target_share, max_repeats, tokens, blocks, wanted and given blocks, most_repeats, mixed_tokens, actual_share, met.

    Without ``total_blocks`` every source with documents is met; with a longer whole the small ones fall short.

    The last block of a source may be shorter, so tokens are counted from the slots themselves. A target is met if its
    source gives all wanted blocks.
    """
    plan, sized = _plan(documents, targets, block, total_blocks)
    spark = documents.sparkSession
    columns = "source string, target_share double, max_repeats bigint, tokens bigint, blocks bigint, wanted bigint, given bigint"
    table = spark.createDataFrame(plan[[c.split()[0] for c in columns.split(", ")]], columns)
    used = slots(spark, plan).join(F.broadcast(table.select("source", "tokens")), "source")
    n = F.least(F.lit(block), F.col("tokens") - F.col("block") * block)
    sums = used.groupBy("source").agg(F.sum(n).alias("mixed_tokens"), F.max("repeat").alias("most_repeats"))
    whole = W.partitionBy()
    return (
        table.join(sums, "source", "left")
        .withColumns({"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
        .withColumn("actual_share", F.when(F.sum("mixed_tokens").over(whole) > 0, F.col("mixed_tokens") / F.sum("mixed_tokens").over(whole)).otherwise(0.0))
        .withColumn("met", F.col("given") == F.col("wanted"))
    )
