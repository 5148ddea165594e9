"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame expressions only.

Source i holds a share p(i) of all tokens and gets the weight p(i)**x / sum of p**x. The exponent x is bisected on a
grid of 2**20 steps in [0, 1]: the largest x whose weights reach the target entropy, but no smaller than the smallest
x at which no source is repeated beyond the limit. A source's quota is its weight of the budget: whole epochs, and for
the rest a prefix of a pseudo-random permutation of its blocks, each block's documents again permuted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_shared

#: Production parameters: share of the largest possible entropy, most repetitions of a source, budget as a multiple of
#: all tokens, documents a block holds on average, seed of the permutations.
ENTROPY_SHARE, REPEAT_LIMIT, BUDGET, BLOCK_DOCS, SEED = 0.95, 4.0, 1.0, 1024, "mix"
GRID, LEVELS = 1 << 20, 5


def tokens_of(text: str = "text") -> Column:
    """Token estimate of a whole text: a quarter of its UTF-8 bytes, rounded up; one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("bigint")


def _hash(*parts: str | Column) -> Column:
    """A number below 2**32 from an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _bisect(shares: DataFrame, measure: Column, holds, rising: bool) -> int:
    """Largest (not ``rising``) or smallest (``rising``) grid place at which ``holds(measure)``; measures of 2**5 - 1
    places in a pass over the table of sources, which is five halvings at once."""
    lo, hi = -1, GRID + 1  # holds at lo and fails at hi, or the reverse
    while hi - lo > 1:
        step = max(1, (hi - lo) >> LEVELS)
        places = [k for k in range(lo + step, hi, step)]
        grid = F.explode(F.array(*[F.lit(k).cast("int") for k in places])).alias("k")
        rows = shares.select("p", grid).withColumn("q", F.pow("p", F.col("k") / GRID)).groupBy("k").agg(measure.alias("m")).collect()  # bounded: len(places)
        met = {r["k"] for r in rows if holds(r["m"])}
        for k in places:
            if (k in met) == rising:
                hi = min(hi, k)
            else:
                lo = max(lo, k)
    return min(hi, GRID) if rising else max(lo, 0)


def exponent(totals: DataFrame, entropy_share: float = ENTROPY_SHARE, repeat_limit: float = REPEAT_LIMIT, budget: float = BUDGET) -> float:
    """The mixing exponent for ``totals(source, source_tokens)``; 1 where there is no token."""
    whole = totals.agg(F.sum("source_tokens").alias("t"), F.count("*").alias("n"), F.min("source_tokens").alias("least")).first()
    if not whole["t"]:
        return 1.0
    shares = totals.select((F.col("source_tokens") / float(whole["t"])).alias("p"))
    entropy = F.log(F.sum("q")) - F.sum(F.col("q") * F.log("q")) / F.sum("q")
    goal = entropy_share * float(shares.agg(F.log(F.count("*").cast("double"))).first()[0])
    by_entropy = _bisect(shares, entropy, lambda m: m >= goal - 1e-9, rising=False)
    repeats = budget * F.max(F.col("q") / F.col("p")) / F.sum("q")
    by_repeats = _bisect(shares, repeats, lambda m: m <= repeat_limit + 1e-9, rising=True)
    return max(by_entropy, by_repeats) / GRID


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, repeat_limit: float = REPEAT_LIMIT, budget: float = BUDGET, block_docs: int = BLOCK_DOCS, seed: str = SEED, keep: bool = False) -> DataFrame:
    """``(doc_id, source, n_tokens, weight, epochs, block, n_copies)`` of every row, ``n_copies`` 0 or more; with
    ``keep`` a struct ``__row`` holds all its columns.

    A null source counts as the source ''; a null text has one token; a null doc_id is one place in the permutation;
    rows of equal doc_id lie together and their order is that of their sizes; an empty table gives no rows. A source
    of any size is dealt into blocks of bounded size by hash, and only sums of blocks are ordered across a source.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep else []
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), tokens_of().alias("n_tokens"), *row)
    totals = write_shared(slim.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs")), "mix-sources")
    x = exponent(totals, entropy_share, repeat_limit, budget)
    all_ = totals.agg(F.sum("source_tokens").alias("t"), F.count("*").alias("n")).first()
    total = float(all_["t"] or 1)
    power = F.pow(F.col("source_tokens") / total, F.lit(x))
    scale = totals.agg(F.sum(power)).first()[0] or 1.0
    quota = F.floor(F.col("weight") * F.lit(float(int(total * budget))) + F.lit(1e-6))
    plan = totals.withColumn("weight", F.round(power / scale, 9)).withColumn("quota", quota)
    plan = plan.withColumn("epochs", F.floor(F.col("quota") / F.col("source_tokens")).cast("bigint")).withColumn("rest", (F.col("quota") - F.col("epochs") * F.col("source_tokens")).cast("bigint"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_docs") / block_docs).cast("bigint"))

    # the block depends on the row and its source alone; a hot source's rows are spread over its many blocks
    dealt = slim.withColumn("turn", _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = plan.select("source", "blocks", "weight", "epochs", "rest")
    placed = _with_blocks(dealt, sized)
    sums = placed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    order = Window.partitionBy("source").orderBy(_hash(F.lit(seed), "source", F.col("block").cast("string")), "block")
    starts = sums.withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).select("source", "block", "before")
    within = Window.partitionBy("source", "block").orderBy(F.col("turn"), F.col("doc_id"), F.col("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.join(starts, ["source", "block"]).withColumn("reached", F.col("before") + F.sum("n_tokens").over(within))
    copies = F.col("epochs") + F.when(F.col("reached") <= F.col("rest"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "n_tokens", "weight", "epochs", "block", copies.cast("bigint").alias("n_copies"), *(["__row"] if keep else []))


def _with_blocks(dealt: DataFrame, sized: DataFrame) -> DataFrame:
    """Joins the sources' plan to their rows, a hot source spread over 64 salts, and numbers each row's block."""
    salted = sized.select("*", F.explode(F.array(*[F.lit(k) for k in range(64)])).alias("salt"))
    joined = dealt.withColumn("salt", (F.col("turn") % 64).cast("int")).join(salted, ["source", "salt"])
    return joined.withColumn("block", F.floor(F.col("turn") / 64) % F.col("blocks")).drop("salt")


def realise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns, each row as many times as its source's weight gives it."""
    mixed = mix(docs, keep=True, **options).where("n_copies > 0")
    rows = mixed.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))).alias("copy"))
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def oracle(entropy_share: float = ENTROPY_SHARE, repeat_limit: float = REPEAT_LIMIT, budget: float = BUDGET, block_docs: int = BLOCK_DOCS, seed: str = SEED) -> str:
    """The same in DuckDB SQL over ``documents``; the grid is bisected by a recursive query."""
    digest = "('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT"
    turn = digest.format(f"'{seed}', coalesce(doc_id::VARCHAR, 'null')")
    block_turn = digest.format(f"'{seed}', source, block::VARCHAR")
    q = f"pow(p, ((lo + hi) // 2) / {GRID}.0)"
    return f"""
    WITH RECURSIVE slim AS (
      SELECT doc_id, coalesce(source, '') AS source,
             greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::BIGINT AS n_tokens FROM documents
    ), totals AS (
      SELECT source, sum(n_tokens)::BIGINT AS source_tokens, count(*) AS source_docs FROM slim GROUP BY source
    ), shares AS (SELECT source_tokens / (SELECT sum(source_tokens) FROM totals)::DOUBLE AS p FROM totals
    ), places AS (
      SELECT 'entropy' AS kind, -1 AS lo, {GRID + 1} AS hi
      UNION ALL SELECT 'repeats', -1, {GRID + 1}
      UNION ALL
      SELECT kind, CASE WHEN met = (kind = 'entropy') THEN mid ELSE lo END, CASE WHEN met = (kind = 'entropy') THEN hi ELSE mid END
      FROM (
        SELECT kind, lo, hi, (lo + hi) // 2 AS mid,
               CASE WHEN kind = 'entropy'
                    THEN ln(sum({q})) - sum({q} * ln({q})) / sum({q}) >= {entropy_share} * ln(count(*)) - 1e-9
                    ELSE {budget} * max({q} / p) / sum({q}) <= {repeat_limit} + 1e-9 END AS met
        FROM places, shares WHERE hi - lo > 1 GROUP BY kind, lo, hi
      )
    ), chosen AS (
      SELECT greatest(max(CASE WHEN kind = 'entropy' THEN greatest(lo, 0) END), max(CASE WHEN kind = 'repeats' THEN least(hi, {GRID}) END)) / {GRID}.0 AS x
      FROM places WHERE hi - lo = 1
    ), powered AS (
      SELECT *, pow(source_tokens / (SELECT sum(source_tokens) FROM totals)::DOUBLE, (SELECT x FROM chosen)) AS q FROM totals
    ), weighted AS (
      SELECT *, round(q / sum(q) OVER (), 9) AS weight, floor((SELECT sum(source_tokens) FROM totals)::DOUBLE * {budget}) AS budget FROM powered
    ), planned AS (
      SELECT *, floor(weight * budget + 1e-6)::BIGINT AS quota, ceil(source_docs / {block_docs}.0)::BIGINT AS blocks FROM weighted
    ), plan AS (
      SELECT *, quota // source_tokens AS epochs, quota % source_tokens AS rest FROM planned
    ), placed AS (
      SELECT doc_id, source, n_tokens, weight, epochs, rest, {turn} AS turn, ({turn} // 64) % blocks AS block FROM slim JOIN plan USING (source)
    ), sums AS (SELECT source, block, sum(n_tokens) AS block_tokens FROM placed GROUP BY ALL
    ), starts AS (
      SELECT source, block, sum(block_tokens) OVER (PARTITION BY source ORDER BY {block_turn}, block ROWS UNBOUNDED PRECEDING) - block_tokens AS before FROM sums
    ), reached AS (
      SELECT *, before + sum(n_tokens) OVER (PARTITION BY source, block ORDER BY turn, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS reached
      FROM placed JOIN starts USING (source, block)
    )
    SELECT doc_id, source, n_tokens, weight, epochs::BIGINT AS epochs, block::BIGINT AS block,
           (epochs + CASE WHEN reached <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM reached
    """
