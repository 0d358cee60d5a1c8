"""Mixing sources to target weights: temperature, bisection, budgeted block permutations. DataFrame functions only.

Weights are the sources' token shares to the power alpha, normalised. alpha in [0, 1] is the least exponent, by
bisection, at which the weights' entropy is no more than the target and no source is repeated more than allowed; the
limit on repetition wins over the target. Each job evaluates five levels of the bisection as one aggregate over the
table of sources.

The weights are realised within a budget of tokens: a source gets budget * weight tokens, as whole epochs and a part
of one more. Each source is dealt by hash into blocks of about ``block_tokens``; every epoch orders the blocks anew by
hash and the documents within each block too. Positions are sums over blocks (two levels, so that no window holds all
blocks of a source) and sums within a block, so a hot source is spread over its blocks. A document is taken if it ends
within its source's budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEVELS, ROUNDS = 5, 9
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text_column: str = "text") -> Column:
    """Words of a text and one end token; null and empty texts have the end token."""
    return (F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)) + 1).cast("long")


def order_key(*parts: Column) -> Column:
    """60 bits of an MD5 of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _measures(sources: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights, and the greatest weight against the share, for each exponent; one aggregate."""
    share = F.col("share")
    sums = []
    for i, a in enumerate(alphas):
        power = F.pow(share, F.lit(a))
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"u{i}"), F.max(F.pow(share, F.lit(a - 1))).alias(f"m{i}")]
    row = sources.agg(*sums).first()
    return [(math.log(row[f"z{i}"]) - a * row[f"u{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i, a in enumerate(alphas)]


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, budget: str | float) -> float:
    """The least alpha in [0, 1] that meets the entropy target and the limit on repetition; 1 if none does.

    sources: rows with ``share``. budget: a multiple of all tokens, or "all": the least with which no source is cut.
    """
    top = sources.agg(F.max("share")).first()[0]
    if top is None:
        return 1.0

    def good(a: float, measure: tuple[float, float]) -> bool:
        h, most = measure
        if repeats is not None:
            # with budget "all" the source of the greatest share is used once, others share ** (a - 1) times as often
            times = _least_share(sources, a, top) if budget == "all" else most * float(budget)
            if times > repeats + 1e-12:
                return False
        return entropy is None or h <= entropy + 1e-12

    low, high = 0.0, 1.0
    if good(0.0, _measures(sources, [0.0])[0]):
        return 0.0
    for _ in range(ROUNDS):
        steps = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        found = [good(a, m) for a, m in zip(steps, _measures(sources, steps), strict=True)]
        a, b = 0, len(steps) + 1  # indices of low and high among the steps
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if found[middle - 1] else (middle, b)
        edges = [low, *steps, high]
        low, high = edges[a], edges[b]
    return high


def _least_share(sources: DataFrame, a: float, top: float) -> float:
    if not hasattr(sources, "_least"):
        sources._least = sources.agg(F.min("share")).first()[0]
    return (top / sources._least) ** (1 - a)


def mix(
    docs: DataFrame,
    entropy_share: float | None = 0.95,
    repeats: float | None = 4.0,
    budget: str | float = 1.0,
    block_tokens: int = 1 << 18,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document and epoch that is taken: the columns in ``keep`` (default id and source), then n_tokens,
    weight, epoch, block and position (tokens of its source before it).

    entropy_share: target entropy as a share of the logarithm of the number of sources. repeats: how often a source
    may be used at most. budget: tokens of the result as a multiple of the input's, or "all" (see ``exponent``).

    A null source is a source of its own. Null and empty texts count one token, long texts are counted whole. Rows with
    equal ids are taken like others, side by side in ties. An empty table gives no rows.
    """
    keep = keep or [id_column, source_column]
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
        F.col(id_column).cast("string").alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("n")).alias("source"),
        # what a document is dealt by: its id, or where that is null its text, so that null ids fill no block alone
        F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit(""))))).alias("name"),
        tokens(text_column).alias("n_tokens"),
    )
    sources = sized.select("source", "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    sources = C.table(sources, "sources")
    total, count = sources.agg(F.sum("n"), F.count("*")).first()
    total = total or 1
    shares = C.table(sources.withColumn("share", F.col("n") / F.lit(total).cast("double")), "shares")
    entropy = None if entropy_share is None else entropy_share * math.log(max(count, 1))
    alpha = exponent(shares, entropy, repeats, budget)
    power = F.pow("share", F.lit(alpha))
    z, top = shares.agg(F.sum(power), F.max("share")).first()
    weight = power / F.lit(z or 1.0)
    if budget == "all":  # tokens of a source: its own, times how often
        goal = F.floor(F.col("n") * F.pow(F.col("share") / F.lit(top or 1.0), F.lit(alpha - 1)) + 1e-6)
    else:
        goal = F.floor(F.lit(float(budget) * total) * weight + 1e-6)
    plan = C.table(
        shares.select(
            "source",
            "n",
            F.round(weight, 6).alias("weight"),
            goal.cast("long").alias("goal"),
            F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long").alias("blocks"),
        ).withColumn("epochs", F.ceil(F.col("goal") / F.col("n")).cast("int")),
        "mixture",
    )
    name, label = F.col("name"), F.when(F.col("source") == "n", "null").otherwise(F.expr("substring(source, 2)"))
    dealt = sized.join(plan, "source").withColumn("block", order_key(F.lit(str(seed)), name) % F.col("blocks"))
    # sums by block, and where each block begins in every epoch's order
    blocks = C.table(dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("epochs").alias("epochs")), "blocks")
    turns = (
        blocks.where("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("turn", order_key(F.lit(str(seed)), label, F.col("block").cast("string"), F.col("epoch").cast("string")))
        .withColumn("range", F.shiftright("turn", 50))
    )
    part = Window.partitionBy("source", "epoch", "range").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = turns.groupBy("source", "epoch", "range").agg(F.sum("size").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(whole), F.lit(0)))
    placed = turns.withColumn("inner", F.coalesce(F.sum("size").over(part), F.lit(0))).join(
        ranges.select("source", "epoch", "range", "base"), ["source", "epoch", "range"]
    )
    placed = C.table(placed.select("source", "block", "epoch", (F.col("base") + F.col("inner")).alias("before")), "turns")
    inside = Window.partitionBy("source", "block", "epoch").orderBy("key", "name").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        dealt.where("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("key", order_key(F.lit(str(seed)), name, F.col("epoch").cast("string")))
        .withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(placed, ["source", "block", "epoch"])
        .withColumn("position", F.col("epoch") * F.col("n") + F.col("before") + F.col("inner"))
        .where(F.col("position") + F.col("n_tokens") <= F.col("goal"))
    )
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    extra = [F.col(c) for c in ("n_tokens", "weight", "epoch", "block", "position") if c not in keep]
    return rows.select(*own, *extra)


#: The same rows in SQL for entropy_share 0.95, repeats 4 and a budget of all tokens once.
SQL = r"""
WITH RECURSIVE
sized AS (SELECT doc_id, coalesce(source, 'null') AS source, 1 + len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM sized GROUP BY source),
shares AS (SELECT source, n, n / (SELECT sum(n) FROM sources)::DOUBLE AS share FROM sources),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN low ELSE middle END, CASE WHEN good THEN middle ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
               (SELECT ln(sum(pow(share, (low + high) / 2))) - (low + high) / 2 * sum(pow(share, (low + high) / 2) * ln(share)) / sum(pow(share, (low + high) / 2))
                       <= 0.95 * ln(count(*)) + 1e-12
                   AND max(pow(share, (low + high) / 2 - 1)) / sum(pow(share, (low + high) / 2)) <= 4 + 1e-12 FROM shares) AS good
        FROM bisect WHERE step < 45)),
alpha AS (SELECT high AS a FROM bisect WHERE step = 45),
weights AS (SELECT source, n, pow(share, (SELECT a FROM alpha)) / (SELECT sum(pow(share, (SELECT a FROM alpha))) FROM shares) AS w FROM shares),
plan AS (SELECT source, n, round(w, 6) AS weight, floor((SELECT sum(n) FROM sources)::DOUBLE * w + 1e-6)::BIGINT AS goal,
                greatest(1, ceil(n / 262144.0))::BIGINT AS blocks FROM weights),
dealt AS (SELECT doc_id, s.source, n_tokens, n, weight, goal, ceil(goal / n::DOUBLE)::BIGINT AS epochs,
                 ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT % blocks AS block FROM sized s JOIN plan p ON s.source = p.source),
rows AS (SELECT d.*, e.epoch, ('0x' || substr(md5('42|' || doc_id || '|' || e.epoch), 1, 15))::BIGINT AS key,
                ('0x' || substr(md5('42|' || source || '|' || block || '|' || e.epoch), 1, 15))::BIGINT AS turn
         FROM dealt d, (SELECT unnest(range(0, 64)) AS epoch) e WHERE e.epoch < d.epochs),
placed AS (SELECT *, epoch * n + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY turn, block, key, doc_id::VARCHAR
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM rows)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, weight, epoch::INTEGER AS epoch, block, position::BIGINT AS position
FROM placed WHERE position + n_tokens <= goal
"""
