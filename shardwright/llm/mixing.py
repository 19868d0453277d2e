"""Temperature mixing of sources to target weights, with built-in functions only.

A source's weight is its share of tokens to the power alpha, normalised: alpha
1 keeps the natural mix, 0 makes sources equal. Alpha is the largest that
reaches the target entropy, by bisection; if some source would then be repeated
more than ``max_epochs`` times, it is the smallest that doesn't, by bisection
too. The mix is realised as block permutations: documents fall into blocks of
about ``block_docs`` by a hash of id and text, every epoch permutes the blocks of a source and the
documents of a block anew, and a source's budget of tokens is spent on whole
epochs and then on the front of one more permutation. So no step needs a source
in one place: sums run over blocks, first within ranges of their order, then over the
ranges, and only a cut block's documents are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.llm.common import cut

ENTROPY, MAX_EPOCHS, BUDGET_RATIO, BLOCK_DOCS, SEED, LEVELS = 0.999, 4.0, 1.0, 256, 7, 32
#: Levels of bisection that one job decides: it evaluates all midpoints that they may need.
AT_ONCE = 4
#: Up to so many sources (a few MB) the plan is broadcast; beyond, it joins by shuffle, where Spark splits hot sources.
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits that cut the order of a source's blocks into ranges.
RANGE_DIGITS = 3


def n_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def bisect(totals: DataFrame, what: str, target: float, budget_ratio: float) -> tuple[float, float]:
    """(lo, hi), LEVELS bisections of [0, 1]; ``totals`` has a share for each source.

    what 'entropy': lo has an entropy of ``target`` or more. what 'epochs': hi
    repeats no source more than ``target`` times. Only figures for each midpoint reach the driver.
    """
    lo, hi = 0.0, 1.0
    for _ in range(LEVELS // AT_ONCE):
        grid = [lo + (hi - lo) * k / 2**AT_ONCE for k in range(2**AT_ONCE + 1)]
        held = dict(evaluate(totals, grid[1:-1], what, target, budget_ratio))
        i, j = 0, 2**AT_ONCE
        while j - i > 1:
            mid = (i + j) // 2
            if held[grid[mid]] == (what == "entropy"):
                i = mid
            else:
                j = mid
        lo, hi = grid[i], grid[j]
    return lo, hi


def evaluate(totals: DataFrame, alphas: list[float], what: str, target: float, budget_ratio: float) -> list[tuple[float, bool]]:
    """Whether each exponent meets the target."""
    at = totals.where("share > 0").select("share", F.explode(F.array(*(F.lit(a) for a in alphas))).alias("alpha")).withColumn("p", F.pow("share", F.col("alpha")))
    if what == "entropy":
        # H = ln Z - sum(p ln p) / Z for unnormalised p
        made = at.groupBy("alpha").agg((F.log(F.sum("p")) - F.sum(F.col("p") * F.log("p")) / F.sum("p")).alias("h"), F.count("*").alias("n"))
        return [(r[0], bool(r[1])) for r in made.select("alpha", F.col("h") >= F.lit(target) * F.log(F.col("n").cast("double"))).collect()]
    made = at.groupBy("alpha").agg((F.max(F.col("p") / F.col("share")) / F.sum("p") * F.lit(budget_ratio)).alias("epochs"))
    return [(r[0], r[1] <= target) for r in made.collect()]


def temperature(totals: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget_ratio: float = BUDGET_RATIO) -> float:
    """The exponent. ``entropy`` is a fraction of the largest entropy that the sources allow."""
    if evaluate(totals, [1.0], "entropy", entropy, budget_ratio) in ([], [(1.0, True)]):
        return 1.0
    alpha = bisect(totals, "entropy", entropy, budget_ratio)[0]
    fits = dict(evaluate(totals, [alpha], "epochs", max_epochs, budget_ratio))
    return alpha if fits[alpha] else bisect(totals, "epochs", max_epochs, budget_ratio)[1]


def _rank_key(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def _name(id_: Column, text: Column) -> Column:
    """What blocks and orders hash: id and text, so that rows of null or repeated ids are dealt over all blocks."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (id_, text))).cast("binary")), 1, 16)


def before(blocks: DataFrame, group: list[str], key: Column, value: str, name: str) -> DataFrame:
    """``blocks`` with ``name``, the sum of ``value`` over the rows of the group that stand before in order of ``key`` (a digest) and block.

    Sums run within ranges of the digest, then over a group's ranges, so no group meets in one task.
    """
    keyed = blocks.withColumn("_order", key).withColumn("_range", F.substring("_order", 1, RANGE_DIGITS))
    so_far = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = keyed.groupBy(*group, "_range").agg(F.sum(value).alias("_held"))
    first = ranges.select(*group, "_range", so_far(W.partitionBy(*group).orderBy("_range"), "_held").alias("_first"))
    inside = keyed.withColumn("_inside", so_far(W.partitionBy(*group, "_range").orderBy("_order", "block"), value))
    return inside.join(first, [*group, "_range"]).withColumn(name, F.col("_first") + F.col("_inside")).select(*blocks.columns, name)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget_ratio: float = BUDGET_RATIO, block_docs: int = BLOCK_DOCS, seed: int = SEED, key_col: str | None = None) -> DataFrame:
    """The mixed order, a row for each use of a document.

    Columns: id_col, source, n_tokens, alpha, weight, epoch (from 1), block,
    block_rank (of the block in its source's epoch), position (in its block),
    and ``key_col``, if named: a key of each row, for joins where ids are null or repeat.
    The budget is ``budget_ratio`` times all tokens. A null source counts as the
    empty one, a null text as empty; a null id stays null. Texts without tokens
    come with every whole epoch. Repeated rows count each; rows
    of one null or repeated id spread over blocks by their texts, those equal in both share one. If no exponent
    meets the repetition limit (a budget over ``max_epochs`` times the
    tokens), alpha is 1. No rows in: no rows out.
    """
    carried = [] if key_col is None else ["_row"]
    narrow = cut(docs.select(*(F.col(key_col).alias(c) for c in carried), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"), _name(F.col(id_col), F.col(text_col)).alias("_name")))
    sums = narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    everything = narrow.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    totals = cut(sums.withColumn("share", F.col("tokens") / F.lit(float(max(1, everything)))))
    alpha = temperature(totals, entropy, max_epochs, budget_ratio)
    z = totals.where("share > 0").agg(F.coalesce(F.sum(F.pow("share", F.lit(alpha))), F.lit(1.0))).first()[0]
    weight = F.when(F.col("share") > 0, F.round(F.pow("share", F.lit(alpha)) / F.lit(z), 9)).otherwise(0.0)
    plan = (
        totals.withColumn("weight", weight)
        .withColumn("budget", F.floor(F.col("weight") * F.lit(budget_ratio * everything)).cast("long"))
        .withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1))
        .select("source", "weight", "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"))
    )
    number = F.conv(F.substring(_rank_key(seed, "block", F.col("_name")), 1, 8), 16, 10).cast("long")
    # A hot source would meet in one task; a plan of few sources goes to the rows instead.
    few = totals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    placed = narrow.join(F.broadcast(plan) if few else plan, "source").withColumn("block", number % F.col("blocks"))

    # The blocks of the last, partial epoch: whole ones while they fit, then one that is cut.
    part = placed.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("held"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    walk = _rank_key(seed, "order", (F.col("full") + 1).cast("string"), F.col("source"), F.col("block").cast("string"))
    taken = before(part, ["source"], walk, "held", "before").where("before < rest").select("source", "block", (F.col("rest") - F.col("before")).alias("left"), (F.col("before") + F.col("held") > F.col("rest")).alias("cut"))

    inside = _rank_key(seed, "doc", F.col("epoch").cast("string"), F.col("_name"))
    every = placed.withColumn("epoch", F.explode(F.expr("CASE WHEN full > 0 THEN sequence(1L, full) END"))).select(*carried, "_id", "_name", "source", "n_tokens", "weight", "block", "epoch", F.lit(None).cast("long").alias("left"))
    last = placed.where("rest > 0").join(taken, ["source", "block"]).select(*carried, "_id", "_name", "source", "n_tokens", "weight", "block", (F.col("full") + 1).alias("epoch"), F.when(F.col("cut"), F.col("left")).alias("left"))
    both = every.union(last).withColumn("_key", inside)
    within = W.partitionBy("source", "epoch", "block").orderBy("_key", "_id", "n_tokens", *carried)
    ranked = both.withColumn("position", F.row_number().over(within).cast("long")).withColumn("_sum", F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    kept = ranked.where("left is null or _sum <= left")

    blocks = kept.groupBy("source", "epoch", "block").agg(F.lit(1).alias("one"))
    order = _rank_key(seed, "order", F.col("epoch").cast("string"), F.col("source"), F.col("block").cast("string"))
    ranks = before(blocks, ["source", "epoch"], order, "one", "place").select("source", "epoch", "block", (F.col("place") + 1).cast("long").alias("block_rank"))
    return kept.join(ranks, ["source", "epoch", "block"]).select(F.col("_id").alias(id_col), "source", "n_tokens", F.lit(alpha).alias("alpha"), "weight", F.col("epoch").cast("long").alias("epoch"), "block", "block_rank", "position", *(F.col(c).alias(key_col) for c in carried))


def mixing_sql(documents: str = "documents", entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget_ratio: float = BUDGET_RATIO, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> str:
    """``mix`` in DuckDB."""
    z = "list_sum(list_transform(shares, lambda s: s ** a))"
    h = f"ln({z}) - list_sum(list_transform(shares, lambda s: (s ** a) * ln(s ** a))) / {z}"
    e = f"list_max(list_transform(shares, lambda s: (s ** a) / s)) / {z} * CAST({budget_ratio} AS DOUBLE)"
    step = lambda n, test, up: f"{n}(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, CASE WHEN {up} THEN a ELSE lo END, CASE WHEN {up} THEN hi ELSE a END FROM (SELECT i, lo, hi, a, shares, {test} AS ok FROM (SELECT i, lo, hi, (lo + hi) / 2 AS a FROM {n} WHERE i < {LEVELS}), lists))"
    target = f"CAST({entropy} AS DOUBLE) * ln(CAST(len(shares) AS DOUBLE))"
    return f"""
WITH RECURSIVE narrow AS (SELECT doc_id, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 16) AS name, coalesce(source, '') AS source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM {documents}),
alltok AS (SELECT coalesce(CAST(sum(n_tokens) AS BIGINT), 0) AS n FROM narrow),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs, sum(n_tokens) / CAST(greatest(1, (SELECT n FROM alltok)) AS DOUBLE) AS share FROM narrow GROUP BY source),
lists AS (SELECT list(share ORDER BY source) AS shares FROM totals WHERE share > 0),
{step('ent', f'({h}) >= {target}', 'ok')},
{step('rep', f'({e}) <= {max_epochs}', 'NOT ok')},
nat AS (SELECT ({h}) >= {target} AS ok FROM (SELECT CAST(1 AS DOUBLE) AS a, shares FROM lists)),
enta AS (SELECT lo AS a FROM ent WHERE i = {LEVELS}),
fits AS (SELECT ({e}) <= {max_epochs} AS ok FROM enta, lists),
chosen AS (SELECT CASE WHEN (SELECT ok FROM nat) THEN CAST(1 AS DOUBLE) WHEN (SELECT ok FROM fits) THEN (SELECT a FROM enta) ELSE (SELECT hi FROM rep WHERE i = {LEVELS}) END AS a),
norm AS (SELECT a, {z} AS z FROM chosen, lists),
weighted AS (SELECT source, tokens, docs, CASE WHEN share > 0 THEN round((share ** a) / z, 9) ELSE CAST(0 AS DOUBLE) END AS weight FROM totals, norm),
budgeted AS (SELECT *, CAST(floor(weight * (CAST({budget_ratio} AS DOUBLE) * (SELECT n FROM alltok))) AS BIGINT) AS budget FROM weighted),
plan AS (SELECT source, weight, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS full_, budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END) * tokens AS rest, CAST(ceil(docs / CAST({block_docs} AS DOUBLE)) AS BIGINT) AS blocks FROM budgeted),
placed AS (SELECT doc_id, name, source, n_tokens, weight, full_, rest, CAST('0x' || substr(md5('{seed}|block|' || name), 1, 8) AS BIGINT) % blocks AS block FROM narrow JOIN plan USING (source)),
part AS (SELECT source, block, sum(n_tokens) AS held, any_value(full_) AS full_, any_value(rest) AS rest FROM placed WHERE rest > 0 GROUP BY source, block),
walked AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY source ORDER BY md5('{seed}|order|' || (full_ + 1) || '|' || source || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part),
taken AS (SELECT source, block, rest - before AS left_, before + held > rest AS cut_ FROM walked WHERE before < rest),
both_ AS (
  SELECT doc_id, name, source, n_tokens, weight, block, unnest(range(1, full_ + 1)) AS epoch, CAST(NULL AS HUGEINT) AS left_ FROM placed
  UNION ALL SELECT doc_id, name, source, n_tokens, weight, block, full_ + 1, CASE WHEN cut_ THEN left_ END FROM placed JOIN taken USING (source, block) WHERE rest > 0),
keyed AS (SELECT *, md5('{seed}|doc|' || epoch || '|' || name) AS k FROM both_),
ranked AS (SELECT *, row_number() OVER w AS position, sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM keyed WINDOW w AS (PARTITION BY source, epoch, block ORDER BY k, doc_id, n_tokens)),
kept AS (SELECT * FROM ranked WHERE left_ IS NULL OR run <= left_),
ranks AS (SELECT source, epoch, block, row_number() OVER (PARTITION BY source, epoch ORDER BY md5('{seed}|order|' || epoch || '|' || source || '|' || block), block) AS block_rank FROM (SELECT DISTINCT source, epoch, block FROM kept))
SELECT doc_id, source, n_tokens, (SELECT a FROM chosen) AS alpha, weight, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(block_rank AS BIGINT) AS block_rank, CAST(position AS BIGINT) AS position FROM kept JOIN ranks USING (source, epoch, block)"""
