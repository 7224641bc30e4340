"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent, normalised: 1 keeps the shares, 0 makes all sources equal, more than
1 sharpens them. The exponent is found by bisection: so that the weights' entropy is a target share of the greatest one possible, whether the natural
entropy is below or above it; or the least one with which no source is repeated more often than a limit; if both are asked for, the
exponent for the entropy is moved into the range that the limit allows. Targets that no exponent meets are an error.
A source's budget is its weight times all tokens that are asked for.
It is realised in epochs: each whole epoch has all documents of the source once; the last, partial one has the first documents of
a permutation of its blocks and of the documents in each, both ordered by MD5, as far as the budget reaches.

Nothing is limited by the number of sources: the sums that the bisection needs are aggregates over the table of sources, for many exponents at
once. Blocks (``BLOCKS`` of a source, by hash) bound the rest: tokens are summed by source and block, and only (id, tokens) rows of the
one block where a budget ends are put in order, to find the last document that is still within it. A row per source, with that
document's place, then decides for all documents where they are read.

Defined cases: a null source is a source of its own, a null text is empty; documents without words have no tokens, and come as often as
the source's whole epochs, once more if their place is within the last one; without any tokens nothing is repeated or dropped; rows that repeat an id and
text share a place, and are within a budget together or not at all; an empty table gives an empty result; columns other than the id, source and text are
carried in a struct, not read, and can have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, inf, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import col, discard, row_of, staged, text_of, words

BLOCKS = 4096
#: Exponents that one pass over the sources tries.
GRID = 32
#: Rows, of a source each, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Exponents beyond this are not tried.
STEEPEST = 4096.0


class Unmeetable(ValueError):
    """No exponent meets what is asked for."""


def least_that(holds: Callable[[list[float]], list[bool]], low: float, high: float, within: float = 1e-13) -> float:
    """The least exponent from low to high that holds, where what holds for one holds for all greater ones, and for high. Each step tries
    ``GRID`` exponents at once and leaves one interval between them."""
    if holds([low])[0]:
        return low
    while high - low > within * max(1.0, abs(high)):
        tried = [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
        found = holds(tried)
        at = found.index(True) if True in found else GRID
        low, high = (tried[at - 1] if at else low), (tried[at] if at < GRID else high)
    return high


class Sources:
    """Sums over the sources' shares. ``tokens``: a table with a row per source and its tokens, of which those without any take no part."""

    def __init__(self, tokens: DataFrame):
        some = tokens.filter("tokens > 0")
        self.total, self.n, least, most = some.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
        self.logs = some.select(F.log(F.col("tokens") / F.lit(float(self.total or 1))).alias("x"))
        if self.n:
            self.least, self.most = log(least / self.total), log(most / self.total)

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent, the logarithm of the sum of the raised shares, and the weights' entropy. Shares are taken relative to the largest, so that
        no power overflows or vanishes."""
        x = F.col("x") - F.lit(self.most)
        raised = [F.exp(x * F.lit(float(e))) for e in exponents]
        row = self.logs.agg(*(F.sum(r).alias(f"r{k}") for k, r in enumerate(raised)), *(F.sum(r * x).alias(f"x{k}") for k, r in enumerate(raised))).first()
        found = []
        for k, e in enumerate(exponents):
            z, s = row[f"r{k}"], row[f"x{k}"]
            found.append((log(z) + e * self.most, log(z) - e * s / z))
        return found

    def entropy_at(self, share: float) -> float:
        """The exponent with which the weights' entropy is this share of the logarithm of the number of sources."""
        target = share * log(self.n)
        holds = lambda es: [h <= target + 1e-12 for _, h in self.sums(es)]  # noqa: E731  more exponent, less entropy
        high = 1.0
        while not holds([high])[0]:
            if high >= STEEPEST:
                raise Unmeetable(f"no exponent gives {share} of the greatest entropy: too many sources are as large as the largest")
            high *= 2
        return least_that(holds, 0.0 if high == 1.0 else high / 2, high)

    def most_repeated(self, exponents: list[float], budget: float | None) -> list[float]:
        """The logarithm of how often the most repeated source is, for a budget of tokens, or for the least budget with which each source comes whole once."""
        found = []
        for e, (z, _) in zip(exponents, self.sums(exponents), strict=True):
            # times of a source: its weight, by the budget, by its tokens; the most is that of the least or of the largest source
            times = [(e - 1) * x - z for x in (self.least, self.most)]
            found.append(max(times) + log(budget / self.total) if budget is not None else max(times) - min(times))
        return found

    def limits(self, budget: float | None, repeats: float) -> tuple[float, float]:
        """The least and the greatest exponent with which no source is repeated more often than the limit. At 1 all are repeated alike; the
        further from it, the more the smallest sources are, or the largest."""
        within = lambda es: [x <= log(repeats) + 1e-12 for x in self.most_repeated(es, budget)]
        if not within([1.0])[0]:
            raise Unmeetable(f"a budget of {budget / self.total if budget else 1} times all tokens repeats them more than {repeats} times")
        if within([STEEPEST])[0]:
            return least_that(within, 0.0, 1.0), inf
        outside = lambda es: [not x for x in within(es)]
        return least_that(within, 0.0, 1.0), least_that(outside, 1.0, STEEPEST) * (1 - 1e-12)

    def exponent(self, budget: float | None, entropy_share: float | None, repeats: float | None) -> float:
        if not self.n or self.n == 1 or entropy_share is None and repeats is None:
            if self.n == 1 and repeats is not None:
                self.limits(budget, repeats)
            return 1.0
        found = None if entropy_share is None else self.entropy_at(entropy_share)
        if repeats is not None:
            low, high = self.limits(budget, repeats)
            found = low if found is None else min(max(found, low), high)
        return found


def _order(*columns: Column) -> Column:
    return F.md5(F.concat_ws("|", *columns).cast("binary"))


def _joined(rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their source. A row per source is broadcast only up to a checked number; more meet their rows in a
    shuffle, where the rows of a large source are spread by a salt."""
    same = F.col("source").eqNullSafe(F.col("asked_source"))
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(asked), same).drop("asked_source")
    salts = 64
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rank"), F.lit(salts)))
    asked = asked.withColumn("asked_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(asked.hint("merge"), same & (F.col("salt") == F.col("asked_salt"))).drop("asked_source", "salt", "asked_salt")


def plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget_share: float | None = 1.0, entropy_share: float | None = None, repeats: float | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(decisions, sources). decisions: one row per row of df: row (its columns), id, source, n_tokens, block, weight,
    copies. sources: source, tokens, weight, epochs, rest. budget_share: the tokens asked for, as a share of all; None: as many as keep every document at least once."""
    own = df.select(row_of(df).alias("row"), col(id_col).alias("id"), col(source_col).cast("string").alias("source"), text_of(text_col).alias("text"))
    own = own.withColumn("rank", _order(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    own = own.withColumn("block", F.pmod(F.conv(F.substring("rank", 1, 8), 16, 10).cast("long"), F.lit(blocks)))
    n_tokens = F.size(words(F.col("text"))).cast("long")
    sums = staged(own.groupBy("source", "block").agg(F.sum(n_tokens).alias("tokens")), "sums")
    tokens = staged(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    found = Sources(tokens)
    n_sources = tokens.count()
    budget = None if budget_share is None else budget_share * found.total
    exponent = found.exponent(budget, entropy_share, repeats)
    if not found.total:
        asked = tokens.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    else:
        z = found.sums([exponent])[0][0]
        log_share = F.log(F.col("tokens") / F.lit(float(found.total)))
        weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * log_share - F.lit(z))).otherwise(0.0)
        if budget is None:  # what leaves each source at least its own tokens
            budget = found.total * exp(-min((exponent - 1) * x - z for x in (found.least, found.most)))
        wanted = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
        asked = tokens.withColumn("weight", weight).withColumn("wanted", F.when(F.col("tokens") > 0, wanted).otherwise(F.col("tokens")))
        asked = asked.select("source", "tokens", "weight", F.when(F.col("tokens") > 0, F.expr("wanted DIV tokens")).otherwise(1).cast("long").alias("epochs"), F.when(F.col("tokens") > 0, F.expr("wanted % tokens")).otherwise(0).cast("long").alias("rest"))
    asked = staged(asked, "asked")
    # The block where a source's budget ends: those before it in the permutation are in, those after it are out.
    before = Window.partitionBy("source").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("place", _order(F.coalesce(F.col("source"), F.lit("")), F.col("block").cast("string")))
    placed = placed.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    key = asked.select(F.col("source").alias("asked_source"), "rest")
    ends = placed.join(key, F.col("source").eqNullSafe(F.col("asked_source"))).filter("before <= rest AND before + tokens > rest AND rest > 0")
    ends = ends.groupBy("asked_source").agg(F.min(F.struct("place", "block", "before")).alias("end"))
    ends = staged(ends.select(F.col("asked_source").alias("source"), "end.place", F.col("end.block").alias("block"), "end.before"), "ends")
    # Only (rank, tokens) rows of those blocks are put in order.
    tie = F.md5(F.col("text").cast("binary"))
    narrow = own.select("source", "rank", "block", tie.alias("tie"), n_tokens.alias("n_tokens"))
    cut = _joined(narrow, ends.select(F.col("source").alias("asked_source"), F.col("block").alias("end_block"), "before"), n_sources).filter("block = end_block")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("rank", "tie"))
    cut = cut.withColumn("upto", F.col("before") + upto)
    cut = cut.join(key, F.col("source").eqNullSafe(F.col("asked_source"))).filter("upto <= rest")
    cut = staged(cut.groupBy("source").agg(F.max(F.struct("rank", "tie")).alias("last")), "cuts")
    rules = asked.join(ends.select(F.col("source").alias("end_source"), "place", "block"), F.col("source").eqNullSafe(F.col("end_source")), "left")
    rules = rules.join(cut.select(F.col("source").alias("cut_source"), "last"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    rules = rules.select(F.col("source").alias("asked_source"), "weight", "epochs", F.struct("place", F.col("block")).alias("end"), "last")
    own_place = F.struct(_order(F.coalesce(F.col("source"), F.lit("")), F.col("block").cast("string")).alias("place"), "block")
    within = F.when(F.col("end.place").isNull(), False).when(own_place < F.col("end"), True).when(own_place > F.col("end"), False)
    within = within.otherwise(F.coalesce(F.struct("rank", tie.alias("tie")) <= F.col("last"), F.lit(False)))
    decided = _joined(own, rules, n_sources).select("row", "id", "source", n_tokens.alias("n_tokens"), "block", "weight", (F.col("epochs") + within.cast("long")).alias("copies"))
    discard(sums, tokens)
    return decided, asked


def mixed(df: DataFrame, **how) -> DataFrame:
    """The rows of df as often as they were decided on, with all their columns."""
    decided, _ = plan(df, **how)
    return decided.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
