"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words.  Whole rounds of the source come first; the rest of the
budget is fitted on counts of documents by exact length: an even share of every length, then
a bounded knapsack over what is left; where that misses the budget, and a nearer sum is not
ruled out, documents around the fit are exchanged for the nearest sum on either side.  Which documents of a length are taken is a matter of a
seeded hash, numbered without ever holding a source or a length in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.llm.common import WORD, ranked, settle, whole_text

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
#: Longest documents whose words bound what is exchanged for a nearer sum.
WINDOW = 64


def fill(lengths: list[int], available: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, for a sum as near below ``budget`` as can be.

    A bounded knapsack over sums up to ``budget`` as bits of one integer; the bits after each
    step are kept to walk back from the best sum.
    """
    steps, reach, mask = [], 1, (1 << (budget + 1)) - 1
    for k, (length, n) in enumerate(zip(lengths, available, strict=True)):
        n, part = min(n, budget // length) if length else 0, 1
        while n > 0 and not reach >> budget & 1:
            part = min(part, n)
            steps.append((reach, k, part))
            reach |= (reach << (part * length)) & mask
            n, part = n - part, 2 * part
    at, taken = reach.bit_length() - 1, [0] * len(lengths)
    for before, k, part in reversed(steps):
        if not before >> at & 1:
            taken[k] += part
            at -= part * lengths[k]
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, times: int = 1) -> list[int]:
    """How many documents of each length make up ``budget`` words of a source with more.

    An even share of every length first; where few documents leave that far from the budget,
    the longest first; where that is far from it too, documents up to ``times`` times."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    budget = min(budget, total)
    if budget <= 0:
        return [0] * len(lengths)
    longest_first = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    # What the knapsack fits: longest documents leave less than this where there are enough.
    window = 2 * max(lengths)

    def completed(taken: list[int]) -> tuple[int, list[int]]:
        left, moved = budget - sum(a * b for a, b in zip(lengths, taken, strict=True)), True
        while moved and left > window:
            moved = False
            for k in longest_first:
                if left > window and taken[k] < counts[k] and 0 < lengths[k] <= left:
                    taken[k], left, moved = taken[k] + 1, left - lengths[k], True
        rest = fill(lengths, [b - a for a, b in zip(taken, counts, strict=True)], min(left, window))
        taken = [a + b for a, b in zip(taken, rest, strict=True)]
        return left - sum(a * b for a, b in zip(lengths, rest, strict=True)), taken

    none = [0] * len(lengths)
    left, taken = completed([n * budget // total for n in counts] if budget > window else none)
    if left > budget // 1000:
        left, taken = min((left, taken), completed(none[:]))
    if left > budget // 1000 and times > 1:
        counts = [n * times for n in counts]
        left, taken = min((left, taken), completed(none[:]))
    return taken


def nearest(lengths: list[int], available: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, for a sum as near to ``budget`` as can be.

    The least sum above the budget is less than the longest document above it.  For each sum
    the step that first reached it is kept, in four bytes, whatever the number of steps."""
    unit = math.gcd(*lengths) or 1
    budget, rest = divmod(budget, unit)
    lengths = [length // unit for length in lengths]
    top = budget + max(lengths) + 1
    reach, mask, steps = 1, (1 << (top + 1)) - 1, []
    since = np.zeros(top + 1, dtype=np.int32)
    for k, (length, n) in enumerate(zip(lengths, available, strict=True)):
        n, part = min(n, top // length) if length else 0, 1
        while n > 0 and (rest or not reach >> budget & 1):
            part = min(part, n)
            new = (reach << (part * length)) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8)
                since[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: top + 1])] = len(steps)
                steps.append((k, part))
                reach |= new
            n, part = n - part, 2 * part
    at = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    if above:
        least = budget + (above & -above).bit_length()
        if least * unit - (budget * unit + rest) < budget * unit + rest - at * unit:
            at = least
    taken = [0] * len(lengths)
    while at:
        k, part = steps[since[at]]
        taken[k] += part
        at -= part * lengths[k]
    return taken


def least_off(lengths: list[int], available: list[int], budget: int) -> int:
    """No sum of the documents can be nearer to the budget: by the greatest common divisor of
    their lengths, and by all of them together."""
    used = [length for length, n in zip(lengths, available, strict=True) if length and n]
    unit = math.gcd(*used) if used else 1
    total = sum(a * b for a, b in zip(lengths, available, strict=True))
    return max(budget - total, min(budget % unit, -budget % unit))


def exchanged(lengths: list[int], available: list[int], budget: int) -> list[int]:
    """A sum near to the budget, from documents around a quick fit.

    Some documents of every length are set aside, the others are fitted to the budget less half
    of what these hold, and the rest of the budget is made up of these as exactly as they can.
    Where a nearer sum is not ruled out, more are set aside, up to the words of ``WINDOW``
    longest documents; a source that holds no more than that is fitted as nearly as can be."""
    bound, held = least_off(lengths, available, budget), 8 * max(lengths)
    total = sum(a * b for a, b in zip(lengths, available, strict=True))
    while True:
        share = held // max(1, len(lengths))
        aside = [min(n, -(-share // length)) if length else 0 for length, n in zip(lengths, available, strict=True)]
        rest = [n - some for n, some in zip(available, aside, strict=True)]
        half = sum(a * b for a, b in zip(lengths, aside, strict=True)) // 2
        taken = fit_budget(lengths, rest, max(0, budget - half))
        left = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
        more = nearest(lengths, aside, left) if left > 0 else [0] * len(lengths)
        taken = [a + b for a, b in zip(taken, more, strict=True)]
        if abs(budget - sum(a * b for a, b in zip(lengths, taken, strict=True))) == bound or held >= min(total, WINDOW * max(lengths)):
            return taken
        held *= 8


def fit_nearest(lengths: list[int], counts: list[int], budget: int, times: int = 1) -> list[int]:
    """As ``fit_budget``, but where that leaves words, the nearest sum below or above: of
    documents taken once, or if it is far from the budget, up to ``times`` times."""
    if budget <= 0 or not any(lengths):
        return [0] * len(lengths)

    def off(taken: list[int]) -> int:
        return abs(budget - sum(a * b for a, b in zip(lengths, taken, strict=True)))

    best = [0] * len(lengths)
    for most in sorted({1, times}):
        available = [n * most for n in counts]
        taken = fit_budget(lengths, available, budget)
        if off(taken) > least_off(lengths, available, budget):
            taken = exchanged(lengths, available, budget)
        best = min(best, taken, key=off)
        if off(best) <= budget // 1000:
            break
    return best


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_no, source_size, target`` of every source.

    Sources are numbered in code point order, null last: in sorted ranges, each of which
    starts where the ranges before it end.  Sources whose share exceeds ``most`` times their
    size stop there, and the excess goes to the others by weight, until none is above; only
    the sums of a round reach the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.repartitionByRange(F.col("source").asc_nulls_last())
    ordered = settle(ordered.withColumn("_part", F.spark_partition_id()), "mix-sources")
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.withColumn("_place", F.row_number().over(within) - 1).join(F.broadcast(starts), "_part")
    number = (F.col("_start") + F.col("_place")).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    known = settle(numbered.select("source", "source_size", number.alias("source_no"), weight.alias("weight")), "mix-weights")

    total = known.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        n, held, weights_left = known.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not weights_left:
            break
        capped, level = n, (total - (held or 0)) / weights_left
    target = F.least(cap.cast("double"), F.col("weight") * level) if weights_left else cap.cast("double")
    return known.select("source", "source_no", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, carried: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source, copies``.

    ``size`` is the number of words, 0 for a null text; ``copies`` is how often the mix takes
    the document, at most 3, and ``taken = size * copies``.  A null source is a source.
    Documents without words are never taken.  Rows with equal id are taken by the same rule;
    a rerun takes the same.  An empty table gives an empty result; columns other than
    ``doc_id, text, source`` are not looked at; those ``carried`` come first in the result.
    """
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(whole_text()))
    sizes = settle(docs.select(*carried, "doc_id", "source", size.alias("size"), order.alias("_order")), "mix-sizes")
    targets = settle(source_targets(sizes, weights), "mix-targets")
    goal = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.select(
        F.col("source").alias("_source"),
        "source_no",
        "source_size",
        "target",
        rounds.alias("_rounds"),
        (goal - rounds * F.col("source_size")).alias("_budget"),
    )
    known = sizes.join(budgets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    counts = known.groupBy("source_no", "size", "_budget", "_rounds").agg(F.count(F.lit(1)).alias("n"))

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        # Counts of one source by exact length: 10^12 words have at most 1.4 million lengths.
        part = part.sort_values("size")
        budget, rounds = int(part["_budget"].iloc[0]), int(part["_rounds"].iloc[0])
        taken = fit_nearest(part["size"].tolist(), part["n"].tolist(), budget, max(1, MOST - rounds))
        return pd.DataFrame({"source_no": part["source_no"], "size": part["size"], "_of": part["n"], "_take": taken})

    takes = counts.groupBy("source_no").applyInPandas(fitted, "source_no long, size long, _of long, _take long")
    total = sizes.count()
    placed = ranked(known, ["source_no", "size"], ["_order", "doc_id"], total, "_place")
    extra = F.floor(F.col("_take") / F.col("_of")) + (F.col("_place") < F.col("_take") % F.col("_of")).cast("long")
    copies = F.when(F.col("size") > 0, F.col("_rounds") + extra).otherwise(0).cast("long")
    mixed = placed.join(takes, ["source_no", "size"]).withColumn("copies", copies)
    return mixed.select(
        *carried, "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )
