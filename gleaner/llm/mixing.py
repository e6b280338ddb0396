"""Mixing sources to target token weights by entropy balancing.

Among all document rates that meet the token constraints (each source's tokens
times their rates equal its target) the operator takes the one closest, in relative
entropy weighted by tokens, to the base rates. The convex dual has one multiplier
per source and its optimum tilts the base rates exponentially:
``rate = min(max_copies, prior * exp(multiplier))``. Newton steps on the dual are
distributed aggregates over the (source, prior) cells, a table far smaller than the
documents; only the largest residual comes back to the driver.

Rates are then rounded into whole copies. Every document gets the whole part of its
rate; the fractions become extra copies, dealt per cell from the longest documents
to the shortest in classes of nearly equal size. What a class over- or undershoots
is carried on to the next, so a source ends within about one short document of its
target. Within a class the documents are chosen by the hash of their id, in stripes,
so no task ever holds a whole source.

Cases: a null or blank text has size 0 and is never repeated beyond its rate (it takes
0 words either way); a null source is a source of its own and sorts last; a source
without words has target 0; no words at all give targets of 0; an empty table gives
an empty result; repeated rows are separate rows (of equal rows any may be chosen);
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import WORD_PATTERN, cut, file_row, row_key, table
from gleaner.operators.ranking import row_number_within

STRIPES = 256
MAX_STEPS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: list[int], share: float, max_copies: float) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Weights repeat over the sources by code point (null last). Targets share
    ``share`` x all sizes by weight, capped at ``max_copies`` x a source's size; the
    excess of capped sources goes to the others by weight until none is above. The
    rounds move two sums each; a round caps at least one more source or is the last.
    """
    order = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*[F.lit(w) for w in weights])
    numbered = row_number_within(sources, [], order, "_i").withColumn(
        "weight", F.element_at(cycle, ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    )
    numbered = cut(numbered.select("source", "source_size", "weight"))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_copies))
    level, capped = 0.0, -1
    while True:
        full = (cap <= F.col("weight") * F.lit(level)) if capped >= 0 else F.lit(False)
        n, used, open_weight = numbered.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (share * total - used) / open_weight
    return numbered.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def balanced_rates(cells: DataFrame, targets: DataFrame, max_copies: float, tolerance: float = 1e-10) -> DataFrame:
    """Newton's method on the dual: (source, prior, words) and (source, target) -> rate per cell.

    A step solves each source's equation linearised at its multiplier; steps are held
    to +-2 and kept inside the bracket that the residual signs have shown so far.
    """
    joined = cut(cells.join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    lam = joined.groupBy("source").agg(
        F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(0.0).alias("_worst")
    )
    rate = F.least(F.lit(float(max_copies)), F.col("prior") * F.exp(F.col("lam")))
    for _ in range(MAX_STEPS):
        at = joined.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        sums = at.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("lam", "low", "high", "target")],
            F.sum(F.col("words") * rate).alias("mass"),
            F.sum(F.when(F.col("prior") * F.exp(F.col("lam")) < max_copies, F.col("words") * rate).otherwise(0.0)).alias("slope"),
        )
        residual = F.col("mass") - F.col("target")
        worst = F.when(F.col("target") > 0, F.abs(residual) / F.col("target")).otherwise(F.lit(0.0))
        low = F.when(residual < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(residual > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.try_divide(residual, F.col("slope"))))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        step = F.when(worst <= tolerance, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        lam = cut(sums.select("source", step.alias("lam"), low.alias("low"), high.alias("high"), worst.alias("_worst")))
        if (lam.agg(F.max("_worst")).first()[0] or 0.0) <= tolerance:
            break
    at = joined.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return at.select("source", "prior", F.when(F.col("target") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def size_class(size: str) -> Column:
    """Classes that grow with the size: exact below 32, then 16 to each doubling (at most 1,008)."""
    over = f"greatest(length(bin({size})) - 5, 0)"
    return F.expr(f"{over} * 16 + shiftright({size}, cast({over} as int))").cast("int")


def mix_documents(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    max_copies: int = 2,
    prior: Column | None = None,
    key: Column | None = None,
) -> DataFrame:
    """Rows (_row, doc_id, size, source_size, target, copies, taken) of the mix.

    ``prior`` is an optional base rate per document with few distinct values (say, a
    quality grade); by default every document starts from 1. ``key`` is what ``_row``
    holds; to join back to ``docs`` it must be the same in every scan (``file_row``).
    """
    base = (prior if prior is not None else F.lit(1.0)).cast("double")
    sized = docs.select((row_key() if key is None else key).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(1e-9)).alias("prior"))
    kind = size_class("size").alias("class")
    stripe = F.pmod(F.xxhash64("doc_id"), F.lit(STRIPES)).cast("int").alias("stripe")
    sized = cut(sized.select("*", kind, stripe))

    cells = cut(sized.groupBy("source", "prior", "class", "stripe").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    targets = cut(capped_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_copies))
    rates = cut(balanced_rates(cells.groupBy("source", "prior").agg(F.sum("words").alias("words")), targets, float(max_copies)))

    # extra copies of each class: whole documents nearest to what the cell still owes
    classes = cells.groupBy("source", "prior", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    listed = classes.groupBy("source", "prior").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("class", "n", "words")))).alias("classes")
    )
    listed = listed.alias("c").join(rates.alias("r"), F.expr("c.source <=> r.source and c.prior = r.prior")).select("c.source", "c.prior", "classes", "rate")
    listed = listed.withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("whole"))
    dealt = F.expr(
        """aggregate(classes,
             named_struct('owed', 0.0D, 'out', cast(array() as array<struct<class:int,n:bigint,extra:bigint>>)),
             (acc, x) -> named_struct(
               'owed', acc.owed + part * x.words - if(x.words = 0, 0.0D,
                  least(x.n, greatest(0, cast(round((acc.owed + part * x.words) * x.n / x.words) as bigint))) * (x.words / x.n)),
               'out', array_append(acc.out, named_struct('class', x.class, 'n', x.n, 'extra',
                  if(x.words = 0, 0L, least(x.n, greatest(0L, cast(round((acc.owed + part * x.words) * x.n / x.words) as bigint))))))))"""
    )
    quotas = listed.select("source", "prior", "whole", F.inline(dealt["out"]))
    # the class quota, dealt to its stripes by running share
    seen = F.sum("n").over(Window.partitionBy("source", "prior", "class").orderBy("stripe"))
    striped = cells.withColumn("_upto", seen).alias("c").join(
        quotas.alias("q"), F.expr("c.source <=> q.source and c.prior = q.prior and c.class = q.class")
    )
    share_of = lambda upto: F.expr(f"cast(floor(cast(q.extra as decimal(20,0)) * ({upto}) / q.n) as bigint)")
    striped = striped.select(
        "c.source", "c.prior", "c.class", "c.stripe", "q.whole", (share_of("c._upto") - share_of("c._upto - c.n")).alias("extra")
    ).join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    group = ["source", "prior", "class", "stripe"]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit("copy"), "doc_id"), "doc_id", "size", "_row"))
    picked = sized.withColumn("_nth", nth).alias("d").join(
        striped.alias("s"), F.expr(" and ".join(f"d.{g} <=> s.{g}" for g in group))
    )
    copies = (F.col("s.whole") + (F.col("d._nth") <= F.col("s.extra")).cast("int")).cast("int")
    return picked.select("d._row", "d.doc_id", "d.size", "s.source_size", "s.target", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def mix_stage(docs: DataFrame, weights: list[int], share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """The mixed documents themselves: each row as often as its copies, with its own columns."""
    mixed = mix_documents(docs, weights, share, max_copies, key=file_row()).where("copies > 0").select(F.col("_row").alias("_mixed_row"), F.col("copies").alias("_mixed_copies"))
    keyed = docs.withColumn("_doc_row", file_row())
    out = keyed.join(mixed.hint("shuffle_hash"), F.col("_doc_row") == F.col("_mixed_row"))
    return out.withColumn("_copy", F.explode(F.expr("sequence(1, _mixed_copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])


WEIGHTS = [5, 2, 1]


def q_mix(spark, sf_dir):
    mixed = mix_documents(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")
