"""Mixing sources to target weights by hash-random order and exact word budgets.

Every row gets a hash-random key from its id. The key's first hex digits cut each source's key range into buckets,
and those into finer ones; sums of the words in each and running sums over the few buckets of a level tell in which
the source's budget ends. Only rows of that one finest bucket are dealt by ranges of the key and sorted, and a
distributed prefix sum over them finds the exact cut; no other row is shuffled.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import dropped, n_words, ranked, running_sums, saved, unused

#: Hex digits of the key that name a bucket at each level: 256 buckets, each of 256 more.
LEVELS = (2, 4)


def random_key(id_col: Column, text: Column, seed: int) -> Column:
    """Of the id; rows without one are told apart by their text, so they don't all share a bucket."""
    no_id = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), no_id)).cast("binary"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, size -> with weight and target.

    Weights repeat in the sources' order (code points, null last). Targets share the total by weight; none is
    above ``cap`` times its source's size, and what is cut off goes to the others by weight. All equal ``level *
    weight`` or the cap, so a few passes over the small table find ``level``.
    """
    n = len(weights)
    # binary order of UTF-8 is code-point order
    t = saved(ranked(sources, [F.col("source").cast("binary").asc_nulls_last()], "place").withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (F.col("place") % n + 1).cast("int"))), "sources")
    limit = F.col("size") * F.lit(float(cap))
    total, whole = t.agg(F.sum("size"), F.sum("weight")).first()
    level = total / whole if whole else 0.0
    while whole:
        full = limit < F.col("weight") * F.lit(level)
        capped, rest = t.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest or (total - capped) / rest <= level:
            break
        level = (total - capped) / rest
    return t.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level)))).select("source", F.col("size").alias("source_size"), "weight", "target")


def _dealt(spark: SparkSession, docs: DataFrame, keep: list[str], weights: tuple[float, ...], cap: float, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """kept (the columns ``keep`` as a struct, so that no name clashes), size, source_size, target, taken."""
    hashed = F.xxhash64(*[docs[c] for c in keep if "map<" not in docs.schema[c].dataType.simpleString()], F.lit(0))
    base = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("kept"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), random_key(docs[id_col], docs[text_col], seed).alias("key"),
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("tie"), hashed.alias("hashed"),
    ).withColumn("bucket", F.substring("key", 1, LEVELS[-1]))
    sums = saved(base.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("size")), weights, cap)
    budget = F.round("target").cast("long")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"), F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    made = [sums]
    for digits in LEVELS:  # the bucket of this level in which the budget ends, and the words before it
        inside = sums.join(plan, F.col("source").eqNullSafe(F.col("of")) & F.col("bucket").startswith(F.col("cut")))
        inside = inside.groupBy("source", F.substring("bucket", 1, digits).alias("part"), "rest", "before").agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.withColumn("end", F.col("before") + F.sum("size").over(run)).where((F.col("end") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        found = inside.groupBy(F.col("source").alias("at")).agg(F.max(F.struct("part", (F.col("end") - F.col("size")).alias("start"))).alias("f"))
        joined = plan.join(found, F.col("of").eqNullSafe(F.col("at")), "left")
        # a budget that whole epochs meet, or a source without words, ends in no bucket
        plan = saved(joined.select("of", "source_size", "target", "epochs", "rest", F.col("f.part").alias("cut"), F.col("f.start").alias("before")), "mix-plan")
        made.append(plan)
    dropped(*made[:-1])
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_cut = F.col("bucket").eqNullSafe(F.col("cut"))
    columns = ["kept", "size", "source_size", "target"]
    whole = F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)
    others = rows.where(~at_cut).select(*columns, (F.col("epochs") * F.col("size") + whole).alias("taken"))
    cut = running_sums(rows.where(at_cut).select(*columns, "source", "key", "tie", "hashed", "epochs", "rest", "before"), "source", ["key", "tie", "size", "hashed"], "size", "upto")
    part = F.least(F.greatest(F.col("rest") - F.col("before") - F.col("upto") + F.col("size"), F.lit(0)), F.col("size"))
    return others.unionAll(cut.select(*columns, (F.col("epochs") * F.col("size") + part).alias("taken")))


def mixed(
    spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Every row with _size, _source_size, _target and _taken (words the mix takes of it, epochs counted).

    ``keep`` names further columns to carry (default: the id); where one has such a name, the figure's gets one more
    underscore at its end. A source's budget is its target, rounded; whole epochs take every row, the last one rows in
    key order until the budget is met, the row at the cut in part. So a source's taken words add up to its budget,
    and no row gives more than ``cap`` times its words (rounded up to whole epochs). Null and empty texts count 0
    words, texts count whole however long, null sources form a source of their own, rows without an id have a key by
    their text. Repeated rows count each time; rows alike in every kept column are interchangeable. An empty table
    gives no row. Rerunning gives the same rows.
    """
    keep = [id_col] if keep is None else keep
    out = _dealt(spark, docs, keep, weights, cap, seed, id_col, source_col, text_col)
    names = {n: unused(f"_{n}", docs.select(*keep)) for n in ("size", "source_size", "target", "taken")}
    return out.select("kept.*", *[F.col(n).alias(a) for n, a in names.items()])


def mix_documents(
    spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each epoch that takes the document.

    A last, partial epoch holds the document's first words, as many as were taken; ``n_chars``, if there is one,
    then counts that text. Nulls, ties, repeated rows, long texts and empty tables as for :func:`mixed`; columns may
    have any name. Rows without words are in no epoch.
    """
    out = _dealt(spark, docs, docs.columns, weights, cap, seed, id_col, source_col, text_col)
    size, taken, text = F.col("size"), F.col("taken"), F.col("kept")[text_col]
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    out = out.where(taken > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    left = taken - (F.col("epoch") - 1) * size
    # only the one row at a source's cut is shortened
    out = out.withColumn("whole", left >= size).withColumn("cut_text", F.when(F.col("whole"), text).otherwise(shortened(text, left)))
    columns = {c: F.col("kept")[c] for c in docs.columns} | {text_col: F.col("cut_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("whole"), F.col("kept")["n_chars"]).otherwise(F.length("cut_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])


def shortened(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text`` with the white space between them."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(words, 1, n.cast("int")), "")
