"""Importance resampling towards a target's distribution of hashed word runs.

DuckDB counts inside the tasks: SQL takes the words of a block of texts, makes runs of consecutive words by window
functions, and a registered checksum puts each distinct run into a bucket. Each document's bucket counts are spilled to
Parquet; Spark merges them to the corpus's counts, does the same for the target, and scores every document by the gains
of its buckets. Gumbel noise from a hash of the id turns the highest scores into a sample drawn by weight.
"""

import re
from collections.abc import Iterator, Sequence
from itertools import islice
from math import floor, log
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import dropped, ranked, saved, unused

#: What a word is, after A-Z are lower-cased, and what never belongs to one.
RUN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD, BOUNDARY = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of text that one SQL statement counts; a longer text is cut between words and counted in parts.
BLOCK_CHARS = 4 << 20
#: Gumbel noise comes from so many values of a hash.
HASHED = 1 << 32


def counting_sql(longest: int, buckets: int) -> str:
    """p, own (words), bucket numbers and counts for each row (p, head, tail) of the view ``texts``.

    Runs start in head, and may end in tail, which holds the words that follow it in the same text.
    """
    words = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{RUN_WORD}')"
    nexts = "".join(f", lead(w, {j}) OVER (PARTITION BY p ORDER BY i) AS w{j}" for j in range(1, longest))
    run = lambda n: " || ' ' || ".join(["w", *(f"w{j}" for j in range(1, n))])
    runs = " UNION ALL ".join(f"SELECT p, {run(n)} AS g FROM follow WHERE i <= own" + (f" AND w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, longest + 1))
    return f"""
WITH cut AS (SELECT p, {words.format("head")} AS h, {words.format("tail")} AS t FROM texts),
word AS (SELECT p, len(h) AS own, unnest(h || t) AS w, generate_subscripts(h || t, 1) AS i FROM cut),
follow AS (SELECT *{nexts} FROM word),
counted AS (SELECT p, g, count(*) AS n FROM ({runs}) GROUP BY p, g),
placed AS (SELECT g, (checksum(encode(g)) % {buckets})::INTEGER AS b FROM (SELECT DISTINCT g FROM counted)),
summed AS (SELECT p, b, sum(n)::BIGINT AS n FROM counted JOIN placed USING (g) GROUP BY p, b),
listed AS (SELECT p, list(b ORDER BY b) AS buckets, list(n ORDER BY b) AS counts FROM summed GROUP BY p)
SELECT p, len(h) AS own, buckets, counts FROM cut LEFT JOIN listed USING (p) ORDER BY p
"""


def text_parts(text: str, longest: int, size: int) -> Iterator[tuple[str, str]]:
    """The text in parts of about ``size`` characters, cut between words, each with the words that a run may end in."""
    start = 0
    while start < len(text) or not start:
        cut = BOUNDARY.search(text, start + size) if start + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end], " ".join(m[0] for m in islice(ANY_CASE_WORD.finditer(text, end), longest - 1))
        start = max(end, 1)


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int, keep: dict[str, str] | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """n_words, n_features, buckets, counts of every row, beside the columns of ``keep`` (name there, name here)."""
    keep = keep or {}
    rows = docs.select(docs[text_col].alias("_text"), *[docs[c].alias(name) for c, name in keep.items()])
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    sql = counting_sql(longest, buckets)
    kept_types = [to_arrow_type(kinds[c]) for c in keep.values()]
    names = [*keep.values(), "n_words", "n_features", "buckets", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}) as con:
            con.create_function("checksum", lambda runs: pa.array([crc32(x) for x in runs.to_pylist()], pa.uint32()), ["BLOB"], "UINTEGER", type="arrow")

            def settle(parts: list[tuple[int, str, str]], out: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
                """Adds each part's words, buckets and counts to its row's."""
                con.register("texts", pa.table({"p": pa.array(range(len(parts)), pa.int64()), "head": pa.array([x[1] for x in parts], pa.large_string()), "tail": pa.array([x[2] for x in parts], pa.large_string())}))
                found = con.execute(sql).to_arrow_table().combine_chunks()
                con.unregister("texts")
                for (r, *_), own, *pair in zip(parts, found["own"].to_pylist(), found["buckets"], found["counts"]):
                    b, n = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64) for x in pair)
                    if r in out:  # a long text's next part
                        sums = np.zeros(buckets, np.int64)
                        sums[out[r][1]] = out[r][2]
                        sums[b] += n
                        own, b, n = out[r][0] + own, np.flatnonzero(sums), sums[sums > 0]
                    out[r] = (own, b, n)
                parts.clear()

            for big in batches:
                for at in range(0, big.num_rows, 2000):
                    x = big.slice(at, 2000)
                    parts, held, out = [], 0, {}
                    for r, text in enumerate(x["_text"]):
                        for head, tail in text_parts(text.as_py() or "", longest, block):
                            parts.append((r, head, tail))
                            held += len(head)
                            if held >= block:
                                settle(parts, out)
                                held = 0
                    if parts:
                        settle(parts, out)
                    found = [out[r] for r in range(x.num_rows)]
                    cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[2].sum()) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*(x[c].cast(t) for c, t in zip(keep.values(), kept_types)), *cols], names=names)

    kept = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in keep.values())
    return rows.mapInArrow(count, f"{kept}n_words long, n_features long, buckets array<int>, counts array<long>")


def merged_counts(counts: DataFrame) -> dict[int, int]:
    """The corpus's number of runs in each bucket that has any: as many entries as there are buckets, at most."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).groupBy(F.col("e.buckets").alias("b")).agg(F.sum("e.counts").alias("n"))
    return {r["b"]: r["n"] for r in pairs.toLocalIterator()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """For each bucket, a thousand times the logarithm of how much commoner it is in the target, smoothed by one."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [floor(1000 * log(((target.get(b, 0) + 1.0) * s_all) / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def noise(id_: Column, seed: str) -> Column:
    """A thousand times Gumbel noise, rounded down, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(HASHED)))))


def resampled(
    spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", carry: Sequence[str] = (), block: int = BLOCK_CHARS,
) -> DataFrame:
    """id, n_features, weight, score, rank for every row of ``docs``; rank is null for those that aren't drawn.

    Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, highest scores first, ties to
    the smaller id (null last), then to fewer features, then in any order. Null and empty texts have no feature, weight 0,
    and are not drawn; a null id is hashed as an empty string. Repeated rows count each for itself, in the counts as in the
    draw. Long texts are counted whole, in parts of ``block`` characters. With an empty target all buckets there count one;
    an empty table gives no row. Columns named in ``carry`` (the text, say) come along in a struct named ``row``; others,
    whatever their names, are not read.
    """
    names = {c: f"_{i}" for i, c in enumerate(dict.fromkeys((id_col, *carry)))}
    counts = saved(bucket_counts(docs, text_col, longest, buckets, names, block).withColumn("_row", F.monotonically_increasing_id()), "buckets")
    aims = saved(bucket_counts(target, target_col, longest, buckets, block=block), "target-buckets")
    table = F.split(F.lit(" ".join(map(str, gains(merged_counts(counts), merged_counts(aims), buckets)))), " ").cast("array<bigint>")  # folded to a constant
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n * table[b]), F.lit(0).cast("long"), lambda total, v: total + v)
    scored = counts.select(*names.values(), "n_words", "n_features", "_row", weight.alias("_weight")).withColumn("_score", F.col("_weight") + noise(F.col("_0"), seed))
    eligible, n = scored.where(F.col("n_words") >= least_words), counts.where(F.col("n_words") >= least_words).count()
    place = ranked(eligible, [F.col("_score").desc(), F.col("_0").asc_nulls_last(), F.col("n_features"), F.col("_row")], "_rank")
    all_ = place.withColumn("_rank", F.when(F.col("_rank") < percent * n // 100, F.col("_rank") + 1)).unionByName(scored.where(F.col("n_words") < least_words).withColumn("_rank", F.lit(None).cast("long")))
    row = [F.struct(*[F.col(names[c]).alias(c) for c in carry]).alias(unused("row", docs.select(id_col)))] if carry else []
    dropped(aims)
    return all_.select(F.col("_0").alias(id_col), "n_features", F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"), *row)
