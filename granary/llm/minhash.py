"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Equal sets are one representative from the start. Representatives that share a band meet in buckets. A bucket
never emits all its pairs: it is dealt into parts, each member is verified against the hub of its part and each hub
against one of them, then, in a few rounds, each member against the likeliest members of other groups; verified links
join groups. Only members of different groups that still share a bucket are then compared with each other. Links
within a group that is already whole add nothing to it and are not looked for.

Sizes and signatures are compared before texts are fetched. No join gathers a hot key: keys above a share of the rows
are few, so what is known of them goes to all tasks (:func:`met`), and the pairs of one hub are dealt into parts.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from granary.llm.common import dropped, met, partitions, process_cache, saved, sifted, unused, words

#: Bands and rows: pairs of similarity 0.8 are missed once in about ten million, at 0.5 seven in ten never meet.
BANDS, ROWS = 40, 5
#: Rounds with one hub a bucket, then rounds with each member's likeliest partner, before all that is left.
HUB_ROUNDS, BEST_ROUNDS = 1, 3
#: A round of likeliest partners that links fewer than one in so many open rows is the last such; all that is left comes next.
FEW = 20
#: In such a round, how many partners a row proposes in a bucket, and of how many bands one is looked at.
PARTNERS, BAND_STEP = 4, 5
#: Words whose hash a task remembers at a time; the cache is emptied when full.
CACHE = 400_000
#: Shingles whose permutations are drawn together.
ELEMENTS = 100_000
#: Rows of a hot bucket that one comparison takes on either side.
BUCKET_BLOCK = 2048
#: Least hashes of a set that a sketch keeps; a smaller set is kept whole.
SKETCH = 1024
#: Elements of a whole set that may share a 32-bit hash with another and so go uncounted.
SLACK = 2
#: Standard deviations by which the places where two signatures agree may fall short of the expected.
MARGIN = 4.5
#: Among so many parts the pairs of one row are dealt for verification; each part gets the row's text once.
PARTS = 64
#: Edges that one task joins at most; more are dealt over as many tasks as that takes, whose forests then meet by shuffles.
TASK_EDGES = 100_000
GOLD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles, A-Z lower-cased.

    Fewer words than that make one shingle of them all; no word, none.
    """
    w = [x.lower() for x in words(text)]
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = mixed64(out * np.uint64(GOLD) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of ``m`` values for each non-empty set, by the SuperMinHash construction.

    Each element draws a random permutation of the m places step by step; its step j puts j + u in a place. Steps
    are made for all elements at once, and a set is done when the largest of its values is below the next step:
    no later step could lower one. Large sets so end after a step or two.
    """
    lengths = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    best = np.full((len(sets), m), np.inf)
    swaps: list[np.ndarray] = []  # by step, the place that each active element swapped with
    for j in range(m):
        r = mixed64(element + np.uint64((j + 1) * GOLD % 2**64))
        u = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((mixed64(r) >> np.uint64(32)).astype(np.int64) * (m - j) >> 32)
        place = k.copy()
        for earlier in range(j - 1, -1, -1):  # what the earlier swaps put there
            place = np.where(place == swaps[earlier], earlier, place)
        np.minimum.at(best, (owner, place), j + u)
        swaps.append(k)
        done = best.max(1) < j + 1
        if done.all():
            break
        keep = ~done[owner]
        if not keep.all():
            element, owner, swaps = element[keep], owner[keep], [s[keep] for s in swaps]
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mixed64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    for i in range(rows):
        key = mixed64(key * np.uint64(GOLD) + bits[:, :, i])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(s: np.ndarray) -> bytes:
    """The least SKETCH of the set's hashes, each mixed down to 32 bits, sorted."""
    return np.unique((mixed64(s) >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes()


def may_link(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    """Could two sets be similar enough, by their sketches and sizes?

    Of two whole sets the sketches give the intersection but for SLACK; of larger ones the least hashes of the union
    are a sample, and at most MARGIN deviations fewer of them may be shared than a link shows.
    """
    if min(size_a, size_b) * 100 < percent * max(size_a, size_b):
        return False
    both = np.intersect1d(a, b, assume_unique=True)
    if max(size_a, size_b) <= SKETCH:
        n = len(both) + SLACK
        return 100 * n >= percent * (size_a + size_b - n)
    whole = np.union1d(a, b)[:SKETCH]
    share = percent / 100
    least = len(whole) * share - MARGIN * (len(whole) * share * (1 - share)) ** 0.5
    return int(np.searchsorted(both, whole[-1], "right")) >= least


def _slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for i in range(0, x.num_rows, rows):
            yield x.slice(i, rows)


def _parts(full: list[int], sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Runs of sets of at most about ELEMENTS elements together."""
    part, n = [], 0
    for i in full:
        if part and n + len(sets[i]) > ELEMENTS:
            yield part
            part, n = [], 0
        part.append(i)
        n += len(sets[i])
    if part:
        yield part


def described(docs: DataFrame, size: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null when empty), band keys, and a byte of each signature value."""

    def describe(batches):
        process_cache().clear()  # what another operator has left in the worker would be held beside the sets
        hashes = WordHash()
        for x in _slices(batches, 256):
            sets = [shingles(t, size, hashes) for t in x["text"].to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            at, sig = {}, {}
            for part in _parts(full, sets):
                values = super_min_hash([sets[i] for i in part], bands * rows)
                at |= zip(part, band_keys(values, bands, rows).tolist())
                sig |= zip(part, map(bytes, (mixed64(values.view(np.uint64)) & np.uint64(255)).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [x["doc_id"], x["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([at.get(i) for i in range(len(sets))], pa.list_(pa.int64())), pa.array([sig.get(i) for i in range(len(sets))], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "keys", "sig"],
            )

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    return read.mapInArrow(describe, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<bigint>, sig binary")


def least_agreement(percent: int) -> float:
    """Places where two signatures must agree at least, at most MARGIN deviations below what a link shows."""
    m, share = BANDS * ROWS, percent / 100
    return m * share - MARGIN * (m * share * (1 - share)) ** 0.5


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and signatures allow a link. signed: id, size, sig."""
    left, right = (signed.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    sized = pairs.join(left, "a").join(right, "b").where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
    least = least_agreement(percent)

    def agreeing(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = pa.array((a == b).sum(1) >= least) if x.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([x["a"].filter(keep), x["b"].filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(agreeing, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough. texts: id, text.

    The pairs of an ``a`` are dealt into PARTS by their ``b``. In a part the text of ``a`` comes first, once, and the
    texts of its ``b`` after it, so neither is a text copied for every pair nor a row with many pairs gathered in a task.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("part")
    dealt = pairs.select("a", "b", part)
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    others = dealt.join(texts.withColumnRenamed("id", "b"), "b")
    both = heads.select("a", "part", F.lit(None).cast("long").alias("b"), "text").unionAll(others.select("a", "part", "b", "text"))

    def verify(batches):
        hashes = WordHash()
        head = None
        for x in _slices(batches, 512):
            a, b, keep = [], [], x["b"].to_pylist()
            for i, (of, other) in enumerate(zip(x["a"].to_pylist(), keep)):
                s = shingles(x["text"][i].as_py(), size, hashes)
                if other is None:
                    head = s
                elif similar(head, s, percent):
                    a.append(of)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    order = [F.col("a"), F.col("part"), F.col("b").asc_nulls_first()]
    return both.repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions(*order).mapInArrow(verify, "a long, b long")


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """id, size, sketch of each text's shingle set. texts: id, text."""

    def describe(batches):
        hashes = WordHash()
        for x in _slices(batches, 256):
            sets = [shingles(t, size, hashes) for t in x["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([x["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([sketched(s) for s in sets], pa.binary())], names=["id", "size", "sketch"])

    return texts.mapInArrow(describe, "id long, size long, sketch binary")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """id, root (the smallest id of its component) for every id in an edge (a, b): distributed union-find.

    Tasks first join what they hold, TASK_EDGES edges or fewer, by a union-find of their own. Where that was one task's
    work, its forest is the result; else large and small stars alternate until no edge changes. However many the
    edges, they are never gathered in one place.
    """

    def local(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for x in batches:
            for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        ids = [x for x in parent if root(x) != x]
        for i in range(0, len(ids), 10_000):
            part = ids[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])

    # edges point from the larger id to the smaller
    tasks = -(-edges.count() // TASK_EDGES) or 1
    stars = saved(edges.coalesce(tasks).mapInArrow(local, "a long, b long"), name)
    while tasks > 1:
        # large star: each neighbour above a node, to the node's least neighbour; small star: those below it
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), name)
        large = saved(met(both.where(F.col("b") > F.col("a")), least, "a", 2 * stars.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        low = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        moved = met(large, low, "a", large.count()).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = saved(moved.unionAll(low.select("a", F.col("m").alias("b"))).where("a > b").distinct(), name)
        gone = stars.exceptAll(small).limit(1).count() + small.exceptAll(stars).limit(1).count()
        dropped(stars, large, least, low)
        stars = small
        if not gone:
            break
    out = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out._granary_path = stars._granary_path
    return out


def _roots(members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("root", F.col("id"))
    return members.join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _open(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of buckets that still hold several groups, with their roots and ``n``, the members of the bucket; saved."""
    if links is None:  # every bucket has several members, each its own group
        return saved(_roots(buckets, None), "open")
    rooted = saved(_roots(buckets, links), "rooted")
    groups = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    several = saved(groups.where("lo < hi").select("key", "n"), "several")
    out = saved(met(rooted.drop("n"), several, "key", rooted.count()), "open")
    dropped(rooted, several)
    return out


def _hub_pairs(members: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of different groups: each member with the hub of its part of the bucket, each such hub with one of them.

    A bucket has as many parts as a shuffle has, so that no task gets a hot bucket's members together; of a small one
    nearly each member is its own part's hub, and all meet the same.
    """
    parts = partitions(members.sparkSession)
    dealt = members.select("key", F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(parts)).cast("int").alias("part"), "id", "root")
    order = F.struct(F.xxhash64(F.lit(round_), "root").alias("by_root"), F.xxhash64(F.lit(round_), "id").alias("by_id"), F.col("id"), F.col("root"))
    hubs = dealt.groupBy("key", "part").agg(F.min(order).alias("h"))
    heads = hubs.groupBy("key").agg(F.min("h").alias("top"))
    near = dealt.join(hubs, ["key", "part"]).where("root <> h.root").select(F.col("h.id").alias("a"), F.col("id").alias("b"))
    far = hubs.join(heads, "key").where("h.root <> top.root").select(F.col("top.id").alias("a"), F.col("h.id").alias("b"))
    return near.unionAll(far).distinct()


def _cross_pairs(members: DataFrame, percent: int, best: bool, more: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of different groups in a bucket whose signatures agree enough for verification.

    members: key, band, id, root, sig, keys, size, sketch, the last four by id in ``more`` where that is given, and ``n``, the
    members of the bucket, which are counted where it is absent. Pairs are compared inside tasks, blocks of hot buckets against
    each other. With ``best``, each row passes on its few likeliest rows of other groups alone, else all pairs, once: by
    the first band key that the two share. Agreement is enough at most MARGIN deviations below what sets similar enough would
    show; of pairs that agree enough, those that may link by their sketches are passed on.
    """
    sizes = None
    if "n" not in members.columns:
        sizes = saved(members.groupBy("key").agg(F.count("*").alias("n")), "sizes")
        members = met(members, sizes, "key", members.count())
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if more is not None:
        dealt = dealt.join(more, "id")
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root", "sig", "size", "sketch", *([] if best else ["keys"]))
    m, least = BANDS * ROWS, least_agreement(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.Table]:
            """One table a bucket's pair of blocks; rows come sorted."""
            held: list[pa.RecordBatch] = []
            for x in batches:
                if not x.num_rows:
                    continue
                marks = np.stack([x[c].to_numpy() for c in ("key", "i", "j")])
                cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), x.num_rows]
                for n, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = x.slice(lo, hi - lo)
                    if held and (n or any(held[0][c][0] != part[c][0] for c in ("key", "i", "j"))):
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(part)
            if held:
                yield pa.Table.from_batches(held)

        for t in each():
            if t.num_rows < 2:
                continue
            ids, roots, block = (t[c].to_numpy() for c in ("id", "root", "block"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, m)
            size, sketch = t["size"].to_numpy(), [np.frombuffer(x, np.uint32) for x in t["sketch"].to_pylist()]
            linkable = lambda r, near: np.array([may_link(sketch[r], sketch[x], size[r], size[x], percent) for x in near], bool)
            i, j, key = t["i"][0].as_py(), t["j"][0].as_py(), t["key"][0].as_py()
            keys = None if best else np.stack(t["keys"].to_pylist()).astype(np.int64)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for r, others in [*((r, right) for r in left), *((r, left) for r in right if best and i != j)]:
                near = others[roots[others] != roots[r]] if best or i != j else others[(roots[others] != roots[r]) & (others > r)]
                agree = (sig[near] == sig[r]).sum(1)
                if best:
                    likeliest = np.argsort(-agree, kind="stable")[:PARTNERS]
                    near = near[likeliest[agree[likeliest] >= least]]
                    near = near[linkable(r, near)]
                else:
                    near = near[agree >= least]
                    # signature bytes may agree in a band whose keys differ: keys alone tell where the two meet
                    near = near[keys[r, (keys[near] == keys[r]).argmax(1)] == key]
                    near = near[linkable(r, near)]
                out.append((np.minimum(ids[near], ids[r]), np.maximum(ids[near], ids[r])))
            a, b = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["key", "i", "j"]
    out = saved(rows.repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long").distinct(), "near")
    if sizes is not None:
        dropped(sizes)
    return out


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Those of the pairs (a, b) that are in ``tried`` in neither order."""
    if tried is None:
        return pairs
    ordered = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    return pairs.select("a", "b", *ordered).join(tried.select(*ordered), ["lo", "hi"], "left_anti").select("a", "b")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of ``size``-word shingles, A-Z
    lower-cased; fewer words make one shingle, null or blank texts an empty set that links with nothing. Texts count
    whole, however long. component_id is the smallest id reachable by links, kept marks that row. Rows with one id are
    one document, whose texts are linked with each other by it (a blank one keeps the id itself); rows with a null id
    keep a null component and are kept. An empty table gives no row. Other columns, whatever their names, are not read.

    A node is a distinct set, numbered; its text is that of its smallest id's row. Files made on the way are deleted.
    """
    made: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(saved(df, name))
        return made[-1]

    at = saved(described(docs, size, id_col, text_col), "sets")
    named = at.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    least_row = F.min(F.struct("doc_id", "text_hash")).alias("row")
    reps = named.groupBy("digest").agg(least_row, F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"), F.count("*").alias("n"))
    reps = saved(reps.select("digest", F.monotonically_increasing_id().alias("id"), F.col("row.doc_id").alias("doc"), "row.text_hash", "keys", "sig", "size", "n"), "reps")
    banded = reps.select("id", F.posexplode("keys").alias("band", "key"))
    shared = put(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = put(met(banded, shared, "key", BANDS * reps.count()).select("key", "band", "id", "n"), "buckets")
    meeting = put(buckets.select("id").distinct(), "ids")
    near, _, bits = sifted(reps, [reps["id"]], meeting)
    wanted = put(near.select("id", "doc", "text_hash", "keys", "sig", "size").join(meeting, "id", "left_semi"), "wanted")
    # keys and signatures are large, and those of sets that share no bucket are not needed any more
    rows, reps_left = put(at.select("doc_id", "n_shingles", "digest"), "rows"), put(reps.select("digest", "id", "doc", "n"), "reps")
    dropped(at, reps, bits)
    source = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    source, _, bits = sifted(source, [source["doc"], source["text_hash"]], wanted.select("doc", "text_hash"))  # other texts stay in place
    made.append(bits)
    texts = put(source.join(wanted.select("id", "doc", "text_hash"), ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"]).select("id", "text"), "texts")
    # unlike texts of one id
    named = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    nodes = put(named.join(several, "doc_id", "left_semi").select("doc_id", "digest").join(reps_left.select("digest", "id"), "digest").select("doc_id", "id").distinct(), "repeated")
    links, tried, found, described_ = None, None, None, None
    if not nodes.isEmpty():
        found = put(nodes.join(nodes.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b"), "links")
        made.append(links := components(found))
    round_, last = 0, HUB_ROUNDS + BEST_ROUNDS
    while round_ <= last:
        open_ = _open(buckets, links)
        if open_.isEmpty():
            dropped(open_)
            break
        if round_ < HUB_ROUNDS:
            pairs = likely(_hub_pairs(open_, round_), wanted.select("id", "size", "sig"), percent)
        else:
            best = round_ < last
            looked = open_.where(F.col("band") % BAND_STEP == round_ % BAND_STEP) if best else open_
            if described_ is None:  # groups only grow: what is open later is open now
                described_ = put(sketches(texts.join(open_.select("id").distinct(), "id", "left_semi"), size).join(wanted.select("id", "sig", "keys"), "id"), "sketches")
            made.append(pairs := _cross_pairs(looked, percent, best, described_))
        pairs = put(_untried(pairs, tried), "pairs")
        good = put(linked(pairs, texts, size, percent).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        tried = pairs if tried is None else tried.unionAll(pairs)
        found = good if found is None else found.unionAll(good)
        if n_good := good.count():
            made.append(links := components(found))
        dropped(open_)
        round_ += 1
        if HUB_ROUNDS < round_ < last and n_good * FEW < described_.count():
            round_ = last
    rooted = put(_roots(reps_left.select("digest", "id", "doc", F.col("n").alias("copies")), links), "rooted")
    groups = put(rooted.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "roots")
    of_digest = put(met(rooted, groups, "root", rooted.count()).select("digest", "least", F.col("copies").alias("n")), "named")
    joined = met(rows.where("doc_id is not null"), of_digest, "digest", rows.count(), "left")
    joined = joined.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "doc_id"))
    out = joined.withColumn("component_id", component)
    out = saved(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups")
    dropped(*made)
    return out


def deduplicated(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, but for those of a group that are not its smallest id.

    Edge cases as for :func:`near_duplicates`: rows without id, and every row of a repeated id that is kept, stay.
    """
    gone = unused("gone", docs)
    ids = near_duplicates(spark, docs, size, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    maybe, stay, _ = sifted(docs, [docs[id_col].cast("long")], ids)  # most rows stay in place
    return stay.unionAll(maybe.join(ids, maybe[id_col] == F.col(gone), "left_anti"))
