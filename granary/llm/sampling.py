"""Sampled segmentations over a SentencePiece vocabulary: forward filtering, backward sampling.

The pieces that match a chunk of text (a word with the spaces before it) are the edges of a lattice. A forward
pass adds up the weights of all paths to each place; going back from the end, each edge is drawn in proportion
to the weight of the paths that lead over it. A segmentation so comes up with its probability under the piece
model, and the draws hang on the row's key alone.

Lattices are built once for a distinct chunk; draws for all chunks of a batch are made together.
"""

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from granary.llm.common import process_cache, saved

SPACE = "▁"
#: Lattices that a worker remembers at a time, and their places; all are dropped when there are more.
CACHE, CACHE_PLACES = 400_000, 6_000_000
#: Characters of new chunks whose lattices are built together; a longer chunk is built alone.
TOGETHER = 1_000_000
#: Places of a chunk from which on sums of weights are kept as logarithms, as they would leave the range of floats.
PLAIN = 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks_of(pieces: Iterable[str]) -> re.Pattern:
    """A chunk is a word with all spaces before it, a run of spaces or a line's end, where no piece spans two such;
    else what the pieces do not span. No chunk is cut, so every piece that matches the text is in a lattice."""
    mixed = any("\n" in p and len(p) > 1 for p in pieces)
    inner = any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in pieces)
    if mixed:
        return re.compile(r".+" if inner else rf"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
    return re.compile(r"[^\n]+|\n" if inner else rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceModel:
    """Pieces with weights, as a trie in arrays. A unigram model has its own weights; for merge ranks, Zipf's law over
    the rank is taken."""

    def __init__(self, model: bytes, temperature: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [sp.unk_id()] * 256
        plain = {i: sp.get_score(i) for i in range(self.n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        ranked = len(plain) > 1 and all(float(s).is_integer() for s in plain.values())
        self.weight = np.zeros(self.n)
        pieces = {}
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif i in plain:
                pieces[piece] = i
                self.weight[i] = math.exp((-math.log(2.0 - plain[i]) if ranked else plain[i]) / temperature)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(SPACE, " ").encode() if i in plain else b"")
        if sp.unk_id() in self.byte_ids:
            raise ValueError("the model has no byte pieces, without which decoding would lose characters")
        self.byte_weight = self.weight[self.weight > 0].min() * math.exp(-10.0)  # of a character spelt in bytes
        self.longest = max(map(len, pieces))
        self.chunk = chunks_of(pieces)
        self.alphabet = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        letter = {chr(c): k for k, c in enumerate(self.alphabet.tolist())}
        states, step = {"": 0}, {}
        for p in sorted(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    step[states[p[: k - 1]] * len(letter) + letter[p[k - 1]]] = states[p[:k]] = len(states)
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.full(len(states), -1, np.int32)
        for p, i in pieces.items():
            self.piece[states[p]] = i

    def edges(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all chunks, their characters numbered through: each edge's first and last character, its piece (-1 for a
        character spelt in bytes) and weight."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        letters = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[letters] == codes
        sizes = np.array([len(c) for c in chunks])
        end = np.repeat(np.cumsum(sizes), sizes)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(codes), bool)
        for depth in range(self.longest):
            inside = at + depth < end[at]
            at, state = at[inside], state[inside]
            key = state * len(self.alphabet) + letters[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = (self.keys[place] == key) & known[at + depth]
            at, state = at[goes], self.next[place[goes]].astype(np.int64)
            piece = self.piece[state]
            whole = piece >= 0
            found.append((at[whole], at[whole] + depth, piece[whole]))
            if not depth:
                single[at[whole]] = True
            if not len(at):
                break
        bare = np.flatnonzero(~single)
        found.append((bare, bare, np.full(len(bare), -1, np.int32)))
        first, last, piece = (np.concatenate(x) for x in zip(*found))
        return first, last, piece, np.where(piece >= 0, self.weight[piece], self.byte_weight)


class Grown:
    """An array that takes more values at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            bigger = np.empty(max(self.n + len(values), len(self.data) * 3 // 2), self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Lattices(dict):
    """Filtered lattices of many chunks in flat arrays; as a dict, the last node of each chunk.

    A node is the place after a character; its edges, likeliest first, have cumulative probabilities, the node they
    start from (-1: the chunk's start) and a token: a piece, or from model.n on a character spelt in bytes.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.byte_runs: list[list[int]] = []
        self.byte_token: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.nodes, self.new = 0, []
        self.offset, self.upto, self.start, self.token = Grown(np.int32), Grown(np.float32), Grown(np.int32), Grown(np.int32)

    def __missing__(self, chunk: str) -> int:
        self.nodes += len(chunk)
        self.new.append(chunk)
        end = self[chunk] = self.nodes - 1
        return end

    def learn(self) -> None:
        """Builds and filters the new chunks' lattices, many of them together, place by place."""
        new, self.new = self.new, []
        part, n = [], 0
        for chunk in new:
            if part and n + len(chunk) > TOGETHER:
                self._build(part)
                part, n = [], 0
            part.append(chunk)
            n += len(chunk)
        if part:
            self._build(part)

    def _build(self, new: list[str]) -> None:
        first, last, piece, weight = self.model.edges(new)
        sizes = np.array([len(c) for c in new])
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        # only ratios count: a factor for each character keeps long products in range
        weight = weight * self.model.byte_weight ** (-0.5 * (last - first + 1))
        forward, mass = np.zeros(len(begin)), np.empty(len(first))
        depth = last - begin[last]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(sizes.max() + 1))
        for lo, hi in zip(cuts[:PLAIN], cuts[1 : PLAIN + 1]):
            e = order[lo:hi]
            before = first[e] - 1
            mass[e] = weight[e] * np.where(first[e] == begin[first[e]], 1.0, forward[before])
            forward += np.bincount(last[e], mass[e], len(forward)) if hi - lo > len(forward) // 8 else 0.0
            if hi - lo <= len(forward) // 8:
                np.add.at(forward, last[e], mass[e])
        if len(cuts) > PLAIN + 1:
            logs = np.log(forward, out=np.zeros(len(forward)), where=forward > 0)
            for lo, hi in zip(cuts[PLAIN:-1], cuts[PLAIN + 1 :]):  # a chunk's edges into this place stand in their order
                e = order[lo:hi]
                nodes, which = np.unique(last[e], return_inverse=True)
                log = np.log(weight[e]) + np.where(first[e] == begin[first[e]], 0.0, logs[first[e] - 1])
                most = np.full(len(nodes), -np.inf)
                np.maximum.at(most, which, log)
                mass[e] = np.exp(log - most[which])
                forward[nodes] = np.bincount(which, mass[e], len(nodes))
                logs[nodes] = most + np.log(forward[nodes])
        order = np.lexsort((-mass, last))
        first, last, piece, share = first[order], last[order], piece[order], (mass / forward[last])[order]
        total = np.cumsum(share)
        heads = np.searchsorted(last, np.arange(len(begin)))
        upto = total - np.repeat(np.concatenate([[0.0], total])[heads], np.diff(np.append(heads, len(last))))
        upto[np.append(heads[1:], len(last)) - 1] = 2.0  # rounding leaves none beyond a node's last edge
        base, edges = self.offset.n, self.upto.n
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            text = "".join(new)
            piece[bare] = [self._bytes(text[i]) for i in first[bare].tolist()]
        self.offset.extend(heads + edges)
        self.upto.extend(upto)
        self.start.extend(np.where(first == begin[first], -1, first - 1 + base))
        self.token.extend(piece)

    def _bytes(self, character: str) -> int:
        if character not in self.byte_token:
            self.byte_token[character] = self.model.n + len(self.byte_runs)
            self.byte_runs.append([self.model.byte_ids[b] for b in character.encode()])
        return self.byte_token[character]

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and how many each text has."""
        if len(self) > CACHE or self.nodes > CACHE_PLACES:
            self.clear()
        ends: list[int] = []
        counts = [0]
        for text in texts:
            # a space mark that stands in the text itself is spelt in bytes, or it would come back as a space
            for s, plain in enumerate(text.split(SPACE) if text else ()):
                if s:
                    ends.append(-1)
                ends.extend(map(self.__getitem__, self.model.chunk.findall(("" if s else SPACE) + plain.replace(" ", SPACE))))
            counts.append(len(ends))
        if self.new:
            self.learn()
        counts = np.diff(counts)
        node = np.array(ends, np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
        stream = mixed64(keys[owner] + mixed64(place.astype(np.uint64) * _GOLD + np.uint64(1)))
        offset, upto, start, token = (x.data for x in (self.offset, self.upto, self.start, self.token))
        active = np.flatnonzero(node >= 0)
        at, drawn, steps = node[active], [], np.ones(len(node), np.int64)
        while len(active):
            u = ((mixed64(stream[active] + np.uint64(len(drawn) * int(_GOLD) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53).astype(np.float32)
            edge = offset[at]
            on = np.flatnonzero(upto[edge] < u)
            while len(on):
                edge[on] += 1
                on = on[upto[edge[on]] < u[on]]
            drawn.append((active, token[edge]))
            at = start[edge]
            more = at >= 0
            active, at = active[more], at[more]
            steps[active] += 1
        last = np.cumsum(steps) - 1
        tokens, source = np.full(int(steps.sum()), -1, np.int32), np.repeat(owner, steps)
        for back, (which, found) in enumerate(drawn):
            tokens[last[which] - back] = found
        special = np.flatnonzero((tokens >= self.model.n) | (tokens < 0))
        if len(special):
            mark = [self.model.byte_ids[b] for b in SPACE.encode()]
            runs = [mark if t < 0 else self.byte_runs[t - self.model.n] for t in tokens[special].tolist()]
            sizes = np.ones(len(tokens), np.int64)
            sizes[special] = [len(r) for r in runs]
            starts = (np.cumsum(sizes) - sizes)[special]
            tokens, source = np.repeat(tokens, sizes), np.repeat(source, sizes)
            lengths = sizes[special]
            tokens[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = np.concatenate(runs)
        return tokens, np.bincount(source, minlength=len(texts))


def decoded(model: PieceModel, ids: list[int]) -> bytes:
    """The text in UTF-8: pieces' bytes joined, less the space that encoding puts first."""
    return b"".join(map(model.bytes_of.__getitem__, ids))[1:]


#: Unlike rows whose numbers a task keeps at a time; with more it begins a new group.
GROUP_ROWS = 500_000


def row_keys(ids: list, seed: int, copies: list[str | None] | None = None) -> np.ndarray:
    """A key for each row, from the seed, the id and, where given, what tells apart rows of one id."""
    named = ["null" if i is None else str(i) for i in ids]
    if copies is not None:
        named = [n if c is None else f"{n}:{c}" for n, c in zip(named, copies)]
    return np.array([xxh3_64_intdigest(f"{seed}:{n}".encode()) for n in named], np.uint64)


def told_apart(docs: DataFrame) -> DataFrame:
    """id, text, copy: rows of one id get unlike values of ``copy``, from their text and their number among equal rows.

    Equal rows stand for each other, so which of them has which number doesn't matter. A task numbers the equal rows that
    it reads; only where several groups of rows hold a row are numbers moved up by the counts of the groups before. Those
    are found from ids, hashes and counts; texts stay in place, unless many rows are spread so. An id, or a row, however
    common isn't gathered in one task.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        group = TaskContext.get().partitionId() << 32
        for x in batches:
            if len(seen) > GROUP_ROWS:
                seen, group = {}, group + 1
            places = []
            for key in zip(map(repr, x["id"].to_pylist()), x["hash"].to_pylist()):
                places.append(at := seen.get(key, 0))
                seen[key] = at + 1
            yield pa.RecordBatch.from_arrays([x["id"], x["text"], x["hash"], pa.array([group] * x.num_rows, pa.int64()), pa.array(places, pa.int64())], names=["id", "text", "hash", "group", "place"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(numbered, f"id {kind}, text string, hash long, group long, place long")
    rows = saved(rows, "numbered")
    counts = rows.groupBy("id", "hash", "group").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("id", "hash").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), F.col("group").alias("group_"), (F.sum("n").over(before) - F.col("n")).alias("start"))
    starts = saved(starts.where("start > 0"), "starts")
    number = F.col("place")
    if not starts.isEmpty():
        rows = rows.join(starts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")) & (F.col("group") == F.col("group_")), "left")
        number = number + F.coalesce("start", F.lit(0))
    return rows.select("id", "text", F.concat_ws(":", F.hex("hash"), number.cast("string")).alias("copy"))


def sampled(
    spark: SparkSession, docs: DataFrame, model_path: str, seed: int = 29, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text", copies: bool = False,
) -> DataFrame:
    """id, n_pieces, ids (array<int>), ids_crc32 (little-endian unsigned 32-bit), text_crc32, lossless.

    A row's draws hang on seed and id only: the same at every run and in any partitioning; equal texts with equal
    ids, also null ids, get equal segmentations. With ``copies``, rows of one id, such as the epochs of a mixture,
    are drawn for each by itself, and the rows of a table still come out the same at every run; that takes a shuffle of
    ids and hashes, without it this is a map over rows. Null and empty texts have no piece. A lattice spans a word, or a run of
    spaces, whole, however long the text: nothing is cut. An empty table gives no row; other columns, whatever their
    names, are not read. ``lossless`` tells that decoding the ids gave the text back, text_crc32 is that of the decoded text.
    """
    with open(model_path, "rb") as f:  # the vocabulary is a local file of under a megabyte
        model_bytes = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("lattices", crc32(model_bytes.value), temperature)
        if key not in process_cache():
            process_cache()[key] = Lattices(PieceModel(model_bytes.value, temperature))
        lattices = process_cache()[key]
        model = lattices.model
        for big in batches:
            for at in range(0, big.num_rows, 256):
                x = big.slice(at, 256)
                texts = [t or "" for t in x["text"].to_pylist()]
                tokens, counts = lattices.sample(texts, row_keys(x["id"].to_pylist(), seed, x["copy"].to_pylist()))
                ends = np.concatenate([[0], np.cumsum(counts)])
                crcs, back, same = [], [], []
                whole = tokens.tolist()
                for i, text in enumerate(texts):
                    crcs.append(crc32(tokens[ends[i] : ends[i + 1]].astype("<u4").tobytes()))
                    out = decoded(model, whole[ends[i] : ends[i + 1]])
                    back.append(crc32(out))
                    same.append(out == text.encode())
                yield pa.RecordBatch.from_arrays(
                    [x["id"], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32())), pa.array(crcs, pa.int64()), pa.array(back, pa.int64()), pa.array(same)],
                    names=[id_col, "n_pieces", "ids", "ids_crc32", "text_crc32", "lossless"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = told_apart(rows) if copies else rows.withColumn("copy", F.lit(None).cast("string"))
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, n_pieces long, ids array<int>, ids_crc32 long, text_crc32 long, lossless boolean")
