"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, serves every block. A block holds whole documents and is
coded on its own: its ids are dealt over interleaved lanes, each with a 64-bit state that gives off 32-bit words.
Checkpoints note the lanes' states and the words read so far, so decoding can start inside a long block; each
block carries a checksum of its ids. Layout of a folder: ``table`` (id, frequency), ``blocks`` (part, block,
first, n_ids, doc_ids, sizes, lanes, checkpoints, words, crc32), as Parquet files.
"""

import json
import os
import string
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import dropped, new_folder, partitions, process_cache, saved, words

#: Frequencies add up to this; states stay in [LOW, LOW << 32).
SCALE_BITS, LOW_BITS = 20, 31
LANES, CHECKPOINT_STEPS = 1024, 128
#: A block is closed by the document that fills it; a longer document makes a longer block.
BLOCK_IDS = 1 << 18
#: A block of more ids is decoded by many tasks, from its checkpoints.
LONG_IDS = 8 * BLOCK_IDS
#: Words whose ids a worker remembers at a time; all are forgotten when there are more.
CACHE = 1_500_000


@dataclass(frozen=True)
class Table:
    """Frequencies of symbols in ascending id order, their starts, and the symbol of each slot."""

    ids: np.ndarray
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray
    place: np.ndarray  # of each id among the symbols

    @staticmethod
    def of(ids: np.ndarray, freq: np.ndarray) -> "Table":
        place = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
        place[ids] = np.arange(len(ids))
        return Table(ids.astype(np.uint32), freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) <= 1 << 16 else np.uint32), freq), place)


def scaled(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts made to add up to 1 << SCALE_BITS, each at least 1; what rounding leaves goes to the most frequent."""
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids], np.float64)
    room = 1 << SCALE_BITS
    if len(ids) > room:
        raise ValueError("more symbols than slots")
    if not len(ids):
        return ids, np.empty(0, np.int64)
    freq = np.maximum(1, np.floor(n / n.sum() * room)).astype(np.int64)
    over = int(freq.sum()) - room
    for i in np.argsort(-freq, kind="stable"):
        take = min(over, int(freq[i]) - 1)
        freq[i] -= take
        over -= take
        if over <= 0:
            break
    return ids, freq


@dataclass(frozen=True)
class Coded:
    n: int
    checkpoints: bytes  # for each: words read before it (uint64), the lanes' states (uint64)
    words: bytes


def encode_block(ids: np.ndarray, table: Table) -> Coded:
    steps = -(-len(ids) // LANES)
    at = table.place[ids]
    freq, start = table.freq[at], table.start[at]
    state = np.full(LANES, 1 << LOW_BITS, np.uint64)
    given: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    limit = np.uint64(LOW_BITS - SCALE_BITS + 32)
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << limit)
        given.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << np.uint64(SCALE_BITS)) + r + c
        if step % CHECKPOINT_STEPS == 0:
            marks.append((step, state.copy()))
    given.reverse()
    read = np.cumsum([0, *map(len, given)])
    points = b"".join(np.uint64(read[step]).tobytes() + s.astype("<u8").tobytes() for step, s in reversed(marks))
    return Coded(len(ids), points, np.concatenate(given).astype("<u4").tobytes() if given else b"")


def decode_block(coded: Coded, table: Table, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """The ids from a checkpoint on, to the end or over so many checkpoints."""
    first = checkpoint * CHECKPOINT_STEPS * LANES
    last = coded.n if checkpoints is None else min(coded.n, first + checkpoints * CHECKPOINT_STEPS * LANES)
    if first >= last:
        return np.empty(0, np.uint32)
    size = 8 * (LANES + 1)
    mark = np.frombuffer(coded.checkpoints, "<u8", LANES + 1, checkpoint * size)
    pos, state = int(mark[0]), mark[1:].astype(np.uint64)
    given = np.frombuffer(coded.words, "<u4").astype(np.uint64)
    out = np.empty(last - first, np.uint32)
    mask, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(1 << LOW_BITS)
    for i in range(0, last - first, LANES):
        x = state[: min(LANES, last - first - i)]
        slot = x & mask
        s = table.slot[slot.astype(np.int64)]
        out[i : i + len(x)] = s
        x = table.freq[s] * (x >> np.uint64(SCALE_BITS)) + slot - table.start[s]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << np.uint64(32)) | given[pos : pos + len(need)]
        pos += len(need)
        state[: len(x)] = x
    return table.ids[out]


#: ASCII marks; a run of them after a word's letters is one more pre-token.
MARKS = string.punctuation
#: Fixed value: the pre-tokenizer pattern that takes runs of letters, and runs of marks, whole.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordIds(dict):
    """Place of each distinct white-space word; its ids come from the tokenizer, once.

    The tokenizer must not look past ASCII white space: its normalizer and pre-tokenizer work within words. If it
    also lower-cases and cuts letters from marks, as LETTERS_APART does, then words are looked up in lower case, and
    words of letters are encoded many at a time: the pieces that end a pre-token part them again.
    """

    def __init__(self, tokenizer_json: str):
        self.plain, self.tokenizer = (tokenizers.Tokenizer.from_str(tokenizer_json) for _ in range(2))
        # words are parts of texts without an added token: what looks like one, once in lower case, is none
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(tokenizer_json)
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added if not t["normalized"]]
        self.added_lower = [t["content"].lower() for t in added if t["normalized"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.apart = bool(suffix) and LETTERS_APART in tokenizer_json.replace("\\\\", "\\") and '"Lowercase"' in tokenizer_json and all(t["special"] for t in added)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[bytes] = []
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def holds_added(self, text: str | None) -> bool:
        """Does the text spell out an added token, such as one that ends texts? Then only the tokenizer itself knows its ids."""
        if not text:
            return False
        return any(map(text.__contains__, self.added)) or bool(self.added_lower) and any(map(text.lower().__contains__, self.added_lower))

    def split(self, text: str | None) -> list[bytes]:
        if not self.apart:
            return words(text)
        return text.encode().lower().split() if text else []

    def learn(self) -> None:
        """Ids of the new words: letters many at a time; letters with marks after them from the two parts' ids."""
        known, letters, rest, whole, parts = len(self.start), [], [], [], []
        for i, raw in enumerate(self.new):  # grows by the parts
            word = raw.decode()
            head = word.rstrip(MARKS) if self.apart else ""
            if not (head.isalpha() and head.lower().isalpha()):
                rest.append(i)
            elif len(head) == len(word):
                letters.append(i)
            else:
                whole.append(i)
                parts.append((self[head.encode()], self[word[len(head) :].encode()]))
        new, self.new = [w.decode() for w in self.new], []
        flat, order, sizes = [self.flat], [], []
        for i in range(0, len(letters), 1000):
            part = letters[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join([new[j] for j in part]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                flat.append(ids)
                order += part
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += part
        for i in range(0, len(rest), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([new[j] for j in rest[i : i + 4096]], add_special_tokens=False)]
            flat.append(np.array([x for ids in found for x in ids], np.uint32))
            sizes.append(np.array([len(ids) for ids in found], np.int64))
        order, sizes = np.array(order + rest, np.int64), np.concatenate([*sizes, np.empty(0, np.int64)])
        start, size = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.start, self.size))
        start[known + order], size[known + order] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.flat = np.concatenate(flat)
        if whole:
            two = np.array(parts, np.int64).ravel()
            at, whole = len(self.flat), np.array(whole, np.int64) + known
            self.flat = np.concatenate([self.flat, self.flat[_spans(start[two], size[two])]])
            size[whole] = size[two].reshape(-1, 2).sum(1)
            start[whole] = at + np.cumsum(size[whole]) - size[whole]
        self.start, self.size = start, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of them."""
        if len(self) > CACHE:
            self.clear()
        at: list[int] = []
        counts = [0]
        whole = {k: np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in enumerate(texts) if self.holds_added(t)}
        for k, t in enumerate(texts):
            if k not in whole:
                at.extend(map(self.__getitem__, self.split(t)))
            counts.append(len(at))
        if self.new:
            self.learn()
        at = np.array(at, np.int64)
        start, size = self.start[at], self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])[counts]
        ids, sizes = self.flat[_spans(start, size)], np.diff(ends)
        if whole:
            ids = np.concatenate([whole[k] if k in whole else ids[ends[k] : ends[k + 1]] for k in range(len(texts))])
            sizes[list(whole)] = [len(x) for x in whole.values()]
        return ids, sizes


def stored_as(vocabulary: int) -> str:
    """Type of the ids on their way to the blocks: two bytes where they suffice."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer_json: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (little-endian, of type ``kind``) with the end id."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        known = process_cache().setdefault(("word ids", shared.value), None) or WordIds(shared.value)
        process_cache()["word ids", shared.value] = known
        for big in batches:
            for at in range(0, big.num_rows, 400):
                x = big.slice(at, 400)
                ids, sizes = known.encode(x["text"].to_pylist())
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype(kind)
                ends = width * np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                yield pa.RecordBatch.from_arrays([x["doc_id"], pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def counted(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs; as many entries as the vocabulary has symbols, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for x in batches:
            for i in range(0, x.num_rows, 500):
                n = np.bincount(np.frombuffer(b"".join(x["ids"].slice(i, 500).to_pylist()), kind), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()}


BLOCK_SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<long>, sizes array<long>, lanes int, checkpoints binary, words binary, crc32 long"


def write_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenizes, counts, sorts by doc_id and writes table and blocks below ``path``.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, so a text that spells out an added token has
    that token's id there. Null and empty texts hold the end id alone. Rows with a null id come first, repeated rows
    and rows with equal ids in the order of their ids' bytes. A very long text makes a block of its own length. An
    empty table gives files without a document. Other columns, whatever their names, are not read. Parts follow each
    other in doc_id order, blocks in each part.
    """
    with open(tokenizer_path) as f:  # the vocabulary is a local file of a few megabytes
        tokenizer_json = f.read()
    kind = stored_as(max(tokenizers.Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1))
    tokens = saved(tokenized(docs, tokenizer_json, kind, end_id, id_col, text_col), "tokens")
    ids, freq = scaled(counted(tokens, kind))
    spark.createDataFrame(list(zip(ids.tolist(), freq.tolist())), "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freq))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table.of(*shared.value), TaskContext.get().partitionId()
        doc_ids, parts, block, first, n = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            coded = encode_block(whole, table)
            cols = [part, block, first, len(whole), doc_ids, [len(p) for p in parts], LANES, coded.checkpoints, coded.words, crc32(whole.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, schema)], schema=schema)

        for x in batches:
            for d, b in zip(x["doc_id"].to_pylist(), x["ids"]):
                doc_ids.append(d)
                parts.append(np.frombuffer(b.as_py(), kind))
                n += len(parts[-1])
                if n >= BLOCK_IDS:
                    yield close()
                    doc_ids, parts, block, first, n = [], [], block + 1, first + n, 0
        if parts:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("lanes", pa.int32()), ("checkpoints", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())])
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids")]
    # by the id alone: sampled keys pass through the driver, and must not hold ids of whole texts
    ordered = tokens.repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    ordered.mapInArrow(code, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(tokens)


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two runs of bytes put together, from their own and the second's length."""
    # each row: what a single bit of the checksum becomes after so many zero bytes
    rows = [0xEDB88320, *(1 << k for k in range(31))]  # after one zero bit

    def times(m: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v, k = v >> 1, k + 1
        return out

    for _ in range(3):
        rows = [times(rows, r) for r in rows]
    while size:
        if size & 1:
            first = times(rows, first)
        rows, size = [times(rows, r) for r in rows], size >> 1
    return first ^ second


def _lists(row: dict, base: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's documents: where each begins and ends in the block, and its start in the corpus."""
    ends = np.cumsum(np.array(row["sizes"], np.int64))
    starts = ends - row["sizes"]
    return starts, ends, starts + base[row["part"]] + row["first"]


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 [, ids] of each document, decoded from the files; a block whose checksum
    doesn't fit its ids stops the job.

    Blocks are decoded side by side. One of more than LONG_IDS ids, as a very long document makes it, is cut at its
    checkpoints; tasks decode the parts, and the checksums of a document's parts are put together.
    """
    table = [(r["id"], r["frequency"]) for r in spark.read.parquet(f"{path}/table").orderBy("id").toLocalIterator()]
    shared = spark.sparkContext.broadcast((np.array([t[0] for t in table], np.int64), np.array([t[1] for t in table], np.int64)))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # a row for each part of the file
    sizes = sorted((r["part"], r["n"], r["longest"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.max("n_ids").alias("longest")).collect())
    base, upto = {}, 0
    for part, n, _ in sizes:
        base[part], upto = upto, upto + n
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def damaged(row: dict) -> ValueError:
        return ValueError(f"block {row['block']} of part {row['part']} is damaged")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Table.of(*shared.value)
        for x in batches:
            for r in range(x.num_rows):
                row = x.slice(r, 1).to_pylist()[0]
                ids = decode_block(Coded(row["n_ids"], row["checkpoints"], row["words"]), symbols).astype("<u4")
                if crc32(ids.tobytes()) != row["crc32"]:
                    raise damaged(row)
                starts, ends, whole_starts = _lists(row, base)
                each = [ids[s:e] for s, e in zip(starts, ends)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(whole_starts, pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array([crc32(e.tobytes()) for e in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([e.tolist() for e in each], pa.list_(pa.int64()))] * with_ids)], names=names)

    short = blocks.where(F.col("n_ids") <= LONG_IDS).mapInArrow(decode, schema)
    if all(longest <= LONG_IDS for _, _, longest in sizes):
        return short

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each checkpoint of a block: its states, the words up to the next, and how many ids."""
        size = 8 * (LANES + 1)
        for x in batches:
            for r in range(x.num_rows):
                row = x.slice(r, 1).to_pylist()[0]
                marks = row["checkpoints"]
                reads = [int(np.frombuffer(marks, "<u8", 1, k)[0]) for k in range(0, len(marks), size)] + [len(row["words"]) // 4]
                for k in range(len(reads) - 1):
                    n = min(row["n_ids"] - k * CHECKPOINT_STEPS * LANES, CHECKPOINT_STEPS * LANES)
                    states = np.uint64(0).tobytes() + marks[k * size + 8 : (k + 1) * size]
                    yield pa.RecordBatch.from_pylist([{"part": row["part"], "block": row["block"], "segment": k, "n": n, "states": states, "words": row["words"][4 * reads[k] : 4 * reads[k + 1]]}], cut_schema)

    cut_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("segment", pa.int32()), ("n", pa.int64()), ("states", pa.binary()), ("words", pa.binary())])

    def decode_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Table.of(*shared.value)
        for x in batches:
            for r in range(x.num_rows):
                row = x.slice(r, 1).to_pylist()[0]
                ids = decode_block(Coded(row["n"], row["states"], row["words"]), symbols).astype("<u4")
                ends = np.cumsum(np.array(row["sizes"], np.int64)) - row["segment"] * CHECKPOINT_STEPS * LANES
                lo, hi = np.maximum(ends - row["sizes"], 0), np.minimum(ends, len(ids))
                held = np.flatnonzero(hi > lo)
                pieces = [ids[lo[i] : hi[i]] for i in held]
                yield pa.RecordBatch.from_pylist(
                    [{"part": row["part"], "block": row["block"], "segment": row["segment"], "n": len(ids), "crc": crc32(ids.tobytes()), "of": held.tolist(), "lengths": [len(p) for p in pieces], "crcs": [crc32(p.tobytes()) for p in pieces], "ids": ids.tolist() if with_ids else []}], piece_schema
                )

    piece_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("segment", pa.int32()), ("n", pa.int64()), ("crc", pa.int64()), ("of", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                row = x.slice(r, 1).to_pylist()[0]
                whole, crcs = 0, [None] * len(row["doc_ids"])
                for s in row["pieces"]:
                    whole = joined_crc(whole, s["crc"], 4 * s["n"])
                    for i, n, c in zip(s["of"], s["lengths"], s["crcs"]):
                        crcs[i] = c if crcs[i] is None else joined_crc(crcs[i], c, 4 * n)
                if whole != row["crc32"]:
                    raise damaged(row)
                starts, ends, whole_starts = _lists(row, base)
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(whole_starts, pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crcs, pa.int64())]
                ids = [i for s in row["pieces"] for i in s["ids"]]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([ids[s:e] for s, e in zip(starts, ends)], pa.list_(pa.int64()))] * with_ids)], names=names)

    long_ = blocks.where(F.col("n_ids") > LONG_IDS)
    lists = long_.select("part", "block", "doc_ids", "sizes", "first", "crc32")
    segments = long_.mapInArrow(cut, "part int, block int, segment int, n long, states binary, words binary").repartition(partitions(spark), "part", "block", "segment")
    pieces = segments.join(lists.select("part", "block", "sizes"), ["part", "block"]).mapInArrow(decode_segments, "part int, block int, segment int, n long, crc long, of array<long>, lengths array<long>, crcs array<long>, ids array<long>")
    gathered = pieces.groupBy("part", "block").agg(F.array_sort(F.collect_list(F.struct("segment", "n", "crc", "of", "lengths", "crcs", "ids"))).alias("pieces"))
    return short.unionAll(gathered.join(lists, ["part", "block"]).mapInArrow(join, schema))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files (default place: the shared folder) and reads them back."""
    path = path or new_folder(spark, "token-files")
    write_files(spark, docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_files(spark, path)
