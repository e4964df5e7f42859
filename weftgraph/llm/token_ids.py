"""Token ids in a file of Simple-8b words.

A block is a row of a Parquet file: the documents that it holds whole, and their
ids one after another in 64-bit words. The high four bits of a word are its
selector; the others hold a fixed number of ids of a fixed width:

    selector  1   2   3   4   5   6   7   8   9  10  11  12  13  14  15
    ids     120  60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits      0   1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 0 stands for one id that needs more than 60 bits; these ids lie, in
order, in the block's ``escapes``. Packing starts anew after every LANE ids, and
``lanes`` has the first word of each such lane; so lanes of many documents are
packed side by side and a reader can start at any of them. Words are little-endian.

Rows of a shard are in ascending order of doc_id, as are the shards; ``start`` of
a block is the number of ids before it in its shard.

Defined cases: null text is empty text, rows whose doc_id is null take no part,
documents that share a doc_id lie side by side, an empty table gives no block. A
text of any length is encoded whole and ends up in one block.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .pieces import Remembered, cut, text_bytes
from .wordhash import chunks

COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
LANE = 256
#: The least value that needs more bits than selectors 1, 2, ... 15 give; ids are compared with these.
_WIDTHS = np.array([1 << b for b in BITS[1:].tolist()], np.uint64)
#: A block is closed after the document with which it reaches so many ids.
BLOCK_IDS = 1 << 16
#: Bytes of text whose pieces are looked up together, one text at least.
ENCODED_AT_ONCE = 4 << 20

BLOCKS = "shard int, block int, start long, doc_ids array<long>, lengths array<int>, lanes array<int>, words binary, escapes binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and the first word of each lane of an array of non-negative integers below 2**64."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    left = np.minimum(LANE - np.arange(n) % LANE, n - np.arange(n)).astype(np.int16)
    need = np.searchsorted(_WIDTHS, ids, side="right").astype(np.int8)  # the place in BITS of the narrowest width
    best = np.zeros(n, np.int8)
    widest, have = need, 1  # of so many ids from here on
    for selector in range(15, 0, -1):  # later ones hold more ids and win
        count = int(COUNTS[selector])
        while have < count:
            more = min(have, count - have)
            if len(widest) <= more:
                break
            widest, have = np.maximum(widest[:-more], widest[more:]), have + more
        if have < count:
            break
        fits = np.flatnonzero((widest < selector) & (left[: len(widest)] >= count))
        if not len(fits):  # then more ids of fewer bits don't fit either
            break
        best[fits] = selector
    step = COUNTS[best]
    # all lanes advance side by side
    here = np.arange(0, n, LANE)
    stop = np.minimum(here + LANE, n)
    begins = []
    while len(here):
        begins.append(here)
        here = here + step[here]
        on = here < stop
        here, stop = here[on], stop[on]
    begins = np.sort(np.concatenate(begins))
    lanes = np.searchsorted(begins, np.arange(0, n, LANE)).astype(np.int32)
    selectors = best[begins].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in range(2, 16):
        hit = np.flatnonzero(selectors == selector)
        if len(hit):
            count, bits = int(COUNTS[selector]), int(BITS[selector])
            values = ids[begins[hit][:, None] + np.arange(count)]
            words[hit] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, ids[begins[selectors == 0]], lanes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The integers of pack(); for words of several lanes or a single one alike."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in range(2, 16):
        hit = np.flatnonzero(selectors == selector)
        if len(hit):
            count, bits = int(COUNTS[selector]), int(BITS[selector])
            values = (words[hit][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            out[at[hit][:, None] + np.arange(count)] = values
    out[at[selectors == 0]] = escapes
    return out


LETTER, NUMBER, SPACE, OTHER, ODD = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of single bytes, and of characters of two bytes below U+02B0, on which all versions of Unicode agree."""
    byte = np.full(256, ODD, np.uint8)
    byte[[9, 10, 13, 32]] = SPACE
    byte[0x21:0x7F] = OTHER
    by_category = {"L": LETTER, "N": NUMBER, "Z": ODD, "C": ODD}
    char = np.array([by_category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x2B0)], np.uint8)
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        byte[ord(first) : ord(last) + 1] = char[ord(first)]
    return byte, np.append(char, np.full(0x800 - 0x2B0, ODD, np.uint8))


_BYTE_KIND, _CHAR_KIND = _kinds()


def kinds(data: np.ndarray) -> np.ndarray:
    """For every byte, the kind of its character. ODD ones are left to the library, as are texts that hold them."""
    kind = _BYTE_KIND[data]
    for least, most, extra in ((0xC2, 0xDF, 1), (0xE2, 0xE2, 2)):
        at = np.flatnonzero((data >= least) & (data <= most))
        if len(at):
            second = data[at + 1].astype(np.int64)
            if extra == 1:
                of = _CHAR_KIND[((data[at].astype(np.int64) & 0x1F) << 6) | (second & 0x3F)]
            else:  # U+2010 to U+2027: dashes, quotes, bullets and dots
                third = data[at + 2]
                of = np.where((second == 0x80) & (third >= 0x90) & (third <= 0xA7), OTHER, ODD).astype(np.uint8)
            for k in range(extra + 1):
                kind[at + k] = of
    return kind


def piece_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces begin into which the byte-level vocabulary splits texts before it merges.

    A piece is a run of letters, of digits or of other characters, with one space before
    it, or white space: a run of it up to the last one before something else, or that last
    one if it isn't a space. An apostrophe that begins a piece takes s, t, m, d, re, ve or
    ll along, and nothing more.
    """
    n = len(data)
    head = np.zeros(n + 1, bool)  # of a text
    head[offsets] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~head[1:n])
    start[last] = True
    start[last[data[last] == 0x20] + 1] = False
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[~head[quote + 1]]
    if len(quote):
        after = np.append(data, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        width = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        for pair in (b"re", b"ve", b"ll"):
            width[(one == pair[0]) & (two == pair[1]) & ~head[quote + 2]] = 2
        quote, width = quote[width > 0], width[width > 0]
        start[quote + 1] = False
        then = quote + width + 1
        then = then[then < n]
        start[then[kind[then] == LETTER]] = True
    return np.flatnonzero(start)


class Encoder(Remembered):
    """Texts to ids with the tokenizers library. A text of odd characters, or with a special token's string, is encoded as a whole."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids whose bytes begin with a space
        self.opens_word[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a space and letters are encoded as one text, as that splits before each space again; others one by one."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        ids = np.fromiter(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32) if words else np.zeros(0, np.uint32)
        first = np.flatnonzero(self.opens_word[ids])
        if len(first) != len(words):  # a vocabulary that doesn't keep the spaces apart
            return self.encode(pieces)
        if len(words) == len(pieces):
            return ids, np.diff(first, append=len(ids))
        word = np.fromiter((p[0] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        other_ids, other_sizes = self.encode([p for p, w in zip(pieces, word.tolist(), strict=True) if not w])
        sizes = np.zeros(len(pieces), np.int64)
        sizes[word], sizes[~word] = np.diff(first, append=len(ids)), other_sizes
        of_word, flat = np.repeat(word, sizes), np.zeros(len(ids) + len(other_ids), np.uint32)
        flat[of_word], flat[~of_word] = ids, other_ids
        return flat, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = kinds(data)
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)
        whole[np.searchsorted(offsets, np.flatnonzero(kind == ODD), side="right") - 1] = True
        if whole.any():
            return self.some_whole(texts, whole)
        starts = piece_starts(data, offsets, kind)
        return self.look_up(cut(data, starts), np.diff(np.searchsorted(starts, offsets)))

    def some_whole(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.zeros(len(texts), np.int64)
        ids, lengths[whole] = self.encode(texts.filter(pa.array(whole)).to_pylist())
        rest, lengths[~whole] = self(texts.filter(pa.array(~whole)))
        from_whole, flat = np.repeat(whole, lengths), np.zeros(len(ids) + len(rest), np.uint32)
        flat[from_whole], flat[~from_whole] = ids, rest
        return flat, lengths


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One of a worker process."""
    if vocabulary not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _block(shard: int, block: int, start: int, doc_ids: list, lengths: list, ids: list) -> pa.RecordBatch:
    words, escapes, lanes = pack(np.concatenate(ids))
    columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([np.concatenate(doc_ids)], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int32())), pa.array([lanes], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([escapes.astype("<u8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "start", "doc_ids", "lengths", "lanes", "words", "escapes"])


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20) -> None:
    """Encodes and writes all documents. One shuffle, of the texts by ranges of the id."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_file).read_text())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, lengths, ids = [], [], []
        encode = encoder(vocabulary.value)
        for batch in batches:
            for part in chunks(batch, "text", ENCODED_AT_ONCE):
                flat, n = encode(part.column(1))
                if end_id is not None:
                    flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                done = 0
                while len(n):
                    # up to the document with which the block is full
                    most = int(np.searchsorted(held + np.cumsum(n), BLOCK_IDS)) + 1
                    took = int(n[:most].sum())
                    doc_ids.append(part.column(0).to_numpy(zero_copy_only=False)[done : done + most])
                    lengths.append(n[:most].astype(np.int32))
                    ids.append(flat[:took])
                    held += took
                    done, flat, n = done + most, flat[took:], n[most:]
                    if held >= BLOCK_IDS:
                        yield _block(shard, block, start, doc_ids, lengths, ids)
                        block, start, held = block + 1, start + held, 0
                        doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield _block(shard, block, start, doc_ids, lengths, ids)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(encode, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_ids(spark, path: str, what: str = "crc32") -> DataFrame:
    """Documents of a written folder: doc_id, start, n_tokens, and ids (array) or ids_crc32, as ``what`` says.

    The starts of shards come from one sum a shard; each block is decoded by itself.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    bound_batches(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: E731, B023
                doc_ids, lengths = one("doc_ids").values, one("lengths").values.to_numpy()
                flat = unpack(np.frombuffer(one("words").as_buffer(), "<u8"), np.frombuffer(one("escapes").as_buffer(), "<u8"))
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths + one("start").as_py()
                if what == "ids":
                    last = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat.astype(np.int64)))
                else:
                    raw = memoryview(flat.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())
                shard = pa.array(np.full(len(lengths), one("shard").as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([shard, doc_ids.cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), last], names=["shard", "doc_id", "local", "n_tokens", last_name])

    last_name = "ids" if what == "ids" else "ids_crc32"
    rows = blocks.mapInArrow(decode, f"shard int, doc_id long, local long, n_tokens long, {last_name} {'array<long>' if what == 'ids' else 'long'}")
    sums = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # a row for each shard: as many as the writer had tasks
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", last_name)


def run(docs: DataFrame, tokenizer_file: str, end_id: int | None = 2) -> DataFrame:
    """Writes the file of all documents into the shared folder and returns what reading it back gives."""
    scratch = Scratch(docs.sparkSession, "token-ids")
    write_ids(docs, scratch.path("ids"), tokenizer_file, end_id)
    return read_ids(docs.sparkSession, scratch.path("ids"))
