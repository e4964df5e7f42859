"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and log scores of a SentencePiece model file lie in a double-array trie
over UTF-8 bytes. A text is a word marker (U+2581) and the text with each space
replaced by that marker. Of all ways to cut it into pieces, the one with the largest
sum of scores wins; a character that is no piece costs the least score less 10 and
is written as its bytes' pieces. Ties go to the way whose last piece is longest, then
the one before it, and so on. Sums are in double precision.

If no piece has a marker after another character, the best way never crosses the
place before a run of markers, so the words between these places are cut on their
own: each distinct one once, many side by side, and remembered. For other models the
text is a single word.

Decoding joins the pieces, makes markers spaces, and drops the first one. Bytes that
are not UTF-8 become U+FFFD.

Defined cases: null and empty texts have no ids and decode to an empty text; U+2581
in a text decodes to a space; ids outside the model are refused. Texts of any length
are encoded whole. Row order, repeated rows and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .pieces import Remembered, cut, text_bytes
from .wordhash import chunks

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CHUNK = 1 << 19


class DoubleArray:
    """Trie of byte strings. The child of state s by byte b is base[s] + b + 1 if check there is s; value is the string's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        room = 1 << 12
        base, check, value = [0] * room, [-1] * room, [-1] * room
        check[0] = 0  # the root is taken
        low = 0
        work = [(0, 0, len(order), 0)]
        while work:
            state, a, b, depth = work.pop()
            if a < b and len(keys[order[a]]) == depth:
                value[state] = order[a]
                a += 1
            kids = []
            while a < b:
                byte, first = keys[order[a]][depth], a
                while a < b and keys[order[a]][depth] == byte:
                    a += 1
                kids.append((byte, first, a))
            if not kids:
                continue
            at, tries = low, 0
            while True:
                while at + 600 > room:
                    base, check, value, room = base + [0] * room, check + [-1] * room, value + [-1] * room, 2 * room
                if all(check[at + k + 1] < 0 for k, _, _ in kids):
                    break
                at, tries = at + 1, tries + 1
            if tries > 64:  # the room before is nearly full; a few slots are given up for a fast build
                low = at
            base[state] = at
            for k, first, last in kids:
                check[at + k + 1] = state
                work.append((at + k + 1, first, last, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def matches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every key that begins at one of the starts and ends by its stop."""
        state, at, found = np.zeros(len(starts), np.int32), starts, []
        while len(at):
            to = self.base[state] + data[at] + 1
            on = self.check[to] == state
            starts, stops, state, at = starts[on], stops[on], to[on], at[on] + 1
            number = self.value[state]
            hit = number >= 0
            found.append((starts[hit], at[hit], number[hit]))
            on = at < stops
            starts, stops, state, at = starts[on], stops[on], state[on], at[on]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


class Model:
    """Pieces, scores and kinds of a model, as the sentencepiece library reads them."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=file)
        size = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        self.scores = [m.get_score(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.by_words = not any(MARK in self.pieces[i].lstrip(MARK) for i in self.plain)
        self.trie = DoubleArray([self.pieces[i].encode() for i in self.plain])


class Unigram(Remembered):
    """Encoder and decoder of a model; one of a worker process."""

    def __init__(self, model: Model):
        super().__init__()
        self.trie, self.by_words = model.trie, model.by_words
        self.ids = np.array(model.plain, np.int64)
        self.scores = np.array([model.scores[i] for i in model.plain], np.float64)
        self.unknown_score = float(self.scores.min(initial=0)) - UNKNOWN_PENALTY
        self.byte_ids = np.array([model.bytes.get(b, model.unknown) for b in range(256)], np.int64)
        spelled = [b"" for _ in model.pieces]
        for i in model.plain:
            spelled[i] = model.pieces[i].replace(MARK, " ").encode()
        for b, i in model.bytes.items():
            spelled[i] = bytes([b])
        spelled[model.unknown] = " ⁇ ".encode()
        self.is_byte = np.zeros(len(spelled), bool)
        self.is_byte[list(model.bytes.values())] = True
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.spelled_begin = np.cumsum(self.spelled_size) - self.spelled_size

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over all words side by side: step p settles the p-th byte of every word."""
        raw = [p.replace(" ", MARK).encode("utf-8", "replace") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(raw)), size)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
        char_end = np.append(heads[1:], len(data))
        stops = (first + size)[word[heads]]
        begin, end, piece = self.trie.matches(data, heads, stops)
        # characters that are no piece by themselves
        ends_of = np.zeros(len(data) + 1, np.int64)
        ends_of[heads] = char_end
        alone = np.zeros(len(data) + 1, bool)
        alone[begin[ends_of[begin] == end]] = True
        odd = ~alone[heads]
        begin, end = np.concatenate([begin, heads[odd]]), np.concatenate([end, char_end[odd]])
        piece = np.concatenate([piece, np.full(int(odd.sum()), -1)])
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # node: word's place + word's number, so that each word has a node before its first byte
        at_word = word[begin]
        source, target, step = begin + at_word, end + at_word, end - first[at_word]
        order = np.lexsort((source, target, step))
        source, target, step, piece, score = (x[order] for x in (source, target, step, piece, score))
        best = np.zeros(len(data) + len(raw) + 1)
        back = np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.diff(step, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(step)], strict=True):
            sums = best[source[a:b]] + score[a:b]
            groups = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            top = np.maximum.reduceat(sums, groups)
            sizes = np.diff(groups, append=b - a)
            places = np.where(sums == np.repeat(top, sizes), np.arange(b - a), b - a)
            chosen = np.minimum.reduceat(places, groups)
            to = target[a:b][groups]
            best[to], back[to] = top, a + chosen
        here, who = first + size + np.arange(len(raw)), np.arange(len(raw))
        here, who = here[size > 0], who[size > 0]
        edges, words = [], []
        while len(here):
            edge = back[here]
            edges.append(edge)
            words.append(who)
            here = source[edge]
            on = here > first[who] + who
            here, who = here[on], who[on]
        if not edges:
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        edges, words = np.concatenate(edges), np.concatenate(words)
        order = np.lexsort((source[edges], words))
        edges, words = edges[order], words[order]
        odd = piece[edges] < 0
        width = np.where(odd, target[edges] - source[edges], 1)
        ids = np.repeat(self.ids[piece[edges]], width)
        byte_at = np.repeat(source[edges] - words, width) + np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        ids = np.where(np.repeat(odd, width), self.byte_ids[data[np.minimum(byte_at, len(data) - 1)]], ids)
        return ids.astype(np.uint32), np.bincount(np.repeat(words, width), minlength=len(raw))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), empty), MARK, " ")
        marked = pc.if_else(pc.equal(spaced, empty), empty, pc.binary_join_element_wise(space, spaced, empty))
        data, offsets = text_bytes(marked)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        begins = begins[:-1]
        if self.by_words:
            space = data == 0x20
            begins[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begins)
        return self.look_up(cut(data, starts), np.diff(np.searchsorted(starts, offsets)))

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of ids, of which text i has lengths[i]."""
        flat = flat.astype(np.int64)
        size = self.spelled_size[flat]
        total = np.cumsum(size)
        raw = self.spelled[np.repeat(self.spelled_begin[flat] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)].tobytes()
        ends = np.concatenate([[0], total])[np.cumsum(lengths)].tolist()
        out, start = [], 0
        for end in ends:
            out.append(raw[start:end].decode("utf-8", "replace").removeprefix(" "))
            start = end
        return out


_unigrams: dict[int, Unigram] = {}


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, ids, n_ids, n_byte_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and round_trip (decoding gives the text). No shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(Model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(model.value)
        if key not in _unigrams:
            _unigrams.clear()
            _unigrams[key] = Unigram(model.value)
        unigram = _unigrams[key]
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, lengths = unigram.encode(part.column(1))
                decoded = unigram.decode(flat, lengths)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(flat.astype("<u4").tobytes())
                spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                bytes_before = np.concatenate([[0], np.cumsum(unigram.is_byte[flat])])
                columns = [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    pa.array(lengths.astype(np.int64)),
                    pa.array((bytes_before[offsets[1:]] - bytes_before[offsets[:-1]]).astype(np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
