"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text becomes symbols, and an agenda of adjacent pairs ordered by piece score (ties: leftmost
first) says which pair merges next, until no adjacent pair is a piece. Merges never cross into a
space that follows another character, as no piece has a space there, so the texts of an Arrow
batch are cut into space-led chunks; the agendas of all distinct short chunks advance side by
side as rows of numpy matrices, long chunks have a heap each. In every Arrow batch the documents
are also encoded and decoded by the sentencepiece library; where the two differ, the library's
result stands and an accumulator counts it.

Defined cases: null text counts as empty and gives no ids; a character that no piece has falls
back to the byte pieces of its UTF-8 form; repeated rows are coded each; other columns stay.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, span_hashes

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class MergeVocabulary:
    """Tables of a BPE model: symbol of each code point, rank and result of each pair that merges."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # what the codec takes for granted: no character is rewritten, spaces stay, one is put first
        probe = "  ａ ﬁ é e\u0301 Å  b  "
        if sp.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("the model normalises texts; this codec needs identity normalization with a leading space")
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in normal):
            raise ValueError("a piece has a space after another character; this codec needs merge-type pieces led by spaces")
        symbol = {sp.id_to_piece(i): i for i in normal}
        for c in sorted({c for p in symbol for c in p} - symbol.keys()):
            symbol[c] = len(symbol) + size  # only ever merged, never a result
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.size = size
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.space = int(self.of_char[ord(SPACE)])
        self.of_char[ord(" ")] = self.space
        by_score = sorted({sp.get_score(i) for i in normal}, reverse=True)
        rank_of = {s: r for r, s in enumerate(by_score)}
        keys, ranks, results = [], [], []
        for p, i in symbol.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    keys.append(symbol[p[:cut]] << 32 | symbol[p[cut:]])
                    ranks.append(rank_of[sp.get_score(i)])
                    results.append(i)
        self._index(np.array(keys, np.uint64), np.array(ranks, np.int32), np.array(results, np.int32))
        self.raw = [b""] * size
        for i in normal:
            self.raw[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self.led = {i for i in normal if sp.id_to_piece(i).startswith(SPACE)}

    def _index(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks, self.results = np.full(1 << bits, NONE), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[at], self.ranks[at], self.results[at] = keys[put], ranks[put], results[put]
            stay = ~np.isin(left, put)
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank NONE where it does not merge."""
        shape = a.shape
        a, b = np.ravel(a), np.ravel(b)
        keys = a.astype(np.uint32).astype(np.uint64) << np.uint64(32) | b.astype(np.uint32).astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        off = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(off):
            slot[off] = (slot[off] + 1) & self.mask
            found = self.keys[slot[off]]
            off = off[(found != keys[off]) & (found != np.uint64(2**64 - 1))]
        return self.ranks[slot].reshape(shape), self.results[slot].reshape(shape)

    def merge_rows(self, m: np.ndarray, n: np.ndarray) -> None:
        """Run the agendas of all rows of ``m`` (symbols, padded by -2) to their ends, in place;
        ``n`` gets the rows' new lengths."""
        width = m.shape[1]
        if width < 2:
            return
        rank, result = self.pair(m[:, :-1], m[:, 1:])
        live = np.arange(len(m))
        work = m.copy()
        column = np.arange(width)[None, :]
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            go = rank[rows, at] != NONE
            if not go.all():
                done = ~go
                m[live[done]] = work[done]
                live, work, rank, result, at = live[go], work[go], rank[go], result[go], at[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            merged = result[rows, at]
            beyond = column > at[:, None]
            moved = np.concatenate([work[:, 1:], np.full((len(live), 1), -2, np.int32)], 1)
            work = np.where(beyond, moved, work)
            work[rows, at] = merged
            gap = beyond[:, :-1]
            pad = np.full((len(live), 1), NONE, np.int32)
            rank = np.where(gap, np.concatenate([rank[:, 1:], pad], 1), rank)
            result = np.where(gap, np.concatenate([result[:, 1:], pad], 1), result)
            for step in (-1, 0):
                p = at + step
                ok = (p >= 0) & (p < width - 1)
                r, q = rows[ok], p[ok]
                rank[r, q], result[r, q] = self.pair(work[r, q], work[r, q + 1])
            n[live] -= 1

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One chunk's agenda as a heap of (rank, position) over a linked list."""
        s = list(symbols)
        before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(at: np.ndarray, nxt: np.ndarray) -> None:
            rank, result = self.pair(np.array([s[i] for i in at], np.int32), np.array([s[i] for i in nxt], np.int32))
            for i, j, r, to in zip(at, nxt, rank.tolist(), result.tolist()):
                if r != NONE:
                    heapq.heappush(agenda, (r, i, s[i], s[j], to))

        add(range(len(s) - 1), range(1, len(s)))
        while agenda:
            _, i, a, b, to = heapq.heappop(agenda)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = to, -9
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            pairs = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y >= 0]
            if pairs:
                add([x for x, _ in pairs], [y for _, y in pairs])
        return [x for x in s if x != -9]

    def encode(self, texts: list[str], long: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and each text's offset."""
        joined = "".join(" " + t if t else "" for t in texts)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sym = self.of_char[chars]
        head = np.zeros(len(sym), bool)
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        head[text_at[:-1][sizes > 0]] = True
        head[1:] |= (sym[1:] == self.space) & (sym[:-1] != self.space)
        unknown = sym < 0
        head |= unknown
        head[1:] |= unknown[:-1]
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(sym))
        # an unknown character's symbol is its own code point, beyond all others
        coded = np.where(unknown, chars.astype(np.int64) + (1 << 24), sym)
        _, first, inverse = np.unique(span_hashes(coded, starts, ends), return_index=True, return_inverse=True)
        sizes_, twin = ends - starts, first[inverse]
        alike = (sizes_ == sizes_[twin]).all() and (coded == coded[np.arange(len(coded)) + np.repeat(starts[twin] - starts, sizes_)]).all()
        if not alike:  # chunks of one hash that differ: each stands for itself
            first = inverse = np.arange(len(starts))
        u_start, u_len = starts[first], (ends - starts)[first]
        out: list[np.ndarray] = []
        order: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        lone = unknown[u_start]
        low = 1
        for width in (2, 4, 6, 8, 10, 12, 16, 24, 32, long):
            pick = np.flatnonzero(~lone & (u_len >= low) & (u_len <= width))
            low = width + 1
            if not len(pick):
                continue
            n = u_len[pick].copy()
            at = u_start[pick][:, None] + np.arange(width)[None, :]
            m = sym[np.minimum(at, len(sym) - 1)]
            m[np.arange(width)[None, :] >= n[:, None]] = -2
            self.merge_rows(m, n)
            out.append(m[np.arange(width)[None, :] < n[:, None]])
            order.append(pick)
            lens.append(n)
        for k in np.flatnonzero(~lone & (u_len > long)):
            got = self.merge_long(sym[u_start[k] : u_start[k] + u_len[k]].tolist())
            out.append(np.array(got, np.int32))
            order.append(np.array([k]))
            lens.append(np.array([len(got)]))
        for k in np.flatnonzero(lone):
            got = self.byte_id[np.frombuffer(chr(chars[u_start[k]]).encode(), np.uint8)]
            out.append(got)
            order.append(np.array([k]))
            lens.append(np.array([len(got)]))
        flat = np.concatenate(out)
        n_of, at_of = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        which, n_all = np.concatenate(order), np.concatenate(lens)
        n_of[which] = n_all
        at_of[which] = np.concatenate([[0], np.cumsum(n_all)[:-1]])
        each = n_of[inverse]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(at_of[inverse] - upto[:-1], each) + np.arange(upto[-1])]
        ids, upto = self._bytes_for_inner(ids, upto)
        return ids, upto[np.searchsorted(starts, text_at)]

    def _bytes_for_inner(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left-over symbols that are no pieces themselves become byte pieces (a model whose
        pieces hold characters that are not pieces)."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, upto
        back = {int(i): chr(c) for c, i in enumerate(self.of_char.tolist()) if i >= self.size}
        parts, grown, last = [], np.zeros(len(ids) + 1, np.int64), 0
        for k in odd:
            raw = self.byte_id[np.frombuffer(back[int(ids[k])].encode(), np.uint8)]
            parts += [ids[last:k], raw]
            grown[k + 1 :] += len(raw) - 1
            last = k + 1
        return np.concatenate([*parts, ids[last:]]), upto + grown[upto]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the space that encoding put first is dropped, and a byte that is
        not valid UTF-8 becomes U+FFFD."""
        raw = b"".join([self.raw[i] for i in ids])
        if ids and ids[0] in self.led:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> MergeVocabulary:
    return MergeVocabulary(model)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", check_every: int = 1, differing: Accumulator | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (string) instead of the text column.

    The model file is read on the driver and sent with the job (its size is the vocabulary's, not
    the data's). ``check_every``: in each Arrow batch the documents whose text has a crc32 that
    this number divides are compared with the library; 1 compares all, 0 none. Texts that differ get
    the library's result and add one to ``differing`` (tasks that run again count again)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for begin, end in slices(column):
                texts = [t or "" for t in column.slice(begin, end - begin).to_pylist()]
                ids, at = vocab.encode(texts)
                flat = ids.tolist()
                decoded = [vocab.decode(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                amended: dict[int, list[int]] = {}
                if check_every:
                    some = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % check_every == 0]
                    for i, right in zip(some, vocab.library.encode([texts[i] for i in some], num_threads=1)):
                        if right != flat[at[i] : at[i + 1]] or vocab.library.decode(right) != decoded[i]:
                            amended[i], decoded[i] = right, vocab.library.decode(right)
                    if amended and differing is not None:
                        differing.add(len(amended))
                if amended:
                    each = [amended.get(i, flat[a:b]) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]
                    ids, at = np.array([x for r in each for x in r], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in each])])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                rest = [batch.column(batch.schema.get_field_index(c)).slice(begin, end - begin) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.select(*kept, F.col(text)).mapInArrow(run, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` returns."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
