"""SentencePiece encoding and decoding (6) by suffix-array matching.

The distinct segments of a batch of texts are concatenated and indexed by a suffix array, sorted as deep as the longest piece.
Every piece of the vocabulary is found by binary search: its range of suffixes lists all its occurrences. Each occurrence is an
edge (start, length, piece); edges are laid out by position, and the relaxation walks over them: as the model is a
byte-pair one, it starts from single characters and takes, segment by segment, the edge of the best score that joins two
neighbouring symbols, the leftmost of equals, until none is left.

Segments: a text is cut between two characters that stand next to each other in no piece. No edge crosses such a cut, so
segments are independent, equal segments are encoded once, and results are those of the whole text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_INF = np.int64(1) << 40
#: Bytes of text that one step handles, and characters of distinct segments that one suffix array indexes.
STEP_CHARS, INDEX_CHARS = 500_000, 150_000
#: Segments kept between steps, each of at most so many characters; longer segments are relaxed with a heap.
KEPT_SEGMENTS, KEPT_CHARS, HEAP_CHARS = 200_000, 64, 2_000


@dataclass(frozen=True)
class Pieces:
    """A vocabulary, as read from the model file: small and of fixed size, it travels with the task."""

    text: tuple[str, ...]
    score: np.ndarray
    normal: np.ndarray  #: pieces that text can become (neither control, unknown nor byte)
    byte: np.ndarray  #: of each byte value, its piece or -1
    unknown: int
    prefix: bool  #: a blank is put before each text

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model without text normalisation is wanted")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = tuple(sp.id_to_piece(i) for i in range(n))
        byte = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                byte[int(text[i][3:5], 16)] = i
        normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)])
        return Pieces(text, np.array([sp.get_score(i) for i in range(n)]), normal, byte, sp.unk_id(), m.normalizer_spec.add_dummy_prefix)


class Matcher:
    """Encodes and decodes; keeps what depends on the vocabulary alone, and a bounded store of segments."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        many = [i for i, t in enumerate(pieces.text) if pieces.normal[i] and len(t) > 1]
        self.single = {t: i for i, t in enumerate(pieces.text) if pieces.normal[i] and len(t) == 1}
        chars = sorted({c for i in many for c in pieces.text[i]})
        if len(chars) >= 1 << 16:
            raise ValueError("too many characters for 16 bits")
        self.cls = np.zeros(0x110000, np.uint16)  # 0: in no piece of several characters
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.longest = max((len(pieces.text[i]) for i in many), default=2)
        self.words = -(-self.longest // 4)
        self.piece_id = np.array(many, np.int64)
        self.piece_len = np.array([len(pieces.text[i]) for i in many], np.int64)
        rows = np.zeros((len(many), 4 * self.words), np.uint64)
        for r, i in enumerate(many):
            own = self.cls[[ord(c) for c in pieces.text[i]]]
            rows[r, : len(own)] = own
            self.beside[own[:-1], own[1:]] = True
        self.piece_words = _packed(rows.reshape(len(many), self.words, 4))
        held = (np.arange(4 * self.words)[None, :] < self.piece_len[:, None]) * np.uint64(0xFFFF)
        self.piece_masks = _packed(held.reshape(len(many), self.words, 4))
        # a better score is a smaller rank; equal scores have equal ranks
        self.rank = np.full(len(pieces.text) + 1, _INF)
        self.rank[:-1] = np.unique(-pieces.score, return_inverse=True)[1]
        self.raw = [self._raw(i) for i in range(len(pieces.text))]
        self.store: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def _raw(self, i: int) -> bytes:
        p = self.pieces
        if i == p.unknown:
            return " ⁇ ".encode()
        at = np.nonzero(p.byte == i)[0]
        return bytes([at[0]]) if len(at) else p.text[i].encode() if p.normal[i] else b""

    # -- matching

    def _suffixes(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array of t, sorted by at least `longest` characters; four characters from each place packed)."""
        n = len(t)
        pad = np.concatenate([t, np.zeros(4 * self.words + 8, t.dtype)]).astype(np.uint64)
        four = (pad[:-3] << np.uint64(48)) | (pad[1:-2] << np.uint64(32)) | (pad[2:-1] << np.uint64(16)) | pad[3:]
        key, depth = four[:n], 4
        while True:
            order = np.argsort(key, kind="stable")
            if depth >= self.longest:
                return order, four
            own = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
            after = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, n), np.int64)])[:n]
            key, depth = rank * (n + 1) + after, 2 * depth

    def _range(self, suffixes: np.ndarray, four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, where its occurrences begin and end in the suffix array: two binary searches, all pieces at once."""
        out = []
        for upper in (False, True):
            lo, hi = np.zeros(len(self.piece_id), np.int64), np.full(len(self.piece_id), len(suffixes))
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = suffixes[np.minimum(mid, len(suffixes) - 1)]
                below, level = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for w in range(self.words):
                    there = four[at + 4 * w] & self.piece_masks[:, w]
                    below |= level & (there < self.piece_words[:, w])
                    level &= there == self.piece_words[:, w]
                go = open_ & (below | (level & upper))
                lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            out.append(lo)
        return out[0], out[1]

    def _edges(self, t: np.ndarray) -> np.ndarray:
        """edges[place, length - 2]: the piece of that length that stands there, or one past the last piece."""
        suffixes, four = self._suffixes(t)
        lo, hi = self._range(suffixes, four)
        n = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = np.full((len(t), self.longest - 1), len(self.pieces.text), np.int32)
        out[suffixes[first], np.repeat(self.piece_len, n) - 2] = np.repeat(self.piece_id, n)
        return out

    # -- relaxation

    def _relax(self, edges: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments [starts, ends) -> all symbols' (start, end), in order. One merge for each segment and round."""
        none = len(self.pieces.text)
        n = ends - starts
        seg = np.repeat(np.arange(len(n)), n)
        s = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        e = s + 1
        done_s, done_e = [], []
        while len(s):
            length = np.zeros(len(s), np.int64)
            length[:-1] = np.where(seg[1:] == seg[:-1], e[1:] - s[:-1], 0)
            fits = (length > 1) & (length <= self.longest)
            piece = np.where(fits, edges[s, np.where(fits, length - 2, 0)], none)
            key = self.rank[piece] * len(s) + np.arange(len(s))  # the leftmost of equals
            first = np.concatenate([[0], np.nonzero(seg[1:] != seg[:-1])[0] + 1])
            best = np.minimum.reduceat(key, first)
            goes = best < _INF * len(s)
            at = best[goes] % len(s)
            e[at] = e[at + 1]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            count = np.diff(np.concatenate([first, [len(s)]]))
            rest = np.repeat(goes, count)
            if not goes.all():
                done_s.append(s[~rest])
                done_e.append(e[~rest])
            keep &= rest
            s, e, seg = s[keep], e[keep], seg[keep]
        s, e = np.concatenate(done_s), np.concatenate(done_e)
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _relax_long(self, edges: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        """The same for one long segment, with a heap."""
        right, left, alive, end = {}, {}, {}, {}
        for i in range(a, b):
            right[i], left[i], alive[i], end[i] = i + 1, i - 1, True, i + 1
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < b and (n := end[j] - i) <= self.longest and (r := int(self.rank[edges[i, n - 2]])) < _INF:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(a, b - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= b or end[j] != stop or end[i] != j:
                continue
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[i] < b:
                left[right[i]] = i
            offer(i)
            if left[i] >= a:
                offer(left[i])
        return [(i, end[i]) for i in range(a, b) if alive[i]]

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that are not in the store and put them there."""
        at = 0
        while at < len(segments):
            stop, size = at, 0
            while stop < len(segments) and (stop == at or size + len(segments[stop]) < INDEX_CHARS):
                size += len(segments[stop]) + 1
                stop += 1
            self._index("\0".join(segments[at:stop]), segments[at:stop])
            at = stop

    def _index(self, text: str, segments: list[str]) -> None:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = self._edges(self.cls[codes])
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        long = sizes > HEAP_CHARS
        s, e = self._relax(edges, starts[~long], (starts + sizes)[~long])
        for i in np.nonzero(long)[0]:
            more = np.array(self._relax_long(edges, int(starts[i]), int(starts[i] + sizes[i])), np.int64)
            s, e = np.concatenate([s, more[:, 0]]), np.concatenate([e, more[:, 1]])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        wide = e - s > 1
        ids = np.empty(len(s), np.int64)
        ids[wide] = edges[s[wide], (e - s)[wide] - 2]
        lone, back = np.unique(codes[s[~wide]], return_inverse=True)
        own = np.array([self.single.get(chr(c), -1 - c) for c in lone.tolist()], np.int64)
        ids[~wide] = own[back] if len(own) else 0
        parts = np.searchsorted(s, starts)
        unknown = ids < 0
        if unknown.any():  # a character without a piece becomes its bytes
            spelled = {c: self._bytes(chr(-1 - c)) for c in np.unique(ids[unknown]).tolist()}
            n = np.ones(len(ids), np.int64)
            n[unknown] = [len(spelled[c]) for c in ids[unknown].tolist()]
            place = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(place[-1], np.int64)
            out[place[:-1][~unknown]] = ids[~unknown]
            for i, c in zip(np.nonzero(unknown)[0].tolist(), ids[unknown].tolist()):
                out[place[i] : place[i + 1]] = spelled[c]
            ids, parts = out, place[parts]
        ids = ids.astype(np.int32)
        bounds = [*parts.tolist(), len(ids)]
        for seg, a, b in zip(segments, bounds, bounds[1:]):
            self.store[seg] = len(self.ids)
            self.ids.append(ids[a:b].copy())

    def _bytes(self, char: str) -> list[int]:
        own = [int(self.pieces.byte[b]) for b in char.encode()]
        return [self.pieces.unknown] if -1 in own else own

    # -- texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]. An empty text has none."""
        if len(self.store) > KEPT_SEGMENTS:
            self.store, self.ids = {}, []
        lead = SPACE if self.pieces.prefix else ""
        whole = [lead + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        text = "".join(whole)
        c = self.cls[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(c) + 1, bool)
        if len(c):
            cut[1:-1] = ~self.beside[c[:-1], c[1:]]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut[ends] = True
        at = np.nonzero(cut)[0]
        places = at.tolist()
        segments = [text[a:b] for a, b in zip(places, places[1:])]
        store = self.store
        met = list(map(store.get, segments))
        new = list(dict.fromkeys(x for x, i in zip(segments, met) if i is None))
        self._learn(new)
        if new:
            met = [store[x] if i is None else i for x, i in zip(segments, met)]
        index = np.array(met, np.int64)
        used, back = np.unique(index, return_inverse=True)
        own = [self.ids[i] for i in used.tolist()]
        n = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.concatenate(own) if own else np.zeros(0, np.int32)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        count = n[back]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begin[back] - total[:-1], count) + np.arange(total[-1])]
        for x in new:  # long segments are seldom met again
            if len(x) > KEPT_CHARS:
                self.ids[store.pop(x)] = flat[:0]
        return total[np.searchsorted(at, ends)], ids

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes put together, bytes that are no UTF-8 replaced, blanks restored, and the blank
        that encoding put in front taken off."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def _packed(rows: np.ndarray) -> np.ndarray:
    r = rows.astype(np.uint64)
    return (r[..., 0] << np.uint64(48)) | (r[..., 1] << np.uint64(32)) | (r[..., 2] << np.uint64(16)) | r[..., 3]


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most STEP_CHARS together, or of one longer text."""
    a = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > STEP_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    yield a, len(sizes)


def encode_documents(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, ids, n_tokens, round_trip): the piece ids of every whole text, and whether decoding them gives the text
    back. One pass, no shuffle; a task holds a few million characters of text and a bounded store of segments at a time.
    Null and empty texts have no ids and return as the empty text. A text with U+2581 does not come back: decoding makes it a
    blank, as the library does. Repeated rows are encoded alike; an empty table gives no rows; other columns are not read."""

    def run(batches):
        matcher = Matcher(pieces)
        for b in slices(batches, 1 << 30):
            column = b.column(1)
            for x, y in _steps(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
                texts = [t or "" for t in column.slice(x, y - x).to_pylist()]
                offsets, ids = matcher.encode(texts)
                at = offsets.tolist()
                back = [matcher.decode(ids[p:q].tolist()) == t for t, p, q in zip(texts, at, at[1:])]
                columns = [b.column(0).slice(x, y - x), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offsets), pa.int64()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """-> (doc_id, text): the inverse of encode_documents. Null ids give the empty text."""

    def run(batches):
        matcher = Matcher(pieces)
        for b in batches:
            texts = [matcher.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """model: a vocabulary file, read on the driver alone; what it holds travels with the tasks."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Pieces.load(model))
