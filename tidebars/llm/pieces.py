"""SentencePiece encoding and decoding with batched numpy Viterbi.

The different words of a batch are laid out by length and words of equal length
advance together: at each end position the substrings of every length are
hashed, the hashes probe the sorted piece keys, and the best predecessor is a
vectorised maximum whose backpointer is stored.  Words are the stretches of a
text that no piece crosses, from a space mark to the next.

For a unigram model the score of a path is the sum of its pieces' log
probabilities.  For a BPE model the only path that merging can give is found by
the same recursion: a piece may follow the last piece of the best path before
it if merging keeps the two apart.  Exactly one candidate passes, it takes the
maximum, and the ids are those of the merge procedure.  Whether two pieces stay
apart is worked out once for each pair that is met.

Characters without a piece become byte pieces (or the unknown piece).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.rows import ROW, packed, unpacked, with_row

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
U = np.uint64

#: Different words that a task remembers, and the bytes of text that it takes at a time.
KNOWN_WORDS = 1_000_000
SLICE_BYTES = 4 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            at += 8
        else:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model(NamedTuple):
    """The pieces of a model file with scores and kinds, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    dummy_prefix: bool
    squeeze: bool
    normalizer: str

    @classmethod
    def load(cls, data: bytes) -> Model:
        """From the bytes of a ``.model`` file; its normaliser must be the identity."""
        pieces, scores, kinds = [], [], []
        algorithm, dummy, squeeze, name, rules = UNIGRAM, True, True, "identity", b""
        for number, value in _fields(data):
            if number == 1:
                made = dict(_fields(value))
                pieces.append(made.get(1, b"").decode())
                scores.append(made.get(2, 0.0))
                kinds.append(made.get(3, NORMAL))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                made = dict(_fields(value))
                name, rules = made.get(1, b"").decode(), made.get(2, b"")
                dummy, squeeze = bool(made.get(3, 1)), bool(made.get(4, 1))
        if rules:
            raise ValueError(f"the normaliser {name!r} changes characters; only the identity is known")
        if algorithm not in (UNIGRAM, BPE):
            raise ValueError(f"model type {algorithm} is neither unigram nor BPE")
        return cls(pieces, scores, kinds, algorithm, dummy, squeeze, name)


def _substring_key(sums: np.ndarray, scale: np.ndarray, size) -> np.ndarray:
    """Hash of a substring from the difference of its prefix sums; the high bits are the well mixed ones."""
    return (sums * scale ^ size) * U(0xFF51AFD7ED558CCD)


class Encoder:
    """Tables of a model, made once, and the encoding of batches of texts.

    For BPE every piece has a rank in the order of merging and the two pieces it
    was last merged from.  Two pieces stay apart unless, as both are taken apart
    from their common border in the reverse order of merging, the parts at the
    border were ever to be merged first.
    """

    def __init__(self, model: Model):
        self.model = model
        use = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER_DEFINED) and model.pieces[i]]
        self.ids = {model.pieces[i]: i for i in use}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.bytes = {model.pieces[i]: i for i, k in enumerate(model.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        # A piece with a space mark after another character may cross words; then texts are not cut.
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        points = [np.array([ord(c) for c in p], np.int64) for p in self.ids]
        data = np.concatenate(points) if points else np.zeros(0, np.int64)
        ends = np.cumsum([len(p) for p in points]).astype(np.int64)
        up, down = W.powers(W.WORD_BASE, len(data) + 1)
        sums = np.r_[np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)]
        begins = np.r_[0, ends][: len(ends)].astype(np.int64)
        keys = _substring_key(sums[ends] - sums[begins], down[begins], (ends - begins).astype(U))
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        self.nothing = len(model.pieces)
        self.lengths = np.ones(self.nothing + 1, np.int64)
        self.lengths[list(self.ids.values())] = [len(p) for p in self.ids]
        self.scores = np.array([*model.scores, 0.0])
        self.floor = float(min((model.scores[i] for i in use), default=0.0)) - 10.0
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> U(44)).astype(np.int64)] = True
        inside = np.ones(max(len(data) - 1, 0), bool)  # neighbours within a piece
        inside[ends[:-1] - 1] = False
        self.neighbours = np.zeros(1 << 20, bool)
        pairs = W.mix(data[:-1][inside].astype(U) << U(21) | data[1:][inside].astype(U)) if len(data) > 1 else np.zeros(0, U)
        self.neighbours[(pairs >> U(44)).astype(np.int64)] = True
        self.asked: dict[int, bool] = {}
        if model.algorithm == BPE:
            self._order_merges()
        self._forget()

    def _order_merges(self) -> None:
        """Rank, last merge, and known pairs of all pieces; pieces of equal score are asked one by one."""
        n = self.nothing
        several = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: -self.model.scores[i])
        self.rank = np.zeros(n + 1, np.int64)
        self.rank[several] = np.arange(1, len(several) + 1)
        scores = self.scores[several]
        same = np.r_[False, scores[1:] == scores[:-1]] | np.r_[scores[1:] == scores[:-1], False] if several else np.zeros(0, bool)
        self.tied = np.zeros(n + 1, bool)
        self.tied[np.array(several, np.int64)[same]] = True
        self.whole = np.zeros(n + 1, bool)  # pieces that merging their own characters gives
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs, made = [], []
        for piece, i in self.ids.items():
            last = self.merged(piece, stop=2)
            self.whole[i] = len(piece) == 1 or (len(last) == 2 and all(x in self.ids for x in last))
            if len(last) == 2 and self.whole[i]:
                self.left[i], self.right[i] = self.ids[last[0]], self.ids[last[1]]
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append(a * (n + 1) + b)
                    made.append(i)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        self.known_pair = np.zeros(1 << 20, bool)
        self.known_pair[(W.mix(self.pairs.astype(U)) >> U(44)).astype(np.int64)] = True

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """What merging makes of a short text, best score first and then leftmost, until ``stop`` parts are left."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.model.scores[found] > best):
                    best, at = self.model.scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces merge to; beyond all ranks for none."""
        asked = left * (self.nothing + 1) + right
        out = np.full(len(asked), np.iinfo(np.int64).max)
        maybe = np.flatnonzero(self.known_pair[(W.mix(asked.astype(U)) >> U(44)).astype(np.int64)])
        if len(maybe) and len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, asked[maybe]), len(self.pairs) - 1)
            hit = self.pairs[place] == asked[maybe]
            out[maybe[hit]] = self.rank[self.made[place[hit]]]
        return out

    def _ask(self, left: int, right: int) -> bool:
        pair = left * (self.nothing + 1) + right
        if pair not in self.asked:
            a, b = "" if left == self.nothing else self.model.pieces[left], self.model.pieces[right]
            self.asked[pair] = self.merged(a + b) == ([a, b] if a else [b])
        return self.asked[pair]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces as they are; ``nothing`` on the left merges with no piece."""
        out = self.whole[right] & ((left == self.nothing) | self.whole[left])
        tied = self.tied[left] | self.tied[right]
        if tied.any():
            for i in np.flatnonzero(tied & (left != self.nothing)).tolist():
                out[i] = self._ask(int(left[i]), int(right[i]))
        rows = np.flatnonzero(out & (left != self.nothing) & ~tied)
        a, b = left[rows], right[rows]
        limit = np.full(len(rows), np.iinfo(np.int64).max)
        while len(rows):
            crossed = self._merge(a, b) < limit
            out[rows[crossed]] = False
            # The piece that was merged later comes apart first; a single character can't.
            later = self.rank[a] > self.rank[b]
            stuck = (self.rank[a] == 0) & (self.rank[b] == 0)
            limit = np.where(later, self.rank[a], self.rank[b] + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
            go = ~crossed & ~stuck
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
        return out

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which substring hashes are pieces, and which pieces."""
        maybe = np.flatnonzero(self.table[(keys >> U(44)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == keys[maybe]
        return maybe[hit], self.key_ids[place[hit]]

    def _advance(self, points: np.ndarray) -> np.ndarray:
        """For words of one length (rows of code points): the last piece of the best path to each end.

        Column i holds the piece that ends after i characters: its id, or
        ``nothing`` for a character without one.
        """
        n, length = points.shape
        up, down = W.powers(W.WORD_BASE, length + 2)
        sums = np.zeros((length + 1, n), U)
        np.cumsum((points.T.astype(U) + U(1)) * up[:length, None], axis=0, out=sums[1:])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.full((length + 1, n), self.nothing, np.int64)
        for end in range(1, length + 1):
            chosen, choice, single = best[end], back[end], np.zeros(n, bool)
            # Longest first: where merging decides, the piece that is found is the only one.
            for size in range(min(end, self.longest), 0, -1):
                begin = end - size
                rows, piece = self._lookup(_substring_key(sums[end] - sums[begin], down[begin : begin + 1], U(size)))
                if size == 1:
                    single[rows] = True
                open_ = best[begin, rows] > -np.inf
                if self.model.algorithm == BPE:
                    open_ &= chosen[rows] == -np.inf
                rows, piece = rows[open_], piece[open_]
                if self.model.algorithm == BPE:
                    passed = self.apart(back[begin, rows], piece)
                    rows, piece = rows[passed], piece[passed]
                    score = np.zeros(len(rows))
                else:
                    score = best[begin, rows] + self.scores[piece]
                better = score > chosen[rows]
                chosen[rows[better]], choice[rows[better]] = score[better], piece[better]
            alone = np.flatnonzero(~single & (best[end - 1] > -np.inf))
            score = best[end - 1, alone] + (0.0 if self.model.algorithm == BPE else self.floor)
            better = score > chosen[alone]
            chosen[alone[better]], choice[alone[better]] = score[better], self.nothing
        return back.T

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece has the two characters side by side; may say so of others too."""
        return self.neighbours[(W.mix(left.astype(U) << U(21) | right.astype(U)) >> U(44)).astype(np.int64)]

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words to the table.

        With byte pieces a word is cut wherever no piece has the two characters
        side by side: nothing is ever merged across.  Different parts are worked
        out once.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        cut = np.zeros(len(points), bool)
        if len(self.bytes) == 256:
            cut[1:] = ~self._joins(points[:-1], points[1:])
        cut[begins] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.r_[starts, len(points)])
        _, first, part_of = np.unique(W.span_hashes(points, starts, starts + lengths, W.WORD_BASE), return_index=True, return_inverse=True)
        part_of = part_of.ravel()
        begin, length = starts[first], lengths[first]
        found: list[tuple[np.ndarray, ...]] = []
        for size in np.unique(length).tolist():
            members = np.flatnonzero(length == size)
            step = max(1, (1 << 20) // (size + 1))
            for at in range(0, len(members), step):
                rows = members[at : at + step]
                block = points[begin[rows][:, None] + np.arange(size)]
                row, piece, end = self._trace(self._advance(block))
                found.append((rows[row], end, piece))
                odd = np.unique(row[piece == self.nothing])
                if len(odd):  # parts with characters that have no piece
                    found[-1] = tuple(x[~np.isin(row, odd)] for x in found[-1])
                    found += [self._odd(int(rows[r]), block[r], piece[row == r], end[row == r]) for r in odd.tolist()]
        part, order, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
        place = np.lexsort((order, part))
        ids, count = ids[place].astype(np.int32), np.bincount(part, minlength=len(begin))
        each = count[part_of]
        ends = np.cumsum(each)
        flat = ids[np.repeat((np.cumsum(count) - count)[part_of] - ends + each, each) + np.arange(int(each.sum()))]
        bounds = np.r_[0, ends][np.r_[np.searchsorted(starts, begins), len(starts)]]
        self.flat = np.concatenate([self.flat, flat])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])

    def _odd(self, part: int, points: np.ndarray, piece: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        spelt = [self._spell(chr(points[e - 1])) if p == self.nothing else [p] for p, e in zip(piece.tolist(), end.tolist(), strict=True)]
        ids = np.array(self._joined(spelt, piece == self.nothing), np.int64)
        return np.full(len(ids), part), np.arange(len(ids)), ids

    def _trace(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, piece and end of the best paths, by row and place: the backpointers of all rows followed together."""
        steps, end, live = [], np.full(len(back), back.shape[1] - 1), np.arange(len(back))
        while len(live):
            piece = back[live, end[live]]
            steps.append((live, piece, end[live]))
            end[live] -= self.lengths[piece]
            live = live[end[live] > 0]
        row, piece, at = (np.concatenate([s[k] for s in steps][::-1]) for k in range(3))
        order = np.argsort(row, kind="stable")
        return row[order], piece[order], at[order]

    def _spell(self, char: str) -> list[int]:
        found = [self.bytes.get(f"<0x{b:02X}>") for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found

    def _joined(self, spelt: list[list[int]], alone: np.ndarray) -> list[int]:
        """Neighbouring unknown pieces are one."""
        out: list[int] = []
        before = False
        for ids, odd in zip(spelt, alone.tolist(), strict=True):
            unknown = odd and ids == [self.unknown]
            if not (unknown and before):
                out += ids
            before = unknown
        return out

    def prepared(self, text: str) -> str:
        if self.model.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return SPACE * self.model.dummy_prefix + text.replace(" ", SPACE)

    def split(self, text: str) -> list[str]:
        """Stretches that begin where a space mark follows another character."""
        if not self.cut or not text:
            return [text] if text else []
        parts = text.split(SPACE)
        out, marks = [], 0
        if parts[0]:
            out.append(parts[0])
        for part in parts[1:]:
            marks += 1
            if part:
                out.append(SPACE * marks + part)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each text's begin and end; null and empty texts have none.

        Each different word is worked out once, while there are not too many.
        """
        if len(self.numbers) > KNOWN_WORDS:
            self._forget()
        numbers, before = self.numbers, len(self.numbers)
        found, counts = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.split(self.prepared(text))
                counts[i + 1] = len(words)
                found += [numbers.setdefault(w, len(numbers)) for w in words]
        if len(numbers) > before:
            self._learn(list(numbers)[before:])
        word = np.array(found, np.int64)
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        begins = np.cumsum(self.sizes) - self.sizes
        ids = self.flat[np.repeat(begins[word] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.r_[0, ends][np.cumsum(counts)]


class Decoder:
    """Ids to text: pieces' bytes one after another, space marks as spaces, without the space put first."""

    def __init__(self, model: Model):
        self.prefix = model.dummy_prefix
        made = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:
                made.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                made.append(b"")
            elif kind == UNKNOWN:
                made.append(" ⁇ ".encode())
            else:
                made.append(piece.replace(SPACE, " ").encode())
        self.data = np.frombuffer(b"".join(made), np.uint8)
        self.sizes = np.array([len(m) for m in made], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids in each row; bytes that are no UTF-8 become replacement characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        data = self.data[np.repeat(self.begins[ids] - begins, sizes) + np.arange(int(sizes.sum()))].tobytes()
        bounds = np.r_[0, ends][offsets]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def read_model(path: str) -> Model:
    """From a model file that the driver can read; tasks get it with the job."""
    with open(path, "rb") as file:
        return Model.load(file.read())


def encode(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``into``, the piece ids of each whole text (empty for a null or empty one)."""
    rows = docs.select(packed(keep), F.col(text).alias("text"))

    shared = docs.sparkSession.sparkContext.broadcast(Encoder(model))  # a few MB, by the size of the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for part in W.texts(batches, "text", SLICE_BYTES):
            found, offsets = encoder.encode(part.rows.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([part.rows.column(0), ids], [ROW, "ids"])

    return unpacked(rows.mapInArrow(run, with_row(rows, "ids array<int>")), keep, F.col("ids").alias(into))


def round_trip(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the piece ids ``ids`` of each whole text, and whether these decode to the text, ``exact``.

    As `encode` and then `decode`, in one pass over the texts.  A null text
    counts as an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Encoder(model), Decoder(model)))
    rows = docs.select(packed(keep), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value
        for part in W.texts(batches, "text", SLICE_BYTES):
            texts = part.rows.column(1).to_pylist()
            found, offsets = encoder.encode(texts)
            exact = [a == (b or "") for a, b in zip(decoder.decode(found, offsets), texts, strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([part.rows.column(0), ids, pa.array(exact, pa.bool_())], [ROW, "ids", "exact"])

    return unpacked(rows.mapInArrow(run, with_row(rows, "ids array<int>, exact boolean")), keep, "ids", "exact")


def decode(encoded: DataFrame, model: Model, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), into: str = "text") -> DataFrame:
    """The columns ``keep`` and ``into``, the text of each row's ids (empty for null or none)."""
    rows = encoded.select(packed(keep), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column(1)
                offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
                texts = decoder.decode(column.flatten().to_numpy(), offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [ROW, "text"])

    return unpacked(rows.mapInArrow(run, with_row(rows, "text string")), keep, F.col("text").alias(into))
