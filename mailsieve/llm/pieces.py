"""SentencePiece encoding that keeps offsets: normalisation by longest prefixes, merges, and each piece's bytes in the text.

A model file is read as what it is, a protocol buffer: pieces with scores, and a normaliser whose compiled character map is
a double-array trie over UTF-8 with a table of replacements. Normalising takes the longest prefix in the map (else one
character), and notes for every character that comes out where its source began. Pieces are made of whole characters of
the normalised text, so the notes project each piece to a span of bytes of the original text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices

SPACE = "▁"  # how models write a space
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Segments up to this length are merged by scanning for the best pair; longer ones with a heap. So many ids are projected and decoded as arrays.
SHORT = 48
#: Chunks and segments up to this length are remembered; of each at most twice so many.
REMEMBERED, MOST = 64, 500_000
#: Ids that are decoded at once.
BLOCK = 1 << 16
#: A text is cut before runs of spaces, where no piece and no rule of the map can reach across.
CHUNKS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; 32 and 64 bit values as bytes."""
    at, end = 0, len(message)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a normaliser. In a unit of its trie, bits 0 to 7 and 31 are the label, bit 8 says that a key ends
    here (the value is the unit at the offset), bits 9 to 30 are the offset. Values are places in the table of replacements.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = array("I", compiled[4 : 4 + size])
        self.table = compiled[4 + size :]
        self.spaces_inside = bool(self.units) and self._spaces_inside()
        self._first: dict[str, bool] = {}

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """The node after one more byte and the value of the key that ends there, -1 if none."""
        node ^= byte
        if node >= len(self.units):
            return None
        unit = self.units[node]
        if unit & 0x800000FF != byte:
            return None
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        return node, self.units[node] & 0x7FFFFFFF if unit >> 8 & 1 else -1

    def _root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _spaces_inside(self) -> bool:
        """Whether a key holds a space, or the sign for one, after its first character. Visits the trie level by level."""
        units, every = np.frombuffer(self.units, np.uint32), np.arange(1, 256, dtype=np.uint32)
        nodes = np.array([self._root()], np.uint32)
        last = np.zeros((1, 2), np.uint8)  # the two bytes before
        for depth in range(len(units)):
            below = []
            for at in range(0, len(nodes), 4096):
                to = nodes[at : at + 4096, None] ^ every
                unit = units[np.minimum(to, len(units) - 1)]
                which, byte = np.nonzero((to < len(units)) & ((unit & 0x800000FF) == every))
                to, unit, byte = to[which, byte], unit[which, byte], (byte + 1).astype(np.uint8)
                before = last[at + which]
                if depth and ((byte == 0x20).any() or depth > 2 and ((before == (0xE2, 0x96)).all(1) & (byte == 0x81)).any()):
                    return True
                below.append((to ^ ((unit >> 10) << ((unit & 0x200) >> 6)), np.stack([before[:, 1], byte], 1)))
            nodes, last = (np.concatenate(x) for x in zip(*below, strict=True))
            if not len(nodes):
                break
        return False

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Bytes and replacement of the longest key that begins there."""
        node, best = self._root(), None
        for i in range(at, len(raw)):
            if (found := self._step(node, raw[i])) is None:
                break
            node, value = found
            if value >= 0:
                best = i + 1 - at, value
        if best is None:
            return None
        return best[0], self.table[best[1] : self.table.index(b"\0", best[1])].decode("utf-8", "replace")

    def begins(self, c: str) -> bool:
        """Whether a key can begin with the character."""
        known = self._first.get(c)
        if known is None:
            node, known = self._root(), True
            for byte in c.encode("utf-8", "surrogatepass"):
                if (found := self._step(node, byte)) is None:
                    known = False
                    break
                node = found[0]
            self._first[c] = known
        return known


def byte_sizes(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8; a surrogate is replaced by one question mark."""
    return np.where((points >= 0xD800) & (points < 0xE000), 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


class Known(dict):
    """What `make` gives for strings, remembered for short ones, in two generations: what `limit` new strings didn't ask for goes."""

    def __init__(self, make: Callable[[str], object], limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= REMEMBERED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceModel:
    """A byte-pair model of the sentencepiece library, read from its file.

    Other kinds of models, and pieces that are user-defined or unused, are errors: the public vocabularies have none.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = list(fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for piece in (dict(fields(v)) for n, v in spec if n == 1):
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            self.kinds.append(piece.get(3, NORMAL))
        trainer, rules = (dict(fields(b"".join(v for n, v in spec if n == k))) for k in (2, 3))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not {*self.kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a byte-pair model of plain pieces")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown, self.begin, self.end = (trainer.get(n, d) for n, d in ((40, 0), (41, 1), (42, 2)))
        self.unknown_shown = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        # the best score first; of equal scores any, as the place in the text decides then
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {self.pieces[i]: order[scores[i]] for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # what each id stands for in decoded text, in one table
        shown = [bytes([self.byte_of[i]]) if k == BYTE else b"" if k == CONTROL else (self.unknown_shown if k == UNKNOWN else p.replace(SPACE, " ")).encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.table, self.lengths = np.frombuffer(b"".join(shown), np.uint8), np.array([*map(len, shown)])
        self.places, self.normal = self.lengths.cumsum() - self.lengths, np.array([k == NORMAL for k in self.kinds])
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        self.sizes = np.array([*map(len, self.pieces)])
        self.touching = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        self.segments = re.compile(self._segments())
        self.known = Known(self._codes, MOST)
        #: Whether texts may be cut before runs of spaces: no piece and no rule of the map has one inside.
        self.cuttable = self.escape and not self.map.spaces_inside and not any(a != SPACE and b == SPACE for a, b in self.touching)
        #: Whether normalising a whole text is a pass without Python's loops: nothing is mapped or dropped.
        self.plain = not self.map.units and not self.squeeze

    def _segments(self) -> str:
        """The pattern of what can be merged by itself: characters of one group, with the spaces in front. Groups are joined by the pairs that touch in a piece.

        So a word is one segment whatever mark or digit follows it. If a piece has a space after another character, spaces are characters like others.
        """
        inside = any(a != SPACE and b == SPACE for a, b in self.touching)
        near = defaultdict(set)
        for a, b in self.touching:
            if inside or a != SPACE:
                near[a].add(b)
                near[b].add(a)
        groups, seen = [], set()
        for c in near:
            if c not in seen:
                seen.add(c)
                group = [c]
                for x in group:  # grows on the way
                    group += near[x] - seen
                    seen |= near[x]
                groups.append(group)
        any_of = [f"[{re.escape(''.join(sorted(g)))}]+" for g in sorted(groups, key=len, reverse=True)]
        return f"{'' if inside else SPACE + '*+'}(?:{'|'.join([*any_of, f'[^{SPACE}]'])})|{SPACE}+"

    def normalise(self, text: str, first: bool = True, last: bool = True) -> tuple[str, Sequence[int]]:
        """The normalised text and, for each of its characters and its end, the byte of the text where its source begins.

        first, last: whether the text begins and ends here; otherwise it is a part and gets no space in front, and none of its spaces are dropped at its ends.
        """
        begins, out, source = self.map.begins, [], []
        mapped = self.map.units and any([begins(c) for c in text])
        if not mapped and not self.squeeze and text:
            space = SPACE if self.escape else " "
            front = self.dummy and first
            at = np.zeros(len(text) + 1 + front, np.int64)
            at[1 + front :] = np.arange(1, len(text) + 1) if text.isascii() else byte_sizes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).cumsum()
            return (space + text if front else text).replace(" ", space), at
        raw, at, i, after_space = text.encode("utf-8", "replace"), 0, 0, self.squeeze and first
        pieces: list[tuple[int, str]] = []
        while i < len(text):
            c = text[i]
            if mapped and begins(c) and (found := self.map.longest(raw, at)):
                n, c = found
                pieces.append((at, c))
                i += len(raw[at : at + n].decode("utf-8", "replace"))
            else:
                n = len(c.encode("utf-8", "replace"))
                pieces.append((at, c))
                i += 1
            at += n
        start = 0
        if self.squeeze and first:
            while start < len(pieces) and pieces[start][1] == " ":
                start += 1
        if start == len(pieces):
            return "", [at]
        if self.dummy and first:
            out.append(SPACE if self.escape else " ")
            source.append(pieces[start][0])
        for begin, c in pieces[start:]:
            if after_space:
                c = c.lstrip(" ")
            if c:
                out.extend(c)
                source.extend([begin] * len(c))
                after_space = self.squeeze and c[-1] == " "
            # what a rule deletes leaves it open whether a space came before
        source.append(at)
        shown = "".join(out)
        if self.escape:
            shown = shown.replace(" ", SPACE)
        if self.squeeze and last:
            kept = len(shown.rstrip(SPACE if self.escape else " "))
            if kept < len(shown):
                shown, source = shown[:kept], source[: kept + 1]
        return shown, source

    def merged(self, segment: str) -> list[str]:
        """The segment in parts: of all neighbours whose union is a piece, the pair with the best score is joined, the leftmost of equals."""
        parts = [*segment]
        rank, never = self.rank.get, len(self.rank)
        if len(parts) > SHORT:
            return self._merged_long(parts)
        ranks = [rank(a + b, never) for a, b in zip(parts, segment[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i] = union = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(union + parts[i + 1], never)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + union, never)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, str]] = []
        for i in range(n - 1):
            if (r := rank(u := parts[i] + parts[i + 1])) is not None:
                heap.append((r, i, u))
        heapq.heapify(heap)
        while heap:
            _, i, union = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != union:
                continue  # one of the two has changed meanwhile
            parts[i], parts[j] = union, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(u := union + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, u))
            if (h := before[i]) >= 0 and (r := rank(u := parts[h] + union)) is not None:
                heapq.heappush(heap, (r, h, u))
        return [p for p in parts if p]

    def _codes(self, segment: str) -> bytes:
        """The id of each part of a segment (32 bits, little-endian); an unknown character c is -1 - ord(c)."""
        ids = self.ids
        return struct.pack(f"<{len(parts := self.merged(segment))}i", *[ids[p] if p in ids else -1 - ord(p) for p in parts])

    def codes(self, normalised: str) -> np.ndarray:
        """The parts of a normalised text. Neighbours that touch in no piece are never joined, so the text is cut there."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.segments.findall(normalised))), "<i4")

    def encode_part(self, text: str, first: bool, last: bool) -> tuple[np.ndarray, Sequence[int], bool]:
        """Codes of a text or a part of one, its alignment, and whether the part is open: its end isn't settled without what follows."""
        shown, source = self.normalise(text, first, last)
        codes = self.codes(shown)
        return codes, source, not shown or shown[-1] == SPACE or codes[-1] < 0 and not self.byte_fallback

    def project(self, codes: np.ndarray, source: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte of the text where the source of each id ends.

        An unknown character is its bytes, of which the last one has the source, or, without such pieces, a run of them is one unknown piece.
        """
        if len(codes) < SHORT and min(few := codes.tolist(), default=0) >= 0:  # arrays take longer to set up
            return codes.view("<u4"), np.array([source[at] for at in accumulate([len(self.pieces[c]) for c in few])], np.uint32)
        unknown = codes < 0
        if not unknown.any():
            return codes.astype("<u4"), np.asarray(source)[self.sizes[codes].cumsum()]
        source = np.asarray(source)[np.where(unknown, 1, self.sizes[np.maximum(codes, 0)]).cumsum()]
        if not self.byte_fallback:
            last = np.append(~(unknown[:-1] & unknown[1:]), True)
            return np.where(unknown, self.unknown, codes)[last].astype("<u4"), source[last]
        points = -1 - codes[unknown]
        counts = np.ones(len(codes), np.int64)
        counts[unknown] = byte_sizes(points)
        ids, ends = np.repeat(codes, counts), np.repeat(np.append(0, source[:-1]), counts)
        ids[ids < 0] = self.byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode("utf-8", "replace"), np.uint8)]
        ends[counts.cumsum() - 1] = source
        return ids.astype("<u4"), ends

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of ids: bytes decoded together (U+FFFD for what isn't UTF-8), control pieces silent, the space in front dropped if `first`."""
        if len(ids) < SHORT or first and self.squeeze:
            return self._decode_one_by_one(ids, first)
        out = []
        for k in range(0, len(ids), BLOCK):
            some = ids[k : k + BLOCK]
            ends = (n := self.lengths[some]).cumsum()
            at = np.repeat(self.places[some] - (ends - n), n)
            at += np.arange(len(at))
            out.append(self.table[at].tobytes())
        begin = next((i for i in ids if self.lengths[i]), self.begin) if first and self.dummy else self.begin
        raw = b"".join(out)
        try:
            return (raw[1:] if self.normal[begin] and self.pieces[begin].startswith(SPACE) else raw).decode()
        except UnicodeDecodeError:
            return self._decode_one_by_one(ids, first)

    def _decode_one_by_one(self, ids: np.ndarray, first: bool) -> str:
        """For few ids, for bytes that make no characters, and where all spaces in front go."""
        out: list[str] = []
        raw = bytearray()
        bare = first and (self.dummy or self.squeeze)  # nothing shown yet

        def flush() -> None:
            nonlocal bare
            at = 0
            while at < len(raw):  # each byte that begins no character is one replacement character
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                at += n
            if raw:
                bare = False
            raw.clear()

        for i in ids.tolist():
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                continue
            flush()
            if kind == CONTROL:
                continue
            shown = self.unknown_shown if kind == UNKNOWN else self.pieces[i]
            if bare and kind == NORMAL and shown.startswith(SPACE):
                shown = shown[1:]
                if not self.squeeze:
                    bare = False
            out.append(shown.replace(SPACE, " ") if kind == NORMAL else shown)
            if shown:
                bare = False
        flush()
        return "".join(out)


class PieceEncoder:
    """Encodes whole texts. If normalising takes long, texts go chunk by chunk; chunks that come again are looked up, with the bytes of the chunk where each of their ids ends."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, Known(self._chunk, MOST)

    def _chunk(self, c: str) -> tuple[bytes, bytes, int, int, str, bool, bool]:
        m = self.model
        codes, source, is_open = m.encode_part(c, False, False)
        ids, ends = m.project(codes, source)
        shown = m.decode(ids, False)
        return ids.tobytes(), ends.astype("<u4", copy=False).tobytes(), len(ids), int(source[-1]), c if shown == c else shown, is_open, bool(source[0] > 0)

    def aligned(self, text: str) -> tuple[bytes, np.ndarray, str]:
        """Ids with begin and end (32 bits each, little-endian), the bytes of the text that each stands for (a row of start and end an id), and what they decode to."""
        m = self.model
        cut = CHUNKS.findall(text) if m.cuttable and not m.plain else []
        if len(cut) > 1:
            codes, source, is_open = m.encode_part(cut[0], True, False)
            raw, ends, counts, sizes, shown, opened, late = zip(*map(self.known.__getitem__, cut[1:]), strict=True)
            if not (is_open or any(opened[:-1]) or any(late) or m.squeeze and opened[-1]):
                ids, own = m.project(codes, source)
                begins = [*accumulate(sizes, initial=int(source[-1]))]
                moved = np.repeat(np.array([0, *begins[:-1]], np.uint32), [len(ids), *counts]) + np.frombuffer(b"".join([own.astype("<u4").tobytes(), *ends]), "<u4")
                return self._framed(np.frombuffer(b"".join([ids.tobytes(), *raw]), "<u4")).tobytes(), self._spans(source[0], moved, begins[-1]), "".join([m.decode(self._framed(ids)), *shown])
        codes, source, _ = m.encode_part(text, True, True)
        ids, ends = m.project(codes, source)
        framed = self._framed(ids)
        return framed.tobytes(), self._spans(source[0], ends, len(text.encode("utf-8", "replace"))), m.decode(framed)

    def _framed(self, ids: np.ndarray) -> np.ndarray:
        """The ids between begin and end."""
        out = np.empty(len(ids) + 2, "<u4")
        out[0], out[1:-1], out[-1] = self.model.begin, ids, self.model.end
        return out

    @staticmethod
    def _spans(start: int, ends: np.ndarray, size: int) -> np.ndarray:
        """Each id begins where the one before it ends; begin and end have no bytes."""
        out = np.zeros((len(ends) + 2, 2), "<u4")
        out[1:-1, 1], out[2:-1, 0], out[-1] = ends, ends[:-1], size
        if len(ends):
            out[1, 0] = start
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids with begin and end (32 bits each, little-endian) and what they decode to."""
        raw, _, decoded = self.aligned(text)
        return raw, decoded

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids with begin and end, and the bytes of the text that each stands for."""
        raw, spans, _ = self.aligned(text)
        return np.frombuffer(raw, "<u4").tolist(), [*map(tuple, spans.tolist())]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One a Python worker, so that later tasks find its memory filled."""
    return PieceEncoder(PieceModel(path))


def encode_pieces(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text with begin and end ids, projects the pieces to bytes of the text, and decodes the ids again.

    Returns the id, n_tokens (begin and end included) and ids (array<int>), starts and ends (array<int>: the bytes of the
    text's UTF-8 that each id stands for; of a character in bytes the last one has them, begin and end have none) and decoded
    (string) or, with `digests`, the SHA-256 of the ids (little-endian, 32 bits), of the decoded text, and of the starts and
ends (one after the other, like the ids), for which every text is projected just the same. Null and empty
    texts have the two ids alone and decode to nothing; null or repeated ids and repeated rows keep one row each; strings of
    special pieces inside texts are plain text; other columns don't matter. Time is linear in the text but for a logarithm. No shuffle.
    """
    os.stat(vocab)  # a missing file is the driver's error, not the tasks'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab)
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(4 if digests else 5)]
            for text in batch.column(1).to_pylist():
                raw, spans, decoded = own.aligned(text or "")
                if digests:
                    row = len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), hashlib.sha256(spans.tobytes()).hexdigest()
                else:
                    row = len(raw) // 4, np.frombuffer(raw, "<i4"), *spans.T.astype(np.int32), decoded
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if digests else [pa.int64(), *[pa.list_(pa.int32())] * 3, pa.string()]
            names = ["n", "ids_sha256", "decoded_sha256", "spans_sha256"] if digests else ["n", "ids", "starts", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["id", *names])

    source = only(docs, id_col, text_col)
    names = "ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digests else "ids array<int>, starts array<int>, ends array<int>, decoded string"
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, {names}")
