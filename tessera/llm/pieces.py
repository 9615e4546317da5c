"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a state for each character boundary; arcs are pieces. Only the last ``longest piece`` states
can gain arcs, so only they are kept with their backpointers, and whenever the paths of all kept states run
through one boundary, the ids before it are committed and forgotten.

* unigram models: an arc costs its piece's negative log probability, the cheapest path wins;
* BPE models: an arc is admissible if merging the previous piece and this one gives just these two back. A
  merge run never crosses a boundary that it keeps, so each boundary has at most one admissible arc and the
  surviving path is the library's own result.

Characters without a piece are spelled in byte pieces (or the unknown piece). Where the vocabulary has no
piece that goes on behind a space or control character, the paths converge before each white space: texts
are cut there and each distinct chunk of a batch is searched once. A mark (U+2581) in a text is a space to the
library, so it becomes one before the cuts.

Null and empty texts have no ids. Repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.store import broadcast, table
from tessera.llm.words import chunks, utf8

MARK = "▁"


@dataclass
class PieceModel:
    """A vocabulary with scores; ``kind`` is "bpe" or "unigram". ``data`` (a model file) is needed only for its normaliser."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]  # of the 256 bytes, or empty
    unknown: int
    kind: str
    spelled: list[bytes]  # by id: what it decodes to
    data: bytes | None = None
    longest: int = 0
    agrees: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10
        #: white space that no piece holds behind another character: all paths converge before it
        self.cuts = np.ones(256, bool)
        self.cuts[[ord(c) for c in " \t\n\v\f\r" if not any(c in q[i:] for p in self.pieces if (q := p.replace(MARK, " ")) for i in [len(q) - len(q.lstrip(c))] if c in q and q.strip(c))]] = False

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by repeated best merges, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        found = self.agrees.get((a, b))
        if found is None:
            if len(self.agrees) > 400_000:
                self.agrees.clear()
            found = self.agrees[a, b] = self.merged(a + b) == [a, b]
        return found

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [found] if found is not None else [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def search(self, text: str) -> list[int]:
        return [i for piece in StreamingViterbi(self).run(text) for i in self.ids_of(piece)]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


class StreamingViterbi:
    """Feeds characters one at a time; ``window`` holds the states still in reach, ``done`` the committed pieces."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.done: list[str] = []
        self.at = 0
        self.tail = ""
        #: boundary -> (cost, last piece, where it began); the first state has no piece
        self.window: dict[int, tuple[float, str, int]] = {0: (0.0, "", -1)}

    def push(self, char: str) -> None:
        m, span = self.model, self.model.longest
        self.at += 1
        self.tail = (self.tail + char)[-span:]
        best = None
        for size in range(min(len(self.tail), span), 0, -1):
            piece = self.tail[-size:]
            if size > 1 and piece not in m.pieces:
                continue
            state = self.window.get(self.at - size)
            if state is None:
                continue
            if m.kind == "bpe":
                if m.agree(state[1], piece) if state[1] else size == 1 or m.merged(piece) == [piece]:
                    best = (0.0, piece, self.at - size)
                    break
            else:
                cost = state[0] - m.scores.get(piece, m.floor)
                if best is None or cost < best[0]:
                    best = (cost, piece, self.at - size)
        if best:
            self.window[self.at] = best

    def commit(self) -> None:
        """Ids up to the last boundary that all paths from states in reach go through are final."""
        reach = [p for p in self.window if p > self.at - self.model.longest]
        fronts = set(reach)
        while len(fronts) > 1:
            p = max(fronts)
            before = self.window[p][2]
            fronts.discard(p)
            if before < 0:
                return
            fronts.add(before)
        self._emit(fronts.pop())

    def _emit(self, boundary: int) -> None:
        path, p = [], boundary
        while self.window[p][2] >= 0:
            path.append(self.window[p][1])
            p = self.window[p][2]
        self.done += reversed(path)
        cost, piece, _ = self.window[boundary]
        self.window = {q: s for q, s in self.window.items() if q > boundary}
        self.window[boundary] = (cost, piece, -1)

    def run(self, text: str) -> list[str]:
        for i, char in enumerate(text, 1):
            self.push(char)
            if i % (2 * self.model.longest) == 0:
                self.commit()
        self._emit(self.at)
        return self.done


class LockstepViterbi:
    """The same search over many short chunks at once (BPE): step i handles boundary i of every chunk.

    Pieces at all places are found by rolling hashes of the characters; a boundary's arc is its longest
    admissible piece. Verdicts on pairs of pieces are kept in a sorted array.
    """

    MOST = 48  # characters of a chunk; longer ones stream

    def __init__(self, model: PieceModel):
        self.model = model
        self.names = list(model.pieces)
        self.index = {p: i for i, p in enumerate(self.names)}
        self.ids = np.array([*model.pieces.values(), model.unknown], np.int32)
        self.lone = len(self.names)  # a character that is no piece: nothing merges with it
        self.stands = np.array([len(p) == 1 or model.merged(p) == [p] for p in self.names] + [True])
        h = np.array([self.hash_of(p) for p in self.names], np.uint64)
        order = np.argsort(h)
        self.hashes, self.which = np.append(h[order], np.uint64(2**64 - 1)), np.append(order, 0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> np.uint64(44)] = True
        self.pairs, self.verdicts = np.array([2**62], np.int64), np.array([False])

    @staticmethod
    def hash_of(text: str) -> int:
        out = 0
        for c in text:
            out = (out * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
        return out * 0xBF58476D1CE4E5B9 % 2**64

    def pieces_at(self, chars: np.ndarray, room: np.ndarray) -> dict[int, np.ndarray]:
        """size -> index of the piece of that size that begins at each character, or -1. room: characters up to the chunk's end."""
        out, h = {}, np.zeros(len(chars), np.uint64)
        for size in range(1, self.model.longest + 1):
            fits = np.flatnonzero(room >= size)
            if not len(fits):
                break
            h[fits] = h[fits] * np.uint64(0x9E3779B97F4A7C15) + chars[fits + size - 1] + np.uint64(1)
            key = h[fits] * np.uint64(0xBF58476D1CE4E5B9)
            hit = self.maybe[key >> np.uint64(44)]
            fits, key = fits[hit], key[hit]
            at = np.searchsorted(self.hashes, key)
            same = self.hashes[at] == key
            found = np.full(len(chars), -1, np.int32)
            found[fits[same]] = self.which[at[same]]
            out[size] = found
        return out

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 24) | b
        at = np.searchsorted(self.pairs, key)
        miss = np.unique(key[self.pairs[at] != key])
        if len(miss):
            new = []
            for k in miss.tolist():
                x, y = self.names[k >> 24], self.names[k & 0xFFFFFF]
                new.append(self.model.merged(x + y) == [x, y])
            if len(self.pairs) > 2_000_000:
                self.pairs, self.verdicts = np.array([2**62], np.int64), np.array([False])
            pairs = np.concatenate([self.pairs, miss])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.verdicts = pairs[order], np.concatenate([self.verdicts, np.array(new, bool)])[order]
            return self.agree(a, b) if len(self.pairs) > 1 else np.zeros(len(a), bool)
        return self.verdicts[at]

    def run(self, texts: list[str]) -> list[np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        start = np.append(0, np.cumsum(size))[:-1][order]
        lens = size[order]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        if not len(chars):
            return [np.zeros(0, np.int32) for _ in texts]
        room = np.empty(len(chars), np.int64)
        room[:] = np.repeat(np.append(0, np.cumsum(size))[1:], size) - np.arange(len(chars))
        at = self.pieces_at(chars, room)
        last = np.full(len(chars), -1, np.int32)  # the piece that ends with each character
        width = np.zeros(len(chars), np.int8)
        for step in range(1, int(lens[0]) + 1):
            n = int(np.searchsorted(-lens, -step, "right"))
            end = start[:n] + step - 1
            todo = np.arange(n)
            for k in range(min(step, max(at)), 0, -1):
                if not len(todo):
                    break
                begin = end[todo] - k + 1
                piece = at[k][begin]
                if k == 1:
                    piece = np.where(piece < 0, self.lone, piece)
                ok = piece >= 0
                prev = np.full(len(todo), self.lone, np.int32)
                if step > k:
                    prev = last[np.where(ok, begin - 1, 0)]
                    ok &= prev >= 0
                ok &= self.stands[piece]
                test = np.flatnonzero(ok & (prev != self.lone) & (piece != self.lone))
                if len(test):
                    ok[test] = self.agree(prev[test], piece[test])
                got = todo[ok]
                last[end[got]], width[end[got]] = piece[ok], k
                todo = todo[~ok]
        on = np.zeros(len(chars), bool)  # characters that end a piece of the surviving path
        at, low = start + lens, start
        while len(at := at[live := at > low]):
            low = low[live]
            on[at - 1] = True
            at = at - width[at - 1]
        ends = np.flatnonzero(on)
        piece = last[ends]
        lone = np.flatnonzero(piece == self.lone)
        ids, many = self.ids[piece], np.ones(len(ends), np.int64)
        spelled = [self.model.ids_of(chr(int(chars[ends[i]]))) for i in lone]
        many[lone] = [len(x) for x in spelled]
        flat, first = np.repeat(ids, many), np.append(0, np.cumsum(many))
        for i, x in zip(lone.tolist(), spelled, strict=True):
            flat[first[i] : first[i + 1]] = x
        cut = first[np.searchsorted(ends, np.append(0, np.cumsum(size)))]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_type(data: bytes) -> int:
    """The kind that a model file names in its training options (field 2, then 3): 1 unigram, 2 BPE; 1 where it names none."""
    return next((v for n, own in fields(data) if n == 2 for m, v in fields(own) if m == 3), 1)


def load_pieces(model_file: str) -> PieceModel:
    import sentencepiece

    with open(model_file, "rb") as f:
        data = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): i for i in own}
    spelled = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    probe = "① ﬁ é  　A"
    plain = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
    kind = {1: "unigram", 2: "bpe"}.get(model_type(data))
    if kind is None:
        raise ValueError("only unigram and BPE models can be searched")
    return PieceModel(pieces, {p: sp.get_score(i) for p, i in pieces.items()}, byte_ids if sp.is_byte(byte_ids[0]) else [], sp.unk_id(), kind, spelled, None if plain else data)


class TextEncoder:
    """Ids of whole texts; remembers the first ``memory`` chunks it meets, and verdicts on pairs, between batches and tasks."""

    def __init__(self, model: PieceModel, memory: int = 250_000):
        self.model, self.memory, self.known = model, memory, {}
        self.lockstep = LockstepViterbi(model) if model.kind == "bpe" else None
        self.library = None
        if model.data:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model.data)

    def found(self, vocab: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct chunks."""
        out = [self.known.get(c) for c in vocab]
        new = [i for i, f in enumerate(out) if f is None]
        texts = [vocab[i].decode("utf-8", "replace").replace(" ", MARK) for i in new]
        brief = [k for k, t in enumerate(texts) if self.lockstep and len(t) <= LockstepViterbi.MOST]
        for k, ids in zip(brief, self.lockstep.run([texts[k] for k in brief]) if brief else [], strict=True):
            out[new[k]] = ids
        for k, i in enumerate(new):
            if out[i] is None:
                out[i] = np.array(self.model.search(texts[k]), np.int32)
            if len(self.known) < self.memory:
                self.known[vocab[i]] = out[i].copy()  # not a view, which would hold its whole batch
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, joined, and where each text's begin (n + 1 offsets)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.library:  # the file's own normaliser; it puts the leading mark itself
            texts = pa.array([self.library.normalize(t).replace(MARK, " ") for t in texts.to_pylist()], pa.large_string())
        else:
            texts = pa.compute.if_else(pa.compute.equal(texts, ""), "", pa.compute.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            texts = pa.compute.replace_substring(texts, MARK, " ")  # a mark in a text is a space from here on
        raw, at = utf8(texts)
        solid = self.model.cuts[raw]
        stop = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        cut = np.union1d(stop, at).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        found = self.found(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        begin = np.append(0, np.cumsum(size))[:-1] if len(size) else size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lens = size[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(lens))
        pick = np.repeat(begin[codes] - ends[:-1], lens) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
        return flat[pick], ends[np.searchsorted(cut, at)]


def encode_pieces(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_ids, round_trip``: the last tells if decoding gives the text back (a mark in a text comes back as a space)."""
    load = broadcast(docs.sparkSession, TextEncoder(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in chunks(batches):
            ids, ends = encoder.encode(b.column("text"))
            rows, texts = np.split(ids, ends[1:-1]), b.column("text").to_pylist()
            same = [encoder.model.decode(r.tolist()) == (t or "").replace(MARK, " ") for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ends)), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids`` (null ids: null text)."""
    load = broadcast(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for b in batches:
            texts = [None if r is None else m.decode(r) for r in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
