"""Operator 7: SentencePiece encoding and decoding: a streaming Viterbi, or the merges of a BPE model.

The scores of a BPE model are ranks of its merges, not log probabilities, and their best sum is
not what SentencePiece gives. encode_texts() therefore takes such a model's ids from its merges,
by the library itself, in parts of about a million characters that no piece crosses; the ids
are those of SentencePieceProcessor.encode for every text without U+2581. With a unigram model it
takes the Viterbi.

A text becomes a stream of characters: a blank before it, blanks written as U+2581, all else
as it is. The Viterbi keeps, for the places within the longest piece's length of the newest
one, the best score and a backpointer. Whenever the backpointers of all places that a later
piece could still start from go through one boundary, the ids up to there are final and leave
the window, so memory doesn't grow with the text. The scores are those of the model file;
of equal scores the piece that starts first stays. Characters that no piece covers become
byte pieces, and so does U+2581 itself, so that decoding gives back every text exactly.

No piece of such a model goes across the start of a blank run that follows other characters, nor
holds a line end, hence all paths meet there (a model with such pieces is streamed throughout). Stretches between two such boundaries are encoded once in a
worker and kept in a bounded memo; it changes nothing but speed.

Edge cases: a null text has null ids, an empty one has none; texts of any length are
streamed; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pointlake.llm.common import doc_slices, fields, give_back, text_buffer

BLANK = "▁"
_LITERAL = "\udfff"  # stands for U+2581 in a text; no text holds a lone surrogate
_NEVER = float("-inf")
_STRETCH = re.compile(" +[^ \n]*|[^ \n]+|\n")
_MEMO_SIZE = 100_000
_LONG = 32  # a longer stretch is streamed and isn't kept
_PART = 1 << 20  # characters of a text that are merged at once
_CUT = re.compile("(?<! ) |\n")  # no piece goes across the place before these
_NO_PREFIX = b"\x1a\x02\x18\x00"  # at the end of a model file: normalizer_spec.add_dummy_prefix = false
_SLICE = 1 << 20  # characters of the texts that are looked at together
_STEP, _SPREAD, _SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18


@dataclass
class PieceModel:
    """Pieces and their beginnings with scores and ids, the ids of the bytes, and what an id stands for."""

    prefixes: dict[str, tuple[float, bytes] | tuple[()]]  # () for what only begins a piece
    byte_ids: list[bytes]
    text_of: list[bytes]
    longest: int
    unknown: float
    crosses: bool
    scores: np.ndarray  # by id, and what -1 reads is never used
    slot_keys: np.ndarray
    slot_ids: np.ndarray
    proto: bytes = b""  # of a BPE model the whole file
    memo: dict[str, bytes] = field(default_factory=dict)
    mergers: list[sentencepiece.SentencePieceProcessor] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "mergers": []}

    @staticmethod
    def load(path: str, paths: bool = False) -> PieceModel:
        """The model file's pieces; the tables of the Viterbi only where the model is no BPE model, or with `paths`."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, text_of = {}, [b""] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = _packed(i)
                text_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                text_of.append(b"")
            else:
                pieces[piece] = (sp.get_score(i), _packed(i))
                text_of.append(piece.replace(BLANK, " ").encode())
        if b"" in byte_ids:
            raise ValueError("the model has no byte pieces")
        low = min(s for s, _ in pieces.values())
        crosses = any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        proto = sp.serialized_model_proto()
        proto = proto if _is_bpe(proto) else b""
        if proto and not paths:
            none = np.zeros(0)
            return PieceModel({}, byte_ids, text_of, max(map(len, pieces)), 0.0, crosses, none, none, none, proto)
        prefixes = {p[:k]: () for p in pieces for k in range(1, len(p))} | pieces
        scores, keys, ids = np.zeros(len(text_of)), np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32)
        if len(pieces) > 1 << (_SLOTS - 1):
            raise ValueError("the vocabulary is too large for the table")
        for piece, (score, packed) in pieces.items():
            i, h = int.from_bytes(packed, "little"), 0
            for c in piece:
                h = (h * int(_STEP) + ord(c) + 1) % (1 << 64)
            slot = (h * int(_SPREAD) % (1 << 64)) >> (64 - _SLOTS)
            while keys[slot]:
                slot = (slot + 1) % (1 << _SLOTS)
            scores[i], keys[slot], ids[slot] = score, h, i
        return PieceModel(prefixes, byte_ids, text_of, max(map(len, pieces)), low - 10.0, crosses, scores, keys, ids, proto)

    # --- encoding -----------------------------------------------------------------

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text as SentencePiece gives them: by merges with a BPE model, else by the Viterbi."""
        return [None if x is None else self._merged(x) for x in texts] if self.proto else self.encode_all(texts)

    def _merged(self, text: str) -> np.ndarray:
        """The ids by the model's merges; U+2581 becomes its bytes, so that decoding gives it back."""
        if not self.mergers:
            self.mergers += [sentencepiece.SentencePieceProcessor(model_proto=self.proto + more) for more in (b"", _NO_PREFIX)]
        whole, inner = self.mergers
        if not text or (BLANK not in text and (len(text) <= _PART or self.crosses)):
            return np.array(whole.encode(text, num_threads=1), np.int32)
        literal = np.frombuffer(b"".join(self.byte_ids[b] for b in BLANK.encode()), np.int32)
        out: list[np.ndarray] = []
        for k, run in enumerate((" " + text).split(BLANK)):
            out += [literal] * (k > 0)
            at = 0
            while at < len(run):
                cut = None if self.crosses else _CUT.search(run, at + _PART)
                stop = cut.start() if cut else len(run)
                out.append(np.array(inner.encode(run[at:stop], num_threads=1), np.int32))
                at = stop
        return np.concatenate(out)

    def stream(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids as packed 32-bit integers, each as soon as it is final, of the characters that come in parts.

        Blanks come as U+2581, U+2581 itself as _LITERAL.
        """
        longest = self.longest
        window, done = "", 0  # characters from the last final boundary on; how many starts are done
        best, back, ids = [0.0], [0], [b""]  # by place: score, start of the last piece, its ids
        for part in parts:
            for k in range(0, len(part), 4 * longest):  # the window stays within six longest pieces
                window += part[k : k + 4 * longest]
                ready = max(done, len(window) - longest)
                self._advance(window, done, ready, best, back, ids)
                done = ready
                alive = {e for e in range(done, len(best)) if best[e] > _NEVER}  # a later piece starts at one of these
                while len(alive) > 1:
                    most = max(alive)
                    alive.remove(most)
                    alive.add(back[most])
                meet = alive.pop()
                if meet:
                    yield _final(meet, back, ids)
                    window, done, low = window[meet:], done - meet, best[meet]
                    best = [s - low for s in best[meet:]]
                    back, ids = [0, *(b - meet for b in back[meet + 1 :])], [b"", *ids[meet + 1 :]]
        self._advance(window, done, len(window), best, back, ids)
        if window:
            yield _final(len(window), back, ids)

    def _advance(self, window: str, first: int, stop: int, best: list, back: list, ids: list) -> None:
        """Continue the paths by all pieces that start at first ... stop - 1."""
        get, n = self.prefixes.get, len(window)
        more = min(n, stop + self.longest) + 1 - len(best)
        best += [_NEVER] * more
        back += [0] * more
        ids += [b""] * more
        for begin in range(first, stop):
            here = best[begin]
            alone = True
            for end in range(begin + 1, n + 1):
                hit = get(window[begin:end])
                if hit is None:
                    break
                if hit:
                    if end == begin + 1:
                        alone = False
                    if here + hit[0] > best[end]:
                        best[end], back[end], ids[end] = here + hit[0], begin, hit[1]
            if alone and here + self.unknown > best[begin + 1]:
                c = window[begin]
                best[begin + 1], back[begin + 1] = here + self.unknown, begin
                ids[begin + 1] = b"".join(self.byte_ids[b] for b in (BLANK if c == _LITERAL else c).encode())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        if self.crosses:
            return np.frombuffer(b"".join(self.stream([_characters(" " + text)])), np.int32)
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text. Stretches that aren't in the memo are worked out together."""
        if self.crosses:
            return [None if x is None else self.encode(x) for x in texts]
        out: list[np.ndarray | None] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < _SLICE):
                size += len(texts[j] or "")
                j += 1
            if size > _PART and j == i + 1:  # a very long text: its window is all that is held of its paths
                long_ = " " + texts[i]
                out.append(np.frombuffer(b"".join(self.stream(_characters(long_[a : a + _PART]) for a in range(0, len(long_), _PART))), np.int32))
                i = j
                continue
            parts = [_STRETCH.findall(" " + x) if x else [] for x in texts[i:j]]
            fresh = {s for p in parts for s in p}.difference(self.memo)
            if len(self.memo) + len(fresh) > _MEMO_SIZE:
                self.memo.clear()
                fresh = {s for p in parts for s in p}
            memo = self.memo
            memo |= self._together([s for s in fresh if len(s) <= _LONG])
            for x, p in zip(texts[i:j], parts, strict=True):
                ids = b"".join([memo[s] if len(s) <= _LONG else self._stretch(_characters(s)) for s in p])
                out.append(None if x is None else np.frombuffer(ids, np.int32))
            i = j
        return out

    def _together(self, stretches: list[str]) -> dict[str, bytes]:
        """The same paths as _stretch() finds, for many short stretches of one length at a time.

        Substrings are looked up by a hash; should two ever share one, the pieces don't spell the
        stretch, and it is done alone. So are stretches with characters that no piece covers.
        """
        got: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for s in stretches:
            by_length.setdefault(len(s), []).append(s)
        for n, words in by_length.items():
            chars = np.frombuffer("".join(map(_characters, words)).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
            best = np.full((n + 1, len(words)), _NEVER)
            best[0] = 0
            back, piece = np.zeros((n + 1, len(words)), np.int8), np.full((n + 1, len(words)), -1, np.int32)
            for begin in range(n):
                h = np.zeros(len(words), np.uint64)
                for end in range(begin + 1, min(n, begin + self.longest) + 1):
                    h = h * _STEP + chars[:, end - 1] + np.uint64(1)
                    at = self._find(h)
                    score = best[begin] + self.scores[at]
                    better = (at >= 0) & (score > best[end])
                    best[end, better], back[end, better], piece[end, better] = score[better], begin, at[better]
            rows, place = np.arange(len(words)), np.full(len(words), n)
            path = np.full((len(words), n), -1, np.int32)
            whole = np.isfinite(best[n])
            for _ in range(n):
                live = (place > 0) & whole
                if not live.any():
                    break
                path[rows[live], place[live] - 1] = piece[place[live], rows[live]]
                place[live] = back[place[live], rows[live]]
            used = path >= 0
            flat = path[used].tobytes()
            cut = np.concatenate([[0], np.cumsum(used.sum(1))]) * 4
            for k, (s, a, b) in enumerate(zip(words, cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                ids = flat[a:b]
                if not whole[k] or b"".join([self.text_of[i] for i in np.frombuffer(ids, np.int32).tolist()]) != s.encode():
                    ids = self._stretch(_characters(s))
                got[s] = ids
        return got

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these hashes, or -1."""
        slot = ((h * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        key = self.slot_keys[slot]
        wrong = np.flatnonzero((key != h) & (key != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % (1 << _SLOTS)
            key = self.slot_keys[slot[wrong]]
            wrong = wrong[(key != h[wrong]) & (key != 0)]
        return np.where(self.slot_keys[slot] == h, self.slot_ids[slot], -1)

    def _stretch(self, chars: str) -> bytes:
        if len(chars) > _LONG:
            return b"".join(self.stream([chars]))
        best, back, ids = [0.0], [0], [b""]
        self._advance(chars, 0, len(chars), best, back, ids)
        return _final(len(chars), back, ids)

    # --- decoding -----------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids that encode() gave, or any others: bytes that are no text are replaced."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        out = b"".join(map(self.text_of.__getitem__, ids))
        return (out[1:] if out.startswith(b" ") else out).decode("utf-8", "replace")


def _is_bpe(proto: bytes) -> bool:
    """Whether the model file says so: field 3 (model_type) of field 2 (trainer_spec) is 2; unset means unigram."""

    def parts(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                byte = data[at]
                at += 1
                out |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return out

        while at < len(data):
            name, kind = divmod(number(), 8)
            if kind == 0:
                yield name, number()
                continue
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield name, data[at : at + size]
            at += size

    return any(value == 2 for name, spec in parts(proto) if name == 2 for own, value in parts(spec) if own == 3)


def _packed(i: int) -> bytes:
    return i.to_bytes(4, "little")


def _final(place: int, back: list, ids: list) -> bytes:
    """The ids of the path that ends at place."""
    out = []
    while place:
        out.append(ids[place])
        place = back[place]
    return b"".join(reversed(out))


def _characters(stretch: str) -> str:
    return stretch.replace(BLANK, _LITERAL).replace(" ", BLANK)


_MODELS: dict[bytes, PieceModel] = {}


def encode_texts(docs: DataFrame, model: PieceModel, column: str = "ids", check: bool = False) -> DataFrame:
    """All columns of docs but text, `ids array<int>`, and with check `intact boolean`: decoding gives the text.

    A null text has null ids and is intact. Columns of docs that are called like the new ones give way.
    """
    docs = docs.drop(column, *["intact"] * check)
    names = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary: its size is the model file's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j in doc_slices(text_buffer(batch.column("text"))[1], 1 << 20):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                ids = own.ids_of(texts)
                intact = [x is None or own.decode(i) == x for x, i in zip(texts, ids, strict=True)] if check else []
                cols = [*(part.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(intact)] if check else cols, [*names, column, *["intact"] * check])
                del texts, ids, cols
                give_back()

    return docs.mapInArrow(run, fields(docs.schema, f"`{column}` array<int>" + ", intact boolean" * check, "text"))


def decode_ids(rows: DataFrame, model: PieceModel, column: str = "ids") -> DataFrame:
    """All columns of rows but `column`, and `text`; another column of that name gives way."""
    rows = rows.drop("text")
    names = [c for c in rows.columns if c != column]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(x.as_py()) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(run, fields(rows.schema, "text string", column))
