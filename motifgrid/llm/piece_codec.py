"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text gets the dummy prefix, blanks become the space sign, and the merges of
the model's pieces run as an agenda: of all adjacent pairs whose join is a
piece, the best score goes first, ties from the left. With dropout, a candidate
is skipped when its keyed hash falls under ``dropout``. The key is (seed, whole
text, place of the chunk in the text, number of the candidate): a chunk's
candidates are numbered as the agenda meets them (the first pairs from the left,
then after each merge the new pair to the right and the new pair to the left).
So every occurrence of a word draws for itself, results repeat exactly, and
nothing depends on order, batch or machine.

No piece of the model has a space sign after another character (checked when
the model is read), so chunks (blanks and the non-blanks after them) never
interact. A chunk's pieces are a function of the chunk and of the draws that its
agenda takes: occurrences none of whose draws skips take the remembered pieces of
the agenda without dropout, and of those at hand together, equal chunks with
equal draws run once. The rest runs together in numpy, one merge of every chunk
a round; long chunks run a heap. Both follow the same agenda. The memory is
bounded in bytes; forgetting changes no result.

Characters outside the model become byte pieces, as does a literal space sign,
so decoding gives back every text, byte for byte.

Edge cases: a null or empty text has no pieces and decodes to the empty text;
repeated rows get equal pieces; very long texts and chunks are encoded whole;
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

SPACE = "▁"
DROPOUT, SEED = 0.1, 20
#: Chunks longer than this run alone on a heap.
LONG = 48
#: Bytes, about, that a worker remembers chunks in.
REMEMBERED = 64 << 20
#: Draws of a chunk that are looked at before its agenda runs.
DRAWS = 32
#: Chunks handled at once, those whose agendas run together (their arrays fit a core's cache), and characters of a text cut into chunks at once.
AT_ONCE, TOGETHER, PIECE = 100_000, 16_000, 1 << 20
_CHUNK = re.compile(r"[ ]+[^ ]*|[^ ]+")
_START = re.compile(r"(?<=[^ ])[ ]")
_M = (1 << 64) - 1
_C = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: int) -> int:
    x = ((x ^ x >> 30) * _C[1]) & _M
    x = ((x ^ x >> 27) * _C[2]) & _M
    return x ^ x >> 31


def _mix_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_C[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_C[2])
    return x ^ x >> np.uint64(31)


def limit_of(dropout: float) -> int:
    """Candidates whose 16 hash bits are below this are skipped."""
    return round(dropout * 65536)


def skipped(key: int, number: int, limit: int) -> bool:
    """Whether the candidate of that number is skipped under an occurrence's key; a hash serves four numbers."""
    return (_mix((key + ((number >> 2) + 1) * _C[0]) & _M) >> 16 * (number & 3)) & 0xFFFF < limit


def skipped_all(key: np.ndarray, number: np.ndarray, limit: int) -> np.ndarray:
    """The same for arrays."""
    h = _mix_all(key + ((number >> 2) + 1).astype(np.uint64) * np.uint64(_C[0]))
    return (h >> ((number & 3) * 16).astype(np.uint64) & np.uint64(0xFFFF)) < np.uint64(limit)


def first_draws(key: np.ndarray, limit: int) -> np.ndarray:
    """The first ``DRAWS`` draws of each key as bits, number 0 lowest."""
    steps = np.arange(1, DRAWS // 4 + 1, dtype=np.uint64) * np.uint64(_C[0])
    out = np.empty(len(key), np.uint32)
    for at in range(0, len(key), 1 << 14):
        h = _mix_all(key[at : at + (1 << 14), None] + steps)
        out[at : at + (1 << 14)] = np.packbits(h.view("<u2") < limit, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


class Codec:
    """One model's pieces and merges."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(n)]
        self.bytes_of = [-1] * 256
        for k in range(n):
            if sp.is_byte(k):
                self.bytes_of[int(names[k][3:5], 16)] = k
        if min(self.bytes_of) < 0:
            raise ValueError("the model has no byte fallback, so it can't be lossless")
        self.id = {p: k for k, (p, s) in enumerate(zip(names, special)) if not s}
        if any(p[k] == SPACE and p[k - 1] != SPACE for p in self.id for k in range(1, len(p))):
            raise ValueError("a piece of the model reaches from one word into the next")
        self.size = n
        self.out = [b""] * n
        for p, k in self.id.items():
            self.out[k] = p.replace(SPACE, " ").encode()
        for value, k in enumerate(self.bytes_of):
            self.out[k] = bytes([value])
        # a dense rank of scores: 0 is merged first
        scores = sorted({sp.get_score(k) for k in self.id.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(n, len(scores), np.int64)
        for k in self.id.values():
            self.rank[k] = rank[sp.get_score(k)]
        pairs = {}
        for p, k in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = k
        self.merge = pairs
        self._index_merges()
        # code point to symbol, -1 where several bytes are needed
        self.first = np.full(0x110000, -1, np.int64)
        self.first[:128] = self.bytes_of[:128]
        for p, k in self.id.items():
            if len(p) == 1:
                self.first[ord(p)] = k
        self.first[ord(SPACE)] = -1
        self.first[32] = self.id.get(SPACE, self.bytes_of[32])

    def _index_merges(self) -> None:
        """An open hash table of the merges: ``slots`` keys and joins, searched one step on at a collision."""
        self.kind = np.int32 if self.size**2 < 1 << 31 else np.int64  # of pair codes; short integers run faster
        bits = max(4, (8 * len(self.merge) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(self.merge), np.int64)
        at = self._slot(keys).tolist()
        self.slots, self.joins = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int64)
        self.steps = 1
        for k, a in zip(keys.tolist(), at):
            step = 1
            while self.slots[a] >= 0:
                a, step = a + 1, step + 1
            self.slots[a], self.joins[a], self.steps = k, self.merge[k], max(self.steps, step)
        self.order = (self.rank[self.joins] << 8).astype(self.kind)  # of the join, ready to take a place below it
        self.slots, self.joins = self.slots.astype(self.kind), self.joins.astype(self.kind)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(_C[0]) >> self.shift).astype(np.int64)

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """The slot of each pair code's merge, or -1."""
        at = self._slot(code)
        held = self.slots[at]
        rest = np.flatnonzero((held != code) & (held >= 0))
        at[held < 0] = -1
        for _ in range(1, self.steps):
            if not len(rest):
                break
            at[rest] += 1
            held = self.slots[at[rest]]
            free = held < 0
            at[rest[free]] = -1
            rest = rest[~free & (held != code[rest])]
        at[rest] = -1
        return at

    def symbols(self, chunk: str) -> list[int]:
        """First symbols of a chunk (blanks are spaces): characters of the model, else their bytes."""
        out = []
        for c in chunk:
            k = self.id.get(SPACE if c == " " else c) if c != SPACE else None
            if k is None:
                out += [self.bytes_of[b] for b in c.encode("utf-8", "surrogatepass")]
            else:
                out.append(k)
        return out

    def heap(self, symbols: list[int], key: int, dropout: float) -> list[int]:
        """The agenda for one chunk, on a heap."""
        limit, n, number = limit_of(dropout), self.size, 0
        sym, left, right = list(symbols), list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def put(i: int):
            nonlocal number
            j = right[i]
            if j < 0 or (k := self.merge.get(sym[i] * n + sym[j])) is None:
                return
            number += 1
            if limit and skipped(key, number - 1, limit):
                return
            heapq.heappush(agenda, (int(self.rank[k]), i, sym[i], sym[j], k))

        for i in range(len(sym) - 1):
            put(i)
        while agenda:
            _, i, a, b, k = heapq.heappop(agenda)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = k, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            put(i)
            if left[i] >= 0:
                put(left[i])
        return [s for s in sym if s >= 0]

    def flat_symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All first symbols of many chunks in a row, and each chunk's count."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, lengths = self.first[points], np.fromiter(map(len, chunks), np.int64, len(chunks))
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, lengths
        own = [self.symbols(chr(points[k])) for k in odd]  # several bytes each
        count = np.fromiter(map(len, own), np.int64, len(own))
        sym[odd] = [b[0] for b in own]
        sym = np.insert(sym, np.repeat(odd + 1, count - 1), [x for b in own for x in b[1:]])
        np.add.at(lengths, np.searchsorted(np.cumsum(lengths), odd, side="right"), count - 1)
        return sym, lengths

    def batch(self, sym: np.ndarray, lengths: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agenda for many chunks: each round merges the best candidate of every chunk.

        Takes the symbols in a row, the chunks' lengths (1 to 255) and keys;
        returns the pieces in a row, the chunks' piece counts and the draws that
        each chunk took.
        """
        n, limit, many, kind = self.kind(self.size), limit_of(dropout), len(lengths), self.kind
        of = np.repeat(np.arange(many, dtype=np.int32), lengths)
        starts = np.cumsum(lengths) - lengths
        place = (np.arange(len(sym)) - np.repeat(starts, lengths)).astype(kind)
        sym, done, drawn = sym.astype(kind), [], np.zeros(many, np.int64)

        def candidates(at: np.ndarray, number: np.ndarray | None) -> np.ndarray:
            """Slots of the pairs that begin at ``at`` (-1: none, or skipped); ``number`` is that of each, default the next of its chunk."""
            slot = self.lookup(sym[at] * n + sym[at + 1])
            ok = np.flatnonzero(slot >= 0)
            own = of[at[ok]]
            if number is None:  # one pair a chunk
                mine = drawn[own]
                drawn[own] += 1
            else:
                mine = np.arange(len(ok)) - np.searchsorted(own, own)  # pairs come chunk by chunk
                drawn[:] = np.bincount(own, minlength=many)
            if limit:
                slot[ok[skipped_all(key[own], mine, limit)]] = -1
            return slot

        slot = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(of[1:] == of[:-1])
        slot[inner] = candidates(inner, np.zeros(0))
        while len(sym):
            at = np.flatnonzero(slot >= 0)
            # rank first, then place: the least value is the agenda's head
            order, owner = self.order[slot[at]] | place[at], of[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(at) else np.zeros(0, np.int64)
            going = np.zeros(many, bool)
            going[owner[first]] = True
            over = ~going[of]
            if over.any():
                done.append((of[over].astype(np.int64) << 8 | place[over], sym[over]))
            if not len(at):
                break
            best = np.minimum.reduceat(order, first)
            head = at[order == np.repeat(best, np.diff(np.r_[first, len(at)]))]
            sym[head] = self.joins[slot[head]]
            keep = ~over
            keep[head + 1] = False
            head = (np.cumsum(keep) - 1)[head]
            sym, of, place, slot = sym[keep], of[keep], place[keep], slot[keep]
            slot[head] = -1
            right = head[np.r_[of[1:] == of[:-1], False][head]] if len(of) else head
            slot[right] = candidates(right, None)
            left = head[head > 0]
            left = left[of[left - 1] == of[left]] - 1
            slot[left] = candidates(left, None)
        if not done:
            return np.zeros(0, np.int32), np.zeros(many, np.int64), drawn
        at, sym = (np.concatenate(x) for x in zip(*done))
        return sym[np.argsort(at)].astype(np.int32), np.bincount(at >> 8, minlength=many), drawn

    def decode_bytes(self, ids) -> bytes:
        """The UTF-8 bytes of a list of pieces, without the dummy prefix."""
        return b"".join(map(self.out.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        """The text of a list of pieces."""
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


class Runs:
    """Growing table of runs of integers, one for each number."""

    def __init__(self):
        self.flat, self.start, self.size, self.rows = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        rows = slice(self.rows, self.rows + len(sizes))
        self.start[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.rows = self.used + len(flat), self.rows + len(sizes)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` behind each other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Numbers(dict):
    """Numbers of chunks; a new one gets the next, long ones -1."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > LONG:
            return -1
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Encodes texts; remembers each chunk's symbols, its pieces without dropout, and the draws that these take."""

    def __init__(self, codec: Codec, dropout: float = DROPOUT, seed: int = SEED):
        self.codec, self.dropout, self.seed = codec, dropout, seed
        self.limit = limit_of(dropout)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.symbols, self.pieces, self.draws, self.bytes = Runs(), Runs(), np.zeros(0, np.int64), 0

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            sym, sizes = self.codec.flat_symbols(part)
            pieces, counts, drawn = self.codec.batch(sym, sizes, np.zeros(len(part), np.uint64), 0.0)
            self.symbols.add(sym, sizes)
            self.pieces.add(pieces, counts)
            self.draws = np.concatenate([self.draws, drawn])
            self.bytes += 4 * (len(sym) + len(pieces)) + 200 * len(part)

    def _run(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agenda of known chunks under their keys: pieces in a row, piece counts, draws taken."""
        done = []
        for at in range(0, len(numbers), TOGETHER):
            own = numbers[at : at + TOGETHER]
            sizes = self.symbols.size[own]
            done.append(self.codec.batch(gather(self.symbols.flat, self.symbols.start[own], sizes), sizes, keys[at : at + TOGETHER], self.dropout))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _pieces(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of chunks under their keys, in a row, and each chunk's piece count."""
        if self.bytes > REMEMBERED:
            self._forget()
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self._learn(self.known.new)
        self.known.new = []
        short = number >= 0
        start, size = np.where(short, self.pieces.start[number], 0), np.where(short, self.pieces.size[number], 0)
        pools, offset = [self.pieces.flat[: self.pieces.used]], self.pieces.used

        def take(at: np.ndarray, pieces: np.ndarray, counts: np.ndarray, of: np.ndarray | None = None) -> None:
            """Chunks ``at`` have the runs ``of`` (default: one each, in order)."""
            nonlocal offset
            first = offset + np.cumsum(counts) - counts
            start[at], size[at] = (first, counts) if of is None else (first[of], counts[of])
            pools.append(pieces)
            offset += len(pieces)

        if self.limit and len(chunks):
            draws = first_draws(keys, self.limit)
            needed = np.zeros(len(number), np.int64)
            needed[short] = self.draws[number[short]]
            looked = lambda n: np.where(n < DRAWS, (np.uint64(1) << np.minimum(n, DRAWS).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFF))
            at = np.flatnonzero(short & ((needed > DRAWS) | (draws & looked(needed) != 0)))
            # equal chunks with equal first draws run once, if the agenda takes no more draws than those
            seen = np.minimum(needed[at] + 2, DRAWS)
            case = number[at].astype(np.uint64) << np.uint64(DRAWS) | draws[at] & looked(seen)
            _, first, of = np.unique(case, return_index=True, return_inverse=True)
            pieces, counts, drawn = self._run(number[at[first]], keys[at[first]])
            take(at, pieces, counts, of)
            alone = (drawn > seen[first])[of]
            alone[first] = False
            rest = at[alone]
            pieces, counts, _ = self._run(number[rest], keys[rest])
            take(rest, pieces, counts)
        if not short.all():
            rest = np.flatnonzero(~short)
            own = [np.array(self.codec.heap(self.codec.symbols(chunks[k]), int(keys[k]), self.dropout), np.int32) for k in rest.tolist()]
            take(rest, np.concatenate(own), np.array([len(x) for x in own], np.int64))
        return gather(np.concatenate(pools) if len(pools) > 1 else pools[0], start, size), size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The pieces of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str], np.ndarray]] = []

        def flush():
            flat, counts = self._pieces([c for _, own, _ in held for c in own], np.concatenate([k for _, _, k in held]))
            ends = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum([len(own) for _, own, _ in held])]].tolist()
            for (i, _, _), a, b in zip(held, ends, ends[1:]):
                out[i].append(flat[a:b])
            held.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            base, place = np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)), 1
            text, at = " " + text, 0
            while at < len(text):
                start = _START.search(text, at + PIECE) if len(text) > at + PIECE else None
                end = start.start() if start else len(text)
                own = _CHUNK.findall(text, at, end)
                held.append((i, own, _mix_all(base + np.arange(place, place + len(own), dtype=np.uint64) * np.uint64(_C[2]))))
                at, place, waiting = end, place + len(own), waiting + len(own)
                if waiting >= AT_ONCE:
                    flush()
                    waiting = 0
        if held:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


_codecs: dict[str, Codec] = {}
_encoders: dict[tuple, Encoder] = {}


def codec(model_file: str) -> Codec:
    """The model, read once by each Python process."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encoder(model_file: str, dropout: float = DROPOUT, seed: int = SEED) -> Encoder:
    """An encoder whose memory lasts over the tasks of a Python process."""
    key = (model_file, dropout, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(codec(model_file), dropout, seed)
    return _encoders[key]


def encode_rows(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``doc_id, pieces array<int>, n_bytes, decoded_sha256, lossless`` for every row.

    Every text is decoded again; ``lossless`` says that its bytes came back.
    ``model_file`` is a path on every machine.
    """

    def make():
        own = encoder(model_file, dropout, seed)

        def run(columns):
            texts = columns[1]
            found = own.encode(texts)
            back = [own.codec.decode_bytes(x.tolist()) for x in found]
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            raw = [t.encode() for t in texts]
            return [columns[0], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), [len(r) for r in raw], [hashlib.sha256(b).hexdigest() for b in back], [b == r for b, r in zip(back, raw)]]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), make, f"doc_id {kind}, pieces array<int>, n_bytes bigint, decoded_sha256 string, lossless boolean")


def decode_rows(rows: DataFrame, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``doc_id, text`` of encoded rows; null pieces give a null text."""

    def make():
        own = codec(model_file)

        def run(columns):
            return [columns[0], [None if x is None else own.decode(x) for x in columns[1]]]

        return run

    kind = rows.schema[id_col].dataType.simpleString()
    return map_rows(rows.select(F.col(id_col).alias("doc_id"), F.col(pieces_col).alias("pieces")), make, f"doc_id {kind}, text string")
