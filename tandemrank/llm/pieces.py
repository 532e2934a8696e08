"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.llm.common import table
from tandemrank.llm.registry import query

SPACE = "▁"  # fixed value: the marker that stands for a space
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character costs this more than the worst piece
_SLICE, _MOST_CELLS = 2 << 20, 1 << 20  # characters of texts and bytes of units solved at once
_LONG_UNIT = 96  # bytes; longer units are solved one by one


def default_model() -> str:
    """Path of a public piece model, if the machine has one."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) of each id of a model file, and whether texts get a leading space marker.

    Models that rewrite characters or trim spaces are refused: they could not be decoded losslessly.
    """
    pieces, dummy, trims, charsmap = [], True, True, b""
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                said = dict(_fields(value))
                score = struct.unpack("<f", said[2])[0] if 2 in said else 0.0
                pieces.append((said.get(1, b"").decode(), score, said.get(3, NORMAL)))
            elif number == 3:
                said = dict(_fields(value))
                charsmap, dummy, trims = said.get(2, b""), bool(said.get(3, 1)), bool(said.get(4, 1))
    if charsmap or trims:
        raise ValueError("the model normalises texts")
    return pieces, dummy


def double_array(words: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """``base``, ``check`` and ``value`` of a trie: state s goes with byte b to t = base[s] + b if check[t] == s."""
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], free = -2, 1
    keys = sorted(words)
    todo = [(0, 0, 0, len(keys))]
    while todo:
        state, depth, first, last = todo.pop()
        if first < last and len(keys[first]) == depth:
            value[state], first = words[keys[first]], first + 1
        children, at = [], first
        while at < last:
            b, start = keys[at][depth], at
            while at < last and keys[at][depth] == b:
                at += 1
            children.append((b, start, at))
        if not children:
            continue
        while check[free] != -1:
            free += 1
        low = children[0][0]
        spot, tries = max(free, low + 1), 0
        while True:
            if spot - low + 256 >= len(check):
                base += [0] * len(base)
                check += [-1] * len(check)
                value += [-1] * len(value)
            if check[spot] == -1 and all(check[spot - low + b] == -1 for b, _, _ in children):
                break
            spot, tries = spot + 1, tries + 1
        if tries > 32:  # the cells up to here are nearly full
            free = spot
        base[state] = spot - low
        for b, start, end in children:
            check[base[state] + b] = state
            todo.append((base[state] + b, depth + 1, start, end))
    size = max(i for i, c in enumerate(check) if c != -1) + 257
    return base[:size], check[:size], value[:size]


@dataclass
class Model:
    """Everything that encoding and decoding need; its size is that of the piece list."""

    pieces: list[tuple[str, float, int]]
    dummy: bool = True
    base: np.ndarray = field(init=False)
    check: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    _lists: list | None = field(init=False, default=None)

    def __post_init__(self):
        used = {p.replace(SPACE, " ").encode(): i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER) and p}
        self.base, self.check, self.value = (np.array(a, np.int32) for a in double_array(used))
        scores = [s for _, s, kind in self.pieces if kind == NORMAL]
        best, worst = max(scores, default=0.0), min(scores, default=0.0)
        self.scores = np.array([len(p.encode()) * best - 0.1 if kind == USER else s for p, s, kind in self.pieces])
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes_ids = np.full(256, self.unknown, np.int32)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes_ids[int(p[3:5], 16)] = i
        self.fallback = all(p[2] == BYTE for p in (self.pieces[i] for i in self.bytes_ids))
        # Pieces never hold a marker after another character, or a line end: then the best path passes these cuts.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, kind in self.pieces if kind in (NORMAL, USER))
        self.bytes_of = [
            b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE
            else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, kind in self.pieces
        ]

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each row of ``units`` (equally long texts as bytes), flat, and their number per row.

        The largest sum of scores wins, ties go to the longer last piece. All rows step through the trie together.
        A character without a piece of its own may be an unknown piece, which is spelled in bytes where the model can.
        """
        n, length = units.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, ids = np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int32)

        def offer(rows, to, score, start, piece):
            won = score > best[rows, to]
            rows, to = rows[won], to[won] if isinstance(to, np.ndarray) else to
            best[rows, to], back[rows, to], ids[rows, to] = score[won], start, piece[won]

        for i in range(length):
            rows = np.flatnonzero(best[:, i] > -np.inf)
            first, all_rows = units[rows, i], rows
            step = np.where(first < 128, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4)))
            alone = np.ones(n, bool)
            state = np.zeros(len(rows), np.int32)
            for j in range(i, length):
                to = self.base[state] + units[rows, j]
                good = self.check[to] == state
                rows, state, step_of = rows[good], to[good], step[good] if j == i else step_of[good]
                if not len(rows):
                    break
                piece = self.value[state]
                ends = piece >= 0
                if ends.any():
                    r, v = rows[ends], piece[ends]
                    offer(r, j + 1, best[r, i] + self.scores[v], i, v)
                    alone[r[step_of[ends] == j + 1 - i]] = False
            lost = alone[all_rows]
            if lost.any():
                r = all_rows[lost]
                offer(r, i + step[lost], best[r, i] + self.unknown_score, i, np.full(len(r), self.unknown, np.int32))
        at, rows, found = np.full(n, length, np.int32), np.arange(n), []
        while len(rows):
            start = back[rows, at[rows]]
            found.append((rows, start, at[rows] - start, ids[rows, at[rows]]))
            at[rows] = start
            rows = rows[start > 0]
        row, start, size, piece = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((start, row))
        row, start, size, piece = row[order], start[order], size[order], piece[order]
        odd = piece == self.unknown
        if odd.any() and self.fallback:
            many = np.where(odd, size, 1)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, start, piece, odd = (np.repeat(c, many) for c in (row, start, piece, odd))
            piece = np.where(odd, self.bytes_ids[units[row, start + place * odd]], piece)
        elif odd.any():  # neighbouring unknown characters are one piece
            keep = np.ones(len(row), bool)
            keep[1:] = ~(odd[1:] & odd[:-1] & (row[1:] == row[:-1]))
            row, piece = row[keep], piece[keep]
        return piece, np.bincount(row, minlength=n)

    def viterbi_long(self, unit: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long text, byte by byte, in time linear in its length."""
        if self._lists is None:
            self._lists = [a.tolist() for a in (self.base, self.check, self.value, self.scores)]
        base, check, value, scores = self._lists
        n, low = len(unit), -np.inf
        best, back, ids = [0.0] + [low] * n, [0] * (n + 1), [0] * (n + 1)
        i = 0
        while i < n:
            b, here, state, alone = unit[i], best[i], 0, True
            step = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
            for j in range(i, n):
                to = base[state] + unit[j]
                if check[to] != state:
                    break
                state, v = to, value[to]
                if v >= 0:
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1], ids[j + 1] = here + scores[v], i, v
                    alone = alone and j + 1 != i + step
            if alone and here + self.unknown_score > best[i + step]:
                best[i + step], back[i + step], ids[i + step] = here + self.unknown_score, i, self.unknown
            i += step
        out, at = [], n
        while at:
            v, start = ids[at], back[at]
            if v == self.unknown and self.fallback:
                out += [int(self.bytes_ids[b]) for b in reversed(unit[start:at])]
            elif not (v == self.unknown and out and out[-1] == v):
                out.append(v)
            at = start
        return np.array(out[::-1], np.int32), np.array([len(out)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, flat, and their number per text. Markers in a text count as spaces.

        Words with the spaces before them, and line ends, are solved apart, each distinct one once: no piece crosses
        these cuts, so the best path is the same. (With a model that has such pieces a text is one unit.)
        """
        lead = " " if self.dummy else ""
        parts = [(lead + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
        data = b"".join(parts)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        b = np.frombuffer(data, np.uint8)
        docs = np.cumsum([0, *map(len, parts)])
        cut = np.zeros(len(b) + 1, bool)
        if self.cuts:
            space, line = b == 32, b == 10
            cut[: len(b)] = line
            cut[0 : len(b)] |= space & ~np.concatenate([[False], space[:-1]])
            cut[1:] |= line
        cut[docs] = True
        starts = np.flatnonzero(cut)
        units = pa.Array.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        inverse, distinct = units.indices.to_numpy(), units.dictionary
        edge = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        raw = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        sizes = np.diff(edge)
        flat, counts = [], np.zeros(len(distinct), np.int64)
        owner = []
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            if size > _LONG_UNIT:
                for one in mine:
                    ids, number = self.viterbi_long(raw[edge[one] : edge[one + 1]].tobytes())
                    flat.append(ids)
                    counts[one] = number[0]
                    owner.append(np.array([one]))
                continue
            for some in np.array_split(mine, -(-len(mine) * int(size) // _MOST_CELLS)):
                ids, number = self.viterbi(raw[edge[some][:, None] + np.arange(size)])
                flat.append(ids)
                counts[some] = number
                owner.append(some)
        owner = np.concatenate(owner)
        place = np.zeros(len(distinct), np.int64)
        place[owner] = np.cumsum(counts[owner]) - counts[owner]
        flat, many = np.concatenate(flat), counts[inverse]
        total = np.cumsum(many)
        at = np.repeat((place[inverse] - (total - many)).astype(np.int32), many)
        at += np.arange(total[-1], dtype=np.int32)
        out = flat[at]
        first = np.searchsorted(starts[:-1], docs)
        return out, np.diff(np.concatenate([[0], total])[first])

    def decode(self, ids) -> str:
        """The text of ``ids``: bytes of byte pieces are joined, markers become spaces, the leading one goes."""
        data = b"".join([self.bytes_of[i] for i in ids])
        return data[1 if self.dummy and data[:1] == b" " else 0 :].decode("utf-8", "replace")


_LOADED: dict[int, Model] = {}


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole ``text``, which may be of any length; a null or empty text has none.

    All columns of ``docs`` stay; a column named ``out`` is replaced.
    """
    pieces = read_model(model or default_model())
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in docs.columns if c != out]
    packed, spot = docs.select(F.struct(*kept).alias("row")), kept.index(text)

    def run(batches):
        m = _model(held)
        for b in batches:
            texts, at = b.column("row").field(spot), 0
            while at < len(texts):
                some, size, start = [], 0, at
                while at < len(texts) and size < _SLICE:
                    some.append(texts[at].as_py())
                    size, at = size + len(some[-1] or ""), at + 1
                ids, many = m.encode(some)
                ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("row").slice(start, at - start), lists], names=["row", "ids"])

    got = packed.mapInArrow(run, f"row {_quoted(packed.schema['row'].dataType)}, ids array<int>")
    return got.select("row.*", F.col("ids").alias(out))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text of each list of ids; a null list is an empty text. All other columns stay."""
    pieces = read_model(model or default_model())
    held = df.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in df.columns if c != out]
    packed, spot = df.select(F.struct(*kept).alias("row")), kept.index(ids)

    def run(batches):
        m = _model(held)
        for b in batches:
            flat = b.column("row").field(spot)
            values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
            for at in range(0, len(flat), 500):
                some = ends[at : at + 501]
                texts = [m.decode(values[s:e].tolist()) for s, e in zip(some[:-1], some[1:])]
                rows = b.column("row").slice(at, 500)
                yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string())], names=["row", "decoded"])

    got = packed.mapInArrow(run, f"row {_quoted(packed.schema['row'].dataType)}, decoded string")
    return got.select("row.*", F.col("decoded").alias(out))


def _quoted(struct_type) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in struct_type.fields) + ">"


def _model(held) -> Model:
    key = held._path if getattr(held, "_path", None) else id(held)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(*held.value)
    return _LOADED[key]


def round_trip(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip``: whether decoding gives the text back, byte for byte.

    It does for every text without the marker character itself, which decodes to a space.
    """
    got = decode(encode(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return got.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("round_trip", same).drop("decoded")


@query("op4_sentencepiece")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fallback = F.size(F.filter("ids", lambda i: (i >= 3) & (i < 259))).cast("bigint")
    return round_trip(docs).select(
        "doc_id", "n_tokens", "round_trip", fallback.alias("n_byte_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
    )
