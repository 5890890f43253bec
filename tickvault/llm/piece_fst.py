"""SentencePiece encoding and decoding by weighted finite-state transducers.

Four machines are compiled from the model file: the normaliser (blank to
U+2581, one put before the text), the pieces (a trie whose arcs emit piece ids
with weight minus score), the byte fallback (arcs for characters without a
piece) and the merge order (an acceptor over adjacent pieces: a pair weighs
nothing if byte-pair merging keeps it apart, infinity otherwise). A merge-model
segmentation is the one whose adjacent pairs are all kept apart, so the
tropical shortest path through the composition with an input is the model's own
encoding. Decoding runs the same machines backwards.

The composition is cut where no piece can cross (found from the pieces
themselves), and every Python worker keeps the paths of parts it has met.

Defined results: a null or empty text has no ids; repeated rows encode alike; a
text of any length is read whole; decoding gives the text back, but U+2581 in a
text comes back as a blank, as with the library. Models with a normaliser table
or another model type are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import table

BLANK = "▁"
#: Paths a worker keeps, of whole parts and of their cuts; each cache starts
#: anew beyond its size.
MAX_PARTS, MAX_CUTS = 400_000, 700_000
_BATCH = 64
_INF = float("inf")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message, one level deep."""
    at = 0

    def varint() -> int:
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
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Machine:
    """The compiled transducers of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        settings = {n: dict(_fields(v)) for n, v in _fields(sp.serialized_model_proto()) if n in (2, 3)}
        if settings[2].get(3, 1) != 2 or settings[3].get(2):
            raise ValueError("a merge model without a normaliser table is needed")
        self.prefix = bool(settings[3].get(3, 1))
        self.squeeze = bool(settings[3].get(4, 1))
        if self.squeeze:
            raise ValueError("a model that keeps blanks as they are is needed")
        self.piece, self.weight, self.bytes_, self.text = {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.piece[p] = i
                self.weight[i] = -sp.get_score(i)
                self.text.append(p.encode())
        self.name = {i: p for p, i in self.piece.items()}
        # the trie: every beginning of a piece, with the piece's id where one ends
        self.arcs: dict[str, int | None] = {p[:k]: None for p in self.piece for k in range(1, len(p))}
        self.arcs.update(self.piece)
        self.pairs: dict[int, bool] = {}
        self.met: dict[str, bytes] = {}
        self.paths: dict[str, bytes] = {}
        self.inside = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        self.parts = re.compile(self._cuts()).findall

    def _cuts(self) -> str:
        """Pattern of parts that no piece reaches across: marks are characters
        that pieces only join with one another or with blanks before them."""
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} | {"\n"}
        if any(a != BLANK and b == BLANK for p in self.piece for a, b in zip(p, p[1:], strict=False)):
            return r"(?s).+"
        while True:
            joined = {
                c
                for p in self.piece
                for a, b in zip(p, p[1:], strict=False)
                if a != BLANK and ((a in marks) != (b in marks))
                for c in (a, b)
            }
            if not joined & marks:
                break
            marks -= joined
        m = re.escape("".join(sorted(marks)))
        return f"(?s){BLANK}*(?:[{m}]+|[^{BLANK}{m}]+)|{BLANK}+" if m else f"(?s){BLANK}*[^{BLANK}]+|{BLANK}+"

    def _merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging: best score first, leftmost first among equals."""
        symbols = list(symbols)
        while True:
            best, at = _INF, -1
            for k in range(len(symbols) - 1):
                i = self.piece.get(symbols[k] + symbols[k + 1])
                if i is not None and self.weight[i] < best:
                    best, at = self.weight[i], k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _apart(self, a: int, b: int) -> bool:
        """The merge-order acceptor's arc from piece ``a`` to piece ``b``."""
        pair = a << 32 | b
        kept = self.pairs.get(pair)
        if kept is None:
            x, y = self.name[a], self.name[b]
            kept = self.pairs[pair] = self._merged(list(x + y)) == [x, y]
        return kept

    def _shortest(self, part: str) -> list[int]:
        """Tropical shortest path over (position, last piece)."""
        # states[p]: last piece (None after a fallback) -> (weight, start, last piece there)
        n = len(part)
        states: list[dict] = [{None: (0.0, 0, None)}] + [{} for _ in part]
        for start in range(n):
            here = states[start]
            if not here:
                continue
            # walk the trie from here: every piece that begins at this position
            for end in range(start + 1, n + 1):
                i = self.arcs.get(part[start:end], -1)
                if i == -1:
                    break
                if i is None or (end - start > 1 and not self._whole(i)):
                    continue
                there, weight = states[end], self.weight[i]
                for last, (w, _, _) in here.items():
                    if last is None or self._apart(last, i):
                        total = w + weight
                        if i not in there or total < there[i][0]:
                            there[i] = (total, start, last)
            if part[start] not in self.piece:
                last, (w, _, _) = min(here.items(), key=lambda s: s[1][0])
                states[start + 1][None] = (w, start, last)
        ids: list[int] = []
        end, last = len(part), min(states[-1].items(), key=lambda s: s[1][0])[0]
        while end:
            _, start, before = states[end][last]
            if last is None:
                ids += [self.bytes_[b] for b in reversed(part[start:end].encode())]
            else:
                ids.append(last)
            end, last = start, before
        return ids[::-1]

    def _whole(self, i: int) -> bool:
        # a piece that merging never builds from its own characters has no arc
        kept = self.pairs.get(-i)
        if kept is None:
            kept = self.pairs[-i] = self._merged(list(self.name[i])) == [self.name[i]]
        return kept

    def _path(self, part: str) -> bytes:
        """Ids of one part: shortest paths between the neighbours no piece holds."""
        out, start = [], 0
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in self.inside:
                cut = part[start:k]
                ids = self.paths.get(cut)
                if ids is None:
                    ids = self.paths[cut] = np.array(self._shortest(cut), "<u4").tobytes()
                out.append(ids)
                start = k
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian uint32 bytes."""
        if not text:
            return b""
        if len(self.met) > MAX_PARTS:
            self.met.clear()
        if len(self.paths) > MAX_CUTS:
            self.paths.clear()
        parts = self.parts((BLANK if self.prefix else "") + text.replace(" ", BLANK))
        met = self.met
        for p in set(parts).difference(met):
            met[p] = self._path(p)
        return b"".join(map(met.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian uint32 bytes."""
        out = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = out.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_MACHINES: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """This worker's machine for a model file."""
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path)
    return _MACHINES[path]


def encode(text: Column, path: str | None = None) -> Column:
    """Ids (binary, little-endian uint32) of a text column."""
    path = path or default_path()
    return F.pandas_udf(lambda x: x.map(lambda t: machine(path).encode(t)), "binary")(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of a column of ids."""
    path = path or default_path()
    return F.pandas_udf(lambda x: x.map(lambda t: machine(path).decode(t or b"")), "string")(ids)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            for k in range(0, batch.num_rows, _BATCH):
                part = batch.slice(k, _BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [m.encode(t) for t in texts]
                back = [m.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([len(t) for t in back], pa.int64()),
                        pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "n_decoded", "same"],
                )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' count and checksum, decoded length, and whether
    decoding gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(
        _digests(default_path()), "doc_id long, n_ids long, ids_crc32 long, n_decoded long, same boolean"
    )
