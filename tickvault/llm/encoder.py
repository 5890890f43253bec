"""Token ids of whole texts, by the ``tokenizers`` library, with a word cache.

The tokenizer drops white space and splits words before it merges, so a text's
ids are the ids of its pieces between blanks end to end. A batch of texts is cut
into pieces and these into distinct ones by Arrow; each Python worker keeps the
ids of pieces it has met, a new piece is put together from those of its
pre-tokens, and only new pre-tokens go through the library, many to a call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Bytes a worker keeps, as pre-tokens and as pieces, in each of two generations
#: (with the batch that fills one about 250 MB in all).
MAX_UNITS, MAX_PIECES = 68 << 20, 50 << 20
#: What an entry takes beside its text and ids: two objects and its table slot.
_ENTRY = 170
#: Rows, and bytes of text, encoded at once (a longer text alone).
MAX_ROWS, MAX_BYTES = 2048, 4 << 20
_JOINED = 256

# The tokenizer's own pre-token pattern over lower-case Latin-1 text, its
# classes written out: letters, numbers, white space of that range.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_UNIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
_FIND = re.compile(_UNIT).findall
_FIND_LINES = re.compile(_UNIT + "|\n").findall
#: Stands between pieces; no id has these bytes.
_BREAK = b"\xff" * 4
# Latin-1 text is unchanged by NFC and folds character by character. Any other,
# or one that may hold a special token, is not folded or cut into pre-tokens here.
_SPECIAL = "[^\\x{0}-\\x{ff}]|<\\|"

_STATE: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, before + MAX_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + MAX_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


class _Cache:
    """Ids by text, in two generations: a full one becomes the old one, whose
    entries come back when they are met again, so what is frequent is learned
    once. Full is meant in bytes, as a text without blanks is one entry."""

    def __init__(self, most: int, always: dict[str, bytes]):
        self.most, self.always = most, always
        self.now, self.old, self.held = dict(always), {}, 0

    def turn(self) -> None:
        if self.held > self.most:
            self.old, self.now, self.held = self.now, dict(self.always), 0

    def keep(self, new: dict[str, bytes]) -> None:
        self.now.update(new)
        self.count(len(new), sum(map(len, new)) + sum(map(len, new.values())))

    def count(self, entries: int, size: int) -> None:
        self.held += _ENTRY * entries + size

    def unknown(self, keys: set[str]) -> set[str]:
        new = keys.difference(self.now)
        back = {k: self.old[k] for k in new if k in self.old} if self.old else {}
        self.keep(back)
        return new.difference(back)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes,
    ``flat(texts)`` all ids and where each text's begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units = _Cache(MAX_UNITS, {"\n": _BREAK})
        self.pieces = _Cache(MAX_PIECES, {"": b""})

    def _learn(self, units: list[str]) -> None:
        groups = [units[i : i + _JOINED] for i in range(0, len(units), _JOINED)]
        joined = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, enc in zip(groups, joined, strict=True):
            words = enc.word_ids
            if None not in words:
                at = np.fromiter(words, np.int64, len(words))
                if len(at) and at[-1] == len(group) - 1:
                    ends = (np.searchsorted(at, np.arange(len(group)), side="right") * 4).tolist()
                    ids, start = np.array(enc.ids, "<u4").tobytes(), 0
                    for unit, end in zip(group, ends, strict=True):
                        self.units.now[unit] = ids[start:end]
                        start = end
                    self.units.count(len(group), sum(map(len, group)) + len(ids))
                    continue
            self.units.keep(self._singly(group))

    def _singly(self, texts: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return {text: np.array(one.ids, "<u4").tobytes() for text, one in zip(texts, found, strict=True)}

    def _know(self, pieces: list[str], plain: bool) -> None:
        new = list(self.pieces.unknown(set(pieces)))
        if not plain:
            self.pieces.keep(self._singly(new))
            return
        if not new:
            return
        lines = "\n".join(new)
        cut = _FIND_LINES(lines)  # a piece holds no line end
        units = self.units.unknown(set(cut))
        # a unit that is not one pre-token would shift the joined words
        alone = [u for u in units if _FIND(u) == [u]]
        self._learn(alone)
        self.units.keep(self._singly(list(units.difference(alone))))
        ids = b"".join(map(self.units.now.__getitem__, cut))
        self.pieces.count(len(new), len(lines) + len(ids))
        self.pieces.now.update(zip(new, ids.split(_BREAK), strict=True))

    def _encoded(self, texts: pa.Array, plain: bool, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's end."""
        if plain:
            # other white space stays inside a piece and parts its pre-tokens
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._know(pieces, plain)
        known = [*map(self.pieces.now.__getitem__, pieces), end]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        starts = np.cumsum(sizes) - sizes
        # the end id is one more piece behind every text
        row = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(pieces))
        size = sizes[row]
        stop = np.cumsum(size)
        at = np.repeat(starts[row] - (stop - size), size)
        at += np.arange(len(at))
        return flat[at], np.concatenate([[0], stop])[ends + np.arange(1, len(ends) + 1)]

    def flat(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, uint32; offsets of each text's, one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring_regex(texts, _SPECIAL).to_numpy(zero_copy_only=False)
        self.units.turn()
        self.pieces.turn()
        if not special.any():
            ids, ends = self._encoded(texts, True, end)
            return ids, np.concatenate([[0], ends])
        # both kinds on their own, then every text at its place
        kinds = [(~special, True), (special, False)]
        done = [(np.flatnonzero(mask), *self._encoded(texts.filter(pa.array(mask)), plain, end)) for mask, plain in kinds if mask.any()]
        size = np.zeros(len(texts), np.int64)
        for where, _, ends in done:
            size[where] = np.diff(ends, prepend=0)
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(offsets[-1]), np.uint32)
        for where, ids, ends in done:
            own = np.diff(ends, prepend=0)
            out[np.arange(len(ids)) + np.repeat(offsets[where] - (ends - own), own)] = ids
        return out, offsets

    def encode(self, texts: list[str | None] | pa.Array, end: bytes = b"") -> list[bytes]:
        ids, offsets = self.flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)
        data, at = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]
