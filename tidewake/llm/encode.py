"""Exact encoding with a public tokenizer file, chunks and pretokens remembered per worker."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .byte_table import Table, beyond_keys, keys, one_of_each, padded, ranges
from .common import Memory

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SPACED_MOST, WORDS_MOST = 1_200_000, 300_000  # chunks that a worker remembers; two workers share an executor's memory with a full heap
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
_SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LOADED: dict[str, Encoder] = {}
_BIG = sys.byteorder == "big"


class _Irregular(Exception):
    pass


class _Memory(dict):
    """chunk -> ids as little-endian 32-bit bytes. Two generations bound the memory and keep what is in use."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Encodes whole texts with the tokenizers library, every distinct chunk once while it is remembered.

    A text is cut where the tokenizer's own splitting always cuts: before one space between two non-space characters and,
    inside a chunk of Latin letters, ASCII digits and ASCII signs without apostrophes, between these kinds. Such a pretoken goes
    to the library's model by itself; any other chunk goes through the whole tokenizer.

    path: a tokenizers file. spaced: the vocabulary keeps a leading space in the token (byte-level BPE); otherwise white
    space only separates. most: chunks remembered (a bound on memory, not on results).
    """

    def __init__(self, path: str, spaced: bool, most: int = SPACED_MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.spaced = self.tok.model, spaced
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        mapped = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(1, 256)}  # a character's bytes as the model sees them
        self.letters = mapped
        self.pretokens = _Memory(self._pretoken, most // 8)
        self.plain = _Memory(self._chunk, most if not spaced else most // 8)
        self.after = _Memory(self._spaced, most)

        self.units = None

    def forget(self) -> None:
        self.units = None
        for m in (self.pretokens, self.plain, self.after):
            m.clear()
            m.old = {}

    def _model(self, pretoken: str) -> bytes:
        return _little([t.id for t in self.model.tokenize(pretoken)])

    def _pretoken(self, word: str) -> bytes:
        return self._model(word if word.isascii() and word[0] != " " and word != "\n" else word.translate(self.letters))

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.spaced and (m := _WORD.fullmatch(chunk)):
            word, signs = m.groups()
            low = word.lower()
            if signs:
                return self.plain[low] + self.pretokens[signs]
            return self._model(low if low.isascii() else low.translate(self.letters)) if low == chunk else self.plain[low]
        body = chunk[1:] if chunk[0] == " " else chunk
        runs = _SIMPLE.findall(body)
        if not runs or sum(map(len, runs)) != len(body):
            return _little(self.tok.encode(chunk, add_special_tokens=False).ids)
        if self.spaced:
            if body is not chunk:
                runs[0] = " " + runs[0]
            if any(r == "\n" for r in runs) and not _alone(runs):
                return _little(self.tok.encode(chunk, add_special_tokens=False).ids)
            return b"".join(map(self.pretokens.__getitem__, runs))
        out = []
        for r in runs:
            if r[0].isdigit():
                out += list(r)  # this vocabulary takes digits one by one
            elif r != "\n":
                out.append(r.lower())
        return b"".join(map(self.pretokens.__getitem__, out))

    def _spaced(self, piece: str) -> bytes:
        """A piece that follows a space, as the letter that the model sees for it tells."""
        if piece.isalpha() and piece.isascii():
            return self._model(self.letters[32] + piece)
        if m := _WORD.fullmatch(piece):
            word, signs = m.groups()
            return self.after[word] + self.pretokens[signs] if signs else self._model(self.letters[32] + word.translate(self.letters))
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        return self._chunk(" " + piece)

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        if not self.spaced:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        try:
            if rest and head and head[-1].isspace():
                raise _Irregular
            return self.plain[head] + b"".join(map(self.after.__getitem__, rest))
        except _Irregular:
            return b"".join(map(self.plain.__getitem__, _BETWEEN.split(text)))

    def column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole Arrow column of texts, each followed by an end id, and the number of ids of each text: ids() for a byte-level vocabulary, by arrays."""
        if self.units is None:
            self.units = _Units(self)
        return self.units.column(texts, end)


_OTHER, _LETTER, _DIGIT, _SIGN, _FEED, _SPACE, _BLANK = range(7)
_KIND = np.zeros(256, np.uint8)
for _k, _chars in ((_DIGIT, "0123456789"), (_FEED, "\n"), (_SPACE, " "), (_BLANK, "\t\v\f\r\x1c\x1d\x1e\x1f")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[[c for c in range(33, 127) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _SIGN
_APART = re.compile(rb"(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xed][\x80-\xbf]{2}) (?=[\x21-\x7e\xc3-\xdf\xe4-\xed])")  # a space that is a cut for sure
_LEADS = np.zeros(256, bool)
_LEADS[0xE1:0xE4] = True  # first bytes of white space of three bytes; that of two begins with 0xC2
_BLANKS = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


class _Units(Table):
    """Ids of a column's texts by arrays over its bytes. A text is cut into units where Encoder cuts it: pretokens of one kind of character with the space before them,
    and whole chunks where a chunk holds anything else. A unit's ids depend on its bytes alone. The table's values are where a unit's ids start in flat << 32 | their number;
    units that have no keys are remembered in a dictionary. Between parts of a column of about PART bytes a full table starts anew (a bound on memory, not on results).
    """

    BITS, MOST, LONG_MOST, PART = 22, 2_000_000, 100_000, 1 << 20

    def __init__(self, enc: Encoder):
        self.enc = enc
        if hasattr(enc.model, "_resize_cache"):
            enc.model._resize_cache(0)  # each unit is asked for once
        self.clear()

    def clear(self) -> None:
        super().__init__(self.BITS)
        self.flat, self.used, self.long = np.zeros(1 << 20, np.uint32), 0, {}

    def _add(self, ids: np.ndarray) -> int:
        """Keeps ids of one or more units, returns their start."""
        at = self.used
        self.used += len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[at : self.used] = ids
        return at

    def _cut(self, b: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of units in the n first bytes, and which of them are whole chunks. starts: those of non-empty texts; b has room for zeros behind."""
        kind = _KIND[b]
        two = np.flatnonzero(b == 0xC3)
        two = two[(b[two + 1] != 0x97) & (b[two + 1] != 0xB7)]  # Latin letters; the others are signs beyond ASCII
        kind[two] = kind[two + 1] = _LETTER
        ends = np.append(starts[1:], n) - 1
        space = np.flatnonzero(kind == _SPACE)
        before, behind = kind[space - 1], kind[space + 1]
        first, last = np.isin(space, starts), np.isin(space, ends)
        good = ((before < _FEED) | first) & (behind < _FEED) & ~last
        near = ((before == _OTHER) & ((b[space - 2] == 0xC2) | _LEADS[b[space - 3]])) | ((behind == _OTHER) & ((b[space + 1] == 0xC2) | _LEADS[b[space + 1]]))
        for i in np.flatnonzero(good & near).tolist():  # beside what may be white space beyond ASCII
            at = int(space[i])
            near = b[max(0, at - 3) : at + 4].tobytes()
            at = min(3, at)
            good[i] = not ((not first[i] and near[:at].endswith(tuple(_BLANKS))) or near[at + 1 :].startswith(tuple(_BLANKS)))
        odd = kind == _OTHER
        odd |= kind == _BLANK
        odd[space[~good]] = True
        feed = np.flatnonzero(kind == _FEED)
        odd[feed[(kind[feed - 1] == _FEED) | (kind[feed + 1] == _FEED) | np.isin(feed, starts) | np.isin(feed, ends)]] = True
        head = np.zeros(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=head[1:])
        head[1:] &= kind[:-1] != _SPACE
        head[starts] = True
        odd = np.flatnonzero(odd[:n])
        at = np.flatnonzero(head[:n])
        if not len(odd):
            return at, np.zeros(len(at), bool)
        cut = np.union1d(space[good], starts)
        chunk = np.searchsorted(cut, odd, "right") - 1
        chunk = chunk[np.flatnonzero(np.diff(chunk, prepend=-1))]
        head[ranges(cut[chunk] + 1, np.append(cut, n)[chunk + 1])] = False
        at = np.flatnonzero(head[:n])
        whole = np.zeros(len(at), bool)
        whole[np.searchsorted(at, cut[chunk])] = True
        return at, whole

    def _learn(self, units: list[bytes], whole: np.ndarray) -> np.ndarray:
        """Values of units that are new, by the library."""
        tokenize, letters, chunk = self.enc.model.tokenize, self.enc.letters, self.enc._chunk
        ids, counts = array("I"), []
        for u, w in zip(b"\xff".join(units).decode("utf-8", "surrogateescape").split("\udcff"), whole.tolist()):
            if w:
                got = np.frombuffer(chunk(u), "<u4").tolist()
            else:
                got = [t.id for t in tokenize(u.replace(" ", letters[32]) if u.isascii() and u != "\n" else u.translate(letters))]
            ids.extend(got)
            counts.append(len(got))
        counts = np.array(counts, np.int64)
        return (self._add(np.frombuffer(ids, np.uint32)) + np.cumsum(counts) - counts) << 32 | counts

    def column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        edge = np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * wide().itemsize).astype(np.int64)
        n = int(edge[-1] - edge[0])
        b = np.frombuffer(texts.buffers()[2], np.uint8, n, int(edge[0])) if n else np.zeros(0, np.uint8)
        edge -= edge[0]
        starts, parts, at, done = edge[:-1][np.diff(edge) > 0], [], 0, 0
        past = np.zeros(len(edge), np.int64)  # ids before each text, without the end ids
        while at < n:
            to = int(edge[np.searchsorted(edge, min(at + self.PART, n))])
            if to > at + self.PART and (m := _APART.search(b, at + self.PART, to)):
                to = m.end() - 1
            first, last = np.searchsorted(starts, [at, to])
            begin = starts[first:last] - at
            ids, units, before = self._part(b[at:to], begin if len(begin) and begin[0] == 0 else np.insert(begin, 0, 0))
            first, last = np.searchsorted(edge, [at, to], "right")
            past[first:last] = done + np.append(before, len(ids))[np.searchsorted(units, edge[first:last] - at)]
            parts.append(ids)
            at, done = to, done + len(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return np.insert(ids, past[1:], np.uint32(end)), np.diff(past) + 1

    def _part(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where units start, numbers of ids before these) of a part of a column that begins and ends with a cut."""
        n = len(text)
        b = padded(text)
        at, whole = self._cut(b, n, starts)
        if self.kept + len(at) // 4 > self.MOST or len(self.long) > self.LONG_MOST:
            self.clear()
        size = np.diff(at, append=n)
        odd = beyond_keys(b[:n], at, size)
        low, high = keys(b, at, size)
        raw, value = b.tobytes(), self.find(low, high)
        value[odd] = -1
        miss = np.flatnonzero(value == 0)
        while len(miss):
            new = miss[one_of_each(low[miss], high[miss])]
            got = self._learn([raw[i:j] for i, j in zip(at[new].tolist(), (at[new] + size[new]).tolist())], whole[new])
            self.put(low[new], high[new], got)
            value[miss] = self.find(low[miss], high[miss])
            miss = miss[value[miss] == 0]  # different units of an equal mix
        for i in np.flatnonzero(odd).tolist():
            u = raw[at[i] : at[i] + size[i]]
            if u not in self.long:
                self.long[u] = int(self._learn([u], whole[i : i + 1])[0])
            value[i] = self.long[u]
        count = (value & 0xFFFFFFFF).astype(np.int32)
        past = np.cumsum(count)
        before = past - count
        where = np.repeat((value >> 32).astype(np.int32) - before.astype(np.int32), count)
        where += np.arange(len(where), dtype=np.int32)
        return self.flat[where], at, before


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if _BIG:
        a.byteswap()
    return a.tobytes()


def _alone(runs: list[str]) -> bool:
    """Every line feed stands between two non-space runs."""
    return runs[0] != "\n" and runs[-1] != "\n" and all(a != "\n" or b != "\n" for a, b in zip(runs, runs[1:]))


def encoder(name: str) -> Encoder:
    """The worker's encoder of a file in the folder of public tokenizers, or of any other path."""
    if name not in _LOADED:
        import public_tokenizers

        spaced = "byte" in os.path.basename(name)
        _LOADED[name] = Encoder(name if os.sep in name else public_tokenizers.path(name), spaced, SPACED_MOST if spaced else WORDS_MOST)
    Memory.use(f"encoder {name}", _LOADED[name].forget)
    return _LOADED[name]


def end_bytes(i: int) -> bytes:
    return _little([i])
