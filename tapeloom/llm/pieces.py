"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Texts are cut into marked words: a run of marks (U+2581, for spaces) and what follows it. The distinct words of a batch are sorted, which
is the depth-first order of their trie, and each word reuses the forward states of the prefix that it shares with the word before.
For a BPE vocabulary, words of up to ``SHORT_WORD`` characters take a step together: level by level, the states of all nodes of a depth of
the trie are found at once with numpy.

For a unigram vocabulary the state at a position is the best score and last piece of any segmentation up to there (Viterbi). A BPE
vocabulary has no such scores: the best-scoring segmentation is not what its merges give. There, the state is the last piece of the
prefix's own encoding. It is unique: a sequence of pieces is a BPE encoding if and only if each
neighbouring pair encodes to itself, so a piece that ends here extends the state at its start exactly when the pair does. Both
states depend on the prefix only, which is what makes them shareable.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Characters of a batch; bytes of the words (unigram) and of half of the pairs of pieces in long words (BPE) that a task's process remembers, four times
#: those of the pairs in short words; the longest word remembered.
BATCH_CHARS, CACHE_BYTES, CACHE_WORD = 1 << 20, 32 << 20, 64
#: Pieces of a long word that are packed at once; ids that are put in place at once.
PACKED_AT_ONCE, PLACED_AT_ONCE = 4096, 1 << 18
#: Characters of a word, and words, that go through the levels of their trie together.
SHORT_WORD, LEVEL_WORDS = 64, 1 << 14
#: Multiplier of the pairs' places in their table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: An unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED = 1, 4


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized protocol buffer message: numbers, and values as integers (varint, fixed) or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
            value = message[at : at + size]
            at += size
        yield tag >> 3, value


class Remembered:
    """A mapping of bounded size: when the newer half is full, it becomes the older half, which is forgotten."""

    def __init__(self, limit: int):
        self.half, self.used, self.new, self.old = limit // 2, 0, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if self.used > self.half:
            self.old, self.new, self.used = self.new, {}, 0
        self.new[key] = value
        self.used += 250 + 4 * sum(map(len, key)) + (len(value) if isinstance(value, bytes) else 0)


class Vocabulary:
    """Pieces with their scores, the ids of the 256 byte pieces, and the id of unknown characters."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int] | None, unknown: int, names: list[str], bpe: bool, prefix: bool = True):
        self.pieces, self.scores, self.byte_ids, self.unknown, self.bpe, self.prefix = pieces, scores, byte_ids, unknown, bpe, prefix
        self.floor = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces), default=1)
        self.texts = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(byte_ids or ()):
            self.texts[i] = bytes([b])
        #: Words can be cut before a mark and around line ends if no piece crosses there.
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        self.word = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+") if self.cuts else re.compile("(?s).+")
        self._words = Remembered(CACHE_BYTES)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._older: dict[tuple[str, str], bool] = {}
        self._most = CACHE_BYTES // (250 + 8 * self.longest)
        #: Neighbouring characters inside pieces; where two others meet, no merge can cross.
        self._joints = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Each suffix of a piece, with whether it can be a piece of an encoding: it is one, and encodes to itself.
        self._suffixes: dict[str, bool] = {}
        for p in pieces:
            for at in range(1, len(p)):
                self._suffixes.setdefault(p[at:], False)
        #: The merges that make each piece, in order: score, and the first and last part after it.
        self._merges: dict[str, list[tuple[float, str, str]]] = {}
        #: Each piece by itself, so that states refer to it instead of to a slice of the word.
        self._own = {p: p for p in pieces}
        #: Each piece as packed ids.
        self._packed = {p: np.int32(i).tobytes() for p, i in pieces.items()}
        for p in pieces:
            steps: list[tuple[float, str, str]] = []
            self._suffixes[p] = not bpe or self.merge(p, steps) == [p]
            self._merges[p] = steps
        if bpe:
            self._number()

    def _number(self) -> None:
        """The pieces as arrays. A unit is a piece or a character inside pieces, by number; the last number stands for all other characters.

        Suffixes of pieces are nodes of a tree, read from the end; a node and the character before it lead to the next node.
        """
        alphabet = sorted({c for p in self.pieces for c in p})
        self._units = [*self.pieces, *(c for c in alphabet if c not in self.pieces)]
        number = {u: i for i, u in enumerate(self._units)}
        self._other = len(self._units)
        self._unit_size = np.array([*map(len, self._units), 1], np.int32)
        self._unit_id = np.array([*(self.pieces.get(u, -1) for u in self._units), -1], np.int32)
        #: Characters as numbers, 0 for those that no piece has, by code point up to the largest.
        self._char = np.zeros(ord(alphabet[-1]) + 2 if alphabet else 1, np.int32)
        self._char[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        if len(self._char) > ord(" "):  # in cut words a space stands for the mark
            self._char[ord(" ")] = self._char[min(ord(MARK), len(self._char) - 1)]
        self._char_unit = np.array([self._other, *(number[c] for c in alphabet)], np.int32)
        node = {s: i for i, s in enumerate(self._suffixes)}
        self._char_node = np.array([-1, *(node.get(c, -1) for c in alphabet)], np.int32)
        self._node_unit = np.array([number[s] if usable else -1 for s, usable in self._suffixes.items()], np.int32)
        longer = [s for s in node if len(s) > 1]
        ways = np.array([node[s[1:]] for s in longer], np.int64) * len(self._char_unit) + np.array([self._char[ord(s[0])] for s in longer], np.int64)
        order = np.argsort(ways)
        self._ways, self._ends = np.append(ways[order], np.iinfo(np.int64).max), np.append(np.array([node[s] for s in longer], np.int32)[order], -1)
        #: What is known of pairs of units: twice the pair's number, plus one if it stays apart. A pair has one place, where a later one replaces it.
        self._held = np.full(1 << max(4, (CACHE_BYTES // 32).bit_length() - 1), -1, np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file; on the driver, since executors may not see the path."""
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, model: bytes) -> Vocabulary:
        """A serialized model: pieces, and what the trainer and the normaliser set. Settings that this class does not have are refused."""
        listed, trainer, normaliser = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                listed.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif field in (2, 3):
                (trainer if field == 2 else normaliser).update(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        unlike = {"model type": kind not in (UNIGRAM, BPE), "spaces as suffixes": trainer.get(24, 0), "user defined pieces": any(t == USER_DEFINED for *_, t in listed)}
        unlike |= {"character map": normaliser.get(2, b""), "removal of spaces": normaliser.get(4, 1), "unescaped spaces": not normaliser.get(5, 1)}
        if refused := [name for name, differs in unlike.items() if differs]:
            raise ValueError(f"the model asks for {', '.join(refused)}")
        plain = {n: i for i, (n, _, t) in enumerate(listed) if t == NORMAL}
        by = [i for i, (*_, t) in enumerate(listed) if t == 6]
        unknown = next((i for i, (*_, t) in enumerate(listed) if t == 2), 0)
        return cls(plain, {n: listed[i][1] for n, i in plain.items()}, by if len(by) == 256 else None, unknown, [n for n, *_ in listed], kind == BPE, bool(normaliser.get(3, 1)))

    def __reduce__(self):
        names = [t.decode("utf-8", "replace").replace(" ", MARK) for t in self.texts]
        return Vocabulary, (self.pieces, self.scores, self.byte_ids, self.unknown, names, self.bpe, self.prefix)

    def merge(self, word: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """BPE by its definition: join the neighbours whose union scores best, the leftmost first, until none is a piece; ``steps`` takes the merges."""
        score, no = self.scores.get, float("-inf")
        parts = list(word)
        joined = [score(a + b, no) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (best := max(joined)) > no:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
            if i:
                joined[i - 1] = score(parts[i - 1] + parts[i], no)
            if i < len(joined):
                joined[i] = score(parts[i] + parts[i + 1], no)
        return parts

    def _stay_apart(self, last: str, piece: str) -> bool:
        """Whether two encodings side by side are one: their merges are replayed in order of score until one across is better than the next of either.

        Up to then neither side sees the other. Of equal scores the leftmost is first: the left side's, the one across, the right side's.
        """
        score, no = self.scores.get, float("-inf")
        left, right = self._merges.get(last, ()), self._merges.get(piece, ())
        x, y, i, j = last[-1], piece[0], 0, 0
        while True:
            across = score(x + y, no)
            a = left[i][0] if i < len(left) else no
            b = right[j][0] if j < len(right) else no
            if across > a and across >= b:
                return False
            if a >= b:
                if a == no:
                    return True
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def _extends(self, last: str, piece: str) -> bool:
        """Whether ``last`` and ``piece`` stay apart; answers are kept in two halves of bounded size, the older of which is forgotten."""
        pair = (last, piece)
        known = self._older.get(pair)
        if known is None:
            known = self._stay_apart(last, piece)
        if len(self._pairs) >= self._most:
            self._older = self._pairs.copy()
            self._pairs.clear()
        self._pairs[pair] = known
        return known

    def _extend(self, last: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Which units of ``last`` and ``unit`` stay apart, as ``_extends`` says of pieces."""
        pair = last * np.int64(self._other + 1) + unit
        place = (pair.view(np.uint64) * SPREAD) >> np.uint64(65 - len(self._held).bit_length())
        held = self._held[place]
        apart = (held & 1).astype(bool)
        if len(new := np.flatnonzero(held >> 1 != pair)):
            asked, back = np.unique(pair[new], return_inverse=True)
            sides = [divmod(p, self._other + 1) for p in asked.tolist()]
            known = np.array([self._other in (a, b) or (x := self._units[a])[-1] + (y := self._units[b])[0] not in self._joints or self._stay_apart(x, y) for a, b in sides])
            apart[new] = known[back]
            self._held[place[new]] = 2 * pair[new] + apart[new]
        return apart

    def _last_units(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last unit of the encoding of each prefix of sorted words: rows by length of the prefix, columns by word, as ``_step_bpe`` finds them.

        ``chars`` has a row for each place of a character. Of words with one prefix the first finds its unit, the others take it over.
        """
        n = len(sizes)
        shared = np.zeros(n, np.int32)
        shared[1:] = np.logical_and.accumulate((chars[:, 1:] == chars[:, :-1]) & (chars[:, 1:] >= 0)).sum(axis=0)
        last = np.zeros((len(chars) + 1, n), np.int32)
        for i in range(1, len(chars) + 1):
            first = shared < i
            at = np.flatnonzero(first & (sizes >= i))
            char = chars[i - 1, at]
            node, unit = self._char_node[char], self._char_unit[char]
            for size in range(1, i + 1):
                if size > 1:
                    way = node * np.int64(len(self._char_unit)) + chars[i - size, at]
                    found = np.searchsorted(self._ways, way)
                    if (self._ways[found] != way).any():
                        raise AssertionError(i)
                    node = self._ends[found]
                    unit = self._node_unit[node]
                fits = unit >= 0
                if size < i:
                    usable = np.flatnonzero(fits)
                    fits[usable] = self._extend(last[i - size, at[usable]], unit[usable])
                last[i, at[fits]] = unit[fits]
                at, node = at[~fits], node[~fits]
                if not len(at):
                    break
            else:
                raise AssertionError(i)
            last[i] = last[i, np.maximum.accumulate(np.where(first, np.arange(n), 0))]
        return last

    def _pack_short(self, words: pa.LargeBinaryArray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed ids of sorted distinct words of at most ``SHORT_WORD`` characters one after the other, and how many each has; for BPE."""
        codes = np.frombuffer(_joined(words).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(sizes.max()) < sizes[:, None]
        chars = np.full(inside.shape, -1, np.int32)
        chars[inside] = self._char[np.minimum(codes, len(self._char) - 1)]
        last = self._last_units(np.ascontiguousarray(chars.T), sizes)
        at, word, steps, count = sizes.copy(), np.arange(len(words)), [], np.zeros(len(words), np.int64)
        while len(word := word[at[word] > 0]):
            unit = last[at[word], word]
            steps.append((word, unit))
            at[word] -= self._unit_size[unit]
            count[word] += 1
        ends = np.cumsum(count)
        units = np.empty(ends[-1], np.int32)
        for back, (word, unit) in enumerate(steps, 1):
            units[ends[word] - back] = unit
        ids = self._unit_id[units]
        packed, out, done = ids.tobytes(), [], 0
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():  # words with characters that are no pieces
            end = int(ends[i])
            first = end - int(count[i])
            cuts = np.cumsum(self._unit_size[units[first:end]]).tolist()
            text = _text(words[i])
            own = self._pack([text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
            out += [packed[4 * done : 4 * first], own]
            done, count[i] = end, len(own) // 4
        return b"".join([*out, packed[4 * done :]]), count

    def _pack_long(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word, parts in self.segment(words):
            yield word, self._pack(parts) if len(parts) <= PACKED_AT_ONCE else b"".join(self._pack(parts[i : i + PACKED_AT_ONCE]) for i in range(0, len(parts), PACKED_AT_ONCE))

    def _pack_words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, bytes, np.ndarray]:
        """The order in which distinct words are packed, their packed ids, and how many ids each has, in that order."""
        order = pc.array_sort_indices(words)
        words, order = words.take(order), _values(order, np.uint64).astype(np.int64)
        if not self.bpe:
            known = {w: self._words.get(w) for w in map(_text, words)}
            for word, ids in self._pack_long([w for w, ids in known.items() if ids is None]):
                known[word] = ids
                if len(word) <= CACHE_WORD:
                    self._words.put(word, ids)
            return order, b"".join(known.values()), np.array([len(ids) // 4 for ids in known.values()], np.int64)
        sizes = _characters(words)
        short = sizes <= SHORT_WORD
        some, long = (words, words.slice(0, 0)) if short.all() else (words.filter(_mask(m)) for m in (short, ~short))
        size, runs = sizes[short], []
        for i in range(0, len(some), LEVEL_WORDS):
            runs.append(self._pack_short(some.slice(i, LEVEL_WORDS), size[i : i + LEVEL_WORDS]))
        for _, ids in self._pack_long(list(map(_text, long))):
            runs.append((ids, np.array([len(ids) // 4])))
        return np.concatenate([order[short], order[~short]]), b"".join(ids for ids, _ in runs), np.concatenate([np.zeros(0, np.int64), *(n for _, n in runs)])

    def _step_bpe(self, word: str, first: int, last: list[str]) -> None:
        """Append the last pieces of the encodings of word[:i] to ``last``, for i from ``first``: the piece that extends the state at its own start."""
        suffixes, pairs, joints, own = self._suffixes, self._pairs, self._joints, self._own
        for i in range(first, len(word) + 1):
            at, piece = i - 1, word[i - 1]
            while at:
                before = last[at]
                if before[-1] + piece[0] not in joints:
                    break
                fits = pairs.get((before, piece))
                if fits or (fits is None and self._extends(before, piece)):
                    break
                at -= 1
                piece = word[at:i]
                while not (usable := suffixes.get(piece)):
                    if usable is None or not at:
                        raise AssertionError(word)
                    at -= 1
                    piece = word[at:i]
            last.append(own.get(piece, piece))

    def _step_viterbi(self, word: str, i: int, best: array) -> tuple[float, str]:
        found = None
        for size in range(min(self.longest, i), 0, -1):  # the longest piece wins a tie
            piece = word[i - size : i]
            score = self.scores.get(piece)
            if score is None and size == 1:
                score = self.floor
            if score is not None and (found is None or best[i - size] + score > found[0]):
                found = (best[i - size] + score, piece)
        return found

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of sorted distinct ``words``; the states of a common prefix are computed once.

        States of a character are a reference to one of the vocabulary's own pieces and, for Viterbi, a packed number, however long a word is.
        """
        last, best, before = [""], array("d", [0.0]), ""
        for word in words:
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], best[same + 1 :]
            if self.bpe:
                self._step_bpe(word, same + 1, last)
            else:
                for i in range(same + 1, len(word) + 1):
                    score, piece = self._step_viterbi(word, i, best)
                    best.append(score)
                    last.append(self._own.get(piece, piece))
            before, parts, at = word, [], len(word)
            while at:
                parts.append(last[at])
                at -= len(last[at])
            parts.reverse()
            yield word, parts

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if (i := self.pieces.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _pack(self, parts: list[str]) -> bytes:
        packed = list(map(self._packed.get, parts))
        return np.array(self.ids(parts), np.int32).tobytes() if None in packed else b"".join(packed)

    def _cut(self, texts: list[str | None]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The words of all texts as UTF-8, where a space stands for each mark, and which of them is the first of each text and after the last.

        A word starts at a line end, after one, and at a mark that follows none; if pieces cross there, only where a text starts.
        """
        head = " " if self.prefix else ""
        held = [(head + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, held)])
        held = b"".join(held)
        data = np.frombuffer(held, np.uint8)
        starts = np.zeros(len(data) + 1, bool)
        if self.cuts:
            starts[:-1] = data == ord(" ")
            starts[1:-1] &= data[:-1] != ord(" ")
            line = data == ord("\n")
            starts[:-1] |= line
            starts[1:] |= line
        starts[ends] = True
        offsets = np.flatnonzero(starts)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)]), np.searchsorted(offsets, ends)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as packed 32-bit integers; without byte pieces a run of unknown characters is one id, also across words."""
        words, first = self._cut(texts)
        words = words.dictionary_encode()
        order, packed, count = self._pack_words(words.dictionary)
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], sizes[order] = np.cumsum(count) - count, count
        ids, bounds = _placed(np.frombuffer(packed, np.int32), starts, sizes, _values(words.indices, np.int32))
        bounds = bounds[first].tolist()
        packed = [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, bounds, bounds[1:], strict=False)]
        return packed if self.byte_ids else [None if p is None else self._one_unknown_a_run(p) for p in packed]

    def _one_unknown_a_run(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, np.int32)
        unknown = ids == self.unknown
        return ids[~(unknown & np.concatenate(([False], unknown[:-1])))].tobytes() if len(ids) else packed

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _text(word: pa.LargeBinaryScalar) -> str:
    """A cut word with its marks."""
    return word.as_py().decode("utf-8", "surrogatepass").replace(" ", MARK)


def _values(numbers: pa.Array, kind: type) -> np.ndarray:
    """Numbers without nulls, as they are; ``pa.array`` would load pandas while a long word is encoded."""
    return np.frombuffer(numbers.buffers()[1], kind)[numbers.offset : numbers.offset + len(numbers)] if len(numbers) else np.zeros(0, kind)


def _mask(marked: np.ndarray) -> pa.BooleanArray:
    return pa.BooleanArray.from_buffers(pa.bool_(), len(marked), [None, pa.py_buffer(np.packbits(marked, bitorder="little"))])


def _joined(words: pa.LargeBinaryArray) -> bytes:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if len(words) else b""


def _characters(words: pa.LargeBinaryArray) -> np.ndarray:
    """How many characters each word has, none of which is empty: its bytes that do not continue one."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)] if len(words) else np.zeros(0, np.int64)
    data = np.frombuffer(_joined(words), np.uint8)
    return np.add.reduceat((data & 0xC0) != 0x80, offsets - offsets[0], dtype=np.int32) if len(words) else np.zeros(0, np.int32)


def _placed(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``which`` one after the other, and the bounds of the words in them; those of word i are ``ids[starts[i] : starts[i] + sizes[i]]``."""
    bounds = np.concatenate([[0], np.cumsum(sizes[which])])
    out, at = np.empty(bounds[-1], np.int32), 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PLACED_AT_ONCE, "right")) - 1)
        some, part = which[at:to], out[bounds[at] : bounds[to]]
        if to == at + 1:
            part[:] = ids[starts[some[0]] :][: len(part)]
        else:
            part[:] = ids[np.repeat(starts[some] - bounds[at:to] + bounds[at], sizes[some]) + np.arange(len(part))]
        at = to
    return out, bounds


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, length = 0, 0
    for i, t in enumerate(texts):
        length += len(t or "")
        if length >= BATCH_CHARS:
            yield first, i + 1
            first, length = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], digest_only: bool = False) -> DataFrame:
    """``keep`` columns with ``n_ids``, and ``ids array<int>``, or ``ids_sha256`` (of the ids as little-endian int32) and ``round_trip``.

    The encoding of a null text is null with n_ids 0, of an empty one empty. A text that holds U+2581 itself decodes to a space
    there, so its round trip fails, as in any implementation.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f"c{i}" for i in range(len(keep))]
    renamed = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            for first, last in _runs(texts):
                part, mine = batch.slice(first, last - first), texts[first:last]
                packed = own.encode(mine)
                columns = [*[part.column(n) for n in names], pa.array([len(p or b"") // 4 for p in packed], pa.int64())]
                if digest_only:
                    columns.append(pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in packed], pa.string()))
                    columns.append(pa.array([own.decode(p) == t for p, t in zip(packed, mine, strict=True)]))
                    yield pa.record_batch(columns, names=[*names, "n_ids", "ids_sha256", "round_trip"])
                else:
                    offsets = np.cumsum([0] + [len(p or b"") // 4 for p in packed]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
                    nulls = pa.array([p is None for p in packed])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), values, mask=nulls))
                    yield pa.record_batch(columns, names=[*names, "n_ids", "ids"])

    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    fields.append("n_ids long, ids_sha256 string, round_trip boolean" if digest_only else "n_ids long, ids array<int>")
    out = renamed.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *out.columns[len(keep) :])


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (with an ``ids array<int>`` column) with ``text``, which replaces a column of that name; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = encoded.drop("text")
    names = [f"c{i}" for i in range(len(rest.columns))]
    at = rest.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else shared.value.decode(np.array(i, np.int32).tobytes()) for i in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rest.schema.fields, strict=True))
    out = rest.toDF(*names).mapInArrow(run, f"{fields}, text string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rest.columns, strict=True)], "text")
