"""Word and n-gram hashes of whole batches of texts, computed with array operations inside a task.

A word is a run of bytes other than white space (0x20, 0x09-0x0D). Its 64-bit hash is a polynomial over random byte values, from
prefix sums modulo 2^64, so that cost is per byte and not per Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go, which bounds the arrays a task holds.
CHUNK = 1 << 20
SPACES = b" \t\n\r\x0b\x0c"
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_rng = np.random.default_rng(20_240_607)
_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
#: Byte classes by which a text falls into tokens; class 0 separates.
WORDS = np.ones(256, np.uint8)
WORDS[list(SPACES)] = 0
#: Letters (with all bytes of other scripts), digits, and signs, which are tokens of their own.
LETTERS_DIGITS_SIGNS = np.full(256, 3, np.uint8)
LETTERS_DIGITS_SIGNS[list(SPACES)] = 0
LETTERS_DIGITS_SIGNS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LETTERS_DIGITS_SIGNS[48:58] = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, classes and polynomials (not yet mixed) of the tokens of ``data``: its runs of one class other than 0."""
    raw = np.frombuffer(data, np.uint8)
    kind = np.concatenate(([0], classes[raw], [0])).astype(np.uint8)
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    opens = kind[1:][edge] > 0
    starts, ends = edge[opens], edge[1:][opens[:-1]]
    up, down = _powers_to(len(raw) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[raw] * up[: len(raw)])))
    return starts, ends, kind[1:][starts], (sums[ends] - sums[starts]) * down[starts]


def _hash_chunk(data: bytes, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the tokens of ``data``."""
    starts, _, _, sums = _tokens(data, classes)
    return starts, mix(sums)


def hash_words(text: bytes, classes: np.ndarray = WORDS) -> np.ndarray:
    """The hashes of the tokens of one text of any length, in pieces of CHUNK bytes; a token that a piece's end cuts goes on in the next."""
    out, held, length, of = [], 0, 0, 0
    for at in range(0, len(text), CHUNK):
        piece = text[at : at + CHUNK]
        starts, ends, kinds, sums = _tokens(piece, classes)
        if length and len(starts) and not starts[0] and kinds[0] == of:
            sums[0] = (held + int(sums[0]) * pow(int(_BASE), length, 1 << 64)) % (1 << 64)
            length += int(ends[0])
        else:
            if length:
                out.append(np.array([held], np.uint64))
            length = int(ends[-1] - starts[-1]) if len(starts) else 0
        if len(starts) > 1:
            length = int(ends[-1] - starts[-1])
        if len(starts) and ends[-1] == len(piece):
            held, of, sums = int(sums[-1]), kinds[-1], sums[:-1]
        else:
            length = 0
        out.append(sums)
    if length:
        out.append(np.array([held], np.uint64))
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def hash_batches(texts: list[bytes | None], classes: np.ndarray = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, hashes, offsets)`` for runs of texts of about CHUNK bytes: text first + i has the words hashes[offsets[i]:offsets[i + 1]]."""
    first, held, length = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        length += len(held[-1]) + 1
        if length < CHUNK and i + 1 < len(texts):
            continue
        if len(held) == 1 and length > CHUNK:
            hashes = hash_words(held[0], classes)
            offsets = np.array([0, len(hashes)])
        else:
            ends = np.cumsum([len(x) + 1 for x in held])
            if length > 2 * CHUNK:  # a long text came last
                own = [hash_words(x, classes) for x in held]
                hashes, offsets = np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
            else:
                starts, hashes = _hash_chunk(b"\n".join(held), classes)
                offsets = np.concatenate(([0], np.searchsorted(starts, ends)))
        yield first, i + 1, hashes, offsets
        first, held, length = i + 1, [], 0


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, by start."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m].copy()
    for j in range(1, n):
        out *= _GRAM
        out += words[j : j + m]
    return mix(out)
