"""Texts cut where no token can lie across: before a space that stands behind a word.

Byte-level tokenizers whose pattern gives a space to the word behind it, and piece tokenizers whose pieces hold a space only at
their begin, both encode such units apart from each other. So a worker encodes each distinct unit once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' patterns have it, without the separators that only Python counts.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RISK = re.compile(f" (?=[{WHITE}]|\\Z)").search
_CUT = re.compile(f"(?<=[^{WHITE}])(?= )").split
_ODD = re.compile(f"[{WHITE}]|$").match
#: The same risk as Arrow finds it, in texts as they are and in texts that are to have a space before them.
_BARE_RISK = f" (?:[{WHITE}]|\\z)"
_RISKS = {True: _BARE_RISK, False: f"^(?:[{WHITE}]|\\z)|{_BARE_RISK}"}
#: Marks that stand behind words.
MARKS = ".,;:!?*%#$&"


def units(text: str) -> list[str]:
    """The units of a text that begins with a space, each without its first space."""
    if _RISK(text):
        return [u[1:] for u in _CUT(text)]
    return text.split(" ")[1:]


def coded(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings of an Arrow array, and for each of its rows the number of its string."""
    encoded = flat.dictionary_encode()
    return encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy()


def cut_texts(texts: pa.Array, bare: bool) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(units, heads, number, edges): the distinct units of ``texts``, the number of each unit of each text, and where each text's begin.

    Units have lost their first space. With ``bare`` a text's first unit had none: it is a head (empty where the text begins with a space),
    numbered behind all units. Without, the texts are taken with a space before them. Nulls are empty texts."""
    texts = texts.fill_null("")
    lists = pc.split_pattern(texts, " ")
    risky = np.flatnonzero(pc.match_substring_regex(texts, _RISKS[bare]).to_numpy(zero_copy_only=False))
    if len(risky):
        own = [[""] + units(t) if bare and t[:1] == " " else units(" " + t) for t in texts.take(pa.array(risky)).to_pylist()]
        order = np.arange(len(texts))
        order[risky] = len(texts) + np.arange(len(risky))
        lists = pa.concat_arrays([lists, pa.array(own, lists.type)]).take(pa.array(order))
    flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    if not bare:
        own, number = coded(flat)
        return own, [], number, edges
    first = np.zeros(len(flat), bool)
    first[edges[:-1]] = True
    (own, behind), (heads, ahead) = coded(flat.filter(pa.array(~first))), coded(flat.filter(pa.array(first)))
    number = np.empty(len(flat), np.int32)
    number[~first], number[first] = behind, ahead + np.int32(len(own))
    return own, heads, number, edges


def joined(values: list[bytes], number: np.ndarray, edges: np.ndarray) -> pa.BinaryArray:
    """For each run of ``number`` between two edges, its values one behind the other."""
    taken = pa.array(values, pa.binary()).take(pa.array(number))
    if not len(taken):
        return pa.array([b""] * (len(edges) - 1), pa.binary())
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32, len(taken) + 1, 4 * taken.offset)[edges]
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data or pa.py_buffer(b"")])


def word_parts(unit: str) -> list[str] | None:
    """A unit's word, the marks behind it, a line's end with the word behind that, and its marks; None for other units and plain words.

    Words here are letters that all Unicode versions in use have."""
    if unit.isalpha():
        return None
    head, line, tail = unit.partition("\n")
    word = head.rstrip(MARKS)
    if not (word.isalpha() and (word.isascii() or max(word) < "\u0530")):
        return None
    out = [word, head[len(word) :]] if len(word) < len(head) else [word]
    if line:
        word = tail.rstrip(MARKS)
        if not (word.isalpha() and (word.isascii() or max(word) < "\u0530")):
            return None
        out.append("\n" + word)
        if len(word) < len(tail):
            out.append(tail[len(word) :])
    return out if len(out) > 1 else None


def byte_level_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; ``tokens`` has the bytes of each id.

    Its pattern parts words, marks and a line's single end from each other."""

    apart = True

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        chars = byte_level_bytes()
        self.tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.tokens[i] = bytes(chars[c] for c in token)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before a text; ``tokens`` has the bytes of each id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in names):
            raise ValueError("a piece holds a space behind its first letter, so that texts cannot be cut before spaces")
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.space = self.model.piece_to_id("\u2581")
        #: Whether no piece goes on from a word to marks or a line's end, or from there on.
        self.apart = not any(y == "\n" or x == "\n" or x.isalpha() and y in MARKS for p in names for x, y in zip(p, p[1:]))

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Texts begin with a space, in whose place the model puts its own."""
        return [[self.space] if t == " " else e for t, e in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1))]


class Memory:
    """What ``coder`` makes of units, each encoded once: ``found`` gives the ids of a unit (without its first space), or None where
    they do not spell it. Plain units are encoded ``RUN`` at a time and told apart by the bytes of their tokens. Units made of words and
    marks that no token joins are put together from these (see :func:`word_parts`); ``after`` has the ids of what stands behind a word."""

    RUN, REMEMBER = 400, 300_000

    def __init__(self, coder, remember: int = REMEMBER, parts: bool = True):
        self.coder, self.remember, self.parts = coder, remember, parts and coder.apart
        self.found: dict[str, bytes | None] = {}
        self.after: dict[str, bytes | None] = {}
        self.size = np.array([len(t) for t in coder.tokens], np.int64)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.coder.tokens.__getitem__, ids))

    def ids_of(self, keys: list[str]) -> list[bytes | None]:
        """The packed ids of each unit; None where they do not spell it."""
        out = list(map(self.found.get, keys))
        if None in out:
            self.learn([k for k, x in zip(keys, out) if x is None])
            out = list(map(self.found.__getitem__, keys))
        return out

    def learn(self, keys) -> None:
        found, after = self.found, self.after
        new = [k for k in keys if k not in found]
        if not self.parts:
            return self.encode(new)
        parts = {k: p for k in new if (p := word_parts(k))}
        self.learn_after(list({x for p in parts.values() for x in p[1:] if x not in after}))
        for k in [k for k, p in parts.items() if any(after[x] is None for x in p[1:])]:
            del parts[k]
        whole = [k for k in new if k not in parts]
        self.encode(list({*whole, *(w for p in parts.values() if (w := p[0]) not in found)}) if parts else whole)
        for k, p in parts.items():
            if (word := found[p[0]]) is None:
                self.encode([k])
            else:
                found[k] = b"".join([word, *map(after.__getitem__, p[1:])])

    def learn_after(self, new: list[str]) -> None:
        """Marks are encoded behind a word, a line's end and the word behind it after a space."""
        before = [" " if x[0] == "\n" else " a" for x in new]
        for x, c, ids in zip(new, before, self.coder.ids([c + x for c, x in zip(before, new)])):
            at = np.cumsum(self.size[np.array(ids)]).tolist()
            apart = len(c) in at and self.spell(ids) == (c + x).encode()
            self.after[x] = np.array(ids[at.index(len(c)) + 1 :], "<u4").tobytes() if apart else None

    def encode(self, new: list[str]) -> None:
        found = self.found
        # white space at a unit's end would grow together with the space before the next one
        odd = [k for k in new if not k or k[-1].isspace() or not k[0].isalnum() and _ODD(k)]
        aside = set(odd)
        plain = [k for k in new if k not in aside] if odd else new
        runs = [plain[i : i + self.RUN] for i in range(0, len(plain), self.RUN)]
        for run, ids in zip(runs, self.coder.ids([" " + " ".join(r) for r in runs])):
            raw = [k.encode() for k in run]
            if self.spell(ids) != b" " + b" ".join(raw):
                odd += run
                continue
            at = np.cumsum(self.size[np.array(ids)])
            cut = np.searchsorted(at, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)) + 1
            packed, a = np.array(ids, "<u4").tobytes(), 0
            for k, z in zip(run, (4 * cut).tolist()):
                found[k] = packed[a:z]
                a = z
        for i in range(0, len(odd), self.RUN):
            some = odd[i : i + self.RUN]
            for k, ids in zip(some, self.coder.ids([" " + k for k in some])):
                found[k] = np.array(ids, "<u4").tobytes() if self.spell(ids) == b" " + k.encode() else None

    def room(self) -> None:
        """Forgets all when there is too much of it; call it where no units are held."""
        if len(self.found) > self.remember:
            self.found.clear()
        if len(self.after) > self.remember // 4:
            self.after.clear()
