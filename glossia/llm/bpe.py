"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a byte string is fixed by one token per prefix: the last token of the
prefix's own encoding. That token is the one vocabulary suffix of the prefix which is
stable beside the last token of what precedes it, where a pair is stable if encoding
its joined bytes gives the pair back. So distinct words go into a trie, a depth-first
walk computes the last token of each node from those of its ancestors, and a prefix
that many words share is worked out once. A word's ids are read backwards along its
path.

Texts are cut at single spaces between non-space characters, where the pre-tokenizer
always cuts too, so a piece and the space before it have the same ids wherever they
stand. Pieces seen before come from a bounded memory of the worker; forgetting costs
time, never results. Texts with runs of white space, and texts that hold the special
token, are pre-tokenized as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.batches import Work, added

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LONG_WORD = 512
#: Bounds of a worker's memory: entries of each kind, and characters in them.
_REMEMBER = 400_000
_REMEMBER_CHARS = 6_000_000
#: Longer pieces seldom come again and are not remembered.
_LONG_PIECE = 64
#: Pieces, or eight characters for one, of the texts that are worked on together.
_PENDING = 250_000
_CHUNK = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Byte strings by number; ``joined`` gathers many of them at once."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.flat = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.start[ids] - (end - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at].tobytes()


class Encoder:
    """Vocabulary, merges and the worker's memory of what was encoded."""

    def __init__(self, path: str, remember: int | None = None):
        self.remember = remember or _REMEMBER
        self.pending = _PENDING * self.remember // _REMEMBER
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(token): i for token, i in vocab.items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        if len(self.bytes_of) > 1 << 16:
            raise ValueError("ids are kept in 16 bits here")
        self.size = list(map(len, self.bytes_of))
        self.pairs_of = [i.to_bytes(2, "little") for i in range(len(self.bytes_of))]
        self.text_table = Table(self.bytes_of)
        self.comma_table = Table([b"%d," % i for i in range(len(self.bytes_of))])
        self._read_tokens()
        self.merges: dict[tuple[int, int], int] = {}
        self.rank = [-1] * len(self.bytes_of)
        self.parts: list[tuple[int, int]] = [(-1, -1)] * len(self.bytes_of)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            self.merges[vocab[left], vocab[right]] = rank
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = rank, (vocab[left], vocab[right])
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.stable_pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {c: self.pairs_of[i] for c, i in self.special.items()}
        self.pieces: dict[str, bytes] = {}
        self.held = {"words": 0, "pieces": 0}

    def _read_tokens(self) -> None:
        """States that tell which tokens end at a byte: the longest suffix that starts a token.

        ``steps``: state and byte to the state one longer, ``shorter``: the state of the
        longest proper suffix, ``ends``: the tokens that end there, longest first.
        """
        steps: dict[int, int] = {}
        own, depth, into = [-1], [0], [0]
        for token, i in self.ids.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                state = steps.setdefault(key, len(own))
                if state == len(own):
                    own.append(-1)
                    depth.append(depth[key >> 8] + 1)
                    into.append(key)
            own[state] = i
        shorter = [0] * len(own)
        ends: list[tuple[int, ...]] = [()] * len(own)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            above, byte = into[state] >> 8, into[state] & 255
            if above:
                while above := shorter[above]:
                    if (above << 8 | byte) in steps:
                        break
                shorter[state] = steps.get(above << 8 | byte, 0)
            tail = ends[shorter[state]]
            ends[state] = (own[state], *tail) if own[state] >= 0 else tail
        self.steps, self.shorter, self.ends = steps, shorter, ends

    def _stable(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border of two tokens that stand side by side.

        Followed back in time from the finished tokens: of the two that touch at the
        border, the one made last is undone (of equals the right one, as merges of a
        rank run from the left), which shows the pair that touched before. A merge of
        that pair would have come first if its rank is below that of the undone merge,
        or equals it where the undone token is the right one.
        """
        rank, merges = self.rank, self.merges
        limit = len(merges)
        while True:
            crossing = merges.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            of_left, of_right = rank[left], rank[right]
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                limit, left = of_left, self.parts[left][1]
            else:
                limit, right = of_right + 1, self.parts[right][0]

    def _state(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        get, shorter = self.steps.get, self.shorter
        while (found := get(state << 8 | byte)) is None:
            if not state:
                raise ValueError("the vocabulary lacks a byte")
            state = shorter[state]
        return found

    def _last(self, state: int, last: list[int]) -> int:
        """Last token of the prefix that leads to ``state``, given those of all shorter ones."""
        depth, size, known = len(last), self.size, self.stable_pairs
        for token in self.ends[state]:
            at = depth - size[token]
            if at < 0:  # the whole prefix
                return token
            key = last[at] << 16 | token
            stable = known.get(key)
            if stable is None:
                stable = known[key] = self._stable(last[at], token)
            if stable:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _along(self, last: list[int]) -> bytes:
        ids, at, size, pairs = [], len(last), self.size, self.pairs_of
        while at:
            token = last[at - 1]
            ids.append(pairs[token])
            at -= size[token]
        ids.reverse()
        return b"".join(ids)

    @staticmethod
    def _insert(root: dict, data: bytes, word: str) -> None:
        """Put a word into the trie; what no other word shares stays one leaf ``(data, word)``."""
        node, at = root, 0
        while at < len(data):
            byte = data[at]
            at += 1
            child = node.get(byte)
            if child is None:
                node[byte] = (data, word)
                return
            if type(child) is tuple:  # the leaf moves down by a byte
                other = child[0]
                child = node[byte] = {other[at]: child} if len(other) > at else {-1: child[1]}
            node = child
        node[-1] = word

    def _learn(self, words: set[str]) -> None:
        """Encode the words into ``self.words`` by one walk over their trie."""
        collects = gc.isenabled()
        gc.disable()  # the nodes hold no cycles, and scanning them all takes most of the time
        try:
            self._walk(words)
            self.held["words"] += sum(map(len, words))
        finally:
            if collects:
                gc.enable()

    def _walk(self, words: set[str]) -> None:
        root: dict = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > _LONG_WORD:  # a path of its own, without nodes
                last: list[int] = []
                state = 0
                for byte in data:
                    state = self._state(state, byte)
                    last.append(self._last(state, last))
                self.words[word] = self._along(last)
                continue
            self._insert(root, data, word)
        last = []
        stack = [(root, 0, 0)]
        while stack:
            node, depth, state = stack.pop()
            if depth:
                del last[depth - 1 :]
                last.append(self._last(state, last))
            if type(node) is tuple:
                for byte in node[0][depth:]:
                    state = self._state(state, byte)
                    last.append(self._last(state, last))
                self.words[node[1]] = self._along(last)
                continue
            for key, child in node.items():
                if key >= 0:
                    stack.append((child, depth + 1, self._state(state, key)))
                else:
                    self.words[child] = self._along(last)
        if len(self.stable_pairs) > self.remember:
            self.stable_pairs = dict(islice(self.stable_pairs.items(), self.remember // 2))

    def _forget(self) -> None:
        """Cut what is remembered to its bounds; what was learnt first is what occurs most."""
        most_chars = _REMEMBER_CHARS * self.remember // _REMEMBER
        for memory, most in (("words", self.remember // 4), ("pieces", self.remember)):
            own = getattr(self, memory)
            if len(own) <= most and self.held[memory] <= most_chars:
                continue
            kept, chars = {}, 0
            for key, ids in own.items():
                if len(kept) >= most // 2 or chars > most_chars // 2:
                    break
                if len(key) <= _LONG_PIECE or key in self.special:
                    kept[key] = ids
                    chars += len(key)
            setattr(self, memory, kept)
            self.held[memory] = chars

    def _by_words(self, text: str, special: bool) -> bytes:
        """Ids of a text that is pre-tokenized as a whole."""
        words: list[str] = []
        for part in self.cut.split(text) if special and self.cut is not None else [text]:
            words.extend([part] if special and part in self.special else self.find(part))
        self._learn(set(words).difference(self.words))
        return b"".join(map(self.words.__getitem__, words))

    def _flush(self, pending: list[tuple[str, list[str], list[bytes | None]]], special: bool) -> Iterator[np.ndarray]:
        """Learn the pieces that were missing and finish the texts that wait for them."""
        cut: dict[str, list[str]] = {}
        missing = {p for _, pieces, found in pending if None in found for p, ids in zip(pieces, found, strict=True) if ids is None}
        for piece in missing:
            if piece and not (piece[0].isspace() or piece[-1].isspace()):
                cut[piece] = self.find(" " + piece)
        self._learn({w for words in cut.values() for w in words}.difference(self.words))
        for piece, words in cut.items():
            self.pieces[piece] = b"".join([self.words[w] for w in words])
        self.held["pieces"] += sum(map(len, cut))
        for text, pieces, found in pending:
            if pieces and None in found:
                found = list(map(self.pieces.get, pieces))
            head = text[: text.find(" ")] if pieces else text
            if not pieces or not head or head[-1].isspace() or None in found:
                ids = self._by_words(text, special)
            else:
                ids = self._by_words(head, special) + b"".join(found)
            yield np.frombuffer(ids, "<u2")
        self._forget()

    def encode(self, texts: Iterable[str | None], special: bool = True) -> Iterator[np.ndarray]:
        """Token ids of each text in turn; null is empty. Texts are taken some at a time.

        Without ``special`` a special token's text is text like any other.
        """
        pending, size = [], 0
        for text in texts:
            text = text or ""
            whole = special and any(x in text for x in self.special)
            pieces = [] if whole else text.split(" ")[1:]
            pending.append((text, pieces, list(map(self.pieces.get, pieces))))
            size += max(len(pieces) + 1, len(text) >> 3)
            if size > self.pending:
                yield from self._flush(pending, special)
                pending, size = [], 0
        yield from self._flush(pending, special)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        data = b"".join(self.text_table.joined(ids[at : at + _CHUNK]) for at in range(0, len(ids), _CHUNK))
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join(self.comma_table.joined(ids[at : at + _CHUNK]) for at in range(0, len(ids), _CHUNK))[:-1]


def default_vocabulary() -> str:
    """The public 50k byte-level vocabulary that every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remember: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if (path, remember) not in _encoders:
        _encoders[path, remember] = Encoder(path, remember)
    return _encoders[path, remember]


def forget() -> None:
    """Give up what the worker keeps for the next tasks."""
    _encoders.clear()


def encoded(docs: DataFrame, path: str, keep: list[str], ids: bool = True, remember: int | None = None, rows: int = 10_000) -> DataFrame:
    """``keep`` columns of every row plus n_tokens, ids_sha256, decoded_sha256 and ids.

    ``path``: the tokenizer's JSON file on each machine. ids holds little-endian 16-bit
    token ids, as binary. Null and empty texts have no tokens and the digests of the
    empty string; repeated rows are encoded each; the row count never changes.
    ``remember`` and ``rows`` bound what a worker remembers and works on together: less takes
    less memory and more time, and changes no result.
    """

    def make() -> Work:
        own = encoder(path, remember)

        def work(texts: list) -> list:
            out: list[list] = [[], [], [], []]
            for found in own.encode(texts):
                out[0].append(len(found))
                out[1].append(hashlib.sha256(own.listed(found)).hexdigest())
                out[2].append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    out[3].append(found.tobytes())
            return out if ids else out[:3]

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return added(docs, F.col("text"), fields, make, keep, rows=rows)  # words of many texts share their prefixes
