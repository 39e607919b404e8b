"""Piece-wise tokenisation with a bounded table of known pieces.

The pre-tokeniser patterns of byte-level BPE vocabularies never let a token cross from a
non-space character to a following space, so a text may be cut there and each piece encoded
by itself. Natural text repeats its pieces: a batch is cut and its distinct pieces are numbered by
Arrow, a worker looks up only those, and the ids of whole texts are gathered from one flat array.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kindred.llm.common import hold

#: Unicode White_Space, which is what the tokenisers' ``\s`` means.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_GENERAL = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A space or line feed after white space; such texts are cut by _GENERAL. Information separators count as white space too.
_SPACE_RUN = f"[{_SPACE}\x1c-\x1f][ \n]"
_MARKS = ".,;:!?|%$&*#()\"-"

#: Characters of the texts that are cut and looked up together (a longer text is taken alone).
SLICE_CHARS = 8 << 20
#: Pieces whose positions in the flat array are found at once.
GATHERED = 1 << 19
#: Pieces whose ids a worker keeps: up to some 250 MB.
KEPT = 1_000_000


class Ragged:
    """Growing rows of numbers in one flat array."""

    def __init__(self, kind: str):
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.rows = 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Append rows: their values one after the other, and how many each has."""
        n, m = self.used + len(values), self.rows + len(lengths)
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : n] = values
        ends = np.cumsum(lengths)
        self.starts[self.rows : m] = self.used + ends - lengths
        self.lengths[self.rows : m] = lengths
        self.used, self.rows = n, m

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the given rows, one after the other, and where each row ends."""
        out = []
        for i in range(0, len(rows), GATHERED):
            part = rows[i : i + GATHERED]
            size = self.lengths[part]
            ends = np.cumsum(size)
            at = np.repeat(self.starts[part] - ends + size, size)
            at += np.arange(len(at))
            out.append(self.flat[at])
        values = out[0] if len(out) == 1 else np.concatenate(out) if out else self.flat[:0]
        return values, np.cumsum(self.lengths[rows])


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of bounded size."""
    begin = chars = 0
    for i, t in enumerate(texts):
        if i > begin and chars + len(t) > SLICE_CHARS:
            yield texts[begin:i]
            begin, chars = i, 0
        chars += len(t)
    yield texts[begin:]


def _with_runs(texts: list[str]) -> tuple[pa.Array, list[int]]:
    """The texts without runs of white space, and the places of those with."""
    column = pa.array(texts, pa.large_string())
    runs = pc.match_substring_regex(column, _SPACE_RUN)
    return column.filter(pc.invert(runs)), np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()


def _pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts without runs of white space, and where each text begins. Pieces after a text's first lack
    the space before them, unless they begin with a line feed."""
    pieces = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
    return pieces.flatten(), pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()


def piece_counts(texts: list[str]) -> Iterator[dict[str, int]]:
    """Pieces with their counts, in several parts that may share pieces."""
    for part in slices(texts):
        column, apart = _with_runs(part)
        for i in apart:
            yield Counter(_GENERAL.findall(part[i]))
        if len(column):
            pieces, first = _pieces(column)
            coded = pieces.dictionary_encode()
            at, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
            yield Counter(names[at[first]].tolist())
            counts = np.bincount(at, minlength=len(names)) - np.bincount(at[first], minlength=len(names))
            asked = np.flatnonzero(counts)
            yield {p if p[:1] == "\n" else " " + p: n for p, n in zip(names[asked].tolist(), counts[asked].tolist())}


class PieceTable:
    """``encode_many`` maps pieces to arrays of ids, as (all ids, how many for each)."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = KEPT):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.ids = Ragged("<u4")

    def _keep(self, names: dict[str, int], new: Sequence[str], pieces: list[str]) -> None:
        begin = self.ids.rows
        self.ids.add(*self.encode_many(pieces))
        names.update(zip(new, range(begin, self.ids.rows)))

    def _learn(self, pieces: list[str]) -> None:
        """Learn pieces that follow a space; ``word.`` is put together from ``word`` and ``.``."""
        whole, parts = [], []
        for p in pieces:
            core = p.rstrip(_MARKS)
            if core and core != p and core[-1].isalpha():
                parts.append((p, core, p[len(core):]))
            else:
                whole.append(p)
        fresh = {core for _, core, _ in parts}.difference(whole)
        whole += [c for c in fresh if c not in self.spaced]
        if whole:
            self._keep(self.spaced, whole, [p if p[:1] == "\n" else " " + p for p in whole])
        self._learn_plain({m for _, _, m in parts})
        if parts:
            rows = np.array([(self.spaced[core], self.plain[marks]) for _, core, marks in parts])
            values, ends = self.ids.gather(rows.ravel())
            begin = self.ids.rows
            self.ids.add(values, np.diff(ends[1::2], prepend=0))
            self.spaced.update(zip((p for p, _, _ in parts), range(begin, self.ids.rows)))

    def _learn_plain(self, pieces: set[str]) -> None:
        if new := [p for p in pieces if p not in self.plain]:
            self._keep(self.plain, new, new)

    def values(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [ids for part in slices(texts) for ids in self._slice(part)]

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.spaced) + len(self.plain) > self.limit:  # only here, so that nothing a slice has learnt goes before it is used
            self.clear()
        out: list = [None] * len(texts)
        column, apart = _with_runs(texts)
        if apart:
            cut = [_GENERAL.findall(texts[i]) for i in apart]
            self._learn_plain({p for c in cut for p in c})
            for i, c in zip(apart, cut):
                out[i] = self.ids.gather(np.array([self.plain[p] for p in c], np.int64))[0]
        if len(column):
            done = set(apart)
            for i, ids in zip((i for i in range(len(texts)) if i not in done), self._joined(column)):
                out[i] = ids
        return out

    def _joined(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of texts without runs of white space."""
        pieces, first = _pieces(column)
        coded = pieces.dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        heads = names[at[first]].tolist()
        self._learn_plain(set(heads))
        follows = np.ones(len(at), bool)
        follows[first] = False
        asked = np.flatnonzero(np.bincount(at[follows], minlength=len(names)))
        get = self.spaced.get
        known = names[asked].tolist()
        rows = np.array([get(p, -1) for p in known], np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            fresh = [known[i] for i in new.tolist()]
            self._learn(fresh)
            rows[new] = [self.spaced[p] for p in fresh]
        number = np.zeros(len(names), np.int64)
        number[asked] = rows
        where = number[at]
        where[first] = [self.plain[h] for h in heads]
        values, ends = self.ids.gather(where)
        last = np.append(first[1:], len(at)) - 1
        return np.split(values, ends[last[:-1]])


#: Letters of words that the pattern takes whole after a space, whatever Unicode version a library has.
_WORD = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1 byte is itself, others are counted from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(own)))}


_TABLES: dict[tuple[str, bool], tuple[PieceTable, Callable, re.Pattern | None]] = {}


def _table(path: str, added: bool) -> tuple[PieceTable, Callable, re.Pattern | None]:
    if (path, added) not in _TABLES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = not added
        contents = [t.content for t in whole.get_added_tokens_decoder().values()] if added else []
        merges, letters = whole.model.tokenize, _byte_letters()

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """A space and letters are one pre-token, to which the library's merges apply at once; others go through all of it."""
            found: list = [None] * len(pieces)
            other = []
            for i, p in enumerate(pieces):
                if p[:1] == " " and _WORD(p, 1):
                    found[i] = [t.id for t in merges(p.encode().decode("latin-1").translate(letters))]
                else:
                    other.append(i)
            for i in range(0, len(other), 20_000):
                part = other[i : i + 20_000]
                for k, x in zip(part, whole.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False)):
                    found[k] = x.ids
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for f in found for i in f), "<u4", int(lengths.sum())), lengths

        tokens = re.compile("|".join(map(re.escape, contents))) if contents else None
        _TABLES[path, added] = PieceTable(encode), encode, tokens
    return _TABLES[path, added]


def library_ids(path: str, texts: list[str], added: bool = False) -> list[np.ndarray]:
    """Ids of each text under a ``tokenizers`` file as little-endian unsigned 32-bit integers.

    With ``added``, a text that holds an added token's string (as ``<|endoftext|>``) is encoded whole and gets that
    token's id, as the library does unless told otherwise; without, such strings are text like any other.
    """
    hold("tokens", _TABLES.clear)
    table, encode, tokens = _table(path, added)
    special = [i for i, t in enumerate(texts) if tokens.search(t)] if tokens else []
    if not special:
        return table.values(texts)
    apart = set(special)
    out = dict(zip(special, (encode([texts[i]])[0] for i in special)))
    rest = [i for i in range(len(texts)) if i not in apart]
    out.update(zip(rest, table.values([texts[i] for i in rest])))
    return [out[i] for i in range(len(texts))]
