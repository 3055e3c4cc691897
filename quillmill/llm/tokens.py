"""Whole texts to token ids with a public vocabulary, many texts at a time.

Byte-level and word-level BPE never merge across certain boundaries, so equal chunks of text between two boundaries have equal
ids wherever they stand. Texts are cut there, a slice's distinct chunks are encoded once by the tokenizers library, and ids are
gathered by chunk number. Chunks of plain letters, with or without a run of punctuation behind them, need no normaliser and no
splitting by regular expression: they go to a tokenizer of the same vocabulary without these, many to a call, the letters and the
punctuation each once. All other chunks go to the full tokenizer. Texts in which runs of white space could make a piece reach over a cut are encoded whole.
The vocabulary's added tokens (`<|endoftext|>` and the like) are one id each where a text holds them, as the library has it: a text
is cut around them first. So a text can hold the end id that separates documents; counts, not ids, tell where documents end.

A worker holds one slice and its ids, and between slices the runs of letters that it has encoded, SEEN_BYTES of them: about half of
the next slice's are among them.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded in one go, and rows at most; chunks to a call. A worker needs about twenty times a slice's bytes.
SLICE_BYTES, SLICE_ROWS, CALL = 2 << 20, 16000, 50
#: Bytes of runs of letters that a worker remembers; how many times as many as a slice has are worth looking through.
SEEN_BYTES, WORTH = 12 << 20, 4
#: Texts that are encoded whole, for RE2: long runs of white space, runs of two at the end, white space beyond ASCII.
WHOLE = r"\x00|[\t-\r ]{3}|[\t-\r ]{2}\z|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters that stay as they are under normalisation, and are lowered alike everywhere; punctuation is one piece of its own.
LETTERS, MARKS = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
BARE, MARKED, UP_TO_MARKS = rf"^ ?[{LETTERS}]+[{MARKS}]*$", rf"([{LETTERS}])([{MARKS}]+)$", rf"^ ?[{LETTERS}]+"

_encoders: dict[str, "Encoder"] = {}


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def encoder(path: str) -> "Encoder":
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_symbols() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 for itself, others from 256 on."""
    itself = np.zeros(256, dtype=bool)
    for a, b in ((33, 127), (161, 173), (174, 256)):
        itself[a:b] = True
    return np.where(itself, np.arange(256), 255 + np.cumsum(~itself)).astype("<u4")


def placed(sizes: np.ndarray) -> np.ndarray:
    """Where each run of these sizes begins."""
    return np.cumsum(sizes) - sizes


def gathered(table: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table[first : first + size] of every code, one after another; where each begins and the last ends)."""
    each = size[codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    kind = np.int32 if max(ends[-1], len(table)) < 1 << 31 else np.int64
    return table[np.arange(ends[-1], dtype=kind) + np.repeat((first[codes] - ends[:-1]).astype(kind), each)], ends


class Encoder:
    """ids(texts) for vocabularies of fewer than 65,536 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens stand for themselves wherever a text holds them; what stands between is encoded on its own
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        assert not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        assert size <= 1 << 16
        self.keeps_space = self._one(" a") != self._one("a")
        self.symbols = byte_symbols()
        self.symbols[ord("\n")] = ord("\n")  # between chunks
        self.space, self.tab = chr(self.symbols[ord(" ")]), chr(self.symbols[ord("\t")])
        self.mark = self._one("\t")[:1] if self.keeps_space else []
        # ids that begin a chunk with a space before it, or end a piece
        self.edge = np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith(self.space) if self.keeps_space else token.endswith("</w>")
        # runs of letters that have been encoded, their ids, where these begin and how many they are
        self.seen = pa.array([], pa.large_string()), np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _call(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of BARE chunks, which begin with a space where spaces are kept: the ids of their letters, then of their marks."""
        letters = pc.ascii_rtrim(chunks, characters=string.punctuation)
        letters = letters if self.keeps_space else pc.utf8_lower(letters)
        marks = pc.replace_substring_regex(chunks, UP_TO_MARKS, "").dictionary_encode()
        worth = len(self.seen[0]) <= WORTH * len(letters)
        known, ids, first, size = self.seen if worth else [x[:0] for x in self.seen]
        coded = pa.concat_arrays([known, letters]).dictionary_encode()
        new = coded.dictionary[len(known) :]
        rank = pc.sort_indices(new)
        own, own_sizes = self._pieces(new.take(rank))
        sizes = np.empty(len(new), dtype=np.int64)
        sizes[rank], begins = own_sizes, np.empty(len(new), dtype=np.int64)
        begins[rank] = placed(own_sizes) + len(ids)
        ids, first, size = np.concatenate([ids, own]), np.concatenate([first, begins]), np.concatenate([size, sizes])
        if worth and coded.dictionary.nbytes <= SEEN_BYTES:
            self.seen = coded.dictionary, ids, first, size
        mark_ids, mark_sizes = self._marks(marks.dictionary)
        first, size = np.concatenate([first, placed(mark_sizes) + len(ids)]), np.concatenate([size, mark_sizes])
        pairs = np.column_stack([coded.indices.to_numpy()[len(known) :], marks.indices.to_numpy() + len(coded.dictionary)]).ravel()
        values, ends = gathered(np.concatenate([ids, mark_ids]), first, size, pairs)
        return values, np.diff(ends[::2])

    def _pieces(self, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of runs of letters as _joined() has them; `edge` tells where each begins or ends."""
        own = letters.to_numpy(zero_copy_only=False).tolist()
        ids = np.concatenate([np.zeros(0, dtype="<u2"), *self._call(self.bare, [self._symbols("\n".join(own[i : i + CALL])) for i in range(0, len(own), CALL)])])
        edges = np.flatnonzero(self.edge[ids])
        bounds = np.append(edges, len(ids)) if self.keeps_space else np.insert(edges + 1, 0, 0)
        return (ids, np.diff(bounds)) if len(bounds) == len(own) + 1 else self._alone(letters)

    def _marks(self, marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of runs of marks, the empty one among them."""
        return self._marked(marks) if self.keeps_space else self._alone(marks)

    def _marked(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of BARE chunks without a space before them, each followed by a tab's id, which no such chunk holds."""
        own = pc.replace_substring_regex(chunks, MARKED, "\\1\n\\2").to_numpy(zero_copy_only=False).tolist()
        found = self._call(self.bare, [self._symbols("\n\t\n".join(own[i : i + CALL]) + "\n\t") for i in range(0, len(own), CALL)])
        ids = np.concatenate([np.zeros(0, dtype="<u2"), *found])
        is_mark = ids == self.mark
        sizes = np.diff(np.flatnonzero(is_mark), prepend=-1) - 1
        return (ids[~is_mark], sizes) if len(sizes) == len(own) else self._alone(chunks)

    def _symbols(self, text: str) -> str:
        if text.isascii():
            return text.replace(" ", self.space).replace("\t", self.tab)
        return self.symbols[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")

    def _alone(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes), chunk by chunk with the full tokenizer."""
        found = self._call(self.tokenizer, chunks.to_numpy(zero_copy_only=False).tolist())
        return np.concatenate([np.zeros(0, dtype="<u2"), *found]), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): the ids of each distinct chunk are ids[first : first + size].

        Chunks are encoded in order of their text: neighbours need the same entries of the vocabulary, which then stay in the caches.
        """
        bare = pc.match_substring_regex(chunks, BARE)
        joined = pc.and_(bare, pc.starts_with(chunks, " ")) if self.keeps_space else bare
        parts, order = [self._joined(chunks.filter(joined))], [np.flatnonzero(joined.to_numpy(zero_copy_only=False))]
        for mask, encode in ((pc.xor(bare, joined), self._marked), (pc.invert(bare), self._alone)):
            own = chunks.filter(mask)
            rank = pc.sort_indices(own)
            parts.append(encode(own.take(rank)))
            order.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False))[rank.to_numpy()])
        at, sizes = np.concatenate(order), np.concatenate([s for _, s in parts])
        first, size = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        first[at], size[at] = placed(sizes), sizes
        return np.concatenate([ids for ids, _ in parts]), first, size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids begin and the last ends); null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        values, offsets = self._between(texts)
        holds = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return self._with(values, offsets, np.flatnonzero(holds), lambda i: self._around(texts[i].as_py())) if holds.any() else (values, offsets)

    def _around(self, text: str) -> np.ndarray:
        """The ids of a text that holds added tokens."""
        pieces = self.around.split(text)
        values, offsets = self._between(pa.array(pieces[::2], pa.large_string()))
        return np.insert(values, offsets[1:-1], [self.added[t] for t in pieces[1::2]]).astype("<u2")

    def _between(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids() of texts without added tokens."""
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, WHOLE)
            cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
            lists = pc.split_pattern(cut, "\x00")
        else:
            whole = None
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        table, first, size = self._table(coded.dictionary)
        values, ends = gathered(table, first, size, coded.indices.to_numpy())
        offsets = ends[bounds - bounds[0]]
        if whole is not None and pc.any(whole).as_py():
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            values, offsets = self._with(values, offsets, rows, lambda i: np.array(self._one(texts[i].as_py()), dtype="<u2"))
        return values, offsets

    def _with(self, values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, ids: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """values and offsets with other ids for some rows."""
        parts = [values[a:b] for a, b in zip(offsets, offsets[1:])]
        for i in rows.tolist():
            parts[i] = ids(i)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
