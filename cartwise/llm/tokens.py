"""Encoding with the tokenizers library inside tasks.

Both vocabularies split a text before they merge, and a single blank that is followed by no
other white space is always such a split: the byte-level pattern attaches it to what follows,
the word pattern drops it. So texts are cut at these blanks, and the ids of a text are the
joined ids of its pieces. Cutting, finding the distinct pieces of a slice of texts and joining
their ids are Arrow kernels over the whole slice.

A slice's distinct pieces are cut, as arrays again, into runs of letters, digits or marks, which
is what the vocabularies' own patterns do with them. Python looks up each distinct run, and the
library's model merges those that are not known. Pieces for which that is not sure (other
scripts, apostrophes, other white space) go to the library whole. A task keeps the runs and such
pieces it has seen lately, a bounded number of them; its encoder ends with it.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartwise.llm.common import give_back

ROOM = 100_000  # runs and pieces kept, about 20 MB in each worker
LONGEST = 48  # characters of a piece that is kept
CALL = 20_000  # pieces of one call
SLICE = 2 << 20  # bytes of text encoded at once
_WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of Python
_INNER = f" (?:[{_WHITE}]|\\z)"
_CUT = re.compile(r" (?=\S)")
#: Letters that are letters for any library and have a lower case of one character, and ASCII marks but the apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = f"\\A ?[{_LETTERS}0-9{_MARKS}]+(?:\\n[{_LETTERS}0-9{_MARKS}]+)*\\z"
#: Kinds of the bytes of a plain piece; all that is no ASCII is part of a letter.
_LETTER, _DIGIT, _MARK, _END, _BLANK = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[c for c in range(256) if chr(c).isalpha() or c > 127]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("\n")] = _END
_KIND[ord(" ")] = _BLANK


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about ``size`` bytes of text, or of one row that is longer."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)
                give_back()


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class Encoder:
    """``encode(text)`` gives the ids the library gives for the whole text, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: The model alone, for runs that need no normalizer and no split.
        self.model = self.tokenizer.model
        #: Byte-level vocabularies without a normalizer keep the blank with what follows it.
        self.keeps_blank = self.tokenizer.normalizer is None
        #: What was seen lately is looked up first, what was seen before that next.
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _known(self, keys: Sequence[str]) -> list[bytes | None]:
        """The ids of the keys that are kept."""
        found = list(map(self.first.get, keys))
        if self.rest:
            for k, ids in enumerate(found):
                if ids is None and (ids := self.rest.get(keys[k])) is not None:
                    found[k] = self.first[keys[k]] = ids
        return found

    def _keep(self, learned: dict[str, bytes]) -> None:
        self.first.update((p, ids) for p, ids in learned.items() if len(p) <= LONGEST)
        if len(self.first) > ROOM // 2:
            self.first, self.rest = {}, self.first

    def _whole(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids (little-endian unsigned 32-bit bytes) of pieces, as words of a pre-split input: one call for many."""
        learned: dict[str, bytes] = {}
        for start in range(0, len(pieces), CALL):
            part = pieces[start : start + CALL]
            whole = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(whole.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(whole.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            learned.update((p, ids[ends[k] : ends[k + 1]]) for k, p in enumerate(part))
        return learned

    def _merged(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of one kind, each byte shown to the model as the letter that stands for it."""
        shown = "\r".join(runs).encode().decode("latin-1").translate(_BYTE_LETTERS).split(_BYTE_LETTERS[13]) if runs else []
        merge = self.model.tokenize
        ids = {run: array("I", [t.id for t in merge(letters)]).tobytes() for run, letters in zip(runs, shown, strict=True)}
        if not self.keeps_blank and "\n" in ids:
            ids["\n"] = b""  # the word pattern drops line ends
        return ids

    def _learned(self, strings: pa.Array, learn: Callable[[list[str]], dict[str, bytes]]) -> pa.Array:
        """The ids of distinct strings; ``learn`` gives those of the strings that are not known."""
        own = _strings(strings)
        found = self._known(own)
        if open_ := [k for k, ids in enumerate(found) if ids is None]:
            learned = learn([own[k] for k in open_])
            for k in open_:
                found[k] = learned[own[k]]
            self._keep(learned)
        return pa.array(found, pa.large_binary())

    def _of_runs(self, pieces: pa.Array) -> pa.Array:
        """The ids of plain pieces, none of them empty: those of their runs, one after the other."""
        edges = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
        data = pieces.buffers()[2]
        raw = np.frombuffer(data, np.uint8, int(edges[-1]))[edges[0] :]
        kinds = _KIND[raw]
        new = np.empty(len(raw), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _BLANK)  # a leading blank goes with what follows
        if not self.keeps_blank:
            new |= kinds == _DIGIT  # the word pattern splits numbers into digits
        new[edges[:-1] - edges[0]] = True
        at = np.flatnonzero(new)
        places = np.append(at, len(raw)).astype(np.int32) + edges[0]
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), data).dictionary_encode()
        ids = self._learned(coded.dictionary, self._merged).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(at) + 1)
        own = ends[np.searchsorted(at, edges - edges[0])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(own), ids.buffers()[2]])

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces, each with its leading blank if the vocabulary keeps it; what is not known is learned."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        easy, other = pieces.filter(plain), pieces.filter(pc.invert(plain))
        if not self.keeps_blank:
            easy = pc.utf8_lower(easy)  # its normalizer lowers letters
        coded = other.dictionary_encode()
        parts = [self._learned(coded.dictionary, self._whole).take(coded.indices)]
        if len(easy):
            parts.append(self._of_runs(easy))
        if not len(other):
            return parts[-1]
        is_plain = plain.to_numpy(zero_copy_only=False)
        at = np.where(is_plain, len(other) + np.cumsum(is_plain) - 1, np.cumsum(~is_plain) - 1)
        return pa.concat_arrays(parts).take(pa.array(at))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text, without the blanks between them."""
        cut = pc.split_pattern(texts, " ")
        if not self.keeps_blank:
            return cut
        odd = pc.match_substring_regex(texts, _INNER).to_numpy(zero_copy_only=False)
        if not odd.any():
            return cut
        own = pa.array([_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], cut.type)
        at = np.where(odd, len(cut) + np.cumsum(odd) - 1, np.arange(len(cut)))
        return pa.concat_arrays([cut, own]).take(pa.array(at))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (unsigned 32-bit), and where each text ends among them."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles: looking for some took a tenth of the time
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = self._cut(pc.fill_null(texts.cast(pa.string()), ""))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        pieces = cut.flatten()
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        if self.keeps_blank:
            firsts = pieces.take(pa.array(offsets[:-1])).dictionary_encode()
            ids = pa.concat_arrays([
                self._ids(pc.binary_join_element_wise(" ", coded.dictionary, "")), self._ids(firsts.dictionary),
            ])
            # the first piece of a text has no blank before it
            codes[offsets[:-1]] = len(coded.dictionary) + firsts.indices.to_numpy()
        else:
            ids = self._ids(coded.dictionary)
        joined = ids.take(pa.array(codes))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(codes) + 1)[offsets[1:]] // 4
        flat = np.frombuffer(joined.buffers()[2], "<u4", int(ends[-1])) if ends[-1] else np.empty(0, "<u4")
        return flat, ends

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        return [own.tobytes() for own in np.split(flat, ends[:-1])] if len(ends) else []

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
