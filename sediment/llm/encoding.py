"""Whole-text token ids from public tokenizers, with the library's work kept per distinct piece.

A text is cut before spaces where no token can span the cut, so that encoding the pieces and joining
their ids equals encoding the whole text. Pieces repeat, so their ids are kept in a bounded memo. Plain new pieces
are encoded many at a time, one after the other as in a text, and told apart by the lengths of the tokens.
A text without such cuts (base64, or writing without spaces) goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_threads

#: Pieces whose ids a worker keeps; then it starts anew.
MEMO_PIECES = 600_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20

#: White_Space of Unicode, and the separators that some libraries count too.
_SPACES = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Stands for a cut; texts that hold it are cut another way.
_MARK = "\x01"
#: A Latin letter before ASCII punctuation: tokens end there. U+0130 isn't one, as its lower case ends in a mark.
_INNER = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([.,!?;:&%$#*|])"
#: Pieces that are a space and a word in letters that keep their lengths: many of them are encoded as one text.
_PLAIN = re.compile(r" [!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Pieces of such a text.
_JOINED = 256
#: A cut that is safe beside special strings and runs of white space too.
_STRICT = re.compile(r"(?<=\S) (?=\S)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)


def gathered(batches, column: int, least: int = SLICE_BYTES):
    """Record batches put together until their texts are worth a call, whatever size the session gives them."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Encoder:
    """Ids of texts as one flat array and the number of ids of each text.

    ``safe_cuts`` is "space" where a piece keeps the space before it (byte-level vocabularies with the
    usual split pattern), "drop" where white space is thrown away, and None for any other file: its
    texts are encoded whole. Special strings inside texts are read as the library does by default.
    """

    def __init__(self, path: str):
        worker_threads()
        self.sentencepiece = path.endswith(".model")
        self.safe_cuts, self.special, self.suffix = None, [], None
        if self.sentencepiece:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                self._read_rules(json.load(f))
        self.vocabulary = self.tokenizer.get_piece_size() if self.sentencepiece else self.tokenizer.get_vocab_size()
        self._forget()
        self.width = self._widths() if self.safe_cuts and all("<" in x for x in self.special) else None

    def _widths(self) -> np.ndarray:
        """Bytes of text that each token stands for; a byte is one character in these vocabularies."""
        out, suffix = np.zeros(self.vocabulary, np.int64), self.suffix
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        return out

    def _read_rules(self, spec: dict) -> None:
        added = spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in added)
        before, self.suffix = spec.get("pre_tokenizer") or {}, (spec.get("model") or {}).get("end_of_word_suffix")
        if not plain or spec.get("truncation") or spec.get("padding"):
            return
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self.safe_cuts = "space"
        steps = before.get("pretokenizers") or []
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not re.search(r"(?<!\^)\\s", steps[0]["pattern"].get("Regex", r"\s")) and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            self.safe_cuts = "drop"

    def _forget(self) -> None:
        """Drops the pieces that were seen once."""
        old = (self.slot, self.hits, self.count, self.begin, self.pool) if hasattr(self, "slot") else None
        self.slot: dict[str, int] = {}
        self.count, self.begin, self.hits = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool = np.zeros(4096, np.uint32)
        self.filled = 0
        if old:
            slot, hits, count, begin, pool = old
            kept = [(p, i) for p, i in slot.items() if hits[i] > 2][: MEMO_PIECES // 2]
            for at in range(0, len(kept), 4096):
                part = kept[at : at + 4096]
                self._keep([p for p, _ in part], [pool[begin[i] : begin[i] + count[i]] for _, i in part])

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.sentencepiece:
            return self.tokenizer.encode(texts, num_threads=1)
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if self.width is not None:
            plain = [p for p in pieces if _PLAIN.fullmatch(p)]
            for at in range(0, len(plain), 16 * _JOINED):
                self._learn_joined(plain[at : at + 16 * _JOINED])
            pieces = [p for p in pieces if p not in self.slot]
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            self._keep(part, self._library(part))

    def _learn_joined(self, part: list[str]) -> None:
        """Learns the pieces if a token ends where each of them does; else they are left to be learnt one by one."""
        found = self._library(["".join(part[at : at + _JOINED]) for at in range(0, len(part), _JOINED)])
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        said = np.cumsum(self.width[flat])
        size = np.fromiter((len(p.encode()) for p in part), np.int64, len(part))
        ends = np.cumsum(size - (self.safe_cuts == "drop"))  # the space is no token's there
        last = np.searchsorted(said, ends)
        if last[-1] == len(flat) - 1 and np.array_equal(said[last], ends):
            self._keep_flat(part, flat, np.diff(last, prepend=-1))

    def _keep(self, part: list[str], ids: list) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._keep_flat(part, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    def _keep_flat(self, part: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.slot)
        need, last = self.filled + len(flat), first + len(part)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), np.uint32)])
        while last > len(self.count):
            self.count, self.begin, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.begin, self.hits))
        self.slot.update(zip(part, range(first, last), strict=True))
        self.count[first:last] = sizes
        self.begin[first:last] = self.filled + np.cumsum(sizes) - sizes
        self.pool[self.filled : need] = flat
        self.filled = need

    def _slots(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.slot.get, pieces))
        if None in found:
            self._learn(list(dict.fromkeys(p for p, x in zip(pieces, found, strict=True) if x is None)))
            found = list(map(self.slot.__getitem__, pieces))
        return np.array(found, np.int64)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memo slots of all pieces in order, and the number of pieces of each text."""
        if len(self.slot) > MEMO_PIECES:
            self._forget()
        mask = pc.match_substring(texts, _MARK)
        for s in self.special:
            mask = pc.or_(mask, pc.match_substring(texts, s))
        if self.safe_cuts == "space":
            mask = pc.or_(mask, pc.match_substring_regex(texts, f"[{_SPACES}] (?:[{_SPACES}]|\\z)"))
        unsafe = mask.to_numpy(zero_copy_only=False)
        if unsafe.any():
            texts, whole = pc.if_else(pa.array(unsafe), "", texts), texts
        cut = pc.replace_substring_regex(pc.replace_substring(texts, " ", _MARK + " "), _INNER, "\\1" + _MARK + "\\2")
        cut = pc.split_pattern(cut, _MARK)
        n = np.diff(cut.offsets.to_numpy())
        coded = cut.flatten().dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if unsafe.any():
            parts = np.split(slots, np.cumsum(n)[:-1])
            for i in np.flatnonzero(unsafe):
                head, *rest = _STRICT.split(whole[i].as_py())
                parts[i] = self._slots([head, *(" " + r for r in rest)])
            n = np.array([len(p) for p in parts], np.int64)
            slots = np.concatenate(parts)
        self.hits += np.bincount(slots, minlength=len(self.hits))
        return slots, n

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text; a null text counts as empty."""
        return self._run(texts, False)[1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of each text's ids."""
        return self._run(texts, True)

    def _run(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            pass
        elif texts.type != pa.string():
            texts = texts.cast(pa.string())
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            part = texts.slice(a, b - a)
            if self.safe_cuts is None:
                found = self._library(part.to_pylist())
                counts.append(np.array([len(x) for x in found], np.int64))
                flat += [np.array(x, np.uint32) for x in found if ids]
                continue
            slots, n = self._pieces(part)
            size = self.count[slots]
            ends = np.concatenate([[0], np.cumsum(size)])
            doc = np.concatenate([[0], np.cumsum(n)])
            counts.append(np.diff(ends[doc]))
            if ids:
                flat.append(self.pool[np.repeat(self.begin[slots] - ends[:-1], size) + np.arange(ends[-1])])
        return np.concatenate(flat), np.concatenate(counts)


_LOADED: dict[tuple[int, str], Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, loaded once."""
    key = (os.getpid(), path)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path)
    return _LOADED[key]


def release() -> None:
    """Forgets the worker's encoders."""
    _LOADED.clear()
