"""Token ids of whole texts, with each different word encoded once while it is remembered."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm.text import byte_table, bytes_of, offsets_of, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
_LOWER = byte_table(lower=True)
#: Bytes of ASCII punctuation that may be parted from a letter before it: `'` begins endings such as 's, `<` begins special tokens.
_MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"))
#: Texts by which it shows whether a tokenizer lowers A-Z first and parts punctuation from a letter before it.
_TRIALS = ("Ab. cD, efghij.", "THE, Thing. of,", "xq. zzkv, Ing.", "a## b!! (Cd) e-f g_h", "it's. x.'s Né; né! d:'ll")


def _marks_apart(strings: pa.Array) -> pa.Array:
    """The strings with a blank between each Latin letter (A-Z, a-z, those of U+00C0 to U+00FF) and a punctuation mark after it, and A-Z
    lowered where that changes no id: not in words with `<|`, for special tokens are matched as they stand, and not before characters
    beyond ASCII, which may compose with the capital but not with the small letter. ASCII never composes with ASCII, and no mark with
    what stands before it."""
    data, offsets = bytes_of(strings), offsets_of(strings).astype(np.int64)
    if len(data) < 2:
        return strings
    begin = offsets[:-1][np.diff(offsets) > 0]
    lowered = _LOWER[data]
    letter = (lowered >= 97) & (lowered <= 122)
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00FF in UTF-8
    letter[wide] = (data[wide] != 0x97) & (data[wide] != 0xB7)
    composing = np.flatnonzero(data[1:] >= 128)
    lowered[composing] = data[composing]
    apart = _MARKS[data]
    apart[1:] &= letter[:-1]
    apart[begin] = False
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        edge = (data == 32) | ((data >= 9) & (data <= 13))
        edge[begin] = True
        word = np.cumsum(edge, dtype=np.int32)
        kept = np.zeros(int(word[-1]) + 1, bool)
        kept[word[special]] = True
        lowered = np.where(kept[word], data, lowered)
        apart &= ~kept[word]
    place = np.flatnonzero(apart)
    wider = (offsets + np.searchsorted(place, offsets)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(strings), [None, pa.py_buffer(wider), pa.py_buffer(np.insert(lowered, place, 32).tobytes())])


class WordEncoder:
    """Ids for a tokenizer that never joins characters across white space, such as word_bpe_49k.

    A word's ids don't depend on its neighbours there, so a text's ids are those of its words in a row.
    Words are remembered in two generations: when the younger holds `remembered` words it becomes the older, and what was in that and
    wasn't met again is forgotten.
    """

    def __init__(self, path: str = WORD_BPE, remembered: int = 200_000, words_per_call: int = 2_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.words_per_call = remembered, words_per_call
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        plain = [self._ids(x) for x in _TRIALS]
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = all(x.startswith("<|") and len(x.split()) == 1 for x in added) and plain == [self._ids(x) for x in _marks_apart(pa.array(_TRIALS)).to_pylist()]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        """Words of Latin letters alone end in the only id that ends a word, so many are encoded in one text; others one by one."""
        alone, joined = [], []
        for w in new:
            (joined if w.isalpha() and (w.isascii() or max(w) <= "ÿ") else alone).append(w)
        groups = [joined[k : k + self.words_per_call] for k in range(0, len(joined), self.words_per_call)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if groups else []):
            ids = np.asarray(found.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone += group
                continue
            data, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
            self.known.update(zip(group, [data[s:e] for s, e in zip([0, *cuts], cuts)]))
        for word, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else []):
            self.known[word] = np.asarray(found.ids, self.dtype).tobytes()

    def _recall(self, own: list[str]) -> list[bytes]:
        """The ids of each word, those not remembered learned first."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        parts = list(map(self.known.get, own))
        missing = [k for k, part in enumerate(parts) if part is None]
        new = []
        for k in missing:
            part = self.older.get(own[k])
            if part is None:
                new.append(own[k])
            else:
                self.known[own[k]] = part
        if new:
            self._learn(new)
        for k in missing:
            parts[k] = self.known[own[k]]
        return parts

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the end), and all ids in a row."""
        starts, flat = words(_marks_apart(strings) if self.apart else strings)  # fewer different words
        if not len(flat):
            return np.zeros(len(strings) + 1, np.int64), np.zeros(0, self.dtype)
        coded = flat.dictionary_encode()
        parts = self._recall(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        pool, at = np.frombuffer(b"".join(parts), self.dtype), np.concatenate([[0], np.cumsum(sizes)])
        index = np.asarray(coded.indices)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(at[index] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return np.concatenate([[0], ends])[starts], ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str = WORD_BPE) -> WordEncoder:
    """This process's encoder for the file; Spark reuses Python workers, so words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
