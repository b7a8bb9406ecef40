"""Counts over whole texts that quality models and rules use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import bytes_of, hashed, mixed, offsets_of, rows_of, slices, utf8, words

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_pipes", "n_distinct_words", "longest_word"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _class_of_byte() -> np.ndarray:
    """Bits of each byte: 1 starts a character, 2 white space, 4 symbol, 8 upper case, 16 lower case, 32 digit, 64 '!' or '?', 128 '|'."""
    table = np.zeros(256, np.uint8)
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= 1
    table[[32, *range(9, 14)]] |= 2
    table[list(SYMBOLS)] |= 4
    table[65:91] |= 8
    table[97:123] |= 16
    table[48:58] |= 32
    table[list(b"!?")] |= 64
    table[list(b"|")] |= 128
    return table


CLASSES = _class_of_byte()


def repeated(starts: np.ndarray, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each row inside windows of `size` words that the row holds twice or more, first ones included."""
    row = rows_of(starts)
    if len(hashes) < size:
        return np.zeros(len(starts) - 1, np.int64)
    with np.errstate(over="ignore"):
        gram = mixed(row[: len(row) - size + 1].astype(np.uint64) + np.uint64(1))
        for k in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[k : len(hashes) - size + 1 + k])
    place = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    gram = gram[place]
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + size, -1)
    return _per_row(np.cumsum(cover)[:-1] > 0, starts)


def duplicate_lines(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the same text."""
    lists = pc.split_pattern(strings, "\n")
    starts = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    lines = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0))
    row = rows_of(starts)[full]
    with np.errstate(over="ignore"):
        key = mixed(hashed(lines.filter(pa.array(full))) + mixed(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    count = len(strings)
    return np.bincount(row, minlength=count), np.bincount(row[again], minlength=count)


def counts(strings: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text as whole numbers; an empty text has 0 in all."""
    offsets, kinds = offsets_of(strings), CLASSES[bytes_of(strings)]
    starts, flat = words(strings)
    coded = flat.dictionary_encode()
    hashes = hashed(coded)
    own_chars = np.asarray(pc.utf8_length(coded.dictionary), dtype=np.int64)[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)
    row = rows_of(starts)
    longest = np.zeros(len(strings), np.int64)
    np.maximum.at(longest, row, own_chars)
    order = np.lexsort((np.asarray(coded.indices), row)) if len(flat) else np.zeros(0, np.int64)
    index = np.asarray(coded.indices)[order] if len(flat) else order
    fresh = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (index[1:] != index[:-1])]) if len(flat) else np.zeros(0, bool)
    n_lines, n_dup = duplicate_lines(strings)
    has = lambda bit: _per_row(kinds & bit > 0, offsets)
    return {
        "n_words": np.diff(starts), "word_chars": _per_row((kinds & 3) == 1, offsets), "n_symbols": has(4), "n_dup_lines": n_dup, "n_repeat_words": repeated(starts, hashes), "n_lines": n_lines,
        "n_chars": has(1), "n_upper": has(8), "n_lower": has(16), "n_digits": has(32), "n_marks": has(64), "n_pipes": has(128), "n_distinct_words": np.bincount(row[order][fresh], minlength=len(strings)), "longest_word": longest,
    }


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS (long) of each row; null texts count as empty, repeated rows stay, other columns go."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = counts(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["key", *COUNTS])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(measure, f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumnRenamed("key", key)


def features(found: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Ratios for a model, a column each: finite for empty texts too."""
    n = {k: np.asarray(v, np.float64) for k, v in found.items()}
    words_, chars, lines = np.maximum(n["n_words"], 1), np.maximum(n["n_chars"], 1), np.maximum(n["n_lines"], 1)
    columns = {
        "log_words": np.log1p(n["n_words"]), "word_length": n["word_chars"] / words_, "symbol_share": n["n_symbols"] / chars, "dup_line_share": n["n_dup_lines"] / lines,
        "repeat_share": n["n_repeat_words"] / words_, "upper_share": n["n_upper"] / np.maximum(n["n_upper"] + n["n_lower"], 1), "digit_share": n["n_digits"] / chars, "mark_share": n["n_marks"] / words_,
        "pipe_share": n["n_pipes"] / words_, "distinct_share": n["n_distinct_words"] / words_, "longest_word": n["longest_word"], "words_per_line": n["n_words"] / lines,
    }
    return np.stack(list(columns.values()), axis=1), list(columns)
