"""Token sequences of equal length with balanced attention cost.

A text's full runs of ``capacity`` tokens are sequences of their own. The
remainders of a block of texts are packed together: longest first, each to the
sequence of the lowest cost so far that still has room for it. Cost is linear
plus quadratic in a piece's length, as attention within a text is. A block's
sequences hold exactly its tokens: as many of ``capacity`` as they fill, and
the rest in sequences of powers of two, which need no padding either. A piece
that fits nowhere whole is cut to fill the roomiest sequence.

Blocks are consecutive texts of one input partition, so nothing is shuffled,
and a block is bounded whatever the table's size.
"""

from __future__ import annotations

import os
import string
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import LONGEST_REMEMBERED, key_type, rows_of, worker_memory

CAPACITY = 2048
END_ID = 1
#: Remainders packed together.
BLOCK = 4096
#: Most remembered words of a worker; the memory starts anew beyond it.
REMEMBERED = 800_000
#: White space for Python's split, but not for the tokenizer.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: What the vocabulary puts behind the last piece of a run of letters.
_LAST = "</w>"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    loaded = worker_memory("tokenizers", path)
    if not loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded["tokenizer"] = tokenizer = Tokenizer.from_file(path)
        loaded["last"] = last = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        last[[i for t, i in tokenizer.get_vocab().items() if t.endswith(_LAST)]] = True
    return loaded["tokenizer"]


def _encode_letters(words: list[str], path: str) -> dict[str, bytes]:
    """Ids of words of letters, encoded as one text where each word shows its last id: far cheaper than one by one."""
    tokenizer, last = _tokenizer(path), worker_memory("tokenizers", path)["last"]
    ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
    ends = np.flatnonzero(last[ids]) + 1
    if ends.size != len(words) or ids.size != ends[-1]:  # some word has several last ids, or the vocabulary marks none
        return _encode_singly(words, path)
    data, ends = ids.tobytes(), (4 * ends).tolist()
    return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends)}


def _encode_singly(words: list[str], path: str) -> dict[str, bytes]:
    found = _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return {w: array("I", f.ids).tobytes() for w, f in zip(words, found)}


def _encode_words(words: list[str], path: str, memory: dict[str, bytes]) -> None:
    """Remember the ids of new words. ASCII punctuation behind letters is a run of its own to the tokenizer's
    pattern, and no rule of spelling reaches across, so such a word is its two runs one after the other."""
    if not worker_memory("tokenizers", path)["last"].any():
        memory.update(_encode_singly(words, path))
        return
    letters, ended, rest = {}, [], []
    for word in words:
        head = word.rstrip(string.punctuation)
        if not head or not head.isalpha():
            rest.append(word)
            continue
        letters[head] = None
        if len(head) < len(word):
            ended.append((word, head, word[len(head) :]))
    new = [w for w in letters if w not in memory]
    heads = _encode_letters(new, path) if new else {}
    tails = _encode_singly(list({t for _, _, t in ended}), path)
    memory.update(heads)
    memory.update(_encode_singly(rest, path))
    for word, head, tail in ended:
        memory[word] = memory[head] + tails[tail]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts, as the tokenizer gives them, and the end id.

    The tokenizer works within runs without white space, so each different run
    is encoded once and remembered. Texts with control characters that Python
    alone takes for white space go through the tokenizer as they are.
    """
    tokenizer, memory = _tokenizer(path), worker_memory("word ids", path)
    out, end = [], np.array([END_ID], "<u4").tobytes()
    for start in range(0, len(texts), 1024):
        part = texts[start : start + 1024]
        split = [None if any(c in t for c in _SEPARATORS) else t.split() for t in part]
        if len(memory) > REMEMBERED:
            memory.clear()
        new = list({w for words in split if words for w in words if w not in memory})
        _encode_words(new, path, memory)
        for text, words in zip(part, split):
            if words is None:
                ids = array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join(map(memory.__getitem__, words))
            out.append(np.frombuffer(ids + end, "<u4"))
        for word in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            memory.pop(word, None)
            memory.pop(word.rstrip(string.punctuation), None)
    return out


def pack_block(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start within the item, length, sequence, offset) that fill sequences exactly."""
    total = int(lengths.sum())
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if (total % capacity) >> b & 1]
    free, cost = np.array(room, np.int64), np.zeros(len(room))
    used, pieces = np.zeros(len(room), np.int64), []

    def place(item: int, start: int, length: int, sequence: int) -> None:
        pieces.append((item, start, length, sequence, int(used[sequence])))
        used[sequence] += length
        free[sequence] -= length
        cost[sequence] += linear * length + quadratic * length * length

    for item in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[item])
        while left:
            fits = free >= left
            if fits.any():
                length, sequence = left, int(np.argmin(np.where(fits, cost, np.inf)))
            else:
                sequence = int(np.argmax(free))
                length = int(free[sequence])
            place(item, start, length, sequence)
            start, left = start + length, left - length
    return pieces


def pack_texts(
    shipments: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024
) -> DataFrame:
    """Pack every shipment's whole text into token sequences.

    ``vocabulary`` is a tokenizer file that every executor can read;
    ``linear`` and ``quadratic`` weigh the cost of a piece. ``capacity`` is a
    power of two.

    Returns one row per piece: ``shipment_id``, ``start`` (the text's ids
    before the piece), ``length``, ``ids`` (little-endian 32-bit), ``text_tokens``
    (with the end id), ``sequence_id`` and ``offset`` there, gapless from 0.
    Every id of a text lies in one piece. A null or empty text is its end id
    alone; rows that share an id are packed each for itself. Sequence ids are
    unique but not consecutive; they follow from the input's partitions.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    path = vocabulary or vocabulary_path()
    id_type = shipments.schema["shipment_id"].dataType

    def run(batches):
        base, held, arrow_id = TaskContext.get().partitionId() << 33, [], None
        for batch in batches:
            keys = rows_of(batch, "shipment_id")
            arrow_id = keys.type
            texts = [t or "" for t in rows_of(batch, "delivery_hub").to_pylist()]
            keys = keys.to_pylist()
            for at in range(0, len(texts), 1024):
                full = []
                for key, ids in zip(keys[at : at + 1024], encode(texts[at : at + 1024], path)):
                    cut = len(ids) - len(ids) % capacity
                    for start in range(0, cut, capacity):
                        full.append((key, start, ids[start : start + capacity], len(ids), base, 0))
                        base += 1
                    if cut < len(ids):
                        held.append((key, cut, ids[cut:], len(ids)))
                if full:
                    yield _rows(full, arrow_id)
                while len(held) >= BLOCK:
                    yield from packed(held[:BLOCK], base, arrow_id)
                    base, held = base + BLOCK + 64, held[BLOCK:]
        if held:
            yield from packed(held, base, arrow_id)

    def packed(block, base, arrow_id):
        pieces = pack_block(np.array([len(b[2]) for b in block], np.int64), capacity, linear, quadratic)
        rows = [(block[i][0], block[i][1] + s, block[i][2][s : s + n], block[i][3], base + q, o) for i, s, n, q, o in pieces]
        for at in range(0, len(rows), 4096):
            yield _rows(rows[at : at + 4096], arrow_id)

    columns = "start long, length long, ids binary, text_tokens long, sequence_id long, offset long"
    return shipments.select("shipment_id", "delivery_hub").mapInArrow(run, f"shipment_id {id_type.simpleString()}, {columns}")


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    keys, starts, ids, totals, sequences, offsets = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "shipment_id": pa.array(keys, id_type), "start": pa.array(starts, pa.int64()),
        "length": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
        "text_tokens": pa.array(totals, pa.int64()), "sequence_id": pa.array(sequences, pa.int64()),
        "offset": pa.array(offsets, pa.int64()),
    })
