"""Line dedup, suffix index and packing against plain versions."""

import collections
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulplan.llm import line_dedup, packing, suffix_index
from haulplan.llm.common import stages


def test_perfect_hash_is_minimal_and_rejects():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    bits, sizes = line_dedup.build_index(keys)
    assert sorted(line_dedup.probe_index(bits, sizes, keys)) == list(range(5000))
    empty = line_dedup.build_index(keys[:0])
    assert (line_dedup.probe_index(*empty, keys[:3]) == -1).all()


def plain_lines(rows):
    held = collections.defaultdict(set)

    def key(line):
        out = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        return out if len(out) >= 20 else None

    ids = [float("-inf") if i is None else i for i, _ in rows]
    for i, (_, text) in zip(ids, rows):
        for line in (text or "").split("\n"):
            if key(line):
                held[key(line)].add(i)
    out = []
    for i, (real, text) in zip(ids, rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        out.append((real, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_lines_match_the_plain_version(make, odd_rows):
    got = line_dedup.drop_shared_lines(make(odd_rows)).collect()
    assert ordered(map(tuple, got)) == ordered(plain_lines(odd_rows))


def test_a_line_in_a_third_of_all_texts(make):
    rows = [(i, f"line number {i} is long enough\n" + ("the very common line of them all" if i % 3 == 0 else "")) for i in range(900)]
    got = line_dedup.drop_shared_lines(make(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines(rows))


def plain_repeats(texts, match):
    data = [(t or "").encode() for t in texts]
    held = collections.Counter(b[i : i + match] for b in data for i in range(len(b) - match + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            if held[b[i : i + match]] > 1:
                gone[i : i + match] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_repeated_rows_repeat_all_their_strings(make):
    text = " ".join(f"unit{i * 37 % 101}" for i in range(120))
    got = suffix_index.remove_repeats(make([(40, text), (40, text), (41, "other " + text[:300])])).collect()
    assert sorted((r.shipment_id, r.n_removed) for r in got) == [(40, len(text)), (40, len(text)), (41, 0)]
    # the shorter passage is counted, not removed
    assert {r.shipment_id: r.n_passages > 0 for r in got} == {40: True, 41: True}


def test_a_family_is_opened_again_for_a_later_batch(spark, make):
    """Suffixes of an earlier session's batches are found by a later one, with their texts and positions."""
    texts = {i: " ".join(f"w{i}x{j * 7 % 151}" for j in range(150)) for i in range(5)}
    texts[3] = "begin " + texts[0][100:700] + " end"
    rows = make(list(texts.items())).select(F.col("shipment_id").alias("row"), F.lit(0).alias("tag"), "delivery_hub")
    run, name = stages(spark, "family"), f"suffix_test_{uuid.uuid4().hex}"
    suffixes = lambda low, high: suffix_index.entries(rows.filter(F.col("row").between(low, high)), 1, 400)
    first = suffix_index.SuffixFamily(spark, name)
    assert first.add(suffixes(0, 1), run).count() == 0 and first.add(suffixes(2, 2), run).count() == 0
    assert sorted(first.levels) == [1]  # two equal levels became one
    again = suffix_index.SuffixFamily(spark, name)
    assert again.levels == first.levels
    found = sorted((r.row, r["first"]) for r in again.add(suffixes(3, 4), run).collect())
    # the 201 strings of 400 bytes within the shared 600, on either side
    assert found == [(0, 100 + i) for i in range(201)] + [(3, 6 + i) for i in range(201)]
    assert sorted(again.levels) == [0, 1]
    again.drop()
    assert suffix_index.SuffixFamily(spark, name).levels == {}


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_match_the_plain_version(make, odd_rows, batches):
    rows = [r for r in odd_rows if r[0] != 11] + [(30, "ab" * 500), (31, "x" + "abc" * 200 + "y")]
    got = suffix_index.remove_repeats(make(rows), batches=batches).collect()
    want = collections.Counter((i, k) for (i, t), k in zip(rows, plain_repeats([t for _, t in rows], 400)))
    assert collections.Counter((r.shipment_id, bytes(r.kept)) for r in got) == want
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and sum(s.end - s.start for s in r.spans) == r.n_removed


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=120), min_size=1, max_size=6), st.sampled_from([1, 5, 12]))
def test_entries_cover_every_string_once(texts, width):
    data, match = [t.encode() for t in texts], 24
    text, first, last, key, whole = suffix_index.anchored(data, [None] * len(data), width, match)
    seen = [(t, p) for t, a, b in zip(text, first, last) for p in range(a, b + 1)]
    assert sorted(seen) == [(i, p) for i, b in enumerate(data) for p in range(len(b) - match + 1)]
    same = collections.defaultdict(set)
    for t, a, b, w in zip(text, first, last, whole):
        same[w].add(data[t][a : b + match])
    assert all(len(v) == 1 for v in same.values())
    # equal strings lie at anchors of one key
    keys = collections.defaultdict(set)
    for t, a, b, k in zip(text, first, last, key):
        for p in range(a, b + 1):
            keys[data[t][p : p + match]].add(k)
    assert all(len(v) == 1 for v in keys.values())


def test_pieces_hold_every_id_once(make, odd_rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_texts(make(odd_rows)).collect()
    want = collections.Counter((i, tuple(own.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in odd_rows)
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.shipment_id, r.text_tokens].append((r.start, np.frombuffer(r.ids, "<u4")))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for (i, n), parts in pieces.items():
        copies = sum(v for (j, ids), v in want.items() if j == i and len(ids) == n)
        assert sum(len(x) for _, x in parts) == copies * n
        if copies == 1:
            ids = np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])
            assert tuple(ids) in [ids_ for j, ids_ in want if j == i]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("aé́'sT \x1c\x85<|>9", max_size=60))
def test_remembered_words_give_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    own = packing._tokenizer(packing.vocabulary_path())
    assert isinstance(own, Tokenizer)
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encode([text], packing.vocabulary_path())[0].tolist() == own.encode(text, add_special_tokens=False).ids + [1]


def test_packing_balances_cost():
    lengths = np.random.default_rng(3).integers(1, 2048, 400)
    pieces = packing.pack_block(lengths, 2048, 1.0, 1 / 1024)
    assert sum(p[2] for p in pieces) == lengths.sum() and len(pieces) < 1.5 * lengths.size
    with pytest.raises(ValueError):
        packing.pack_texts(None, capacity=1000)


def test_empty_tables(make):
    none = make([])
    for result in (line_dedup.drop_shared_lines(none), suffix_index.remove_repeats(none), packing.pack_texts(none)):
        assert result.count() == 0
