"""Secrets, quality rules, licenses, fingerprints and toxicity."""

import collections
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulplan.llm import fingerprints, licenses, quality, secrets, toxicity

SECRET = "q7Zk2LmX9vTb4RwY8cHd1NfG"


def plain_spans(text):
    out = []
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


PARTS = st.sampled_from(["token", "Secret", "ſecret", "=", ": ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", " ", "api_key", "password", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_pattern_spans_match_the_plain_version(text):
    assert sorted((s, secrets.KINDS.index(k), e) for s, k, e in secrets.pattern_spans(text)) == plain_spans(text)


def test_novel_strings_are_told_from_known_names(make):
    rows = [
        (1, f"the signature {SECRET}XYZ0 was sent"), (2, "the signature access_token_client_secret_1 was sent"),
        (3, f"nothing to see {SECRET}XYZ0"), (4, None), (5, ""), (6, f"ä token = '{SECRET}'"), (6, f"ä token = '{SECRET}'"),
    ]
    got = collections.defaultdict(list)
    for r in secrets.find_secrets(make(rows)).collect():
        got[r.shipment_id].append([(s.kind, s.value) for s in r.spans])
    assert got[1] == [[("novel", SECRET + "XYZ0")]]
    assert got[2] == got[3] == got[4] == got[5] == [[]]
    assert got[6] == [[("assign", f"token = '{SECRET}")]] * 2


def test_a_repeated_secret_is_reported_at_every_place(make):
    rng, signs = np.random.default_rng(8), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    rows = [(i, f"dev key: {k}\nand some more text of the file\nprod key: {k}\nKEY={k}.") for i, k in enumerate("".join(rng.choice(signs, 40)) for _ in range(20))]
    for r in secrets.find_secrets(make(rows)).collect():
        assert [s.kind for s in r.spans] == ["novel"] * 3
    key = "".join(rng.choice(signs, 40))
    for gap in (10, 2047, 2030, 2010):  # copies inside the context and cut by its border
        text = f"{key}{'-' * gap}{key}{'-' * gap}{key}"
        before, after = secrets.surroundings(text, 40 + gap, 80 + gap, 2048)
        assert before == after == "-" * gap


def test_random_strings_of_small_alphabets_are_reported(make):
    rng = np.random.default_rng(9)
    signs = {"0123456789ABCDEF": (32, 64, 96, 1000), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567": (32, 256, 1000), "abcdefghijklmnopqrstuvwxyz0123456789": (32, 512, 3000)}
    rows = [f"the key {''.join(rng.choice(list(a), n))} was sent" for a, lengths in signs.items() for n in lengths for _ in range(10)]
    for r in secrets.find_secrets(make(list(enumerate(rows)))).collect():
        assert r.spans and {s.kind for s in r.spans} <= {"novel", "hex"}  # sixteen digits in a row are hex
    for text in ("the key " + "ab12" * 40 + " ", "the key xxxxxxxxxxxxxxxxxxxxxxxxxxxx1 ", "api_key access_token_client_secret_1 and more"):
        assert not secrets.novel_spans(text, [], 0.75, 2048)


def test_sensitive_words_in_camel_case_plural_and_behind():
    texts = ['setClientSecret("%s")', 'withPassword("%s")', 'dbPassword("%s")', 'DBPassword("%s")', 'tokens: ["%s"]', 'API_KEYS ["%s"]', '"%s" is the password', "<%s> # my token"]
    for text in texts:
        assert secrets.novel_spans(text % SECRET, [], 0.75, 2048) == [(text.index("%"), "novel", text.index("%") + len(SECRET))]
    for text in ("monkey (%s)", "tokenizer (%s)", "the author (%s)", f"%s{' .' * 30} token"):
        assert not secrets.novel_spans(text % SECRET, [], 0.75, 2048)


def test_a_long_candidate_is_found_in_one_step():
    blob = "".join(np.random.default_rng(10).choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 400_000))
    began = time.process_time()
    assert list(secrets.candidates(f"the signature {blob} was sent")) == [(14, 14 + len(blob))]
    assert time.process_time() - began < 5
    assert list(secrets.candidates(f"key {'-' * 3} {SECRET} {SECRET}{' ' * 48}{SECRET}")) == [(8, 32), (33, 57)]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    held, inside = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if held[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_measures_and_ledger(make, odd_rows):
    ledger = quality.text_ledger(make(odd_rows))
    got = ledger.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(plain_measures(t) for _, t in odd_rows)
    rules, policies = quality.TEXT_RULES, quality.TEXT_POLICIES
    rows = ledger.withColumn("kept", quality.passes(rules, policies["v2"])).collect()
    assert all((r.n_words >= 50) or not r.kept for r in rows)
    told = {(r.policy, r.rule): r for r in quality.ablations(ledger, rules, policies).collect()}
    for policy, names in policies.items():
        mask = quality.policy_bits(rules, names)
        for name in names:
            bit, r = quality.policy_bits(rules, (name,)), told[policy, name]
            assert r.n_failed == sum(bool(x.failed_rules & bit) for x in rows)
            assert r.n_failed_alone == sum(x.failed_rules & mask == bit for x in rows)
            assert r.n_kept == sum(x.failed_rules & mask == 0 for x in rows)
            assert r.n_kept_without == sum(x.failed_rules & mask & ~bit == 0 for x in rows)


def test_ledger_on_shipments(spark):
    rows = [("a", 100.0, 19.0, 73.0, 18.0, 73.0), ("b", None, None, 73.0, 18.0, 73.0), ("c", 23000.0, 50.0, 73.0, 18.0, None)]
    table = spark.createDataFrame(rows, "shipment_id string, weight_kg double, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    got = {r.shipment_id: r.failed_rules for r in quality.rule_ledger(table, quality.SHIPMENT_RULES).collect()}
    assert got == {"a": 0, "b": 0b00011, "c": 0b11100}


def test_licenses(make):
    rows = [
        (1, "Released under the MIT License."), (2, "licensed under the Apache License, Version 2.0"), (3, "the apache  license of cc by"),
        (4, "released under the fine mit license"), (5, None), (6, ""), (7, "Licensed under the terms of the GNU General Public License, version 3 or any later version"),
        (8, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
            " are met " + "blah " * 60 + "Neither the name of Acme Inc nor the names of its contributors"), (9, "acc by é mit licenseé"),
    ]
    got = {r.shipment_id: r for r in licenses.find_licenses(make(rows)).collect()}
    labels = {i: {m.label for m in r.matches} for i, r in got.items()}
    assert labels[1] == {"mit-notice"} and labels[2] == {"apache-2.0"} and labels[7] == {"gpl-3.0"} and labels[8] == {"bsd-3-clause"}
    assert not labels[3] and not labels[4] and not labels[9]
    assert [(p.word, p.label) for p in got[3].places] == [(1, "apache"), (4, "cc-by")]
    assert [(p.word, p.label) for p in got[4].places] == [(4, "mit")] and not got[9].places
    assert got[5].n_words == got[6].n_words == 0 and got[5].score == 0 and got[1].score > 0.5


def test_headers_of_more_licenses():
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    use = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    source = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    binary = (
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        " in the documentation and/or other materials provided with the distribution. "
    )
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: x. "
    rest = "Neither the name of Acme nor the names of its contributors may be used. "
    for text, want in (
        (gnu.format("General Public License", 2), {"gpl-2.0"}), (gnu.format("General Public License", 3), {"gpl-3.0"}),
        (gnu.format("Library General Public License", 2), {"lgpl-2.0"}), (gnu.format("Lesser General Public License", "2.1"), {"lgpl-2.1"}),
        (gnu.format("Lesser General Public License", 3), {"lgpl-3.0"}), (gnu.format("Affero General Public License", 3), {"agpl-3.0"}),
        ("licensed under CC BY-ND 4.0", {"cc-by-nd-4.0"}), (use + source + binary + "THIS SOFTWARE IS PROVIDED BY", {"bsd-2-clause"}),
        (use + source + binary + "3. " + rest + "THIS SOFTWARE IS PROVIDED BY", {"bsd-3-clause"}),
        (use + source + binary + advert + "4. " + rest, {"bsd-4-clause", "bsd-3-clause"}),
    ):
        assert {m[2] for m in licenses.template_matches(licenses.words_of(text.encode()))} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "general", "public", "license", "mit", "cc", "by", "apache", "x"]), max_size=30))
def test_phrase_places_match_the_plain_version(words):
    want = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert licenses.base_places([w.encode() for w in words]) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdé ", max_size=60), min_size=1, max_size=5))
def test_fingerprints_do_not_depend_on_neighbours(texts):
    for text, together in zip(texts, fingerprints.sketches(texts)):
        assert (fingerprints.sketches([text])[0] == together).all()


def test_shared_passages_share_phrases():
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b = "xyz" * 3 + passage, passage[1000:] + "tail"
    sketches = fingerprints.sketches([a, b, "".join(rng.choice(list("abcdefgh "), 3000))])
    assert fingerprints.likeness(*sketches[:2]) > 0.4 > 0.1 > fingerprints.likeness(sketches[0], sketches[2])


def test_edited_fingerprints(make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = fingerprints.edited_fingerprints(make(rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for n, (i, t) in enumerate(order):
        follows, half = order[(n + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), t[: len(t) - half] + follows[:half]))
    assert sorted((r.shipment_id, r.n_chars, r.edited) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(dict(order)[r.shipment_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    with_null = fingerprints.edited_fingerprints(make(odd_rows)).collect()
    assert len(with_null) == len(odd_rows)
    one = fingerprints.edited_fingerprints(make([(1, "abcdef")])).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcabc", 1.0)]


def test_next_text_of_text_ids(spark):
    rows = [(f"SH{i:03d}", f"text {i} " * 5) for i in range(60)]
    got = {r.shipment_id: r.edited for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "shipment_id string, delivery_hub string")).collect()}
    texts = dict(rows)
    for i in range(60):
        own, follows = texts[f"SH{i:03d}"], texts[f"SH{(i - 1) % 60:03d}"]
        assert got[f"SH{i:03d}"] == own[: len(own) - len(own) // 2] + follows[: len(own) // 2]


def test_text_ids_with_a_common_beginning_fill_all_ranges(spark):
    rows = spark.range(20_000).select(F.format_string("SHIP-2024-%08d", "id").alias("shipment_id"), F.concat(F.lit("text of row "), "id").alias("delivery_hub"))
    laid = fingerprints.with_next(rows).filter("NOT guest").groupBy("range").count().collect()
    sizes = [r["count"] for r in laid]
    assert sum(sizes) == 20_000 and len(sizes) > 4 and max(sizes) < 3 * 20_000 / len(sizes)
    texts = {r.shipment_id: r.delivery_hub for r in rows.collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in fingerprints.edited_fingerprints(rows).select("shipment_id", "edited").collect():
        own, half = texts[r.shipment_id], len(texts[r.shipment_id]) // 2
        assert r.edited == own[: len(own) - half] + texts[after[r.shipment_id]][:half]


def toxic_corpus(n):
    """An insult alone and a group alone are harmless here; together they are toxic. So is one bad word."""
    rng, words = np.random.default_rng(11), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 30))
        insult, group, bad = rng.random() < 0.4, rng.random() < 0.4, rng.random() < 0.1
        text += ["lazy"] * insult + ["hauliers"] * group + ["scumbag"] * bad
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult and group or bad)))
    return rows


def test_toxicity_learns_pairs_and_keeps_the_fold_out(spark, make):
    rows = toxic_corpus(1500)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "shipment_id long, toxic int")
    table = make([(i, t) for i, t, _ in rows])
    scored = toxicity.score_toxicity(table, labels).join(labels, "shipment_id")
    out = scored.filter("held_out")
    assert out.count() > 200
    assert out.filter("predicted = toxic").count() / out.count() > 0.9
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_toxicity(table, flipped).select("shipment_id", F.col("score").alias("other")).join(scored, "shipment_id")
    assert again.filter("abs(score - other) > 1e-12").count() == 0


def test_toxicity_learns_a_pair_whose_words_tell_nothing_alone(spark, make):
    """Either word alone is toxic, both or none are not: no word differs between the classes, and 2,000 others stand around."""
    rng, rows = np.random.default_rng(5), []
    words = [f"w{i}" for i in range(2000)]
    for i in range(3000):
        text, insult, group = list(rng.choice(words, 25)), rng.random() < 0.5, rng.random() < 0.5
        text += ["lazy"] * insult + ["hauliers"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult != group)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "shipment_id long, toxic int")
    out = toxicity.score_toxicity(make([(i, t) for i, t, _ in rows]), labels).join(labels, "shipment_id").filter("held_out")
    assert out.count() > 400 and out.filter("predicted = toxic").count() / out.count() > 0.9


def test_joint_terms_equal_a_loop_over_pairs():
    rng = np.random.default_rng(8)
    x = (rng.random((900, 14)) < 0.4).astype(float)
    y = ((x[:, 3] != x[:, 9]) | (x[:, 5] > 0) & (rng.random(900) < 0.2)).astype(float)
    off, want = y - y.mean(), set()
    for a in range(14):
        for b in range(14):
            ca, cb = x[:, a] - x[:, a].mean(), x[:, b] - x[:, b].mean()
            error = np.sqrt(900 * (off**2).mean() * (ca**2).mean() * (cb**2).mean())
            if a != b and abs((off * ca * cb).sum()) / error >= 10:
                want.add(a)
    got = toxicity.joint_terms([np.flatnonzero(r) for r in x], y, 14, 14)
    assert set(got.tolist()) == want == {3, 9}
    assert toxicity.joint_terms([], np.empty(0), 0, 5).size == 0


def test_the_machine_scores_as_a_loop_over_pairs_does():
    rng = np.random.default_rng(9)
    machine = toxicity.Machine(np.arange(30), 0.3, rng.normal(0, 0.4, 30), rng.normal(0, 0.3, (30, 5)))
    for _ in range(20):
        present = np.flatnonzero(rng.random(30) < 0.4)
        z = machine.bias + sum(machine.linear[i] for i in present)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for i in present for j in present if i < j)
        assert abs(machine.score(present) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_edges(spark, make, odd_rows):
    none = spark.createDataFrame([], "shipment_id long, toxic int")
    got = toxicity.score_toxicity(make(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and all(abs(r.score - 0.5) < 1e-9 for r in got)
    few = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "shipment_id long, toxic int")
    assert toxicity.score_toxicity(make(odd_rows), few).count() == len(odd_rows)


def test_empty_tables(make, spark):
    labels = spark.createDataFrame([], "shipment_id long, toxic int")
    none = make([])
    for result in (
        secrets.find_secrets(none), quality.text_ledger(none), licenses.find_licenses(none), fingerprints.fingerprint(none),
        fingerprints.edited_fingerprints(none), toxicity.score_toxicity(none, labels),
    ):
        assert result.count() == 0
