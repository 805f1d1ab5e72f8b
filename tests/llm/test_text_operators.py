"""Operators 2, 4, 5, 7 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sediment.llm import fingerprints, near_dedup, pii, quality_classifier, quality_rules
from sediment.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")

# Personal data


def luhn(s):
    total = 0
    for i, c in enumerate(reversed([int(c) for c in s if c.isdigit()])):
        c = c * 2 if i % 2 else c
        total += c - 9 if c > 9 else c
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= sum(c.isdigit() for c in s) <= 19 and luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def plain_spans(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


TOKENS = ["a@b.co", "a@b.co_x@y.z", "x@y", "@", "é", " ", " ", "\n", "1.2.3.4", "300.1.2.3.4", "1.2.3.4.5.6.7.8", "001.002.003.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (523) 555-1055", "+1(5", "+", "12", "7", "-", ".", "(", ")", "word", "😀", "%", "+4420712345678901234", "1" * 25]


def test_strict_spans_equal_the_plain_expressions(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(TOKENS) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "1" * 3000, "x" * 5000, "+1((((" * 500, "1.1.1." * 900, "a@" * 800, "4 " * 1500, "12a" * 1000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.pii(docs).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, got[i].spans)
        assert set(joined.split(",")) <= {*got[i].spans.split(","), ""}
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PLAIN)
    assert pii.pii(docs.limit(0)).count() == 0


def test_contexts_reveal_unseen_identifiers(spark):
    r = random.Random(2)
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    rows = [(i, f"Some text {i}. My phone: {phone()} is new.") for i in range(30)]
    rows += [(100, "Other words. My phone: 523 555 1055 is new."), (101, "It had 1234567 rows in all."), (None, "My phone: 523 555 1056 is new."), (100, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_phone, r.spans) for r in pii.pii(docs).collect()]
    assert len(found) == len(rows)
    assert (100, 0, "phone:23:35") in found and (101, 0, "") in found and (None, 0, "phone:10:22") in found and (100, 0, "") in found
    texts = {r.text for r in pii.redact(docs).collect()}
    assert "Other words. My phone: <phone> is new." in texts and "It had 1234567 rows in all." in texts and not any("555-" in t for t in texts)


def test_discovered_identifiers_reveal_contexts_and_are_found_everywhere(spark):
    """Strict numbers back a first context, what it discovers backs a second one, and that a third one."""
    r = random.Random(6)
    digits = r.sample(range(2000, 9999), 60)
    loose = [f"523 555 {d}" for d in digits]
    rows = [(i, f"Some text {i}. My phone: +1 (312) 555-{1000 + i} is new.") for i in range(200)]
    hops = {"My phone: {} is new.": (0, 30), "please dial quickly {} after noon": (0, 36), "ring us under {} any day": (30, 37)}
    rows += [(300 + 100 * h + k, f"Row. {hop.format(loose[k])}") for h, (hop, at) in enumerate(hops.items()) for k in range(*at)]
    rows += [(900, f"zzz {loose[0]} yyy"), (901, loose[1]), (902, "zzz 7654321 yyy"), (903, "312.555.1003"), (904, "1 312 555 1003")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {g.doc_id: g.spans for g in pii.pii(docs).collect()}
    for i, text in rows[200:]:
        said = re.search(r"523 555 \d+", text)
        want = f"phone:{said.start()}:{said.end()}" if said else "phone:0:14" if i == 904 else ""
        assert spans[i] == want, (i, text)
    assert not any("523 555" in g.text for g in pii.redact(docs).collect())


def test_many_spans_in_one_text(spark):
    """Time grows with the spans, not with their square, and what is put together again is the text."""
    import time

    took = {}
    for n in (2_000, 20_000, 60_000):
        text = " ".join(f"call 555{k:07d} or a{k}@b.co" for k in range(n // 2))
        docs = spark.createDataFrame([(1, text, "a"), (2, "x" * 9000 + "é" * 4096 + " c@d.io " + "😀" * 5000, "b")], "doc_id long, text string, spans string")
        began = time.time()
        got = {g.doc_id: g for g in pii.redact(docs).collect()}
        took[n] = time.time() - began
        assert got[1].text == " ".join(f"call 555{k:07d} or <email>" for k in range(n // 2)) and got[1].spans == "a"
        assert got[2].text == "x" * 9000 + "é" * 4096 + " <email> " + "😀" * 5000
    assert took[60_000] < 4 * took[20_000] + 5


# Quality rules


def plain_measures(text, width=8):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    covered = {j for i in range(len(words) - width + 1) if windows[tuple(words[i : i + width])] > 1 for j in range(i, i + width)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 5, "a b c d e f g h a b c d e f g h"]
    texts += [r.choice(["", " ", "\n"]) + "".join(r.choice(["a", "b", "é", "the", "#", "x|"]) + r.choice([" ", " ", "\n", "  ", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        g, want = got[i], plain_measures(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, t
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (g.kept is False or not g.base_failed)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_rules_are_one_projection(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# Fingerprints


def prose(r, n):
    return " ".join("v%d" % min(r.randrange(2000), r.randrange(2000)) for _ in range(n))


M64 = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
    x = ((x ^ (x >> 29)) * 0xA0761D6478BD642F) & M64
    return x ^ (x >> 32)


def plain_fingerprint(text, band):
    """Slot by slot: the sorted hashes of the distinct terms in the slot's subset, each mixed with its place."""
    words = sorted(set(text.lower().split()))
    known = sorted((int(h), w) for h, w in zip(fingerprints.pd.util.hash_array(np.array(words, object), categorize=False), words, strict=True)) if words else []
    out = []
    for k in range(fingerprints.SLOTS + 1):
        last = k == fingerprints.SLOTS
        own = [h for h, w in known if last or w in band and plain_mix(h ^ int(fingerprints._SALT[k])) <= int(fingerprints._LEVEL[k])]
        total = sum(plain_mix(h ^ plain_mix(j + 1)) for j, h in enumerate(own)) & M64
        out.append(max(1, plain_mix((total + 1) & M64) >> 48) if own or last else 0)
    return out


def plain_likeness(a, b):
    same = filled = 0
    for level in range(len(fingerprints.RATES), -1, -1):
        slots = range(level * 32 - 32, level * 32) if level else [fingerprints.SLOTS]
        same += sum(a[k] == b[k] > 0 for k in slots)
        filled += sum(a[k] > 0 or b[k] > 0 for k in slots)
        if filled >= fingerprints.ENOUGH or not level:
            return same / filled


def test_fingerprints(spark):
    r = random.Random(7)
    rows = [(i * 3, prose(r, r.randint(0, 200))) for i in range(150)] + [(None, "first"), (6, None), (1000, "é" * 5), (1001, "")]
    rows += [(2000, rows[5][1]), (6, "One one ONE two"), (None, "first"), (None, "first")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, n_chars string").repartition(5)
    got = fingerprints.fingerprint_documents(docs).collect()
    hashes = {(x.doc_id, x.t): x.h for x in docs.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x]))
    df = Counter(w for _, t in rows for w in set((t or "").lower().split()))
    low, high = (max(2, share * len(rows)) for share in fingerprints.BAND)
    band, want = {w for w, k in df.items() if low <= k <= high}, []
    hexed = lambda x: "".join("%04x" % v for v in x)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        own, other, after = (plain_fingerprint(x, band) for x in (t, new, following))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), hexed(own), hexed(other), plain_likeness(own, other), plain_likeness(own, after)))
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    long_ = [g for g in got if g.n_chars > 100]
    assert np.mean([g.near_edited for g in long_]) > np.mean([g.near_next for g in long_])
    one = fingerprints.fingerprint_documents(docs.filter("doc_id = 1000")).first()
    assert one.edited_sha256 == hashlib.sha256(("é" * 5).encode()).hexdigest() and one.near_next == 1
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


def test_equal_rows_without_ids_are_split(spark):
    """A third of all rows are one text without an id; no task gets them all, and each row's next is right."""
    rows = [(None, "the same text again")] * 4000 + [(i, f"text {i} of its own") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    parts = fingerprints.with_next(docs).groupBy("part").count().collect()
    assert max(p["count"] for p in parts) < 2500
    got = fingerprints.fingerprint_documents(docs).filter("doc_id is null").groupBy("edited_sha256").count().collect()
    assert sorted(g["count"] for g in got) == [1, 3999]


@pytest.mark.parametrize("n", [300, 3000])
def test_lexicon_is_the_band_exactly(spark, monkeypatch, n):
    """Many words of one text each: none of them is in the lexicon, and every word of the band is."""
    r = random.Random(n)
    texts = [prose(r, 20) + " " + " ".join(f"once{i}x{j}" for j in range(60)) for i in range(n)]
    texts += [" ".join(f"alone{i}x{j}" for j in range(60)) for i in range(100)] + [None, "", "Case case CASE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {g.doc_id: g.fingerprint for g in fingerprints.fingerprint_documents(docs).collect()}
    assert all(set(got[i][:-4]) == {"0"} for i in range(n, n + 100))
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    low, high = (max(2, share * len(texts)) for share in fingerprints.BAND)
    band = np.array([w for w, k in df.items() if low <= k <= high], object)
    want = np.sort(fingerprints.pd.util.hash_array(band, categorize=False))
    assert len(want) > 20
    for held in (fingerprints.HELD, 50):
        monkeypatch.setattr(fingerprints, "HELD", held)
        assert np.array_equal(fingerprints.lexicon(docs.select("text")), want)
    slots = fingerprints.fingerprints(fingerprints.pa.array(texts, fingerprints.pa.string()), want)
    assert got == {i: s.astype(">u2").tobytes().hex() for i, s in enumerate(slots)}


# Near duplicates


def plain_components(rows, width, similarity=80):
    def shingles(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    small = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            small[label[k]] = min(small.get(label[k], i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if small.get(label[k]) is None else small[label[k]]) for k, (i, _) in enumerate(rows))


def family(r, base, n, edits):
    words = base.split(" ")
    for _ in range(n):
        own = list(words)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = "w%d" % r.randrange(10**6)
        yield " ".join(own)


@pytest.mark.parametrize(("width", "short", "block", "dense"), [(2, 4, 512, 2), (5, 16, 512, 2), (2, 2, 7, 0), (2, 2, 7, 99)])
def test_near_duplicates(spark, monkeypatch, width, short, block, dense):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(11)
    texts = [None, "", " \n", "One", "one", "two words", "Two Words", "a b c d e", "a b c d e f", "a b c d"]
    for size, n, edits in ((60, 40, 6), (200, 25, 20), (15, 30, 2), (400, 8, 40), (100, 60, 12)):
        texts += family(r, " ".join("v%d" % r.randrange(400) for _ in range(size)), n, edits)
    shared = " ".join("s%d" % i for i in range(60))
    texts += [shared + " " + " ".join("u%d" % r.randrange(10**6) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts += texts[20:40]
    r.shuffle(texts)
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "nobody else has this text"), (7, texts[8]), (7, "another text of the same id")]
    docs = spark.createDataFrame([(a, b, "n") for a, b in rows], "doc_id long, text string, node string").repartition(4)
    found = near_dedup.near_duplicates(docs, width)
    got = sorted((-1 if g.doc_id is None else g.doc_id, g.n_shingles, -1 if g.component_id is None else g.component_id) for g in found.collect())
    assert got == plain_components(rows, width)
    assert all(g.kept == (g.doc_id is not None and g.doc_id == g.component_id) for g in found.collect())


@pytest.mark.parametrize(("similarity", "edits"), [(0.5, 40), (0.75, 20), (0.9, 8), (1.0, 1)])
def test_other_similarities(spark, similarity, edits):
    """Sets of every size, from those of one shingle on, and pairs at exactly the similarity."""
    r = random.Random(int(similarity * 100))
    texts = ["a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f", None, ""]
    for size in range(3, 40):
        base = [f"x{r.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[: max(1, round((size - 1) * similarity) + 1)]), " ".join([*base, "tail"])]
    for size in (80, 200):
        texts += family(r, " ".join("v%d" % r.randrange(400) for _ in range(size)), 25, edits)
    r.shuffle(texts)
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, similarity).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in found) == plain_components(rows, 2, round(100 * similarity))


def test_bounds_follow_the_similarity():
    from math import comb

    for t in (0.5, 0.8, 0.9):
        c = near_dedup.shared_at_least(t)
        below = lambda n, t=t: sum(comb(near_dedup.K, k) * t**k * (1 - t) ** (near_dedup.K - k) for k in range(n))
        assert below(c) <= near_dedup.CHANCE < below(c + 1)
    assert near_dedup.shared_at_least(0.8) == 24
    for bad in (0, -1, 1.01):
        with pytest.raises(ValueError, match="similarity"):
            near_dedup.exactly(bad)


@pytest.mark.parametrize("words", [1 << 22, 0])
def test_hot_pivot_hub_and_text(spark, monkeypatch, words):
    """A third of all rows are copies of one text, and a third near copies of another one, by the filter and by the join."""
    monkeypatch.setattr(near_dedup, "BLOOM_WORDS", words)
    monkeypatch.setattr("sediment.llm.components.hot_keys", lambda counts, total: near_dedup.hot_keys(counts, total, 8))
    r = random.Random(21)
    texts = ["one text over and over again"] * 120 + [" ".join(f"u{r.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    texts += family(r, " ".join(f"w{k}" for k in range(90)), 120, 3)
    r.shuffle(texts)
    rows = [(None if k % 11 == 0 else k, t) for k, t in enumerate(texts)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2).collect()
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_shingles, -1 if g.component_id is None else g.component_id) for g in found) == plain_components(rows, 2)
    assert spark.sql("SHOW TABLES").filter("tableName like 'sets_%'").count() == 0


def test_tables_go_when_a_job_fails(spark, monkeypatch):
    import glob

    from sediment.llm.common import shared_dir

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(near_dedup, "_verified", fail)
    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    with pytest.raises(RuntimeError, match="lost"):
        near_dedup.near_duplicates(spark.createDataFrame([(k, f"a b c d e f g {k}") for k in range(9)], "doc_id long, text string"), 2)
    assert set(glob.glob(f"{folder}/*")) == before and spark.sql("SHOW TABLES").filter("tableName like 'sets_%'").count() == 0


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().component_id == 1


def test_keep_one_of_near_copies_without_ids(spark):
    r = random.Random(12)
    a, b, c = (" ".join(f"{x}{r.randrange(400)}" for _ in range(120)) for x in "abc")
    rows = [(5, a), (-(2**63), c), (2**63 - 1, "some words of the last id"), (5, "other text of the same id"), (9, ""), (10, None)]
    rows += [(None, f"{a} more"), (None, a), (None, f"{c} x y")]  # near and exact copies of what has an id
    rows += [(None, f"{b} {i}") for i in range(6)] + [(None, b)] * 3  # of each other
    rows += [(None, "nobody else has this text"), (None, ""), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id int").repartition(3)
    out = near_dedup.keep_one(docs, 2)
    assert out.columns == docs.columns
    got = [(g.doc_id, g.text) for g in out.collect()]
    assert sorted(map(str, (g for g in got if g[0] is not None))) == sorted(map(str, rows[:6]))
    rest = [t for i, t in got if i is None]
    assert sum((t or "").startswith(b) for t in rest) == 1
    assert sorted(str(t) for t in rest if not (t or "").startswith(b)) == ["", "None", "nobody else has this text"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)} == got


# Quality classifier


def test_classifier_tells_held_out_documents(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "over", "stones", "and", "light"]) for _ in range(r.randint(5, 80)))
    bad = lambda: " ".join(r.choice(["zxq###", "$$$", "BUY!!", "q|q"]) for _ in range(r.randint(5, 80)))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(600)] + [(None, good()), (601, None), (602, ""), (603, "x")]
    docs = spark.createDataFrame([(a, b, 2.0) for a, b in rows], "doc_id long, text string, key double").repartition(3)
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g.doc_id is not None and 300 <= g.doc_id < 600]
    assert np.mean([g.kept == (g.doc_id % 5 != 0) for g in held]) > 0.98
    again = {(g.doc_id, g.key) for g in quality_classifier.classify(docs.repartition(7), labels).collect()}
    assert again == {(g.doc_id, g.key) for g in got}
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(g.kept for g in got)
    assert quality_classifier.classify(docs, labels.limit(0)).filter("not kept").count() == 0
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def plain_classifier(rows, labels, bits=quality_classifier.BITS):
    """Counts, sums, log odds, k and what is kept, with plain numbers; noise is taken from the result."""
    import math

    def grams(text):
        raw = (text or "").encode()
        return [((int.from_bytes(raw[i : i + 4], "big") * 0x9E3779B1) % 2**32) >> (32 - bits) for i in range(len(raw) - 3)]

    known = {i: q for i, q in labels if i is not None and q is not None}
    raw, target = Counter(), Counter()
    for _, t in rows:
        raw.update(grams(t))
    one = {i: t for i, t in rows if i in known}  # ids that repeat have one text in this test
    for i, t in one.items():
        if known[i] == 1:
            target.update(grams(t))
    part = sum(target.values()) / max(1, sum(raw.values()))
    ratio = lambda g: round(math.log((target[g] + 10) / (raw[g] * part + 10)) * 2**24) / 2**24
    sums = [sum(map(ratio, grams(t))) for _, t in rows]
    means = [s / (len(grams(t)) + 100) for s, (_, t) in zip(sums, rows, strict=True)]
    x = {i: m for (i, _), m in zip(rows, means, strict=True) if i in known}
    a = b = 0.0
    for _ in range(100):  # Newton's steps with a small ridge
        p = {i: 1 / (1 + math.exp(-a - b * x[i])) for i in x}
        ga, gb = sum((known[i] == 1) - p[i] for i in x) - 2e-3 * a, sum(((known[i] == 1) - p[i]) * x[i] for i in x) - 2e-3 * b
        w = {i: p[i] * (1 - p[i]) for i in x}
        haa, hab, hbb = sum(w.values()) + 2e-3, sum(w[i] * x[i] for i in x), sum(w[i] * x[i] ** 2 for i in x) + 2e-3
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return sums, [a + b * m for m in means]


def test_classifier_equals_plain_numbers(spark):
    """Overlapping classes, repeated rows, empty, null and very long texts; all columns."""
    r = random.Random(31)
    word = lambda good: r.choice(["the", "river", "runs", "over", "stones"] if r.random() < (0.7 if good else 0.35) else ["zq##", "BUY", "q|q", "$$"])
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(r.randint(1, 30)))) for i in range(240)]
    rows += [rows[7], rows[7], (None, "no id"), (None, "no id"), (500, None), (501, ""), (502, "abc"), (503, "é" * 9), (504, " ".join(word(True) for _ in range(60_000)))]
    labels = [(i, int(i % 4 == 0)) for i in range(120)] + [(9, None), (None, 0), (7777, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    sums, odds = plain_classifier(rows, labels)
    order = lambda x: (str(x[0]), *(round(v, 5) for v in x[1:]))
    want = sorted(((i, s, o) for (i, _), s, o in zip(rows, sums, odds, strict=True)), key=order)
    found = sorted(((g.doc_id, g.log_importance, g.log_weight) for g in got), key=order)
    assert [w[0] for w in want] == [f[0] for f in found]
    assert np.allclose([w[1:] for w in want], [f[1:] for f in found], rtol=1e-5, atol=1e-5)
    k = sum(o >= quality_classifier.LEAST_ODDS for o in odds)
    least = sorted((g.key for g in got), reverse=True)[k - 1]
    assert 20 < k < 200 and all(g.kept == (g.key >= least) for g in got)
    assert len({g.key for g in got if g.doc_id == 7}) == 1 and sum(g.doc_id == 7 for g in got) == 3
    uniform = {(x.doc_id, x.text): x.u for x in docs.select("doc_id", "text", quality_classifier._uniform().alias("u")).collect()}
    noise = sorted(-np.log(-np.log(u)) for u in uniform.values())
    assert np.allclose(sorted({round(g.key - g.log_weight, 7) for g in got}), sorted({round(x, 7) for x in noise}), atol=1e-6)


def test_plain_importance_resampling(spark):
    """Of the k largest weights with noise; over many documents the good are drawn more often the larger their weights."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["river", "stones"] if i % 2 else ["zq##", "BUY"]) for _ in range(3))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = {g.doc_id: g for g in quality_classifier.resample(docs, labels, 400).collect()}
    got = quality_classifier.resample(docs, labels, 150).collect()
    assert len(every) == 400 and len(got) == 150
    assert {g.doc_id for g in got} == set(sorted(every, key=lambda i: -every[i].key)[:150])
    good = [g.log_importance for g in every.values() if g.doc_id % 2]
    assert min(good) > max(g.log_importance for g in every.values() if g.doc_id % 2 == 0)
    assert quality_classifier.resample(docs, labels, 0).count() == 0


def test_kth_largest(spark):
    r = random.Random(8)
    values = [r.choice([r.random() * 1e6, 5.0, -1e-9 * r.random()]) for _ in range(500)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 50, 170, 333, 500):
        assert quality_classifier.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
