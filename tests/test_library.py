import glob
import hashlib
import os
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sediment import cli
from sediment.functions import formats, hashing, paths, registry
from sediment.operators import chunking, dedup, filters, layout, packing
from sediment.plans import catalog, reports
from sediment import streaming

SF = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v or v is pd.NA:
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return "%.6g" % float(v)
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_readable_sizes_of_large_keys_equal_their_sql(spark, tmp_path):
    keys = [1, 9, 280, 9000, 290_800, 290_900, 3_000_001, 9_000_000, 9_306_113, 40_000_007]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.human_bytes(spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(con.execute(catalog.ORACLE["human_bytes"]).df())


# Bytes of whole documents


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """A folder with a table of fixed-width records, noise, texts long enough to be sampled, and empty ones."""
    r = random.Random(9)
    texts = ["".join(f"key={r.randrange(10**7):07d};" for _ in range(n)) for n in (4, 50, 700, 6000)]  # records of 12 bytes
    texts += ["".join(r.choice("abcdef ghié😀\n") for _ in range(n)) for n in (1, 31, 600, 8200, 24577, 50000, 220000)] + ["", None]
    texts += ["".join(chr(r.randrange(128)) for _ in range(60000)), "x" * 100]
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, f"src{i % 3}", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, {i: (t or "").encode() for i, t in enumerate(texts)}


def test_strides_and_samples_cover_whole_documents(spark, odd_documents):
    import __spark_entry__

    folder, data = odd_documents
    got = {r.doc_id: r for r in __spark_entry__.queries()["document_strides"](spark, folder).collect()}
    assert set(got) == set(data)
    for i, x in data.items():
        scores = [sum(x[k] == x[k - s] for k in range(s, len(x), 7)) for s in range(1, 33)]
        assert (got[i].len, got[i].scores) == (len(x), scores)
        best = max(range(1, 33), key=lambda k: scores[k - 1])
        assert got[i].stride == (best if len(x) >= 512 and best >= 2 and scores[best - 1] * 8 > (len(x) - 32) // 7 else 0)
    assert got[0].stride == 0 and all(got[i].stride and got[i].stride % 12 == 0 for i in (1, 2, 3)) and got[9].stride == 0
    got = {r.doc_id: r for r in __spark_entry__.queries()["document_samples"](spark, folder).collect()}
    assert set(got) == set(data)
    for i, x in data.items():
        size = min(24576, len(x))
        n = max(1, min(8, len(x) // max(size, 1)))
        own = b"".join(x[a : a + size] for a in (min(k * (len(x) // n), len(x) - size) for k in range(n)))
        assert (got[i].total, got[i].sampled, got[i].sample_id) == (len(x), len(own), hashlib.sha256(own).hexdigest()[:32])
    assert {g.sampled < g.total for g in got.values()} == {False, True}



def test_files_are_written_in_parts(spark, odd_documents):
    """Files to archive come as paths, so that none is a value in memory."""
    folder, texts = odd_documents
    rows, where = catalog._on_disk(spark, folder, 0)
    want = {f"src{k}/part.en": b"".join(t for i, t in sorted(texts.items()) if i % 3 == k) for k in range(3)}
    assert "content" not in rows.columns and {r.path: open(r.disk, "rb").read() for r in rows.collect()} == want
    assert len(os.listdir(where)) == 3


def test_damage_takes_no_memory_of_the_archive(spark, tmp_path):
    """Python's memory in the driver stays far below the archive's size, and no damaged copy is left."""
    r = random.Random(3)
    text = lambda i: "".join(r.choices("abcdefghijklmnop ", k=500_000))
    spark.createDataFrame([(i, text(i), f"src{i % 3}", "en") for i in range(16)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(catalog.local_folder(spark)))
    tracemalloc.start()
    found = catalog.damage_errors(spark, str(tmp_path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {k: e for k, (_, e) in catalog.DAMAGE.items()} | {"half of it": "Corrupt", "nothing": "BadMagic", "none": "none"}
    assert {r.damage: r.error for r in found.collect()} == want and peak < 16 * 500_000
    assert not [x for x in set(os.listdir(catalog.local_folder(spark))) - before if ".arc" in x]


def test_analysis_of_whole_documents(spark, odd_documents):
    import __spark_entry__

    folder, data = odd_documents
    got = {r.doc_id: r for r in __spark_entry__.queries()["document_analysis"](spark, folder).collect()}
    assert set(got) == set(data)
    for i, x in data.items():
        size, want = min(24576, len(x)), (0, False)
        if len(x) >= 8192:
            n = max(1, min(8, len(x) // size))
            own = b"".join(x[a : a + size] for a in (min(k * (len(x) // n), len(x) - size) for k in range(n)))
            plain, stride = len(zlib.compress(own, 6)), filters.likely_stride(own)
            better = stride and len(zlib.compress(filters.delta(own, stride, True), 6)) + plain * 2 // 100 < plain
            want = (0, True) if plain * 100 >= 98 * len(own) else (64 + stride if better else 0, False)
        assert (got[i].filter, got[i].incompressible) == want, i


def test_branch_filter_changes_blocks(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    got = catalog.WHOLE["branch_filter"](spark, SF).collect()
    con = duckdb.connect()
    n = con.execute(f"SELECT count(*) FROM '{SF}/embeddings.parquet'").fetchone()[0]
    assert sum(g.raw_len for g in got) == 64 * n and all(g.same for g in got) and sum(g.changed for g in got) > 100


def test_reports_on_a_written_archive(spark, tmp_path):
    """Two sources and two languages with copies in both; every figure is summed up again from the files and the index."""
    r = random.Random(17)
    words = [f"word{k}" for k in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(4000)), f"s{i % 2}", ("en", "de")[i // 2 % 2]) for i in range(12)]
    rows += [(20 + i, rows[i][1], "s1", "de") for i in range(4)] + [(30, "".join(chr(r.randrange(128)) for _ in range(90000)), "s0", "raw")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    files = {}
    for _, text, source, lang in sorted(rows):
        files[f"{source}/part.{lang}"] = files.get(f"{source}/part.{lang}", b"") + text.encode()
    unique = {c for x in files.values() for c in chunking.split(x)}
    s = catalog.WHOLE["written_summary"](spark, str(tmp_path)).first()
    total = sum(map(len, files.values()))
    assert (s.files, s.raw_bytes, s.deduped_bytes) == (len(files), total, total - sum(map(len, unique)))
    assert s.info_total_size == total and s.info_unique_size == sum(map(len, unique)) and s.info_archive_bytes == s.archive_bytes
    assert s.info_ratio == pytest.approx(total / s.archive_bytes) and s.archive_bytes == 16 + s.stored_bytes + s.metadata_bytes
    blocks = catalog.WHOLE["written_blocks"](spark, str(tmp_path)).collect()
    assert sum(b.raw_len for b in blocks) == sum(map(len, unique)) and sum(b.n_chunks for b in blocks) == len(unique)
    assert sum(b.comp_len for b in blocks) == s.stored_bytes and sum(b.stored for b in blocks) == s.stored_blocks and all(b.stored or b.comp_len < b.raw_len for b in blocks)
    packed = {a.path: a for a in catalog.WHOLE["written_attribution"](spark, str(tmp_path)).collect()}
    assert {p: a["size"] for p, a in packed.items()} == {p: len(x) for p, x in files.items()}
    assert s.stored_bytes - len(files) <= sum(a.packed for a in packed.values()) <= s.stored_bytes
    by_ext = {e.ext: e for e in catalog.WHOLE["written_extensions"](spark, str(tmp_path)).collect()}
    for ext in ("en", "de", "raw"):
        own = [a for p, a in packed.items() if p.endswith("." + ext)]
        assert (by_ext[ext].files, by_ext[ext].raw, by_ext[ext].packed) == (len(own), sum(a["size"] for a in own), sum(a.packed for a in own))


# Chunking


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(64, 256, 1024), (100, 900, 2000), (8192, 32768, 131072)]), st.booleans(), st.integers(0, 60000))
def test_cuts_equal_the_definition(seed, sizes, scaled, n):
    data = random.Random(seed).randbytes(n)
    want, at = [], 0
    while at < n:
        want.append(chunking.next_cut(data, at, sizes, scaled))
        at += want[-1]
    assert chunking.cuts(data, sizes, scaled) == want
    assert b"".join(chunking.split(data, sizes, scaled)) == data


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 2**32), st.floats(0, 1), st.binary(min_size=1, max_size=300), st.booleans())
def test_chunks_away_from_an_edit_stay(seed, place, put, replace):
    """Bytes put in or over others change chunks up to the next cut or two; all others are found again."""
    sizes = (512, 2048, 8192)
    data = random.Random(seed).randbytes(200_000)
    at = int(place * len(data))
    edited = data[:at] + put + data[at + len(put) * replace :]
    before, after = chunking.split(data, sizes, True), chunking.split(edited, sizes, True)
    kept = set(before)
    assert b"".join(after) == edited and sum(c not in kept for c in after) <= 12
    start = 0
    for c in before:  # those that end before the edit are the same, one by one
        if start + len(c) + sizes[2] > at:
            break
        assert c == after[before.index(c)]
        start += len(c)


def test_default_sizes_hold_and_average():
    data = random.Random(31).randbytes(3_000_000)
    found = chunking.cuts(data)
    least, average, most = 8 << 10, 32 << 10, 128 << 10
    assert sum(found) == len(data) and all(least <= n <= most for n in found[:-1]) and average / 2 < len(data) / len(found) < 2 * average
    for strict in range(2, 33):
        assert bin(chunking.mask(strict)).count("1") == strict
    assert chunking.masks(scaled=True) == chunking.masks()


def test_tables_of_constants():
    assert int(chunking.GEAR[0]) == 0xC0E16B163A85A4DC and int(chunking.GEAR[255]) == 0xFD4CBB1B3007D376
    assert hashing.xxh64(b"") == 0xEF46DB3751D8E999


def test_checksum_column_equals_the_function(spark):
    rows = [(i, random.Random(i).randbytes(n)) for i, n in enumerate((0, 1, 3, 4, 7, 8, 15, 31, 32, 33, 103, 1280))]
    got = spark.createDataFrame(rows, "i int, data binary").select("i", "data", hashing.checksum("data").alias("c"), hashing.content_id("data").alias("id")).collect()
    assert all(r.c == hashing.signed(hashing.xxh64(bytes(r.data))) and bytes(r.id) == hashlib.sha256(r.data).digest()[:16] for r in got)


# Filters


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300) | st.lists(st.sampled_from([0xE8, 0xE9, 0, 255, 7]), max_size=200).map(bytes), st.sampled_from([0, 1, 0x41, 0x44, 0x7F]), st.integers(0, 2**32))
def test_filters_are_undone(data, byte, base):
    assert filters.unapply(byte, filters.apply(byte, data, base), base) == data


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.lists(st.integers(5, 60), min_size=2, max_size=6), st.sampled_from([0xE8, 0xE9]))
def test_branches_to_one_place_become_alike(target, gaps, opcode):
    """Wherever they stand, branches to the same absolute place have the same operands after the filter."""
    data, places = bytearray(), []
    for gap in gaps:
        data += bytes(gap - 5)
        places.append(len(data))
        data += bytes([opcode]) + ((target - len(data) - 5) % 2**32).to_bytes(4, "little")
    out = filters.apply(1, bytes(data))
    assert {out[p + 1 : p + 5] for p in places} == {target.to_bytes(4, "little")}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 63), st.integers(0, 255), st.integers(70, 400))
def test_a_ramp_of_any_stride_becomes_flat(stride, step, n):
    ramp = bytes(k // stride * step % 256 for k in range(n))
    assert set(filters.apply(0x40 + stride, ramp)[stride:]) == {step}


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 30), st.integers(0, 2**32))
def test_records_show_their_width(width, seed):
    r = random.Random(seed)
    records = b"".join(bytes([k + 1 for k in range(width - 1)]) + r.randbytes(1) for _ in range(6000 // width))
    found = filters.likely_stride(records)
    assert found and found % width == 0 or found == width
    assert filters.likely_stride(r.randbytes(4000)) == 0 and filters.likely_stride(records[:300]) == 0


@settings(max_examples=10, deadline=None)
@given(st.integers(20, 700), st.integers(0, 2**32))
def test_code_is_told_by_its_branches(every, seed):
    r = random.Random(seed)
    plain = bytes(r.choice(b"the quick and other words\n") for _ in range(every - 5))
    code = (plain + b"\xe9" + r.randbytes(3) + r.choice([b"\0", b"\xff"])) * (60_000 // every)
    noise = r.randbytes(60_000)
    assert filters.looks_like_code(code) and not filters.looks_like_code(noise) and not filters.looks_like_code(plain * 90)
    assert filters.analyze(code) == (1, False) and filters.analyze(noise) == (0, True)
    assert filters.analyze(noise[:4000] * 9).incompressible is False and filters.analyze(noise[:5000]) == (0, False)


def test_unknown_filters_and_probes():
    known = {0, 1, *range(0x41, 0x80)}
    for byte in range(256):
        if byte in known:
            assert filters.stride_of(byte) == max(0, byte - 0x40)
        else:
            with pytest.raises(filters.Corrupt):
                filters.stride_of(byte)
    for n in (0, 100, 24 << 10, 100_000, 300_000):
        assert all(0 <= a <= n - min(n, filters.SLICE_BYTES) for a in filters.probe_starts(n))


def test_blocks_that_do_not_shrink_are_stored():
    noise = random.Random(3).randbytes(20_000)
    p = packing.pack(noise, 1, method=packing.ZLIB)
    assert p.method == 0 and p.data == noise and packing.unpack(p) == noise
    text = b"some text and more of it. " * 900
    for method in (packing.ZLIB, packing.LZMA, packing.ZSTD):
        q = packing.pack(text, 3, method=method)
        assert len(q.data) < len(text) and packing.unpack(q, 3) == text
        with pytest.raises(packing.Corrupt):
            packing.unpack(q._replace(raw_len=q.raw_len - 1), 3)
    with pytest.raises(packing.IntegrityFailure):
        packing.unpack(p._replace(checksum=1))
    forced = packing.pack(text, 3, filter_byte=0x41, effort=packing.ALWAYS, method=packing.ZLIB)
    assert forced.filter == 0x41 and packing.unpack(forced, 3) == text


# Placement


@pytest.mark.parametrize("size", [1, 40, 700, 10**6])
def test_blocks_of_ranges_equal_the_fold(spark, size):
    r = random.Random(size)
    lens = [r.randint(1, 60) for _ in range(700)]
    want, block, filled = [], 0, 0
    for n in lens:
        want.append(block)
        filled += n
        if filled >= size:
            block, filled = block + 1, 0
    rows = spark.createDataFrame(list(enumerate(lens)), "chunk_idx long, len long").repartition(5)
    got = layout.pack_blocks(rows, size).orderBy("chunk_idx").collect()
    assert [g.block_idx for g in got] == want
    assert layout.pack_blocks(rows.limit(0), size).count() == 0


@pytest.mark.parametrize("together", [2, 3])
def test_runs_of_ranges_equal_the_fold(spark, monkeypatch, together):
    """Chunks without bytes, ranges below and above a block, and runs of ranges."""
    monkeypatch.setattr(layout, "TOGETHER", together)
    r = random.Random(together)
    for size in (90, 2000):
        lens = [r.choice([0, 0, 1, 7, r.randint(1, 60)]) for _ in range(600)]
        rows = spark.createDataFrame(list(enumerate(lens)), "chunk_idx long, len long").repartition(3)
        got = layout.pack_blocks(rows, size).orderBy("chunk_idx").collect()
        assert [g.block_idx for g in got] == layout.greedy_blocks(np.array(lens), size).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=12), min_size=2, max_size=5), st.integers(1, 90))
def test_states_of_two_runs_are_those_of_one(parts, size):
    of = lambda x: layout.entry_states(np.array(x), size).assign(total=sum(x))
    found = of(parts[0])
    for p in parts[1:]:
        found = layout.follow(found, of(p), size)
    whole = of([x for p in parts for x in p])
    for filled in range(size):
        assert layout._next((0, filled), found, size) == layout._next((0, filled), whole, size)


def test_deltas_over_ranges(spark):
    values = [random.Random(3).randrange(10**6) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(6)
    got = layout.lag_deltas(rows, "i", "v", "d").orderBy("i").collect()
    assert [g.d for g in got] == [v - (values[k - 1] if k else 0) for k, v in enumerate(values)]


def test_global_order(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    rows = spark.createDataFrame([(v, 2) for v in values], "v long, n long")
    assert all(r.v == r.at for r in layout.global_rank(rows, [F.col("v")], "at").collect())
    assert all(r.total == 16 + 2 * r.v for r in layout.global_running_sum(rows, [F.col("v")], "n", "total", 16).collect())


def test_first_occurrences(spark):
    rows = spark.createDataFrame([(0, 0, "a", 3), (0, 1, "b", 4), (1, 0, "a", 3), (1, 1, "c", 5), (2, 0, "c", 5)], "entry_idx long, pos long, chunk_id string, len long")
    unique = dedup.number_unique(rows)
    assert [(r.chunk_idx, r.chunk_id) for r in unique.orderBy("chunk_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert {r.entry_idx: (r.chunks, r["size"]) for r in dedup.chunk_refs(rows, unique).collect()} == {0: ([0, 1], 7), 1: ([0, 2], 8), 2: ([2], 5)}
    stats = dedup.dedup_stats(rows, unique).first()
    assert (stats.raw_bytes, stats.unique_bytes, stats.deduplicated_bytes) == (20, 12, 8)
    refs = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 0, 5)], "entry_idx long, pos long, chunk_idx long")
    assert [r.charged for r in reports.first_reference(refs).orderBy("entry_idx", "pos").collect()] == [True, False, False]


# Paths and formats


def test_paths(spark):
    safe = ["a", "a/b", "a/b/c.txt", "weird name .tar.gz", "ünï/cödé"]
    bad = ["", "/etc/passwd", "../escape", "a/../../escape", "a/./b", "a//b", "C:/windows", "back\\slash", "nul\0", "x" * 4097]
    got = {r.p: r.u for r in spark.createDataFrame([(p,) for p in safe + bad], "p string").select("p", paths.is_unsafe("p").alias("u")).collect()}
    assert all(got[p] == paths.unsafe(p) == (p in bad) for p in safe + bad)
    norm = {"/usr/share/doc": "usr/share/doc", "./a/b": "a/b", "a/../b/c": "b/c"}
    assert all(r.n == norm[r.p] for r in spark.createDataFrame([(p,) for p in norm], "p string").select("p", paths.archive_path("p").alias("n")).collect())
    with pytest.raises(Exception, match="unsafe path"):
        spark.createDataFrame([("/",)], "p string").select(paths.archive_path("p")).collect()
    named = ["src", "src/main.rs", "src/deep/x", "a.txt", "srcfoo", "a.txt.bak", "other"]
    chosen = spark.createDataFrame([(p,) for p in named], "p string").filter(paths.selects("p", ["src", "a.txt"]))
    assert {r.p for r in chosen.collect()} == set(named[:4])
    exts = {"a.RS": ("rs", "rs"), "a.d/file": ("d/file", "(none)"), "x.13": ("13", "(none)"), "none": ("", "(none)"), "a.b.tar": ("tar", "tar"), "a.waytoolongext": ("waytoolongext", "(none)"), "dot.": ("", "(none)")}
    rows = spark.createDataFrame([(p,) for p in exts], "p string").select("p", paths.sort_extension("p").alias("s"), paths.report_extension("p").alias("r")).collect()
    assert {r.p: (r.s, r.r) for r in rows} == exts
    order = spark.createDataFrame([("b.txt", 0), ("z.rs", 0), ("dir", 1), ("a.txt", 0), ("a.rs", 0), ("l", 2)], "path string, kind int")
    assert [r.path for r in layout.solidity_order(order).orderBy("entry_idx").collect()] == ["dir", "a.rs", "z.rs", "a.txt", "b.txt", "l"]


def test_formats(spark):
    sizes = {0: "0 B", 999: "999 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 204800: "200 KiB", 3 << 20: "3.0 MiB", 2**63 - 1: "8.0 EiB", 1280: "1.2 KiB"}
    assert {r.n: r.t for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.format_bytes("n").alias("t")).collect()} == sizes
    times = {0.25: "250 ms", 3.25: "3.2 s", 125.0: "2 m 5 s"}
    assert {r.s: r.t for r in spark.createDataFrame([(s,) for s in times], "s double").select("s", formats.format_duration("s").alias("t")).collect()} == times
    given_ = {"4096": 4096, "64K": 65536, "16M": 16 << 20, "2G": 2 << 30, "8MB": 8 << 20, " 5 k ": 5120, "": None, "abc": None, "12Q": None, "99999999999999999999": None, "9999999999G": None}
    assert {r.s: r.n for r in spark.createDataFrame([(s,) for s in given_], "s string").select("s", formats.parse_size("s").alias("n")).collect()} == given_
    for text, n in given_.items():
        if n is not None:
            assert cli.parse_size(text) == n
    specs = {"auto": -1, "none": 0, "x86": 1, "delta:1": 0x41, "delta:63": 0x7F, "delta:64": None, "delta:0": None, "delta:x": None, "other": None}
    assert {r.s: r.n for r in spark.createDataFrame([(s,) for s in specs], "s string").select("s", formats.filter_of_name("s").alias("n")).collect()} == specs


# SQL functions, streams, command line


def test_registered_functions(spark):
    registry.register(spark)
    got = spark.sql("SELECT c.* FROM (SELECT encode(repeat('some text ', 2000), 'utf-8') AS d) t, LATERAL chunk(t.d, 512, 2048, 8192) c").collect()
    assert sum(r.len for r in got) == 20000 and [r.pos for r in got] == list(range(len(got)))
    assert spark.sql("SELECT analyze_bytes(encode(repeat('some text ', 2000), 'utf-8')).incompressible AS x").first().x is False


def test_stream_lets_content_through_once(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    os.mkdir(source)
    for i, data in enumerate((b"one" * 500, b"two" * 500, b"one" * 500)):
        with open(f"{source}/{i}", "wb") as f:
            f.write(data)
    for more in (None, b"two" * 500, b"three" * 500):
        if more:
            with open(f"{source}/{len(os.listdir(source))}", "wb") as f:
                f.write(more)
        streaming.ingest(spark, source, store, checkpoint).awaitTermination()
    assert sorted(bytes(r.data[:5]) for r in spark.read.parquet(store).collect()) == [b"oneon", b"three", b"twotw"]
    assert streaming.running_content_id([b"a", b"", b"bc"]) == hashing.content_id_of(b"abc")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda threads: spark)
    monkeypatch.chdir(tmp_path)
    os.makedirs("in/sub")
    for name, data in (("in/a.txt", b"text " * 300), ("in/sub/b.txt", b"text " * 300), ("in/c.log", b"log")):
        with open(name, "wb") as f:
            f.write(data)
    arc = str(tmp_path / "x.arc")
    assert cli.run(["c", arc, "in", "missing", "-kq", "-l", "1"]) == 0
    assert cli.run(["ls", arc]) == 0 and cli.run(["info", "-v", arc]) == 0 and cli.run(["t", arc]) == 0
    assert "in/sub/b.txt" in capsys.readouterr().out
    assert cli.run(["x", arc, "in/sub", "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/in/sub/b.txt").read_bytes() == b"text " * 300 and not (tmp_path / "out/in/a.txt").exists()
    with pytest.raises(FileExistsError):
        cli.run(["create", arc, "in"])
    assert cli.run(["compress", "in/a.txt", "-o", "a.q"]) == 0 and cli.run(["d", "a.q", "-o", "a.back"]) == 0
    with open("a.back", "rb") as f:
        assert f.read() == b"text " * 300
    with pytest.raises(FileExistsError):
        cli.run(["compress", "in/a.txt", "-o", "a.q"])
    assert cli.run(["bench", "in/a.txt"]) == 0 and "gzip" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.run(["create", "--filter", "delta:64", arc])
