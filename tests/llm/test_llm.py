"""The text operators against brute force, known answers and odd input."""

import gzip
import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sheetwise.llm import (  # noqa: E402
    archives,
    components,
    contamination,
    extraction,
    fm_index,
    lines,
    packing,
    passages,
    pseudonyms,
    quality,
    sharding,
    simhash,
    tokens,
)
from sheetwise.llm.registry import table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, repeated rows and ids, and columns named like results."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    line = "This line stands in several documents."
    rows = [
        (1, f"{line}\nfirst own line of text here", "en", 1.0),
        (2, f"  {line.upper()} \nsecond own line of text\n\n", None, 2.0),
        (3, f"{line}\n{line}\nthird", "en", None),
        (4, None, "en", 4.0),
        (5, "", None, None),
        (6, long, "de", 6.0),
        (6, "another text under the same id", "de", 6.0),
        (None, f"{line}\nno id here", "en", 7.0),
        (7, "twice the same row, word for word", "en", 7.0),
        (7, "twice the same row, word for word", "en", 7.0),
        (8, "   \t\n \x0b ", "en", 8.0),
        (9, "é ü 日本語 😀 naïve space", "fr", 9.0),
    ]
    clash = ", ".join(f"{c} string" for c in ("shard", "slot", "n_lines", "kept", "n_words", "items", "n_values", "fingerprint"))
    rows = [r + ("x",) * 8 for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, x double, {clash}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

WORDS = "[^\x20\x09-\x0d]+"


def documents(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# ---- sharding ----


@pytest.mark.parametrize("cell_rows", [10_000, 7])
def test_shards_are_exact_and_gapless(spark, sf, cell_rows):
    docs = table(spark, sf, "documents").repartition(5)
    got = sharding.shuffle_into_shards(docs, shards=7, cell_rows=cell_rows).collect()
    n = docs.count()
    assert len(got) == n == len({r["doc_id"] for r in got})
    for shard in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(n // 7 + (shard < n % 7)))


def test_matrix_rows_add_up_and_have_hypergeometric_means():
    blocks, cells, total = np.array([5, 0, 3, 4]), np.array([3, 3, 4, 2]), np.zeros((4, 4))
    for seed in range(2000):
        m = np.array([sharding.matrix_row(seed, blocks, cells, b) for b in range(4)])
        assert (m.sum(0) == cells).all() and (m.sum(1) == blocks).all()
        total += m
    assert np.abs(total / 2000 - np.outer(blocks, cells) / 12).max() < 0.1


def test_large_draws_agree_with_numpy(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 10)
    rng = np.random.default_rng(1)
    mine = [sharding._draw(rng, 300, 500, 100) for _ in range(5000)]
    theirs = rng.hypergeometric(300, 500, 100, 5000)
    assert abs(np.mean(mine) - theirs.mean()) < 0.3 and abs(np.var(mine) / theirs.var() - 1) < 0.15


def test_dealing_by_halves_has_the_same_means(monkeypatch):
    cells = np.array([4, 0, 6, 3, 0, 7, 2])
    rng = np.random.default_rng(2)
    for most in (3, 9, 15):
        monkeypatch.setattr(sharding, "NUMPY_MOST", most)
        for n in (0, 1, 11, 22):
            got = [sharding.deal(rng, cells, n) for _ in range(1500)]
            assert all(g.sum() == n and (g >= 0).all() and (g <= cells).all() for g in got)
            means = np.mean(got, axis=0)
            assert np.abs(means - n * cells / 22).max() < 0.15


def test_shard_digests_against_the_texts(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    for r in sharding.hypergeometric_shards(spark, sf).collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))


def test_shards_of_odd_rows(odd, none):
    got = sharding.shuffle_into_shards(odd, shards=3)
    assert got.count() == odd.count() and got.columns.count("shard") == 1
    assert sharding.shuffle_into_shards(none).count() == 0


# ---- lines ----


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(-(2**63) if d is None else d)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if gone.get(key(x), d) == d]
        out.append((d, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_of_odd_rows(odd, none):
    got = lines.dedup_lines(odd)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert found == brute_lines(rows)
    assert lines.dedup_lines(none).count() == 0


# ---- quality ----


def test_statistics_against_brute_force(spark, sf):
    rows = documents(spark, sf) + [(0, None), (0, ""), (0, "a b c d e a b c d e f"), (0, "# x\n# x\n \n")]
    for _, t in rows:
        words = re.findall(WORDS, t or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        kept = [x for x in (t or "").split("\n") if re.search(WORDS, x)]
        expected = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(kept) - len(set(kept)), len(inside)
        assert quality.statistics(t)[:5] == expected


def test_windows_are_found_with_many_kinds_of_words():
    ids = np.random.default_rng(0).integers(0, 3_000_000, 20_000)
    ids[15_000:15_010] = ids[10:20]
    assert quality.repeated_words(ids, 3_000_000) == 20


def test_forest_keeps_clean_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.apply_rules(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id")
    kept = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.05


def test_rules_on_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.apply_rules(odd, no_labels)
    assert got.count() == odd.count() and got.filter(F.col("kept") != ~F.col("base_failed")).count() == 0
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.apply_rules(none, labels).count() == 0


# ---- passages ----


def brute_passages(rows, window):
    low = lambda d: -(2**63) if d is None else d
    split = [(d, re.findall(WORDS, t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, low(d)), low(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < low(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("route_bodies, shard_words", [(10**6, 200_000), (3, 100)])
def test_passages_against_brute_force(spark, route_bodies, shard_words):
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(30)]

    def doc(i):
        base = list(common)
        if rng.random() < 0.5:
            base[rng.integers(30)] = f"z{i}"
        return " ".join([*(f"{'ab'[rng.integers(2)]}{rng.integers(3)}" for _ in range(rng.integers(60))), *base, *("xyz"[rng.integers(3)] for _ in range(rng.integers(40)))])

    rows = [(i, doc(i)) for i in range(120)] + [(200, None), (201, ""), (202, "a " * 500), (None, doc(3)), (5, doc(5)), (5, doc(5))]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 14, route_bodies, shard_words)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "text").collect()), key=str)
    assert found == brute_passages(rows, 14)


def test_passages_of_odd_rows(odd, none):
    got = passages.remove_repeats(odd, 5)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "text").collect()), key=str)
    assert found == brute_passages(rows, 5)
    assert passages.remove_repeats(none).count() == 0


def test_query_of_passages(spark, sf):
    rows = documents(spark, sf)
    got = sorted((tuple(r) for r in passages.substring_dedup(spark, sf).collect()), key=str)
    assert got == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_passages(rows, 50)), key=str)


def test_index_finds_smallest_owners():
    rng = np.random.default_rng(1)
    for _ in range(40):
        depth, kinds = int(rng.integers(1, 7)), int(rng.integers(1, 5))
        texts = [rng.integers(0, kinds, rng.integers(1, 25)) for _ in range(rng.integers(1, 12))]
        owners = rng.integers(0, 100, len(texts))
        index = fm_index.FmIndex(texts, owners, kinds, depth)
        patterns = texts + [rng.integers(0, kinds, rng.integers(1, 20)) for _ in range(4)]
        for p, got in zip(patterns, index.smallest_owners(patterns)):
            held = lambda t, w: any((t[j : j + depth] == w).all() for j in range(len(t) - depth + 1))
            stretches = [p[i : i + depth] for i in range(len(p) - depth + 1)]
            assert got.tolist() == [min([o for t, o in zip(texts, owners) if held(t, w)], default=fm_index.ABSENT) for w in stretches]


# ---- pseudonyms ----


def test_pseudonyms_keep_the_format(spark):
    text = "Call +1 (988) 555-2485, mail bo.b42@mail8.example.com, 70.123.182.155, card 4041 8949 7460 8795, born 1980-02-29 or 02/28/1981."
    rows = [(1, text), (2, "again 4041 8949 7460 8795 and bo.b42@mail8.example.com"), (3, None), (4, ""), (5, "no 999.1.1.1 nor 4041894974608796 nor 1980-02-31")]
    got = {r[0]: (r[1], r[2]) for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == (rows[4][1], 0)
    new, count = got[1]
    assert count == 6 and re.sub(r"\d", "9", re.sub(r"[a-z]", "a", new.split(",")[0])) == re.sub(r"\d", "9", re.sub(r"[a-z]", "a", text.split(",")[0]))
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
    mail = re.search(r"\S+@mail8.example.com", new)[0]
    assert card != "4041 8949 7460 8795" and card in got[2][0] and mail in got[2][0]
    digits = [int(c) for c in card if c.isdigit()]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(0, 146_097, 37).select(F.expr("cast(date_add(date'1800-01-01', cast(id as int)) as string)").alias("text"))
    done = pseudonyms.pseudonymise(days, "k").agg(F.count_distinct("text"), F.count("text"), F.min("text"), F.max("text")).first()
    assert done[0] == done[1] and done[2] >= "1800-01-01" and done[3] <= "2199-12-31"


def test_pseudonyms_of_odd_rows(odd, none):
    got = pseudonyms.pseudonymise(odd, "k")
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert got.columns.count("n_values") == 1 and pseudonyms.pseudonymise(none, "k").count() == 0


# ---- extraction ----


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a <b>b<br>c<p>d</p>e", "a b\nc\n\nd\n\ne"),
        ("<ul><li>one<li>two<ol><li>x<li value=5>y</ol></ul>after", "- one\n- two\n  1. x\n  5. y\n\nafter"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td rowspan=2>r<td>1<tr><td>2</table>t", "Name       Qty\napple pie  3\nr          1\n           2\n\nt"),
        ("<style>.h{display:none}</style><p class='z h'>no<p hidden>no<p>yes<span style='visibility:hidden'>no<i style='visibility:visible'>!", "yes!"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("a &lt;b&gt; &copy; 1 < 2 <!-- no --> <unclosed \"x <b>q</b>", "a <b> © 1 < 2 q"),
        ("<title>no</title>x<script>if (a<b) no()</script> y<pre>a\n  b</pre>", "x y\n\na\n  b"),
        ("<table><tr><td>o<table><tr><td>a<td>b</table><td>p</table>", "o     p\n\na  b"),
    ],
)
def test_rendering(page, text):
    from sheetwise.llm.render import render

    assert render(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>@media print {.nav{display:none}} @media (max-width:600px){.nav{display:none}}</style><p class=nav>yes", "yes"),
        ("<style>@supports not (display:grid){.n{display:none}} @charset 'x'; @media screen and (min-width:40em){.m{display:none}}</style><p class=n>yes<p class=m>no", "yes"),
        ("<style>@media (400px <= width <= 700px), print{p{display:none}} @font-face{x:y}</style><p>yes", "yes"),
        ("<style media=print>p{display:none}</style><noscript><style>p{display:none}</style></noscript><p>yes", "yes"),
        ("<style>.m{display:none}.m{display:block}</style><p class=m>yes", "yes"),
        ("<p class=m>yes</p><style>.m{display:none}</style><style>.m{display:block}</style>", "yes"),
        ("<style>.m{display:none}</style><p class=m style='display:block'>yes<p class=m>no", "yes"),
        ("<style>.m{display:none!important}#i{display:block}.m{display:block}</style><p class=m id=i style='display:block'>no<p>yes", "yes"),
        ("<style>#i{display:none}p{display:block}p.a.b{display:none}</style><p id=i>no<p class='b a'>no<p class=a>yes", "yes"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>no<b class=v>yes</b>no</div>", "yes"),
        ("<style>.s{display:block}</style><p hidden class=s>yes<p hidden>no", "yes"),
        ("a<svg><title>no</title><rect/><desc>no</desc>no<g><text x=1>one</text><text>two<tspan>!</tspan></text></g></svg> b", "a one two! b"),
        ("f <math><mi>x</mi> <mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>.", "f x= 1 2."),
        ("<svg><path d='M0'><p>yes", "yes"),
    ],
)
def test_rendering_of_styles_and_drawings(page, text):
    from sheetwise.llm.render import render

    assert render(page) == text


def test_rendering_of_deep_and_broken_pages():
    from sheetwise.llm.render import render

    assert render("<div>" * 50_000 + "deep").strip() == "deep"
    assert render("<ul><li>" * 3_000 + "deep").strip() == "deep"
    assert render("<table>" * 3_000 + "x") == "x"
    assert "x" in render("</td></table></li><li>x</ul></p>")


def test_extraction_keeps_rows(spark, sf):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None)], "page_id long, html string, text string")
    assert sorted(map(tuple, extraction.extract_text(pages).select("page_id", "text").collect())) == [(1, "a"), (1, "a"), (2, "")]
    assert extraction.layout_text(spark, sf).filter("n_chars > 0").count() == table(spark, sf, "pages").count()


# ---- near duplicates ----


def test_covering_masks_leave_no_pair_out():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & bits == 0 for m in masks)
        for m in masks[:3]:
            free = bits & ~m
            assert any((c & ~m) & free == 0 for c in simhash.finer(m, 3))


@pytest.mark.parametrize("bucket_rows", [2_048, 8])
def test_near_links_connect_what_is_near(spark, bucket_rows):
    rng = np.random.default_rng(0)
    values = set()
    for b in rng.integers(-(2**62), 2**62, 8).tolist():
        for _ in range(40):
            for k in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                b ^= 1 << k if rng.random() < 0.5 else 0
            values.add(simhash.signed(b & (2**64 - 1)))
    values = sorted(values)
    fp = np.array(values, np.int64)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3).tolist():
            a, b = find(v), find(values[i + 1 + j])
            root[max(a, b)] = min(a, b)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, bucket_rows)
    got = dict(map(tuple, components.components(links).collect()))
    assert all(got.get(v, v) == find(v) for v in values)


def test_fingerprints_against_brute_force(spark, sf):
    import xxhash

    got = {r[0]: r[1] for r in simhash.simhash_near_dedup(spark, sf).collect()}
    for d, t in documents(spark, sf):
        words = re.findall(WORDS, t.translate({c: c + 32 for c in range(65, 91)}))
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = np.zeros(64, int)
        for r in runs:
            h = xxhash.xxh64_intdigest(r.encode(), 42)
            counts += np.array([h >> b & 1 for b in range(64)])
        assert got[d] == f"{sum(1 << b for b in range(64) if counts[b] * 2 > len(runs)):016x}"


def test_near_duplicates_of_odd_rows(odd, none):
    classes = simhash.near_classes(odd).collect()
    assert len(classes) == odd.count()
    empty = {r["component"] for r in classes if r["id"] in (4, 5, 8)}
    assert empty == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["component"] for r in classes})
    assert simhash.near_classes(none).count() == 0 and simhash.keep_one(none).count() == 0


# ---- packing ----


def test_ids_equal_the_tokenizers():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = tokens.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", None, " a", "a ", "  ", "a  b", "a\n b", "x\x00 y", "hi<|endoftext|> you", "don't you'll  ", "é　 é", "end.\n", "1,234.5 ... --- 'sx", "日本語 😀 😀", "a\xa0 b", "a \x85b"]
    for t, got in zip(texts, encoder.encode(pa.array(texts))):
        assert got.tolist() == (plain.encode(t, add_special_tokens=False).ids if t else [])


def check_pieces(spark, docs, length, shard_bytes=24 << 20):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pieces_with_digests(packing.pack_documents(docs, length=length, shard_bytes=shard_bytes)).collect()
    wanted = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        wanted[d] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    assert Counter({d: sum(r["length"] for r in got if r["doc_id"] == d) for d in {r["doc_id"] for r in got}}) == wanted
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return got, plain


@pytest.mark.parametrize("shard_bytes", [24 << 20, 100_000])
def test_packing_round_trip(spark, sf, shard_bytes):
    docs = table(spark, sf, "documents")
    got, plain = check_pieces(spark, docs, 1024, shard_bytes)
    for d, t in docs.select("doc_id", "text").limit(40).collect():
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for r in got:
            if r["doc_id"] == d:
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)


def test_packing_of_odd_rows(spark, odd, none):
    check_pieces(spark, odd, 64)
    assert packing.pack_documents(none).count() == 0


def test_neighbours_share_words():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3, 9], [7, 8, 6], [1, 2, 3, 4], [7, 8, 5], [10, 11])]
    index = packing.Bm25(docs)
    assert index.neighbours(0, np.array([True, False, False, False, False]))[0] == 2
    assert index.neighbours(4, np.zeros(5, bool)) == []
    assert sorted(packing.chain(docs, 8, 8)) == [0, 1, 2, 3, 4]


def test_neighbours_by_all_terms():
    # document 1 shares forty terms with the seed, the next ones its twelve rarest alone
    docs = [np.arange(52), np.arange(12, 52), *(np.array([i, 900 + i]) for i in range(12)), np.arange(12, 32), np.arange(32, 52)]
    index = packing.Bm25([d.astype(np.uint32) for d in docs])
    assert index.neighbours(0, np.arange(len(docs)) == 0)[0] == 1


def brute_bm25(docs, seed, used, k1=1.2, b=0.75):
    """Scores of all documents for the terms of one, each term and document by itself."""
    mean = np.mean([len(d) for d in docs])
    out = []
    for i, d in enumerate(docs):
        score = 0.0
        for term in set(docs[seed].tolist()):
            held = sum(term in x for x in docs)
            tf = int((d == term).sum())
            if held > 1 and tf:
                score += np.log1p((len(docs) - held + 0.5) / (held + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        out.append(0.0 if used[i] else score)
    return np.array(out)


def test_neighbours_while_documents_are_used_up():
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.3, rng.integers(1, 60)).clip(0, 500).astype(np.uint16) for _ in range(150)]
    index, used = packing.Bm25(docs), np.zeros(150, bool)
    for seed in rng.permutation(150).tolist():
        used[seed] = True
        found, slow = index.neighbours(seed, used, most=10), brute_bm25(docs, seed, used)
        assert len(found) == min(10, int((slow > 0).sum())) and not used[found].any()
        assert np.allclose(slow[found], np.sort(slow)[::-1][: len(found)], rtol=1e-4)


def test_many_empty_and_repeated_rows_are_dealt_over_shards(spark):
    rows = [(i, None if i % 2 else "") for i in range(400)] + [(7, "one and the same row again and again")] * 400
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), length=64, shard_bytes=1_500).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in got}) == len(got) and sum(r["start"] == 0 for r in got) == 800
    shards = Counter(r["sequence_id"] >> 33 for r in got if r["doc_id"] == 7 and r["start"] == 0)
    assert len(shards) > 5 and max(shards.values()) < 150


def test_near_copies_meet_in_a_shard(spark):
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4_000)])
    texts = [" ".join(rng.choice(words, 80)) for _ in range(300)]
    docs = spark.createDataFrame([(1_000 * copy + i, t + f" {copy}") for i, t in enumerate(texts) for copy in (0, 1)], "doc_id long, text string")
    size = sum(2 * len(t) + 4 for t in texts)
    got = packing.pack_documents(docs, length=256, shard_bytes=size // 6).select("doc_id", "sequence_id").collect()
    shard = {r["doc_id"]: r["sequence_id"] >> 33 for r in got}
    assert len(shard) == 600 and len(set(shard.values())) >= 6
    assert sum(shard[i] == shard[1_000 + i] for i in range(300)) >= 240  # dealt by hash, about 50 met


def test_cells_fill_shards():
    assert packing.places_of({0: 4, 1: 4, 2: 4, 3: 25, 4: 1}, 10) == ([(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1)], 6)
    assert packing.places_of({0: 0}, 10) == ([(0, 0, 1)], 0) and packing.places_of({}, 10) == ([], 0)


# ---- decontamination ----


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    tests = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            tests.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else "null")
    sizes = {len(k) for k in tests}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if key := tests.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= key
        out.append((d, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_windows", [50_000, 5])
def test_contamination_against_brute_force(spark, odd, none, block_windows):
    items = [(1, "second own line of TEXT"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (3, None), (None, "日本語"), (5, "..."), (6, "the same row word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.find_contamination(odd, bench, block_windows=block_windows)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()), key=str)
    assert found == brute_contamination([tuple(r) for r in odd.select("doc_id", "text").collect()], items)
    assert contamination.drop_contaminated(odd, bench).columns == odd.columns
    assert contamination.find_contamination(none, bench).count() == 0
    assert contamination.find_contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


# ---- archives ----


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "u", "x" * 50), (1, "u v", "x" * 50), (2, None, None), (None, "v", "y"), (6, "a", ""), (7, "z", ""), (7, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    manifest = archives.write_archives(pages, folder, roll_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == 7 and manifest.count() > 3
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archives.read_archives(spark, folder).collect()), key=str)
    assert got == sorted([(1, "response", None, 50), (2, "response", None, 0), (3, "revisit", 1, 50), (6, "revisit", 2, 0), (7, "revisit", 2, 0), (7, "revisit", 2, 0), (None, "response", None, 1)], key=str)
    again = str(tmp_path / "again")
    archives.write_archives(pages, again, roll_bytes=300)
    for r in manifest.collect():
        data = (tmp_path / "warc" / r["file"]).read_bytes()
        assert data == (tmp_path / "again" / r["file"]).read_bytes() and hashlib.sha256(data).hexdigest() == r["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    archives.write_archives(pages, folder, min_payload=3)
    assert sorted((r["page_id"], r["refers_to"]) for r in archives.read_archives(spark, folder).collect()) == [(1, None), (2, None), (3, None), (4, 3)]


def test_archives_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives.write_archives(pages, str(tmp_path / "none"))
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0


# ---- pipeline ----


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    ruled = quality.apply_rules(docs, table(spark, sf, "labels")).collect()
    assert kept == {r["doc_id"] for r in ruled if r["kept"]}
    thin = stages["line dedup"](spark, good, sf).select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in thin) == sorted((d, t) for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in good.collect()]))
    thin = stages["line dedup"](spark, good, sf)
    one = {r["doc_id"] for r in stages["near dedup"](spark, thin, sf).collect()}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in thin.collect()}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert one == {find(d) for d in ids}
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    clean = {r["doc_id"] for r in stages["decontamination"](spark, thin, sf).collect()}
    assert clean == {d for d, _, _, _, hit in brute_contamination([(r["doc_id"], r["text"]) for r in thin.collect()], items) if not hit}


def test_pipeline_runs_through(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.count() > 0
