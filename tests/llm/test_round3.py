"""Filter interactions, VA-file clusters and the toxicity classifier against brute force and odd input."""

import base64
import hashlib
import itertools
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from sheetwise.llm import interactions, packing, tokens, toxicity, va_file  # noqa: E402
from sheetwise.llm.registry import table  # noqa: E402

WORDS = re.compile("[^\x20\x09-\x0d]+")
NO_ID = -(2**63)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and ids, columns named like results."""
    long = " ".join(f"Word{i}" for i in range(50_000))
    rows = [
        (1, "plain text", "en"),
        (2, "plain text", "en"),
        (2, "plain text", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, long, "de"),
        (None, "plain text", "en"),
        (None, "no id # here", None),
        (6, "UPPER CASE WORDS & SIGNS", "fr"),
        (7, " \t\n\x0b ", "fr"),
        (8, "é ü 日本語 😀 naïve", ""),
        (9, long, "en"),
    ]
    rows = [r + ("x",) * 6 for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, word string, kept string, score string, id string, failed string")


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (5, None, 1), (None, 1, 1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- filter interactions ----


def failed_set(text, d, least):
    words = WORDS.findall(text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if d > least else set())


def brute_audit(docs, labels):
    rows = [(NO_ID if d is None else d, t or "", part or "") for d, t, part in docs]
    least = {}
    for d, t, _ in rows:
        least[t] = min(least.get(t, d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    judged = [(part, failed_set(t, d, least[t]), d in good, d in toxic) for d, t, part in rows]
    out, total = {}, {}
    for part in {j[0] for j in judged}:
        some = [j for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = some
            for i, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                fails = sum(f in j[1] for j in some)
                alone = sum(j[1] == {f} for j in some)
                out[part, "".join(order), i + 1] = [len(left), len(gone), fails - len(gone), alone, sum(j[2] for j in gone), sum(j[3] for j in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(odd, marks):
    got = interactions.audit(odd, marks, interactions.FILTERS, "E").collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    assert found == brute_audit([tuple(r)[:3] for r in odd.collect()], [tuple(r) for r in marks.collect()])


def test_audit_of_empty_tables(odd, marks):
    assert interactions.audit(odd.limit(0), marks, interactions.FILTERS, "E").count() == 0
    no_labels = interactions.audit(odd, marks.limit(0), interactions.FILTERS, "E")
    assert no_labels.filter("good_lost + toxic_lost > 0").count() == 0 and no_labels.count() == 4 * 600


def test_audit_of_two_filters_and_no_repeats(odd, marks):
    two = {"short": interactions.FILTERS["A"], "signs": interactions.FILTERS["D"]}
    got = interactions.audit(odd, marks, two).filter("part = 'fr'").collect()
    assert {(r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in got} == {
        ("shortsigns", 1, 0, 2, 3), ("shortsigns", 2, 0, 0, 1), ("signsshort", 1, 1, 1, 1), ("signsshort", 2, 0, 1, 3),
    }


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 4099])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    expected = [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]
    assert interactions.positional_popcount(words).tolist() == expected


def test_many_parts_are_handed_on_in_time(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 1500 as string) as part", "cast(4294967295 as long) as word", "true as good", "id % 2 = 0 as toxic")
    got = interactions.subset_survivors(rows.repartition(2)).collect()
    assert len(got) == 1500 and all(r["survivors"][0] == 2 and len(r["survivors"]) == 96 for r in got)


# ---- clusters ----


def brute_clusters(rows, k=8, rounds=10):
    """``rows`` of (id, list of 64 whole numbers)."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    mid = [r[1] for r in sorted(rows, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(mid))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        mid = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(mid)]
    return sorted(((d, *near(v)[::-1]) for d, v in rows), key=str), mid


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance long")


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters_of_odd_vectors(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.3, 64).astype(np.float32)]) for i in range(60)]
    rows += [(5, [0.0] * 64), (5, [0.0] * 64), (None, [-1.5] * 64), (70, [1e30] + [0.0] * 63)]  # repeated, no id, beyond all bounds
    bad = [(80, None), (81, []), (82, [0.0] * 63), (83, [None] + [0.0] * 63), (84, [float("nan")] + [0.0] * 63), (85, [float("inf")] * 64)]
    done = va_file.cluster(vectors_of(spark, [r + ("x", 1) for r in rows + bad]).repartition(3), bits=bits)
    whole = [(d, [max(-va_file.LARGEST, min(va_file.LARGEST, int(np.floor(1024 * x)))) for x in v]) for d, v in rows]
    expected, mid = brute_clusters(whole)
    got = done.rows.collect()
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=str) == expected
    assert done.centroids.tolist() == mid
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for c in {r["cluster"] for r in got}:
        assert {r["cluster_inertia"] for r in got if r["cluster"] == c} == {sum(r["distance"] for r in got if r["cluster"] == c)}


def test_clusters_of_few_vectors_and_ties(spark):
    assert va_file.cluster(vectors_of(spark, [])).rows.count() == 0
    same = va_file.cluster(vectors_of(spark, [(i, [0.25] * 64, "x", 1) for i in range(5)]))
    assert {(r["cluster"], r["distance"]) for r in same.rows.collect()} == {(0, 0)} and len(same.centroids) == 5


def test_intervals_decide_only_what_is_sure_and_spare_most_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 128, (4000, 64)).astype(np.int64)
    centroids = np.array([vectors[i::8].mean(axis=0) for i in range(8)]).astype(np.int64) * 8
    cells = va_file.Cells.spread(vectors.min(0), vectors.max(0), vectors.mean(0), vectors.std(0), 8)
    best, open_ = va_file.nearest_by_cells(cells.code(vectors), cells.table(centroids))
    assert (best[~open_] == va_file.squared(vectors, centroids).argmin(axis=1)[~open_]).all()
    assert open_.mean() < 0.3


# ---- toxicity ----


def test_network_gradients_by_differences():
    """A step of training lowers the loss of its batch; responses equal plain loops."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.int32) for _ in range(64)]
    labels = np.array([float(7 in d) for d in docs])
    net = toxicity.train(docs, labels, min_docs=1)
    ids = net.ids(docs[0])
    padded = np.concatenate([ids, np.zeros(net.margin, np.int64)])
    plain = []
    for f in net.filters:
        x = net.vectors[padded]
        plain.append(np.max([sum(x[t + j] @ f[j] for j in range(len(f))) for t in range(len(ids))], axis=0))
    found = net.responses(net.projections()[padded], len(ids)).max(axis=0)
    assert np.allclose(np.concatenate(plain), found, atol=1e-4)
    z = net.logits(np.array([net.responses(net.projections()[np.append(net.ids(d), [0, 0])], len(d)).max(axis=0) for d in docs]))
    assert ((z > 0) == (labels == 1)).mean() > 0.95


def test_long_texts_score_as_one_piece(monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 3, 64, 65, 66, 67, 1000, 5000)] + [None]
    hashes = [np.concatenate([*toxicity.word_hashes(t), np.zeros(0, np.int32)]).astype(np.int32) for t in texts]
    net = toxicity.train(hashes, np.array([float("w3" in (t or "").split()) for t in texts]), min_docs=1)
    whole = toxicity.scores(net, net.projections(), texts)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity.word_hashes, "__defaults__", (64,))
    assert np.allclose(toxicity.scores(net, net.projections(), texts), whole, atol=1e-4)
    one = [toxicity.scores(net, net.projections(), [t])[0] for t in texts]
    assert np.allclose(one, whole, atol=1e-4)


def test_words_are_hashed_whatever_touches_them():
    a, b = (list(toxicity.word_hashes(t))[0].tolist() for t in ("IDIOT!! été,###", "idiot Été"))
    assert a == b == [zlib.crc32("idiot".encode()) % toxicity.BUCKETS, zlib.crc32("été".encode()) % toxicity.BUCKETS]


def test_scaling_and_cuts():
    at = np.linspace(-5, 5, 100)
    truth = 1 / (1 + np.exp(-(0.5 * at - 1)))
    a, b = toxicity.scaling(np.stack([1e5 * (1 - truth), 1e5 * truth]), at)
    assert abs(a - 0.5) < 0.01 and abs(b + 1) < 0.01
    assert toxicity.best_cut(np.array([[9, 1, 0, 0], [0, 0, 2, 5]])) == 2
    assert toxicity.best_cut(np.array([[9, 1], [0, 0]])) is None


def test_held_out_accuracy(spark):
    """Held-out labels of 10,000 documents; about a twentieth of the toxic ones are labelled at random."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.score_documents(docs, labels).filter("held_out")
    rows = scored.join(labels.withColumnRenamed("doc_id", "id"), "id").select("toxic", "score", "flagged").collect()
    for called in ([r["score"] >= 0.3 for r in rows], [r["flagged"] for r in rows]):
        hits = sum(c and r["toxic"] == 1 for c, r in zip(called, rows))
        assert hits / sum(called) > 0.9 and hits / sum(r["toxic"] == 1 for r in rows) > 0.85


def test_held_out_labels_are_not_learned(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    scores = [sorted(tuple(r) for r in toxicity.score_documents(docs, x, lang_col=c).select("id", "held_out", "score").collect()) for x, c in ((labels, "lang"), (turned, "source"))]
    assert scores[0] == scores[1]
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h, _ in scores[0])


def test_toxicity_of_odd_rows(spark, odd):
    toxic = [(i, "you idiot", "en") for i in range(100, 140)] + [(i, "kind words", None) for i in range(140, 180)]
    docs = odd.select("doc_id", "text", "lang", "score", "id").unionByName(
        spark.createDataFrame([t + ("x", "y") for t in toxic], "doc_id long, text string, lang string, score string, id string")
    )
    labels = spark.createDataFrame([(d, int(t == "you idiot")) for d, t, _ in toxic] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels, carry=("text",)).collect()
    assert len(got) == odd.count() + 80 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["text"]: r["score"] for r in got}
    assert by["you idiot"] > 0.5 > by["kind words"]
    assert len({r["score"] for r in got if r["text"] in (None, "", " \t\n\x0b ")}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and not any(r["flagged"] for r in none)
    one = toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()
    assert {r["score"] for r in one} == {1.0}


# ---- archives and pseudonyms ----


def test_archives_do_not_depend_on_the_placement_of_rows(spark, tmp_path):
    from sheetwise.llm import archives

    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 77, id * id * id) as page_id", "concat('u', id) as url", "repeat(md5(cast(id % 9000 as string)), int(id % 20)) as html")
    rows = rows.unionByName(rows.filter("page_id < 0 or page_id % 50 = 1").selectExpr("cast(null as long) as page_id", "url", "html"))
    seen = []
    for n in (5, 11):
        folder = str(tmp_path / f"warc{n}")
        manifest = archives.write_archives(rows.repartition(n, F.rand(n)), folder, part_bytes=1 << 20, roll_bytes=1 << 18)
        seen.append(sorted((r["file"], r["records"], r["sha256"]) for r in manifest.collect()))
    assert seen[0] == seen[1] and len({name.split("-")[1] for name, _, _ in seen[0]}) > 10
    assert max(n for _, n, _ in seen[0]) < 6_000  # the id of a third of all rows is divided
    assert sum(n for _, n, _ in seen[0]) == rows.count()


def test_parts_hold_what_they_should(spark):
    from sheetwise.llm import archives

    ids = [-(2**63), -5, 2**63 - 1] + [10**15 + i for i in range(400)] + [4] * 300
    narrow = spark.createDataFrame([(i, 10) for i in ids], "page long, weight long")
    begin, number, count = archives.page_parts(narrow, 100, bins=4)
    shifted = np.array([i + 2**63 for i in ids], np.uint64)
    ranges, sizes = np.unique(np.searchsorted(begin, shifted, side="right") - 1, return_counts=True)
    assert len(ranges) == len(begin) and all(s * 10 <= 100 * c for s, c in zip(sizes.tolist(), count.tolist()))
    assert number.tolist() == [0, *np.cumsum(count)[:-1].tolist()] and count.max() == 30


def test_round_trip_of_all_pages(spark):
    from sheetwise.llm import archives
    from sheetwise.llm.registry import table

    sf = "/root/testdata/sf0.001"
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in table(spark, sf, "pages").collect()]
    first = {}
    for page, payload in sorted(pages):
        first.setdefault(payload, page)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [(p, len(b), digest(b), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in pages]
    assert sorted(tuple(r) for r in archives.warc_round_trip(spark, sf).collect()) == sorted(want)


@pytest.mark.parametrize(
    "value",
    ["25/12/2024", "25-12-2024", "1/2/2024", "12-25-2024", "5.11.2024", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "123-45-6789", "555.123.4567", "555 123 4567", "GB82 WEST 1234 5698 7654 32"],
)
def test_pseudonyms_of_more_forms(spark, value):
    from sheetwise.llm.pseudonyms import pseudonymise

    docs = spark.createDataFrame([(1, f"a {value}, b"), (2, f"{value} and {value}")], "doc_id long, text string")
    one, two = [r["text"] for r in pseudonymise(docs, "k").orderBy("doc_id").collect()]
    new = one[2:-3]
    assert new != value and two == f"{new} and {new}" and one == f"a {new}, b"
    if not re.match(r"\d{1,2}[./-]", value):
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", value) or value[0] == "G"
    if value[0] in "DG":
        number = "".join(str(int(c, 36)) for c in new.replace(" ", "")[4:] + new[:4])
        assert int(number) % 97 == 1 and new[:2] == value[:2]


def test_invalid_values_stay(spark):
    from sheetwise.llm.pseudonyms import pseudonymise

    text = "31/02/2024 32-13-2024 666-45-6789 000-12-3456 123-00-4567 DE88370400440532013000 v1.2.2024.5"
    assert pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["n_values"] == 0


def test_late_days_and_national_numbers_are_permuted(spark):
    from sheetwise.llm.pseudonyms import LATE_DAYS, LATE_RADIX, pseudonymise

    days = spark.range(146_097).select(F.expr("date_add(date'1800-01-01', cast(id as int))").alias("day")).filter("day(day) > 12")
    assert days.count() == LATE_DAYS == LATE_RADIX[0] * LATE_RADIX[1]
    moved = pseudonymise(days.select(F.date_format("day", "dd/MM/yyyy").alias("text")), "k")
    found = moved.agg(F.count_distinct("text"), F.count_if(F.substring("text", 1, 2).cast("int") > 12), F.count_if(F.try_to_timestamp("text", F.lit("dd/MM/yyyy")).isNull())).first()
    assert tuple(found) == (LATE_DAYS, LATE_DAYS, 0)
    numbers = spark.range(20_000).selectExpr("format_string('%03d-%02d-%04d', 1 + id * 7 % 665, 1 + id % 99, 1 + id * 31 % 9999) as text").distinct()
    found = pseudonymise(numbers, "k").agg(F.count_distinct("text"), F.count("text"), F.count_if(F.col("text").rlike("^(?:000|666|9)|-00-|-0000$"))).first()
    assert found[0] == found[1] and found[2] == 0


def test_pseudonyms_against_a_plain_network(spark):
    """Digits of a telephone number, moved by ten rounds written out in Python."""
    from sheetwise.llm.pseudonyms import pseudonymise

    values, radix = [0] + [int(c) for c in "5551234567"], [1] + [10] * 10  # the sign stays
    for k in range(1, 11):
        half = len(values) // 2
        mine = range(half) if k % 2 == 0 else range(half, len(values))
        other = [v for i, v in enumerate(values) if i not in mine]
        said = f"k,phone,{k}," + ".".join(map(str, other))
        turned = list(values)
        for i in mine:
            turned[i] = (values[i] + int(hashlib.sha256(f"{said}#{i}".encode()).hexdigest()[:12], 16)) % radix[i]
        values = turned
    new = "".join(map(str, values[1:]))
    got = pseudonymise(spark.createDataFrame([("+5551234567",)], "text string"), "k").first()["text"]
    assert got == "+" + new


# ---- pages ----


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>.a .b{display:none}</style><div class=a><p><b class=b>no</b>yes</div><b class=b>too</b>", "yes\n\ntoo"),
        ("<style>ul>li.x{display:none}</style><ul><li class=x>no<li>yes</ul><ol><li class=x>1st</ol>", "- yes\n\n1. 1st"),
        ("<style>[aria-hidden=true]{display:none}</style><p aria-hidden=true>no<p aria-hidden=false>yes", "yes"),
        ("<style>p:not(.k){display:none}</style><p>no<p class=k>yes", "yes"),
        ("<style>p:not(.k, [data-x='a,b'] ) , x{display:none}</style><p>no<p class=k>yes<p data-x='a,b'>too", "yes\n\ntoo"),
        ("<style>a[href^='/ad'],a[href$=\".gif\" i],a[rel~=no],[lang|=de]{display:none}</style><a href=/ads>no</a><a href=x.GIF>no</a><a rel='a no'>no</a><i lang=de-AT>no</i><i lang=dex>yes</i>", "yes"),
        ("<style>div > p > b{display:none} div p b.s{display:inline}</style><div><p><b>no</b><b class=s>yes</b><i><b>too</b></i></div>", "yestoo"),
        ("<style>p:hover, p + p, p::before{display:none} ul > > li, > li{display:none}</style><p>yes<ul><li>too</ul>", "yes\n\n- too"),
        ("<style>#a#b{display:none}p.p{display:block}</style><p class=p>yes", "yes"),
        ("<form><input type=submit value=Send><input type=reset><input type=text value=no><input type=SUBMIT></form>", "SendResetSubmit"),
        ("a<plaintext><b>&amp;\n  x</plaintext>", "a\n\n<b>&amp;\n  x</plaintext>"),
    ],
)
def test_rendering_of_selectors_and_labels(page, text):
    from sheetwise.llm.render import render

    assert render(page) == text


def test_selectors_over_deep_pages():
    from sheetwise.llm.render import render

    rule = "<style>" + " ".join(["div"] * 40) + " b{display:none}</style>"
    assert render(rule + "<div>" * 39 + "<b>yes</b>") == "yes" and render(rule + "<div>" * 60 + "<b>no</b>") == ""


def test_layout_text_of_no_pages(spark):
    from sheetwise.llm import extraction

    none = spark.createDataFrame([], "page_id long, url string, html string, n_chars string")
    assert extraction.extract_text(none).count() == 0


# ---- passages and benchmarks ----


def test_first_smallest_places():
    from sheetwise.llm.passages import sliding_argmin

    x = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 7, 41):
        want = np.lib.stride_tricks.sliding_window_view(x, width).argmin(axis=1) + np.arange(len(x) - width + 1)
        assert sliding_argmin(x, width).tolist() == want.tolist()


def test_anchors_of_a_long_text_need_little_memory():
    import tracemalloc

    from sheetwise.llm.passages import runs_of

    hashes = np.random.default_rng(2).integers(0, 2**63, 400_000).astype(np.uint64)
    tracemalloc.start()
    runs_of(hashes, np.arange(len(hashes) - 49), 50, 20)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000 and tracemalloc.stop() is None


def test_many_blocks_of_a_benchmark(spark):
    """More blocks than a worker keeps give what one block gives, and the documents' texts are not written."""
    from sheetwise.llm import contamination
    from sheetwise.llm.registry import table

    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    # the documents themselves as a large benchmark
    more = bench.select(F.col("item_id").cast("string"), "text").unionByName(docs.filter("doc_id % 7 = 0").select(F.concat(F.lit("d"), "doc_id").alias("item_id"), "text"))
    windows = contamination.item_windows(more, 10, "item_id", "text").count()
    one = contamination.find_contamination(docs, more, block_windows=10**9)
    many = contamination.find_contamination(docs, more, block_windows=windows // 9)
    assert "ExistingRDD" not in many._jdf.queryExecution().toString()
    cols = ["doc_id", "n_words", "n_hit", "hit_spans", "items", "contaminated"]
    assert sorted(map(str, one.select(cols).collect())) == sorted(map(str, many.select(cols).collect()))
    assert one.filter("contaminated").count() > docs.count() // 7


# ---- packing ----


def odd_documents():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, n).clip(0, 60_000).astype("<u2") for n in rng.integers(1, 300, 200)]
    return [*docs, np.array([70_000, 3, 70_000], "<u4"), np.empty(0, "<u2"), docs[4].copy(), np.arange(3_000, dtype="<u2")]


@pytest.mark.parametrize("counted", [50, 2_000, 500_000])
def test_tokens_of_many_documents_are_counted_at_once(monkeypatch, counted):
    monkeypatch.setattr(packing, "COUNTED", counted)
    docs = odd_documents()
    found = list(packing._counted(docs))
    assert len(found) < len(docs) or counted == 50
    terms, counts, sizes = (np.concatenate(x) for x in zip(*found))
    wanted = [np.unique(d, return_counts=True) for d in docs]
    assert terms.tolist() == np.concatenate([t for t, _ in wanted]).tolist()
    assert counts.tolist() == np.concatenate([c for _, c in wanted]).tolist() and sizes.tolist() == [len(t) for t, _ in wanted]


def test_lookups_do_not_depend_on_how_postings_are_gathered(monkeypatch):
    docs, orders = odd_documents(), []
    for joined in (0, 32, 10**9):
        monkeypatch.setattr(packing, "JOINED", joined)
        orders.append(list(packing.chain(docs, 256, 256)))
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == list(range(len(docs)))
    index, used = packing.Bm25(docs), np.zeros(len(docs), bool)
    used[::3] = True
    near = index.neighbours(4, used.copy(), most=len(docs))
    lengths, sets = np.array([len(d) for d in docs], float), [dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)))) for d in docs]
    held = {}
    for s in sets:
        for t in s:
            held[t] = held.get(t, 0) + 1
    idf = {t: np.log1p((len(docs) - n + 0.5) / (n + 0.5)) for t, n in held.items()}
    norm = 1.2 * (0.25 + 0.75 * lengths / lengths.mean())
    score = np.array([sum(idf[t] * s[t] * 2.2 / (s[t] + norm[i]) for t in sets[4] if t in s and held[t] > 1) for i, s in enumerate(sets)])
    assert set(near) == {i for i in range(len(docs)) if score[i] > 0 and not used[i]}
    assert np.allclose(score[near], np.sort(score[near])[::-1], rtol=1e-4)


def test_distinct_pieces_are_encoded_to_numbers_at_once():
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoder = tokens.Encoder(*files)
    encoder.fast.encode_ordinary = lambda piece: pytest.fail(piece) if piece else []
    texts = [" a first word", " <|endoftext|", " Größe 中文 x9", " a first word word"]
    got = encoder.encode(pa.array(texts))
    assert [g.tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
