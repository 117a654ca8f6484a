"""Operators for training text against brute force, exact round trips and their defined cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, decontam, fm_index, frequent, html_main, langid, lattice_lm, ngram_join, pieces, pii, quality, spm, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, t string"
rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def edited(ws, n, seed):
    r = random.Random(seed)
    ws = list(ws)
    for _ in range(n):
        ws[r.randrange(len(ws))] = "zz" + str(r.randrange(1000))
    return ws


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), "r", "t") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(words(n, k)) for k, n in enumerate((60, 120, 300, 45, 80, 2000))]
    near = [" ".join(edited(words(300, 2), 4, k)) for k in range(6)]
    return [*base, base[0], base[0], *near, "one two", "one two", "", None, "  \n ", "x", "again " * 50, "a b c d e " * 30, base[1] + "\n" + base[4]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


# --- 3: quality rules


def repeat_words(ws):
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + d for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for d in range(3)}
    return len(covered)


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality_measures(docs, texts):
    got = {r.id: r for r in quality.ledger(docs).select("row.doc_id", "*").withColumnRenamed("doc_id", "id").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(ws), sum(map(len, ws)), repeat_words(ws)), i
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert bool(r.fail_bits & 1) == (len(ws) < 50)


def test_quality_filter_policy_and_ablation(docs, texts):
    led = quality.ledger(docs).cache()
    kept = led.where(quality.passes("v1")).count()
    out = quality.filtered(docs)
    assert out.columns == docs.columns and out.count() == kept > 0
    table = {r.rule: r for r in quality.ablation(led).collect()}
    bits = [r.fail_bits for r in led.collect()]
    mask = quality.POLICIES["v1"].mask
    for rule in quality.RULES:
        if rule.name in table:
            b = 1 << rule.bit
            assert table[rule.name].n_fail == sum(bool(x & b) for x in bits)
            assert table[rule.name].n_kept_without == sum(x & mask & ~b == 0 for x in bits)


def test_quality_of_very_long_texts_ties_and_clashing_names(spark):
    long = " ".join(words(60_000, 6)) + "\n" + "\n".join(["one line"] * 500)
    docs = frame(spark, [long, long, "a b c a b c"]).withColumnsRenamed({"lang": "n_words", "source": "_keep"})
    got = {r.i: r for r in quality.ledger(docs).select(F.col("row.doc_id").alias("i"), "*").collect()}
    ws = split(long)
    assert got[0][2:] == got[1][2:] and got[0].n_words == len(ws) and got[0].n_repeat_words == repeat_words(ws) and got[0].n_dup_lines == 499
    assert quality.filtered(docs).columns == docs.columns


def test_quality_of_nothing(spark):
    empty = frame(spark, [])
    assert quality.ledger(empty).count() == 0 and quality.filtered(empty).count() == 0


# --- 2: archives

PAGES = "page_id long, html string, url string, payload string"


def page_rows():
    big, other = "<p>" + "lorem ipsum " * 100 + "</p>", "<p>" + "dolor sit " * 150 + "é</p>"
    return [(1, big, "http://a/1"), (2, big, "http://a/2"), (3, other, None), (4, None, "http://a/4"), (5, "", "x\r\ny"), (6, "short", "u"), (7, "short", "u"), (8, big, "u"), (9, big * 200, "u"), (9, big * 200, "u"), (None, other, "u"), (None, "solo", "u")]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    got = warc.round_trip(pages, payload=True).collect()
    assert len(got) == len(rows)
    most = defaultdict(list)
    for i, h, _ in rows:
        if i is not None:
            most[h or ""].append(i)
    count = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = Counter()
    for i, h, _ in rows:
        data = (h or "").encode()
        top = max(most[h or ""], default=None)
        again = len(data) >= 1000 and top is not None and top != i
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
    assert count == want
    assert all(r.payload == (dict((i, h) for i, h, _ in rows)[r.page_id] or "").encode() for r in got if r.record_type == "response" and r.page_id not in (None,))


def test_archive_has_its_dictionary_first_and_a_frame_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in page_rows()], PAGES)
    manifest = warc.write_archives(warc.planned(pages), f"file://{tmp_path}/w", archive_bytes=2000, sample_bytes=1000).collect()
    assert sum(r.n_records for r in manifest) == len(page_rows()) and len(manifest) > 1
    path = manifest[0].file.removeprefix("file://")
    data = open(path, "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert data.count(b"\x28\xb5\x2f\xfd") >= manifest[0].n_records + 1
    records = list(warc.frames(open(path, "rb")))
    assert len(records) == manifest[0].n_records and all(x.startswith(b"WARC/1.1\r\n") for x in records)
    with pytest.raises(ValueError, match="cut off"):
        import io

        list(warc.frames(io.BytesIO(data[:-3])))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date"), (b"Content-Length: ", b"Content-Length: 1"), (b"ipsum", b"ipsux"), (b"\r\n\r\n", b"\r\n\r\nx")])
def test_broken_records_are_refused(change):
    payload = b"lorem ipsum"
    good = warc.record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")
    assert warc.parsed(good)["payload"] == payload
    with pytest.raises(ValueError):
        warc.parsed(good.replace(*change))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# --- 5: language


def test_language(spark):
    tongues = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    make = lambda letters, seed: " ".join("".join(random.Random(seed * 1000 + k).choice(letters) for _ in range(5)) for k in range(40))
    train = spark.createDataFrame([(make(x, k), lang) for lang, x in tongues.items() for k in range(20)] + [(None, "aa"), ("123", "bb"), ("lost", None)], "text string, lang string")
    learned = langid.learn(train)
    assert sorted(learned) == sorted(tongues)
    rows = [(k, make(x, 100 + k), lang) for lang, x in tongues.items() for k in range(10)] + [(90, None, ""), (91, "12 34!", ""), (92, "", ""), (92, " ".join(make("abcde", k) for k in range(200, 300)), "aa"), (None, make("abcde", 7), "aa")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, truth string"), learned).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.truth:
            assert r.lang_pred == r.truth and 0 < r.score <= 1, r.doc_id
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0), r.doc_id
    assert langid.predict(spark.createDataFrame(rows, "doc_id long, text string, truth string"), {}).where("lang_pred <> 'und'").count() == 0


def test_many_languages(spark, monkeypatch):
    tongue = lambda k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ao", "ie", "uy", "zw")]
    make = lambda k, seed: " ".join(random.Random(seed).choices(tongue(k), k=30))
    train = spark.createDataFrame([(make(k, 1000 * s + k), f"l{k}") for k in range(300) for s in range(3)], "text string, lang string")
    learned = langid.learn(train)
    assert len(learned) == 300
    few = langid.learn(train, max_chars=300 * 100)
    assert sorted(few) == sorted(learned) and max(map(len, few.values())) <= 100
    rows = spark.createDataFrame([(k, make(k, 9000 + k)) for k in range(0, 300, 10)], "doc_id long, text string")
    got = langid.predict(rows, learned).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in got)
    monkeypatch.setattr(langid, "LOADED", 1000)
    assert langid.predict(rows, learned).collect() == got


def test_languages_by_brute_force(spark):
    """Sample, dictionaries and sizes again without Spark; ties, nulls, very long texts, clashing names and an empty table."""
    import xxhash
    import zstandard

    make = lambda letters, n, seed: " ".join("".join(random.Random(seed * 999 + k).choice(letters) for _ in range(4)) for k in range(n))
    tongues = {"aa": "abcdeé", "bb": "vwxyzé", "cc": "klmnoé"}
    train = [(make(x, 5 + 40 * (k % 7), k), lang) for lang, x in tongues.items() for k in range(30)]
    train += [train[0], train[0], ("123", "aa"), (None, "bb"), ("lost", None), (train[40][0], "cc")]
    learned = langid.learn(spark.createDataFrame(train, "text string, lang string"), docs_per_lang=20, dict_chars=900)
    for lang in tongues:
        own = {t for t, x in train if x == lang and t and re.search("[^\\W\\d_]", t)}
        order = sorted(own, key=lambda t: xxhash.xxh64(t.encode(), 42).intdigest() - ((1 << 64) if xxhash.xxh64(t.encode(), 42).intdigest() >> 63 else 0))[:20]
        parts, size = [], 0
        for t in order:
            if size < 900:
                parts.append(t[: 900 - size].lower())
                size += len(t) + 1
        assert learned[lang] == "\n".join(parts).encode(), lang
    texts = [make(x, n, 70 + n) for x in tongues.values() for n in (1, 6, 60, 30_000)] + [make("abvwkl", 9, 3), "é", "a v k", "", None, "1 2"]
    rows = spark.createDataFrame([(k, t, "old", "old", "x") for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score string, row string")
    got = {r.doc_id: r for r in langid.predict(rows, learned).collect()}
    assert langid.predict(rows, learned).columns == ["doc_id", "text", "row", "lang_pred", "score", "confident"]
    for k, t in enumerate(texts):
        want = ("und", 0.0)
        if t and re.search("[^\\W\\d_]", t):
            sizes = []
            for lang, data in learned.items():
                raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes.append((len(zstandard.ZstdCompressor(dict_data=raw, compression_params=langid.settings()).compress(t.lower().encode())), lang))
            sizes.sort()
            want = sizes[0][1], 1 - sizes[0][0] / sizes[1][0]
        assert got[k].lang_pred == want[0] and math.isclose(got[k].score, want[1]) and got[k].confident == (want[1] >= 0.02), k
    empty = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert empty == {} and langid.predict(rows.limit(0), learned).count() == 0


# --- 6: near duplicates


def shingle_set(t):
    ws = split(t)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def links(texts):
    s = [shingle_set(t) for t in texts]
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    return [[j for j in range(len(s)) if j != i and near(s[i], s[j])] for i in range(len(s))]


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    want = links(texts)
    assert len(got) == len(texts)
    for i, near in enumerate(want):
        seen, todo = {i}, [i]
        while todo:
            for j in want[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].n_links == len(near), i
        assert got[i].class_id == min(seen), i
    sets = [shingle_set(t) for t in texts]
    for i, near in enumerate(want):
        same = [j for j in range(len(texts)) if sets[j] == sets[i]] if sets[i] else [i]
        others = {frozenset(sets[j]) for j in near} - {frozenset(sets[i])}
        assert (got[i].copy_of, got[i].n_copies, got[i].n_linked_texts) == (min(same), len(same), len(others)), i
    kept = {r.doc_id for r in ngram_join.deduplicated(docs).collect()}
    assert kept == {r.doc_id for r in got.values() if r.class_id == r.doc_id}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = [" ".join(edited(words(200, 1), k % 3, k)) for k in range(30)]
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: len(x) for i, x in enumerate(links(texts))}


def test_recall_of_near_copies(spark):
    """Every pair of texts at the threshold or above, found by exact Jaccard, is a link."""
    texts = []
    for k in range(60):
        base = words(80 + 5 * k, 500 + k)
        texts += [" ".join(edited(base, e, 1000 * k + e)) for e in range(1 + k % 5)]
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    want = links(texts)
    assert got == {i: len(x) for i, x in enumerate(want)} and sum(map(len, want)) > 60


def test_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "AT_ONCE", 16)
    base = words(60, 31)
    texts = [" ".join([*base, f"end{k}", *([f"more{j}" for j in range(k % 15)])]) for k in range(400)]
    want = {i: len(x) for i, x in enumerate(links(texts))}
    for block, size in ((4096, 32 << 20), (100, 32 << 20), (4096, 50_000)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
        assert {r.doc_id: r.n_links for r in ngram_join.near_duplicates(frame(spark, texts)).collect()} == want


def test_deduplication_of_repeated_ids_and_clashing_names(spark):
    t, u = " ".join(words(50, 9)), " ".join(words(50, 10))
    docs = frame(spark, [t, t, u, t, None, None], [4, 4, 4, 7, None, None]).withColumnsRenamed({"lang": "_gone", "source": "key", "row": "class_id"})
    out = ngram_join.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text or "") for r in out.collect()) == sorted([(4, t), (4, u), (-1, ""), (-1, "")])


def test_near_duplicates_of_very_long_texts(spark):
    long = words(60_000, 77)
    texts = [" ".join(long), " ".join(edited(long, 900, 1)), " ".join(words(60_000, 78))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0)} and links(texts)[0] == [1]


def test_near_duplicates_of_odd_rows(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    t = " ".join(words(50, 9))
    got = ngram_join.near_duplicates(frame(spark, [t, t, None, t], [4, 4, None, None])).collect()
    assert sorted((r.doc_id or -1, r.n_copies) for r in got) == [(-1, 1), (-1, 1), (4, 2), (4, 2)]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_of_one_id_with_two_texts(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    a, b = words(200, 71), words(200, 72)
    # the last text of id 4 is near to its first, which is no link
    texts = [" ".join(x) for x in (a, b, edited(a, 1, 1), edited(b, 1, 2), words(200, 73), edited(a, 1, 3))]
    got = ngram_join.near_duplicates(frame(spark, texts, [4, 4, 7, 8, 9, 4])).collect()
    want = [(4, 4, 3)] * 3 + [(7, 4, 2), (8, 4, 1), (9, 9, 0)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = ngram_join.least_matches(0.8, 1e-6)
    r = np.random.default_rng(1)
    lost = sum(any((r.random(ngram_join.HASHES) < 0.8)[:n].sum() < fewest[n] for n in range(16, 161, 16)) for _ in range(2000))
    assert lost == 0 and fewest[160] > 80


def test_components(spark):
    edges = [(k, k + 1) for k in range(10)] + [(20, 21), (22, 21), (30, 30), (40, 5)] + [(100, 101 + k) for k in range(50)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == dict.fromkeys([*range(11), 40], 0) | {20: 20, 21: 20, 22: 20}
    assert all(got[101 + k] == 100 for k in range(50))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: decontamination


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return min(row)


def free_edits(item, text):
    """Least edits of item to any passage."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_decontamination(spark):
    items = [words(n, 50 + n) for n in (16, 25, 40, 59, 5, 2)]
    texts, planted = [], []
    for k, item in enumerate(items[:4]):
        for e in (0, len(item) // 10, len(item) // 5):
            noisy = edited(item, e, k * 10 + e)
            texts.append(" ".join([*words(150, 900 + k * 10 + e), *[w.upper() + "!!" if i % 3 else w + "***" for i, w in enumerate(noisy)], *words(60, 300 + k + e)]))
    texts += [" ".join(words(400, 77)), "", None, " ".join(items[4]), " ".join(items[5]), " ".join(items[0][:8])]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "..."), (92, " ".join(items[0]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, texts), bench).collect()}
    for d, t in enumerate(texts):
        clean = [c for w in (t or "").encode().split() if (c := decontam.cleaned(w))]
        for i, item in enumerate([*items, None, None, items[0]]):
            if item is None:
                continue
            i = 92 if i == 8 else i
            least = free_edits(item, clean) if clean else 99
            if least <= int(0.2 * len(item) + 1e-9):
                assert got[(d, i)].edits == least, (d, i)
                r = got[(d, i)]
                assert edit_distance(item, [c for w in t.encode().split()[r.start_word : r.end_word] if (c := decontam.cleaned(w))]) <= least
            else:
                assert (d, i) not in got
    blocks = decontam.leaks(frame(spark, texts), bench, block_bytes=300)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(got)
    clash = frame(spark, texts).withColumn("doc", F.lit(1)).withColumn("item_id", F.lit("x"))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(clash, bench).collect()} == set(got)
    left = decontam.decontaminated(frame(spark, texts), bench)
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark, texts), bench.where("false")).count() == 0


def noisy(item, n, seed):
    """An item with n random word edits of all kinds."""
    r = random.Random(seed)
    out = list(item)
    for _ in range(n):
        k, what = r.randrange(len(out)), r.randrange(3)
        if what == 0:
            out[k] = "zz" + str(r.randrange(1000))
        elif what == 1:
            del out[k]
        else:
            out.insert(k, r.choice(VOCAB))
    return out


def recalled(sizes, share=0.2):
    """Of items planted with edits at the limit, those within it by brute force, and those of them that the search finds."""
    items = [words(n, 7000 + k) for k, n in enumerate(sizes)]
    bench = decontam.Benchmark([(k, " ".join(x)) for k, x in enumerate(items)], share)
    symbols, texts = decontam.Symbols(bench.vocabulary), []
    for k, item in enumerate(items):
        texts.append([*words(40, 8000 + k), *noisy(item, int(share * len(item) + 1e-9), k), *words(40, 9000 + k)])
    real = {k for k, (item, t) in enumerate(zip(items, texts, strict=True)) if free_edits(item, t) <= share * len(item) + 1e-9}
    hits = {(t, i) for t, i, *_ in bench.search([symbols.of(" ".join(t).encode()) for t in texts])}
    return real, {k for k in real if (k, k) in hits}


def test_recall_of_the_sampled_walks(monkeypatch):
    real, found = recalled([12 + k % 50 for k in range(400)])
    assert len(real) > 390 and len(found) >= 0.99 * len(real)
    real, found = recalled([5 + k % 7 for k in range(200)])
    assert len(real) > 190 and len(found) >= 0.95 * len(real)
    real, found = recalled([1 + k % 4 for k in range(40)])  # no edit allowed
    assert found == real and len(real) == 40
    # nothing but the sampled walks finds candidates
    monkeypatch.setattr(decontam, "REPEATS", 0)
    monkeypatch.setattr(decontam.Table, "candidates", lambda self, x, starts: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert not recalled([30] * 10)[1]


def test_sampled_walks_pass_few_other_windows():
    items = [words(30, 100 + k) for k in range(50)]
    bench = decontam.Benchmark([(k, " ".join(x)) for k, x in enumerate(items)], 0.2)
    x = decontam.Symbols(bench.vocabulary).of(" ".join(words(20_000, 5)).encode())
    x = np.concatenate([x, np.zeros(decontam.BETWEEN, np.int64)])
    seen = sum(len(t.candidates(x, np.flatnonzero(x))[0]) for t in bench.tables)
    assert seen < 0.01 * len(items) * 20_000 * len(bench.tables) / 50


def test_decontamination_of_a_very_long_text(spark):
    item = words(40, 60)
    text = [*words(150_000, 61), *noisy(item, 8, 1), *words(150_000, 62)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontam.leaks(frame(spark, [" ".join(text), " ".join(text[:1000])], [5, 5]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(5, 1)] and 149_950 < got[0].start_word < 150_050


# --- 7: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    odd = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.0255 1.2.3", "4111 1111 1111 1111 4111111111111112", "+1 (499) 555-6503 +12 +1.....2 +1234567890123456", "é😀 ü a.b@mail2.example.com!", "…@x.y", None, "", "@" * 1000, "a" * 50_000, "1" * 50_000, "1 " * 30_000, "+1-" * 5_000, "x.y@" * 3000 + "z.q", "%a@b.c%d@e.f@g.h"]
    r = random.Random(11)
    odd += ["".join(r.choice(letters) for _ in range(r.randint(5, 60))) for letters in ("0125.", "01 -4", "+1 .(9", "a@.b", "a1@.+- \n") for _ in range(60)]
    odd += ["10.0.0.1 0.0.0.0 00.256.1.1 100.20.255.9", "4532015112830366 and 6011-0009-9013-9424"]
    got = pii.personal(frame(spark, odd), carry=["doc_id"]).select("row.doc_id", pii.joined(F.col("base")).alias("base")).collect()
    assert {r.doc_id: r.base for r in got} == {i: ",".join(base_spans(t)) for i, t in enumerate(odd)}


def test_bootstrapped_identifiers(spark):
    known = [f"mailbox: user{k}@mail.example.org done" for k in range(12)]
    unseen = [f"please use mailbox: acct#77{k}x until monday" for k in range(5)]
    common = [f"the the the the {w} 123456{k} the the" for k, w in enumerate(words(30, 4))] + [f"the user{k}@x.org the the the the the" for k in range(5)]
    got = pii.personal(frame(spark, [*known, *unseen, *common, None]), carry=["doc_id"]).select("row.doc_id", "other").collect()
    found = {r.doc_id: [x.value for x in r.other] for r in got if r.other}
    assert found == {12 + k: [f"acct#77{k}x"] for k in range(5)}


def test_labels_and_words_after_are_patterns(spark):
    known = [f"email=user{k}@mail.example.org, badge 12" for k in range(6)] + [f"reach bob{k}@x.example.org anytime soon" for k in range(6)]
    unseen = ["see email=jane.doe(at)example.org now", "email: k.lee@localhost ok", "reach (at)home99x anytime soon", "mail email:ab12cd34 x"]
    got = pii.personal(frame(spark, [*known, *unseen]), carry=["doc_id"]).select("row.doc_id", "other").collect()
    text = dict(enumerate([*known, *unseen]))
    found = {r.doc_id: [text[r.doc_id][x.start : x.end] for x in r.other] for r in got if r.other}
    assert found[12] == ["jane.doe(at)example.org"] and found[14] == ["at)home99x"]
    assert 13 not in found and 15 not in found  # another label has no seeds


def brute_discovered(texts, rounds=3, min_support=3, accept=0.5):
    """Identifiers by the docstring's rules, with Python's regular expressions and dictionaries."""
    gap, letter = "[\\x20\\x09-\\x0D]", "[^\\W\\d_]"
    punct = re.compile(f"(?:(?!{letter})[^0-9\\x20\\x09-\\x0D])*")

    def tokens(t):
        out = []
        for m in re.finditer("[^\\x20\\x09-\\x0D]+", t):
            label = re.match(f"{letter}{{3,24}}[:=](?=.)", m[0], re.S)
            cut = m.start() + label.end() if label else m.start()
            out += [(m.start(), cut)] * bool(label) + [(cut, m.end())]
        return out

    totals, mentions = Counter(), []
    for d, t in enumerate(texts):
        t = t or ""
        own = tokens(t)
        totals.update(t[a:b].lower() for a, b in own)
        base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(t))]
        free = []
        for a, b in own:
            w = t[a:b]
            if re.search(f"[0-9]|{letter}@{letter}|\\(at\\)", w):
                core = [k for k, c in enumerate(w) if re.match(f"{letter}|[0-9]", c)]
                if core and core[-1] + 1 - core[0] >= 6:
                    free.append((a, b, a + core[0], a + core[-1] + 1))
        kept = [(a, b, x, y) for a, b, x, y in free if not any(p < y and x < q for p, q in base)]
        around = [(p, q, p, q, 1.0) for p, q in base] + [(*x, 0.0) for x in kept]
        for a, b, x, y, seed in around:
            before = [(p, q) for p, q in own if q < a + (a == 0) and q <= a and re.fullmatch(f"{gap}+{punct.pattern}", t[q:a])]
            glued = [(p, q) for p, q in own if t[q - 1] in ":=" and re.fullmatch(f"{letter}{{3,24}}[:=]", t[p:q]) and q <= a and punct.fullmatch(t[q:a])]
            after = [(p, q) for p, q in own if p >= b and re.fullmatch(f"{punct.pattern}{gap}+", t[b:p])]
            pats = {"<" + t[p:q].lower() for p, q in (before or glued)[:1]} | {">" + t[p:q].lower() for p, q in after[:1]}
            mentions.append((d, x, y, t[x:y].lower(), seed, pats))
    edges = Counter((p, m[3]) for m in mentions for p in m[5])
    seed = defaultdict(float)
    for m in mentions:
        if m[5]:
            seed[m[3]] = max(seed[m[3]], m[4])
    of = defaultdict(dict)
    for (p, v), n in edges.items():
        of[p][v] = n
    of = {p: vs for p, vs in of.items() if len(vs) >= min_support and sum(1 for v in vs if not seed[v]) > 0}
    known = {v: seed[v] for vs in of.values() for v in vs}
    for _ in range(rounds):
        score = {p: min(1.0, sum(n * known[v] for v, n in vs.items()) / totals[p[1:]]) for p, vs in of.items() if sum(known[v] >= accept for v in vs) >= min_support}
        known = {v: max(seed[v], 1 - math.prod(1 - min(score.get(p, 0.0), 0.999999) for p, vs in of.items() if v in vs)) for v in known}
    new = {v for v, x in known.items() if x >= accept and not seed[v]}
    return {(d, x, y) for d, x, y, v, sd, _ in mentions if not sd and v in new}


def test_discovered_spans_by_brute_force(spark):
    r = random.Random(9)
    labels = ["mail:", "tel", "id=", "user", "ref:", "acct"]
    ends = ["now", "please", "then", "until", "and"]
    make = [lambda: f"u{r.randrange(40)}@m{r.randrange(5)}.example.org", lambda: f"10.0.{r.randrange(9)}.{r.randrange(9)}", lambda: f"ab-{r.randrange(30)}-77x", lambda: f"key_{r.randrange(50)}99", lambda: f"jo{r.randrange(9)}(at)home.example", lambda: r.choice(VOCAB)]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(r.randint(1, 5)):
            label = r.choice(labels)
            what = r.choice(make[:2] if label in ("mail:", "tel") and r.random() < 0.6 else make)()
            parts.append(label + r.choice([" ", "", " (", ' "']) + what + r.choice(["", ".", ")", ","]) + " " + r.choice(ends))
        texts.append(" ".join(parts))
    got = pii.personal(frame(spark, texts), carry=["doc_id"]).select("row.doc_id", "other").collect()
    found = {(x.doc_id, y.start, y.end) for x in got for y in x.other}
    assert found == brute_discovered(texts) and len(found) > 20


def test_time_grows_with_a_text(spark):
    """Twice the text takes little more than twice the time, whatever it repeats."""
    import time

    shapes = {
        "numbered": lambda n: " ".join(f"w{k}x{k}" for k in range(n // 4)),
        "run": lambda n: "a" * n + " y q a@b.co",
        "emails": lambda n: "a@b.co " * (n // 8),
        "mixed": lambda n: "a@b.co x1y2z3 " * (n // 16),
    }
    pii.redacted(frame(spark, ["a@b.co 10.0.0.1"])).collect()
    for name, shape in shapes.items():
        took = []
        for n in (40_000, 160_000):
            began = time.perf_counter()
            out = pii.redacted(frame(spark, [shape(n)])).collect()
            took.append(time.perf_counter() - began)
            assert "@" not in out[0].text
        assert took[1] < 5 * took[0] + 10, (name, took)


def test_redaction_keeps_the_rest(spark):
    t = "see a@b.co, or 10.0.0.1 é +1 (499) 555-6503."
    out = pii.redacted(frame(spark, [t, None, "clean"]), length="n_chars").orderBy("doc_id").collect()
    assert out[0].text == "see [EMAIL], or [IP] é [PHONE]." and out[0].n_chars == len(out[0].text)
    assert out[1].text is None and out[2].text == "clean"
    assert pii.redacted(frame(spark, [])).count() == 0


# --- 8: main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies and more.</p></div>
<div class="ad">Buy this now.</div>%s<section class="comments"><p>First! What a fine article this is.</p></section>
<form><p>Search here please.</p></form><aside><p>Other things that you may like.</p></aside><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    article = "<article><h1>A  title &amp; more</h1><p><b>Bold\n start<br>of a text that is long enough. <p>Second &lt;one&gt; &eacute;.</article>"
    plain = "<div class='post-12'><p>Main words of some length are here.</p><div><p>More words of the main part follow.</p></div></div>"
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE % (article if k % 2 else plain), "c") for k in range(8)]
    rows += [(20, None, PAGE % article, "c"), (21, "http://h1.org/x", None, "c"), (22, "http://h1.org/y", "", "c"), (23, "http://h1.org/z", (PAGE % article)[:700], "c"), (24, "u", "just text", "c"), (25, "http://h9/", "<p>One line.<p>Two lines.", "c"), (None, "http://h1.org/q", PAGE % article, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").drop("text").withColumn("host", F.lit("clash"))
    want = {1: "A title & more\nBold start of a text that is long enough.\nSecond <one> é.", 0: "Main words of some length are here.\nMore words of the main part follow."}
    for most in (50_000, 0):
        got = {r.page_id: r for r in html_main.main_text(pages, keep=["page_id", "url"], max_broadcast=most).collect()}
        assert len(got) == len(rows)
        for k in range(8):
            assert got[k].text == want[k % 2]
        assert got[20].text == got[None].text == want[1] and got[1].n_chars == len(want[1])
        assert got[21].text == got[22].text == "" and got[24].text == "just text" and got[25].text == "One line.\nTwo lines."
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_split_articles(spark):
    """Title, lead and all parts stay when most of the text lies in sections or in wrapped paragraphs."""
    parts = [f"Part {k} of the text says a good deal. " + " ".join(words(60, k)) + "." for k in range(4)]
    head, lead = "A title of the whole text", "A lead in one sentence that stands before the parts."
    each = lambda tag, xs: "".join(f"<{tag}><p>{x}</p></{tag.split()[0]}>" for x in xs)
    links = "<div class='more'>" + "".join(f"<p><a href='/{k}'>Another text that may be read, number {k}</a></p>" for k in range(40)) + "</div>"
    shapes = {
        "sections": f"<article><h1>{head}</h1><p>{lead}</p>{each('section', parts)}</article>",
        "kinds": f"<article><header><h1>{head}</h1></header><div class='lead'><p>{lead}</p></div>{each('section class=a', parts[:1])}{each('section class=b', parts[1:])}</article>",
        "wrapped": f"<main><h1>{head}</h1><p>{lead}</p><div class='inner'>{each('div class=p', parts)}</div></main>",
        "content": f"<div class='page'><p>Words of the site that stand on all pages.</p><div class='post-7'><h1>{head}</h1><div class='lead'>{lead}</div>{each('div class=p', parts)}</div></div>",
        "plain": f"<div class='x'><h1>{head}</h1><p>{lead}</p>{each('div class=w-1/2', parts)}</div>{links}",
        "bare": f"<h1>{head}</h1><p>{lead}</p>{each('div class=p', parts)}",
        "beside": f"<h1>Words of a site</h1><main>{links}<article><h1>{head}</h1><p>{lead}</p>{each('section', parts)}</article></main>",
    }
    rows = [(k, f"http://{name}.org/{k}", PAGE % html) for name, html in shapes.items() for k in range(3)]
    # a page of its own without the host's path, and one without a host
    rows += [(9, "http://plain.org/9", PAGE % shapes["sections"]), (9, None, PAGE % shapes["sections"])]
    got = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == "\n".join([head, lead, *parts]), (r.url, r.text)


def test_main_text_reads_markup_as_it_is():
    read = lambda t: html_main.extracted(t, None)
    two = "".join(f"<section class={c}><p>Section {c} with some words in it.</p></section>" for c in "ab")
    assert read(f"<main>{two}</main>") == "Section a with some words in it.\nSection b with some words in it."
    inner = "<div class='section-header'><h2>A head</h2></div><p>A long paragraph of text is here.</p><p class='notice-period'>The notice period is long.</p>"
    assert read(f"<article>{inner}<div class='ad-slot-3'>Buy it.</div><div id=comments>First!</div></article>") == "A head\nA long paragraph of text is here.\nThe notice period is long."
    assert read("<article class=it's title='a>b'><p title=a\"b>A long paragraph, isn't it.</p><p data-x = \"</p>\">More \"of\" it.</p></article>") == "A long paragraph, isn't it.\nMore \"of\" it."
    assert read("<div class=share>only this</div>") == "" and read("<p>one</p><div class='x-share'>two</div>") == "one"


def test_main_text_beside_comments_and_within_forms():
    read = lambda t: html_main.extracted(t, None)
    text = "<h1>The title</h1><p>A paragraph that says what the page is about, at some length.</p>"
    kept = "The title\nA paragraph that says what the page is about, at some length."
    said = "<p>A reader has a long opinion on this, too, and says it here at a good deal more length than the text itself has.</p>"
    assert read(f"<main><article class='post'>{text}</article><ol class='commentlist'><li><article class='comment-body'>{said}</article></ol></main>") == kept
    assert read(f"<main><article class='post'>{text}</article><article class='comment even depth-1'>{said}</article></main>") == kept
    assert read(f"<article>{text}<div class=commentlist>{said}</div></article>") == kept
    assert read(f"<article class='no-comments'>{text}</article>") == read(f"<article class='post comments-open'>{text}</article>") == kept
    assert read(f"<body><form id=all><div class='content'>{text}</div></form></body>") == kept
    assert read(f"<body><a href=#x>Skip</a><form><main>{text}</main></form><form><p>Your name, and your address.</p></form></body>") == kept
    assert read(f"<article>{text}</article><form><h2>Write to us</h2><p>Your name, and your address.</p></form>") == kept
    assert read("<div class='banner'><p>The only words that this page has are here.</p></div>") == "The only words that this page has are here."
    assert read("<form><p>A page that is one form has this sentence.</p></form>") == "A page that is one form has this sentence."
    assert read("<div class='cookie-notice'><p>We use cookies on all of our pages.</p></div>") == ""
    assert read("<article><p>As long as <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, all is well.</p></article>") == "As long as x=1 holds, all is well."
    started = time.monotonic()
    assert read("<form class=a>" * 50_000 + text).count("\n") == 1 and time.monotonic() - started < 20


def test_main_text_of_deep_and_long_pages():
    deep = "<div class=a>" * 100_000 + "<p>Some text that is deep down in here.</p>" + "</div>" * 100_000 + "</b>" * 1000
    assert html_main.extracted(deep, None) == "Some text that is deep down in here."
    long = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(20_000)) + "</article>"
    assert html_main.extracted(long, None).count("\n") == 19_999


def test_host_paths_by_brute_force(spark):
    r = random.Random(3)
    say = lambda k: " ".join(words(k, r.randrange(10**6))) + "."
    rows = []
    for k in range(60):
        host = k % 3
        body = [f"<div class='c{r.choice('xyz')}'>{''.join(f'<p>{say(r.randint(3, 30))}</p>' for _ in range(r.randint(1, 4)))}</div>" for _ in range(r.randint(1, 4))]
        if r.random() < 0.7:
            body.append(f"<div class='post'><h1>{say(4)}</h1><p>{say(50)}</p><div class=q><p>{say(30)}</p></div></div>")
        rows.append((k, f"http://h{host}.org/{k}", "<body>" + "".join(body) + "</body>"))
    rows += [rows[0], (70, "http://h0.org/t", rows[0][2])]  # repeated rows and ties
    points, sums, around, kinds = defaultdict(Counter), defaultdict(dict), defaultdict(dict), {}
    for _, url, text in rows:
        host, page = url[7:13], html_main.read(text)
        own, chars = html_main.scores(page), sum(map(len, page.texts))
        for p, x in html_main.totals(page).items():
            points[host][p] += round(own.get(p, 0.0) / sum(own.values()) * 1e6)
            kinds[p] = x[0]
            sums[host][p] = [a + round(b / chars * 1e6) for a, b in zip(sums[host].get(p, [0] * 4), x[1:], strict=True)]
        around[host].update(html_main.surroundings(page))
    chosen = {}
    for host, own in points.items():
        best = max((x, p) for p, x in own.items())[1]
        chosen[host] = html_main.widened([(p, (kinds[p], *sums[host][p])) for p in around[host][best]])
    got = Counter((r.page_id, r.text) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter((i, html_main.extracted(text, chosen[url[7:13]])) for i, url, text in rows)


def test_main_text_replaces_columns_of_its_names(spark):
    rows = [(1, "http://a.org/1", "<article><p>Some words that are long enough.</p></article>", "old", "old", "old")]
    out = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string, path string"))
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "path", "text", "url"]
    assert out.select("text", "path").collect() == [("Some words that are long enough.", "old")]


# --- 9: repeated passages


def without_repeats(rows, window=20):
    first, ws = {}, {i: split(t) for i, t in rows}
    for i in sorted(ws):
        for k in range(len(ws[i]) - window + 1):
            first.setdefault(tuple(ws[i][k : k + window]), (i, k))
    out = {}
    for i, w in ws.items():
        gone = {k + d for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] != (i, k) for d in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("hot", "block"), [(60_000, 200_000), (60, 200_000), (60, 300), (60_000, 100)])
def test_repeated_passages(spark, texts, monkeypatch, hot, block):
    monkeypatch.setattr(substring, "HOT_WORDS", hot)
    monkeypatch.setattr(substring, "BLOCK_WORDS", block)
    shared = words(50, 1234)
    more = [" ".join([*words(30, 60 + k), *shared, *words(25, 160 + k)]) for k in range(20)]
    every = [*texts, *more, " ".join(words(7, 1) * 9), "a " * 200, " ".join(words(19, 3))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(frame(spark, every)).collect()}
    assert got == without_repeats(list(enumerate(every)))


def test_a_hot_minimizer_keeps_its_index(spark, monkeypatch):
    """Many different segments around one frequent phrase: cut by longer grams, most of them still meet others in a shard."""
    monkeypatch.setattr(substring, "HOT_WORDS", 1_000)
    phrase, around = words(13, 77), [words(24, 300 + k) for k in range(40)]
    every = [" ".join([*around[k % 40], *phrase, *around[(k + k // 40 * 11) % 40], *words(5, k)]) for k in range(240)]
    seen = []
    marked, by_context = substring._marked, substring._by_context
    monkeypatch.setattr(substring, "_marked", lambda *a: seen.append("hot") or marked(*a))
    monkeypatch.setattr(substring, "_by_context", lambda rows, w: seen.append(by_context(rows, w)) or seen[-1])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(frame(spark, every)).collect()}
    assert got == without_repeats(list(enumerate(every)))
    rows = [r for r in seen[-1].collect() if r.words is not None]
    together = Counter(r.key for r in rows)
    assert seen[0] == "hot" and sum(n for n in together.values() if n > 1) > len(rows) / 2
    sizes = Counter()
    for key, w in {(r.key, bytes(r.words)) for r in rows}:
        sizes[key] += len(w) // 8
    assert max(sizes.values()) <= 1_000


def test_repeated_passages_of_odd_rows(spark):
    t = " ".join(words(40, 8))
    got = substring.without_repeats(frame(spark, [t, t, t], [3, 3, None])).collect()
    assert len(got) == 3 and all(r.n_removed == 0 for r in got)
    assert substring.without_repeats(frame(spark, [])).count() == 0


def test_fm_index_finds_first_places():
    r = random.Random(2)
    segments = [np.array([r.randint(1, 4) for _ in range(r.randint(3, 30))]) for _ in range(40)]
    index = fm_index.FMIndex(segments, 4, 5)
    text = np.concatenate([np.append(s, 0) for s in segments]).tolist()
    queries = [*segments, np.array([r.randint(1, 6) for _ in range(50)])]
    for q, found in zip(queries, index.matches(queries), strict=True):
        for k in range(len(q) - 4):
            places = [p for p in range(len(text) - 4) if text[p : p + 5] == q[k : k + 5].tolist()]
            assert found[k] == (places[0] if places else -1)


# --- 4: lattice likelihood


def small_model(tmp):
    ids = {p: (300 + k, -float(k)) for k, p in enumerate(["▁", "a", "b", "c", "d", "e", "f", "g", "h", "▁a", "ab", "abc", "de", "▁de", "gh", "fgh", "bc"])}
    return pieces.Pieces(ids, list(range(3, 259)), -100.0)


def test_lattice_sums_all_segmentations():
    model = small_model(None)
    names, p, b = lattice_lm.prior(model)
    lattice = pieces.Lattice(names, np.log(p), np.log(b))
    weight = dict(zip(names, p, strict=True))

    def total(w):
        if not w:
            return 1.0
        head = sum(weight[w[:k]] * total(w[k:]) for k in range(1, min(len(w), 3) + 1) if w[:k] in weight)
        return head if w[0] in weight else math.prod(b[x] for x in w[0].encode()) * total(w[1:])

    some = ["▁abcde", "▁dé", "▁", "▁fghabc", "▁xyz"]
    assert np.allclose(np.exp(lattice.log_probability(some)), [total(w) for w in some], rtol=1e-9)
    counts, code = lattice.expected(["▁abc"], np.array([2.0]))
    ways = {("▁", "a", "b", "c"), ("▁a", "b", "c"), ("▁", "ab", "c"), ("▁", "abc"), ("▁", "a", "bc"), ("▁a", "bc")}
    share = {w: math.prod(weight[x] for x in w) for w in ways}
    for x in ("ab", "▁a", "bc", "c"):
        assert math.isclose(counts[names.index(x)], 2 * sum(s * w.count(x) for w, s in share.items()) / sum(share.values()))
    assert code.sum() == 0


@pytest.mark.parametrize("held_table", [200_000, 10])
def test_scores(spark, docs, texts, monkeypatch, held_table):
    monkeypatch.setattr(lattice_lm, "FREQUENT", held_table)
    got = {r.doc_id: r for r in lattice_lm.scored(docs, F.col("doc_id") % 4 == 2, keep=["doc_id"]).collect()}
    tokens = {i: [*split((t or "").lower()), None] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if i % 4 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    model = pieces.load()
    n_docs = sum(i % 4 != 2 for i in range(len(texts)))
    train = {w: k for w, k in c.items() if w}
    names, p, b = lattice_lm.prior(model)
    e, code = pieces.Lattice(names, np.log(p), np.log(b)).expected(["▁" + w for w in train], np.array(list(train.values()), float))
    sums = np.concatenate([e, code]) + lattice_lm.PRIOR * np.concatenate([p, b])
    logs, whole = np.log(sums / (sums.sum() + n_docs + 1)), sums.sum() + n_docs + 1
    lattice = pieces.Lattice(names, logs[: len(names)], logs[len(names) :])
    for i, ws in tokens.items():
        want = (lattice.log_probability(["▁" + w for w in ws[:-1]]).sum() if ws[:-1] else 0.0) + math.log((n_docs + 1) / whole)
        assert math.isclose(got[i].score, want / math.log(10), rel_tol=1e-9), i


def test_scores_of_very_long_texts_and_clashing_names(spark):
    texts = [" ".join(words(50_000, 3)) + " " + "x" * 3000, "a b", None]
    docs = frame(spark, texts).withColumn("score", F.lit("old")).withColumn("rid", F.lit("r")).withColumn("word", F.lit("w"))
    out = lattice_lm.scored(docs, F.lit(False))
    assert len(set(out.columns)) == len(out.columns) and {"rid", "word", "score", "t"} <= set(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].n_tokens == 50_002 and got[0].score < got[1].score < 0 and got[2].n_tokens == 1 and got[0].rid == "r"


def test_scores_of_nothing(spark):
    assert lattice_lm.scored(frame(spark, []), F.lit(False)).count() == 0
    assert lattice_lm.scored(frame(spark, ["a b", None]), F.lit(True), keep=["doc_id"]).where("n_known = 0").count() == 2


# --- 10: pieces


def test_best_paths_agree_with_the_library_and_the_fallback(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = pieces.load()
    read = proto.ModelProto()
    read.ParseFromString(open(pieces.DEFAULT_MODEL, "rb").read())
    read.trainer_spec.model_type = 1  # the same table read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=read.SerializeToString())
    some = sorted({*VOCAB[:150], "Hello", "international", "thehethe", "naïve", "日本", "x\ty", "🙂a"})
    units = spark.createDataFrame([("▁" + w,) for w in some], "unit string")
    got = {r.unit: np.frombuffer(r.ids, model.code).tolist() for r in spm.best_paths(spm.lattice(units, model), model).collect()}
    assert got == {"▁" + w: model.best("▁" + w) for w in some}
    for w in some:
        if all(c in model.ids for c in w):
            # the library adds up in single precision and may settle for less
            total = lambda path: sum(score for i, score in model.ids.values() for _ in range(path.count(i)))
            assert total(got["▁" + w]) >= total(library.encode(w)), w
    worst = lambda u: max(([0.0] if not u else [model.ids[u[:k]][1] + worst(u[k:]) for k in range(1, len(u) + 1) if u[:k] in model.ids]), default=-math.inf)
    for w in VOCAB[:60]:
        assert math.isclose(sum(score for i, score in model.ids.values() for _ in range(model.best("▁" + w).count(i))), worst("▁" + w))


@pytest.mark.parametrize("size", [16, spm.WINDOW])
def test_long_units_by_windows(spark, size):
    model = pieces.load()
    some = ["e" * 300, "the" * 100, "international" * 40 + "日本🙂" * 30, "x\tyz" * 99, *("thehe"[k:] + "acgtin" * 60 for k in range(4)), "a" * size, "ab" * size]
    long = spark.createDataFrame([(k % 3, u) for k, u in enumerate(some * 2)], "block long, unit string")
    parts = spm.windows(long, model, size)
    assert max(len(r.unit) for r in parts.collect()) <= size + model.longest - 1
    got = {r.key: np.frombuffer(r.ids, model.code).tolist() for r in spm.best_long_paths(spm.lattice(parts, model), model.longest, size).collect()}
    assert got == {hashlib.sha256(u.encode()).hexdigest(): model.best(u) for u in some}


def test_time_grows_with_a_unit(spark):
    model, took = pieces.load(), {}
    for n in (300, 20_000, 80_000):  # the first one warms up
        long, since = spark.createDataFrame([(0, "e" * n)], "block long, unit string"), time.monotonic()
        (row,) = spm.best_long_paths(spm.lattice(spm.windows(long, model), model), model.longest).collect()
        took[n] = time.monotonic() - since
        assert np.frombuffer(row.ids, model.code).tolist() == model.best("e" * n)
    assert took[80_000] < 8 * took[20_000] + 2  # 16 times, if it grew with the square


def whole_units(t):
    """A text between the marks that stand for its spaces."""
    return re.findall("▁[^▁]*", "▁" + t.replace(" ", "▁")) if t else []


@pytest.mark.parametrize(("rows", "remembered"), [(4096, 400_000), (3, 2)])
def test_encoding_round_trip(spark, texts, monkeypatch, tmp_path, rows, remembered):
    monkeypatch.setattr(spm, "ROWS", rows)
    monkeypatch.setattr(spm, "AT_ONCE", remembered)
    monkeypatch.setattr(spm, "COLLECTED", remembered)
    monkeypatch.setattr(spm, "CHARS", remembered * 10)
    every = [*texts, " lead", "two  spaces ", "tab\tline\n\nend\n", "é日本🙂", "x" * 5000, "acgt" * 1500, "a▁b", " "]
    docs = frame(spark, every)
    model = pieces.load()
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    for source in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        coded = spm.encode(source, checked=True)
        out = coded.collect()
        assert len(out) == len(every)
        for r in out:
            if r.text is None:
                assert r.ids is None and r.intact is None
            else:
                # a unit is best cut as a whole, so the cuts within it lose nothing
                assert r.intact and r.ids == [k for u in whole_units(r.text) for k in model.best(u)]
        assert Counter(r.text for r in spm.decode(coded).collect()) == Counter(t and t.replace(pieces.MARK, " ") for t in every)
    assert spm.encode(frame(spark, [])).count() == 0


def test_encoding_replaces_columns_of_its_names(spark):
    docs = frame(spark, ["one two", None]).withColumn("ids", F.lit("old")).withColumn("intact", F.lit("old"))
    out = spm.encode(docs, checked=True)
    assert sorted(out.columns) == sorted(docs.columns) and [r.intact for r in out.orderBy("doc_id").collect()] == [True, None]
    assert spm.encode(docs).select("intact").distinct().collect() == [("old",)]


def test_frequent_words_stay_within_their_bound(spark):
    table = spark.createDataFrame([(f"w{k}".encode(), k) for k in range(200)] + [(b"x" * 100, 10_000)], "word binary, n long")
    got = [r.n for r in frequent.most_frequent(table, 50).collect()]
    assert 0 < len(got) <= 50 and min(got) > 100 and max(got) == 199


def test_sentencepiece_sorts_the_edges_of_few_units_in_a_task(spark, monkeypatch):
    """Partitions of units are not put together by the size of the units, which is small beside that of their edges."""
    dealt, whole = [], spm.lattice

    def watched(found, *given):
        dealt.append(found)
        return whole(found, *given)

    monkeypatch.setattr(spm, "lattice", watched)
    docs = frame(spark, [" ".join(words(1000, 900 + k)) + f" w{k}" for k in range(8)])
    assert spm.encode(docs, checked=True).where("intact").count() == 8
    per_task = [r["count"] for r in dealt[0].groupBy(F.spark_partition_id()).count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(per_task) > 200 and len(per_task) > 2 * parts and max(per_task) < sum(per_task) / parts
