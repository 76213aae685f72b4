"""Each operator on a small table with nulls, ties, repeated rows, empty and long texts and extra columns, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import fingerprints, lm, mil, mixing, packing, quality_rules, sharding, simhash, suffixes, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, uid string, _w string, n int, _id string, _u int, _text string, _d int, _s string, _times int, doc int, of int, rest string, times int, held string"


def sentences(seed, n):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(300)]
    return " ".join(r.choice(names) for _ in range(n))


def texts():
    base, shared = sentences(1, 200), sentences(9, 40)
    out = [base, base, base.replace(" a", " b", 1), None, "", "  \t\n", "a", "a" * 700, "ab" * 400, sentences(2, 80) + shared, shared + sentences(3, 90), "é" * 300 + sentences(4, 60), sentences(5, 30000), sentences(6, 60) + "\x00\x00" * 120, "#$% 1 2 3 #$%\n" * 60]
    return out + [sentences(i, 120) for i in range(20, 28)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", "hot" if i % 3 else f"s{i}", len(t or ""), "x", f"u{i}", "x", 1, "x", i, "x", i, "x", i, i, i, "x", i, "x") for i, t in enumerate(texts(), 1)]
    return out + [out[0], (None, sentences(7, 90), *[None] * 18)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_levels(spark, docs, rows, none):
    found = suffixes.numbered(docs.select(F.col("doc_id"), "text"))
    order = sorted(((r.doc_id if r.doc_id is not None else 2**63, r.uid, (r.text or "").encode()) for r in found.collect()))
    got = {r.uid: r for r in suffixes.remove_repeats(found).collect()}
    seen = set()
    for _, uid, data in order:
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert (got[uid].n_bytes, got[uid].n_removed, bytes(got[uid].kept)) == (len(data), sum(gone), kept)
        assert len(got[uid].spans) == len([1 for k, _ in itertools.groupby(gone) if k])
    assert len(got) == len(rows)
    assert suffixes.remove_repeats(suffixes.numbered(none.select("doc_id", "text"))).count() == 0


def test_hot_anchors_are_dealt_in_blocks(spark, docs, monkeypatch):
    found = suffixes.numbered(docs.select("doc_id", "text"))
    plain = {(r.uid, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(found).collect()}
    monkeypatch.setattr(suffixes, "HOT_RUNS", 0)
    monkeypatch.setattr(suffixes, "BATCH_STARTS", 50)
    assert {(r.uid, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(found).collect()} == plain


@pytest.mark.parametrize("heavy", [1, 3, suffixes.HEAVY])
def test_counted_join_is_a_join(spark, heavy, monkeypatch):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)  # of 3: the key of half of the rows is broadcast, the others are not
    key = [0] * 50 + [1] * 10 + [2] * 10 + list(range(3, 33))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(key)], "k long, i long")
    keys = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("low")).where("c > 1")
    got = suffixes.join_counted(rows, keys, ["k"], "c", len(key)).select("k", "i", "c", "low")
    assert sorted(map(tuple, got.collect())) == [(k, i, key.count(k), key.index(k)) for i, k in enumerate(key) if k < 3]


def test_levels_are_geometric():
    index, seen = suffixes.LevelIndex(), set()
    r = random.Random(3)
    for _ in range(30):
        batch = [bytes([r.randrange(5)]) * 99 + bytes([r.randrange(200)]) for _ in range(40)]
        want = []
        for b in batch:
            want.append(b in seen)
            seen.add(b)
        assert index.add(np.concatenate([suffixes.strings_at(b, 1) for b in batch])).tolist() == want
        sizes = [len(x) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_fingerprints(docs, rows, none):
    got = fingerprints.fingerprint_documents(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", len(r[1] or "") // 3
        want.append((r[0] or -1, len(t), hashlib.sha256((t[: len(t) - n] + (nxt[1] or "")[:n]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_simhash(docs, rows, none):
    def brute(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [brute(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.product(range(len(rows)), repeat=2):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[i] = root[j] = min(root[i], root[j])
    ids = lambda k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None)
    want = sorted((str(r[0]), f"{f:016x}", str(ids(k))) for r, f, k in zip(rows, fp, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_golay_finds_all_links_of_two_bits(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    pairs = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    far = [signed(r.getrandbits(64)) for _ in range(50)]
    frame = spark.createDataFrame([(signed(x),) for x in [base, *pairs]] + [(x,) for x in far], "fp long").distinct()
    from palimpsest.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    assert len({roots[signed(x)] for x in [base, *pairs]}) == 1
    assert not any(x in roots for x in far)


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    pieces = packing.pack_documents(docs).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    for r, want in zip(rows, ids, strict=True):
        mine = [p for p in pieces if p.doc_id == r[0]]
        assert {p.doc_tokens for p in mine} == {len(want)}
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0


def test_rules(docs, rows, none):
    def base(text):
        w = (text or "").encode().split()
        grams = {}
        for i in range(len(w) - 2):
            grams.setdefault(tuple(w[i : i + 3]), []).append(i)
        twice = {i + k for p in grams.values() if len(p) > 1 for i in p for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)

    got = quality_rules.judge(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(r[0]), *base(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.judge(none).count() == 0


def test_em_recovers_planted_accuracies():
    r, chances = random.Random(3), {1: [(0.02, 0.08), (0.1, 0.1), (0.05, 0.25), (0.01, 0.3), (0.2, 0.2)], -1: [(0.7, 0.1), (0.5, 0.2), (0.6, 0.3), (0.35, 0.3), (0.55, 0.2)]}
    histogram = {}
    for _ in range(60_000):
        y = 1 if r.random() < 0.8 else -1
        votes = tuple(-1 if (x := r.random()) < bad else 0 if x < bad + none else 1 for bad, none in chances[y])
        histogram[votes] = histogram.get(votes, 0) + 1
    model = quality_rules.fit(histogram, 5)
    assert abs(1 / (1 + np.exp(-model.log_prior)) - 0.8) < 0.02
    for i, found in enumerate(model.accuracies):
        for y in (1, -1):
            assert abs(found[y][-1] - chances[y][i][0]) < 0.03 and abs(found[y][0] - chances[y][i][1]) < 0.03


def test_em_is_that_of_every_document():
    """The same estimates from a loop over documents, without histogram or logs."""
    r = random.Random(4)
    given = [tuple(r.choice((-1, 0, 1, 1)) if i % 4 else r.choice((-1, -1, 0)) for _ in range(3)) for i in range(200)]
    start, n0 = quality_rules.START, quality_rules.PSEUDO
    chance, good = [start] * 3, quality_rules.START_GOOD
    for _ in range(40):
        belief = []
        for votes in given:
            g, b = good, 1 - good
            for c, v in zip(chance, votes, strict=True):
                g, b = g * c[1][v], b * c[-1][v]
            belief.append(g / (g + b))
        weight = {1: belief, -1: [1 - p for p in belief]}
        chance = [{y: {v: (sum(p for p, x in zip(weight[y], given, strict=True) if x[i] == v) + n0 * start[y][v]) / (sum(weight[y]) + n0) for v in (-1, 0, 1)} for y in (1, -1)} for i in range(3)]
        good = (sum(belief) + n0 * quality_rules.START_GOOD) / (len(given) + n0)
    histogram = {v: given.count(v) for v in set(given)}
    model = quality_rules.fit(histogram, 3, rounds=40)
    assert all(abs(model.accuracies[i][y][v] - chance[i][y][v]) < 1e-9 for i in range(3) for y in (1, -1) for v in (-1, 0, 1))


def test_a_single_odd_measure_is_overruled(spark):
    """On many documents EM keeps one that breaks a weak rule alone, which passing all rules would not."""
    plain = [(i, sentences(1000 + i, 120)) for i in range(600)]
    junk = [(1000 + i, " ".join(w + " $$$ ###" for w in sentences(2000 + i, 60).split())) for i in range(60)]
    short = [(2000 + i, sentences(3000 + i, 55)) for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(plain + junk + short, "doc_id long, text string")).collect()}
    assert all(got[i].kept for i, _ in plain + short) and not any(got[i].kept for i, _ in junk)
    assert all(got[i].n_words < quality_rules.RULES[0].bad_low for i, _ in short)


PAGES = "page_id long, url string, html string, lang string, digest string, first long, shard int"


def test_archive(spark, monkeypatch):
    """Records and look-ups against the table itself: nulls, short and equal payloads, equal URLs over several blocks, repeated rows."""
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 3)
    html = ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, "é" * 60, "é" * 60, "<p>" + sentences(1, 40)]
    given = [(i, f"http://{'abc'[i % 3]}.org/{i % 4 // 3}", h, "en", "x", i, i) for i, h in enumerate(html * 3)]
    given += [given[4], (None, "https://User@A.org:443/1#x", "y" * 100, None, None, None, None), (77, None, "z", None, None, None, None)]
    pages = spark.createDataFrame(given, PAGES).repartition(3)
    archive = warc.write_archive(pages)
    data = lambda h: (h or "").encode()
    low = lambda p: (p is not None, p or 0)
    first = {}
    for p, _, h, *_ in given:
        if len(data(h)) >= 100:
            first[data(h)] = min(first.get(data(h), low(p)), low(p))
    want = []
    for p, u, h, *_ in given:
        revisit = len(data(h)) >= 100 and low(p) != first[data(h)]
        refers = (first[data(h)][1] if first[data(h)][0] else None) if revisit else None
        want.append((str(p), u or "", len(data(h)), hashlib.sha256(data(h)).hexdigest(), "revisit" if revisit else "response", str(refers)))
    row = lambda r: (str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
    assert sorted(map(row, archive.read().collect())) == sorted(want)
    found = archive.find(pages.select(F.coalesce("url", F.lit("")).alias("url"))).collect()
    assert sorted(map(row, found)) == sorted(want)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in found)
    for url in ("http://b.org/0", "http://a.org/1", "http://nowhere.org/", "zzz", ""):
        some = archive.find(spark.createDataFrame([(url,), (None,), (url,)], "url string")).collect()
        assert sorted(map(row, some)) == sorted(w for w in want if warc.url_key(w[1]) == warc.url_key(url)), url
    empty = warc.write_archive(spark.createDataFrame([], PAGES))
    assert empty.read().count() == 0 and empty.find(pages.select("url")).count() == 0


def test_mixing(spark, docs, rows, none):
    big = spark.createDataFrame([(i, "a b c d", "big") for i in range(300)] + [(1000 + i, "a b c d", "small") for i in range(20)], "doc_id long, text string, source string")
    got = mixing.plan(big, mixing.Mix(entropy=1.0, max_repeats=3.0)).toPandas()
    assert set(got[got.source == "big"].doc_id.value_counts()) == {1}
    assert set(got[got.source == "small"].doc_id.value_counts()) == {3}
    assert abs(got.groupby("source").weight.first().sum() - 1) < 1e-9
    equal = mixing.plan(big, mixing.Mix(entropy=1.0, max_repeats=1e9, budget=640.0)).toPandas()
    assert equal.groupby("source").n_tokens.sum().to_dict() == {"big": 320, "small": 320}
    assert got.n_tokens.sum() == 1440 and got.position.between(0, 1440, inclusive="left").all() and not got.duplicated(["doc_id", "pass"]).any()
    kept = mixing.mix_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows}
    assert mixing.plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mixing_by_brute_force(spark):
    """The whole plan again: exponent by halving, quotas, passes ordered by the hash, positions by running sums."""
    r = random.Random(8)
    given = [(i, " ".join(["w"] * r.randint(0, 30)), source) for i, source in enumerate(["a"] * 200 + ["b"] * 70 + ["c"] * 25 + [None] * 5)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    for mix in (mixing.Mix(), mixing.Mix(entropy=0.9), mixing.Mix(close=1.0, max_repeats=1.5, budget=9000.0)):
        tokens = {i: max(1, len(t.split())) for i, t, _ in given}
        size = {s: sum(tokens[i] for i, _, x in given if x == s) for s in ("a", "b", "c", None)}
        total = sum(size.values())
        weights = lambda a: {s: (n / total) ** a / sum((m / total) ** a for m in size.values()) for s, n in size.items()}  # noqa: B023, E731
        entropy = lambda a: -sum(w * np.log(w) for w in weights(a).values()) / np.log(4)
        ratio = lambda a: max(weights(a)[s] / size[s] for s in size) / min(weights(a)[s] / size[s] for s in size)  # noqa: B023, E731
        target = mix.entropy if mix.entropy is not None else 1 - (1 - entropy(1)) * (1 - mix.close)

        def turn(holds):
            low, high = 0.0, 1.0
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (mid, high) if holds(mid) else (low, mid)
            return low

        a = 1.0 if entropy(1) >= target else 0.0 if target >= 1 else turn(lambda x: entropy(x) >= target)  # noqa: B023
        a = max(a, 0.0 if ratio(0) <= mix.max_repeats else turn(lambda x: ratio(x) > mix.max_repeats))  # noqa: B023
        assert 0 < a < 1
        w = weights(a)
        budget = mix.budget or max(size[s] / w[s] for s in size)
        got = mixing.plan(docs, mix).collect()
        assert all(abs(x.weight - w[x.source]) < 1e-5 and abs(x.repeats - w[x.source] * budget / size[x.source]) < 1e-3 for x in got)
        passes = spark.createDataFrame([(i, s, k) for i, _, s in given for k in range(1, 12)], "doc_id long, source string, pass int")
        order = {(x["doc_id"], x["pass"]): x.h for x in passes.withColumn("h", F.xxhash64(F.lit("mix"), "pass", "doc_id", "source")).collect()}
        quota, want = {s: round(got_weight * budget) for s, got_weight in {x.source: x.weight for x in got}.items()}, set()
        for s in size:
            begins = 0
            for k in range(1, 12):
                for i in sorted((i for i, _, x in given if x == s), key=lambda i: order[i, k]):  # noqa: B023
                    if begins < quota[s]:
                        want.add((i, s, k, begins))
                    begins += tokens[i]
        assert {(x.doc_id, x.source, x["pass"], round(x.position * x.weight)) for x in got} == want


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 24) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(none).count() == 0


def test_attention_gradients():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(k, mil.BUCKETS + mil.SHAPES + 3)).astype(np.float32) for k in (1, 3, 2)]
    model = mil.fit(bags, [1, 0, 1])
    x, bag, y = np.concatenate(bags), np.array([0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1])
    loss = lambda: (lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())(model.forward(x, bag, 3)["y"])
    for name, g in model.gradients(x, bag, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
        model.p[name][at] += 1e-5


def test_classifier(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (15, 0), (10, 1), (11, None), (None, 1), (16, 1), (16, 0)], "doc_id long, quality int")
    got = mil.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in mil.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert mil.score_documents(none, labels).count() == 0


def lm_tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [" "]


SMALL = lm.Size(words=40, endings=16, members=8)


def test_language_model(docs, rows, none):
    got = {r.doc_id: r for r in lm.score_documents(docs, SMALL).collect()}
    counts = {}
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            for w in lm_tokens(r[1]):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        words = lm_tokens(r[1])
        want = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert abs(got[r[0]].base_score - want) < 1e-6 * max(1, abs(want))
        assert (got[r[0]].n_tokens, got[r[0]].n_known, got[r[0]].train_tokens) == (len(words), sum(w in counts for w in words), total)
    assert lm.score_documents(none, SMALL).count() == 0


def test_language_model_scores_by_its_formula(spark, docs, rows):
    """Every score again from the model's parameters, a word and a leaf at a time."""
    coded, words, _ = lm.coded_corpus(docs.select("doc_id", "text"), SMALL)
    model = lm.train(coded, words)
    got = {r.doc_id: r.score for r in coded.mapInArrow(lambda b: lm._score(b, model, 0), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").collect()}
    counts = {}
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            for w in lm_tokens(r[1]):
                counts[w] = counts.get(w, 0) + 1
    top = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], xxhash.xxh64_intdigest(w) - (1 << 64 if xxhash.xxh64_intdigest(w) >> 63 else 0)))[:40])}
    ending = lambda w: xxhash.xxh32_intdigest(w.encode()[-4:], 5) % 16
    rest = {e: [counts[w] for w in counts if w not in top and ending(w) == e] for e in range(16)}
    soft = lambda z: z - np.log(np.exp(z).sum())
    for r in rows[:6] + rows[9:12]:
        before, want = [len(model.t), len(model.t)], 0.0
        for w in lm_tokens(r[1]):
            leaf = top.get(w, 40 + ending(w))
            q = np.r_[model.r[before[0]] * model.c[0] + model.r[before[1]] * model.c[1], 1].astype(np.float64)
            k = leaf // 8
            want += soft(model.g.astype(np.float64) @ q)[k] + soft(model.t[8 * k : 8 * k + 8].astype(np.float64) @ q)[leaf - 8 * k]
            want += 0 if w in top else np.log((counts.get(w, 0) + 0.5) / (sum(rest[ending(w)]) + 0.5 * (len(rest[ending(w)]) + 1)))
            before = [leaf, before[0]]
        assert abs(got[r[0]] - want / np.log(10)) < 1e-4 * max(1, abs(want))


def test_probabilities_of_all_words_add_up_to_one():
    names = [f"w{i}".encode() for i in range(60)]
    size, counts = lm.Size(words=20, endings=6, members=8), np.arange(60, 0, -1)
    hashes, endings = lm._hashes(names), lm._endings(names, size)
    rest = np.array([[counts[20:][endings[20:] == e].sum(), (endings[20:] == e).sum()] for e in range(6)], float)
    words = lm.Words(hashes[:20], counts[:20], rest, counts.sum(), 60, size)
    model = lm.Model(words)
    model.t += np.random.default_rng(0).normal(size=model.t.shape).astype(np.float32)
    leaves = words.leaf(hashes, endings)
    assert leaves.tolist() == [*range(20), *(20 + endings[20:])]
    for before in (3, 24):
        chance = lambda leaf: np.exp(model.logs(np.array([7, before, leaf]), np.array([3])))[2]  # noqa: B023, E731
        total = sum(chance(x) * words.share(np.array([x]), np.array([c]))[0] for x, c in zip(leaves, counts, strict=True))
        total += sum(chance(20 + e) * words.share(np.array([20 + e]), np.array([0]))[0] for e in range(6))
        assert abs(total - 1) < 1e-5


def test_pipeline(spark, docs, rows, none):
    """Each stage's rows against what it must keep, all columns as they were."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").columns == none.columns and stage(spark, none, "").count() == 0, name
    of = lambda d: sorted(map(str, d.collect()))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, "")
    good = {}
    for r in quality_rules.judge(docs).collect():
        good[r.doc_id] = good.get(r.doc_id, True) and r.kept
    assert of(kept) == sorted(str(r) for r in docs.collect() if good[r.doc_id])
    first = stages["simhash_near_dedup"](spark, docs, "")
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else {()}
    sets, group = [shingle(r[1]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    want = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in first.collect()) == sorted(want.values())
    assert set(of(first)) <= set(of(docs))
    cut = stages["suffix_array_dedup"](spark, first, "")
    texts_of = {r.doc_id: r.text for r in cut.collect()}
    seen = set()
    for r in sorted(first.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")
        assert (r.doc_id in texts_of) == bool(left or not data) and texts_of.get(r.doc_id) in (left or r.text, None)
    mixed = stages["source_mixing"](spark, cut, "")
    assert set(of(mixed)) == set(of(cut))
    pieces = stages["packing"](spark, mixed, "").collect()
    docs_out = {}
    for p in pieces:
        docs_out[p.doc_id] = docs_out.get(p.doc_id, 0) + p.length
    code = packing.coder(packing.default_vocabulary()).tokenizer
    want = {}
    for r in mixed.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(code.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert docs_out == want


def test_language_model_learns_the_same_from_any_partitions(spark, monkeypatch):
    r = random.Random(5)
    follow = {f"w{i}": [f"w{r.randrange(60)}" for _ in range(2)] for i in range(60)}

    def text():
        out = [f"w{r.randrange(60)}"]
        while len(out) < 150:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    given = spark.createDataFrame([(i, text()) for i in range(800)], "doc_id long, text string")
    one, many = ({r.doc_id: r for r in lm.score_documents(given.repartition(n), lm.Size(words=80, endings=8, members=16)).collect()} for n in (1, 64))
    assert max(abs(one[i].score - many[i].score) for i in one) < 1e-3
    gain = lambda got: 1 - sum(x.score for x in got.values() if x.held_out) / sum(x.base_score for x in got.values() if x.held_out)
    assert gain(many) > 0.02
