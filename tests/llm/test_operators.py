"""Every operator against a brute-force version, on rows with nulls, repeats, long texts and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftlines.llm import common, dedup, langid, lm, mixing, neighbours, packing, quality, sharding, simhash, tokenfile
from siftlines.llm.registry import TOKENIZER

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, row long, "
          "_id string, sha string, kept boolean, cluster long, place long")
WORDS = {"en": "the of and that with from this have which their would there about could other into than then them these".split(),
         "de": "der die und das nicht eine mit sich auch auf für ist ein dem von zu den werden wurde über".split()}


def sentence(seed: int, lang: str, n: int) -> str:
    random = np.random.default_rng(seed)
    return " ".join(random.choice(WORDS[lang], n).tolist())


def messy_rows() -> list[tuple]:
    texts = [(i, sentence(i, lang, 30 + i), lang, f"s{i % 4}") for i, lang in ((i, ("en", "de")[i % 2]) for i in range(60))]
    texts += [(100 + i, sentence(3, "de", 33).replace(" ", "\t\n", i), "de", "s0") for i in range(25)]  # copies
    texts += [(200 + i, sentence(7, "de", 300) + f" x{i}", "de", "s1") for i in range(6)]  # near copies
    texts += [(300, None, "en", "s0"), (301, "", "en", None), (302, " \n\t", None, "s2"), (303, "12 34 !?", "en", "s3"),
              (304, sentence(9, "en", 30_000), "en", "s2"), (None, "ein Text ohne Nummer", "de", "s1"),
              (305, "A", None, None), (306, "Zeile\x85mit Trennern \x1c und mehr \U0001f600", "de", "s3")]
    texts += [texts[5], texts[5], texts[-3]]  # whole rows repeated
    return [(i, t, lang, s, len(t or ""), 1, 0.5, 7, "x", "y", True, 3, None) for i, t, lang, s in texts]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def held(doc_id, modulus: int) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == 2


def n_words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_exact_groups(messy):
    groups = defaultdict(list)
    for r in messy_rows():
        groups[normal(r[1])].append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        expected.update((i, least, len(ids), sha) for i in ids)
    found = dedup.exact_groups(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(
        hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    stay = dedup.exact_dedup(messy)
    assert stay.columns == messy.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in stay.collect()) == sorted(
        min((i for i in ids if i is not None), default=-1) for ids in groups.values())


def test_a_full_filter_loses_nothing(messy):
    hashes = messy.select("doc_id", dedup.text_sha256(F.col("text")).alias("text_sha256"))
    repeated = dedup.repeated_bits(hashes, "text_sha256", bits=64)
    maybe, alone = dedup.split(hashes, "text_sha256", repeated, bits=64)
    assert maybe.count() + alone.count() == messy.count()
    counts = Counter(normal(r[1]) for r in messy_rows())
    assert maybe.count() >= sum(n for n in counts.values() if n > 1)


@pytest.mark.parametrize("cut", [3, 23])
def test_targets(spark, cut):
    sizes = {f"s{i:02d}": (i * 37) % 11 * 10 ** (i % 4) for i in range(cut)} | {None: 5}
    found = mixing.targets(spark.createDataFrame([(k, 1, v) for k, v in sizes.items()],
                                                 "source string, n_docs long, source_size long")).collect()
    order = sorted(k for k in sizes if k) + [None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:  # reshare the excess until nobody is above
        left = total - sum(done.values())
        open_weight = sum(w for k, w in weight.items() if k not in done)
        share = {k: left * w / open_weight for k, w in weight.items() if k not in done}
        above = {k: 3.0 * sizes[k] for k, v in share.items() if v > 3 * sizes[k] + 1e-9}
        if not above:
            break
        done |= above
    assert {r.source: pytest.approx(r.target) for r in found} == done | share


def test_mix_takes_the_targets(messy):
    rows = mixing.mix(messy).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], n_words(r[1])) for r in messy_rows())
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and (r.copies > 0) == (r.taken > 0)
        assert r.taken == 0 or 0 <= r.first_position <= r.last_position <= 1
    assert all(abs(taken[r.source] - r.target) <= 1 for r in rows)
    again = mixing.mix(messy.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    course = mixing.curriculum(messy)
    assert course.columns == messy.columns
    copies = Counter()
    for r in rows:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in course.collect()) == +copies


def test_mix_is_sorted_by_the_time_due(messy):
    times = [r.first_position for r in mixing.mix(messy.repartition(5)).collect()]
    due = [t for t in times if t is not None]
    assert due == sorted(due) and times == due + [None] * (len(times) - len(due))


def test_schedule_is_inverted(spark):
    grid = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for slope in mixing.SLOPES:
        for r in grid.select("u", mixing.due(F.col("u"), F.lit(slope)).alias("t")).collect():
            assert (1 + slope) * r.t - slope * r.t ** 2 == pytest.approx(r.u, abs=1e-9)


def test_shards(messy):
    rows = sharding.shard_rows(messy).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in messy_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    of = defaultdict(set)
    for r in rows:
        of[r.linked].add(r.shard)
    counts = Counter(r.linked for r in rows)
    assert sum(len(of[k]) == 1 for k, n in counts.items() if 1 < n <= 3) >= 1


def test_small_groups_are_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}" if i < 1400 else f"alone {i}") for i in range(2400)],
                                 "doc_id long, text string")
    rows = sharding.shard_rows(docs).where("doc_id < 1400").groupBy("linked").agg(F.countDistinct("shard").alias("k"))
    assert rows.where("k > 1").count() <= 20


def simhash_by_definition(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_definition(fps: list[int]) -> list[int]:
    labels = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and labels[j] < labels[i]:
                    labels[i], changed = labels[j], True
    return labels


def test_near_groups(messy):
    rows = [r for r in messy_rows() if len(r[1] or "") < 50_000]
    rows = [(r[0], r[1]) for r in rows]
    fps = [simhash_by_definition(t) for _, t in rows]
    labels = components_by_definition(fps)
    least = defaultdict(lambda: None)
    for (i, _), label in zip(rows, labels):
        if i is not None and (least[label] is None or i < least[label]):
            least[label] = i
    found = simhash.near_groups(messy.where("length(text) < 50000 or text is null")).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter(
        (i, f"{fp:016x}", least[label]) for (i, _), fp, label in zip(rows, fps, labels))
    stay = simhash.near_dedup(messy)
    assert stay.columns == messy.columns
    assert stay.count() == simhash.near_groups(messy).where("representative").count()


def test_links_of_large_entries(spark):
    random = np.random.default_rng(1)
    centre = int(random.integers(1 << 62))
    fps = {centre}
    while len(fps) < 400:
        bits = random.choice(64, random.integers(1, 7), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps | {int(x) for x in random.integers(0, 1 << 62, 200)})
    table = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    labels = {x: x for x in fps}

    def root(x):
        while labels[x] != x:
            x = labels[x]
        return x

    for a, b in edges:
        labels[max(root(a), root(b))] = min(root(a), root(b))
    expected = components_by_definition(fps)
    assert [root(x) for x in fps] == [fps[i] for i in expected]


def test_language(messy):
    rows = langid.predictions(messy).collect()
    assert Counter((r.doc_id, r.held_out) for r in rows) == Counter((r[0], held(r[0], 4)) for r in messy_rows())
    text = {r[0]: r[1] for r in messy_rows()}
    truth = {r[0]: r[2] for r in messy_rows()}
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or "")))
    good = [r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert sum(good) / len(good) > 0.95
    kept = langid.accepted(messy)
    assert kept.columns == messy.columns
    assert kept.count() >= sum(good)


def pack_by_definition(sizes, sources, clusters, capacity, most):
    bins: list[list[int]] = []
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i], i)):
        fits = [(capacity - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)
                if sizes[i] <= capacity - sum(sizes[j] for j in b) and clusters[i] not in {clusters[j] for j in b}
                and len({sources[j] for j in b} | {sources[i]}) <= most]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
        placed[i] = k
    return placed, bins


def test_best_fit_is_the_tightest_compatible():
    random = np.random.default_rng(2)
    for _ in range(20):
        n = 120
        sizes, sources = random.integers(1, 60, n).tolist(), random.integers(0, 5, n).tolist()
        clusters = random.integers(0, 25, n).tolist()
        bins, offsets = packing.best_fit(sizes, sources, clusters, 60, 2)
        expected, by_bin = pack_by_definition(sizes, sources, clusters, 60, 2)
        residual = lambda placed: sorted(  # noqa: E731  equal residuals may be chosen in any order
            60 - sum(s for s, b in zip(sizes, placed) if b == k) for k in set(placed))
        assert abs(len(set(bins)) - len(by_bin)) <= 2
        for k in set(bins):
            inside = [i for i in range(n) if bins[i] == k]
            assert sum(sizes[i] for i in inside) <= 60
            assert len({clusters[i] for i in inside}) == len(inside)
            assert len({sources[i] for i in inside}) <= 2
            ends = sorted((offsets[i], offsets[i] + sizes[i]) for i in inside)
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
        assert residual(bins)[0] >= 0


def check_packed(rows, docs):
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.piece_size
        assert (r.bin is None) == (r.piece_size == 0)
        if r.bin is not None:
            bins[r.packer, r.bin].append(r)
    expected = defaultdict(int)
    for i, text in docs:
        expected[i] += n_words(text)
    assert dict(total) == dict(expected)
    for inside in bins.values():
        assert sum(r.piece_size for r in inside) <= packing.CAPACITY
        assert len({r.cluster for r in inside}) == len(inside)
        assert len({r.source for r in inside}) <= packing.SOURCES


def test_pack(messy):
    check_packed(packing.pack(messy).collect(), [(r[0], r[1]) for r in messy_rows()])


def test_token_file(spark, messy, tmp_path):
    from tokenizers import Tokenizer

    tokenfile.write(messy, str(tmp_path / "ids"), TOKENIZER)
    found = tokenfile.read(spark, str(tmp_path / "ids")).collect()
    assert len(found) == messy.count()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in messy_rows()}
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(ids[r.doc_id]))
        assert r.ids_crc32 == crc32(np.array(ids[r.doc_id], "<u4").tobytes())
        at += r.n_tokens
    named = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)


@pytest.mark.parametrize("values", [[0], [5] * 10, list(range(10_000)), [0] * 99 + [2 ** 32 - 1], [2 ** 32 - 1, 0]])
def test_blocks_round_trip(values):
    data, starts = tokenfile.encode_page(np.array(values, np.uint32))
    assert tokenfile.decode_page(data, starts).tolist() == values
    some = len(starts) // 2
    assert tokenfile.decode_block(data, starts[some]).tolist() == values[some * tokenfile.BLOCK:(some + 1) * tokenfile.BLOCK]


def test_quality(spark):
    good = [(i, sentence(i, "en", 60), 1) for i in range(300)]
    bad = [(1000 + i, sentence(i, "en", 60).replace(" ", "$$$ "), 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(None, None), (5000, ""), (5001, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(9, None, 0), (77777, 1, 0), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id, 4) for r in rows)
    truth = {i: q for i, _, q in good + bad}
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]) > 0.95
    none = quality.scores(docs, labels.where("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}


def test_lm_scores(messy):
    docs = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in messy_rows()]
    counts = Counter(w for i, words in docs if not held(i, 7) for w in words)
    tokens, words = sum(counts.values()), len(counts)
    expected = Counter((i, held(i, 7), len(ws), sum(w in counts for w in ws), tokens, round(sum(
        np.log10((counts[w] + 1) / (tokens + words + 1)) for w in ws), 6)) for i, ws in docs)
    rows = lm.scores(messy).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in rows) == expected
    assert all(r.score <= 1e-9 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_probabilities_add_up():
    random = np.random.default_rng(3)
    weights = random.normal(size=(lm.ROWS, lm.WIDTH)).astype(np.float32)
    mixed = random.integers(0, 1 << 62, (lm.FEATURES, 50)).astype(np.uint64)
    p = lm.softmax(np.zeros(lm.WIDTH, np.float32), weights, lm.rows_of(mixed))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_lm_probabilities_of_very_large_and_very_small_weights():
    weights = np.zeros((lm.ROWS, lm.WIDTH), np.float32)
    weights[0], weights[1], weights[2, 5] = 400, -400, 300
    prior = np.where(np.arange(lm.WIDTH) < 60, 0, -np.inf).astype(np.float32)
    rows = np.array([[0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 3, 3]])
    p = lm.softmax(prior, weights, rows)
    even = np.where(np.arange(lm.WIDTH) < 60, 1 / 60, 0)
    assert np.allclose(p, [even, even, np.eye(lm.WIDTH)[5], even], atol=1e-6)


def training_step(repeated):
    """A table, features and truths of a step; some features come very often."""
    random = np.random.default_rng(4)
    rows = np.where(random.random((lm.FEATURES, lm.STEP_TOKENS)) < repeated, random.integers(0, 40, (lm.FEATURES, lm.STEP_TOKENS)),
                    random.integers(0, lm.ROWS, (lm.FEATURES, lm.STEP_TOKENS)))
    return random.normal(size=(lm.ROWS, lm.WIDTH)).astype(np.float32), rows, random.integers(0, lm.WIDTH, lm.STEP_TOKENS)


@pytest.mark.parametrize("repeated", [0, 0.4, 1])
def test_lm_training_step(repeated):
    weights, rows, truth = training_step(repeated)
    trainer = lm.Trainer(weights)
    trainer.step(np.zeros(lm.WIDTH, np.float32), rows, truth)
    z = np.exp(weights.astype(float)[rows].sum(axis=0))
    slope = z / z.sum(axis=1, keepdims=True) - np.eye(lm.WIDTH)[truth]
    sums = np.zeros(weights.shape)
    for row in rows:
        np.add.at(sums, row, slope)
    assert np.allclose(trainer.weights, weights - lm.RATE * sums / np.sqrt(0.01 + sums * sums), atol=1e-4)
    assert trainer.used.tolist() == np.bincount(rows.reshape(-1), minlength=lm.ROWS).tolist()


def test_lm_training_step_takes_less_time_than_its_sums_by_reduceat():
    from timeit import repeat

    weights, rows, truth = training_step(0.4)
    trainer, prior = lm.Trainer(weights), np.zeros(lm.WIDTH, np.float32)
    found = np.sort(rows.reshape(-1))
    first, slopes = np.flatnonzero(np.r_[True, np.diff(found) > 0]), np.ones((len(found), lm.WIDTH), np.float32)
    assert min(repeat(lambda: trainer.step(prior, rows, truth), number=1, repeat=9)) < min(
        repeat(lambda: np.add.reduceat(slopes, first, axis=0), number=1, repeat=9))


def test_tokens():
    texts = ["One  two\tONE", None, "", " \n", "\u00c4 \u2028x one"]
    words, code, lengths = common.tokens(pa.array(["not this", *texts]).slice(1))
    assert lengths.tolist() == [4, 1, 1, 1, 4]
    assert [b"\n" if c == 0 else words[c - 1] for c in code] == [
        x for t in texts for x in [*(t or "").encode().lower().split(), b"\n"]]
    assert len(set(words)) == len(words)
    nothing = common.tokens(pa.array([], pa.string()))
    assert (nothing[0], len(nothing[1]), len(nothing[2])) == ([], 0, 0)


@pytest.mark.parametrize("n", [30, 900])
def test_neighbours(spark, n):
    random = np.random.default_rng(n)
    vectors = random.normal(size=(n, 16))
    vectors[n // 2:n // 2 + 12] = vectors[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(None, [1.0] * 16, "x"), (5000, None, "x"), (5020, [0.0] * 16, "x"), (5040, [float("nan")] * 16, "x"),
           (5060, [None] * 16, "x"), (5080, [1.0, 2.0], "x"), (5100, [], "x"), (5120, [float("inf")] * 16, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list string")
    found = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, n, 20))
    hits = 0
    for q, near in found.items():
        products = (vectors[q] * vectors).sum(axis=1)
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, min(20, n - 1) + 1))
        assert all(abs(s - products[v]) < 1e-12 and v != q for _, v, s in near)
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        best = sorted((-products[v], v) for v in range(n) if v != q)[:20]
        hits += len({v for _, v in best} & {v for _, v, _ in near})
    assert hits >= 0.9 * len(found) * min(20, n - 1)


def near_copy(random, similarity: float) -> tuple[str, str]:
    """400 words, and as many with words replaced until their 4-word shingles are no more alike than ``similarity``."""
    words = [f"w{i}" for i in random.integers(0, 5000, 400)]
    shingles = lambda x: {tuple(x[i:i + 4]) for i in range(len(x) - 3)}
    other, whole = list(words), shingles(words)
    while len(whole & shingles(other)) > similarity * len(whole | shingles(other)):
        other[random.integers(0, 400)] = f"w{random.integers(0, 5000)}"
    return " ".join(words), " ".join(other)


def test_near_copies_of_known_similarity(spark):
    random, rows = np.random.default_rng(8), []
    for similarity in (0.8, 0.9, 0.95):
        rows += [(2 * i, *near_copy(random, similarity), similarity) for i in range(len(rows), len(rows) + 200)]
    docs = [(i + j, text) for i, *pair, _ in rows for j, text in enumerate(pair)]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    caught = {s: np.mean([i + 1 not in kept for i, _, _, t in rows if t == s]) for s in (0.8, 0.9, 0.95)}
    assert all(i in kept for i, *_ in rows)
    assert caught[0.8] < 0.1 and caught[0.8] <= caught[0.9] <= caught[0.95]  # README gives the shares


def test_a_group_larger_than_a_shard_fills_few(spark):
    texts = ["the same text again and again"] * 8000 + [f"pair {i // 2}" for i in range(2000)] + [f"single {i}" for i in range(14000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 24000
    assert set(Counter(r.shard for r in rows).values()) == {1000}
    hot = sorted(Counter(r.shard for r in rows if r.doc_id < 8000).values(), reverse=True)
    assert sum(hot[:10]) >= 0.95 * 8000


def test_neighbours_that_do_not_cluster(spark):
    n, width = 3000, 512
    vectors = np.random.default_rng(4).normal(size=(n, width))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(vectors)}))
    found = defaultdict(set)
    for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0).collect():
        found[r.query_id].add(r.vec_id)
    assert len(found) == n // 10
    products = vectors[::10] @ vectors.T
    products[np.arange(n // 10), np.arange(0, n, 10)] = -np.inf
    best = np.argsort(-products, axis=1)[:, :20]
    recall = np.mean([len(found[10 * i] & set(row.tolist())) / 20 for i, row in enumerate(best)])
    assert recall >= 0.92


@pytest.mark.parametrize("spread", [0.05, 5.0])  # few and nearly all candidates are left after some columns
def test_lists_give_the_best_rows_that_reach_the_floor(spread):
    random = np.random.default_rng(12)
    middles = random.normal(size=(40, 64))
    x = np.repeat(middles, 15, axis=0) + random.normal(size=(600, 64)) * spread
    q = np.repeat(middles[:10], 30, axis=0) + random.normal(size=(300, 64)) * spread
    product = (q[:, None] * x[None]).sum(axis=2)
    rows = pa.table({"vec_id": np.arange(600), "vector": list(x)})
    for floor in (np.full(300, -np.inf), np.sort(product, axis=1)[:, -3], np.full(300, np.inf)):
        queries = pa.table({"key": [str(i) for i in range(300)], "vector": list(q), "floor": floor})
        found = neighbours._scan(64, 7)(rows, queries).to_pylist()
        best = {(str(i), int(j)) for i, of in enumerate(np.argsort(-product, axis=1)[:, :7]) for j in of if product[i, j] >= floor[i]}
        named = {(r["key"], r["vec_id"]) for r in found}
        assert len(named) == len(found) and len(best & named) >= 0.99 * len(best)
        assert all(abs(r["score"] - product[int(r["key"]), r["vec_id"]]) < 1e-9 for r in found)
        if spread > 1:  # whole products are worked out: no other row
            assert named == best


def test_floors_are_of_rows_in_probed_lists():
    random = np.random.default_rng(13)
    q, known, lists = random.normal(size=(20, 8)), random.normal(size=(500, 8)) * 1e6, random.integers(0, 10, 500)
    probed = np.argsort(random.random((20, 10)), axis=1)[:, :3]
    for i, floor in enumerate(neighbours.floors(q, probed, known, lists, 10, 4)):
        scores = np.sort((q[i] * known[np.isin(lists, probed[i])]).sum(axis=1))
        assert scores[-5] < floor <= scores[-4]
    assert (neighbours.floors(q, probed, known[:3], lists[:3], 10, 4) == -np.inf).all()
    assert (neighbours.floors(q, probed, known, np.full(500, 9), 10, 4) == -np.inf)[~(probed == 9).any(axis=1)].all()


def test_empty_tables(spark, nothing, tmp_path):
    for result in (dedup.exact_groups(nothing), dedup.exact_dedup(nothing), mixing.mix(nothing), mixing.curriculum(nothing),
                   sharding.shard_rows(nothing), simhash.near_groups(nothing), simhash.near_dedup(nothing),
                   langid.predictions(nothing), langid.accepted(nothing), packing.pack(nothing), lm.scores(nothing),
                   quality.scores(nothing, spark.createDataFrame([], "doc_id long, quality int")),
                   neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True))):
        assert result.collect() == []
    tokenfile.write(nothing, str(tmp_path / "none"), TOKENIZER)
    assert tokenfile.read(spark, str(tmp_path / "none")).collect() == []


def test_pipeline(spark, messy, tmp_path):
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        result = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert result.columns == messy.columns
        kept.append(result)
        docs = result
    texts = [[r.text for r in x.collect()] for x in kept[:4]]
    assert all(any(map(str.isalpha, t)) for t in texts[0])
    assert Counter(map(normal, texts[1])) == Counter(set(map(normal, texts[0])))
    fps = [simhash_by_definition(t) for t in texts[1] if len(t) < 50_000]
    assert len(set(components_by_definition(fps))) + sum(len(t) >= 50_000 for t in texts[1]) == len(texts[2])
    assert set(texts[3]) <= set(texts[2])
    check_packed(kept[4].collect(), [(r.doc_id, r.text) for r in kept[3].collect()])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_tables_are_cleared(spark):
    kept = common.table(spark.range(5))
    assert kept.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(common.folder(spark))
    common.clear(spark)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
