"""Hard negatives, near-duplicate vectors and lexical search against brute-force versions, on awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlines.llm import hardneg, lexical, vectordups

VECTORS = "vec_id long, embedding array<double>, label int, id long, n long, same string, cell int, rank int, parent long"


def vector_rows(n: int = 600, width: int = 16, seed: int = 1, hot: int = 150) -> list[tuple]:
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, width))
    x[100:140] = x[100] + random.normal(size=(40, width)) * 0.1  # near copies
    x[200:200 + hot] = x[200]  # copies
    for i in range(150, 170):  # a chain: each near the next, the ends apart
        x[i] = x[i - 1] + random.normal(size=width) * 0.2
    labels = random.integers(0, 3, n)
    labels[100:170] = 1
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))]
    rows += [(1000, None, 1), (1001, [0.0] * width, 1), (1002, [float("nan")] + [1.0] * (width - 1), 2), (1003, [1.0, None] * (width // 2), 0),
             (1004, [float("inf")] * width, 0), (1005, x[5].tolist(), None), (1006, [], 1), (1007, [1.0, 2.0], 2), (1008, [1.0, 2.0], 2),
             (None, x[7].tolist(), int(labels[7])), rows[9], rows[9]]
    return [(*r, 1, 2, "s", 3, 4, 5) for r in rows]


def good(v, zero: bool = True) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def links_of(rows, tau=0.93):
    """(id, links, component) of every row, by comparing all pairs."""
    part = [r[0] is not None and r[2] is not None and good(r[1], zero=False) for r in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and part[i] and part[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= tau:
                    near[i].append(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((r[0], len(near[i]), r[0] if r[0] is None else min(rows[j][0] for j in seen)))
    return Counter(out)


@pytest.mark.parametrize("cell_rows", [vectordups.CELL_ROWS, 16])
def test_vector_groups(spark, cell_rows, monkeypatch):
    rows = vector_rows(400)
    if cell_rows == 16:  # many cells, blocks and chunks
        monkeypatch.setattr(vectordups, "BLOCK_ROWS", 7)
        monkeypatch.setattr(vectordups, "CHUNK_ROWS", 9)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = vectordups.near_groups(table, cell_rows=cell_rows).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == links_of(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    stay = vectordups.near_dedup(table, cell_rows=cell_rows)
    assert stay.columns == table.columns
    ids = {r.vec_id for r in found if r.kept}
    assert Counter(r.vec_id for r in stay.collect()) == Counter(r[0] for r in rows if r[0] in ids or r[0] is None)


def test_visited_cells_hold_every_near_vector():
    random = np.random.default_rng(4)
    x = vectordups.unit(random.normal(size=(3000, 6)))
    middle = vectordups.centres(x, 64)
    home, later = vectordups.visits(x, middle, 0.93, 1.0)
    near = np.triu(x @ x.T >= 0.93, 1)
    for i, j in zip(*np.nonzero(near)):
        first, last = sorted((i, j), key=lambda k: home[k])
        assert home[first] == home[last] or later[first, home[last]]
    assert later.sum() < 0.3 * len(x) * len(middle)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 1000 + i) for i in range(300)] + [(7, 7)]
    found = {r.id: r.parent for r in vectordups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 500 for i in range(300)}


def mined(rows, anchors, positives=5, negatives=5):
    """Hard negatives by comparing every anchor with every row."""
    width = Counter(len(r[1]) for r in rows if r[0] is not None and r[2] is not None and good(r[1])).most_common(1)[0][0]
    kept = [(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows
            if r[0] is not None and r[2] is not None and good(r[1]) and len(r[1]) == width]
    out = Counter()
    for i, label, q in kept:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, other) for j, other, x in kept if j != i)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            window = [(s, j) for s, j, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            out.update((i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(window[:negatives]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, small, monkeypatch):
    rows = vector_rows(500, width=8, seed=3)
    if small:  # many cells, trees and chunks
        for name, value in (("CELL_ROWS", 40), ("TREE_ROWS", 11), ("CHUNK_ANCHORS", 3), ("TOGETHER", 2)):
            monkeypatch.setattr(hardneg, name, value)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = hardneg.mine(table, F.col("vec_id") % 20 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == mined(rows, lambda i: i % 20 == 0)


def test_cover_tree_radii_hold_what_is_below():
    random = np.random.default_rng(6)
    middles = random.normal(size=(12, 5)) * 10
    x = np.concatenate([m + random.normal(size=(40, 5)) * 0.3 for m in middles] + [np.repeat(middles[:1], 9, axis=0)])
    points = hardneg.lifted(x, float(np.sqrt((x * x).sum(axis=1)).max()) * 1.001)
    parent, step, radii = hardneg.cover_tree(points)
    assert (parent == -1).sum() == 1 and parent[0] == -1
    for row in range(1, len(x)):
        node, came = row, None
        while parent[node] >= 0:
            node, came = parent[node], step[node]
            assert np.linalg.norm(points[row] - points[node]) <= radii[node][came] + 1e-9
    assert max(map(len, radii)) > 3  # levels, not one flat list


def test_search_skips_what_lies_outside_the_windows(monkeypatch):
    random = np.random.default_rng(8)
    x = np.concatenate([m + random.integers(-3, 4, size=(100, 6)) for m in random.integers(-300, 300, size=(20, 6))])
    most = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max()) * 1.001
    import pyarrow as pa
    rows = hardneg._build(6, most)(pa.table({
        "vec_id": pa.array(range(len(x)), pa.int64()), "label": pa.array([0] * len(x), pa.int64()), "x": pa.array(x.tolist())}))
    tree, seen = hardneg.Tree(rows, 6, most), []
    verify = hardneg.product
    monkeypatch.setattr(hardneg, "product", lambda q, x: seen.append(len(q) * len(x)) or verify(q, x))
    q = x[::200]
    open_ = np.full((len(q), 1), -np.inf), np.full((len(q), 1), np.inf)
    who, _, slot, score = tree.search(q, np.zeros(len(q), int), True, *open_, 5)
    assert sorted(score.tolist()) == sorted(np.sort(q @ x.T, axis=1)[:, -5:].reshape(-1).tolist())
    assert sum(seen) < 0.5 * len(q) * len(x)


def test_search_finds_nothing_in_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hardneg.mine(none, F.col("vec_id") % 20 == 0).collect() == []
    assert vectordups.near_groups(none).collect() == [] and vectordups.near_dedup(none).collect() == []
    some = spark.createDataFrame(vector_rows(300, hot=10), VECTORS)
    assert hardneg.mine(some, F.lit(False)).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


DOCS = "doc_id long, text string, item long, m long, terms string, tfs int, rank int, score double, item_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def lexical_rows() -> list[tuple]:
    random = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄRGER", "naïve", "日本"]
    chance = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(random.choice(words, int(random.integers(1, 60)), p=chance / chance.sum())) for _ in range(700)]
    texts += ["w1 w2,w3;W1"] * 120 + [None, "", "  ... ", "\x00\x7f", "w9" * 3, "x" * 100_000 + " w5", "w7 " * 50_000, "a\x85b w4"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w3"), (5, texts[5]), (5, texts[5])]
    return [(*r, 1, 2, "t", 3, 4, 0.5, 6) for r in rows]


def lexical_results(docs, items, k):
    counted = [(r[0], Counter(plain_terms(r[1]))) for r in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(plain_terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out.update((item, place + 1, i, -score) for place, (score, _, i) in enumerate(sorted(found)[:k]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, small, monkeypatch):
    rows = lexical_rows()
    items = [(1, "W1, w40 straße"), (2, "ärger ÄRGER w63 w2"), (3, None), (4, "..."), (None, "日本 w9w9w9 w7"), (2, "w5 w4 nothere"),
             (6, " ".join(f"w{i}" for i in range(60)))]
    how = {}
    if small:  # items in blocks, strata in blocks, hardly any first visits
        monkeypatch.setattr(lexical, "BLOCK_DOCS", 10)
        monkeypatch.setattr(lexical, "WIDE", 5)
        how = dict(item_terms=20, first_docs=5, k=7)
    found = lexical.search(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **how)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == lexical_results(rows, items, how.get("k", lexical.K))


def test_special_tokens_in_any_case_and_other_vocabularies(tmp_path):
    import json

    from tokenizers import Tokenizer

    from siftlines.llm import tokenfile
    from siftlines.llm.registry import TOKENIZER
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|EndOfText|>Y", "<|startoftext|>", "< | >", "<|endoftext", None, "It's ÄRGER, 12!"]
    for path in (TOKENIZER, str(tmp_path / "other.json")):
        spec = json.load(open(TOKENIZER))
        if path != TOKENIZER:  # words can no longer be told apart
            spec["normalizer"] = {"type": "NFC"}
            json.dump(spec, open(path, "w"))
        assert tokenfile.wordwise(spec) == (path == TOKENIZER)
        library = Tokenizer.from_file(path)
        expected = [[*library.encode(t or "", add_special_tokens=False).ids, tokenfile.END_ID] for t in texts]
        assert [x.tolist() for x in tokenfile.encoder(path)(texts)] == expected


def mixed_texts(n: int) -> list[str]:
    """Words of letters, marks, digits and signs that the vocabulary prepares in some way, in any order."""
    random = np.random.default_rng(n)
    signs = ["a", "b", "he", "llo", "Z", "Q", "\u00c4", "\u00e9", "\u00df", "\u00ff", "\u00d7", "\u00f7", "'", "'s", "'re", "'d", "!", "--", ".", "<", "|", "7",
             "12", "\u0301", "\u0130", "\u03a3", "\u4e2d", "\u00a0", "\u0085", "\x1c", "\x7f", "\u2028", "\U0001f600", "</w>", "\u00b2", "\u212a", "\u017f"]
    words = ["".join(random.choice(signs[:int(random.choice([6, 23, len(signs)]))], random.integers(1, 6))) for _ in range(300)]
    return [str(random.choice([" ", "\n", " \t"])).join(random.choice(words, random.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [1 << 18, 20])
def test_words_in_pieces_have_the_ids_of_the_library(monkeypatch, remembered):
    from tokenizers import Tokenizer

    from siftlines.llm import tokenfile
    from siftlines.llm.registry import TOKENIZER
    monkeypatch.setattr(tokenfile, "REMEMBERED", remembered)
    library, encode = Tokenizer.from_file(TOKENIZER), tokenfile.encoder(TOKENIZER)
    for texts in (mixed_texts(n) for n in (200, 1, 90, 0, 150)):
        expected = [[*library.encode(t, add_special_tokens=False).ids, tokenfile.END_ID] for t in texts]
        assert [x.tolist() for x in encode(texts)] == expected


@pytest.mark.parametrize("other", [False, True])
def test_columns_are_encoded_as_lists_are(tmp_path, other):
    import json

    import pyarrow as pa

    from siftlines.llm import tokenfile
    from siftlines.llm.registry import TOKENIZER
    spec = json.load(open(TOKENIZER))
    if other:
        spec["normalizer"] = {"type": "NFC"}
    json.dump(spec, open(tmp_path / "ids.json", "w"))
    texts = [*mixed_texts(50), None, "", "x <|EndOfText|> y"]
    encode = tokenfile.encoder(str(tmp_path / "ids.json"))
    assert [x.tolist() for x in encode(pa.array(["not this", *texts]).slice(1))] == [x.tolist() for x in encode(texts)]


def test_words_are_merged_many_at_once():
    from siftlines.llm import tokenfile
    from siftlines.llm.registry import TOKENIZER
    import cProfile
    import pstats

    encode, profile = tokenfile.encoder(TOKENIZER), cProfile.Profile()
    letters = np.random.default_rng(5).choice(list("abcdefgh"), (5000, 9))
    profile.runcall(encode, [" ".join(map("".join, letters))])
    calls = {name: n for (_, _, name), (n, *_) in pstats.Stats(profile).stats.items()}
    assert sum(n for name, n in calls.items() if "tokenize" in name or "encode_batch" in name) < 10


def test_no_call_for_each_word():
    from siftlines.llm import tokenfile
    from siftlines.llm.registry import TOKENIZER
    import cProfile
    import pstats

    encode, profile = tokenfile.encoder(TOKENIZER), cProfile.Profile()
    letters = np.random.default_rng(6).choice(list("abcdefgh"), (20_000, 9))
    text = " ".join("".join(word) + ending for word, ending in zip(letters, ["", ",", "'s", "7"] * 5000))
    for _ in range(2):  # new words, then known ones
        profile.runcall(encode, [text])
    assert pstats.Stats(profile).total_calls < 2000


def test_width_of_a_block_is_that_of_the_difference_at_the_percentile():
    from siftlines.llm import tokenfile
    random = np.random.default_rng(7)
    cases = [random.integers(0, 2 ** int(random.integers(1, 33)), int(random.integers(1, 4097))).astype("<u4") for _ in range(60)]
    for values in [*cases, np.array([0, 2 ** 32 - 1], "<u4"), np.zeros(9, "<u4")]:
        block = tokenfile.encode_block(values)
        rest = np.sort(values - values.min())
        assert np.frombuffer(block, "<u4", 4)[2] == int(rest[math.ceil((len(rest) - 1) * tokenfile.PERCENTILE / 100)]).bit_length()
        assert (tokenfile.decode_block(block, 0) == values).all()


@pytest.mark.parametrize("kind", ["smallint", "date"])
def test_ids_of_any_type(spark, kind):
    from siftlines.llm import lm
    docs = spark.range(1, 40).select((F.col("id").cast("smallint") if kind == "smallint" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("doc_id"),
                                     F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"))
    assert lm.scores(docs).count() == 39
    items = spark.createDataFrame([(1, "two 17")], "item_id long, text string")
    assert lexical.search(docs, items).where("rank = 1").select("doc_id").first()[0] == docs.where("text = 'one two 17'").first()[0]


def test_what_tasks_get_does_not_name_the_package():
    import pickle

    from siftlines.llm import lm
    parts = lm.Vocabulary.of({"hashes": np.array([1], np.uint64), "n": np.array([2]), "place": np.array([0])}).parts()
    assert b"siftlines" not in pickle.dumps(parts)
    assert lm.Vocabulary.of(parts).find(np.array([1, 5], np.uint64))[0].tolist() == [2, 0]
