"""Quality scores: random-indexing word vectors, pooled per document, into a small calibrated network.

Every word, and the shape of every word, falls into one of ``BUCKETS`` rows by hash.  A row has a fixed sparse random
index vector; its word vector is the sum of the index vectors of its neighbours over the whole corpus.  A document is
the mean of its words' vectors, the mean of its shapes' vectors, and a few totals.  A network with one hidden layer
is trained on a bounded sample of labelled rows (``SAMPLE`` at most, picked by hash), a fifth of which is kept apart to
fit the temperature of its probabilities.

Null and empty texts have zero vectors and get the score the network gives those; without labels of both
kinds every score is the share of label 1 (0.5 without any); several labels of one document count
as several rows; an empty table gives an empty result.
"""

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common

BUCKETS = 1 << 13
DIMENSIONS = 32
#: Entries of an index vector that are not zero.
ENTRIES = 4
#: Neighbours on each side.
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7
TOTALS = 6
SIZE = 2 * DIMENSIONS + TOTALS

SHAPES = (re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits become one sign each; all else stays."""
    return SHAPES[2].sub("0", SHAPES[1].sub("a", SHAPES[0].sub("A", word)))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector."""
    random = np.random.default_rng(7)
    places = np.argsort(random.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places, random.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(document, bucket and shape bucket of each word, code of each word), and the different words."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner.filter(real).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shapes = [shape(w) for w in names]
    bucket = np.array([crc32(w.encode("utf-8", "replace")) for w in names], np.int64) % BUCKETS
    known: dict[str, int] = {}
    shape_bucket = np.array([known[s] if s in known else known.setdefault(s, crc32(b"\n" + s.encode("utf-8", "replace")) % BUCKETS)
                             for s in shapes], np.int64)
    empty = np.empty(0, np.int64)
    return owner, bucket[code] if len(names) else empty, shape_bucket[code] if len(names) else empty, code, names


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over one task's documents, one row per bucket that occurs."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    seen = np.zeros(BUCKETS)
    for part in (part for batch in batches for part in common.slices(batch, 0)):
        owner, words, shapes, _, _ = tokens(part.column(0))
        for ids in (words, shapes):
            seen += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                same = owner[step:] == owner[:-step]
                for here, other in ((ids[:-step][same], ids[step:][same]), (ids[step:][same], ids[:-step][same])):
                    for k in range(ENTRIES):
                        sums += np.bincount(here * DIMENSIONS + places[other, k], weights=signs[other, k],
                                            minlength=BUCKETS * DIMENSIONS)
    rows = np.flatnonzero(seen)
    vectors = sums.reshape(BUCKETS, DIMENSIONS)[rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(seen[rows]), *[pa.array(vectors[:, d]) for d in range(DIMENSIONS)]],
        ["bucket", "seen", *[f"v{d}" for d in range(DIMENSIONS)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, from all documents: BUCKETS x DIMENSIONS numbers reach the driver."""
    names = ["seen", *[f"v{d}" for d in range(DIMENSIONS)]]
    schema = "bucket long, " + ", ".join(f"{n} double" for n in names)
    sums = docs.select(text_col).mapInArrow(contexts, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.toPandas().to_numpy() if docs.columns else np.empty((0, 2 + DIMENSIONS))
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    if len(found):
        raw = found[:, 2:]
        length = np.sqrt((raw ** 2).sum(axis=1, keepdims=True))
        vectors[found[:, 0].astype(np.int64)] = raw / np.maximum(length, 1e-9)
    return vectors


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of SIZE numbers per text."""
    owner, words, shapes, code, names = tokens(texts)
    n = len(texts)
    out = np.zeros((n, SIZE), np.float32)
    counts = np.bincount(owner, minlength=n)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.r_[0, np.cumsum(counts[full])[:-1]]
    slab = 1 << 14  # documents of about so many words at a time
    cuts = np.r_[np.flatnonzero(np.diff(starts // slab, prepend=-1)), len(full)]
    ends = np.r_[starts[1:], len(owner)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        low, high = starts[a], ends[b - 1]
        for ids, at in ((words, 0), (shapes, DIMENSIONS)):
            out[full[a:b], at:at + DIMENSIONS] = np.add.reduceat(vectors[ids[low:high]], starts[a:b] - low, axis=0)
    out[full, :2 * DIMENSIONS] /= counts[full, None]
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    letters = np.array([sum(map(str.isalpha, w)) for w in names], np.float64)
    sizes = np.array([len(w) for w in names], np.float64)
    pairs = np.unique(owner * np.int64(len(names) + 1) + code) // (len(names) + 1)
    per = np.maximum(counts, 1)
    out[:, -6] = np.log1p(counts) / 8
    out[:, -5] = np.bincount(pairs, minlength=n) / per  # share of different words
    out[:, -4] = np.bincount(owner, weights=letters[code], minlength=n) / np.maximum(
        np.bincount(owner, weights=sizes[code], minlength=n), 1)  # share of letters
    out[:, -3] = np.bincount(owner, weights=sizes[code], minlength=n) / per / 8
    out[:, -2] = np.bincount(owner[letters[code] == 0], minlength=n) / per  # share of words without letters
    out[:, -1] = np.log1p(length) / 10
    return out


def features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features); the vectors are broadcast, BUCKETS x DIMENSIONS numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in common.slices(batch, 1)):
            rows = pooled(part.column(1), shared.value)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), SIZE).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "features"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, features array<float>")


def forward(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.tanh((x - net["mean"]) / net["spread"] @ net["w1"] + net["b1"])
    return hidden @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A network trained by Adam, and the temperature that suits the rows kept apart."""
    random = np.random.default_rng(11)
    order = random.permutation(len(x))
    apart, used = order[:len(x) // 5], order[len(x) // 5:]
    net = {"mean": x.mean(axis=0), "spread": x.std(axis=0) + 1e-3,
           "w1": random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
           "w2": random.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(())}
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {k: 0 * net[k] for k in names}, {k: 0 * net[k] for k in names}, 0
    for _ in range(EPOCHS):
        order = random.permutation(used)
        for at in range(0, len(order), 128):
            rows, step = order[at:at + 128], step + 1
            scaled = (x[rows] - net["mean"]) / net["spread"]
            hidden = np.tanh(scaled @ net["w1"] + net["b1"])
            error = (1 / (1 + np.exp(-np.clip(hidden @ net["w2"] + net["b2"], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, net["w2"]) * (1 - hidden ** 2)
            slopes = {"w1": scaled.T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0),
                      "w2": hidden.T @ error + 1e-4 * net["w2"], "b2": error.sum()}
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                net[k] = net[k] - 0.003 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    logits, truth = forward(x[apart], net), y[apart]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
    candidates = np.exp2(np.linspace(-2, 4, 61))
    net["temperature"] = float(min(candidates, key=loss)) if len(apart) else 1.0
    return net


def train(rows: DataFrame) -> dict | float:
    """A network from (features, quality), or the share of label 1 where there is nothing to tell apart."""
    known = rows.where("quality IN (0, 1)")
    counts = dict(known.groupBy("quality").count().collect())
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 0.5
    draw = F.pmod(F.xxhash64("doc_id", "quality"), F.lit(1 << 30)) / (1 << 30)
    sample = (known.where(draw < SAMPLE / total).select("features", "quality", draw.alias("draw"))
              .orderBy("draw").limit(SAMPLE).toPandas())
    return fit(np.stack(sample["features"].to_numpy()).astype(np.float64), sample["quality"].to_numpy(np.float64))


def score(rows: DataFrame, net: dict | float) -> DataFrame:
    """(doc_id, score) from (doc_id, features)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(net, float):
                found = np.full(batch.num_rows, net)
            else:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE).astype(np.float64)
                found = 1 / (1 + np.exp(-np.clip(forward(x, net) / net["temperature"], -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: Column) -> Column:
    return common.remainder(doc_id, 4) == 2


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    vectors = word_vectors(docs, text_col)
    rows = common.table(features(docs, vectors, id_col, text_col))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    net = train(rows.where(~held_out(F.col("doc_id"))).join(marks, "doc_id"))
    return score(rows, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                   (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
