"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words are known by a 64-bit hash.  The most frequent ``CLASSES - 1`` times ``WIDTH`` of them stand in classes of equal
size, by falling frequency; one more class holds all others.  The probability of a word is that of its class times that of the word
within its class, each a softmax over sums of weights of three hashed features of what comes before (the word
before, the two before, and the one before the last) on top of the logarithm of its frequency.  A word of the last class
has the add-one share of its count among all words of that class, so the whole is a distribution over known and unseen
words.

Training: every task runs adaptive gradient steps over all its documents from the same start, and the tasks' updates are
averaged, each row of weights by how often a task has used it.  Scoring runs in batches; words too rare to be
broadcast meet their counts in a join.

Null texts are empty: one end token.  Rows with null ids count as others; equal rows are scored each; without training
rows all counts are zero and the model is uniform; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftlines.llm import common

CLASSES = 64
WIDTH = 64
#: Rows of weights for classes, and as many for words.
ROWS = 1 << 14
#: Most words whose counts are broadcast.
FREQUENT = 1 << 18
STEP_TOKENS = 8192
SCORE_TOKENS = 1 << 11
RATE = 0.15
FEATURES = 3
#: Groups of more rows are summed one by one.
LONG = 16
#: Sums of exponentials between this and its inverse need no scaling.
LEAST = np.float32(1e-20)

END = xxhash.xxh64_intdigest(b"\n", 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                np.uint64)


def training(doc_id: Column) -> Column:
    return common.remainder(doc_id, 7) != 2


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts in a row, each text's end included: hash of each different word, code of
    each token, document of each token, place in its document."""
    words, code, lengths = common.tokens(texts)
    hashes = np.array([END, *[xxhash.xxh64_intdigest(w, 1) for w in words]], np.uint64)
    document = np.repeat(np.arange(len(texts)), lengths)
    return hashes, code, document, np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in common.slices(batch, 0)):
        hashes, code, _, _ = sequence(part.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(np.bincount(code, minlength=len(hashes)))], ["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word hash occurs, ends included."""
    return docs.select(text_col).mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """The count from which on at most ``most`` words are as frequent."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    from_n, held = 1 << 62, 0
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        from_n = r["n"]
    return from_n


class Vocabulary:
    """The frequent words, the totals, and which words the model has a place for.

    Tasks get its ``parts``, plain arrays and numbers: a broadcast names the class of an object and does not hold it.
    """

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
        self.tokens, self.words = totals["tokens"] or 0, totals["words"]
        self.from_n = frequent_from(counts)
        found = counts.where(F.col("n") >= self.from_n).toPandas()
        hashes, n = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]
        ranked = np.lexsort((self.hashes, -self.n))[:(CLASSES - 1) * WIDTH]
        self.place = np.full(len(order), -1, np.int64)
        self.place[ranked] = np.arange(len(ranked))
        modelled = np.zeros((CLASSES - 1) * WIDTH)
        modelled[:len(ranked)] = self.n[ranked]
        self.other_tokens = self.tokens - int(modelled.sum())
        self.other_words = self.words - len(ranked)
        within = modelled.reshape(CLASSES - 1, WIDTH)
        of_class = np.r_[within.sum(axis=1), self.other_tokens + 1.0]
        empty = np.where(np.arange(CLASSES - 1) * WIDTH < len(ranked), 0.0, -np.inf)
        with np.errstate(divide="ignore"):
            self.class_prior = (np.log(of_class / of_class.sum()) + np.r_[empty, 0.0]).astype(np.float32)
            self.word_prior = np.log(within / np.maximum(within.sum(axis=1, keepdims=True), 1)).astype(np.float32)

    def parts(self) -> dict:
        return dict(vars(self))

    @classmethod
    def of(cls, parts: dict) -> "Vocabulary":
        found = cls.__new__(cls)
        vars(found).update(parts)
        return found

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (zero if not frequent) and place (-1 if outside the model) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        return np.where(same, self.n[at], 0), np.where(same, self.place[at], -1)


def features(hashes: np.ndarray, code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashed features of what comes before each token, FEATURES x tokens."""
    word = hashes[code]
    one, two = np.zeros_like(word), np.zeros_like(word)
    one[1:] = word[:-1]
    two[2:] = word[:-2]
    one[place < 1] = 1
    two[place < 2] = 2
    return np.stack([one * _ODD[0], (one * _ODD[1]) ^ (two * _ODD[2]), two * _ODD[3]])


def rows_of(mixed: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Row of weights for each feature; the salt is the class for words within it."""
    x = mixed + np.asarray(salt, np.uint64) * _ODD[4]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    return (x >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


def _rows(table: np.ndarray, which: np.ndarray) -> np.ndarray:
    return np.take(table, which, axis=0, mode="clip")  # several times faster than an index


def softmax(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Probabilities for each token, tokens x width; in ``out`` if given."""
    def sums() -> np.ndarray:
        z = np.take(weights, rows[0], axis=0, out=out, mode="clip")
        for row in rows[1:]:
            z += _rows(weights, row)
        z += prior
        return z

    z = sums()
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if not np.all((total > LEAST) & (total < 1 / LEAST)):  # the largest of each token is taken off only where it has to be
        z = sums()
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        total = z.sum(axis=1)
    z /= total[:, None]
    return z


def group_sums(values: np.ndarray, which: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each group the sum of the rows ``which[first:first + size]`` of ``values``.

    Groups come by falling size, those above ``LONG`` in any order.  The latter are summed one by one; the rows of the others are
    added one place at a time, all groups side by side, in a tenth of the time of ``np.add.reduceat``.
    """
    sums = _rows(values, which[first])
    longer = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, LONG + 1), minlength=LONG + 2))  # groups of more rows
    for group, at, size in zip(sums[:longer[LONG]], first.tolist(), sizes.tolist()):
        np.add.reduce(_rows(values, which[at:at + size]), axis=0, out=group)
    for place in range(1, LONG):
        here = slice(longer[LONG], longer[place])
        sums[here] += _rows(values, which[first[here] + place])
    return sums


class Trainer:
    """Adaptive gradient steps on one table of weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.copy()
        self.squares = np.full(weights.shape, 1e-2, np.float32)
        self.used = np.zeros(len(weights))
        self.slope = np.empty((STEP_TOKENS, WIDTH), np.float32)

    def step(self, prior: np.ndarray, rows: np.ndarray, truth: np.ndarray) -> None:
        slope = self.slope[:len(truth)]
        for at in range(0, len(truth), SCORE_TOKENS):  # parts that stay in a core's cache
            part = slice(at, at + SCORE_TOKENS)
            softmax(prior[part] if prior.ndim == 2 else prior, self.weights, rows[:, part], slope[part])
        slope[np.arange(len(truth)), truth] -= 1
        flat = rows.reshape(-1).astype(np.uint16)  # sorted by digits, not by comparing
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sizes = np.diff(np.r_[first, len(flat)])
        falling = np.argsort(LONG + 1 - np.minimum(sizes, LONG + 1).astype(np.uint8), kind="stable")
        first, sizes = first[falling], sizes[falling]
        touched = ordered[first].astype(np.int64)
        sums = group_sums(slope, order % len(truth), first, sizes)
        for at in range(0, len(touched), SCORE_TOKENS):
            row, change = touched[at:at + SCORE_TOKENS], sums[at:at + SCORE_TOKENS]
            squares = change * change
            squares += _rows(self.squares, row)
            self.squares[row] = squares
            np.sqrt(squares, out=squares)
            change *= RATE
            change /= squares
            self.weights[row] = _rows(self.weights, row) - change
        self.used[touched] += sizes


def _trainer(shared):
    names = ["row", "used", *[f"d{i}" for i in range(WIDTH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, words = shared.value
        vocabulary = Vocabulary.of(parts)
        by_class, by_word = Trainer(classes), Trainer(words)
        for part in (part for batch in batches for part in common.slices(batch, 0)):
            hashes, code, _, place = sequence(part.column(0))
            at = vocabulary.find(hashes)[1][code]
            mixed = features(hashes, code, place)
            of_class = np.where(at < 0, CLASSES - 1, at // WIDTH)
            for begin in range(0, len(code), STEP_TOKENS):
                here = slice(begin, begin + STEP_TOKENS)
                by_class.step(vocabulary.class_prior, rows_of(mixed[:, here]), of_class[here])
                known = begin + np.flatnonzero(at[here] >= 0)
                if len(known):
                    chosen = of_class[known]
                    by_word.step(_rows(vocabulary.word_prior, chosen), rows_of(mixed[:, known], chosen + 1), at[known] % WIDTH)
        for base, start, trained in ((0, classes, by_class), (ROWS, words, by_word)):
            used = np.flatnonzero(trained.used)
            change = (trained.weights[used] - start[used]) * trained.used[used, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used + base), pa.array(trained.used[used]),
                 *[pa.array(change[:, i].astype(np.float32)) for i in range(WIDTH)]], names)

    return run, "row long, used double, " + ", ".join(f"d{i} float" for i in range(WIDTH))


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights for classes and for words, ROWS x CLASSES and ROWS x WIDTH."""
    weights = np.zeros((2 * ROWS, WIDTH), np.float32)
    run, schema = _trainer(docs.sparkSession.sparkContext.broadcast((vocabulary.parts(), weights[:ROWS], weights[ROWS:])))
    changes = docs.select(text_col).mapInArrow(run, schema).groupBy("row").agg(
        *[(F.sum(f"d{i}") / F.sum("used")).cast("float").alias(f"d{i}") for i in range(WIDTH)])
    found = changes.toPandas()
    weights[found["row"].to_numpy()] += found.drop(columns="row").to_numpy(np.float32)
    return weights[:ROWS], weights[ROWS:]


def _scorer(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, words = shared.value
        vocabulary = Vocabulary.of(parts)
        below = np.log10(vocabulary.tokens + 1.0 * (vocabulary.words + 1))
        for batch in (part for whole in batches for part in common.slices(whole, 2)):
            n = batch.num_rows
            hashes, code, document, place = sequence(batch.column(2))
            count, at = vocabulary.find(hashes)
            count, at = count[code], at[code]
            frequent = count > 0
            base = np.where(frequent, np.log10(np.maximum(count, 0) + 1.0) - below, 0.0)
            mixed = features(hashes, code, place)
            score = np.zeros(len(code))
            for begin in range(0, len(code), SCORE_TOKENS):
                here = np.arange(begin, min(begin + SCORE_TOKENS, len(code)))
                of_class = np.where(at[here] < 0, CLASSES - 1, at[here] // WIDTH)
                p = softmax(vocabulary.class_prior, classes, rows_of(mixed[:, here]))
                score[here] = np.log10(np.maximum(p[np.arange(len(here)), of_class], 1e-30))
                known = np.flatnonzero(at[here] >= 0)
                if len(known):
                    chosen = of_class[known]
                    p = softmax(_rows(vocabulary.word_prior, chosen), words, rows_of(mixed[:, here[known]], chosen + 1))
                    score[here[known]] += np.log10(np.maximum(p[np.arange(len(known)), at[here[known]] % WIDTH], 1e-30))
            outside = frequent & (at < 0)
            score[outside] += np.log10(count[outside] + 1.0) - np.log10(
                vocabulary.other_tokens + vocabulary.other_words + 1.0)
            total = lambda x: pa.array(np.bincount(document, weights=x, minlength=n))
            whole = lambda x: pa.array(np.bincount(document, weights=x, minlength=n).astype(np.int64))
            names = ["row", "doc_id", "word", "n", "known", "base", "score"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.nulls(n, pa.int64()), whole(np.ones(len(code))), whole(frequent),
                 total(base), total(score)], names)
            rare = ~frequent
            pairs, times = np.unique(document[rare] * np.int64(len(hashes)) + code[rare], return_counts=True)
            zero = np.zeros(len(pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pairs // len(hashes))), pa.nulls(len(pairs), kind),
                 pa.array(hashes[pairs % len(hashes)].view(np.int64)), pa.array(times.astype(np.int64)),
                 pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    taught = docs.where(training(F.col(id_col)))
    counts = common.table(word_counts(taught, text_col))
    vocabulary = Vocabulary(counts)
    classes, words = train(taught, vocabulary, text_col)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = slim.schema["doc_id"].dataType
    kind = to_arrow_type(field)
    run = _scorer(docs.sparkSession.sparkContext.broadcast((vocabulary.parts(), classes, words)), kind)
    parts = common.table(slim.mapInArrow(
        run, f"row long, doc_id {field.simpleString()}, word long, n long, known long, base double, score double"))
    below = F.lit(float(np.log10(vocabulary.tokens + 1.0 * (vocabulary.words + 1))))
    outside = F.lit(float(np.log10(vocabulary.other_tokens + vocabulary.other_words + 1.0)))
    rare = counts.where(F.col("n") < vocabulary.from_n).select("word", F.col("n").alias("c"))
    looked_up = parts.where("word IS NOT NULL").join(rare, "word", "left").select(
        "row", "doc_id", F.lit(0).cast("long").alias("n"),
        F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - below)).alias("base"),
        (F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - outside)).alias("score"))
    whole = parts.where("word IS NULL").drop("word").unionByName(looked_up).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
                        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
