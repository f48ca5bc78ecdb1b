"""Toxicity by weak supervision.

Voters are words, word beginnings and character patterns. A generative label model learns from their
votes how accurate each is and how far they repeat one another, and gives every training document a
posterior; a linear classifier is trained on these posteriors and scores all documents. Human labels
choose the lexicon and are one more voter of the label model; they are no input of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import rolling as R
from millrace.llm.common import stored, table
from millrace.llm.decontamination import LOWER

#: About so many labelled documents are learnt from: all, or a sample by a hash of their ids.
TRAINING_ROWS = 20_000
#: Word beginnings that may become voters, in UTF-8 bytes; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
#: Learned voters, at most, and the least likelihood-ratio statistic of one (chance gives this about once in a million terms).
VOTERS, LEAST_G2 = 256, 24.0
#: Insults that vote from the start, so that a lexicon exists however few labels there are.
INSULTS = ("idiot", "moron", "stupid", "dumb", "imbecile", "trash", "garbage", "scum", "loser", "clown", "pathetic", "worthless", "disgusting", "filth", "vermin", "freak", "creep", "bastard", "bitch", "shit", "fuck", "asshole", "idiota", "imbécil", "estúpido", "basura", "idiote", "imbécile", "ordure", "connard", "merde", "dummkopf", "abschaum", "arschloch", "scheiße", "trottel")
BITMAP = 1 << 20
#: Training rows that the driver has as floating-point numbers at a time.
AT_ONCE = 1000


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of term: prefix length, the words that are long enough, and their terms' hashes."""
    up, down = R.powers(R.BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=R.U)
    np.cumsum(R.BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    for k in PREFIXES:
        own = np.flatnonzero(ends - starts >= k) if k else np.arange(len(starts))
        stop = starts[own] + k if k else ends[own]
        yield k, own, R.mix((total[stop] - total[starts[own]]) * down[starts[own]] + R.U(k))


def tokens(data: np.ndarray, offs: np.ndarray):
    """Letters-only words, lower-cased (ASCII and Latin-1 letters); ASCII punctuation and digits separate like white space."""
    data = LOWER[data]
    plain = data.copy()
    # In UTF-8 the capitals of Latin-1 are C3 80 to C3 9E but for C3 97, the small letters 20 (hexadecimal) above.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    plain[capital] += 0x20
    plain[(data < 128) & ~((data >= 97) & (data <= 122))] = 32
    return (plain, *R.words(plain, offs))


def _hash_of(word: str, prefix: int = 0) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    data = data[:prefix] if prefix else data
    return int(next(h for k, _, h in term_hashes(data, np.array([0]), np.array([len(data)])) if k == prefix)[0])


def pattern_votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters: many exclamation marks, much shouting, many symbols (texts x 3)."""
    n = np.maximum(np.diff(offs), 1)
    out = []
    for mask, least in ((data == 33, 0.02), ((data >= 65) & (data <= 90), 0.3), ((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42), 0.05)):
        total = np.concatenate(([0], np.cumsum(mask)))
        out.append((total[offs[1:]] - total[offs[:-1]]) / n > least)
    return np.column_stack(out)


N_PATTERNS = 3


@dataclass
class Model:
    """Sorted term hashes of the voters, and the classifier's weights: one for each voter, the patterns, four totals, and the bias."""

    terms: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.marked = np.zeros(BITMAP, dtype=bool)
        self.marked[(self.terms % R.U(BITMAP)).astype(np.int64)] = True

    def votes(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(texts x voters) how often each voter's term occurs, pattern votes last; words of each text."""
        n = len(column)
        out, words = np.zeros((n, len(self.terms) + N_PATTERNS), dtype=np.float32), np.zeros(n, dtype=np.int64)
        for a, b, offs, data in R.text_slices(column):
            plain, starts, ends, first = tokens(data, offs)
            words[a:b] = np.diff(first)
            out[a:b, len(self.terms) :] = pattern_votes(data, offs)
            if not len(starts) or not len(self.terms):
                continue
            for _, own, h in term_hashes(plain, starts, ends):
                maybe = np.flatnonzero(self.marked[(h % R.U(BITMAP)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
                true = self.terms[slot] == h[maybe]
                text = np.searchsorted(first, own[maybe[true]], "right") - 1
                np.add.at(out, (a + text, slot[true]), 1)
        return out, words

    def scores(self, column) -> np.ndarray:
        votes, words = self.votes(column)
        return sigmoid(features(votes, words, self.weights) @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(votes: np.ndarray, words: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Which voters vote, how many, how often all of their terms occur, in all and for each word, and 1 for the bias."""
    return features_of(votes > 0, votes[:, : votes.shape[1] - N_PATTERNS].sum(axis=1), words)


def features_of(given: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``features`` from who votes, and how often all terms occur."""
    distinct = given[:, : given.shape[1] - N_PATTERNS].sum(axis=1)
    return np.column_stack([given, np.log1p(distinct), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1)), total == 0, np.ones(len(given))])


def slices(n: int) -> list[slice]:
    return [slice(a, a + AT_ONCE) for a in range(0, n, AT_ONCE)]


def label_model(votes: np.ndarray, human: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy of each voter (its precision when it votes), and its weight.

    Generative: given the class, voter j votes with probability p[j, class]. Votes that repeat each other
    aren't independent: a voter counts by one over the sum of its correlations within the class
    with all voters. Expectation maximisation starts from the human labels and keeps them as a
    voter with its own, learned, error rates.
    """
    n, m = votes.shape
    parts = slices(n)

    def of(part: slice) -> np.ndarray:
        return (votes[part] > 0).astype(np.float64)

    q = np.where(human == 1, 0.9, 0.05).astype(np.float64)
    weight = np.ones(m)
    for r in range(rounds):
        prior = np.clip(q.mean(), 0.01, 0.6)
        on, off = np.zeros(m), np.zeros(m)
        for part in parts:
            v = of(part)
            on += q[part] @ v
            off += (1 - q[part]) @ v
        p1 = (on + 0.5) / (q.sum() + 5)
        p0 = (off + 0.05) / ((1 - q).sum() + 5)
        h1, h0 = np.clip((q @ human) / max(q.sum(), 1e-9), 0.6, 0.99), np.clip(((1 - q) @ human) / max((1 - q).sum(), 1e-9), 0.005, 0.2)
        if r % 10 == 0:
            both, squares = np.zeros((m, m)), np.zeros(m)
            for part in parts:
                rest = of(part) - q[part, None] * p1 - (1 - q[part, None]) * p0
                both += rest.T @ rest
                squares += np.square(rest).sum(axis=0)
            scale = np.sqrt(squares) + 1e-9
            weight = 1 / np.maximum(np.abs(both / scale[:, None] / scale[None, :]).clip(0, 1).sum(axis=1), 1)
        if_on, if_off = weight * np.log(p1 / p0), weight * np.log((1 - p1) / (1 - p0))
        odds = np.log(prior / (1 - prior)) + np.concatenate([of(part) @ if_on + (1 - of(part)) @ if_off for part in parts])
        odds += np.where(human == 1, np.log(h1 / h0), np.log((1 - h1) / (1 - h0)))
        new = sigmoid(odds)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q, p1 * q.mean() / (p1 * q.mean() + p0 * (1 - q.mean())), weight


def logistic(x: Callable[[slice], np.ndarray], y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression on soft labels (Newton's method); ``x`` makes the features of a slice of the rows."""
    m, parts = x(slice(0, 1)).shape[1], slices(len(y))
    w, penalty = np.zeros(m), np.full(m, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        curve, slope = np.diag(penalty), penalty * w
        for part in parts:
            f = x(part)
            p = sigmoid(f @ w)
            curve += (f * (p * (1 - p))[:, None]).T @ f
            slope += f.T @ (p - y[part])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents each term is in."""
    for batch in batches:
        toxic, got = batch.column(1).to_numpy(zero_copy_only=False), []
        for a, b, offs, data in R.text_slices(batch.column(0)):
            plain, starts, ends, first = tokens(data, offs)
            text = np.repeat(np.arange(a, b), np.diff(first))
            for _, own, h in term_hashes(plain, starts, ends):
                got.append(np.unique(np.column_stack([h.view(np.int64), text[own]]), axis=0))
        if not got:
            continue
        both = np.concatenate(got)
        terms, at = np.unique(both[:, 0], return_inverse=True)
        pos = np.bincount(at, weights=toxic[both[:, 1]], minlength=len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(pos), pa.array(np.bincount(at, minlength=len(terms)) - pos)], ["term", "pos", "neg"])


def _votes(model: Model):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, words = model.votes(batch.column(0))
            total = votes[:, : len(model.terms)].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(total), pa.array([r.tobytes() for r in np.packbits(votes > 0, axis=1)], pa.binary())], ["toxic", "words", "total", "votes"])

    return emit


def held_out(id_: Column) -> Column:
    """Rows that nothing is learnt from (a null id is not held out)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS, voters: int = VOTERS) -> Model:
    """A model of the labelled documents that aren't held out: all of them, or about ``rows`` (a sample by a hash of the id); at most ``voters`` terms are learnt.

    Null labels and ids are not learnt from; of repeated labels of a document, 1 prevails. Without labels the
    fixed insults alone vote, each with weight 2 on a bias of -4.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("lid", F.lit("toxicity")), F.lit(1_000_000)) < int(1e6 * rows / n))
    slim = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("text"))
    chosen = stored(slim.join(F.broadcast(known), F.col("did") == F.col("lid")).select("text", "label"), "toxicity-training")
    size = dict(chosen.groupBy("label").count().collect())
    n1, n0 = size.get(1, 0), size.get(0, 0)
    terms = {_hash_of(w) for w in INSULTS}
    if n1 and n0:
        counts = chosen.mapInArrow(_term_counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        rate, total = n1 / (n1 + n0), F.col("pos") + F.col("neg")
        share = F.col("pos") / total
        # Twice the log-likelihood ratio of the term's own share of toxic documents against the overall share.
        g2 = 2 * (F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0))
        best = counts.where((F.col("pos") > 0) & (share > min(0.95, 3 * rate))).select("term", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "term").limit(voters)
        terms |= {r["term"] % (1 << 64) for r in best.collect()}
    model = Model(np.array(sorted(terms), dtype=R.U), np.zeros(0))
    if not (n1 and n0):
        model.weights = np.array([2.0] * len(model.terms) + [0.0] * (N_PATTERNS + 4) + [-4.0])
        return model
    got = chosen.select("text", "label").mapInArrow(_votes(model), "toxic int, words long, total float, votes binary").toArrow()
    human, words, total = (got.column(c).to_numpy() for c in ("toxic", "words", "total"))
    packed = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.uint8).reshape(got.num_rows, -1)
    del got
    # A bit a vote comes to the driver, a byte a vote stays there; floating-point numbers are made of a slice at a time.
    given = np.unpackbits(packed, axis=1, count=len(model.terms) + N_PATTERNS).view(bool)
    posterior, _, _ = label_model(given, human.astype(np.float64))
    model.weights = logistic(lambda part: features_of(given[part], total[part], words[part]), posterior)
    return model


def _scorer(model: Model):
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            yield pa.array(model.scores(x), pa.float64())

    return score


def toxicity_score(model: Model, text: Column) -> Column:
    """The model's score of a text, 0 to 1. Null and empty texts are scored like texts without a vote; a very long text is read whole, and every row for itself."""
    return F.arrow_udf(_scorer(model), "double")(text)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
