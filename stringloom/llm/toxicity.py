"""Operator 6: toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: on the training sample, a feature of a token (its word without punctuation, or
its first 3 to 6 bytes) counts as toxic if its document counts differ from the base rate by far more than the number of features lets
chance explain. A token of a toxic document with such a feature is labelled toxic, every other token clean.

The field has two states and, for each token, hashed features (word, beginnings). It is fitted by
gradient steps on its exact conditional likelihood (forward-backward) over windows around toxic tokens and seeded clean windows.

Scoring runs forward-backward over whole texts. With two states a message is one log ratio, r[t] = e[t] + g(r[t-1]), and g contracts, so
the recursion is solved for all texts of a batch at once: tokens whose predecessor changed are updated until nothing changes by more
than 1e-9. The document score is a logistic function, fitted on the training sample, of the summed marginals above FLOOR, the largest one,
and the sum's density.

The sample is trained on in one task. Training rows: crc32(doc_id as text) mod 5 is not 0. The sample is bounded by TRAIN_DOCS documents and
TRAIN_BYTES of text, both as expected values (rows are chosen by hash, each as a whole, so one very long text may exceed them); the field is fitted on windows around at most TOXIC_WINDOWS toxic tokens and around CLEAN_WINDOWS places, both
seeded random choices of the sample's tokens. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts get the score of a text without toxic tokens; rows are scored each, repeated or not; documents
without a label are scored all the same; contradicting labels of one id: each counts; without training rows all scores are 0; other
columns are ignored.
"""
from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.words import Words, mix, slices

FOLDS, TRAIN_DOCS, TRAIN_BYTES = 5, 6_000, 16_000_000
HASH_PARTS = 8
TABLE, WINDOW, STEPS, CLEAN_WINDOWS, TOXIC_WINDOWS, ROUNDS, FLOOR, SEED = 1 << 20, 6, 200, 24_000, 8_000, 4, 0.05, 5
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TEMPLATES = 5


def features(words: Words) -> np.ndarray:
    """(templates, tokens) hashes: the bare word and its first 3, 4, 5 and 6 bytes; a beginning longer than the word is 0."""
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        cut = (ends - starts > 1) & _PUNCTUATION[words.data[ends - 1]] if len(ends) else np.zeros(0, bool)
        ends[cut] -= 1
        cut = (ends - starts > 1) & _PUNCTUATION[words.data[starts]] if len(ends) else np.zeros(0, bool)
        starts[cut] += 1
    out = np.zeros((_TEMPLATES, len(starts)), np.uint64)
    out[0] = words.part(starts, ends)
    for row, k in enumerate((3, 4, 5, 6), 1):
        long = ends - starts > k
        out[row][long] = mix(words.part(starts[long], starts[long] + k) ^ np.uint64(row))
    return out


def places(hashes: np.ndarray) -> np.ndarray:
    """Places in the weight table; place 0 stands for no feature and keeps weight 0."""
    out = (hashes % np.uint64(TABLE - 1)).astype(np.int64) + 1
    out[hashes == 0] = 0
    return out


def tags(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.uint16)


def _log_ratio(x, at0, a00, a01, a10, a11):
    """log of (e^x a11 + a01) / (e^x a10 + a00), stable for large |x|."""
    return np.logaddexp(x + a11, a01) - np.logaddexp(x + a10, a00)


class Field:
    """Weights: emission log ratio of the toxic state (bias and a table of features with tags), transition log weights [from][to], start log ratio."""

    def __init__(self):
        self.table = np.zeros(TABLE, np.float32)
        #: which feature a place belongs to: others that fall there have no weight
        self.tag = np.zeros(TABLE, np.uint16)
        self.bias, self.start = -3.0, -2.0
        self.trans = np.zeros((2, 2))
        self.doc = np.array([-2.0, 0.0, 0.0, 0.0])

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the features that have one, 0 for others."""
        at = places(hashes)
        at[self.tag[at] != tags(hashes)] = 0
        return at

    def take(self, hashes: np.ndarray) -> None:
        """Give these features their places."""
        h = hashes[hashes != 0]
        self.tag[places(h)] = tags(h)

    def emissions(self, hashes: np.ndarray) -> np.ndarray:
        return self.bias + self.table[self.own(hashes)].sum(axis=0, dtype=np.float64)

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of every token; first: where the texts' tokens begin, and their end."""
        n = len(e)
        if not n:
            return e
        (a00, a01), (a10, a11) = self.trans
        begins, ends = np.zeros(n, bool), np.zeros(n, bool)
        some = first[1:] > first[:-1]
        begins[first[:-1][some]] = True
        ends[first[1:][some] - 1] = True

        def solve(value, update, step, stop):
            """value[t] from its neighbour value[t - step], which a text's edge lacks; only what follows a change is done again."""
            todo = np.flatnonzero(~stop)
            for _ in range(n):
                if not len(todo):
                    return value
                new = update(value, todo)
                moved = np.abs(new - value[todo]) > 1e-9
                value[todo] = new
                todo = todo[moved] + step
                todo = todo[(todo >= 0) & (todo < n)]
                todo = todo[~stop[todo]]
            return value

        r = e + self.start * begins
        r = solve(r, lambda v, t: e[t] + _log_ratio(v[t - 1], 0, a00, a01, a10, a11), 1, begins)
        b = np.zeros(n)
        b = solve(b, lambda v, t: np.logaddexp(e[t + 1] + v[t + 1] + a11, a10) - np.logaddexp(e[t + 1] + v[t + 1] + a01, a00), -1, ends)
        return 1 / (1 + np.exp(-np.clip(r + b, -500, 500)))

    def aggregate(self, p: np.ndarray, words: Words) -> np.ndarray:
        """(texts, 4): 1, log of 1 + summed marginals above the floor, the largest marginal, and that sum per hundred tokens (at most 1)."""
        doc = words.doc
        strong = p >= FLOOR
        total = np.bincount(doc[strong], p[strong], words.n)
        most = np.zeros(words.n)
        np.maximum.at(most, doc, p)
        n = np.maximum(1, np.diff(words.first))
        return np.stack([np.ones(words.n), np.log1p(total), most, np.minimum(1, 100 * total / n)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -50, 50)))


def toxic_features(hashes: np.ndarray, unit: np.ndarray, label: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Sorted features that mark toxic units (of label 1) beyond chance, from the open tokens; a template and a range of hashes at a time,
    to bound the memory."""
    there = np.unique(unit[open_])
    base = min(max(label[there].mean() if len(there) else 0.5, 1e-3), 0.999)
    n, kept, gains = 2, [], []
    for row in hashes:
        for part in range(HASH_PARTS):
            at = np.flatnonzero(open_ & (row != 0) & (row % np.uint64(HASH_PARTS) == part))
            h, d = row[at], unit[at]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            names, at = np.unique(h, return_inverse=True)
            a = np.bincount(at, label[d] == 1, len(names))
            b = np.bincount(at, label[d] == 0, len(names))
            share = a / np.maximum(1, a + b)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = a * np.log(np.maximum(share, 1e-12) / base) + np.where(b > 0, b * np.log(np.maximum(1 - share, 1e-12) / (1 - base)), 0)
            n += len(names)
            kept.append(names[share > 0.8])
            gains.append(gain[share > 0.8])
    return np.sort(np.concatenate(kept)[np.concatenate(gains) > math.log(n) + 2])


def holds(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which tokens have one of the (sorted) features."""
    out = np.zeros(hashes.shape[1], bool)
    if len(marks):
        for h in hashes:
            out |= marks[np.minimum(np.searchsorted(marks, h), len(marks) - 1)] == h
    return out


def likenesses(words: Words, rounds: int = 6) -> np.ndarray:
    """(rounds, texts): least hashes of the texts' three-word runs; near copies share some."""
    at, h = words.shingles(3)
    out = np.empty((rounds, words.n), np.uint64)
    for i in range(rounds):
        out[i] = mix(np.arange(words.n, dtype=np.uint64) + words.hash[:1].sum() + np.uint64(1))  # texts of fewer words are like no other
        least = np.full(words.n, np.uint64(2**64 - 1))
        np.minimum.at(least, words.doc[at], mix(h ^ mix(np.array([i + 1], np.uint64))))
        out[i][np.unique(words.doc[at])] = least[np.unique(words.doc[at])]
    return out


def clusters(group: np.ndarray) -> np.ndarray:
    """A number for each text, equal for those that share a likeness, also by way of others."""
    n = group.shape[1]
    of = np.arange(n)

    def root(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for row in group:
        order = np.argsort(row, kind="stable")
        for a, b in zip(order[:-1][row[order[1:]] == row[order[:-1]]].tolist(), order[1:][row[order[1:]] == row[order[:-1]]].tolist()):
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def train(texts: list[str], labels: list[int]) -> Field:
    field = Field()
    field.doc = np.array([-20.0, 0, 0, 0])
    label = np.array(labels)
    if not len(label) or label.min() == label.max():
        return field
    column = pa.array(texts, pa.string())
    # room for as many tokens as the bytes allow; only what is written takes memory
    room = (pc.sum(pc.binary_length(column)).as_py() or 0) // 2 + len(column)
    hashes, doc, group, n = np.empty((_TEMPLATES, room), np.uint64), np.empty(room, np.int32), [], 0
    for lo, hi in slices(column):
        words = Words(column.slice(lo, hi - lo))
        m = n + len(words.starts)
        hashes[:, n:m] = features(words)
        doc[n:m] = words.doc + lo
        group.append(likenesses(words))
        n = m
    hashes, doc, group = hashes[:, :n], doc[:n], np.concatenate(group, axis=1)
    units, unit = np.unique(clusters(group) * 2 + label, return_inverse=True)
    unit = unit.astype(np.int32)[doc]
    y = np.zeros(len(doc), np.int8)
    for _ in range(ROUNDS):
        # the clean documents, and the toxic ones that no marked token explains yet: fewer, so that rarer features stand out
        explained = np.bincount(doc, y, len(label)) > 0
        open_ = ~explained[doc]
        marks = toxic_features(hashes, unit, units & 1, open_)
        found = holds(marks, hashes) & (label[doc] == 1) & (y == 0)
        if not found.any():
            break
        y[found] = 1
    # windows: around toxic tokens, and seeded clean ones
    rng = np.random.default_rng(SEED)
    toxic = np.flatnonzero(y)
    if len(toxic) > TOXIC_WINDOWS:
        toxic = rng.choice(toxic, TOXIC_WINDOWS, replace=False)
    centre = np.concatenate([toxic, rng.integers(0, len(y), CLEAN_WINDOWS)])
    at = centre[:, None] + np.arange(-WINDOW, WINDOW + 1)
    inside = (at >= 0) & (at < len(y))
    at = np.clip(at, 0, len(y) - 1)
    inside &= doc[at] == doc[centre][:, None]
    # padding goes to the end of each window
    order = np.argsort(~inside, axis=1, kind="stable")
    at, inside = np.take_along_axis(at, order, 1), np.take_along_axis(inside, order, 1)
    field.take(hashes[:, np.unique(at)])
    field.take(hashes[:, toxic])
    _fit(field, field.own(hashes[:, at.reshape(-1)]).reshape(_TEMPLATES, *at.shape), y[at], inside, rng)
    del hashes, doc
    x = []
    for lo, hi in slices(column):
        words = Words(column.slice(lo, hi - lo))
        x.append(field.aggregate(field.marginals(field.emissions(features(words)), words.first), words))
    field.doc = _logistic(np.concatenate(x), label)
    return field


def _fit(field: Field, idx: np.ndarray, y: np.ndarray, inside: np.ndarray, rng) -> None:
    """Gradient ascent (per-weight rates) on the conditional log likelihood of windows; idx: (templates, windows, places)."""
    n, width = y.shape
    g_table, g_rest = np.full(TABLE, 1e-3), np.full(6, 1e-3)
    for step in range(STEPS):
        rows = rng.choice(n, min(n, 3000), replace=False)
        ix, yy, ok = idx[:, rows], y[rows], inside[rows]
        e = field.bias + field.table[ix].sum(axis=0, dtype=np.float64)
        em = np.stack([np.zeros_like(e), e], 2)  # rows, places, states
        m = len(rows)
        alpha = np.zeros((m, width, 2))
        alpha[:, 0] = em[:, 0] + np.array([0, field.start])
        for t in range(1, width):
            nxt = em[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + field.trans[0], alpha[:, t - 1, 1, None] + field.trans[1])
            alpha[:, t] = np.where(ok[:, t, None], nxt, alpha[:, t - 1])
        beta = np.zeros((m, width, 2))
        for t in range(width - 2, -1, -1):
            x = em[:, t + 1] + beta[:, t + 1]
            prev = np.logaddexp(field.trans[:, 0] + x[:, 0, None], field.trans[:, 1] + x[:, 1, None])
            beta[:, t] = np.where(ok[:, t + 1, None], prev, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        post = np.exp(alpha + beta - z[:, None, None])
        post[~ok] = 0
        grad_e = np.where(ok, yy - post[:, :, 1], 0)
        grad_table = np.bincount(ix.reshape(_TEMPLATES, -1).reshape(-1), np.tile(grad_e.reshape(-1), _TEMPLATES), TABLE) / m
        grad_table[0] = 0
        grad_table -= 1e-5 * field.table
        grad_t = np.zeros((2, 2))
        both = ok[:, 1:]
        for i in range(2):
            for j in range(2):
                seen = ((yy[:, :-1] == i) & (yy[:, 1:] == j) & both).sum()
                pair = np.exp(alpha[:, :-1, i] + field.trans[i, j] + em[:, 1:, j] + beta[:, 1:, j] - z[:, None])
                grad_t[i, j] = (seen - pair[both].sum()) / m
        rest = np.array([grad_e.sum() / m, (np.where(ok[:, 0], yy[:, 0] - post[:, 0, 1], 0)).sum() / m, *grad_t.reshape(-1)])
        g_table += grad_table**2
        g_rest += rest**2
        field.table += (0.5 * grad_table / np.sqrt(g_table)).astype(np.float32)
        move = 0.2 * rest / np.sqrt(g_rest)
        field.bias += move[0]
        field.start += move[1]
        field.trans += move[2:].reshape(2, 2)
    field.trans -= field.trans[0, 0]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.5 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of the bounded training sample."""
    def below(share: float, *columns: str):
        return F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1_000_000)) < int(share * 1_000_000)

    chosen = labels.where("toxic in (0, 1)").where(common.crc_of_id() % FOLDS != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    ids = chosen.where(below(min(1.0, TRAIN_DOCS / max(1, chosen.count())), "doc_id")).limit(2 * TRAIN_DOCS)
    # only the chosen rows leave the scan; repeated ones count once
    both = common.stage(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct(), "sample")
    size = both.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    part = both.where(below(min(1.0, TRAIN_BYTES / max(1, size)), "doc_id", "text"))
    made = part.select("doc_id", "text", "toxic").repartition(1).mapInArrow(_train, "field binary").collect()
    return pickle.loads(made[0]["field"]) if made else train([], [])


@common.freeing
def _train(batches):
    """The bounded sample, in one task, to the field."""
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    rows.sort(key=lambda r: (r[0], r[2], r[1] or ""))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] or "" for r in rows], [r[2] for r in rows]))], pa.binary())], names=["field"])


def judge(texts: pa.Array, field: Field, spans: bool = True) -> tuple[np.ndarray, list[str]]:
    """Scores, and the places (code points) of tokens that are rather toxic than not, as start:end joined by commas."""
    scores, where = np.zeros(len(texts)), [""] * len(texts)
    for lo, hi in slices(texts):
        words = Words(texts.slice(lo, hi - lo))
        p = field.marginals(field.emissions(features(words)), words.first)
        scores[lo:hi] = field.score(field.aggregate(p, words))
        hits = np.flatnonzero(p >= 0.5) if spans else []
        if len(hits):
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            at = points[words.text_start[words.doc[hits]]]
            out: dict[int, list[str]] = {}
            for d, a, b in zip(words.doc[hits].tolist(), (points[words.starts[hits]] - at).tolist(), (points[words.ends[hits]] - at).tolist()):
                out.setdefault(d, []).append(f"{a}:{b}")
            for d, x in out.items():
                where[lo + d] = ",".join(x)
    return scores, where


def _score(field: Field):
    @common.freeing
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            scores, where = judge(batch.column(names.index("text")), field)
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), pa.array(scores), pa.array(where)], names=["doc_id", "score", "offsets"])

    return run


def _keep(field: Field):
    @common.freeing
    def run(batches):
        for batch in batches:
            scores, _ = judge(batch.column(batch.schema.names.index("text")), field, spans=False)
            yield batch.filter(pa.array(scores < 0.5))

    return run


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = docs.mapInArrow(_score(field), "doc_id long, score double, offsets string")
    return out.select("doc_id", (common.crc_of_id() % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offsets")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all columns, without those that score 0.5 or more."""
    return docs.mapInArrow(_keep(fit(docs, labels)), docs.schema)
