"""Toxicity scores from class-conditional Kneser-Ney models.

An expression is a run of letters, A-Z lower-cased, spelt in bytes between a start and an
end mark; a run of over PIECE bytes, as in scripts without spaces, is read in pieces of as
many. Each class has a Kneser-Ney model of the next byte given up to ORDER - 1 before it in
the expression: absolute discounts on the class's own counts, and the mass they free, with
that of STRENGTH further tokens, goes to a model of the counts of both classes together,
which in turn backs off to shorter contexts by continuation counts. So an expression that
training saw rarely, or never, is smoothed by shared counts, alike in both classes.

Most of a toxic document is ordinary text. So the toxic class writes a share, SHARE, of its
expressions by the toxic model and the rest by the ordinary one, the ordinary class all by
the ordinary model. Both likelihoods are of the whole text, each expression as often as it
stands there. A document's evidence is the logarithm of the one over the other, divided by
the number of expressions: every ordinary expression speaks for the ordinary class, by at
most -log(1 - SHARE), and what languages or subjects differ in by chance between the classes
adds up to little. The score is a logistic curve of the evidence, on a scale that is linear
near its least value and logarithmic above.

What the two models differ in is two tables: for every n-gram seen, and for every context
seen with a byte that wasn't, the logarithm of the ratio; all else is zero, since the
shared part cancels. These tables are a file in the shared folder, which each task reads;
neither the driver nor an idle worker holds them.

Training reads labelled rows that are not held out. It takes at most TRAIN_DOCUMENTS rows
of each class, those with the smallest hashed ids, so the tables are bounded.
The curve is fitted across PARTS parts of them, each scored by a model of the others, and
weighted to the classes' true shares; the final model has them all. Expressions are counted
by the executors, and one task of theirs trains the models; all documents are scored whole.

Defined results: null and empty texts and texts without letters have evidence zero; null
labels are ignored; of a doc_id with several labels the largest counts; without training
rows of both classes every score is about the share of toxic ones; repeated rows are
scored each; a null doc_id is held out (null counts as remainder 0); a text of any length is
read whole, a batch at a time; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, freeing, opened, work_dir

ORDER = 9
DISCOUNT = 0.75
#: Tokens that the shared model counts for in each context of a class.
STRENGTH = 8.0
#: Of a toxic document's expressions, those that the toxic model writes.
SHARE = 0.01
#: Bytes of an expression at most.
PIECE = 64
TRAIN_DOCUMENTS = 4000
#: Parts of the training rows that the curve is fitted across.
PARTS = 3
FOLDS = 5
#: Distinct expressions that a task remembers; beyond it the memory starts anew.
WORDS_HELD = 500_000
START, STOP = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z; letters and bytes of longer characters stay; all else is white space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The expressions of a text, in order."""
    found = text.translate(_LETTERS).split()
    if found and len(max(found, key=len)) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by FOLDS; 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


# --- spelling -------------------------------------------------------------------------------------


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their marks, the place of each in its word, and the number of its word."""
    joined = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), dtype=np.uint8)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)
    return joined, np.arange(len(joined), dtype=np.int32) - np.repeat(starts, sizes), np.repeat(np.arange(len(words), dtype=np.int32), sizes)


def _hashes(joined: np.ndarray, place: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For k from 0 to order: the hash of the k bytes that end at each place; with fewer there, of all of them."""
    h, power = np.zeros(len(joined), dtype=np.uint64), np.uint64(1)
    yield h
    for k in range(1, order + 1):
        with np.errstate(over="ignore"):
            power = power * _BASE
            back = np.zeros(len(joined), dtype=np.uint64)
            back[k - 1 :] = joined[: max(0, len(joined) - k + 1)]
            back += np.uint64(257)
            back *= power
            back[place < k - 1] = 0
            np.add(h, back, out=back)
            h = back
        yield h


def _before(h: np.ndarray) -> np.ndarray:
    """The hash at the place before each: that of the context."""
    return np.concatenate([[np.uint64(0)], h[:-1]])


def _last_two(h: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    before = now = next(h)
    for x in h:
        before, now = now, x
    return before, now


def _mixed(gram: np.ndarray) -> np.ndarray:
    """Spreads hashes of sums, so that sums of unlike n-grams don't meet."""
    with np.errstate(over="ignore"):
        gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        gram = (gram ^ (gram >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return gram ^ (gram >> np.uint64(32))


# --- training -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Logarithms of ratios by n-gram and by context, and the curve (a, b) over a document's evidence."""

    order: int
    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """The logarithm of each word's likelihood under the toxic model over that under the ordinary one."""
        if not words or not len(self.grams):
            return np.zeros(len(words))
        joined, place, number = _spelt(words)
        shorter, gram = _last_two(_hashes(joined, place, self.order))
        gram, context = _mixed(gram), _mixed(_before(shorter))
        at = place > 0
        gram, context, number = gram[at], context[at], number[at]
        i = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[i] == gram
        value = np.where(known, self.gram_ratio[i], 0.0)
        rest = np.flatnonzero(~known)
        j = np.minimum(np.searchsorted(self.contexts, context[rest]), len(self.contexts) - 1)
        value[rest] = np.where(self.contexts[j] == context[rest], self.context_ratio[j], 0.0)
        return np.bincount(number, weights=value, minlength=len(words))

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """The logarithm of each word's likelihood in a toxic document over that in an ordinary one."""
        return np.log1p(SHARE * np.expm1(np.minimum(self.ratios(words), 500.0)))


def scaled(evidence: np.ndarray) -> np.ndarray:
    """Evidence on the curve's scale: it rises with it, by ever less where a few words decide."""
    return np.log1p(np.maximum(evidence / -np.log1p(-SHARE) + 1, 0))


_KINDS = {"grams": "<u8", "gram_ratio": "<f4", "contexts": "<u8", "context_ratio": "<f4"}


@dataclass(frozen=True)
class Stored:
    """A model in a file of the shared folder."""

    uri: str
    part: int
    order: int
    curve: tuple[float, float] = (1.0, 0.0)

    def load(self) -> Model:
        system, path = opened(self.uri)
        names = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
        for name in names:
            table = pq.read_table(name, filesystem=system, filters=[("part", "=", self.part)])
            if table.num_rows:
                return Model(self.order, *(np.frombuffer(table[a][0].as_buffer(), dtype=k) for a, k in _KINDS.items()), self.curve)
        raise FileNotFoundError(f"{self.uri}: no model of part {self.part}")


def _tally(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the first place of each, the number of each key's key, and sums of the weights."""
    found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, inverse, *(np.bincount(inverse, weights=w, minlength=len(found)) for w in weights)


def _by_last_byte(joined: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """The places of bytes that have one before them, in parts by that byte: contexts that aren't empty meet in one part, so each is counted alone."""
    at = np.flatnonzero(place[1:] > 0).astype(np.int32) + np.int32(1)
    behind = joined[at - 1]
    for byte in np.flatnonzero(np.bincount(behind, minlength=256)):
        yield at[behind == byte]


def _first_order(joined: np.ndarray, place: np.ndarray, discount: float) -> np.ndarray:
    """The shared probability of each byte after the empty context: by the bytes it is seen after."""
    pairs = np.zeros((256, 256), dtype=bool)
    for some in _by_last_byte(joined, place):
        pairs[joined[some[0] - 1], joined[some]] = True
    cont = pairs.sum(axis=0).astype(float)
    return (np.maximum(cont - discount, 0) + discount * np.count_nonzero(cont) * (1 / 256)) / max(cont.sum(), 1)


def train(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, discount: float = DISCOUNT, strength: float = STRENGTH) -> Model:
    """Model from distinct words and how often each class has them."""
    none = np.zeros(0)
    if not words or not toxic.sum() or not ordinary.sum():
        return Model(order, none.astype(np.uint64), none, none.astype(np.uint64), none)
    joined, place, number = _spelt(words)
    first_order = _first_order(joined, place, discount)

    def smoothed(n: np.ndarray, lower: np.ndarray, strength: float, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of counts by n-gram: the probability of each, and by context the share that goes to lower."""
        total = np.maximum(np.bincount(of, weights=n, minlength=size) + strength, 1e-9)
        rest = (strength + discount * np.bincount(of, weights=n > 0, minlength=size)) / total
        return np.maximum(n - discount, 0) / total[of] + rest[of] * lower, rest

    def tables(at: np.ndarray) -> tuple[np.ndarray, ...]:
        """N-grams and contexts of some places with their ratios."""
        deep, power = place[at], np.uint64(1)

        def byte(back: int, power: np.uint64) -> np.ndarray:
            """What the byte so far back adds to a hash; 0 before the word."""
            h = joined[np.maximum(at - back, 0)].astype(np.uint64)
            h += np.uint64(257)
            h *= power
            h[deep < back] = 0
            return h

        # hashes of k bytes, of the k - 1 before the last and of k + 1, as of _hashes
        now, behind, shared = byte(0, _BASE), np.zeros(len(at), dtype=np.uint64), first_order[joined[at]]
        for k in range(1, order):
            power = power * _BASE
            ahead = now + byte(k, power * _BASE)
            if k > 1:  # shared: continuation counts of shorter n-grams, from the distinct n-grams one byte longer
                some = np.flatnonzero(deep >= k)  # a byte stands before the n-gram
                gram, of_some, lower = now[some], behind[some], shared[some]
                _, first = np.unique(ahead[some], return_index=True)
                grams, where, _, cont = _tally(gram[first], np.ones(len(first)))
                contexts, _, _, total, kinds = _tally(of_some[first][where], cont, np.ones(len(where)))
                i, j = np.searchsorted(grams, gram), np.searchsorted(contexts, of_some)
                shared[some] = (np.maximum(cont[i] - discount, 0) + discount * kinds[j] * lower) / total[j]
            behind, now = behind + byte(k, power), ahead
        grams, first, _, *counts = _tally(_mixed(now), *[n[number[at]] for n in (toxic, ordinary)])
        contexts, of = np.unique(_mixed(behind)[first], return_inverse=True)
        both, _ = smoothed(counts[0] + counts[1], shared[first], 0.0, of, len(contexts))
        (p, p_rest), (q, q_rest) = (smoothed(n, both, strength, of, len(contexts)) for n in counts)
        logs, rests = ([np.log(np.maximum(x, 1e-300)) for x in pair] for pair in ((p, q), (p_rest, q_rest)))
        return grams, (logs[0] - logs[1]).astype(np.float32), contexts, (rests[0] - rests[1]).astype(np.float32)

    # all orders of one part, then the next: those of all places would not fit
    with np.errstate(over="ignore"):
        found = [tables(at) for at in _by_last_byte(joined, place)]
    ordered = []
    for keys, values in ((0, 1), (2, 3)):
        key = np.concatenate([x[keys] for x in found])
        i = np.argsort(key)
        ordered += [key[i], np.concatenate([x[values] for x in found])[i]]
    return Model(order, *ordered)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, lightly pulled to zero."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * x).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _trained(counted: DataFrame, order: int) -> list[Stored]:
    """Models without each part, then that of all parts, from (word, o0, .., t0, ..).

    One task trains them one after another, so that neither the driver nor two tasks of one
    executor hold their arrays; the words are bounded by the rows that fit takes.
    """
    path = work_dir(counted.sparkSession, "toxicity")
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for b in batches:
            words += b.column(0).to_pylist()
            counts.append(np.array([b.column(i + 1).to_numpy() for i in range(2 * PARTS)], dtype=float))
        n = np.concatenate([np.zeros((2 * PARTS, 0)), *counts], axis=1).reshape(2, PARTS, len(words))
        counts.clear()
        for part in range(PARTS + 1):
            ordinary, toxic = n.sum(axis=1) - (n[:, part] if part < PARTS else 0)
            some = np.flatnonzero(toxic + ordinary)
            model = train([words[i] for i in some], toxic[some], ordinary[some], order)
            yield pa.RecordBatch.from_pydict({"part": [part]} | {a: [getattr(model, a).astype(k).tobytes()] for a, k in _KINDS.items()})

    schema = "part long, " + ", ".join(f"{a} binary" for a in _KINDS)
    counted.coalesce(1).sortWithinPartitions("word").mapInArrow(run, schema).write.option("parquet.block.size", 1 << 20).parquet(path)
    return [Stored(path, k, order) for k in range(PARTS + 1)]


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, limit: int = TRAIN_DOCUMENTS) -> Stored:
    """Model from docs (doc_id, text) and labels (doc_id, toxic), held-out ids left out."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    marked = marked.where(fold(F.col("doc_id")) != 0)
    share = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = share.get(True, 0) / max(1, sum(share.values()))
    order_by = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = marked.where("toxic").orderBy(*order_by).limit(limit).unionByName(marked.where("not toxic").orderBy(*order_by).limit(limit))
    taken = cut(taken.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), PARTS).cast("int")))
    # at most 2 x limit ids
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(taken), "doc_id").select("doc_id", "toxic", "part", "text"))
    names = [f"{c}{k}" for c in "ot" for k in range(PARTS)]

    @freeing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in names]
        for b in batches:
            for toxic, part, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found[toxic * PARTS + part].update(words_of(text or b""))
        every = list(set().union(*found))
        for i in range(0, len(every), 50_000):
            words = every[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary())} | {n: pa.array([c[w] for w in words], pa.int64()) for n, c in zip(names, found, strict=True)})

    schema = "word binary, " + ", ".join(f"{n} long" for n in names)
    counted = sample.select("toxic", "part", "text").mapInArrow(count, schema).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    *parts, whole = _trained(cut(counted), order)

    # the curve is set by documents that the model of their part hasn't seen
    by_part = sample.select("doc_id", "part", "text").repartition(4 * PARTS, "part").sortWithinPartitions("part")
    seen = _evidence(by_part, parts).join(F.broadcast(taken), "doc_id").select("evidence", "toxic").toArrow()
    x, y = seen["evidence"].to_numpy(), seen["toxic"].to_numpy(zero_copy_only=False).astype(float)
    if not 0 < y.sum() < len(y):
        curve = (0.0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    else:
        curve = fit_curve(x, y, np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean())))
    return replace(whole, curve=curve)


# --- scoring --------------------------------------------------------------------------------------


def _evidence(docs: DataFrame, models: Sequence[Model | Stored]) -> DataFrame:
    """(doc_id, evidence) of docs (doc_id, part, text as binary), each by the model of its part."""
    of = _sender(docs, models)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, evidence in _weighed(batches, of, 2, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(evidence)], ["doc_id", "evidence"])

    return docs.mapInArrow(run, "doc_id long, evidence double")


def _sender(docs: DataFrame, models: Sequence[Model | Stored]) -> Callable[[int], Model]:
    """What gives a task the model of a part: from its file, or by broadcast if it is in the driver's memory."""
    if all(isinstance(m, Stored) for m in models):
        return lambda part: models[part].load()
    held = docs.sparkSession.sparkContext.broadcast(list(models))
    return lambda part: held.value[part]


def _weighed(batches: Iterator[pa.RecordBatch], of: Callable[[int], Model], text: int, part: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the evidence of its rows; text, part: numbers of those columns. One model is held at a time."""
    now, model, known = None, None, {}
    for b in batches:
        out = np.zeros(b.num_rows)
        parts = b.column(part).to_pylist() if part is not None else [0] * b.num_rows
        for i, (k, t) in enumerate(zip(parts, b.column(text).cast(pa.binary()), strict=True)):
            words = words_of(t.as_py() or b"")
            if not words:
                continue
            if k != now:
                now, model, known = k, of(k), {}
            distinct = set(words)
            if missing := distinct.difference(known):
                if len(known) + len(missing) > WORDS_HELD:
                    known.clear()
                    missing = distinct
                new = list(missing)
                known.update(zip(new, model.evidence(new).tolist(), strict=True))
            out[i] = sum(map(known.__getitem__, words)) / len(words)
        yield b, scaled(out)


def score(docs: DataFrame, model: Model | Stored) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text)."""
    a, b = model.curve
    found = _evidence(docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("part"), F.col("text").cast("binary").alias("text")), [model])
    p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("evidence") * a + b, F.lit(-500.0)), F.lit(500.0))))
    return found.select("doc_id", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def score_held_out(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) by a model of the labelled rows that are not held out."""
    return score(docs, fit(docs, labels, **options)).withColumn("held_out", fold(F.col("doc_id")) == 0)


def drop_toxic(docs: DataFrame, model: Model | Stored) -> DataFrame:
    """docs, with all their columns, without the rows that the model predicts to be toxic."""
    of, text, (a, b) = _sender(docs, [model]), docs.columns.index("text"), model.curve

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, evidence in _weighed(batches, of, text, None):
            yield batch.filter(pa.array(a * evidence + b < 0))

    return docs.mapInArrow(run, docs.schema)
