"""Toxic spans and scores from a linear-chain conditional random field.

Tokens are lower-cased letter-digit runs, and all tokens of a text are one chain. Each token
has two states, clean and toxic. A token's emission weight sums hashed features of its form (the whole
word, its prefixes and suffixes), so it depends on the word only and is kept per word; transitions tie
neighbours. Training maximises the regularised likelihood of labelled tokens by forward-backward passes over windows
of WINDOW tokens of the training sample.
Where only documents are labelled, tokens are labelled from them: a word or prefix that is seen in several
independent toxic documents and in hardly any clean one marks its tokens there.

Forward-backward marginals over the whole chain give each token's probability: chains are computed in blocks, whose
2 x 2 products carry the messages from block to block, so nothing is cut. Their largest value and their sum, the expected
number of toxic tokens, are turned into a document score by a logistic fit on the training documents;
offsets are the character spans of tokens that are likelier toxic than not.

The training sample is bounded: at most TOXIC_ROWS and CLEAN_ROWS labelled rows, the first in the order of a
hash of their ids, up to TRAIN_CHARS characters in that proportion. Every text is scored whole.

Edge cases: a null or empty text has no tokens and gets the score of an expected count of 0; without labelled
rows of both kinds every score is the share of toxic labels (0 without labels); a document with several
labels counts as toxic if one of them says so; rows that share an id share its label, and in the sample they are as
many rows; repeated rows get equal scores; rows with null ids are scored and never learned from; very long texts are one
chain like any other; other columns, whatever their names, are not read and pass keep_clean as they are; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import in_slices, utf8

TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1200, 2000, 16_000_000
#: One document of the sample gives at most this part of the characters of its class: its first ones.
PARTS = 20
WINDOW, FEATURES, PREFIXES, SUFFIXES = 64, 1 << 18, range(3, 9), (3,)
#: A feature marks tokens if so many independent toxic documents have it, and so large a share of all that do is toxic.
SUPPORT, PRECISION = 4, 0.75
STEPS, RATE, RIDGE = 80, 0.5, 1e-5
#: Marginals below this add nothing to the expected count, or long clean texts would gather one.
FLOOR = 0.2
#: Words that are hashed together, and tokens that are decoded together.
KEPT, SLICE = 100_000, 200_000
ODD = np.uint64(0xD6E8FEB86659FD93)
WORD = re.compile(r"[^\W_]+")


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's features, and which of them it has: one that all words share and that speaks for words not
    seen, the whole word, its prefixes of PREFIXES characters, its suffixes of SUFFIXES.

    All words are hashed at once: a hash is the sum of character x power of ODD over places, mixed."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(n) - n
    power = np.cumprod(np.full(int(n.max(initial=max(SUFFIXES))) + 1, ODD, np.uint64))
    place = np.arange(len(codes)) - np.repeat(first, n)
    terms = np.append(np.uint64(0), np.cumsum(codes * power[place]))  # sums from the first character of all words
    kinds = [(None, n > 0), *((k, n > k) for k in PREFIXES)]
    sums = [np.zeros(len(words), np.uint64), *(terms[first + (n if k is None else np.minimum(k, n))] - terms[first] for k, _ in kinds)]
    has = [np.ones(len(words), bool), *(h for _, h in kinds)]
    for k in SUFFIXES:
        end = first + n
        own = np.zeros(len(words), np.uint64)
        for i in range(k):
            own += codes[np.maximum(end - 1 - i, 0)] * power[i] if len(codes) else np.uint64(0)
        sums.append(own)
        has.append(n > k)
    h = np.stack(sums, axis=1) + np.arange(1, len(sums) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31)), np.stack(has, axis=1)


def flat(forms, columns: slice = slice(None), kind=np.uint64, modulus: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all forms in one array, and how many each form has; made a part of the forms at a time."""
    forms, out, sizes = list(forms), [], []
    for i in range(0, len(forms), KEPT):
        h, has = feature_hashes(forms[i : i + KEPT])
        h, has = h[:, columns], has[:, columns]
        out.append((h[has] % np.uint64(modulus) if modulus else h[has]).astype(kind))
        sizes.append(has.sum(axis=1))
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, kind), np.zeros(0, np.int64))


def marginals(emit: np.ndarray, mask: np.ndarray, step: np.ndarray, start: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded rows, each a chain of its own.

    emit: log odds of toxic against clean by row and place. step: 2 x 2 log potentials. Returns the
    probability of toxic at each place, expected transitions by kind, and the log partition function.
    weight: how many rows each row stands for, in the last two. Messages are kept as the ratio of toxic to clean."""
    (w00, w01), (w10, w11) = np.exp(step)
    rows, places = emit.shape
    weight = np.ones(rows) if weight is None else weight
    odds, on = np.exp(np.clip(emit, -30, 30)).T.copy(), mask.T
    r = np.empty((places, rows))
    r[0] = odds[0] * np.exp(start)
    log_z = np.zeros(rows)
    for t in range(1, places):
        base = w00 + r[t - 1] * w10
        r[t] = np.where(on[t], odds[t] * (w01 + r[t - 1] * w11) / base, r[t - 1])
        log_z += np.where(on[t], np.log(base), 0)
    log_z += np.log1p(r[-1])
    p, moves, s = np.empty((places, rows)), np.zeros((2, 2)), np.ones(rows)
    for t in range(places - 1, -1, -1):
        p[t] = r[t] * s / (1 + r[t] * s)
        if t:
            q = odds[t] * s
            pair = np.stack([np.full(rows, w00), w01 * q, r[t - 1] * w10, r[t - 1] * w11 * q])
            moves += (pair[:, on[t]] / pair[:, on[t]].sum(axis=0) @ weight[on[t]]).reshape(2, 2)
            s = np.where(on[t], (w10 + w11 * q) / (w00 + w01 * q), 1.0)
    return p.T, moves, log_z @ weight


def pad(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every token when texts of these lengths are laid out in rows of WINDOW tokens."""
    n = np.array(lengths, np.int64)
    per = -(-n // WINDOW)
    first = np.concatenate([[0], np.cumsum(per)])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + inside // WINDOW, inside % WINDOW


def chain_marginals(emissions: list[np.ndarray], step: np.ndarray, start: float) -> list[np.ndarray]:
    """The probability of toxic at each place of each chain.

    Each row of WINDOW places gets the product of its steps. Products then carry the forward message from a chain's rows to
    the next ones and the backward message back, and a pass within all rows at once gives every place."""
    lengths = [len(x) for x in emissions]
    if not sum(lengths):
        return [np.zeros(0) for _ in lengths]
    (w00, w01), (w10, w11) = np.exp(step)
    row, place = pad(lengths)
    rows = int(row[-1]) + 1
    odds, on = np.ones((WINDOW, rows)), np.zeros((WINDOW, rows), bool)
    odds[place, row] = np.exp(np.clip(np.concatenate(emissions), -30, 30))
    on[place, row] = True
    per = -(-np.array(lengths, np.int64) // WINDOW)
    per = per[per > 0]
    first = np.zeros(rows, bool)
    head = np.cumsum(per) - per
    first[head] = True
    # Products of (transition, emission); a chain's first place has no transition.
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(WINDOW):
        na, nb, nc, nd = a * w00 + b * w10, (a * w01 + b * w11) * odds[t], c * w00 + d * w10, (c * w01 + d * w11) * odds[t]
        if t == 0:
            na, nb, nc, nd = np.where(first, 1.0, na), np.where(first, 0.0, nb), np.where(first, 0.0, nc), np.where(first, odds[0], nd)
        scale = 1 / (na + nb + nc + nd)
        a, b, c, d = (np.where(on[t], new * scale, old) for new, old in ((na, a), (nb, b), (nc, c), (nd, d)))
    into, back = np.full(rows, np.exp(start)), np.ones(rows)
    for k in range(1, int(per.max())):
        at = head[per > k] + k
        f = into[at - 1]
        into[at] = (b[at - 1] + f * d[at - 1]) / (a[at - 1] + f * c[at - 1])
        at = (head + per - k)[per > k]
        g = back[at]
        back[at - 1] = (c[at] + d[at] * g) / (a[at] + b[at] * g)
    r, p = np.empty((WINDOW, rows)), np.empty((WINDOW, rows))
    before = into
    for t in range(WINDOW):
        after = odds[t] * (w01 + before * w11) / (w00 + before * w10)
        if t == 0:
            after = np.where(first, odds[0] * before, after)
        before = r[t] = np.where(on[t], after, before)
    s = back
    for t in range(WINDOW - 1, -1, -1):
        p[t] = r[t] * s / (1 + r[t] * s)
        q = odds[t] * s
        s = np.where(on[t], (w10 + w11 * q) / (w00 + w01 * q), s)
    return np.split(p[place, row], np.cumsum(lengths)[:-1])


def lowered(text: str) -> tuple[str, np.ndarray | None]:
    """The text in lower case, and for each of its places the place in the text, None where all are the same."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    sizes = np.fromiter((len(c.lower()) for c in text), np.int64, len(text))
    return low, np.append(np.repeat(np.arange(len(text)), sizes), len(text))


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    start: float
    fit: np.ndarray  # of the logistic score, in the order of summary()

    def word_weights(self, words: list[str]) -> np.ndarray:
        ids, sizes = flat(words, kind=np.int64, modulus=FEATURES)
        return np.add.reduceat(self.weights[ids], np.cumsum(sizes) - sizes, dtype=np.float64) if len(words) else np.zeros(0)

    def emissions(self, words: list[str]) -> np.ndarray:
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        return self.word_weights(list(place))[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def token_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        emit = self.emissions([w for x in texts for w in x])
        return self.decode(np.split(emit, np.cumsum([len(x) for x in texts])[:-1])) if texts else []

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        return chain_marginals(emissions, self.step, self.start)

    def score(self, p: np.ndarray) -> float:
        if not self.fit[1:].any():
            return float(self.fit[0])
        return float(1 / (1 + np.exp(-np.clip(self.fit @ summary(p), -30, 30))))

    def score_texts(self, texts: list[str]):
        """(score, spans) of each text; spans: (start, end, probability), characters."""
        at = 0
        while at < len(texts):
            words, n, first = [], 0, at
            while at < len(texts) and n < SLICE:
                words.append(WORD.findall(texts[at].lower()))
                n += len(words[-1])
                at += 1
            for text, p in zip(texts[first:at], self.token_probabilities(words), strict=True):
                spans = []
                if len(p) and p.max() >= 0.5:
                    low, places = lowered(text)
                    spans = [(*m.span(), float(q)) for m, q in zip(WORD.finditer(low), p, strict=True) if q >= 0.5]
                    if places is not None:
                        spans = [(int(places[a]), int(places[b - 1]) + 1, q) for a, b, q in spans]
                yield self.score(p), spans


def summary(p: np.ndarray) -> np.ndarray:
    """Intercept, log expected count, log odds of the largest, and the first and the next two of the expected count."""
    most = float(np.clip(p.max(), 1e-6, 1 - 1e-6)) if len(p) else 1e-6
    count = p[p >= FLOOR].sum()
    return np.array([1.0, np.log(count + 1e-3), np.log(most / (1 - most)), min(count, 1.0), min(max(count - 1, 0.0), 2.0)])


class Sample:
    """Texts as numbers of word forms, which cost a driver far less memory than strings."""

    def __init__(self):
        self.forms: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, words: list[str]) -> None:
        forms = self.forms
        self.texts.append(np.fromiter((forms.setdefault(w, len(forms)) for w in words), np.int32, len(words)))


def independent(texts: list[np.ndarray]) -> list[int]:
    """A group number for each text; texts that agree in one of four min-hashes of word 3-shingles share one, as copies do."""
    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[tuple[int, int], int] = {}
    odd = np.random.default_rng(7).integers(1, 1 << 63, 7, dtype=np.uint64) | np.uint64(1)
    for i, text in enumerate(texts):
        x = text.astype(np.uint64) + np.uint64(1)
        h = x[:-2] * odd[0] + x[1:-1] * odd[1] + x[2:] * odd[2] if len(x) > 2 else x.sum(keepdims=True) * odd[0]
        h ^= h >> np.uint64(29)
        for k in range(4):
            g = h * odd[3 + k]
            j = seen.setdefault((k, int((g ^ (g >> np.uint64(32))).min())), i)
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def label_tokens(sample: Sample, toxic: list[bool], scale: float = 1.0) -> list[np.ndarray]:
    """Token labels from document labels. scale: clean documents that each sampled one stands for."""
    hashes, sizes = flat(sample.forms, slice(1, 2 + len(PREFIXES)))  # the word and its prefixes
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = np.zeros(len(hashes), bool)
    whole[starts] = True  # a word's first feature here is the word itself
    features, at = np.unique(hashes, return_inverse=True)
    counts = np.zeros((2, len(features)))
    members: dict[tuple[bool, int], list[int]] = defaultdict(list)
    for i, g in enumerate(independent(sample.texts)):
        members[toxic[i], g].append(i)
    for (bad, _), texts in members.items():
        forms = np.unique(np.concatenate([sample.texts[i] for i in texts]))
        size = ends[forms] - starts[forms]
        places = np.repeat(starts[forms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        counts[int(bad), np.unique(at[places])] += 1
    good, bad = counts
    sure = (bad >= SUPPORT) & (bad / np.maximum(bad + scale * good, 1) >= PRECISION)
    marks = sure[at] & (whole | (bad[at] >= 2 * SUPPORT))
    hit = np.add.reduceat(marks, starts) > 0 if len(starts) else np.zeros(0, bool)
    return [hit[x] & b for x, b in zip(sample.texts, toxic, strict=True)]


def train(sample: Sample, tags: list[np.ndarray]) -> Model:
    """Fits weights and transitions to labelled tokens."""
    flat_ids, sizes = flat(sample.forms, kind=np.int32, modulus=FEATURES)
    owner, n_forms = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes)
    form, gold = np.concatenate(sample.texts).astype(np.int64), np.concatenate(tags)
    row, place = pad([len(x) for x in sample.texts])
    rows = row[-1] + 1
    mask, truth = np.zeros((rows, WINDOW), bool), np.zeros((rows, WINDOW), bool)
    mask[row, place], truth[row, place] = True, gold
    # Sequences without a toxic token are many and alike; each kept one stands for `stride` of them.
    has = truth.any(axis=1)
    stride = max(1, int((~has).sum() // max(4 * has.sum(), 2000)))
    keep = has | (np.cumsum(~has) % stride == 0)
    number = np.cumsum(keep) - 1
    on = keep[row]
    form, gold, row, place = form[on], gold[on], number[row[on]], place[on]
    mask, truth, weight = mask[keep], truth[keep], np.where(has[keep], 1.0, stride)
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][pairs].astype(int), truth[:, 1:][pairs].astype(int)), np.broadcast_to(weight[:, None], pairs.shape)[pairs])
    theta, step, start = np.zeros(FEATURES), np.zeros((2, 2)), -4.0
    speed, speed_step, speed_start = np.zeros(FEATURES), np.zeros((2, 2)), 0.0
    of_form = np.bincount(form, weights=gold.astype(float), minlength=n_forms)
    for _ in range(STEPS):
        emit = np.zeros(mask.shape)
        emit[row, place] = np.bincount(owner, weights=theta[flat_ids], minlength=n_forms)[form]
        p, moves, _z = marginals(emit, mask, step, start, weight)
        slope = of_form - np.bincount(form, weights=p[row, place] * weight[row], minlength=n_forms)
        slope = np.bincount(flat_ids, weights=slope[owner], minlength=FEATURES) - RIDGE * len(form) * theta
        speed += slope**2
        theta += RATE * slope / np.sqrt(speed + 1e-8)
        slope = seen - moves
        slope -= slope[0, 0]  # one transition is the reference
        speed_step += slope**2
        step += 0.1 * slope / np.sqrt(speed_step + 1e-8)
        slope = truth[:, 0].sum() - (p[:, 0] * weight).sum()
        speed_start += slope**2
        start += 0.1 * slope / np.sqrt(speed_start + 1e-8)
    return Model(theta.astype(np.float32), step, float(start), np.zeros(5))


def calibrate(model: Model, sample: Sample, toxic: list[bool], weights: np.ndarray) -> None:
    """A logistic fit of document labels on the marginals' summary (Newton steps)."""
    of_form = model.word_weights(list(sample.forms))
    rows, batch, held = [], [], 0
    for i, text in enumerate(sample.texts):
        batch.append(of_form[text])
        held += len(text)
        if held >= SLICE or i == len(sample.texts) - 1:
            rows += [summary(p) for p in model.decode(batch)]
            batch, held = [], 0
    x = np.stack(rows)
    y, beta = np.array(toxic, float), np.zeros(5)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (y - q)) - 1e-2 * beta
        curve = (x * (weights * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(5)
        beta = beta + np.linalg.solve(curve, slope)
    model.fit = beta


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from (doc_id, text) and (doc_id, toxic): a bounded sample of the labelled rows, none of them held out.

    Ids are sampled before any text is read, so texts are neither shuffled nor sorted."""
    toxic_of = labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    listed = documents.select("doc_id").distinct().join(toxic_of, "doc_id").withColumn("o", F.xxhash64("doc_id"))
    count = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = {bad: [r["doc_id"] for r in listed.where(F.col("toxic") == bad).orderBy("o", "doc_id").limit(most).collect()] for bad, most in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))}
    place = [(i, n, bad) for bad, ids in picked.items() for n, i in enumerate(ids)]
    wanted = documents.sparkSession.createDataFrame(place, "doc_id long, place int, toxic boolean")  # TOXIC_ROWS + CLEAN_ROWS rows at most
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    budget = {bad: TRAIN_CHARS * most // (TOXIC_ROWS + CLEAN_ROWS) for bad, most in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))}
    # A document gives a bounded part of its class's characters, so that no long one ends the sample.
    most = F.when(F.col("toxic"), budget[True] // PARTS).otherwise(budget[False] // PARTS)
    rows = rows.withColumn("text", F.substring("text", F.lit(1), most))
    used = Window.partitionBy("toxic").orderBy("place", F.xxhash64("text"))
    rows = rows.withColumn("size", F.sum(F.length("text")).over(used)).where(F.col("size") <= F.when(F.col("toxic"), budget[True]).otherwise(budget[False]))
    sample, toxic = Sample(), []
    for r in rows.orderBy(F.desc("toxic"), "place", F.xxhash64("text")).toLocalIterator():
        sample.add(WORD.findall(r["text"].lower()))
        toxic.append(r["toxic"])
    total = sum(count.values())
    if not any(toxic) or all(toxic) or not sample.forms:
        return Model(np.zeros(FEATURES, np.float32), np.zeros((2, 2)), 0.0, np.array([count.get(True, 0) / total if total else 0.0, 0, 0, 0, 0]))
    scale = (count[False] / toxic.count(False)) / (count[True] / toxic.count(True))
    model = train(sample, label_tokens(sample, toxic, scale))
    calibrate(model, sample, toxic, np.where(toxic, 1.0, scale))
    return model


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) for every row: spans are array<struct<start, end, probability>>, in characters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, spans = [], []
            for s, found in shared.value.score_texts([x.as_py().decode("utf-8", "replace") for x in batch.column(1)]):
                scores.append(s)
                spans.append([{"start": a, "end": b, "probability": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).transform(in_slices, run, "doc_id long, score double, spans array<struct<start: int, end: int, probability: double>>")


def keep_clean(df: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of `df`, all columns, whose text scores below the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([s < threshold for s, _ in shared.value.score_texts(texts)], pa.bool_()))

    return df.transform(in_slices, run, df.schema)


def held_out(doc_id="doc_id"):
    """Rows whose label is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
