"""Benchmark decontamination: a block-max BM25 inverted index of test items, queried by every training passage.

Each item is an indexed document of BM25; impacts are divided by the item's score for its own words, so a
passage scores 1 when it holds every word of the item and one threshold serves all items. A text is cut into
overlapping passages, at least twice as long as an item and half overlapping, so that any copy of the item
lies wholly in one passage. Items of up to STRIDE words share their passages; each doubling of the length has its own.

The index holds a posting list for each term, in the order of the items, cut into blocks of BLOCK items with
the largest impact of each. Every passage is a query, and all items at or above the threshold are retrieved,
not a top k:

1. The block maxima of a passage's terms are summed by block, for a batch of passages at a time. A passage
   of which no block reaches the threshold can hold no item and is done; nearly all are.
2. The others run block-max WAND: cursors on their terms' lists stand in the order of their items, and the pivot is
   the first at which the lists' largest impacts sum up to the threshold. If the maxima of the pivot's blocks
   cannot reach it, all cursors before it move behind the nearest block end; else they move to the pivot's item,
   which is scored once all have come there.

Retrieved pairs are verified on words: the passage must hold at least OVERLAP of the item's 5-word shingles,
and of the words of its question and of its answer. The answer is what follows the item's last line break,
or else its last sentence, or else the second half of its words.

Indexes are built on the executors, each of SHARD_BYTES at most (a single item may exceed that), and written. The
driver holds and broadcasts groups of PASS_BYTES at most, one after another; texts are scanned once for each
group, so a benchmark of any size is queried whole.

Edge cases: null or empty items and texts have no words and match nothing; items shorter than 5 words have
one shingle; words of one item that repeat count by BM25's term frequency; each pair of a document's row and an
item (id and text, repeated ones once) gives one result, so documents that repeat, or share an id, or have none, give theirs each; very
long texts are scanned whole, SLICE tokens at a time; other columns, whatever their names, are not read, and
pass keep_clean as they are; no items, or no documents, give no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, in_slices, utf8

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.65, 0.8, 5
BLOCK = 4
#: Bytes of one index, and of the indexes that are broadcast for one scan of the texts.
SHARD_BYTES, PASS_BYTES = 8_000_000, 64_000_000
#: Characters of items that make about one index; words up to which items share their passages.
SHARD_CHARACTERS, STRIDE = 1_000_000, 64
#: Tokens that are scored together.
SLICE = 400_000
#: A term of one in FULL of the blocks counts as a common one.
FULL = 4
EPSILON = 1e-4
find_words = re.compile(r"[^\W_]+").findall


def tokens(text: str) -> list[str]:
    return find_words(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    body = text.strip()
    question, found, answer = body.rpartition("\n")
    if not (found and tokens(question) and tokens(answer)):
        sentences = [x for x in re.split(r"(?<=[.!?])\s+", body) if tokens(x)]
        question, answer = " ".join(sentences[:-1]), sentences[-1] if sentences else ""
    if tokens(question) and tokens(answer):
        return tokens(question), tokens(answer)
    words = tokens(body)
    return words[: len(words) // 2], words[len(words) // 2 :]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def held(part: list[str], words: Counter) -> float:
    """Share of a part's words (repeats counted) that a passage has."""
    return sum(min(n, words[w]) for w, n in Counter(part).items()) / len(part) if part else 1.0


class Index:
    """Posting lists of some items with words, and their block maxima.

    Lists lie one behind another: those of term t are items[first[t] : first[t + 1]], their impacts beside them,
    and its blocks are blocks[first_block[t] : first_block[t + 1]] with the largest impacts beside them."""

    def __init__(self, items: list[tuple[int, str]], n: int, mean: float, frequency: dict[str, int], stride: int = STRIDE):
        self.ids, self.parts, rows = [], [], []
        self.terms: dict[str, int] = {}
        for item_id, text in items:
            words = tokens(text or "")
            if not words:
                continue
            count = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean)
            impacts = {w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in count.items()}
            own = sum(impacts.values())
            rows += [(self.terms.setdefault(w, len(self.terms)), len(self.ids), x / own) for w, x in impacts.items()]
            self.ids.append(item_id)
            self.parts.append((words, *split_item(text)))
        term, item, impact = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((item, term))
        term, self.items, self.impacts = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_blocks = math.ceil(len(self.ids) / BLOCK)
        key, starts = np.unique(term * max(self.n_blocks, 1) + self.items // BLOCK, return_index=True)
        self.blocks = (key % max(self.n_blocks, 1)).astype(np.int32)
        self.maxima = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.zeros(0, np.float32)
        self.first_block = np.searchsorted(key // max(self.n_blocks, 1), np.arange(len(self.terms) + 1))
        self.largest = np.maximum.reduceat(self.impacts, self.first[:-1]) if len(self.terms) else np.zeros(0, np.float32)
        # Terms of many blocks have their maxima in a row of all blocks as well, no more than FULL times what the lists take.
        wide = np.nonzero(np.diff(self.first_block) * FULL >= max(self.n_blocks, 1))[0]
        self.full = np.full(len(self.terms), -1, np.int32)
        self.full[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.n_blocks), np.float32)
        for i, t in enumerate(wide):
            own = slice(self.first_block[t], self.first_block[t + 1])
            self.rows[i, self.blocks[own]] = self.maxima[own]
        self.stride = stride

    def possible(self, keys: list[np.ndarray], threshold: float) -> np.ndarray:
        """Which of some queries (arrays of distinct terms) have a block whose maxima sum to the threshold."""
        flat = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        row, sums = self.full[flat], np.zeros((len(keys), self.n_blocks))
        common = row >= 0
        if common.any():
            own = owner[common]
            starts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
            sums[own[starts]] = np.add.reduceat(self.rows[row[common]], starts, axis=0)
        flat, owner = flat[~common], owner[~common]
        width = (self.first_block[1:] - self.first_block[:-1])[flat]
        at = np.repeat(self.first_block[flat] - np.cumsum(width) + width, width) + np.arange(width.sum())
        sums += np.bincount(np.repeat(owner, width) * self.n_blocks + self.blocks[at], weights=self.maxima[at], minlength=sums.size).reshape(sums.shape)
        return np.nonzero((sums >= threshold - EPSILON).any(axis=1))[0]

    def wand(self, query: np.ndarray, threshold: float):
        """(item, score) of all items at or above the threshold, by block-max WAND over the query's posting lists."""
        least = threshold - EPSILON
        lists = [(self.items[a:b].tolist(), self.impacts[a:b].tolist(), self.blocks[c:d].tolist(), self.maxima[c:d].tolist(), float(self.largest[t])) for t, a, b, c, d in zip(query.tolist(), self.first[query], self.first[query + 1], self.first_block[query], self.first_block[query + 1], strict=True)]
        place = [0] * len(lists)
        live = sorted(range(len(lists)), key=lambda i: lists[i][0][0])
        while live:
            bound = 0.0
            for p, i in enumerate(live):
                bound += lists[i][4]
                if bound >= least:
                    break
            else:
                return
            pivot = lists[live[p]][0][place[live[p]]]
            while p + 1 < len(live) and lists[live[p + 1]][0][place[live[p + 1]]] == pivot:
                p += 1
            before, block = live[: p + 1], pivot // BLOCK
            bound, following = 0.0, lists[live[p + 1]][0][place[live[p + 1]]] if p + 1 < len(live) else math.inf
            for i in before:
                k = bisect_left(lists[i][2], block)
                if k < len(lists[i][2]) and lists[i][2][k] == block:
                    bound += lists[i][3][k]
            if bound < least:  # no item of the pivot's block can do it: go on behind the block, or at the next list's item
                target, moved = min((block + 1) * BLOCK, following), before
            elif lists[live[0]][0][place[live[0]]] == pivot:
                score = sum(lists[i][1][place[i]] for i in before)
                if score >= least:
                    yield pivot, score
                target, moved = pivot + 1, before
            else:
                target, moved = pivot, [i for i in before if lists[i][0][place[i]] < pivot]
            for i in moved:
                place[i] = bisect_left(lists[i][0], target, place[i])
            live = sorted((i for i in live if place[i] < len(lists[i][0])), key=lambda i: lists[i][0][place[i]])

    def retrieve(self, docs: list[np.ndarray], threshold: float):
        """(doc, passage start, item, score) of all passages of the given term id arrays (-1: not an index term)."""
        starts = [(d, s) for d, t in enumerate(docs) for s in range(0, max(1, len(t) - self.stride), self.stride)]
        keys = [np.unique(docs[d][s : s + 2 * self.stride]) for d, s in starts]
        keys = [k[1:] if len(k) and k[0] < 0 else k for k in keys]
        full = [p for p, k in enumerate(keys) if len(k)]
        if not self.ids or not full:
            return
        for row in self.possible([keys[p] for p in full], threshold):
            for item, score in self.wand(keys[full[row]], threshold):
                yield (*starts[full[row]], item, score)

    def verify(self, item: int, words: list[str]) -> tuple[float, float, float]:
        """Overlap of the item's shingles, question and answer with a passage's words."""
        whole, question, answer = self.parts[item]
        have, own, count = shingles(words), shingles(whole), Counter(words)
        if len(whole) < SHINGLE:
            n = len(whole)
            together = float(any(words[i : i + n] == whole for i in range(len(words) - n + 1)))
        else:
            together = len(own & have) / len(own)
        return together, held(question, count), held(answer, count)

    def matches(self, texts: list[list[str]], threshold: float, overlap: float) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (score, shingles, question, answer) of the best passage of each verified pair. texts: lists of words."""
        lookup, best = self.terms.get, {}
        ids = [np.fromiter((lookup(x, -1) for x in words), np.int32, len(words)) for words in texts]
        for d, s, i, score in self.retrieve(ids, threshold):
            found = self.verify(i, texts[d][s : s + 2 * self.stride])
            if min(found) >= overlap:
                best[d, i] = max(best.get((d, i), ()), (score, *found))
        return best


def scan(texts: Iterator[str], indexes: list[Index], threshold: float, overlap: float):
    """(text, item id, score, shingles, question, answer) of each verified pair; about SLICE tokens are held at a time."""
    first, words, held_back = 0, [], 0

    def flush():
        for index in indexes:
            for (d, i), found in sorted(index.matches(words, threshold, overlap).items()):
                yield (first + d, index.ids[i], *found)

    for text in texts:
        words.append(tokens(text))
        held_back += len(words[-1])
        if held_back >= SLICE:
            yield from flush()
            first, words, held_back = first + len(words), [], 0
    yield from flush()


def length_class(n_words: int) -> int:
    """The passage step of an item: STRIDE, doubled until the item fits."""
    return max(STRIDE, 1 << max(n_words - 1, 0).bit_length())


def build(items: DataFrame, work: WorkArea) -> DataFrame:
    """(shard, part, bytes, data): pickled indexes of (item_id, text), built on the executors and written."""

    def described(batches):
        for batch in batches:
            words = [tokens(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([length_class(len(w)) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["item_id", "text", "words", "step", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = work.write(rows.transform(in_slices, described, "item_id long, text string, words long, step long, terms array<string>").where("words > 0"), "items")
    total = rows.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum(F.length("text")).alias("characters")).first()
    n, mean, limit = max(total["n"], 1), (total["words"] or 1) / max(total["n"], 1), SHARD_BYTES
    shards = max(1, math.ceil((total["characters"] or 0) / SHARD_CHARACTERS))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    needed = placed.select(F.col("step").alias("to_step"), F.col("shard").alias("to_shard"), F.explode("terms").alias("term")).distinct().join(frequency, "term")

    def make(own: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        df = dict(zip(terms["term"].tolist(), terms["df"].tolist(), strict=True))
        own = own.sort_values(["item_id", "text"])
        out, waiting = [], [[(None if i != i else int(i), t) for i, t in zip(own["item_id"].tolist(), own["text"].tolist(), strict=True)]]
        while waiting:
            part = waiting.pop()
            data = pickle.dumps(Index(part, n, mean, df, int(own["step"].iloc[0])), protocol=5)
            if len(data) > limit and len(part) > 1:
                waiting += [part[len(part) // 2 :], part[: len(part) // 2]]
            else:
                out.append((int(own["step"].iloc[0]), int(own["shard"].iloc[0]), len(out), len(data), data))
        return pd.DataFrame(out, columns=["step", "shard", "part", "bytes", "data"])

    made = placed.select("step", "shard", "item_id", "text").groupBy("step", "shard").cogroup(needed.groupBy("to_step", "to_shard")).applyInPandas(make, "step long, shard long, part long, bytes long, data binary")
    return work.write(made, "indexes", codec="uncompressed")


def passes(indexes: DataFrame) -> Iterator[list[bytes]]:
    """The pickled indexes in groups of PASS_BYTES at most, or of a single one; the driver reads one group at a time."""
    listed = [(r["step"], r["shard"], r["part"], r["bytes"]) for r in indexes.select("step", "shard", "part", "bytes").orderBy("step", "shard", "part").collect()]
    groups: list[list[tuple]] = []
    held = 0
    for *key, size in listed:
        if not groups or held + size > PASS_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(tuple(key))
        held += size
    for group in groups:
        wanted = indexes.sparkSession.createDataFrame(group, "step long, shard long, part long")
        yield [bytes(r["data"]) for r in indexes.join(F.broadcast(wanted), ["step", "shard", "part"]).orderBy("step", "shard", "part").collect()]


def _loaded(shared) -> list[Index]:
    return [pickle.loads(x) for x in shared.value]


def contaminated(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, shingle_overlap, question_overlap, answer_overlap): one row for each verified pair."""
    spark = df.sparkSession
    names = ["doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
    schema = "doc_id long, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for group in passes(build(items, WorkArea(spark, "benchmark"))):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            indexes = _loaded(shared)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[d], *rest) for d, *rest in scan((x.as_py().decode("utf-8", "replace") for x in batch.column(1)), indexes, threshold, overlap)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

        out = out.union(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).transform(in_slices, run, schema))
    return out


def keep_clean(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `df`, all columns, whose text matches no item."""
    work = WorkArea(df.sparkSession, "decontaminate")
    for n, group in enumerate(passes(build(items, work))):
        if n:  # one group's indexes are loaded in a worker at a time
            df = work.write(df, f"pass-{n}")
        shared = df.sparkSession.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            indexes = _loaded(shared)
            for batch in batches:
                texts = (x.as_py() or "" for x in batch.column(batch.schema.get_field_index("text")))
                hit = {d for d, *_ in scan(texts, indexes, threshold, overlap)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        df = df.transform(in_slices, run, df.schema)
    return df


#: The same by every score of every passage, with the constants above written out; scores have six digits.
ORACLE = r"""
WITH i0 AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
i AS (SELECT row_number() OVER () AS k, item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM i0),
items AS (SELECT *, greatest(64, CAST(2 ** ceil(log2(len(w))) AS BIGINT)) AS step FROM i WHERE len(w) > 0),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM items),
tf AS (SELECT k, len(w) AS size, unnest(w) AS term FROM items), tfs AS (SELECT k, size, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
raw AS (SELECT k, term, tf, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) AS x FROM tfs JOIN df USING (term), n),
impact AS (SELECT k, term, x / sum(x) OVER (PARTITION BY k) AS x FROM raw),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
steps AS (SELECT DISTINCT step FROM items),
p AS (SELECT r, doc_id, step, s, w[s + 1 : s + 2 * step] AS w FROM (SELECT r, doc_id, step, w, unnest(range(0, greatest(1, len(w) - step), step)) AS s FROM d, steps)),
pt AS (SELECT DISTINCT r, step, s, unnest(w) AS term FROM p),
hits AS (SELECT r, t.step, s, x.k, sum(x.x) AS score FROM pt t JOIN impact x USING (term) JOIN items i ON i.k = x.k AND i.step = t.step GROUP BY ALL HAVING sum(x.x) >= 0.65 - 1e-4),
cut AS (SELECT k, item_id, step, w, body, regexp_extract(body, '^(.*)\n', 1, 's') AS q1, regexp_extract(body, '([^\n]*)$', 1) AS a1, list_filter(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS sentences FROM items),
halves AS (SELECT *, contains(body, chr(10)) AND regexp_matches(q1, '[\p{L}\p{N}]') AND regexp_matches(a1, '[\p{L}\p{N}]') AS by_line FROM cut),
parts AS (SELECT k, item_id, step, w, CASE WHEN by_line THEN regexp_extract_all(lower(q1), '[\p{L}\p{N}]+') WHEN len(sentences) > 1 THEN regexp_extract_all(lower(array_to_string(sentences[1 : len(sentences) - 1], ' ')), '[\p{L}\p{N}]+') ELSE w[1 : len(w) // 2] END AS q,
  CASE WHEN by_line THEN regexp_extract_all(lower(a1), '[\p{L}\p{N}]+') WHEN len(sentences) > 1 THEN regexp_extract_all(lower(sentences[len(sentences)]), '[\p{L}\p{N}]+') ELSE w[len(w) // 2 + 1 : len(w)] END AS a FROM halves),
m AS (SELECT h.r, p.doc_id, h.s, h.k, item_id, round(score, 6) AS score, p.w AS pw, parts.w AS iw, q, a FROM hits h JOIN p USING (r, step, s) JOIN parts ON parts.k = h.k),
o AS (SELECT *, list_distinct(list_transform(range(greatest(1, len(iw) - 4)), lambda j: array_to_string(iw[j + 1 : j + 5], ' '))) AS own, list_distinct(list_transform(range(greatest(1, len(pw) - 4)), lambda j: array_to_string(pw[j + 1 : j + 5], ' '))) AS have FROM m),
v AS (SELECT r, doc_id, item_id, k, score, len(list_intersect(own, have)) / CAST(len(own) AS DOUBLE) AS sh,
  list_sum(list_transform(list_distinct(q), lambda t: least(len(list_filter(q, lambda x: x = t)), len(list_filter(pw, lambda x: x = t))))) / CAST(len(q) AS DOUBLE) AS qo,
  list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(pw, lambda x: x = t))))) / CAST(len(a) AS DOUBLE) AS ao FROM o),
b AS (SELECT r, doc_id, item_id, k, max((score, sh, qo, ao)) AS best FROM v WHERE least(sh, qo, ao) >= 0.8 GROUP BY r, doc_id, item_id, k)
SELECT doc_id, item_id, best[1] AS score, best[2] AS shingle_overlap, best[3] AS question_overlap, best[4] AS answer_overlap FROM b
"""
