"""Secret scans with a random forest that removes false positives.

Patterns find candidates: private key blocks, tokens with known prefixes, quoted or bare values assigned to
names, passwords in addresses, and long runs of token characters with a digit. A random forest then scores each candidate on its
length, its character transitions (class changes, and how likely its character pairs are in words and in
random strings), how much of it dictionary words cover (a short English list and the commonest words of the corpus), whether it is part of a path or address, and the words
beside it. The forest is trained on labelled findings: those the caller gives, at most FINDINGS of them, or
else as many that a seeded generator writes: keys of several alphabets in assignments and headers against
checksums, commit ids, UUIDs, card numbers, versions, placeholders, paths, addresses and long words.

Edge cases: a null or empty text has no candidates; overlapping candidates are reduced to the one that starts
first (the longest of those); offsets are characters; ids may be null or repeat, each row is scanned by
itself, so repeated rows give the same; a score of SECRET counts as a secret; one very long text is scanned whole; other
columns, whatever their names, are not read by scan and pass redact as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, ascii_lower, in_slices, utf8
from tidewrack.llm.trees import Trees, forest

FINDINGS, SEED, SECRET, BESIDE = 6000, 11, 0.5, 40
#: A corpus gives its words with more than 1/WORDS of all places, fewer than WORDS words; and their lengths.
WORDS, SHORTEST_WORD, LONGEST_WORD = 50_000, 3, 14
#: Names that secrets go by, and names of harmless long values.
NAMES = "token secret password passwd pwd apikey api_key api-key access_key access-key auth authorization bearer credential credentials private_key client_secret".split()
HARMLESS = "sha sha1 sha256 md5 checksum digest hash commit revision rev uuid guid etag version build id isbn doi serial example sample placeholder test dummy public integrity fingerprint".split()
#: A small dictionary of common words and parts of names.
DICTIONARY = "the and for that with this from have not are was but all can had her one our out day get has him his how man new now old see two way who did its let put say she too use about after again also back because been before being between both came come could each even find first give good great hand here high home into just know large last life like line little live long look made make many more most much must name never next number only other over part people place right same should small some such take tell than them then there these they thing think time under until very water well went were what when where which while will work world would write year your user file data page list item type value index config default local system server client image style class main content".split()
_NAMED = "|".join(sorted({re.sub("[_-]", "[_-]?", n) for n in NAMES}, key=lambda n: (-len(n), n)))
#: Alternatives: key blocks, tokens with known prefixes, values assigned to a name that holds one of NAMES, bearer headers,
#: passwords in addresses, long runs. Names and runs begin where an identifier does and are read once, so time grows with the text.
PATTERN = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN).)*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Z][A-Za-z-]*: [^\n]*)*(?:(?:\\[rn]|\s)+[A-Za-z0-9+/=]{32,})*(?:(?:\\[rn]|\s)+[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*(?:\n|\Z)))?)"
    r"|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bxox[abpr]-[A-Za-z0-9-]{10,}|\bsk[-_][A-Za-z0-9_-]{20,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    r"|(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?i:" + _NAMED + r")s?(?:[0-9]{1,9})?(?![A-Za-z0-9]))[A-Za-z0-9_-]++\\?[\"']?[^\w\s\"']*\s*[:=][^\w\s\"'\\]*\s*(?i:(?:bearer|basic)\s+)?(?:\\\"((?:[^\"\\\n]|\\[^\"\n]){8,})\\\"|\"((?:[^\"\\\n]|\\.){8,})\"|'((?:[^'\\\n]|\\.){8,})'|([^\s\"',;]{8,}))"
    r"|(?i:\bbearer)[ \t]+([A-Za-z0-9._~+/=-]{8,})"
    r"|://[^\s/:@\"'<>]*+:(?P<address>[^\s@/\"'<>]{3,})@"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}",
    re.DOTALL,
)
KINDS = ((re.compile(r"-----BEGIN"), "private-key"), (re.compile(r"(?:AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk[-_])"), "prefixed"), (re.compile(r"eyJ"), "web-token"))
WORD = re.compile(r"[a-z][a-z0-9_-]*")


def candidates(text: str):
    """(start, end, kind) of disjoint candidates."""
    for m in PATTERN.finditer(text):
        group = m.lastindex or 0
        start, end = m.span(group)
        yield start, end, "address" if m.lastgroup else "assigned" if group else next((kind for p, kind in KINDS if p.match(text, start)), "run")


def _classes(value: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]


class Lexicon:
    """Words, and the log odds of character pairs in them against uniform letters."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        count = Counter(w[i : i + 2] for w in self.words for i in range(len(w) - 1))
        total = sum(count.values())
        self.pairs = {a + b: math.log((count[a + b] + 0.3) / (total + 0.3 * 676) * 676) for a in string.ascii_lowercase for b in string.ascii_lowercase}

    def covered(self, low: str) -> int:
        """Characters that words cover, read from the left, the longest word first."""
        at = found = 0
        while at < len(low):
            n = next((n for n in range(min(LONGEST_WORD, len(low) - at), SHORTEST_WORD - 1, -1) if low[at : at + n] in self.words), 0)
            found += n
            at += n or 1
        return found


ENGLISH = Lexicon(DICTIONARY)


def lexicon(df: DataFrame, most: int = WORDS) -> Lexicon:
    """DICTIONARY and the words of (text), of ASCII letters alone, that have more than 1/most of the places: fewer than `most` rows come to the driver."""
    word = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit("[a-zÀ-ÿ]+"), 0)).alias("word")
    counted = df.select(word).where(F.char_length("word").between(SHORTEST_WORD, LONGEST_WORD) & F.col("word").rlike("^[a-z]+$")).groupBy("word").count()
    counted = WorkArea(df.sparkSession, "lexicon").write(counted, "words")
    places = counted.agg(F.sum("count")).first()[0] or 0
    return Lexicon({*DICTIONARY, *(r["word"] for r in counted.where(F.col("count") * most > places).collect())})


def describe(text: str, start: int, end: int, known: Lexicon = ENGLISH) -> list[float]:
    """Features of a candidate."""
    value, low = text[start:end], text[start:end].lower()
    n = len(value)
    kinds = _classes(value)
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1)
    odds = [known.pairs[p] for p in map("".join, zip(low, low[1:], strict=False)) if p in known.pairs]
    counts = [low.count(c) / n for c in set(low)]
    entropy = -sum(p * math.log2(p) for p in counts)
    covered = known.covered(low) / n
    longest = max((len(x) for x in re.findall(r"[a-z]+", low)), default=0)
    left, right = text[max(0, start - BESIDE) : start].lower(), text[end : end + BESIDE].lower()
    before, after = WORD.findall(left)[-4:], WORD.findall(right)[:3]
    parts = {p for w in before for p in (w, *re.split(r"[_-]", w))}
    glued = text[max(0, start - 1) : start], text[end : end + 1]
    assigned = bool(re.search(r"[:=][^\w\s\"']*\s*[\"']?$", left))
    return [
        n, math.log(n), *share, changes, sum(odds) / len(odds) if odds else 0.0, len(odds) / max(n - 1, 1), entropy, max(counts), covered, longest,
        len(set(low)), value.count("/"), value.count("-"), value.count("."), value.count("_"), bool(re.fullmatch(r"[0-9a-fA-F]+", value)), value.isdigit(),
        bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)), n % 4 == 0, n in (32, 40, 64, 128),
        glued[0] == "/" or glued[1] == "/" or "://" in left[-30:], bool(re.search(r"\.[a-z]{1,4}$", low)), glued[0] in "\"'" and glued[1] in "\"'" and "" not in glued,
        assigned, any(w in NAMES or w in ("key", "keys") for w in (*before, *parts)), bool(before) and any(p in NAMES for p in (before[-1], *re.split(r"[_-]", before[-1]))),
        any(w in HARMLESS for w in (*before, *parts)), bool(before) and any(p in HARMLESS for p in (before[-1], *re.split(r"[_-]", before[-1]))), any(w in HARMLESS for w in after),
        bool(re.search(r"(.)\1{4,}|1234|abcd|xxxx|example|change|your|placeholder|dummy|sample|redacted", low)), low.startswith(("akia", "asia", "ghp_", "gho_", "xox", "sk_", "sk-", "eyj", "-----begin")), value.count("$") + value.count("{") + value.count("<"), glued == (":", "@"),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED, known: Lexicon = ENGLISH) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, secret): generated findings, about half of them secrets, with words of the lexicon."""
    r, listed = random.Random(seed), sorted(known.words)
    hexa, base = "0123456789abcdef", string.ascii_letters + string.digits
    rand = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))

    def word() -> str:
        return r.choice(listed) if r.random() < 0.5 else "".join(r.choice("bcdfghlmnprstv") + r.choice("aeiou") + r.choice(["", "n", "r", "st"]) for _ in range(r.randint(1, 3)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def password() -> str:
        """As people make them: words with digits and signs, letters replaced."""
        w, sign, digits = word(), r.choice("!@#$%^&*?-_."), str(r.randint(1, r.choice([9, 99, 9999])))
        v = r.random()
        if v < 0.35:
            out = f"{w.capitalize()}{digits}{sign}{word()}"
        elif v < 0.6:
            out = f"{w}{sign}{word().capitalize()}{digits}"
        elif v < 0.85:
            out = f"{w.capitalize()}{word()}{digits}".translate(str.maketrans({"o": "0", "e": "3", "a": "@", "s": "5", "i": "1"})) + r.choice(["", sign])
        else:
            out = rand(base + "!@#%^*", r.randint(8, 14))
        return out + "".join(r.choice(base) for _ in range(8 - len(out)))

    def named() -> str:
        name, prefix, suffix = r.choice(NAMES), word(), word()
        name = r.choice([name, name, f"{prefix}_{name}", f"{name}s", f"{name}_{suffix}", f"{prefix}_{name}_{suffix}", f"{prefix}-{name}"])
        return name.upper() if r.random() < 0.3 else name

    def random_value() -> str:
        v = r.random()
        if v < 0.35:
            return rand(hexa, r.choice([32, 40, 40, 64]))
        if v < 0.65:
            return rand(base, r.randint(20, 48))
        if v < 0.75:
            return rand(base + "+/", r.choice([40, 43, 44, 86])) + r.choice(["", "=", "=="])
        if v < 0.85:
            return rand(base + "_-", r.randint(20, 44))
        return rand(base + "!@#%^*", r.randint(10, 20))

    def secret() -> tuple[str, str, str]:
        v = r.random()
        if v < 0.15:
            value = r.choice([f"AKIA{rand(string.ascii_uppercase + string.digits, 16)}", f"ghp_{rand(base, 36)}", f"xoxb-{rand(string.digits, 11)}-{rand(base, 24)}", f"sk-{rand(base, 40)}", f"eyJ{rand(base, 17)}.eyJ{rand(base, 40)}.{rand(base + '_-', 43)}"])
            return r.choice(["", "key: ", "token = ", "Authorization: Bearer "]), value, ""
        if v < 0.18:
            return "", f"-----BEGIN RSA PRIVATE KEY-----\n{rand(base + '+/', 200)}\n-----END RSA PRIVATE KEY-----", ""
        if v < 0.24:
            return f"{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'ftp'])}://{r.choice([word(), 'admin', 'root', ''])}:", r.choice([password(), password()[: r.randint(5, 9)], random_value()]).replace("@", "a").replace("/", "b"), f"@{word()}.{word()}.com/{word()}"
        quote = r.choice(['"', '"', "'", ""])
        value = password() if r.random() < 0.3 else random_value()
        if quote and r.random() < 0.06:
            value = " ".join(word() for _ in range(r.randint(3, 6)))
        return f"{named()}{r.choice([' = ', '=', '=', ': ', ' := ', chr(34) + ': '])}{quote}", value, quote

    def harmless() -> tuple[str, str, str]:
        v = r.random()
        if v < 0.04:
            return f"{r.choice(['postgres', 'https', 'mysql'])}://{r.choice(['user', 'username', word()])}:", r.choice(["password", "pass", "${PASSWORD}", "xxxx", "<password>", "$PASS"]), "@localhost"
        if v < 0.2:
            return f"{r.choice(HARMLESS)}{r.choice([' ', ': ', ' = ', '=', '-'])}{r.choice(['', chr(34)])}", rand(hexa, r.choice([32, 40, 64])), ""
        if v < 0.3:
            return f"{words(1, 2)} ", rand(string.digits, r.choice([16, 16, 18, 20])), " "
        if v < 0.38:
            return r.choice(["", "uuid ", "id: ", "id="]), f"{rand(hexa, 8)}-{rand(hexa, 4)}-{rand(hexa, 4)}-{rand(hexa, 4)}-{rand(hexa, 12)}", ""
        if v < 0.5:
            return r.choice(["/", "https://", "see "]), "/".join(word() for _ in range(r.randint(2, 6))) + f"/{word()}{r.randint(1, 99)}", r.choice([".html", ".py", "/", ""])
        if v < 0.62:
            return f"{named()}{r.choice([' = ', ': ', '='])}{chr(34)}", r.choice(["xxxxxxxxxxxxxxxx", "your_" + word() + "_here", "changeme123456", "EXAMPLE" + word().upper() + "KEY1234", "${" + word().upper() + "_TOKEN}", "<" + word() + "-" + word() + ">", "0" * 32, "1234567890abcdef", "dummy-" + word() + "-value"]), '"'
        if v < 0.72:
            return f"{named()}{r.choice([' = ', ': ', '='])}", r.choice([f"get_{word()}_{word()}()", f"os.environ[{word()}]", f"config.{word()}.{word()}", f"{word()}{word()}{word()}"]), ""
        if v < 0.82:
            return f"{word()} ", "".join(word().capitalize() for _ in range(r.randint(3, 5))) + str(r.randint(1, 99)), " "
        if v < 0.9:
            return f"{word()} ", "-".join([*(word() for _ in range(r.randint(2, 5))), str(r.randint(1, 2999))]), " "
        return f"{r.choice(['version', 'build', 'serial', 'ref'])} ", f"{r.randint(1, 20)}-{r.randint(1, 20)}-{rand(string.digits, 8)}_{word()}{r.choice(['', '-rc1'])}", ""

    out = []
    while len(out) < n:
        bad = r.random() < 0.5
        left, value, right = secret() if bad else harmless()
        if r.random() < 0.08:
            left, value = left.upper(), value.upper() if re.fullmatch(r"[0-9a-f]+", value) else value
        left = f"{words(1, 8)}{r.choice([' ', chr(10), '. '])}{left}"
        out.append((f"{left}{value}{right}{r.choice([' ', chr(10), ', ', ''])}{words(0, 8)}", len(left), len(left) + len(value), bad))
    return out


class Scanner:
    """A forest and the words that its features look for."""

    def __init__(self, trees: Trees, known: Lexicon = ENGLISH):
        self.trees, self.known = trees, known

    def findings(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of each candidate of one text."""
        found = list(candidates(text))
        if not found:
            return []
        scores = self.trees.total(np.array([describe(text, a, b, self.known) for a, b, _ in found], np.float64))
        return [(a, b, kind, float(min(max(s, 0), 1))) for (a, b, kind), s in zip(found, scores, strict=True)]


def train(findings: list[tuple[str, int, int, bool]], known: Lexicon = ENGLISH) -> Scanner:
    """A forest of labelled findings (text, start, end, secret); at most FINDINGS are used."""
    used = findings[:FINDINGS]
    x = np.array([describe(t, a, b, known) for t, a, b, _ in used], np.float64)
    return Scanner(forest(x, np.array([bad for *_, bad in used], float)), known)


def fit(df: DataFrame) -> Scanner:
    """Learns from generated findings, with the commonest words of (text) as its dictionary."""
    known = lexicon(df)
    return train(labelled_findings(known=known), known)


def scan(df: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, start, end, kind, value_sha256, score, is_secret) for each candidate of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(scanner or fit(df))
    names = ["doc_id", "start", "end", "kind", "value_sha256", "score", "is_secret"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_())

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = data.as_py().decode("utf-8", "replace")
                rows += [(doc_id, a, b, kind, hashlib.sha256(text[a:b].encode()).hexdigest(), s, s >= SECRET) for a, b, kind, s in shared.value.findings(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).transform(in_slices, run, "doc_id long, start int, end int, kind string, value_sha256 string, score double, is_secret boolean")


def redact(df: DataFrame, scanner: Scanner | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each secret of `text` replaced by the mask; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(scanner or fit(df))

    def run(batches):
        for batch in batches:
            place, out = batch.schema.get_field_index("text"), []
            for x in batch.column(place):
                text = x.as_py()
                for a, b, _, s in reversed(shared.value.findings(text or "")):
                    if s >= SECRET:
                        text = text[:a] + mask + text[b:]
                out.append(text)
            yield batch.set_column(place, "text", pa.array(out, pa.string()))

    return df.transform(in_slices, run, df.schema)
