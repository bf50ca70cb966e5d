"""Secret scans: patterns find candidates, a random forest takes the false ones out.

Candidates are provider keys with a known prefix, private keys between their
marker lines, values (six characters or more) assigned to a name with a word
like ``password`` or ``token``, and opaque runs (16 or more) of letters and
digits.  None has a longest length.  Each is
described by its length, its character transitions (how much likelier prose
makes them than chance), the share of its letters that dictionary words cover,
the words beside it and the path it is in.  A random forest, trained on
labelled findings, says how likely it is a secret.

The prose statistics and the dictionary are counted over all documents.  Only
the contexts of the labelled findings that ``labelled_findings`` makes come
from a bounded sample: strings of known kinds, secret and harmless, put between
words of the sample.  Findings labelled by people can be given instead.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import drop, materialise, table
from tamarack.llm.ranking import first_share, seeded_hash

#: The sample that labelled findings are made from: so many documents and bytes of text at most.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1_000_000
#: The dictionary has the words that are at least one in so many of all words: it can't have more words than that.
DICTIONARY = 1 << 18
#: Labelled findings that are made: so many secret and so many harmless ones.
FINDINGS = 2000
#: Characters looked at on either side of a candidate.
BESIDE = 48
THRESHOLD = 0.5

#: Prefixes of provider keys and how they go on.
PROVIDER = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}"
KEYWORD = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
PRIVATE = r"(?:[A-Z0-9]++ ){0,4}PRIVATE KEY-----"
#: Possessive runs that begin only where a name begins: linear time on any text.
NAMED = re.compile(
    rf"(?<![A-Za-z0-9])(?P<provider>{PROVIDER})"
    rf"|(?P<pem>-----BEGIN {PRIVATE}(?:[^-]|-(?!----))*+-----END {PRIVATE})"
    r"|(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z0-9_.\-]++)[\"']?+[ \t]*+(?::=|=>|[:=]{1,2}+)[ \t]*+"
)
VALUE = re.compile(r"\"(?P<double>[^\"\n]{6,}+)\"|'(?P<single>[^'\n]{6,}+)'|[\"'`]?(?P<plain>[^\s\"'`<>()]{6,}+)")
SECRET_NAME = re.compile(rf"(?<![A-Za-z])(?i:{KEYWORD})|(?<=[a-z])(?:Pass(?:word|phrase)?|Pwd|Secret|Token|Auth|Credential|ApiKey|AccessKey)")
#: An opaque candidate lies in such a run: 16 characters or more, a letter and a digit, of any length.
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
OPAQUE = 16
MARK = re.compile(r"[+/_\-]")
LAST_MARK, LAST_DIGIT, LAST_LETTER = ((lambda s, chars=c: max(map(s.rfind, chars))) for c in ("+/_-", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
WORD_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
KINDS = ("provider", "pem", "assigned", "opaque")
LETTERS = re.compile(r"[^\W\d_]+")
BEFORE = re.compile(rf"(?:{KEYWORD})[A-Za-z0-9_.\-]*[\"']?\s*[:=>]{{0,2}}\s*[\"']?$", re.IGNORECASE)
HARMLESS = re.compile(r"(?:commit|sha\d*|md5|digest|checksum|hash|revision|uuid|guid|id|build|version|etag|example|sample|dummy|test)[\"']?\s{0,4}[:=#]{0,2}\s{0,4}[\"']?$", re.IGNORECASE)
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|\*{3}|<[a-z]|\$\{|\{\{|todo|test|1234|abcd", re.IGNORECASE)
HARMLESS_PATH = re.compile(r"test|example|sample|fixture|mock|spec|doc|lock|vendor", re.IGNORECASE)
CONFIG_PATH = re.compile(r"\.env|config|settings|secret|credential|\.ya?ml|\.ini|\.toml|\.properties", re.IGNORECASE)


@dataclass
class Prose:
    """Frozen statistics of ordinary text: character transitions and words."""

    transitions: np.ndarray  # log2 of how much likelier prose makes a pair of character classes than chance
    words: frozenset[str]


def _classes(s: str) -> np.ndarray:
    """a-z, A-Z, 0-9, the rest."""
    raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8).astype(np.int64)
    out = np.full(len(raw), 62, np.int64)
    for begin, first, n in ((97, 0, 26), (65, 26, 26), (48, 52, 10)):
        hit = (raw >= begin) & (raw < begin + n)
        out[hit] = raw[hit] - begin + first
    return out


def _pairs(text: str) -> np.ndarray:
    c = _classes(text)
    return np.bincount(c[:-1] * 63 + c[1:], minlength=63 * 63)


def _transitions(pairs: np.ndarray) -> np.ndarray:
    seen = pairs.reshape(63, 63) + 1.0
    return np.log2(seen / seen.sum(1, keepdims=True) * 63)


def learn_prose(texts: Sequence[str], least: int = 2) -> Prose:
    pairs = np.zeros(63 * 63, np.int64)
    words: Counter = Counter()
    for t in texts:
        pairs += _pairs(t)
        words.update(w.lower() for w in LETTERS.findall(t) if len(w) >= 3)
    return Prose(_transitions(pairs), frozenset(w for w, n in words.items() if n >= least))


COUNTS = "pair int, word string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> counts of pairs of character classes (``word`` null) and of words (``pair`` null), summed up as far as memory is bounded."""
    pairs, words = np.zeros(63 * 63, np.int64), Counter()

    def made(pair, word, n):
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=[x.split()[0] for x in COUNTS.split(", ")])

    def flush():
        low: Counter = Counter()
        for w, n in words.items():
            # No feature looks at a word beside a candidate that is longer than BESIDE.
            if 3 <= len(w) <= BESIDE:
                low[w.lower()] += n
        words.clear()
        return made([None] * len(low), list(low), list(low.values()))

    for b in batches:
        for at in range(0, b.num_rows, 64):
            for t in b.column(0).slice(at, 64).to_pylist():
                pairs += _pairs(t)
                words.update(LETTERS.findall(t))
            if len(words) > 200_000:
                yield flush()
    yield flush()
    some = np.flatnonzero(pairs)
    yield made(some, [None] * len(some), pairs[some])


def corpus_prose(docs: DataFrame, least: int = 2, most: int = DICTIONARY) -> Prose:
    """Statistics of all texts of ``docs``; repeated rows count each.

    A word is in the dictionary if it occurs ``least`` times or more and makes
    up ``1 / most`` of all words or more, so that at most ``most`` words are.
    """
    counted = docs.where("text is not null").select("text").mapInArrow(_count, COUNTS)
    counts = materialise(counted.groupBy("pair", "word").agg(F.sum("n").alias("n")), "counts")
    pairs = np.zeros(63 * 63, np.int64)
    for r in counts.where("word is null").collect():
        pairs[r.pair] = r.n
    total = counts.where("word is not null").agg(F.sum("n")).first()[0] or 0
    words = counts.where((F.col("word").isNotNull()) & (F.col("n") >= max(least, -(-total // most)))).select("word").collect()
    drop(counts)
    return Prose(_transitions(pairs), frozenset(r.word for r in words))


def dictionary_coverage(text: str, words: frozenset[str], longest: int = 16) -> float:
    """Share of the letters that words cover, the longest first from the left."""
    letters = covered = 0
    for run in LETTERS.findall(text):
        run = run.lower()
        letters += len(run)
        at = 0
        while at < len(run):
            for n in range(min(longest, len(run) - at), 2, -1):
                if run[at : at + n] in words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
    return covered / letters if letters else 0.0


FEATURES = (
    "length", "entropy", "transitions", "coverage", "digits", "upper", "lower", "marks", "switches", "hex", "distinct",
    "provider", "assigned", "keyword_before", "harmless_before", "placeholder", "quoted", "assignment", "word_before", "word_after", "harmless_path", "config_path",
)


def features(candidate: str, kind: str, before: str, after: str, path: str | None, prose: Prose) -> list[float]:
    n = len(candidate)
    counts = np.array(list(Counter(candidate).values()), float) / n
    c = _classes(candidate)
    group = np.where(c < 26, 0, np.where(c < 52, 1, np.where(c < 62, 2, 3)))
    share = np.bincount(group, minlength=4) / n
    last, first = LETTERS.findall(before)[-1:], LETTERS.findall(after)[:1]
    known = lambda w: float(bool(w) and w[0].lower() in prose.words)
    return [
        float(n), float(-(counts * np.log2(counts)).sum()), float(prose.transitions[c[:-1], c[1:]].mean()) if n > 1 else 0.0, dictionary_coverage(candidate, prose.words),
        float(share[2]), float(share[1]), float(share[0]), float(share[3]), float((group[1:] != group[:-1]).sum() / n), float(all(x in "0123456789abcdefABCDEF" for x in candidate)), len(set(candidate)) / n,
        float(kind in ("provider", "pem")), float(kind == "assigned"), float(bool(BEFORE.search(before))), float(bool(HARMLESS.search(before))), float(bool(PLACEHOLDER.search(candidate))),
        float(before[-1:] in "\"'" and bool(before)), float(bool(re.search(r"[:=]\s*[\"']?$", before))), known(last), known(first), float(bool(HARMLESS_PATH.search(path or ""))), float(bool(CONFIG_PATH.search(path or ""))),
    ]


class _Run:
    """A run of opaque characters, and where candidates in it can begin and end; looked through once, so that long ones take linear time."""

    def __init__(self, text: str, m: re.Match):
        self.text, self.begin, self.end = text, *m.span()
        run = m.group()
        # Both a digit and a letter are at or after the start.
        self.latest = self.begin + min(LAST_DIGIT(run), LAST_LETTER(run))
        self.mark = self.begin + LAST_MARK(run)
        # The whole run and up to two "=", if no word or address goes on after it.
        signs = 2 if text.startswith("==", self.end) else int(text.startswith("=", self.end))
        ends = (self.end + k for k in range(signs, -1, -1))
        self.whole = next((e for e in ends if text[e : e + 1] not in WORD_CHARACTERS and text[e : e + 1] != "@"), None)

    def first(self, at: int) -> tuple[int, int] | None:
        """The candidate with the first start from ``at`` on."""
        s = max(at, self.begin)
        if s and self.text[s - 1] in WORD_CHARACTERS:
            m = MARK.search(self.text, s, self.end)
            if not m:
                return None
            s = m.end()
        if s > self.latest or s + OPAQUE > self.end:
            return None
        if self.whole is not None:
            return s, self.whole
        return (s, self.mark) if self.mark >= s + OPAQUE else None


def _named(text: str, at: int) -> tuple[str, int, int, int] | None:
    """(kind, start of the match, start and end of the candidate) of the first named candidate from ``at`` on."""
    while m := NAMED.search(text, at):
        kind = m.lastgroup
        if m.group("name") is None:
            return kind, m.start(), *m.span(kind)
        value = VALUE.match(text, m.end()) if SECRET_NAME.search(m.group("name")) else None
        if value:
            s, e = value.span(value.lastgroup)
            while value.lastgroup == "plain" and e - s >= 6 and text[e - 1] in ",;":
                e -= 1
            if e - s >= 6:
                return "assigned", m.start(), s, e
        at = m.end()  # the value may hold a name of its own
    return None


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): the leftmost candidate, then the leftmost after it; named ones come before opaque ones."""
    at, run, named, opaque = 0, None, _named(text, 0), None
    runs = True
    while True:
        if named and named[1] < at:
            named = _named(text, at)
        if opaque is None or opaque[0] < at:
            opaque, from_ = None, at
            while runs and opaque is None:
                if run is None or from_ >= run.end:
                    m = RUN.search(text, from_)
                    runs = m is not None
                    run = _Run(text, m) if m else None
                if run:
                    opaque = run.first(from_)
                    from_ = max(from_, run.end)
        if named and (opaque is None or named[1] <= opaque[0]):
            yield named[0], *named[2:]
            at = named[3]
        elif opaque:
            yield "opaque", *opaque
            at = opaque[1]
        else:
            return


def candidates(text: str | None) -> Iterator[tuple[int, str, str, str, str]]:
    """(first character, candidate, kind, text before, text after) of a whole text, without overlaps; candidates have any length."""
    text = text or ""
    for kind, s, e in _found(text):
        found = text[s:e].rstrip(".:!?")
        if len(found) >= 6:
            yield s, found, kind, text[max(0, s - BESIDE) : s], text[s + len(found) : s + len(found) + BESIDE]


LETTERS_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: How a value is assigned: (before, after).
KEYS = (("password=", ""), ("password: ", ""), ('token = "', '"'), ("secret=", ""), ("api_key='", "'"), ('"apikey": "', '"'), ("pwd=", ";"), ("access_key = ", ""), ('auth_token="', '"'), ("credential=", ","), ("token_for_production_db = ", ""), ("password     = ", ""))
PATHS = ("src/app.py", "config/settings.yaml", ".env", "notes.md", "web", "", "tests/fixtures/a.json", "package.lock")


class Maker:
    """Strings of known kinds between words: each method gives (before, candidate, after, path or None)."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words

    def of(self, chars: str, n: int) -> str:
        return "".join(self.rng.choices(chars, k=n))

    def hexa(self, *lengths: int) -> str:
        return self.of("0123456789abcdef", self.rng.choice(lengths))

    def word(self) -> str:
        return self.rng.choice(self.words)

    def long(self) -> int:
        return int(16 * 2 ** (8 * self.rng.random()))  # 16 to 4,096

    def base64(self, n: int) -> str:
        return base64.b64encode(self.rng.randbytes(n)).decode()

    def assigned(self, value: str):
        return self.rng.choice(KEYS)[0], value, "", None

    def quoted(self, value: str):
        before, after = self.rng.choice([k for k in KEYS if k[1] in "\"'" and k[1]])
        return before, value, after, None

    def secret_cloud_key(self):
        return self.word() + " ", self.rng.choice(("AKIA", "ASIA")) + self.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), "", None

    def secret_provider_key(self):
        return self.word() + " ", self.rng.choice(("ghp_", "sk_live_", "AIza")) + self.of(LETTERS_DIGITS, 36), "", None

    def secret_hex(self):
        return self.assigned(self.hexa(16, 18, 20, 32, 40, 64, 128))

    def secret_mixed(self):
        return self.assigned(self.of(LETTERS_DIGITS, self.rng.randrange(10, 48)))

    def secret_password(self):
        return self.quoted(self.of(LETTERS_DIGITS, self.rng.randrange(3, 14)) + self.rng.choice("!#%&*+-_;,") + self.of(LETTERS_DIGITS, 4))

    def secret_short(self):
        return self.assigned(self.of(LETTERS_DIGITS, self.rng.randrange(6, 10)))

    def secret_long(self):
        return self.assigned(self.of(LETTERS_DIGITS, self.long()))

    def secret_blob(self):
        return self.rng.choice(KEYS)[0], self.base64(self.long()), "", None

    def secret_web_token(self):
        part = lambda n: base64.urlsafe_b64encode(self.rng.randbytes(n)).decode().rstrip("=")
        return self.rng.choice(("token=", "auth: ", "authorization: ")), f"eyJ{part(24)}.eyJ{part(60)}.{part(32)}", "", None

    def secret_private_key(self):
        kind = self.rng.choice(("RSA ", "EC ", "OPENSSH ", ""))
        body = self.base64(self.rng.randrange(100, 1500))
        lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
        return self.word() + "\n", f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", "\n", None

    def harmless_placeholder(self):
        return self.assigned(self.rng.choice(("changeme", "your_password", "xxxxxxxx", "example-token", "${PASSWORD}", "{{secret}}", "********", "placeholder", "test1234", "dummy-secret-1")))

    def harmless_digest(self):
        return self.rng.choice(("commit ", "sha1: ", "sha256:", "md5=", "checksum: ", "digest=", "etag: ", "revision ")), self.hexa(32, 40, 64), "", None

    def harmless_uuid(self):
        return self.rng.choice(("id: ", "uuid=", self.word() + " ")), str(uuid.UUID(int=self.rng.getrandbits(128))), "", None

    def harmless_path(self):
        return self.word() + " ", "/".join([self.word(), self.word(), f"{self.word()}{self.rng.randrange(100)}"]), "", None

    def harmless_slug(self):
        return self.word() + " ", "-".join([self.word(), self.word(), str(self.rng.randrange(2030)), self.word()]), "", None

    def harmless_words_assigned(self):
        return self.assigned(self.word() + self.rng.choice(("", "_", "-")) + self.word())

    def harmless_sentence(self):
        return self.rng.choice(("password: ", "token: ", "author: ", "secret: ")), f"{self.word()}{self.word()} {self.word()} {self.word()}", "", None

    def harmless_quoted_prose(self):
        return self.quoted(" ".join(self.word() for _ in range(self.rng.randrange(2, 6))))

    def harmless_version(self):
        return self.rng.choice(("build ", "version ", self.word() + " ")), f"{self.word()}-{self.rng.randrange(30)}-{self.rng.randrange(30)}-{self.rng.randrange(10**6)}", "", None

    def harmless_text_blob(self):
        return "image base64 ", base64.b64encode(" ".join(self.word() for _ in range(3)).encode()).decode(), "", "tests/fixtures/a.json"

    def harmless_integrity(self):
        return "integrity: ", "sha512-" + self.base64(64), "", "package.lock"

    def harmless_numbers(self):
        return self.word() + " ", self.of("0123456789", self.rng.randrange(12, 20)) + self.rng.choice("abkmpx") * 4, "", None

    def harmless_name(self):
        parts = [self.word() for _ in range(3)]
        return self.word() + " ", parts[0] + "".join(p.title() for p in parts[1:]) + str(self.rng.randrange(1000)), "", None


#: The kinds that ``Maker`` makes.
MADE = tuple(n for n in vars(Maker) if n.startswith(("secret_", "harmless_")))
Finding = tuple[str, str, str, str, str, int, str]  # candidate, kind, before, after, path, label, kind made


def labelled_findings(texts: Sequence[str], n: int = FINDINGS, seed: int = 10, kinds: Sequence[str] = MADE) -> list[Finding]:
    """``n`` findings of known ``kinds``, half of them secret if both sorts are among these, put between words of ``texts``; only those that the patterns find."""
    rng = random.Random(seed)
    words = [w for t in texts for w in LETTERS.findall(t)[:400] if 3 <= len(w) <= 14 and w.isascii()] or ["word", "other", "more"]
    maker, out = Maker(rng, words), []
    sorts = [s for s in ([k for k in kinds if k.startswith("secret_")], [k for k in kinds if k.startswith("harmless_")]) if s]
    while len(out) < n:
        name = rng.choice(rng.choice(sorts))
        before, made, after, path = getattr(maker, name)()
        text = f"{' '.join(rng.choices(words, k=5))} {before}{made}{after} {' '.join(rng.choices(words, k=5))}"
        hit = next((c for c in candidates(text) if c[1] and c[1] in made and (len(c[1]) * 2 > len(made) or name == "harmless_sentence")), None)
        if hit:
            out.append((hit[1], hit[2], hit[3], hit[4], rng.choice(PATHS) if path is None else path, int(name.startswith("secret_")), name))
    return out


def train(spark: SparkSession, findings: Sequence[Finding], prose: Prose, trees: int = 40, depth: int = 8, seed: int = 10) -> RandomForestClassificationModel:
    """A random forest on labelled findings, which the caller has bounded."""
    rows = [([*features(*f[:5], prose)], float(f[5])) for f in findings]
    # One partition: trees then don't hang on how the rows were dealt out.
    df = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1).select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(df)


def sample_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, seed: int = 10) -> list[str]:
    """The first texts in a seeded order, so many and of so many bytes at most (longer ones are passed over)."""
    sized = docs.where("text is not null and doc_id is not null").select("doc_id", F.octet_length("text").alias("n"), seeded_hash(seed, "doc_id").alias("h")).where(F.col("n") <= sample_bytes)
    sized = sized.where(first_share(F.col("h"), sample_docs, docs.count()))
    first = sized.orderBy("h", "doc_id", "n").limit(sample_docs).withColumn("b", F.sum("n").over(Window.orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)))
    chosen = first.where(F.col("b") <= sample_bytes).select("doc_id").distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").where(F.octet_length("text") <= sample_bytes).collect()
    return [r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


CANDIDATES = "doc_id long, start long, length int, kind string, digest string, x array<double>"


def _scan(prose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Prose = prose.value
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, text, path in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for start, found, kind, before, after in candidates(text):
                        rows.append((doc_id, start, len(found), kind, hashlib.sha256(found.encode("utf-8", "replace")).hexdigest()[:16], features(found, kind, before, after, path, p)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in CANDIDATES.split(", ")])

    return run


def scan(docs: DataFrame, model: RandomForestClassificationModel, prose: Prose, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row a candidate: ``doc_id, start, length, kind, digest, score, secret``.

    ``start`` counts characters from 0; ``digest`` is the start of the
    candidate's SHA-256, so that the result doesn't repeat the secret.
    ``secret`` is ``score >= threshold``.  Assigned values have six characters
    or more, opaque runs 16 or more; there is no longest.  Whole texts are read; null and empty
    ones have no candidates, repeated rows give theirs each, a null ``doc_id``
    stays null.  Without a column ``path`` none is known; other columns are
    passed over.  An empty table gives an empty result.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("long"), "text", where.alias("path")).mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(prose)), CANDIDATES)
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", "kind", "digest", score.alias("score"), (score >= threshold).alias("secret"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prose = corpus_prose(docs)
    return scan(docs, train(spark, labelled_findings(sample_texts(docs)), prose), prose)
