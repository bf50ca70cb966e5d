"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path; its key is both joined, like ``net/de/``.  A URL
fits a rule exactly if the rule's key is among the URL's own keys: the ends of
its host by labels, each joined with a beginning of its path.  Only the shapes
(labels, path length) that rules have are formed.

A cascade answers which keys are listed.  Its first level is a Bloom filter of
the listed keys; the second one of the keys of the corpus that the first takes
wrongly for listed; the third of the listed keys that the second takes wrongly
for those; and so on, until a level takes none wrongly.  Over the complete
universe of the corpus's keys the answer is therefore exact, and a URL is
judged by arithmetic on a few literals, without a join.  A level has as many
bits as the list calls for, not the corpus: the first level's error rate is set
so that about as many keys pass it wrongly as are listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import drop, fresh, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a level at most (16 MB), which is one literal; longer lists are cut into parts.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` (a multiple of 64) as 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        one = F.pmod(F.xxhash64(key, F.lit(self.number)), F.lit(self.bits))
        two = F.pmod(F.xxhash64(F.lit(self.number), key), F.lit(self.bits - 1)) + 1
        return [F.pmod(one + two * i, F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a literal
        out = None
        for p in self.positions(key):
            bit = F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
            out = bit if out is None else out & bit
        return out


def _rate(listed: int, others: int) -> float:
    """The first level's error rate: about as many keys pass it wrongly as are listed."""
    return min(0.5, max(1e-9, 0.7 * listed / max(1, others)))


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    bits = _bits(n, rate)
    empty = Level(number, bits, max(1, round(-math.log2(rate))), ())
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).collect()  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.b
    return Level(number, bits, empty.hashes, tuple(words))


@dataclass
class Cascade:
    """``parts``: the levels for the keys of each part, told by a hash of the key."""

    parts: list[list[Level]] = field(default_factory=list)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
        """Exact for every key of ``universe(key)``: whether it is among ``listed(key)``.

        Null keys are in neither; repeated keys count once.  Either table may
        be empty.  A list whose first level would need over ``max_bits`` is
        cut into parts by a hash of the key, each with levels of its own; what
        a task holds is then all of them, some two bytes a listed key.
        """
        every = universe.where("key is not null").select("key").distinct()
        known = listed.where("key is not null").select("key").distinct()
        inside = materialise(every.join(known, "key", "left_semi"), "listed")
        outside = materialise(every.join(known, "key", "left_anti"), "unlisted")
        n, m = inside.count(), outside.count()
        parts = -(-2 * _bits(n, _rate(n, m)) // max_bits) if n and _bits(n, _rate(n, m)) > max_bits else 1
        if parts == 1:
            out = cls([cls._levels(inside, outside)] if n else [])
        else:
            of = cls._part(F.col("key"), parts)
            out = cls([cls._levels(inside.where(of == p), outside.where(of == p)) for p in range(parts)])
        drop(inside)
        drop(outside)
        return out

    @staticmethod
    def _part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))

    @staticmethod
    def _levels(inside: DataFrame, outside: DataFrame) -> list[Level]:
        held, out, encode, other = [], [], inside, outside
        n, m = encode.count(), other.count()
        while n:
            level = _level(encode, n, len(out) + 1, 0.5 if out else _rate(n, m))
            out.append(level)
            if len(out) > 200:
                raise RuntimeError("the cascade does not end")
            wrong = materialise(other.where(level.holds(F.col("key"))), "wrong")
            held.append(wrong)
            encode, other, n = wrong, encode, wrong.count()
        for df in held:
            drop(df)
        return out

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; null keys are not."""
        out = None
        for p, levels in enumerate(self.parts):
            answer = F.lit(len(levels) % 2 == 1)
            for level in reversed(levels):
                answer = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(answer)
            here = self._part(key, len(self.parts)) == p
            out = F.when(here, answer) if out is None else out.when(here, answer)
        return F.coalesce(F.when(key.isNotNull(), out), F.lit(False)) if out is not None else F.lit(False)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    begin = F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1
    return F.coalesce(F.regexp_extract(F.substr(rest, begin), "^[^?#]*", 0), F.lit(""))


def _keys(rules: Sequence[Rule], host: Column, path: Column) -> list[tuple[int, Column]]:
    """(labels, key) for each shape that rules have; null where the URL is shorter."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    labels_of = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    return [(labels, F.when((labels_of >= labels) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -labels), F.substr(path, F.lit(1), F.lit(n))))) for labels, n in shapes]


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Needs a ``url`` column; columns with the four names are replaced, others
    stay.  A rule fits its host and all subdomains, if the URL's path starts
    with the rule's; of fitting rules the longest wins (of equal length that
    with more labels).  Where none fits, ``rule`` is null and the verdict
    ``default``.  A null URL or one without ``://`` has empty host and path.
    Repeated rows keep a row each; an empty table gives an empty result.  Two
    verdicts for one key are an error.
    """
    rules = list(rules)
    if len({r.key for r in rules}) < len({(r.key, r.verdict) for r in rules}):
        raise ValueError("a rule has two verdicts")
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.col("url").alias("_url")).select(host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shaped = _keys(rules, F.col("host"), F.col("path"))
    # The universe: each key of any shape that a URL of the corpus has.
    universe = materialise(urls.select(F.explode(F.array(*[k for _, k in shaped])).alias("key")).where("key is not null").distinct(), "url-keys")
    cascades = {v: Cascade.build(spark.range(1).select(F.explode(F.array(*[F.lit(r.key) for r in rules if r.verdict == v])).alias("key")), universe, max_bits) for v in sorted({r.verdict for r in rules})}
    drop(universe)
    # A lambda's argument is computed once; spelled out, each key would be once more for each hash.
    verdict = lambda key: F.coalesce(*[F.when(c.listed(key), F.lit(v)) for v, c in cascades.items()])
    keys = F.array(*[F.struct(F.lit(labels).alias("labels"), key.alias("key")) for labels, key in shaped])
    hits = F.transform(keys, lambda k: F.struct(F.length(k["key"]).alias("n"), k["labels"].alias("labels"), k["key"].alias("key"), verdict(k["key"]).alias("verdict")))
    hits = F.filter(hits, lambda h: h["verdict"].isNotNull())
    best = fresh(rows, "_best")
    out = rows.withColumn(best, F.array_max(hits))
    return out.withColumns({"rule": F.col(f"{best}.key"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


#: The rules of the query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT *, '.' || host AS dotted FROM p),
j AS (SELECT page_id, host, path,
       CASE WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN ends_with(dotted, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN ends_with(dotted, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN ends_with(dotted, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM m)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
